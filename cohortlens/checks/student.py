"""Registered queries of the student workload."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.checks import views as V
from cohortlens.checks.registry import check, part
from cohortlens.functions import expressions as X
from cohortlens.operators import encode, frequent, rows, stats
from cohortlens.plans import course, students, term
from cohortlens.session import scratch_path
from cohortlens.sources import domain as D
from cohortlens.sources import readers as R
from cohortlens.sources.readers import Tables

SQLTEXT = Path(__file__).resolve().parent.parent / "sqltext"
SNAPSHOT_TERM = 1001
STUDENT = "37"
OUTLIER_LOAD = 1.0


def terms(t: Tables) -> DataFrame:
    return term.term_aggregate(course.course_features(D.enrolments(t)))


def cumulative(t: Tables) -> DataFrame:
    return term.cumulate(terms(t), course.CUMULATED)


def master(t: Tables) -> DataFrame:
    return students.student_master(
        D.population(t),
        students.demographics(D.dae_raw(t)),
        D.pell_raw(t),
        students.admissions(D.admissions_raw(t)),
    )


def features(t: Tables) -> DataFrame:
    return students.student_features(
        term.term_features(D.enrolments(t)),
        students.encode_students(master(t), V.ENCODING),
        V.ENCODING,
    )


def shown(df: DataFrame) -> DataFrame:
    return df.withColumns({c: X.rounded(c) for c in V.FLOATING if c in df.columns})


# ---- sources, sinks and projections


@check(
    "scan_sql_file",
    """SELECT CAST(o_custkey AS VARCHAR) AS emplid, CAST(year(o_orderdate) AS INT) AS start_year,
  count(*) AS n_courses, sum(l_quantity) AS total_quantity
FROM orders JOIN lineitem ON l_orderkey = o_orderkey
GROUP BY o_custkey, year(o_orderdate)""",
)
def scan_sql_file(t: Tables) -> DataFrame:
    views = {"course_orders": t.orders, "course_lines": t.lineitem}
    return R.run_sql_file(t.spark, SQLTEXT / "term_units.sql", views)


@check(
    "masked_scan",
    "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_mktsegment, c_nationkey FROM customer",
)
def masked_scan(t: Tables) -> DataFrame:
    return R.masked_scan(t.customer, ["c_custkey", "c_mktsegment", "c_nationkey"], "c_custkey")


@check(
    "csv_roundtrip",
    """SELECT CAST(p_partkey AS VARCHAR) AS isbn, p_name AS book_title, p_brand AS publisher,
  p_size AS year_of_publication, p_retailprice AS price FROM part""",
)
def csv_roundtrip(t: Tables) -> DataFrame:
    source = t.part.select(
        F.col("p_partkey").cast("string"), "p_name", "p_brand", "p_size", "p_retailprice"
    )
    path = R.write_delimited(source, scratch_path(t.spark, "books"))
    schema = T.StructType(
        [
            T.StructField("p_partkey", T.StringType()),
            T.StructField("p_name", T.StringType()),
            T.StructField("p_brand", T.StringType()),
            T.StructField("p_size", T.IntegerType()),
            T.StructField("p_retailprice", T.DoubleType()),
        ]
    )
    names = ["isbn", "book_title", "publisher", "year_of_publication", "price"]
    return R.read_delimited(t.spark, path, schema, names)


@check(
    "schema_report",
    """SELECT position, column_name, column_type, (SELECT count(*) FROM customer) AS row_count
FROM (VALUES (0, 'c_custkey', 'bigint'), (1, 'c_name', 'string'), (2, 'c_nationkey', 'int'),
  (3, 'c_acctbal', 'double'), (4, 'c_mktsegment', 'string')) AS s(position, column_name, column_type)""",
)
def schema_report(t: Tables) -> DataFrame:
    return rows.schema_report(t.customer)


@check(
    "grade_projection",
    """SELECT emplid AS EMPLID, term_code AS TERM_CODE, plan_cd AS EOT_ACAD_PLAN_CD, units AS UNITS_TAKEN,
  grade AS OFFICIAL_GRADE, grade_points AS GRADE_POINTS, bcmp AS BCMP,
  CASE WHEN bcmp = 1 THEN units ELSE 0 END AS BCMP_UNITS_TAKEN FROM v_enrol""",
)
def grade_projection(t: Tables) -> DataFrame:
    return rows.upper_names(
        D.enrolments(t).select(
            "emplid",
            "term_code",
            F.col("plan_cd").alias("eot_acad_plan_cd"),
            F.col("units").alias("units_taken"),
            F.col("grade").alias("official_grade"),
            "grade_points",
            "bcmp",
            F.when(F.col("bcmp") == 1, F.col("units")).otherwise(0).alias("bcmp_units_taken"),
        )
    )


@check("column_slice", "SELECT cohort, term_code, plan_cd FROM v_enrol")
def column_slice(t: Tables) -> DataFrame:
    return rows.column_slice(D.enrolments(t, science=False), 1, 4)


# ---- joins and lookups


@check(
    "cohort_grades",
    """SELECT p.cohort, e.emplid, e.term_code, e.grade, e.units
FROM v_enrol e JOIN (SELECT d.emplid, p.cohort FROM v_dae d JOIN v_population p ON p.emplid = d.emplid
  WHERE p.cohort IN (954, 964, 974)) p ON p.emplid = e.emplid WHERE e.bcmp = 1""",
)
def cohort_grades(t: Tables) -> DataFrame:
    grades = D.enrolments(t).filter(F.col("bcmp") == 1).select("emplid", "term_code", "grade", "units")
    repeated = (
        D.population(t)
        .filter(F.col("cohort").isin(954, 964, 974))
        .join(D.dae_raw(t).select("emplid"), "emplid")
        .select("emplid", "cohort")
    )
    return rows.inner_with_cohort(grades, repeated, "emplid", distinct=False)


@check(
    "cohort_grades_distinct",
    """SELECT p.cohort, e.emplid, e.term_code, e.grade, e.units
FROM v_enrol e JOIN (SELECT DISTINCT d.emplid, p.cohort FROM v_dae d JOIN v_population p ON p.emplid = d.emplid)
  p ON p.emplid = e.emplid""",
)
def cohort_grades_distinct(t: Tables) -> DataFrame:
    grades = D.enrolments(t).select("emplid", "term_code", "grade", "units")
    repeated = (
        D.population(t).join(D.dae_raw(t).select("emplid"), "emplid").select("emplid", "cohort")
    )
    return rows.inner_with_cohort(grades, repeated, "emplid")


@check("demographics", "SELECT * FROM v_dem")
def demographics(t: Tables) -> DataFrame:
    return students.demographics(D.dae_raw(t))


@check("admissions", "SELECT * FROM v_adm")
def admissions(t: Tables) -> DataFrame:
    return students.admissions(D.admissions_raw(t))


@check(
    "income_band",
    f"""SELECT indep_income, {V.BANDS.format("indep_income")} AS applicant_income, count(*) AS n
FROM v_dae GROUP BY 1, 2""",
)
def income_band(t: Tables) -> DataFrame:
    return D.dae_raw(t).groupBy(
        F.col("indep_income").cast("bigint"), X.income_label("indep_income").alias("applicant_income")
    ).agg(F.count(F.lit(1)).alias("n"))


@check("student_master", "SELECT * FROM v_master")
def student_master(t: Tables) -> DataFrame:
    return master(t)


part(
    "v_gaps",
    """SELECT DISTINCT p.emplid, p.cohort, p.deg_term - p.cohort AS dem_diff_indx, d.* EXCLUDE (emplid),
  e.pell_eligibility, a.* EXCLUDE (emplid)
FROM v_population p LEFT JOIN (SELECT * FROM v_dem WHERE CAST(emplid AS BIGINT) % 7 <> 3) d ON d.emplid = p.emplid
LEFT JOIN v_pell e ON e.emplid = d.emplid LEFT JOIN v_adm a ON a.emplid = d.emplid""",
)


@check("student_master_gaps", "SELECT * FROM v_gaps")
def student_master_gaps(t: Tables) -> DataFrame:
    """With students that have no demographics, and so neither pell status nor scores."""
    known = D.dae_raw(t).filter(F.col("emplid").cast("bigint") % 7 != 3)
    return students.student_master(
        D.population(t),
        students.demographics(known),
        D.pell_raw(t),
        students.admissions(D.admissions_raw(t)),
    )


@check("hs_gpa", "SELECT emplid, gpa_hs, round(gpa_hs / 100.0::DOUBLE, 6) AS hs_points FROM v_adm")
def hs_gpa(t: Tables) -> DataFrame:
    scores = students.admissions(D.admissions_raw(t))
    return scores.select("emplid", "gpa_hs", F.round(X.high_school_gpa("gpa_hs"), 6).alias("hs_points"))


@check(
    "student_lookup",
    f"""SELECT emplid, term_code, plan_cd, cum_units_taken, cum_gpa FROM v_gpa
WHERE emplid = '{STUDENT}' ORDER BY term_code, plan_cd LIMIT 5""",
)
def student_lookup(t: Tables) -> DataFrame:
    found = term.grade_averages(cumulative(t)).select(
        "emplid", "term_code", "plan_cd", "cum_units_taken", "cum_gpa"
    )
    return rows.lookup(found, "emplid", STUDENT, ["term_code", "plan_cd"], 5)


@check(
    "pseudonymise",
    """SELECT substr(sha256(emplid || 'salt'), 1, 32) AS pseudo_id, cohort, deg_term FROM v_population""",
)
def pseudonymise(t: Tables) -> DataFrame:
    return D.population(t).select(X.pseudonym("emplid", "salt").alias("pseudo_id"), "cohort", "deg_term")


# ---- filters


@check(
    "load_outliers",
    f"""SELECT emplid, term_code, plan_cd, units_for_credit, completion_rate, cum_units_for_credit,
  semester_index, load_index FROM v_load WHERE load_index > {OUTLIER_LOAD}""",
)
def load_outliers(t: Tables) -> DataFrame:
    return (
        term.completion(term.load_indexes(cumulative(t)))
        .filter(F.col("load_index") > OUTLIER_LOAD)
        .select(
            "emplid",
            "term_code",
            "plan_cd",
            "units_for_credit",
            "completion_rate",
            "cum_units_for_credit",
            "semester_index",
            "load_index",
        )
    )


@check(
    "complete_rows",
    """SELECT * FROM (SELECT emplid, act_comp, sat_comp, gpa_hs,
  CASE act_comp % 10 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE act_comp / CAST(gpa_hs AS DOUBLE) END AS ratio
  FROM v_adm) WHERE act_comp IS NOT NULL AND sat_comp IS NOT NULL AND gpa_hs IS NOT NULL
  AND ratio IS NOT NULL""",
)
def complete_rows(t: Tables) -> DataFrame:
    digit = F.col("act_comp") % 10
    odd = (
        F.when(digit == 0, F.lit(float("inf")))
        .when(digit == 1, F.lit(float("nan")))
        .otherwise(X.ratio("act_comp", "gpa_hs", "null"))
    )
    source = students.admissions(D.admissions_raw(t))
    return rows.complete_rows(
        source.select("emplid", "act_comp", "sat_comp", "gpa_hs", odd.alias("ratio"))
    )


@check(
    "term_snapshot",
    f"SELECT emplid, plan_cd, term_gpa, cum_gpa FROM v_gpa WHERE term_code = {SNAPSHOT_TERM}",
)
def term_snapshot(t: Tables) -> DataFrame:
    return (
        term.grade_averages(cumulative(t))
        .filter(F.col("term_code") == SNAPSHOT_TERM)
        .select("emplid", "plan_cd", "term_gpa", "cum_gpa")
    )


# ---- aggregates


@check("term_aggregate", "SELECT * FROM v_terms")
def term_aggregate(t: Tables) -> DataFrame:
    return terms(t)


AGG_MAP = {
    "grade_points_in_gpa": "sum",
    "units_taken": "sum",
    "units_in_gpa": "sum",
    "units_for_credit": "sum",
    "g_a": "sum",
    "g_f": "sum",
    "bcmp": "max",
}


def _running(c: str) -> str:
    return (
        f"CAST(sum({c}) OVER (PARTITION BY emplid ORDER BY term_code"
        f" RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum_{c}"
    )


@check(
    "agg_map",
    f"""SELECT *, {V.quotient("grade_points_in_gpa", "units_in_gpa")} AS term_gpa,
  {V.quotient("cum_grade_points_in_gpa", "cum_units_in_gpa")} AS cum_gpa,
  term_code - cohort AS term_diff, {V.semester("term_code - cohort")} AS n,
  15 * {V.semester("term_code - cohort")} AS prescribed_units,
  {V.quotient("cum_units_for_credit", "15 * " + V.semester("term_code - cohort"))} AS load_index,
  {V.quotient("units_for_credit", "units_taken")} AS completion_rate
FROM (SELECT *, {", ".join(_running(c) for c in ("grade_points_in_gpa", "units_taken", "units_in_gpa",
    "units_for_credit"))}
  FROM (SELECT emplid, term_code, cohort,
    CAST(coalesce(sum(gpa_ok * grade_points), 0) AS BIGINT) AS grade_points_in_gpa,
    CAST(sum(units) AS BIGINT) AS units_taken,
    CAST(coalesce(sum(gpa_ok * units), 0) AS BIGINT) AS units_in_gpa,
    CAST(coalesce(sum(credit_ok * units), 0) AS BIGINT) AS units_for_credit,
    CAST(count(*) FILTER (grade = 'A') AS BIGINT) AS g_a,
    CAST(count(*) FILTER (grade = 'F') AS BIGINT) AS g_f, max(bcmp) AS bcmp
    FROM v_course GROUP BY 1, 2, 3))""",
)
def agg_map(t: Tables) -> DataFrame:
    source = course.course_features(D.enrolments(t))
    return term.transform_terms(source, AGG_MAP, "emplid", "term_code", "cohort")


@check("distinct_values", "SELECT DISTINCT plan_cd FROM v_enrol")
def distinct_values(t: Tables) -> DataFrame:
    return stats.distinct_values(D.enrolments(t, science=False), "plan_cd")


@check(
    "base_rate",
    """SELECT e.term_code, count(p.g) AS n, sum(p.g) / CAST(count(p.g) AS DOUBLE) AS base_rate
FROM (SELECT DISTINCT emplid, term_code FROM v_enrol) e JOIN (SELECT emplid,
  CASE WHEN deg_term - cohort <= 40 THEN 1 ELSE 0 END AS g FROM v_population) p ON p.emplid = e.emplid
GROUP BY 1""",
)
def base_rate(t: Tables) -> DataFrame:
    present = D.enrolments(t, science=False).select("emplid", "term_code").distinct()
    flag = F.when(F.col("deg_term") - F.col("cohort") <= 40, 1).otherwise(0)
    graduates = D.population(t).select("emplid", flag.alias("graduated"))
    return stats.base_rate(present.join(graduates, "emplid"), "graduated", ["term_code"])


ADMISSION_COLUMNS = ["act_comp", "act_read", "sat_comp", "sat_math", "gpa_hs"]


@check(
    "column_stats",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std"
        " FROM v_adm"
        for c in ADMISSION_COLUMNS
    ),
)
def column_stats(t: Tables) -> DataFrame:
    return stats.column_stats(students.admissions(D.admissions_raw(t)), ADMISSION_COLUMNS)


@check(
    "describe",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count({c}) AS count, round(avg({c}), 6) AS mean,
  round(stddev_samp({c}), 6) AS std, CAST(min({c}) AS DOUBLE) AS min,
  round(quantile_cont({c}, 0.25), 6) + 0.0 AS p25, round(quantile_cont({c}, 0.5), 6) + 0.0 AS p50,
  round(quantile_cont({c}, 0.75), 6) + 0.0 AS p75, CAST(max({c}) AS DOUBLE) AS max FROM v_load"""
        for c in ("load_index", "cum_gpa", "units_taken")
    ),
)
def describe(t: Tables) -> DataFrame:
    source = term.load_indexes(term.grade_averages(cumulative(t)))
    return stats.describe(source, ["load_index", "cum_gpa", "units_taken"])


NULLABLE = ["dem_diff_indx", "pell_eligibility", "act_comp", "sat_comp", "gpa_hs", "ap"]


@check(
    "null_counts",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS null_count FROM v_master"
        for c in NULLABLE
    ),
)
def null_counts(t: Tables) -> DataFrame:
    return stats.null_counts(master(t), NULLABLE)


CORRELATED = ["units_taken", "units_for_credit", "cum_units_taken", "cum_units_for_credit", "bcmp"]


@check(
    "corr_pairs",
    " UNION ALL ".join(
        f"SELECT '{b}' AS column_a, '{a}' AS column_b, round(corr({a}, {b}), 6) AS corr FROM v_cum"
        for i, a in enumerate(CORRELATED)
        for b in CORRELATED[i + 1 :]
    ),
)
def corr_pairs(t: Tables) -> DataFrame:
    return stats.corr_pairs(cumulative(t), CORRELATED)


@check(
    "histogram",
    """SELECT CAST(floor((load_index - 0.0) / 0.125) AS BIGINT) AS bin,
  floor((load_index - 0.0) / 0.125) * CAST(0.125 AS DOUBLE) AS bin_start, count(*) AS n
FROM v_load GROUP BY 1, 2""",
)
def histogram(t: Tables) -> DataFrame:
    return stats.histogram(term.load_indexes(cumulative(t)), "load_index", 0.125)


_PROFILED = ["units_taken", "units_for_credit", "cum_units_taken", "cum_units_for_credit"]


@check(
    "profile_columns",
    "WITH c AS MATERIALIZED (SELECT * FROM v_cum), r AS ("
    + " UNION ALL ".join(
        f"SELECT '{a}' AS x, '{b}' AS y, corr({a}, {b}) AS v FROM c"
        for i, a in enumerate(_PROFILED)
        for b in _PROFILED[i + 1 :]
    )
    + ") "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count({c}) AS count, count(*) - count({c}) AS null_count,
  round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, CAST(min({c}) AS DOUBLE) AS min,
  CAST(max({c}) AS DOUBLE) AS max,
  (SELECT count(*) FROM r WHERE (x = '{c}' OR y = '{c}') AND abs(round(v, 6)) > 0.9) AS similar_columns
FROM c"""
        for c in _PROFILED
    ),
)
def profile_columns(t: Tables) -> DataFrame:
    return stats.profile_columns(cumulative(t), _PROFILED)


_FREQUENT = 0.005
_VALUED = [*_PROFILED, "term_code", "plan_cd"]


@check(
    "frequent_values",
    "WITH c AS MATERIALIZED (SELECT * FROM v_cum) "
    + " UNION ALL ".join(
        f"""SELECT column_name, CAST(row_number() OVER (ORDER BY n DESC, value_number, value_text) AS INT) AS rank,
  value_text, value_number, n, known FROM (
  SELECT '{c}' AS column_name, {"CAST(v AS VARCHAR), CAST(NULL AS DOUBLE)" if c == "plan_cd" else "CAST(NULL AS VARCHAR), CAST(v AS DOUBLE)"},
    count(*), CAST(sum(count(*)) OVER () AS BIGINT)
  FROM (SELECT {c} AS v FROM c WHERE {c} IS NOT NULL) GROUP BY v) t(column_name, value_text, value_number, n, known)
WHERE n >= known * {_FREQUENT}::DOUBLE"""
        for c in _VALUED
    ),
)
def frequent_values(t: Tables) -> DataFrame:
    """Values that at least one of 200 known values of a column equals."""
    return frequent.frequent_values(cumulative(t), _VALUED, _FREQUENT)


# ---- windows and term features


@check("term_cumulative", "SELECT * FROM v_cum")
def term_cumulative(t: Tables) -> DataFrame:
    return cumulative(t)


@check(
    "term_cumulative_rows",
    """SELECT cohort, emplid, term_code, plan_cd,
  CAST(sum(units_taken) OVER w AS BIGINT) AS cum_units_taken,
  CAST(sum(units_for_credit) OVER w AS BIGINT) AS cum_units_for_credit
FROM v_terms WINDOW w AS (PARTITION BY emplid ORDER BY term_code, cohort, plan_cd ROWS UNBOUNDED PRECEDING)""",
)
def term_cumulative_rows(t: Tables) -> DataFrame:
    summed = term.cumulate_rows(terms(t), ["units_taken", "units_for_credit"])
    return summed.select(*course.KEYS, "cum_units_taken", "cum_units_for_credit")


@check(
    "gpa_eligibility",
    """SELECT emplid, cohort, term_code, plan_cd, grade, units, grade_points, bcmp,
  gpa_ok * grade_points AS grade_points_in_gpa, gpa_ok * units AS units_in_gpa,
  credit_ok * units AS units_for_credit, bcmp * units AS bcmp_units_taken,
  gpa_ok * bcmp * grade_points AS bcmp_grade_points_in_gpa, gpa_ok * bcmp * units AS bcmp_units_in_gpa,
  credit_ok * bcmp * units AS bcmp_units_for_credit FROM v_course""",
)
def gpa_eligibility(t: Tables) -> DataFrame:
    return course.eligibility(D.enrolments(t))


GPA_COLUMNS = [*course.KEYS, "term_gpa", "cum_gpa", "bcmp_term_gpa", "bcmp_cum_gpa"]


@check("gpa", f"SELECT {', '.join(GPA_COLUMNS)} FROM v_gpa")
def gpa(t: Tables) -> DataFrame:
    return term.grade_averages(cumulative(t)).select(*GPA_COLUMNS)


@check(
    "semester_index",
    f"""SELECT term_code - cohort AS term_diff, {V.semester("term_code - cohort")} AS semester_index,
  count(*) AS n FROM v_enrol GROUP BY 1, 2""",
)
def semester_index(t: Tables) -> DataFrame:
    diff = F.col("term_code") - F.col("cohort")
    return (
        D.enrolments(t, science=False)
        .groupBy(diff.alias("term_diff"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("semester_index", X.semester_index("term_diff"))
    )


LOAD_COLUMNS = [
    *course.KEYS,
    "term_diff",
    "semester_index",
    "load_index",
    "load_index_exclude",
    "load_index_only",
]


@check("load_index", f"SELECT {', '.join(LOAD_COLUMNS)} FROM v_load")
def load_index(t: Tables) -> DataFrame:
    return term.load_indexes(cumulative(t)).select(*LOAD_COLUMNS)


@check(
    "completion_rate",
    "SELECT cohort, emplid, term_code, plan_cd, units_for_credit, units_taken, completion_rate FROM v_load",
)
def completion_rate(t: Tables) -> DataFrame:
    return term.completion(terms(t)).select(
        *course.KEYS, "units_for_credit", "units_taken", "completion_rate"
    )


@check(
    "dfw_rate", "SELECT cohort, emplid, term_code, plan_cd, units_taken, dfw, dfw_rate FROM v_load"
)
def dfw_rate(t: Tables) -> DataFrame:
    return term.dfw(terms(t)).select(*course.KEYS, "units_taken", "dfw", "dfw_rate")


@check(
    "term_season",
    """SELECT emplid, term_code, grade, units,
  CASE WHEN term_code % 10 = 3 THEN credit_ok * units ELSE 0 END AS summer,
  CASE WHEN term_code % 10 = 1 THEN credit_ok * units ELSE 0 END AS winter FROM v_course""",
)
def term_season(t: Tables) -> DataFrame:
    eligible = D.enrolments(t, science=False).withColumn(
        "units_for_credit", X.counts_for_credit("grade", "units")
    )
    return course.season_units(eligible).select(
        "emplid", "term_code", "grade", "units", "summer", "winter"
    )


@check(
    "bcmp_flags",
    """SELECT l_partkey, p_type, CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN 1 ELSE 0 END AS bcmp,
  CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN l_quantity ELSE 0 END AS bcmp_units_taken
FROM lineitem JOIN part ON p_partkey = l_partkey""",
)
def bcmp_flags(t: Tables) -> DataFrame:
    science = X.science_flag("p_type", D.SCIENCE_TYPES)
    joined = t.lineitem.select("l_partkey", "l_quantity").join(
        t.part.select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey"
    )
    return joined.select(
        "l_partkey",
        "p_type",
        science.alias("bcmp"),
        F.when(science == 1, F.col("l_quantity")).otherwise(0.0).alias("bcmp_units_taken"),
    )


@check(
    "time_to_grad",
    "SELECT emplid, cohort, dem_diff_indx, dem_n, CAST(dem_n * 0.5 AS DOUBLE) AS yrs_to_grad,"
    + ", ".join(
        f"CASE WHEN dem_n * 0.5 = {y} THEN 1 ELSE 0 END AS {n}" for n, y in zip(V.RESPONSES, V.YEARS)
    )
    + f" FROM (SELECT *, {V.DEGREE_INDEX} AS dem_n FROM"
    " (SELECT emplid, cohort, deg_term - cohort AS dem_diff_indx FROM v_population))",
)
def time_to_grad(t: Tables) -> DataFrame:
    timed = (
        D.population(t)
        .select("emplid", "cohort", (F.col("deg_term") - F.col("cohort")).alias("dem_diff_indx"))
        .withColumn("dem_n", X.time_to_degree("dem_diff_indx"))
    )
    return timed.select(
        "*", (F.col("dem_n") * F.lit(0.5)).alias("yrs_to_grad"), *students.response_columns()
    )


@check(
    "grad_within",
    "SELECT emplid, CASE WHEN r4 = 0 THEN 0 ELSE 1 END AS graduate_within_4yr,"
    " CASE WHEN r4 + r2 = 0 THEN 0 ELSE 1 END AS graduate_within_6yr FROM (SELECT emplid, "
    + " + ".join(f"CASE WHEN deg_term - cohort <= {10 * k} THEN 1 WHEN deg_term IS NULL THEN NULL"
                 " ELSE 0 END" for k in range(1, 5))
    + " AS r4, "
    + " + ".join(f"CASE WHEN deg_term - cohort <= {10 * k} THEN 1 WHEN deg_term IS NULL THEN NULL"
                 " ELSE 0 END" for k in range(5, 7))
    + " AS r2 FROM v_population)",
)
def grad_within(t: Tables) -> DataFrame:
    flags = [f"rate_{k}yr" for k in range(1, 7)]
    return D.graduation_flags(t).select(
        "emplid",
        X.graduated_within(flags[:4]).alias("graduate_within_4yr"),
        X.graduated_within(flags).alias("graduate_within_6yr"),
    )


@check(
    "major_change",
    """SELECT cohort, emplid, term_code, plan_cd, substr(plan_cd, 1, 4) AS subject,
  substr(plan_cd, 5, 2) AS plan_type, major_change_indicator, major_change_cnt FROM v_term_features""",
)
def major_change(t: Tables) -> DataFrame:
    keyed = D.enrolments(t, science=False).select(*course.KEYS).distinct()
    changed = term.major_changes(term.drop_before_cohort(keyed))
    return changed.select(
        *course.KEYS,
        X.plan_subject("plan_cd").alias("subject"),
        X.plan_type("plan_cd").alias("plan_type"),
        "major_change_indicator",
        "major_change_cnt",
    )


@check(
    "plan_split",
    """SELECT emplid, coalesce(plan_cd, 'nan') AS plan_cd, substr(coalesce(plan_cd, 'nan'), 1, 4) AS subject,
  substr(coalesce(plan_cd, 'nan'), 5, 2) AS plan_type FROM (SELECT emplid,
  CASE WHEN term_code % 10 = 2 THEN NULL ELSE plan_cd END AS plan_cd FROM v_enrol)""",
)
def plan_split(t: Tables) -> DataFrame:
    plan = F.when(F.col("term_code") % 10 != 2, F.col("plan_cd")).alias("plan_cd")
    return D.enrolments(t, science=False).select("emplid", plan).select(
        "emplid",
        X.plan_text("plan_cd").alias("plan_cd"),
        X.plan_subject("plan_cd").alias("subject"),
        X.plan_type("plan_cd").alias("plan_type"),
    )


@check(
    "plan_length",
    """SELECT 'plan_length' AS column_name, count(x) AS count, round(avg(x), 6) AS mean,
  round(stddev_samp(x), 6) AS std, CAST(min(x) AS DOUBLE) AS min, quantile_cont(x, 0.25) AS p25,
  quantile_cont(x, 0.5) AS p50, quantile_cont(x, 0.75) AS p75, CAST(max(x) AS DOUBLE) AS max
FROM (SELECT length(plan_cd) AS x FROM v_enrol)""",
)
def plan_length(t: Tables) -> DataFrame:
    lengths = D.enrolments(t, science=False).select(F.length("plan_cd").alias("plan_length"))
    return stats.describe(lengths, ["plan_length"])


# ---- encoding, split, scaling, feature table, chunks


@check(
    "one_hot",
    "SELECT emplid, "
    + ", ".join(f"CASE WHEN {e} THEN 1 ELSE 0 END AS {n}" for n, e in V.DUMMY_SQL)
    + " FROM v_master",
)
def one_hot(t: Tables) -> DataFrame:
    labelled = master(t).withColumns(
        {
            "first_generation": X.relabel("first_generation", "UNKNOWN", "First Generation Unknown"),
            "ethnicity": X.relabel("ethnicity", "UNKNOWN", "ETHNICITY UNKNOWN"),
        }
    )
    return encode.one_hot(labelled, V.ENCODING).select("emplid", *encode.encoded_names(V.ENCODING))


@check("split", f"SELECT emplid, {V.DEV} AS is_dev FROM (SELECT DISTINCT emplid FROM v_enrol)")
def split(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_custkey").cast("string").alias("emplid")).distinct().select(
        "emplid", X.is_dev("emplid").alias("is_dev")
    )


@check(
    "split_rows",
    """SELECT emplid, label, score, substr(md5(concat(emplid, '|42')), 1, 4) < '4000' AS is_test
FROM v_scored""",
)
def split_rows(t: Tables) -> DataFrame:
    return D.scored(t).withColumn("is_test", X.is_test(["emplid"]))


def _joined(t: Tables) -> DataFrame:
    students_table = students.encode_students(master(t), V.ENCODING)
    return students_table.join(term.term_features(D.enrolments(t)), ["emplid", "cohort"], "left")


@check(
    "test_scores",
    """SELECT emplid, term_code, plan_cd, gendr_m, round(t_comp0, 6) + 0.0 AS t_comp,
  round(t_read0, 6) + 0.0 AS t_read, round(t_math0, 6) + 0.0 AS t_math FROM v_fused""",
)
def test_scores(t: Tables) -> DataFrame:
    fused = students.fuse_scores(_joined(t))
    return fused.select(
        "emplid",
        "term_code",
        X.plan_text("plan_cd").alias("plan_cd"),
        "gendr_m",
        *[X.rounded(c).alias(c) for c in ("t_comp", "t_read", "t_math")],
    )


@check(
    "mean_impute",
    f"SELECT emplid, term_code, plan_cd, gendr_m, {V.shown(V.FLOATING)} FROM v_filled",
)
def mean_impute(t: Tables) -> DataFrame:
    filled = students.impute_means(students.fuse_scores(_joined(t)), V.FLOATING)
    return filled.select(
        "emplid",
        "term_code",
        X.plan_text("plan_cd").alias("plan_cd"),
        "gendr_m",
        *[X.rounded(c).alias(c) for c in V.FLOATING],
    )


@check(
    "standardise",
    "SELECT emplid, term_code, plan_cd, "
    + ", ".join(f"round({V.zscore(c)}, 6) + 0.0 AS {c}" for c in students.SCALED_PERFORMANCE)
    + f" FROM (SELECT *, {V.DEV} AS is_dev FROM v_term_features)",
)
def standardise(t: Tables) -> DataFrame:
    marked = term.term_features(D.enrolments(t)).withColumn("is_dev", X.is_dev("emplid"))
    scaled = students.scale_columns(marked, students.SCALED_PERFORMANCE)
    return scaled.select(
        "emplid",
        "term_code",
        "plan_cd",
        *[X.rounded(c).alias(c) for c in students.SCALED_PERFORMANCE],
    )


ALL_COLUMNS = [*V.PERFORMANCE, *V.STATIC]


@check("student_features", f"SELECT cohort, emplid, {V.shown(ALL_COLUMNS)} FROM v_features")
def student_features(t: Tables) -> DataFrame:
    return shown(features(t))


@check(
    "chunk_t0", f"SELECT DISTINCT cohort, emplid, {V.shown(V.STATIC)} FROM v_features"
)
def chunk_t0(t: Tables) -> DataFrame:
    return students.chunk(shown(features(t)), 0, V.ENCODING)


@check(
    "chunk_t",
    f"SELECT cohort, emplid, {V.shown(ALL_COLUMNS)} FROM v_features WHERE semester_index <= 3",
)
def chunk_t(t: Tables) -> DataFrame:
    return shown(students.chunk(features(t), 3, V.ENCODING))


@check(
    "chunk_sizes",
    """SELECT s.t, f.is_dev, count(*) AS n_rows
FROM (SELECT DISTINCT semester_index AS t FROM v_features WHERE semester_index >= 1) s
JOIN v_features f ON f.semester_index <= s.t GROUP BY 1, 2""",
)
def chunk_sizes(t: Tables) -> DataFrame:
    return students.chunk_sizes(features(t))
