"""SQL of the domain views, written apart from the DataFrame code they are compared with."""

from __future__ import annotations

from cohortlens.checks.registry import part
from cohortlens.functions.labels import INCOME_BANDS

part(
    "v_cohort",
    """SELECT o_custkey, CAST((year(min(o_orderdate)) - 1900) * 10 + 4 AS INT) AS cohort
FROM orders GROUP BY o_custkey""",
)
part(
    "v_enrol_raw",
    """SELECT CAST(o.o_custkey AS VARCHAR) AS emplid, c.cohort,
  CAST((year(o_orderdate) - 1900) * 10 + quarter(o_orderdate) AS INT) AS term_code,
  upper(substr(o_orderpriority, 3, 4)) || CASE WHEN o_orderkey % 2 = 0 THEN 'BA' ELSE 'PR' END
    || '0000' AS plan_cd,
  ['A','AU','B','C','CR','D','F','I','NC','RD','RP','W','WE','WU'][
    CAST((l_partkey * 7 + l_suppkey * 3 + l_linenumber) % 14 AS INT) + 1] AS grade,
  CAST(1 + l_linenumber % 4 AS INT) AS units,
  CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN 1 ELSE 0 END AS bcmp
FROM lineitem JOIN orders o ON l_orderkey = o_orderkey JOIN v_cohort c ON c.o_custkey = o.o_custkey
JOIN part ON p_partkey = l_partkey""",
)
part(
    "v_enrol",
    """SELECT emplid, cohort, term_code, plan_cd, grade, units,
  units * CASE grade WHEN 'A' THEN 4 WHEN 'B' THEN 3 WHEN 'C' THEN 2 WHEN 'D' THEN 1 ELSE 0 END
    AS grade_points, bcmp
FROM v_enrol_raw""",
)
part(
    "v_population",
    """SELECT CAST(c_custkey AS VARCHAR) AS emplid, cohort,
  CASE WHEN c_custkey % 5 = 0 THEN NULL
    ELSE cohort + [28, 30, 37, 38, 40, 47, 50, -10][CAST(c_custkey % 8 AS INT) + 1] END AS deg_term
FROM customer JOIN v_cohort ON o_custkey = c_custkey""",
)
part(
    "v_dae",
    """SELECT CAST(c_custkey AS VARCHAR) AS emplid,
  CASE WHEN (c_custkey + CASE WHEN c_custkey % 97 = 0 THEN n ELSE 0 END) % 2 = 0 THEN 'M' ELSE 'F' END
    AS sex,
  CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'UNKNOWN' ELSE c_mktsegment END AS race_eth,
  CASE WHEN c_nationkey % 3 = 0 THEN 'MINORITY' ELSE 'NON-MINORITY' END AS min_status,
  CASE c_nationkey % 3 WHEN 0 THEN 'FIRST GENERATION' WHEN 1 THEN 'CONTINUING GENERATION'
    ELSE 'UNKNOWN' END AS first_gen,
  CASE WHEN c_nationkey = 24 THEN 99 ELSE 1 + c_nationkey % 9 END AS dep_family,
  CASE WHEN (c_custkey + n) % 7 = 0 THEN 99 ELSE 1 + c_custkey % 6 END AS indep_family,
  (c_custkey + n) % 10 AS indep_income
FROM customer, (VALUES (0), (1)) AS r(n)""",
)
part(
    "v_adm",
    """SELECT CAST(c_custkey AS VARCHAR) AS emplid,
  CAST(nullif(c_custkey * 5 % 37, 0) AS INT) AS act_comp,
  CAST(nullif(c_custkey * 7 % 37, 0) AS INT) AS act_read,
  CAST(nullif(c_custkey * 11 % 37, 0) AS INT) AS act_math,
  CAST(nullif(c_custkey * 13 % 37, 0) AS INT) AS act_eng,
  CAST(nullif(c_custkey * 17 % 37, 0) AS INT) AS act_sci,
  CAST(CASE WHEN c_custkey % 4 <> 0 THEN 200 + 10 * (c_custkey * 7 % 61) END AS INT) AS sat_read,
  CAST(CASE WHEN c_custkey % 4 <> 0 THEN 200 + 10 * (c_custkey * 9 % 61) END AS INT) AS sat_math,
  CAST(CASE WHEN c_custkey % 4 <> 0 THEN 400 + 10 * (c_custkey * 3 % 121) END AS INT) AS sat_comp,
  CAST(nullif(c_custkey * 13 % 401, 0) AS INT) AS gpa_hs,
  CAST(NULL AS INT) AS ap
FROM customer""",
)
part(
    "v_pell",
    """SELECT CAST(c_custkey AS VARCHAR) AS emplid,
  CASE WHEN c_custkey % 3 = 0 THEN 'TRADITIONAL' ELSE 'NON TRADITIONAL' END AS pell_eligibility
FROM customer WHERE c_custkey % 3 < 2""",
)
part(
    "v_scored",
    """SELECT CAST(c_custkey AS VARCHAR) AS emplid,
  CASE WHEN c_custkey % 8 IN (2, 3) AND c_custkey % 5 <> 0 THEN 1 ELSE 0 END AS label,
  ((c_custkey * 37 + 11) % 1000) / 1000.0::DOUBLE AS score
FROM customer""",
)
part("v_pred", "SELECT *, CASE WHEN score > 0.5 THEN 1 ELSE 0 END AS prediction FROM v_scored")
part(
    "v_cells",
    """SELECT count(*) FILTER (label = 1 AND prediction = 1) AS tp,
  count(*) FILTER (label = 0 AND prediction = 1) AS fp,
  count(*) FILTER (label = 1 AND prediction = 0) AS fn,
  count(*) FILTER (label = 0 AND prediction = 0) AS tn
FROM v_pred""",
)
part(
    "v_ratings",
    """SELECT o_custkey AS user, l_partkey AS item,
  CAST(max((l_orderkey + l_partkey) % 11) AS INT) AS rating
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""",
)
part(
    "v_clean",
    """SELECT r.* FROM v_ratings r
WHERE rating > 0 AND item IN (SELECT p_partkey FROM part WHERE p_size <= 45)""",
)
part(
    "v_thin_items",
    "SELECT * FROM v_clean WHERE item IN (SELECT item FROM v_clean GROUP BY item HAVING count(*) >= 10)",
)
part(
    "v_thin",
    """SELECT * FROM v_thin_items
WHERE user IN (SELECT user FROM v_thin_items GROUP BY user HAVING count(*) >= 20)""",
)

SUMS = [
    ("grade_points_in_gpa", "gpa_ok * grade_points"),
    ("units_taken", "units"),
    ("units_in_gpa", "gpa_ok * units"),
    ("units_for_credit", "credit_ok * units"),
    ("bcmp", "bcmp"),
    ("bcmp_grade_points_in_gpa", "gpa_ok * bcmp * grade_points"),
    ("bcmp_units_taken", "bcmp * units"),
    ("bcmp_units_in_gpa", "gpa_ok * bcmp * units"),
    ("bcmp_units_for_credit", "credit_ok * bcmp * units"),
]
FLAGS = ["A", "AU", "B", "C", "CR", "D", "F", "I", "NC", "RP", "W", "WE", "WU"]
SEASONS = [("summer", 3), ("winter", 1)]
CUM = [n for n, _ in SUMS] + ["summer", "winter"]
MEASURES = [n for n, _ in SUMS] + [f"g_{f.lower()}" for f in FLAGS] + ["summer", "winter"]

part(
    "v_course",
    """SELECT *,
  CASE WHEN grade IN ('AU','CR','NC','RD','RP','W','WE') THEN NULL ELSE 1 END AS gpa_ok,
  CASE WHEN grade IN ('AU','NC','RD','RP','W','WE') THEN NULL ELSE 1 END AS credit_ok
FROM v_enrol""",
)
part(
    "v_terms",
    "SELECT cohort, emplid, term_code, plan_cd,\n  "
    + ",\n  ".join(
        [f"CAST(coalesce(sum({e}), 0) AS BIGINT) AS {n}" for n, e in SUMS]
        + [
            f"CAST(sum(CASE WHEN grade = '{f}' THEN 1 ELSE 0 END) AS BIGINT) AS g_{f.lower()}"
            for f in FLAGS
        ]
        + [
            f"CAST(coalesce(sum(CASE WHEN term_code % 10 = {d} THEN credit_ok * units ELSE 0 END), 0)"
            f" AS BIGINT) AS {n}"
            for n, d in SEASONS
        ]
    )
    + "\nFROM v_course GROUP BY 1, 2, 3, 4",
)
part(
    "v_cum",
    "SELECT v_terms.*,\n  "
    + ",\n  ".join(
        f"CAST(sum({n}) OVER (PARTITION BY emplid ORDER BY term_code"
        f" RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum_{n}"
        for n in CUM
    )
    + "\nFROM v_terms",
)


def quotient(num: str, den: str) -> str:
    return f"coalesce(({num}) / CAST(nullif({den}, 0) AS DOUBLE), 0.0)"


GPAS = ",\n  ".join(
    f"{quotient(a, b)} AS {n}"
    for n, a, b in [
        ("term_gpa", "grade_points_in_gpa", "units_in_gpa"),
        ("cum_gpa", "cum_grade_points_in_gpa", "cum_units_in_gpa"),
        ("bcmp_term_gpa", "bcmp_grade_points_in_gpa", "bcmp_units_in_gpa"),
        ("bcmp_cum_gpa", "cum_bcmp_grade_points_in_gpa", "cum_bcmp_units_in_gpa"),
    ]
)


def semester(d: str) -> str:
    return (
        f"CAST(trunc(CASE WHEN ({d}) % 10 = 0 THEN ({d}) / 5.0::DOUBLE + 1"
        f" ELSE (({d}) + 2) / 5.0::DOUBLE END) AS INT)"
    )


DFW = "(g_d + g_f + g_i + g_nc + g_w + g_we + g_wu)"
part(
    "v_gpa",
    f"""SELECT *, {GPAS}, term_code - cohort AS term_diff,
  {semester("term_code - cohort")} AS semester_index,
  CASE WHEN term_code >= cohort THEN units_for_credit ELSE 0 END AS units_for_credit_exclude
FROM v_cum""",
)
part(
    "v_load1",
    """SELECT *,
  CAST(sum(units_for_credit_exclude) OVER (PARTITION BY emplid ORDER BY term_code
    RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum_units_for_credit_exclude,
  cum_units_for_credit / CAST(nullif(15 * semester_index, 0) AS DOUBLE) AS li
FROM v_gpa""",
)
part(
    "v_load2",
    """SELECT *, cum_units_for_credit_exclude / CAST(nullif(15 *
    CASE WHEN term_diff < 0 THEN 0 ELSE semester_index END, 0) AS DOUBLE) AS lx
FROM v_load1""",
)
part(
    "v_load",
    f"""SELECT * EXCLUDE (li, lx), coalesce(li, 0.0) AS load_index, coalesce(lx, 0.0) AS load_index_exclude,
  coalesce(max(li - lx) OVER (PARTITION BY emplid), 0.0) AS load_index_only,
  {quotient("units_for_credit", "units_taken")} AS completion_rate,
  {DFW} AS dfw, {quotient(DFW, "units_taken")} AS dfw_rate
FROM v_load2""",
)
part(
    "v_change",
    """SELECT *, CASE WHEN lag(substr(plan_cd, 1, 4)) OVER
    (PARTITION BY emplid ORDER BY term_code, plan_cd, cohort) <> substr(plan_cd, 1, 4)
    THEN 1 ELSE 0 END AS major_change_indicator
FROM v_load WHERE cohort <= term_code""",
)
part(
    "v_term_features",
    """SELECT *, CAST(sum(major_change_indicator) OVER (PARTITION BY emplid
    ORDER BY term_code, plan_cd, cohort ROWS UNBOUNDED PRECEDING) AS BIGINT) AS major_change_cnt
FROM v_change""",
)

BANDS = "CASE {0} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in INCOME_BANDS.items()) + " END"
part(
    "v_dae_student",
    """SELECT emplid, min(first_gen) AS first_generation,
  max(CASE WHEN CAST(dep_family AS VARCHAR) LIKE '%99%' THEN -1 ELSE dep_family END) AS dep,
  max(CASE WHEN CAST(indep_family AS VARCHAR) LIKE '%99%' THEN -1 ELSE indep_family END) AS indep,
  max(indep_income) AS income
FROM v_dae GROUP BY emplid""",
)
part(
    "v_dem",
    f"""SELECT g.emplid, g.gender, g.ethnicity, s.first_generation,
  CASE WHEN CAST(dep AS VARCHAR) LIKE '%-1%' THEN 'NA' ELSE CAST(dep AS VARCHAR) END AS dep_family_size,
  g.minority,
  CASE WHEN CAST(indep AS VARCHAR) LIKE '%-1%' THEN 'NA' ELSE CAST(indep AS VARCHAR) END
    AS applicant_family_size,
  {BANDS.format("income")} AS applicant_income
FROM (SELECT emplid, sex AS gender, min(race_eth) AS ethnicity, min(min_status) AS minority
      FROM v_dae GROUP BY 1, 2) g
LEFT JOIN v_dae_student s ON s.emplid = g.emplid""",
)
part(
    "v_master",
    """SELECT DISTINCT p.emplid, p.cohort, p.deg_term - p.cohort AS dem_diff_indx, d.* EXCLUDE (emplid),
  e.pell_eligibility, a.* EXCLUDE (emplid)
FROM v_population p LEFT JOIN v_dem d ON d.emplid = p.emplid
LEFT JOIN v_pell e ON e.emplid = d.emplid LEFT JOIN v_adm a ON a.emplid = d.emplid""",
)

# The labels that occur in the domain views, per encoded column.
ENCODING = [
    ("gender", "GENDR", ["M"]),
    ("ethnicity", "", ["AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY", "ETHNICITY UNKNOWN"]),
    (
        "first_generation",
        "",
        ["CONTINUING GENERATION", "FIRST GENERATION", "First Generation Unknown"],
    ),
    ("dep_family_size", "DEP_FAM", [*map(str, range(1, 10)), "NA"]),
    ("minority", "URM", ["MINORITY", "NON-MINORITY"]),
    ("applicant_family_size", "APP_FAM", [*map(str, range(1, 7)), "NA"]),
    (
        "applicant_income",
        "INCM",
        ["LESS THEN $6000", "$6,000 TO $11,999", "$12,000 TO $23,999", "$60,000 OR MORE"],
    ),
    ("pell_eligibility", "PELL", ["NON TRADITIONAL", "TRADITIONAL"]),
]
DUMMY_SQL = [
    ("gendr_m", "gender = 'M'"),
    ("automobile", "ethnicity = 'AUTOMOBILE'"),
    ("building", "ethnicity = 'BUILDING'"),
    ("furniture", "ethnicity = 'FURNITURE'"),
    ("machinery", "ethnicity = 'MACHINERY'"),
    ("ethnicity_unknown", "ethnicity = 'UNKNOWN'"),
    ("continuing_generation", "first_generation = 'CONTINUING GENERATION'"),
    ("first_generation", "first_generation = 'FIRST GENERATION'"),
    ("first_generation_unknown", "first_generation = 'UNKNOWN'"),
    *[(f"dep_fam_{i}", f"dep_family_size = '{i}'") for i in range(1, 10)],
    ("dep_fam_na", "dep_family_size = 'NA'"),
    ("urm_minority", "minority = 'MINORITY'"),
    ("urm_non_minority", "minority = 'NON-MINORITY'"),
    *[(f"app_fam_{i}", f"applicant_family_size = '{i}'") for i in range(1, 7)],
    ("app_fam_na", "applicant_family_size = 'NA'"),
    ("incm_less_then_6000", "applicant_income = 'LESS THEN $6000'"),
    ("incm_6_000_to_11_999", "applicant_income = '$6,000 TO $11,999'"),
    ("incm_12_000_to_23_999", "applicant_income = '$12,000 TO $23,999'"),
    ("incm_60_000_or_more", "applicant_income = '$60,000 OR MORE'"),
    ("pell_non_traditional", "pell_eligibility = 'NON TRADITIONAL'"),
    ("pell_traditional", "pell_eligibility = 'TRADITIONAL'"),
]
YEARS = [2.5, 3.0, 3.5, 4.0, 4.5, 5.0, 5.5, 6.0]
RESPONSES = [f"grad_in_{str(y).replace('.', '_')}" for y in YEARS]
DEGREE_INDEX = (
    "CASE WHEN dem_diff_indx >= 0 THEN CAST(trunc(CASE WHEN dem_diff_indx % 10 IN (0, 7)"
    " THEN dem_diff_indx / 5.0::DOUBLE + 1 ELSE (dem_diff_indx + 2) / 5.0::DOUBLE END) AS INT)"
    " ELSE dem_diff_indx END"
)
DEV = "substr(md5(concat(emplid, '|42')), 1, 4) < '199a'"
SCORES = ["act_comp", "act_read", "act_math", "act_eng", "act_sci", "sat_read", "sat_math", "sat_comp"]
part("v_indexed", f"SELECT *, {DEGREE_INDEX} AS dem_n, {DEV} AS is_dev FROM v_master")
part(
    "v_students",
    "SELECT emplid, cohort, "
    + ", ".join(SCORES)
    + ", gpa_hs,\n  "
    + ",\n  ".join(
        [f"CASE WHEN {e} THEN 1 ELSE 0 END AS {n}" for n, e in DUMMY_SQL]
        + [f"CASE WHEN dem_n * 0.5 = {y} THEN 1 ELSE 0 END AS {n}" for n, y in zip(RESPONSES, YEARS)]
    )
    + ",\n  is_dev\nFROM v_indexed",
)
part(
    "v_joined",
    """SELECT s.*, t.* EXCLUDE (emplid, cohort, plan_cd), coalesce(t.plan_cd, 'nan') AS plan_cd
FROM v_students s LEFT JOIN v_term_features t ON t.emplid = s.emplid AND t.cohort = s.cohort""",
)


def zscore(c: str) -> str:
    sd = f"stddev_pop({c}) OVER (PARTITION BY is_dev)"
    return (
        f"({c} - avg({c}) OVER (PARTITION BY is_dev)) / CASE WHEN {sd} = 0 THEN 1.0 ELSE {sd} END"
    )


part(
    "v_z",
    "SELECT * EXCLUDE ("
    + ", ".join(SCORES)
    + "),\n  "
    + ",\n  ".join(f"{zscore(c)} AS {c}" for c in SCORES)
    + "\nFROM v_joined",
)
part(
    "v_fused",
    """SELECT *, greatest(act_comp, sat_comp) AS t_comp0, greatest(act_read, sat_read) AS t_read0,
  greatest(act_math, sat_math) AS t_math0 FROM v_z""",
)


def filled(c: str) -> str:
    return f"coalesce({c}, avg({c}) OVER (PARTITION BY is_dev))"


part(
    "v_filled",
    f"""SELECT * EXCLUDE (gpa_hs, t_comp0, t_read0, t_math0), {filled("t_comp0")} AS t_comp,
  {filled("t_read0")} AS t_read, {filled("t_math0")} AS t_math,
  {filled("CAST(gpa_hs AS DOUBLE)")} AS gpa_hs
FROM v_fused""",
)
PERFORMANCE = [
    "term_code",
    "semester_index",
    "plan_cd",
    "major_change_indicator",
    "major_change_cnt",
    "units_taken",
    "bcmp",
    *[f"g_{f.lower()}" for f in FLAGS],
    "winter",
    "summer",
    "cum_bcmp",
    "cum_summer",
    "cum_winter",
    "term_gpa",
    "cum_gpa",
    "bcmp_term_gpa",
    "bcmp_cum_gpa",
    "completion_rate",
    "load_index_exclude",
    "load_index_only",
    "dfw_rate",
    "t_comp",
    "t_read",
    "t_math",
]
STATIC = ["gpa_hs", *[n for n, _ in DUMMY_SQL], *RESPONSES, "is_dev"]
FLOATING = ["t_comp", "t_read", "t_math", "gpa_hs"]


def shown(columns: list[str]) -> str:
    return ", ".join(f"round({c}, 6) + 0.0 AS {c}" if c in FLOATING else c for c in columns)


part(
    "v_features",
    "SELECT cohort, emplid, "
    + ", ".join(PERFORMANCE + STATIC)
    + " FROM v_filled WHERE is_dev OR semester_index IS NOT NULL",
)
