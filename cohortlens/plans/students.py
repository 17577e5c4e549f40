"""Student rows: demographic master, encoded responses, scores, feature table, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.expressions import (
    income_label,
    is_dev,
    plan_text,
    relabel,
    time_to_degree,
)
from cohortlens.functions.labels import DEMOGRAPHIC_ENCODING, GRADUATION_YEARS
from cohortlens.operators.encode import encoded_names, one_hot
from cohortlens.plans.course import GRADE_FLAGS
from cohortlens.session import cut_lineage

TEST_COLUMNS = [
    "act_comp",
    "act_read",
    "act_math",
    "act_eng",
    "act_sci",
    "sat_read",
    "sat_math",
    "sat_comp",
]
SCALED_PERFORMANCE = [
    "cum_bcmp",
    "cum_summer",
    "cum_winter",
    "term_gpa",
    "cum_gpa",
    "bcmp_term_gpa",
    "bcmp_cum_gpa",
]
ID_COLUMNS = ["cohort", "emplid"]
PERFORMANCE_COLUMNS = [
    "term_code",
    "semester_index",
    "plan_cd",
    "major_change_indicator",
    "major_change_cnt",
    "units_taken",
    "bcmp",
    *GRADE_FLAGS,
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
RESPONSE_COLUMNS = [f"grad_in_{str(y).replace('.', '_')}" for y in GRADUATION_YEARS]


def demographics(raw: DataFrame) -> DataFrame:
    """Collapse repeated demographic rows to one per (student, gender).

    Gender-level and student-level extremes come from one aggregate; the student level is finished by
    a window over the few gender rows a student has.
    """

    def family(c: str) -> Column:
        return F.max(F.when(F.col(c).cast("string").contains("99"), -1).otherwise(F.col(c)))

    grouped = (
        raw.filter(F.col("emplid").isNotNull())
        .groupBy("emplid", F.col("sex").alias("gender"))
        .agg(
            F.min("race_eth").alias("ethnicity"),
            F.min("min_status").alias("minority"),
            F.min("first_gen").alias("first_generation"),
            family("dep_family").alias("dep"),
            family("indep_family").alias("indep"),
            F.max("indep_income").alias("income"),
        )
    )
    student = Window.partitionBy("emplid")

    def size(c: str) -> Column:
        text = F.max(c).over(student).cast("string")
        return F.when(text.contains("-1"), "NA").otherwise(text)

    return grouped.select(
        "emplid",
        "gender",
        "ethnicity",
        F.min("first_generation").over(student).alias("first_generation"),
        size("dep").alias("dep_family_size"),
        "minority",
        size("indep").alias("applicant_family_size"),
        income_label(F.max("income").over(student)).alias("applicant_income"),
    )


def admissions(raw: DataFrame) -> DataFrame:
    """Test scores with 0 as missing, and the always-missing AP column."""
    scores = [F.nullif(F.col(c), F.lit(0)).alias(c) for c in TEST_COLUMNS]
    return raw.select(
        "emplid",
        *scores,
        F.nullif(F.col("hs_gpa"), F.lit(0)).alias("gpa_hs"),
        F.lit(None).cast("int").alias("ap"),
    )


def student_master(
    population: DataFrame, demographic: DataFrame, pell: DataFrame, admission: DataFrame
) -> DataFrame:
    """Population with every known attribute.

    Pell status and test scores hang on the demographics key: a student without demographics has neither.
    """
    known = demographic.withColumn("dae_emplid", F.col("emplid"))
    awards = pell.filter(F.col("emplid").isNotNull()).select(
        F.col("emplid").alias("dae_emplid"), F.col("elig").alias("pell_eligibility")
    )
    scores = admission.withColumnRenamed("emplid", "dae_emplid")
    return (
        population.select(
            "emplid", "cohort", (F.col("deg_term") - F.col("cohort")).alias("dem_diff_indx")
        )
        .join(known, "emplid", "left")
        .join(awards, "dae_emplid", "left")
        .join(scores, "dae_emplid", "left")
        .drop("dae_emplid")
        .distinct()
    )


def response_columns(index: str = "dem_n") -> list[Column]:
    """Exact-time responses: 1 when the degree came after exactly that many years."""
    return [
        F.expr(f"CASE WHEN {index} * 0.5D = {y}D THEN 1 ELSE 0 END AS {name}")
        for y, name in zip(GRADUATION_YEARS, RESPONSE_COLUMNS)
    ]


def encode_students(master: DataFrame, encoding=DEMOGRAPHIC_ENCODING) -> DataFrame:
    """One-hot demographics and responses, and the dev flag of each student."""
    labelled = master.withColumns(
        {
            "first_generation": relabel("first_generation", "UNKNOWN", "First Generation Unknown"),
            "ethnicity": relabel("ethnicity", "UNKNOWN", "ETHNICITY UNKNOWN"),
            "dem_n": time_to_degree("dem_diff_indx"),
        }
    )
    coded = one_hot(labelled, encoding)
    return coded.select(
        "*", *response_columns(), is_dev("emplid").alias("is_dev")
    ).drop("dem_n", "dem_diff_indx", "ap")


def scale_columns(
    df: DataFrame, columns: list[str], split: str = "is_dev", fit_on: str | None = None
) -> DataFrame:
    """Z-scores with population deviation, nulls skipped, constant columns 0.

    By default each split is scaled by itself; ``fit_on="train"`` applies the training rows' figures
    to both. The figures are one row per split, at most two, so that join is broadcast.
    """
    measured = df.filter(~F.col(split)) if fit_on == "train" else df
    figures = [F.expr(f"avg({c}) AS _m_{c}") for c in columns] + [
        F.expr(f"CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS _s_{c}")
        for c in columns
    ]
    if fit_on == "train":
        row = measured.agg(F.struct(*figures).alias("f")).scalar()
        joined = df.withColumn("_f", row).select("*", "_f.*").drop("_f")
    else:
        joined = df.join(F.broadcast(measured.groupBy(split).agg(*figures)), split)
    scaled = {c: f"({c} - _m_{c}) / _s_{c} AS {c}" for c in columns}
    return joined.selectExpr(*[scaled.get(c, f"`{c}`") for c in df.columns])


def impute_means(
    df: DataFrame, columns: list[str], split: str = "is_dev", fit_on: str | None = None
) -> DataFrame:
    """Fill nulls with the column mean of the same split, or of the training rows."""
    measured = df.filter(~F.col(split)) if fit_on == "train" else df
    means = [F.avg(c).alias(f"_m_{c}") for c in columns]
    if fit_on == "train":
        row = measured.agg(F.struct(*means).alias("f")).scalar()
        joined = df.withColumn("_f", row).select("*", "_f.*").drop("_f")
    else:
        joined = df.join(F.broadcast(measured.groupBy(split).agg(*means)), split)
    filled = {c: f"coalesce({c}, _m_{c}) AS {c}" for c in columns}
    return joined.selectExpr(*[filled.get(c, f"`{c}`") for c in df.columns])


def fuse_scores(df: DataFrame, fit_on: str | None = None) -> DataFrame:
    """Standardise the test columns, then keep the better of both tests per subject."""
    fused = scale_columns(df, TEST_COLUMNS, fit_on=fit_on)
    return fused.withColumns(
        {
            "t_comp": F.greatest("act_comp", "sat_comp"),
            "t_read": F.greatest("act_read", "sat_read"),
            "t_math": F.greatest("act_math", "sat_math"),
        }
    ).drop(*TEST_COLUMNS)


def student_features(
    terms: DataFrame, students: DataFrame, encoding=DEMOGRAPHIC_ENCODING, fit_on: str | None = None
) -> DataFrame:
    """The final feature table: one row per student attribute row and term row.

    ``students`` comes from ``encode_students``. Incomplete rows leave the training part only. The
    joined rows are written once: scaling and imputing then scan only the score columns, instead of
    running the term pipeline again for each set of figures.
    """
    measured = [c for c in PERFORMANCE_COLUMNS if c in terms.columns]
    known = terms.select(*ID_COLUMNS, *measured)
    joined = cut_lineage(
        students.join(known, ["emplid", "cohort"], "left").withColumn("plan_cd", plan_text("plan_cd"))
    )
    filled = impute_means(
        fuse_scores(joined, fit_on), ["t_comp", "t_read", "t_math", "gpa_hs"], fit_on=fit_on
    )
    columns = [
        *ID_COLUMNS,
        *PERFORMANCE_COLUMNS,
        "gpa_hs",
        *encoded_names(encoding),
        *RESPONSE_COLUMNS,
        "is_dev",
    ]
    chosen = filled.select(*columns)
    incomplete = " OR ".join(f"{c} IS NULL" for c in columns)
    return chosen.filter(f"is_dev OR NOT ({incomplete})")


def static_columns(encoding=DEMOGRAPHIC_ENCODING) -> list[str]:
    return [*ID_COLUMNS, "gpa_hs", *encoded_names(encoding), *RESPONSE_COLUMNS, "is_dev"]


def chunk(features: DataFrame, t: int, encoding=DEMOGRAPHIC_ENCODING) -> DataFrame:
    """Everything known by semester ``t``; chunk 0 is what is known before the first term."""
    if t == 0:
        return features.select(*static_columns(encoding)).dropDuplicates()
    return features.filter(F.col("semester_index") <= t)


def chunk_sizes(features: DataFrame) -> DataFrame:
    """Rows per split in every chunk t >= 1, from one count per semester index."""
    counted = (
        features.filter(F.col("semester_index") >= 1)
        .groupBy("is_dev", F.col("semester_index").alias("t"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    so_far = (
        Window.partitionBy("is_dev")
        .orderBy("t")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return counted.select("t", "is_dev", F.sum("n").over(so_far).alias("n_rows"))
