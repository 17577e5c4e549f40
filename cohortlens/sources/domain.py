"""Domain views: the two workloads' inputs derived from the star-schema tables.

Every view is a plain projection, aggregate or join of the given tables, so its size follows theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.labels import GRADES
from cohortlens.sources.readers import Tables

# The departments' stand-in (part types counted as science).
SCIENCE_TYPES = ["ECONOMY", "PROMO"]
# Degree term minus cohort, by customer key modulo 8.
DEGREE_OFFSETS = [28, 30, 37, 38, 40, 47, 50, -10]


def _pick(items: list, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in items]), (index + 1).cast("int"))


def _text(column: str) -> Column:
    return F.col(column).cast("string")


def _year_code(date: Column) -> Column:
    return (F.year(date) - 1900) * 10


def cohorts(t: Tables) -> DataFrame:
    """First-order cohort per customer; partial aggregation keeps a busy customer cheap."""
    return t.orders.groupBy("o_custkey").agg(
        (_year_code(F.min("o_orderdate")) + 4).cast("int").alias("cohort")
    )


def enrolments(t: Tables, science: bool = True) -> DataFrame:
    """One row per student x course. ``science=False`` skips the part join when BCMP is unused."""
    orders = t.orders.join(cohorts(t), "o_custkey").select(
        "o_orderkey",
        _text("o_custkey").alias("emplid"),
        "cohort",
        (_year_code(F.col("o_orderdate")) + F.quarter("o_orderdate")).cast("int").alias("term_code"),
        F.concat(
            F.upper(F.substring("o_orderpriority", 3, 4)),
            F.when(F.col("o_orderkey") % 2 == 0, "BA").otherwise("PR"),
            F.lit("0000"),
        ).alias("plan_cd"),
    )
    units = (1 + F.col("l_linenumber") % 4).cast("int")
    grade = _pick(
        GRADES, (F.col("l_partkey") * 7 + F.col("l_suppkey") * 3 + F.col("l_linenumber")) % 14
    )
    lines = t.lineitem.select(
        F.col("l_orderkey").alias("o_orderkey"),
        F.col("l_partkey").alias("p_partkey"),
        grade.alias("grade"),
        units.alias("units"),
    )
    points = (
        F.when(F.col("grade") == "A", 4)
        .when(F.col("grade") == "B", 3)
        .when(F.col("grade") == "C", 2)
        .when(F.col("grade") == "D", 1)
        .otherwise(0)
    )
    rows = lines.join(orders, "o_orderkey")
    columns = ["emplid", "cohort", "term_code", "plan_cd", "grade", "units"]
    if not science:
        return rows.select(*columns, (F.col("units") * points).alias("grade_points"))
    parts = t.part.select(
        "p_partkey", F.col("p_type").isin(SCIENCE_TYPES).cast("int").alias("bcmp")
    )
    return rows.join(parts, "p_partkey").select(
        *columns, (F.col("units") * points).alias("grade_points"), "bcmp"
    )


def population(t: Tables) -> DataFrame:
    offset = _pick(DEGREE_OFFSETS, F.col("c_custkey") % 8)
    return (
        t.customer.select("c_custkey")
        .join(cohorts(t), F.col("c_custkey") == F.col("o_custkey"))
        .select(
            _text("c_custkey").alias("emplid"),
            "cohort",
            F.when(F.col("c_custkey") % 5 != 0, F.col("cohort") + offset)
            .cast("int")
            .alias("deg_term"),
        )
    )


def graduation_flags(t: Tables) -> DataFrame:
    """0/1 flags for a degree within 1 to 6 years; null without a degree term."""
    years = F.col("deg_term") - F.col("cohort")
    return population(t).select(
        "emplid",
        *[
            F.when(years.isNull(), F.lit(None))
            .when(years <= 10 * k, 1)
            .otherwise(0)
            .cast("int")
            .alias(f"rate_{k}yr")
            for k in range(1, 7)
        ],
    )


def dae_raw(t: Tables) -> DataFrame:
    key, nation, n = F.col("c_custkey"), F.col("c_nationkey"), F.col("n")
    return t.customer.select(
        "c_custkey", "c_nationkey", "c_mktsegment", F.explode(F.array(F.lit(0), F.lit(1))).alias("n")
    ).select(
        _text("c_custkey").alias("emplid"),
        F.when((key + F.when(key % 97 == 0, n).otherwise(0)) % 2 == 0, "M")
        .otherwise("F")
        .alias("sex"),
        F.when(F.col("c_mktsegment") == "HOUSEHOLD", "UNKNOWN")
        .otherwise(F.col("c_mktsegment"))
        .alias("race_eth"),
        F.when(nation % 3 == 0, "MINORITY").otherwise("NON-MINORITY").alias("min_status"),
        F.when(nation % 3 == 0, "FIRST GENERATION")
        .when(nation % 3 == 1, "CONTINUING GENERATION")
        .otherwise("UNKNOWN")
        .alias("first_gen"),
        F.when(nation == 24, 99).otherwise(1 + nation % 9).cast("int").alias("dep_family"),
        F.when((key + n) % 7 == 0, 99).otherwise(1 + key % 6).cast("int").alias("indep_family"),
        ((key + n) % 10).cast("int").alias("indep_income"),
    )


def admissions_raw(t: Tables) -> DataFrame:
    key = F.col("c_custkey")

    def sat(base: int, factor: int, modulus: int) -> Column:
        return F.when(key % 4 == 0, 0).otherwise(base + 10 * (key * factor % modulus)).cast("int")

    return t.customer.select(
        _text("c_custkey").alias("emplid"),
        (key * 5 % 37).cast("int").alias("act_comp"),
        (key * 7 % 37).cast("int").alias("act_read"),
        (key * 11 % 37).cast("int").alias("act_math"),
        (key * 13 % 37).cast("int").alias("act_eng"),
        (key * 17 % 37).cast("int").alias("act_sci"),
        sat(400, 3, 121).alias("sat_comp"),
        sat(200, 7, 61).alias("sat_read"),
        sat(200, 9, 61).alias("sat_math"),
        (key * 13 % 401).cast("int").alias("hs_gpa"),
    )


def pell_raw(t: Tables) -> DataFrame:
    key = F.col("c_custkey")
    return t.customer.filter(key % 3 < 2).select(
        _text("c_custkey").alias("emplid"),
        F.when(key % 3 == 0, "TRADITIONAL").otherwise("NON TRADITIONAL").alias("elig"),
    )


def scored(t: Tables) -> DataFrame:
    """A label and a deterministic score with ties, for checking evaluation metrics."""
    key = F.col("c_custkey")
    return t.customer.select(
        _text("c_custkey").alias("emplid"),
        ((key % 8).isin(2, 3) & (key % 5 != 0)).cast("int").alias("label"),
        ((key * 37 + 11) % 1000 / F.lit(1000.0)).alias("score"),
    )


def ratings(t: Tables) -> DataFrame:
    """One rating per (user, item); the maximum is combined before the shuffle."""
    return (
        t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
        .join(t.orders.select("o_orderkey", "o_custkey"), "o_orderkey")
        .groupBy(F.col("o_custkey").alias("user"), F.col("l_partkey").alias("item"))
        .agg(F.max((F.col("o_orderkey") + F.col("l_partkey")) % 11).cast("int").alias("rating"))
    )


def catalogue(t: Tables) -> DataFrame:
    return t.part.filter(F.col("p_size") <= 45).select(F.col("p_partkey").alias("item"))
