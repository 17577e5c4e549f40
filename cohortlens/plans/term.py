"""Term rows: aggregates, cumulative sums, ratios, load indexes, major changes.

Course rows shrink to (cohort, student, term, plan) rows before anything is partitioned by student,
so a student's window holds at most one row per combination of codes, however many courses there are.
All windows share one partitioning, hence one exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.expressions import plan_subject, ratio, semester_index
from cohortlens.functions.labels import DFW_GRADES
from cohortlens.plans.course import CUMULATED, KEYS, MEASURES, course_features

PRESCRIBED_UNITS = 15


def term_aggregate(
    rows: DataFrame, keys: list[str] = KEYS, measures: list[str] = MEASURES
) -> DataFrame:
    """Sums per key; an all-null group sums to 0 and rows with a null key are dropped."""
    return (
        rows.na.drop("any", subset=keys)
        .groupBy(*keys)
        .agg(*[F.expr(f"coalesce(sum({m}), 0) AS {m}") for m in measures])
    )


def aggregate_with(rows: DataFrame, keys: list[str], functions: dict[str, str]) -> DataFrame:
    """Group by ``keys`` with a function name per column (``sum`` or ``max``)."""
    known = {"sum": lambda c: F.coalesce(F.sum(c), F.lit(0)), "max": F.max}
    return (
        rows.na.drop("any", subset=keys)
        .groupBy(*keys)
        .agg(*[known[f](c).alias(c) for c, f in functions.items()])
    )


def _up_to_term(student: str = "emplid", term: str = "term_code"):
    return (
        Window.partitionBy(student)
        .orderBy(F.col(term))
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )


def cumulate(
    rows: DataFrame, measures: list[str], student: str = "emplid", term: str = "term_code"
) -> DataFrame:
    """Running sums per student; all rows of a term share the total of that term."""
    scope = f"PARTITION BY {student} ORDER BY {term} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    return rows.selectExpr("*", *[f"sum({m}) OVER ({scope}) AS cum_{m}" for m in measures])


def cumulate_rows(rows: DataFrame, measures: list[str]) -> DataFrame:
    """Running sums row by row in (term, cohort, plan) order."""
    scope = (
        Window.partitionBy("emplid")
        .orderBy("term_code", "cohort", "plan_cd")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return rows.withColumns({f"cum_{m}": F.sum(m).over(scope) for m in measures})


def grade_averages(rows: DataFrame) -> DataFrame:
    return rows.withColumns(
        {
            "term_gpa": ratio("grade_points_in_gpa", "units_in_gpa"),
            "cum_gpa": ratio("cum_grade_points_in_gpa", "cum_units_in_gpa"),
            "bcmp_term_gpa": ratio("bcmp_grade_points_in_gpa", "bcmp_units_in_gpa"),
            "bcmp_cum_gpa": ratio("cum_bcmp_grade_points_in_gpa", "cum_bcmp_units_in_gpa"),
        }
    )


def load_indexes(rows: DataFrame, on_zero: str = "zero") -> DataFrame:
    """Load index, the same without pre-cohort units, and the student's pre-degree share.

    The student maximum is taken before filling, so pre-cohort rows (0 prescribed units) are skipped.
    """
    diff = F.col("term_code") - F.col("cohort")
    student = Window.partitionBy("emplid")

    def load(units: Column, index: Column) -> Column:
        return ratio(units, index * PRESCRIBED_UNITS, "null")

    indexed = rows.withColumns(
        {
            "term_diff": diff,
            "semester_index": semester_index(diff),
            "units_for_credit_exclude": F.when(diff >= 0, F.col("units_for_credit")).otherwise(0),
        }
    )
    summed = indexed.withColumn(
        "cum_units_for_credit_exclude", F.sum("units_for_credit_exclude").over(_up_to_term())
    )
    on_degree = F.when(F.col("term_diff") < 0, 0).otherwise(F.col("semester_index"))
    loaded = summed.withColumns(
        {
            "load_index": load(F.col("cum_units_for_credit"), F.col("semester_index")),
            "load_index_exclude": load(F.col("cum_units_for_credit_exclude"), on_degree),
        }
    ).withColumn(
        "load_index_only",
        F.max(F.col("load_index") - F.col("load_index_exclude")).over(student),
    )
    if on_zero == "null":
        return loaded
    return loaded.na.fill(0, ["load_index", "load_index_exclude", "load_index_only"])


def completion(rows: DataFrame, on_zero: str = "zero") -> DataFrame:
    return rows.withColumn(
        "completion_rate", ratio("units_for_credit", "units_taken", on_zero)
    )


def dfw(rows: DataFrame, on_zero: str = "zero") -> DataFrame:
    flags = [F.col(f"g_{g.lower()}") for g in DFW_GRADES]
    return rows.withColumn("dfw", sum(flags[1:], flags[0])).withColumn(
        "dfw_rate", ratio("dfw", "units_taken", on_zero)
    )


def major_changes(rows: DataFrame) -> DataFrame:
    """1 where the plan's subject differs from the student's previous row, and the running count."""
    order = Window.partitionBy("emplid").orderBy("term_code", "plan_cd", "cohort")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    previous = F.lag(plan_subject("plan_cd")).over(order)
    return rows.withColumn(
        "major_change_indicator",
        F.when(previous != plan_subject("plan_cd"), 1).otherwise(0),
    ).withColumn("major_change_cnt", F.sum("major_change_indicator").over(so_far))


def drop_before_cohort(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("cohort") <= F.col("term_code"))


def term_features(enrolments: DataFrame) -> DataFrame:
    """All term-level features of the packaged pipeline, on-degree terms only."""
    rows = cumulate(term_aggregate(course_features(enrolments)), CUMULATED)
    rows = dfw(completion(load_indexes(grade_averages(rows))))
    return major_changes(drop_before_cohort(rows))


def transform_terms(
    rows: DataFrame, functions: dict[str, str], student: str, term: str, cohort: str
) -> DataFrame:
    """Caller-chosen term aggregates plus cumulative sums, grade averages, load and completion.

    The aggregation map must cover ``grade_points_in_gpa``, ``units_taken``, ``units_in_gpa`` and
    ``units_for_credit``.
    """
    summed = ["grade_points_in_gpa", "units_taken", "units_in_gpa", "units_for_credit"]
    grouped = cumulate(aggregate_with(rows, [student, term, cohort], functions), summed, student, term)
    diff = F.col(term).cast("int") - F.col(cohort).cast("int")
    return completion(
        grouped.withColumns(
            {
                "term_gpa": ratio("grade_points_in_gpa", "units_in_gpa"),
                "cum_gpa": ratio("cum_grade_points_in_gpa", "cum_units_in_gpa"),
                "term_diff": diff,
                "n": semester_index(diff),
            }
        )
        .withColumn("prescribed_units", F.col("n") * PRESCRIBED_UNITS)
        .withColumn("load_index", ratio("cum_units_for_credit", "prescribed_units"))
    )
