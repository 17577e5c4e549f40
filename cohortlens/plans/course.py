"""Course rows: grade eligibility, science and season measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.expressions import counts_for_credit, counts_in_gpa, term_digit
from cohortlens.functions.labels import COUNTED_GRADES
from cohortlens.operators.encode import dummies

GRADE_FLAGS = [f"g_{g.lower()}" for g in COUNTED_GRADES]
CUMULATED = [
    "grade_points_in_gpa",
    "units_taken",
    "units_in_gpa",
    "units_for_credit",
    "bcmp",
    "bcmp_grade_points_in_gpa",
    "bcmp_units_taken",
    "bcmp_units_in_gpa",
    "bcmp_units_for_credit",
    "summer",
    "winter",
]
MEASURES = CUMULATED[:9] + GRADE_FLAGS + CUMULATED[9:]
KEYS = ["cohort", "emplid", "term_code", "plan_cd"]


def eligibility(enrolments: DataFrame) -> DataFrame:
    """Points and units that count toward the grade average and toward credit."""
    science_units = F.col("bcmp") * F.col("units")
    science_points = F.col("bcmp") * F.col("grade_points")
    return enrolments.withColumns(
        {
            "grade_points_in_gpa": counts_in_gpa("grade", "grade_points"),
            "units_in_gpa": counts_in_gpa("grade", "units"),
            "units_for_credit": counts_for_credit("grade", "units"),
            "bcmp_units_taken": science_units,
            "bcmp_grade_points_in_gpa": counts_in_gpa("grade", science_points),
            "bcmp_units_in_gpa": counts_in_gpa("grade", science_units),
            "bcmp_units_for_credit": counts_for_credit("grade", science_units),
        }
    )


def season_units(rows: DataFrame) -> DataFrame:
    """Credit units taken in summer (last term digit 3) and winter (1)."""
    digit = term_digit("term_code")
    return rows.withColumns(
        {
            "summer": F.when(digit == "3", F.col("units_for_credit")).otherwise(0),
            "winter": F.when(digit == "1", F.col("units_for_credit")).otherwise(0),
        }
    )


def course_features(enrolments: DataFrame) -> DataFrame:
    rows = season_units(eligibility(enrolments)).withColumnRenamed("units", "units_taken")
    return rows.select("*", *dummies("grade", COUNTED_GRADES, "g"))
