"""Scalar column expressions shared by the plans. All of them stay inside generated code."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortlens.functions.labels import INCOME_BANDS, NOT_FOR_CREDIT, NOT_IN_GPA

# Dev share of the student split: the first four hex digits of the hash lie below this bound (10 %).
DEV_BOUND = "199a"
# Same for the 25 % row-level split.
TEST_BOUND = "4000"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: Column | str, den: Column | str, on_zero: str = "zero") -> Column:
    """num / den; a zero denominator gives 0, or null with ``on_zero="null"``."""
    value = F.try_divide(col(num).cast("double"), col(den).cast("double"))
    return value if on_zero == "null" else F.coalesce(value, F.lit(0.0))


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Round for comparison; adding zero turns -0.0 into 0.0."""
    return F.round(col(c), digits) + F.lit(0.0)


def counts_in_gpa(grade: Column | str, value: Column | str) -> Column:
    return F.when(~col(grade).isin(NOT_IN_GPA), col(value))


def counts_for_credit(grade: Column | str, value: Column | str) -> Column:
    return F.when(~col(grade).isin(NOT_FOR_CREDIT), col(value))


def term_digit(term: Column | str) -> Column:
    return F.substring(col(term).cast("string"), -1, 1)


def semester_index(diff: Column | str) -> Column:
    """1, 2, 3 ... from term code minus cohort code; truncates toward zero before the cohort."""
    d = col(diff)
    return (
        F.when(d % 10 == 0, d / 5 + 1).otherwise((d + 2) / 5).cast("int")
    )


def time_to_degree(diff: Column | str) -> Column:
    """Half-year index of the degree term; negative differences pass through, null stays null."""
    d = col(diff)
    index = F.when((d % 10).isin(0, 7), d / 5 + 1).otherwise((d + 2) / 5).cast("int")
    return F.when(d >= 0, index).otherwise(d)


def graduated_within(flags: list[str]) -> Column:
    """0 only when every yearly flag is 0; a null flag counts as graduated."""
    total = sum((F.col(c) for c in flags[1:]), F.col(flags[0]))
    return F.when(total == 0, 0).otherwise(1)


def science_flag(department: Column | str, labels: list[str]) -> Column:
    return F.when(col(department).isin(labels), 1).otherwise(0)


def income_label(code: Column | str) -> Column:
    expr = F.lit(None).cast("string")
    for value, label in reversed(INCOME_BANDS.items()):
        expr = F.when(col(code) == value, label).otherwise(expr)
    return expr


def relabel(c: Column | str, old: str, new: str) -> Column:
    return F.when(col(c) == old, new).otherwise(col(c))


def plan_text(plan: Column | str) -> Column:
    return F.coalesce(col(plan).cast("string"), F.lit("nan"))


def plan_subject(plan: Column | str) -> Column:
    return F.substring(plan_text(plan), 1, 4)


def plan_type(plan: Column | str) -> Column:
    return F.substring(plan_text(plan), 5, 2)


def pseudonym(identifier: Column | str, salt: str) -> Column:
    """Keyed 32-character token, stable across runs and tables."""
    return F.substring(F.sha2(F.concat(col(identifier), F.lit(salt)), 256), 1, 32)


def _key_text(keys: list[str], seed: int) -> Column:
    parts: list[Column] = []
    for key in keys:
        parts += [F.col(key).cast("string"), F.lit("|")]
    return F.concat(*parts, F.lit(str(seed)))


def hash_uniform(keys: list[str], seed: int) -> Column:
    """Uniform value in (0, 1] from a row key; independent of partitioning."""
    prefix = F.substring(F.md5(_key_text(keys, seed)), 1, 8)
    return (F.conv(prefix, 16, 10).cast("bigint") + 1) / F.lit(4294967296.0)


def is_dev(identifier: str, seed: int = 42) -> Column:
    return F.substring(F.md5(_key_text([identifier], seed)), 1, 4) < DEV_BOUND


def is_test(keys: list[str], seed: int = 42) -> Column:
    return F.substring(F.md5(_key_text(keys, seed)), 1, 4) < TEST_BOUND


def fold_of(keys: list[str], folds: int, seed: int = 42) -> Column:
    prefix = F.substring(F.md5(_key_text(keys, seed)), 1, 8)
    return (F.conv(prefix, 16, 10).cast("bigint") % folds).cast("int")


def slug(label: str) -> str:
    """A plain snake_case column name for an encoded label."""
    return re.sub(r"[^0-9a-z]+", "_", label.lower()).strip("_")


def high_school_gpa(column: str) -> Column:
    """The high-school score, kept as hundredths, as grade points."""
    return F.col(column) / F.lit(100.0)
