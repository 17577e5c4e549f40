"""Import every check module so that its queries are registered."""

from cohortlens.checks import evaluation, models, newton, ratings, student, trees  # noqa: F401
from cohortlens.checks.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
