"""The rows of the quantile transform."""

from __future__ import annotations

from cohortlens.checks import models


def test_rows_are_made_once(tables, monkeypatch):
    """The landmarks and the result both made the feature table."""
    seen = []
    monkeypatch.setattr(models.transforms, "quantile_normal", lambda df, columns: seen.append(df) or df)
    models.quantile_normal(tables)
    files = seen[0].inputFiles()
    assert files and all("/step-" in f for f in files)
