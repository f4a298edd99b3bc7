"""Columns of the caller's, kept apart from an operator's own."""

from __future__ import annotations

from pyspark.sql import DataFrame


def renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns named c0, c1, ..., which no operator uses for its own, and each one's new name."""
    own = {name: f"c{i}" for i, name in enumerate(docs.columns)}
    return docs.toDF(*own.values()), own
