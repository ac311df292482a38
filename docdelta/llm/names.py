"""Columns by their names, whatever these are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def column(name: str) -> Column:
    """The column of exactly this name, which may hold full stops and backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def spare(columns: list[str] | tuple[str, ...], *wanted: str) -> list[str]:
    """The wanted names, made longer than any of the columns', so that they clash with none."""
    longest = max(map(len, columns), default=0)
    return [w.ljust(longest + 1, "_") for w in wanted]


def select_named(docs: DataFrame, columns: list[str] | tuple[str, ...]) -> DataFrame:
    """The columns of exactly these names."""
    return docs.select(*(column(c) for c in columns))
