"""Joins in which single keys may hold a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than a share of 1 / HOT of the rows is hot, so there are fewer than HOT of them.
HOT = 100


def dealt(table: DataFrame) -> DataFrame:
    """``table`` for a join by keys that deals both sides, even where it is small. A loop of many small joins would else
    build every table again in the driver, each on a thread of its own."""
    return table.hint("merge")


def join_hot(rows: DataFrame, labels: DataFrame, on: str, total: int) -> DataFrame:
    """``rows`` joined to ``labels``, which has a row for each key and in ``n`` its number of ``rows`` out of ``total``.

    The labels of hot keys, fewer than HOT rows, are broadcast, so that their rows stay where they are; only the rows of
    the other keys are dealt by key.
    """
    hot = labels.where(F.col("n") * HOT > total)
    columns = [c for c in labels.columns if c not in ("n", on)]
    cold = rows.join(F.broadcast(hot.select(on)), on, "left_anti")
    return rows.join(F.broadcast(hot.select(on, *columns)), on).unionByName(cold.join(labels.select(on, *columns), on))
