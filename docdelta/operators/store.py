"""The task and audit store as tables: filters, pages, upserts, expiry, roll-ups (SRT, FLT, SNK-12 to 14, AGG-08 to 11)."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def where_equal(table: DataFrame, **values) -> DataFrame:
    """FLT-03: all given columns equal."""
    return table.where(reduce(lambda a, b: a & b, [F.col(k) == v for k, v in values.items()], F.lit(True)))


def order_by(table: DataFrame, clause: str | None) -> DataFrame:
    """SRT-04: a caller's ORDER BY of one column, ignored unless it is well formed."""
    if not clause or not (m := re.fullmatch(r"([A-Za-z_]\w*)(?: (ASC|DESC))?", clause)) or m[1] not in table.columns:
        return table
    return table.orderBy(F.col(m[1]).desc() if m[2] == "DESC" else F.col(m[1]))


def page(table: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """SRT-01, SRT-02: a page in an order; Spark keeps only the rows of the page."""
    return table.orderBy(*order).offset(offset).limit(limit)


def audit_window(log: DataFrame, start: str | Column, end: str | Column, user=None, event: str | None = None) -> DataFrame:
    """FLT-04: both ends inclusive; records without a time pass, as in the file log."""
    start, end = (F.lit(t).cast("timestamp") if isinstance(t, str) else t for t in (start, end))
    out = log.where(F.col("logged_at").isNull() | F.col("logged_at").between(start, end))
    out = out if user is None else out.where(F.col("user_id") == user)
    return out if event is None else out.where(F.col("event_type") == event)


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """SNK-12: new rows replace old ones with their key."""
    return table.join(rows.select(key), key, "left_anti").select(*table.columns).unionByName(rows)


def update_status(table: DataFrame, key: str, value, status: str, now: Column) -> DataFrame:
    """SNK-12: a status change; completed and failed stamp the time."""
    hit = F.col(key) == value
    done = F.lit(status in ("completed", "failed"))
    return table.withColumns({"status": F.when(hit, status).otherwise(F.col("status")), "completed_at": F.when(hit & done, now).otherwise(F.col("completed_at"))})


def toggle(table: DataFrame, key: str, value, flag: str = "is_active") -> DataFrame:
    """SNK-13."""
    return table.withColumn(flag, F.when(F.col(key) == value, 1 - F.col(flag)).otherwise(F.col(flag)))


def set_default(table: DataFrame, key: str, value, flag: str = "is_default") -> DataFrame:
    """SNK-13: one row alone has the flag; an unknown key changes nothing."""
    known = table.agg(F.count_if(F.col(key) == value).alias("n")).scalar() > 0
    return table.withColumn(flag, F.when(known, F.when(F.col(key) == value, 1).otherwise(0)).otherwise(F.col(flag)))


def expire(table: DataFrame, column: str, cutoff: Column) -> DataFrame:
    """SNK-14, STR-07: rows that are not older than the cut-off."""
    return table.where(F.col(column) >= cutoff)


def latest(table: DataFrame, key: str, at: str, *columns: str) -> DataFrame:
    """STR-05: the last state of each key."""
    return table.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(at, *columns)).alias("s")).select(key, *(F.col("s")[c].alias(c) for c in columns))


def ring(table: DataFrame, order: list[Column], size: int, *by: str) -> DataFrame:
    """SRT-09, WIN-07, AGG-10: the newest rows of each group."""
    return table.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__n") <= size).drop("__n")


def progress(table: DataFrame, *by: str) -> DataFrame:
    """AGG-08: completed, failed, total and per cent done; no tasks at all are done by 100."""
    done, n = F.count_if(F.col("status") == "completed"), F.count("*")
    percent = F.when(n == 0, 100.0).otherwise(F.bround(done / F.greatest(n, F.lit(1)) * 100, 1))
    return table.groupBy(*by).agg(done.alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"), n.alias("total"), percent.alias("percent"))


def trail_summary(records: DataFrame, at: str, key: str, *, recent: int = 10) -> DataFrame:
    """AGG-10: one row with the number of operations, of completed, failed and running ones, and the ``recent`` newest
    in order. Spark keeps the newest rows alone."""
    count = lambda status: F.count_if(F.col("status") == status)
    newest = records.orderBy(F.desc(at), F.desc(key)).limit(recent).agg(F.array_sort(F.collect_list(F.struct(at, key))).alias("x"))
    sums = records.agg(F.count("*").alias("total_operations"), count("completed").alias("completed"), count("failed").alias("failed"), count("processing").alias("in_progress"))
    return sums.withColumn("recent", newest.select(F.transform("x", lambda s: s[key])).scalar())


def export_trail(records: DataFrame, *order: str, exported_at: str) -> DataFrame:
    """SNK-16: the lines of one JSON document {exported_at, total_records, records}, in order: written as text, the files one
    after the other are the document. Records are sorted by ranges, so no task holds them all; ``order`` has to tell them
    apart, and the driver gets two small rows."""
    last = records.agg(F.count("*").alias("n"), F.max(F.struct(*order)).alias("last"))
    n, end = last.select("n").scalar(), last.select("last").scalar()
    record = F.to_json(F.struct(*records.columns))
    lines = records.select(F.lit(1).alias("part"), *order, F.concat(record, F.when(F.struct(*order) == end, "").otherwise(",")).alias("value"))
    edge = lambda part, value: records.sparkSession.range(1).select(F.lit(part).alias("part"), *(F.lit(None).cast(records.schema[c].dataType).alias(c) for c in order), value.alias("value"))
    head = edge(0, F.concat(F.lit(f'{{"exported_at":"{exported_at}","total_records":'), n, F.lit(',"records":[')))
    return head.unionByName(lines).unionByName(edge(2, F.lit("]}"))).orderBy("part", *order).select("value")


def health(parts: DataFrame, every: bool = False) -> DataFrame:
    """AGG-11: from (name, critical, available): unhealthy without critical parts (with ``every``: without one of them),
    degraded if any part is missing."""
    counts = parts.agg(F.count_if("critical").alias("need"), F.count_if(F.col("critical") & F.col("available")).alias("have"), F.count_if(~F.col("available")).alias("gone"))
    return counts.select(F.when((F.col("need") > 0) & (F.col("have") < F.col("need") if every else F.col("have") == 0), "unhealthy").when(F.col("gone") > 0, "degraded").otherwise("healthy").alias("status"), "need", "have", "gone")


def allowed(keys: DataFrame, permissions: DataFrame, wanted: str) -> DataFrame:
    """FLT-09, FLT-05, FLT-06: active keys whose role holds a permission, without their hashes."""
    roles = F.broadcast(permissions.where(F.array_contains("permissions", wanted)).select("role"))  # a row a role
    return keys.where(F.col("is_active") == 1).join(roles, "role", "left_semi").select("key_id", "role", "label")


def migrate(json_rows: DataFrame) -> DataFrame:
    """SRC-18: key records with defaults."""
    return json_rows.select(F.explode("keys").alias("k")).select("k.key_id", "k.key_hash", F.coalesce("k.role", F.lit("viewer")).alias("role"), F.coalesce("k.label", F.lit("")).alias("label"), F.coalesce("k.is_active", F.lit(True)).alias("is_active"))
