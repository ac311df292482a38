"""Stateful operators (STR-01 to STR-06) and their batch twins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from ..functions import vocab

_OUT = "client string, at double, admitted boolean"


def admitted(now: float, kept: list[float], per_minute: int = vocab.RATE_PER_MINUTE, burst: int = vocab.RATE_BURST) -> bool:
    """STR-01: whether a request passes, given the admitted ones of the last minute."""
    return not (len(kept) >= burst and now - kept[0] < 1.0) and len(kept) < per_minute


def admit(times: list[float], kept: list[float], per_minute: int = vocab.RATE_PER_MINUTE, burst: int = vocab.RATE_BURST) -> tuple[list[bool], list[float]]:
    """STR-01: verdicts for requests in order, and the admitted times still counted. Only admitted requests count."""
    out = []
    for now in times:
        kept = [t for t in kept if now - t < 60]
        ok = admitted(now, kept, per_minute, burst)
        out.append(ok)
        if ok:
            kept.append(now)
    return out, kept


def rate_limit_batch(requests: DataFrame, idle: int = 60) -> DataFrame:
    """(client, at) → (client, at, admitted) in a batch.

    After ``idle`` seconds without requests nothing counts any more, so a client's requests fall into sessions that are
    taken each by itself, in order, in sorted Arrow batches with a window of at most the limit carried on. Sessions are
    told from the first and last request of each minute, which are far fewer than the requests.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, kept = None, []
        for batch in batches:
            verdicts = []
            for who, session, at in zip(batch.client, batch.session, batch["at"]):
                if (who, session) != of:
                    of, kept = (who, session), []
                kept = [t for t in kept if at - t < idle]
                ok = admitted(at, kept)
                if ok:
                    kept.append(at)
                verdicts.append(ok)
            yield pd.DataFrame({"client": batch.client, "at": batch["at"], "admitted": verdicts})

    rows = requests.select(F.col("client").cast("string").alias("client"), F.col("at").cast("double").alias("at")).withColumn("minute", F.floor(F.col("at") / idle))
    minutes = rows.groupBy("client", "minute").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    in_turn = Window.partitionBy("client").orderBy("minute")
    begins = F.coalesce((F.col("first") - F.lag("last").over(in_turn) >= idle).cast("int"), F.lit(1))
    sessions = minutes.withColumn("begins", begins).withColumn("session", F.sum("begins").over(in_turn)).select("client", "minute", "session")
    told = rows.join(sessions, ["client", "minute"]).select("client", "session", "at")
    return told.repartition("client", "session").sortWithinPartitions("client", "session", "at").mapInPandas(run, _OUT)


def rate_limit(requests: DataFrame) -> DataFrame:
    """STR-01 on a stream of (client, at): a state of at most the limit's times for each client, dropped when idle."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = list(state.get[0]) if state.exists else []
        times = sorted(t for f in frames for t in f["at"])
        verdicts, kept = admit(times, kept)
        state.update((kept,))
        state.setTimeoutDuration(60_000)
        yield pd.DataFrame({"client": [key[0]] * len(times), "at": times, "admitted": verdicts})

    rows = requests.select(F.col("client").cast("string").alias("client"), F.col("at").cast("double").alias("at"))
    return rows.groupBy("client").applyInPandasWithState(run, _OUT, "kept array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def hourly_counts(log: DataFrame, late: str = "2 hours") -> DataFrame:
    """STR-04: events an hour and kind, with a watermark for late records; the same on a batch."""
    return log.withWatermark("logged_at", late).groupBy(F.window("logged_at", "1 hour"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("hour"), "event_type", "n")


def batch_progress(tasks: DataFrame) -> DataFrame:
    """STR-03: done and failed of each batch, in update mode on a stream."""
    return tasks.groupBy("batch_id").agg(F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"), F.count("*").alias("total"))


def life_cycle(changes: DataFrame) -> DataFrame:
    """STR-05: the last status of each task."""
    return changes.groupBy("task_id").agg(F.max_by("status", "changed_at").alias("status"))


def trail(steps: DataFrame) -> DataFrame:
    """STR-06: (operation_id, step, at, details) → the last step and all details, later ones over earlier."""
    entries = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", F.map_entries("details").alias("entries")))), lambda s: s["entries"]))
    merged = F.aggregate(entries, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")), lambda a, e: F.map_concat(F.map_filter(a, lambda k, _: k != e["key"]), F.create_map(e["key"], e["value"])))
    return steps.groupBy("operation_id").agg(F.max_by("step", "at").alias("status"), merged.alias("details"))


class _Expiry(StatefulProcessor):
    """The last status of a task, until a time after its last change."""

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "status string, at bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        known = self.last.get() if self.last.exists() else None
        for frame in rows:
            for status, at in zip(frame.status, frame["ms"]):
                if known is None or (int(at), status) > (known[1], known[0]):
                    known = (status, int(at))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.last.update(known)
        self.handle.registerTimer(known[1] + 1000 * self.seconds)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, at = self.last.get()
        self.last.clear()
        yield pd.DataFrame({"task_id": [key[0]], "status": [status], "last_ms": [at], "expired_ms": [expiredTimerInfo.getExpiryTimeInMs()]})

    def close(self) -> None:
        pass


def expiries(changes: DataFrame, seconds: int = 3600, late: str = "10 minutes") -> DataFrame:
    """STR-02, STR-07 on a stream of (task_id, status, changed_at): (task_id, status, last_ms, expired_ms) of every task that
    nothing has changed for ``seconds``, as soon as the watermark says so.

    State is one row for each living task, dropped with its timer; changes come in any order within ``late``, later ones
    are left out. A task that changes again after it expired lives again. Needs the RocksDB state store.
    """
    rows = changes.select(F.col("task_id").cast("string").alias("task_id"), "status", "changed_at").withWatermark("changed_at", late).withColumn("ms", F.unix_millis("changed_at"))
    out = "task_id string, status string, last_ms bigint, expired_ms bigint"
    return rows.groupBy("task_id").transformWithStateInPandas(_Expiry(seconds), out, "Append", "EventTime")


def expiries_batch(changes: DataFrame, seconds: int, now: Column) -> DataFrame:
    """What :func:`expiries` has told when its watermark is ``now``: each stretch of a task's changes that ends ``seconds``
    before the next one or before now."""
    at = F.unix_millis("changed_at")
    after = F.coalesce(F.lead("ms").over(Window.partitionBy("task_id").orderBy("ms", "status")), F.unix_millis(now))
    rows = changes.select(F.col("task_id").cast("string").alias("task_id"), "status", at.alias("ms")).withColumn("after", after)
    return rows.where(F.col("after") - F.col("ms") >= 1000 * seconds).select("task_id", "status", F.col("ms").alias("last_ms"), (F.col("ms") + 1000 * seconds).alias("expired_ms"))
