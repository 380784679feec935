"""X1, ST1, ST2, ST7 as state machines: ``transformWithState`` with value and map state, timers and time to live.

Both need the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
Each has a fold over a finished log that gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Set this in a session whose streams keep state here.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

# -- the change queue (X1, ST1, ST2) ------------------------------------------------------------------

#: What a queue's stream reads: ``published`` rows tell that a key was published, ``skip`` those that the trigger ignores.
CHANGE = "key long, revision long, payload string, ts timestamp, published boolean, skip boolean"
QUEUED = "key long, base long, local long, payload string, queued_at timestamp, changed_at timestamp, pending long, status string"
_PENDING = "base long, local long, payload string, queued_at timestamp, changed_at timestamp, pending long, status string"
_SEEN = "revision long, payload string"


class ChangeQueue(StatefulProcessor):
    """A row a key: what is pending since it was last published.

    The last payload is kept to tell whether a change changes anything (ST1); it
    may be dropped ``retention`` after its last change (the next change then
    counts as new). A pending row stays until it is published, then as published.
    """

    def __init__(self, retention_ms: int | None = None) -> None:
        self.retention_ms = retention_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.queue = handle.getValueState("queue", _PENDING)
        self.seen = handle.getValueState("seen", _SEEN, self.retention_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ARG002
        changes = pd.concat(list(rows)).sort_values(["ts", "revision"], kind="stable")
        last = self.seen.get() if self.seen.exists() else None
        row = list(self.queue.get()) if self.queue.exists() else None
        before = row
        for c in changes.itertuples(index=False):
            if c.published:
                if row:
                    row = [*row[:5], 0, "published"]
                continue
            payload, revision = (None if pd.isna(c.payload) else c.payload), max(1 if pd.isna(c.revision) else int(c.revision), 1)
            if c.skip or (last is not None and last[1] == payload):
                continue
            base = max(last[0], 1) if last is not None else max(revision - 1, 1)
            at = c.ts.to_pydatetime()
            if row and row[6] == "pending":
                row = [row[0], revision, payload, row[3], at, row[5] + 1, "pending"]
            else:
                row = [base, revision, payload, at, at, 1, "pending"]
            last = (revision, payload)
            self.seen.update(last)
        if row is not None and row != before:
            self.queue.update(tuple(row))
            yield pd.DataFrame([(key[0], *row)], columns=[c.split()[0] for c in QUEUED.split(", ")])

    def close(self) -> None:
        pass


def queued(changes: DataFrame, retention_ms: int | None = None) -> DataFrame:
    """The queue's rows as they change, from a stream of ``CHANGE``."""
    mode = "processingTime" if retention_ms else "none"
    return changes.groupBy("key").transformWithStateInPandas(ChangeQueue(retention_ms), QUEUED, "Update", mode)


def queued_log(changes: DataFrame) -> DataFrame:
    """The same rows at the end of a finished log: windows and one aggregation, no state.

    A change counts if its payload differs from that of the change that counted
    before it, which is that of the change before it.
    """
    order = W.partitionBy("key").orderBy("ts", "revision")
    real = changes.where(~F.coalesce("published", F.lit(False)) & ~F.coalesce("skip", F.lit(False)))
    real = real.withColumns({"revision": F.greatest(F.coalesce("revision", F.lit(1)), F.lit(1)), "_first": F.row_number().over(order) == 1, "_before": F.lag("payload").over(order)})
    real = real.where(F.col("_first") | ~F.col("_before").eqNullSafe(F.col("payload")))
    real = real.withColumn("_base", F.coalesce(F.lag("revision").over(order), F.greatest(F.col("revision") - 1, F.lit(1))))
    marks = changes.where("published").select("key", "revision", "ts", F.lit(True).alias("_mark"))
    both = real.select("key", "revision", "payload", "ts", "_base", F.lit(False).alias("_mark")).unionByName(marks, allowMissingColumns=True)
    earlier = W.partitionBy("key").orderBy("ts", "revision").rowsBetween(W.unboundedPreceding, W.currentRow)
    eras = both.withColumn("_era", F.sum(F.col("_mark").cast("int")).over(earlier))
    of = F.struct("ts", "revision")
    told = eras.where("not _mark").groupBy("key", "_era").agg(
        F.min_by("_base", of).alias("base"), F.max_by("revision", of).alias("local"), F.max_by("payload", of).alias("payload"),
        F.min("ts").alias("queued_at"), F.max("ts").alias("changed_at"), F.count("*").alias("pending"),
    )
    last = told.groupBy("key").agg(F.max_by(F.struct(*told.columns), F.col("_era")).alias("r")).select("r.*")
    now = eras.groupBy("key").agg(F.max("_era").alias("_now"))
    open_ = F.col("_era") == F.col("_now")
    return last.join(now, "key").select(
        "key", "base", "local", "payload", "queued_at", "changed_at", F.when(open_, F.col("pending")).otherwise(0).alias("pending"), F.when(open_, "pending").otherwise("published").alias("status")
    )


# -- leases (ST7) ---------------------------------------------------------------------------------------

#: What a lease's stream reads: ``kind`` is ``hold`` (taken or renewed) or ``release``.
HELD = "gate string, lease string, kind string, ts timestamp"
TOLD = "gate string, lease string, event string, at timestamp"


class Leases(StatefulProcessor):
    """The leases of a gate by name; one that isn't renewed for longer than ``ttl`` runs out by an event-time timer."""

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stamps = handle.getMapState("stamps", "lease string", "ms long")

    def _told(self, key: Any, rows: list[tuple[str, str, int]]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame({"gate": [key[0]] * len(rows), "lease": [r[0] for r in rows], "event": [r[1] for r in rows], "at": pd.to_datetime([r[2] for r in rows], unit="ms")})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ARG002
        out: list[tuple[str, str, int]] = []
        for r in pd.concat(list(rows)).sort_values(["ts", "lease"], kind="stable").itertuples(index=False):
            now = r.ts.value // 1_000_000
            held = self.stamps.getValue((r.lease,))[0] if self.stamps.containsKey((r.lease,)) else None
            if held is not None and now - held > self.ttl_ms:
                out.append((r.lease, "expired", held + self.ttl_ms))
                held = None
            if r.kind == "release":
                if held is not None:
                    out.append((r.lease, "released", now))
                if self.stamps.containsKey((r.lease,)):
                    self.stamps.removeKey((r.lease,))
                continue
            out.append((r.lease, "acquired" if held is None else "renewed", now))
            self.stamps.updateValue((r.lease,), (now,))
            self.handle.registerTimer(now + self.ttl_ms + 1)
        yield from self._told(key, out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ARG002
        now = expiredTimerInfo.getExpiryTimeInMs()
        gone = [(k[0], "expired", v[0] + self.ttl_ms) for k, v in self.stamps.iterator() if now - v[0] > self.ttl_ms]
        for lease, _, _ in gone:
            self.stamps.removeKey((lease,))
        yield from self._told(key, gone)

    def close(self) -> None:
        pass


def lease_events(stream: DataFrame, ttl_ms: int, delay: str = "0 seconds") -> DataFrame:
    """ST7: what happens to leases, from a stream of ``HELD``."""
    marked = stream.withWatermark("ts", delay)
    return marked.groupBy("gate").transformWithStateInPandas(Leases(ttl_ms), TOLD, "Append", "eventTime")


def lease_log(events: DataFrame, ttl_ms: int, now: Column) -> DataFrame:
    """The same rows from a finished log, as of ``now``: each lease's event against the one before and the one behind it."""
    order = W.partitionBy("gate", "lease").orderBy("ts", F.desc("kind"))
    ttl = F.make_dt_interval(secs=F.lit(ttl_ms / 1000))
    rows = events.withColumns({"_kind": F.lag("kind").over(order), "_ts": F.lag("ts").over(order), "_next": F.lead("ts").over(order)})
    held = F.coalesce((F.col("_kind") == "hold") & (F.col("ts") - F.col("_ts") <= ttl), F.lit(False))
    event = F.when(F.col("kind") == "hold", F.when(held, "renewed").otherwise("acquired")).when(held, "released")
    happened = rows.select("gate", "lease", event.alias("event"), F.col("ts").alias("at")).where("event is not null")
    late = rows.where((F.col("kind") == "hold") & (F.coalesce("_next", now) - F.col("ts") > ttl))
    return happened.unionByName(late.select("gate", "lease", F.lit("expired").alias("event"), (F.col("ts") + ttl).alias("at")))
