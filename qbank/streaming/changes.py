"""ST1-ST8: keyed change logs with Structured Streaming.

The change queue keeps one row a key: while a change is pending its base
revision and first time stay and its count grows; once published, the next
change starts anew.  In a stream the queue is state by key
(``applyInPandasWithState``); over a finished log the same fold is one window
and one aggregation.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

QUEUE = "key long, base long, local long, pending long, queued_at timestamp, status string"
STATE = "base long, local long, pending long, queued_at timestamp, status string"


def changed(before: Column, after: Column) -> Column:
    """ST1: a null-safe difference of the tracked fields."""
    return ~before.eqNullSafe(after)


def captured(log: DataFrame, key: str, order: str, tracked: list[str], skip: Column | None = None) -> DataFrame:
    """ST1: the rows of a log that change a tracked field of their key and are not flagged to be skipped."""
    w = W.partitionBy(key).orderBy(order)
    row = F.struct(*tracked)
    out = log.withColumn("_before", F.lag(row).over(w)).where(F.col("_before").isNull() | changed(F.col("_before"), row))
    return (out if skip is None else out.where(~skip)).drop("_before")


def coalesced(log: DataFrame, key: str, order: str, published: Column) -> DataFrame:
    """ST2: of each key the changes since it was last published: base and first order, last order, count."""
    w = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    marked = log.withColumn("_p", published).withColumn("_era", F.coalesce(F.sum(F.col("_p").cast("int")).over(w), F.lit(0)))
    last = marked.withColumn("_last", F.max("_era").over(W.partitionBy(key))).where("_era = _last and not _p")
    return last.groupBy(key).agg(F.min(order).alias("base"), F.max(order).alias("local"), F.count("*").alias("pending"))


def publish_action(server: Column, base: Column, local_payload: Column, server_payload: Column) -> Column:
    """ST3: insert, conflict, published or update."""
    return (
        F.when(server.isNull(), "insert").when(server != base, "conflict")
        .when(local_payload.eqNullSafe(server_payload), "published").otherwise("update")
    )


def since(feed: DataFrame, cursor: int, kept: int = 200, seq: str = "seq") -> DataFrame:
    """ST6: the updates behind the cursor among the last ``kept``."""
    return feed.orderBy(F.desc(seq)).limit(kept).where(F.col(seq) > cursor)


def alive(leases: DataFrame, now: Column, ttl_seconds: int, ts: str = "ts") -> DataFrame:
    """ST7: leases that have not run out."""
    return leases.where(F.col(ts) >= now - F.make_dt_interval(secs=F.lit(ttl_seconds)))


def invalidated(rows: DataFrame, signature: Column, stored: Column, outputs: list[str]) -> DataFrame:
    """ST8: outputs are cleared where the source's signature is another one now."""
    stale = changed(signature, stored)
    return rows.withColumns({c: F.when(~stale, F.col(c)) for c in outputs} | {"stale": stale})


def change_queue(stream: DataFrame) -> DataFrame:
    """ST1, ST2 as a stream of ``key, revision, ts, published``: the queue's rows as they change."""

    def fold(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        base, local, pending, queued, status = state.get if state.exists else (None, None, 0, None, "published")
        for t in batches:
            for row in t.sort_values("revision").itertuples(index=False):
                if row.published:
                    pending, status = 0, "published"
                    continue
                if not pending:
                    base, queued = row.revision, None if pd.isna(row.ts) else row.ts
                local, pending, status = row.revision, pending + 1, "pending"
        if base is None:
            return
        state.update((base, local, pending, queued, status))
        yield pd.DataFrame([(key[0], base, local, pending, queued, status)], columns=[c.split()[0] for c in QUEUE.split(", ")])

    return stream.groupBy("key").applyInPandasWithState(fold, QUEUE, STATE, "update", GroupStateTimeout.NoTimeout)


def upserting(path: str, key: str):  # noqa: ANN201
    """A ``foreachBatch`` function: the table at ``path`` with each batch's last row of a key, by version folders."""

    def write(batch: DataFrame, version: int) -> None:
        spark = batch.sparkSession
        last = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), F.col("local")).alias("r")).select("r.*")
        if version:
            old = spark.read.parquet(f"{path}/v={version - 1}")
            last = last.unionByName(old.join(last, key, "left_anti"))
        last.write.mode("overwrite").parquet(f"{path}/v={version}")

    return write
