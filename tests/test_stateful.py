"""Streams with state: timers, restarts, and the same rows as over the finished log."""

import datetime
import random
import time

import pytest
from pyspark.sql import functions as F

from qbank.streaming import stateful

START = datetime.datetime(2024, 1, 1)


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


@pytest.fixture
def stored(spark):
    before = spark.conf.get(stateful.STATE_STORE[0], None)
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set(*stateful.STATE_STORE)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    if before is None:
        spark.conf.unset(stateful.STATE_STORE[0])
    else:
        spark.conf.set(stateful.STATE_STORE[0], before)


def put(spark, rows, schema, where):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(where)


def run(spark, made, schema, where, checkpoint, mode, clock=0):
    """Everything that is there, in batches of a file; the rows that come out."""
    out = []
    stream = made(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(where))
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: out.extend(df.collect()))
    query = query.trigger(**({"processingTime": "0 seconds"} if clock else {"availableNow": True})).start()
    try:
        if clock:  # with processing time there is always another batch
            until = time.monotonic() + 90
            while sum(p.numInputRows for p in query.recentProgress) < clock and time.monotonic() < until:
                time.sleep(0.5)
        else:
            assert query.awaitTermination(120)
    finally:
        query.stop()
    return out


def test_lease_runs_out_by_timer(stored, tmp_path):
    where, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    put(stored, [("g", "a", "hold", at(0)), ("g", "b", "hold", at(1)), ("h", "a", "hold", at(2))], stateful.HELD, where)
    put(stored, [("g", "a", "hold", at(8)), ("h", "a", "release", at(9))], stateful.HELD, where)
    put(stored, [("z", "clock", "hold", at(15))], stateful.HELD, where)
    got = {tuple(r) for r in run(stored, lambda s: stateful.lease_events(s, 10_000), stateful.HELD, where, checkpoint, "append")}
    assert ("g", "b", "expired", at(11)) in got and ("g", "a", "expired", at(18)) not in got
    # After a restart the lease that was renewed runs out by its timer, without any row of its own.
    put(stored, [("z", "clock", "hold", at(40))], stateful.HELD, where)
    again = {tuple(r) for r in run(stored, lambda s: stateful.lease_events(s, 10_000), stateful.HELD, where, checkpoint, "append")}
    assert ("g", "a", "expired", at(18)) in again
    log = stored.read.schema(stateful.HELD).parquet(where)
    want = {tuple(r) for r in stateful.lease_log(log, 10_000, F.lit(at(40))).collect()}
    assert got | again == want


def test_queue_survives_a_restart(stored, tmp_path):
    where, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    row = lambda key, revision, payload, s, published=False, skip=False: (key, revision, payload, at(s), published, skip)
    first = [row(1, 1, "a", 0), row(1, 2, "b", 1), row(2, 5, "x", 2), row(3, 1, None, 3), row(3, 2, "skipped", 4, skip=True)]
    put(stored, first, stateful.CHANGE, where)
    got = run(stored, stateful.queued, stateful.CHANGE, where, checkpoint, "update")
    assert {(r.key, r.base, r.local, r.pending, r.status) for r in got} == {(1, 1, 2, 2, "pending"), (2, 4, 5, 1, "pending"), (3, 1, 1, 1, "pending")}
    put(stored, [row(1, 3, "c", 10), row(1, 3, "c", 11), row(2, 5, None, 12, published=True)], stateful.CHANGE, where)
    put(stored, [row(2, 6, "y", 20)], stateful.CHANGE, where)
    got = run(stored, stateful.queued, stateful.CHANGE, where, checkpoint, "update")
    last = {r.key: r for r in got}
    assert (last[1].base, last[1].local, last[1].pending, last[1].queued_at) == (1, 3, 3, at(0))
    assert (last[2].base, last[2].local, last[2].pending, last[2].queued_at) == (5, 6, 1, at(20))


def test_queue_is_the_log_folded(stored, tmp_path):
    r = random.Random(4)
    where, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    rows = [(r.randint(1, 6), i + 1, r.choice(["a", "b", None]), at(i), r.random() < 0.2, r.random() < 0.1) for i in range(120)]
    for k in range(0, 120, 40):
        put(stored, rows[k : k + 40], stateful.CHANGE, where)
    last = {}
    for x in run(stored, lambda s: stateful.queued(s, 3_600_000), stateful.CHANGE, where, checkpoint, "update", clock=120):
        last[x.key] = tuple(x)
    want = {x.key: tuple(x) for x in stateful.queued_log(stored.createDataFrame(rows, stateful.CHANGE)).collect()}
    assert last == want
