"""ST1-ST8 over the events table as a change log."""

from __future__ import annotations

from pyspark.sql import functions as F

from qbank.plans.registry import query
from qbank.streaming import changes, stateful


@query("ST1_captured", "select event_id from (select *, lag(event_type) over w b, row_number() over w k from events window w as (partition by user_id order by event_id)) where (k = 1 or b is distinct from event_type) and value >= 5")
def st1(t):  # noqa: ANN001, ANN201
    return changes.captured(t("events"), "user_id", "event_id", ["event_type"], F.col("value") < 5).select("event_id")


@query(
    "ST2_coalesced",
    """with e as (select *, event_type = 'purchase' p, coalesce(sum(cast(event_type = 'purchase' as integer)) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), 0) era from events),
l as (select *, max(era) over (partition by user_id) last from e)
select user_id, min(event_id) base, max(event_id) local, count(*) pending from l where era = last and not p group by 1""",
)
def st2(t):  # noqa: ANN001, ANN201
    return changes.coalesced(t("events"), "user_id", "event_id", F.col("event_type") == "purchase")


@query(
    "ST3_publish",
    "select a.event_id, case when b.event_id is null then 'insert' when b.user_id <> a.user_id then 'conflict' when a.event_type is not distinct from b.event_type then 'published' else 'update' end action from events a left join events b on b.event_id = a.event_id + 1",
)
def st3(t):  # noqa: ANN001, ANN201
    e = t("events").select("event_id", "user_id", "event_type")
    b = e.select((F.col("event_id") - 1).alias("event_id"), F.col("user_id").alias("sr"), F.col("event_type").alias("sp"))
    return e.join(b, "event_id", "left").select("event_id", changes.publish_action(F.col("sr"), F.col("user_id"), F.col("event_type"), F.col("sp")).alias("action"))


@query("ST4_publish_order", "select event_id, try_cast(json_extract_string(props, '$.k') as bigint) k from events order by ts, event_id limit 50")
def st4(t):  # noqa: ANN001, ANN201
    """Oldest first, the limit after sorting; a bad row yields null, not a failure."""
    top = t("events").orderBy("ts", "event_id").limit(50)
    return top.select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


@query("ST5_pending_list", "select event_id from events where event_type in ('view', 'error', 'click') order by ts desc, event_id desc")
def st5(t):  # noqa: ANN001, ANN201
    return t("events").where(F.col("event_type").isin("view", "error", "click")).orderBy(F.desc("ts"), F.desc("event_id")).select("event_id")


@query("ST6_cursor", "select event_id from (select event_id from events order by event_id desc limit 200) where event_id > (select max(event_id) - 120 from events)")
def st6(t):  # noqa: ANN001, ANN201
    e = t("events").select("event_id")
    top = e.agg((F.max("event_id") - 120).alias("cursor"))
    feed = changes.since(e, -1, 200, "event_id")
    return feed.join(F.broadcast(top), F.col("event_id") > F.col("cursor")).select("event_id")


@query("ST7_leases", "select event_id from events where ts >= (select max(ts) from events) - interval 3600 second")
def st7(t):  # noqa: ANN001, ANN201
    e = t("events")
    now = F.broadcast(e.agg(F.max("ts").alias("now")))
    return changes.alive(e.join(now, F.lit(True)), F.col("now"), 3600).select("event_id")


@query("ST8_invalidated", "select o_orderkey, case when o_orderkey % 3 <> 0 then o_orderstatus end o_orderstatus, o_orderkey % 3 = 0 stale from orders")
def st8(t):  # noqa: ANN001, ANN201
    o = t("orders").select("o_orderkey", "o_orderstatus")
    now = F.sha1(F.col("o_orderkey").cast("string"))
    stored = F.when(F.col("o_orderkey") % 3 == 0, F.lit("other")).otherwise(now)
    return changes.invalidated(o, now, stored, ["o_orderstatus"])


@query(
    "ST2_queue_log",
    """with e as (select user_id k, event_id rev, event_type p, ts, event_type = 'purchase' pub, value < 5 skip from events),
r as (select *, lag(p) over w pb, lag(rev) over w rb, row_number() over w i from e where not coalesce(pub, false) and not coalesce(skip, false) window w as (partition by k order by ts, rev)),
c as (select k, greatest(rev, 1) rev, p, ts, i, pb from r where i = 1 or p is distinct from pb),
d as (select *, coalesce(lag(rev) over (partition by k order by ts, rev), greatest(rev - 1, 1)) base from c),
m as (select k, rev, ts, true mark, null::varchar p, null::bigint base from e where pub union all select k, rev, ts, false, p, base from d),
a as (select *, count(*) filter (where mark) over (partition by k order by ts, rev rows between unbounded preceding and current row) era from m),
g as (select k, era, arg_min(base, (ts, rev)) base, arg_max(rev, (ts, rev)) as "local", arg_max(p, (ts, rev)) payload, min(ts) queued_at, max(ts) changed_at, count(*) pending from a where not mark group by all),
l as (select *, row_number() over (partition by k order by era desc) i from g), n as (select k, max(era) era_now from a group by 1)
select k as "key", base, "local", payload, epoch_us(queued_at) queued_at, epoch_us(changed_at) changed_at, case when era = era_now then pending else 0 end pending,
  case when era = era_now then 'pending' else 'published' end status from l join n using (k) where i = 1""",
)
def st2_queue(t):  # noqa: ANN001, ANN201
    """The change queue at the end of the log: what the stream of the same changes holds."""
    e = t("events")
    changes_of = e.select(F.col("user_id").alias("key"), F.col("event_id").alias("revision"), F.col("event_type").alias("payload"), "ts", (F.col("event_type") == "purchase").alias("published"), (F.col("value") < 5).alias("skip"))
    return stateful.queued_log(changes_of).withColumns({c: F.unix_micros(F.col(c).cast("timestamp")) for c in ("queued_at", "changed_at")})


_LEASE_SECONDS = 7200


@query(
    "ST7_lease_log",
    f"""with e as (select 'u' || user_id gate, event_type lease, case when value < 20 then 'release' else 'hold' end kind, ts, max(ts) over () now from events),
r as (select *, lag(kind) over w pk, lag(ts) over w pt, lead(ts) over w nt from e window w as (partition by gate, lease order by ts, kind desc)),
h as (select *, coalesce(pk = 'hold' and ts - pt <= interval {_LEASE_SECONDS} second, false) held from r)
select gate, lease, case when kind = 'hold' then case when held then 'renewed' else 'acquired' end else 'released' end as "event", epoch_us(ts) as "at" from h where kind = 'hold' or held
union all select gate, lease, 'expired', epoch_us(ts + interval {_LEASE_SECONDS} second) from h where kind = 'hold' and coalesce(nt, now) - ts > interval {_LEASE_SECONDS} second""",
)
def st7_log(t):  # noqa: ANN001, ANN201
    """Every lease's history, with those that run out: what the stream's timers tell."""
    e = t("events")
    held = e.select(F.concat(F.lit("u"), "user_id").alias("gate"), F.col("event_type").alias("lease"), F.when(F.col("value") < 20, "release").otherwise("hold").alias("kind"), "ts")
    held = held.join(F.broadcast(e.agg(F.max("ts").alias("now"))), F.lit(True))
    return stateful.lease_log(held, 1000 * _LEASE_SECONDS, F.col("now")).withColumn("at", F.unix_micros(F.col("at").cast("timestamp")))
