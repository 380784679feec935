"""Roll-ups, counts, scores and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from qbank.functions import classify, similarity, status, text
from qbank.operators import reports
from qbank.plans.sections import classify_sql, sections
from qbank.plans.filters import verdicts
from qbank.plans.registry import query


@query(
    "A1_count_by_source",
    "select source, n from (select coalesce(case when source = 'src3' then '' else source end, '') source, count(*) n from documents group by 1 order by n desc, source limit 10) where source <> ''",
)
def a1(t):  # noqa: ANN001, ANN201
    """Top counts, the blank name dropped after the limit."""
    s = F.coalesce(F.when(F.col("source") == "src3", "").otherwise(F.col("source")), F.lit(""))
    top = t("documents").groupBy(s.alias("source")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(10)
    return top.where("source <> ''")


@query("A2_filtered_count", "select count(*) n from documents where lang = 'es' and n_chars > 500")
def a2(t):  # noqa: ANN001, ANN201
    return t("documents").where("lang = 'es' and n_chars > 500").agg(F.count("*").alias("n"))


@query(
    "A3_conditional_counts",
    "select source, count(*) total, count(*) filter (where quality = 1) good, count(*) filter (where quality = 0) bad, count(*) filter (where quality is null) unreviewed from documents left join labels using (doc_id) group by 1",
)
def a3(t):  # noqa: ANN001, ANN201
    v = F.col("verdict")
    return verdicts(t).groupBy("source").agg(
        F.count("*").alias("total"), F.count_if(v == status.GOOD).alias("good"), F.count_if(v == status.BAD).alias("bad"), F.count_if(v.isNull()).alias("unreviewed")
    )


@query(
    "A4_instance_rollup",
    """select o_custkey, count(*) n, sum(greatest(coalesce(o_orderkey % 7 - 2, 0), 0)) expected, coalesce(string_agg(distinct o_orderpriority, ', ' order by o_orderpriority), '-') kinds,
 count(*) filter (where o_orderstatus = 'O') open, count(*) filter (where o_totalprice > 200000) large from orders group by 1""",
)
def a4(t):  # noqa: ANN001, ANN201
    kinds = F.array_join(F.sort_array(F.collect_set("o_orderpriority")), ", ")
    return t("orders").groupBy("o_custkey").agg(
        F.count("*").alias("n"), F.sum(F.greatest(F.coalesce(F.col("o_orderkey") % 7 - 2, F.lit(0)), F.lit(0))).alias("expected"),
        F.coalesce(F.nullif(kinds, F.lit("")), F.lit("-")).alias("kinds"), F.count_if(F.col("o_orderstatus") == "O").alias("open"),
        F.count_if(F.col("o_totalprice") > 200000).alias("large"),
    )


@query(
    "A5_health",
    """with i as (select s.source, s.lang, count(d.doc_id) total, count(*) filter (where d.doc_id is not null and l.quality is null) unreviewed,
   count(*) filter (where l.quality = 0) bad, count(*) filter (where l.quality = 1) good
 from (select distinct a.source, b.lang from documents a, (select distinct lang from documents) b) s
 left join documents d on d.source = s.source and d.lang = s.lang left join labels l on l.doc_id = d.doc_id group by 1, 2)
select source, lang, total, unreviewed, bad, good, case when total = 0 then 'empty' when unreviewed > 0 then 'in_progress'
  when bad > 0 then 'complete_with_inconsistencies' else 'complete' end status from i""",
)
def a5(t):  # noqa: ANN001, ANN201
    """Instances without problems count none as unreviewed (B2)."""
    v = verdicts(t).groupBy("source", "lang").agg(
        F.count("*").alias("total"), F.count_if(F.col("verdict").isNull()).alias("unreviewed"),
        F.count_if(F.col("verdict") == status.BAD).alias("bad"), F.count_if(F.col("verdict") == status.GOOD).alias("good"),
    )
    langs = t("documents").select("lang").distinct().agg(F.collect_set("lang").alias("langs"))
    every = t("documents").select("source").distinct().join(F.broadcast(langs), F.lit(True)).select("source", F.explode("langs").alias("lang"))
    n = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = every.join(v, ["source", "lang"], "left").select("source", "lang", n("total"), n("unreviewed"), n("bad"), n("good"))
    state = F.when(F.col("total") == 0, "empty").when(F.col("unreviewed") > 0, "in_progress").when(F.col("bad") > 0, "complete_with_inconsistencies").otherwise("complete")
    return out.withColumn("status", state)


@query(
    "A6_dashboard",
    """select o_custkey, sum(expected) expected, sum(scanned) scanned, greatest(sum(expected) - sum(scanned), 0) missing,
 round(case when sum(expected) <= 0 then 0 else sum(scanned) / sum(expected) end, 6) ratio
from (select o_custkey, o_orderkey % 9 expected, coalesce(n, 0) scanned from orders left join (select l_orderkey, count(*) n from lineitem group by 1) on l_orderkey = o_orderkey) group by 1""",
)
def a6(t):  # noqa: ANN001, ANN201
    lines = t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    o = t("orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_custkey", (F.col("o_orderkey") % 9).alias("e"), F.coalesce("n", F.lit(0)).alias("s"))
    g = o.groupBy("o_custkey").agg(F.sum("e").alias("expected"), F.sum("s").alias("scanned"))
    ratio = F.when(F.col("expected") <= 0, 0.0).otherwise(F.try_divide("scanned", "expected"))
    return g.withColumns({"missing": F.greatest(F.col("expected") - F.col("scanned"), F.lit(0)), "ratio": F.round(ratio, 6)})


_SOLUTIONS = ('{"1": [["p"]], "2": [], "x": ["q"], "3": {"images": ["r"]}}', None, '{"2": "s", "0": ["n"], "-1": ["m"]}', '{"4": [["a"], []], "5": [[], " "], "6": 7}', "broken")
_SOLVED_SQL = "(c % 5 = 0 and turn in (1, 3)) or (c % 5 = 2 and turn = 2) or (c % 5 = 3 and turn in (4, 6))"


@query(
    "A7_session_stats",
    f"""with i as (select conv_id, conv_id c, turn, coalesce(turn % 3 = 0, false) as keyed, coalesce(turn % 4 = 1, false) or coalesce({_SOLVED_SQL}, false) as solved from conversations)
select conv_id, count(*) items, count(*) filter (where keyed) with_key, count(*) filter (where solved) with_solution, count(distinct turn) filter (where turn > 0) numbers,
  count(*) filter (where not keyed) without_key, count(*) filter (where not solved) without_solution from i group by 1""",
)
def a7(t):  # noqa: ANN001, ANN201
    """Conversations as sessions: keys by tag, solutions by tag or by the session's map of numbers."""
    n = F.col("turn")
    tags = F.concat(F.when(n % 3 == 0, "[[ Clave = A ]] ").otherwise("[[clave=]] "), F.when(n % 4 == 1, "[[solucionario=s]]").otherwise("[[soluciones=s]]"))
    items = t("conversations").select("conv_id", "turn", F.concat(tags, F.coalesce("text", F.lit(""))).alias("item"))
    held = F.lit(None).cast("string")
    for k, x in enumerate(_SOLUTIONS):
        held = F.when(F.col("conv_id") % len(_SOLUTIONS) == k, F.lit(x)).otherwise(held)
    solved = reports.numbered_solutions(items.select("conv_id").distinct().select("conv_id", held.alias("held")), "conv_id", "held")
    return reports.session_stats(items, solved, "conv_id", "turn", "item")


@query(
    "A8_staging_summary",
    """select count(*) total, count(*) filter (where event_type = 'purchase') ready, 0 human_reviewed, count(*) filter (where event_type <> 'purchase' and value > 50) needs_review,
 count(*) filter (where event_type = 'error') errors from events""",
)
def a8(t):  # noqa: ANN001, ANN201
    """Ready before review; errors counted on their own; the human column stays 0."""
    ready = F.col("event_type") == "purchase"
    return t("events").agg(
        F.count("*").alias("total"), F.count_if(ready).alias("ready"), F.lit(0).alias("human_reviewed"),
        F.count_if(~ready & (F.col("value") > 50)).alias("needs_review"), F.count_if(F.col("event_type") == "error").alias("errors"),
    )


@query("A9_manifest", "select user_id, count(*) filter (where event_type = 'view') as view, count(*) filter (where event_type = 'click') as click, count(*) filter (where event_type = 'error') as error from events group by 1")
def a9(t):  # noqa: ANN001, ANN201
    return t("events").groupBy("user_id").pivot("event_type", ["view", "click", "error"]).agg(F.count(F.lit(1))).na.fill(0, ["view", "click", "error"])


@query(
    "A10_status_reduction",
    """select user_id, case when e > 0 then 'error' when p > 0 then 'processing' when r > 0 then 'needs_review' when d = n then 'ready' else 'pending' end status from (
 select user_id, count(*) n, count(*) filter (where event_type = 'error') e, count(*) filter (where event_type = 'click') p, count(*) filter (where event_type = 'signup') r, count(*) filter (where event_type = 'purchase') d from events group by 1)""",
)
def a10(t):  # noqa: ANN001, ANN201
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    return t("events").groupBy("user_id").agg(status.reduced_status(F.count("*"), n("error"), n("click"), n("signup"), n("purchase")).alias("status"))


@query("A11_record_status", "select o_orderkey, case when o_orderstatus = 'F' then 'error' when o_orderpriority like '1%' then 'ready' else 'pending' end status from orders")
def a11(t):  # noqa: ANN001, ANN201
    """A record's status from a map of its steps."""
    steps = F.create_map(F.lit("ocr"), F.when(F.col("o_orderstatus") == "F", "error").otherwise("ready"), F.lit("review"), F.when(F.col("o_orderpriority").startswith("1"), "ready").otherwise("pending"))
    values = F.map_values(steps)
    out = F.when(F.exists(values, lambda x: x == "error"), "error").when(F.forall(values, lambda x: x == "ready"), "ready").otherwise("pending")
    return t("orders").select("o_orderkey", out.alias("status"))


@query(
    "A12_stage_overview",
    "select * from (select 'pages' stage, (select count(*) from pages) n union all select 'boxes', (select count(*) from documents) union all select 'reviewed', (select count(*) from labels) union all select 'ocr', (select count(*) from conversations))",
)
def a12(t):  # noqa: ANN001, ANN201
    one = lambda name, table: t(table).agg(F.count("*").alias("n")).select(F.lit(name).alias("stage"), "n")
    return one("pages", "pages").unionByName(one("boxes", "documents")).unionByName(one("reviewed", "labels")).unionByName(one("ocr", "conversations"))


@query(
    "A13_timeline_stage",
    "select source, case when count(*) filter (where quality = 1) > 30 then 'db' when count(*) filter (where quality = 0) > 2 then 'review' when count(*) > 0 then 'ocr' else 'none' end stage from documents left join labels using (doc_id) group by 1",
)
def a13(t):  # noqa: ANN001, ANN201
    good, bad = F.count_if(F.col("verdict") == status.GOOD), F.count_if(F.col("verdict") == status.BAD)
    g = verdicts(t).groupBy("source").agg(good.alias("g"), bad.alias("b"), F.count("*").alias("n"))
    return g.select("source", status.first_stage(("db", F.col("g") - 30), ("review", F.col("b") - 2), ("ocr", F.col("n"))).alias("stage"))


@query("A14_counter_trio", "select source, null lang, count(*) n from documents group by 1 union all select null, lang, count(*) from documents group by 2")
def a14(t):  # noqa: ANN001, ANN201
    return t("documents").groupingSets([["source"], ["lang"]], "source", "lang").agg(F.count("*").alias("n")).select("source", "lang", "n")


SPLIT = "case when s < 80 then 'train' when s < 90 then 'validation' else 'test' end"
PERCENT = "cast(('0x' || substr(sha1(cast(doc_id as varchar)), 1, 8)) as bigint) % 100"


@query("A15_split_stats", f"select {SPLIT} split, count(*) images, sum(n_chars) boxes from (select *, {PERCENT} s from documents) group by 1")
def a15(t):  # noqa: ANN001, ANN201
    return t("documents").groupBy(text.split_of(F.col("doc_id").cast("string")).alias("split")).agg(F.count("*").alias("images"), F.sum("n_chars").alias("boxes"))


@query("A16_feedback_counts", "select count(*) filter (where quality = 1) positive, count(*) filter (where quality = 0) negative, greatest(0, 500 - count(*) filter (where toxic = 1)) remaining_to_target from labels")
def a16(t):  # noqa: ANN001, ANN201
    return t("labels").agg(
        F.count_if(F.col("quality") == 1).alias("positive"), F.count_if(F.col("quality") == 0).alias("negative"),
        F.greatest(F.lit(0), 500 - F.count_if(F.col("toxic") == 1)).alias("remaining_to_target"),
    )


@query("A17_distinct_books", "select count(*) segments, count(distinct source) books from documents")
def a17(t):  # noqa: ANN001, ANN201
    return t("documents").agg(F.count("*").alias("segments"), F.countDistinct("source").alias("books"))


@query(
    "A18_ocr_evaluation",
    """with p as (select o_orderkey, o_orderpriority target, case when o_orderkey % 3 = 0 then o_orderpriority else replace(o_orderpriority, 'E', 'X') end got from orders)
select count(*) samples, round(avg(case when target = got then 1.0 else 0 end), 6) exact_rate, round(avg(levenshtein(target, got) / greatest(length(target), 1)), 6) mean_cer, round(avg(length(got)), 6) mean_length from p""",
)
def a18(t):  # noqa: ANN001, ANN201
    got = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).otherwise(F.replace("o_orderpriority", F.lit("E"), F.lit("X")))
    p = t("orders").select(F.col("o_orderpriority").alias("target"), got.alias("got"))
    return p.agg(
        F.count("*").alias("samples"), F.round(F.avg((F.col("target") == F.col("got")).cast("double")), 6).alias("exact_rate"),
        F.round(F.avg(similarity.character_error_rate(F.col("target"), F.col("got"))), 6).alias("mean_cer"), F.round(F.avg(F.length("got")), 6).alias("mean_length"),
    )


@query("A20_pass_ratio", "select round(coalesce(avg(case when n_chars > 300 then 1.0 else 0 end), 0), 6) ratio from documents where lang = 'de'")
def a20(t):  # noqa: ANN001, ANN201
    return t("documents").where("lang = 'de'").agg(F.round(F.coalesce(F.avg((F.col("n_chars") > 300).cast("double")), F.lit(0.0)), 6).alias("ratio"))


@query(
    "A21_audit_scores",
    """with g as (select conv_id, count(*) items, count(*) filter (where role = 'system') si, count(*) filter (where length(text) < 20) ms, count(*) filter (where role = 'user') sb, count(*) filter (where role = 'assistant') mf,
  count(*) filter (where turn % 2 = 0) bc, count(*) filter (where length(text) > 200) br, count(*) filter (where length(text) > 50) pr, count(*) filter (where length(text) between 20 and 50) pm,
  count(*) filter (where contains(text, '.')) st from conversations group by 1),
s as (select conv_id, greatest(0, least(100, 100 - case when si = 0 then 45 else 0 end - least(35, ms * 12) - case when sb = 0 and mf = 0 then 35 else 0 end - case when bc = 0 then 20 else 0 end - least(25, br * 5))) a,
  greatest(0, least(100, 100 - case when items = 0 then 45 else 0 end - case when pr = 0 then 35 when pr < greatest(3, items // 3) then 15 else 0 end - least(35, pm * 12) - case when items > 0 and st = 0 then 15 else 0 end)) b from g)
select conv_id, cast(a as bigint) segmentation, cast(b as bigint) ocr, cast(round_even((a + b) / 2.0, 0) as bigint) score,
  case when round_even((a + b) / 2.0, 0) >= 80 then 'listo' when round_even((a + b) / 2.0, 0) >= 55 then 'revisar' else 'bloqueado' end status from s""",
)
def a21(t):  # noqa: ANN001, ANN201
    """Conversations as sessions: turns by role and length stand for images, boxes, bindings and pairs."""
    n = F.length("text")
    g = t("conversations").groupBy("conv_id").agg(
        F.count("*").alias("items"), F.count_if(F.col("role") == "system").alias("source_images"), F.count_if(n < 20).alias("missing_source_images"),
        F.count_if(F.col("role") == "user").alias("segment_boxes"), F.count_if(F.col("role") == "assistant").alias("manifest_segments"), F.count_if(F.col("turn") % 2 == 0).alias("bindings_confirmed"),
        F.count_if(n > 200).alias("bindings_review"), F.count_if(n > 50).alias("pairs_ready"), F.count_if(n.between(20, 50)).alias("pairs_missing_image"),
        F.count("*").alias("raw_blocks"), F.count_if(F.contains("text", F.lit("."))).alias("structured_blocks"),
    )
    s = classify.audit_scores({c: F.col(c) for c in g.columns if c != "conv_id"})
    return g.select("conv_id", s.alias("s")).select("conv_id", *(F.col(f"s.{c}").cast("bigint").alias(c) for c in ("segmentation", "ocr", "score")), "s.status")


@query(
    "A22_number_summary",
    "select g, min(n) least, max(n) largest, coalesce(list_sort(list(n) filter (where c > 1)), []) duplicates from (select l_suppkey g, l_linenumber n, count(*) c from lineitem group by 1, 2) group by 1",
)
def a22(t):  # noqa: ANN001, ANN201
    c = t("lineitem").groupBy(F.col("l_suppkey").alias("g"), F.col("l_linenumber").alias("n")).agg(F.count("*").alias("c"))
    dup = F.sort_array(F.collect_list(F.when(F.col("c") > 1, F.col("n"))))
    return c.groupBy("g").agg(F.min("n").alias("least"), F.max("n").alias("largest"), dup.alias("duplicates"))


@query(
    "A23_error_report",
    """with m as (select event_id, user_id, event_type, event_type || case event_id % 3 when 0 then ': at ' || user_id when 1 then ' ' || user_id else ':[k] ' || user_id end message,
  case event_id % 3 when 0 then event_type when 1 then event_type || ' #' else event_type || ':[k]' end k from events),
c as (select k, count(*) n, count(distinct event_type) scopes, count(distinct user_id) records from m group by 1),
f as (select k, message, min(event_id) seen from m group by 1, 2), r as (select *, row_number() over (partition by k order by seen, message) i from f)
select c.*, list(message order by i) examples from c join r using (k) where i <= 3 group by all""",
)
def a23(t):  # noqa: ANN001, ANN201
    """Three forms of message for each event; the first three different ones of each key by rank."""
    k, u = F.col("event_id") % 3, F.col("user_id").cast("string")
    message = F.concat("event_type", F.when(k == 0, ": at ").when(k == 1, " ").otherwise(":[k] "), u)
    return reports.error_report(t("events").withColumn("message", message), "user_id", "event_type", "message", "event_id")


@query("A24_library_totals", "select o_orderstatus status, count(*) n, round(sum(o_totalprice), 2) total from orders group by 1")
def a24(t):  # noqa: ANN001, ANN201
    return t("orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("A25_counts_by_instance", "select lang, source, count(*) n from documents group by 1, 2")
def a25(t):  # noqa: ANN001, ANN201
    return t("documents").groupBy("lang", "source").agg(F.count("*").alias("n"))


@query("A26_consensus", "select conv_id, turn, count(*) over (partition by conv_id, role) agree from conversations")
def a26(t):  # noqa: ANN001, ANN201
    from pyspark.sql import Window as W

    return t("conversations").select("conv_id", "turn", F.count("*").over(W.partitionBy("conv_id", "role")).alias("agree"))


@query("A27_sync_summary", "select case when quality is null then 'insert' when quality = 0 then 'update' else 'skip' end action, count(*) n from documents left join labels using (doc_id) group by 1")
def a27(t):  # noqa: ANN001, ANN201
    action = F.when(F.col("quality").isNull(), "insert").when(F.col("quality") == 0, "update").otherwise("skip")
    return t("documents").join(t("labels"), "doc_id", "left").groupBy(action.alias("action")).agg(F.count("*").alias("n"))


@query("A28_api_comparison", "select user_id % 3 as provider, count(*) calls, count(*) filter (where event_type <> 'error') ok, count(*) filter (where event_type = 'error') failed from events group by 1")
def a28(t):  # noqa: ANN001, ANN201
    """Events as calls of three providers; one that ended in an error failed."""
    e = t("events").select((F.col("user_id") % 3).alias("provider"), F.when(F.col("event_type") == "error", F.col("props")).alias("error"))
    return e.groupBy("provider").agg(F.count("*").alias("calls"), F.count_if(F.col("error").isNull()).alias("ok"), F.count_if(F.col("error").isNotNull()).alias("failed"))


@query(
    "A29_section_counts",
    f"select section, count(*) n, count(*) filter (where section <> case p_partkey % 3 when 0 then 'Geometria' else 'General' end or confidence <> 'alta') changed from ({classify_sql()}) group by 1",
)
def a29(t):  # noqa: ANN001, ANN201
    """Sections of S28 counted, and the rows whose stored section or confidence differs."""
    stored = F.struct(F.when(F.col("p_partkey") % 3 == 0, "Geometria").otherwise("General").alias("section"), F.lit("alta").alias("confidence"))
    d = sections(t("part")).withColumn("changed", (F.col("s.section") != stored["section"]) | (F.col("s.confidence") != stored["confidence"]))
    return d.groupBy(F.col("s.section").alias("section")).agg(F.count("*").alias("n"), F.count_if("changed").alias("changed"))


@query("A30_training_pairs", "select count(*) total, count(*) filter (where n_chars > 100 and source <> 'src1') ready, count(*) filter (where n_chars > 100 and source = 'src1') text_without_image from documents")
def a30(t):  # noqa: ANN001, ANN201
    has_text, image = F.col("n_chars") > 100, F.get(F.filter(F.array(F.when(F.col("source") != "src1", F.col("source"))), lambda x: x.isNotNull()), F.lit(0))
    return t("documents").agg(F.count("*").alias("total"), F.count_if(has_text & image.isNotNull()).alias("ready"), F.count_if(has_text & image.isNull()).alias("text_without_image"))


@query(
    "A31_bank_readiness",
    "select lang, count(*) n, greatest(0, 150 - count(*)) remaining, coalesce(case when lang = 'en' then 'old' end, case when count(*) >= 150 then 'now' end) reached from documents group by 1",
)
def a31(t):  # noqa: ANN001, ANN201
    """The first time the threshold was reached stays (an earlier manifest wins)."""
    g = t("documents").groupBy("lang").agg(F.count("*").alias("n"))
    old = t("documents").where("lang = 'en'").select("lang", F.lit("old").alias("before")).distinct()
    out = g.join(old, "lang", "left")
    return out.select("lang", "n", F.greatest(F.lit(0), 150 - F.col("n")).alias("remaining"), F.coalesce("before", F.when(F.col("n") >= 150, "now")).alias("reached"))


@query("A32_page_totals", "select count(*) pages, count(*) filter (where page_id % 2 = 0) reviewed, sum(len(regexp_extract_all(html, '<p>'))) boxes from pages")
def a32(t):  # noqa: ANN001, ANN201
    return t("pages").agg(F.count("*").alias("pages"), F.count_if(F.col("page_id") % 2 == 0).alias("reviewed"), F.sum(F.regexp_count("html", F.lit("<p>"))).alias("boxes"))
