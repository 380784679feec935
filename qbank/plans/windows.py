"""Window-shaped operators and orders."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from qbank.functions import geometry
from qbank.operators import matching, ordering, windows
from qbank.plans.registry import query


@query("W1_best_row", "select user_id, event_id from (select *, row_number() over (partition by user_id order by (event_type = 'purchase') desc, value desc, event_id desc) k from events) where k = 1")
def w1(t):  # noqa: ANN001, ANN201
    e = t("events").select("user_id", "event_id", "event_type", "value")
    return windows.best_by(e, ["user_id"], [F.col("event_type") == "purchase", F.col("value"), F.col("event_id")]).select("user_id", "event_id")


@query("W2_keep_last", "select user_id, event_type, max(event_id) event_id from events group by 1, 2")
def w2(t):  # noqa: ANN001, ANN201
    return windows.keep(t("events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], [F.desc("event_id")])


@query("W3_keep_first", "select user_id, event_type, min(event_id) event_id from events group by 1, 2")
def w3(t):  # noqa: ANN001, ANN201
    return windows.keep(t("events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], [F.asc("event_id")])


@query("W4_renumber", "select conv_id, turn, cast(row_number() over (partition by conv_id order by turn) + 9 as integer) n from conversations")
def w4(t):  # noqa: ANN001, ANN201
    return windows.renumber(t("conversations").select("conv_id", "turn"), ["conv_id"], [F.asc("turn")], 10)


@query(
    "W5_running_sequence",
    """with c as (select conv_id, turn, row_number() over (partition by conv_id order by turn) - 1 p, case when turn % 3 = 1 then length(text) % 7 end num from conversations)
select conv_id, turn, cast(p + greatest(1, coalesce(max(num - p) over (partition by conv_id order by turn rows unbounded preceding), 1)) as integer) seq from c""",
)
def w5(t):  # noqa: ANN001, ANN201
    num = F.when(F.col("turn") % 3 == 1, F.length("text") % 7)
    return windows.running_sequence(t("conversations"), ["conv_id"], "turn", num).select("conv_id", "turn", "seq")


@query(
    "W6_two_columns",
    """with c as (select l_orderkey k, l_linenumber n, l_partkey * 1.0 c from lineitem), g as (select *, lead(c) over (partition by k order by c) - c gap from c),
s as (select k, max(gap) widest, max(c) - min(c) span, count(*) boxes from g group by 1), m as (select k, min(c) cut from g join s using (k) where gap = widest group by 1)
select g.k, g.n, case when boxes >= 4 and widest >= greatest(80, span * 0.12) and c > cut then 1 else 0 end column_no from g join s using (k) left join m using (k)""",
)
def w6(t):  # noqa: ANN001, ANN201
    li = t("lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), "l_partkey")
    return windows.columns_of(li, ["k"], F.col("l_partkey").cast("double")).select("k", "n", "column_no")


@query(
    "W7_runs",
    """with a as (select user_id, event_id, event_id - lag(event_id) over (partition by user_id order by event_id) d from events where value > 20),
r as (select *, sum(case when d is null or d > 201 then 1 else 0 end) over (partition by user_id order by event_id rows unbounded preceding) run from a)
select user_id, run, min(event_id) as first, max(event_id) as last, count(*) rows from r group by 1, 2 having max(event_id) - min(event_id) + 1 >= 5""",
)
def w7(t):  # noqa: ANN001, ANN201
    return windows.runs(t("events").select("user_id", "event_id", "value"), ["user_id"], "event_id", F.col("value") > 20, 200, 5)


def boxes(t, where: str = "true"):  # noqa: ANN001, ANN201
    """lineitem as boxes on pages (orders)."""
    x, y = (F.col("l_partkey") % 180).cast("int"), (F.col("l_suppkey") % 80).cast("int")
    w = F.col("l_quantity").cast("int") + 10
    return t("lineitem").where(where).select(
        F.col("l_orderkey").alias("page"), F.col("l_linenumber").cast("bigint").alias("id"), x.alias("x1"), y.alias("y1"), (x + w).alias("x2"), (y + w).alias("y2"),
        F.col("l_discount").alias("conf"),
    )


def placed_boxes(t):  # noqa: ANN001, ANN201
    """The same with each box's place in its page as its id."""
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount")
    numbered = t("lineitem").withColumn("l_linenumber", F.row_number().over(order))
    return boxes(lambda _: numbered)


_BOXES_SQL = """b as (select l_orderkey page, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount) id, cast(l_partkey % 180 as integer) x1, cast(l_suppkey % 80 as integer) y1,
  cast(x1 + floor(l_quantity)::integer + 10 as integer) x2, cast(y1 + floor(l_quantity)::integer + 10 as integer) y2, l_discount conf from lineitem)"""


def _iou_sql(a: str, b: str, least: str) -> str:
    w = f"greatest(least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1), 0)"
    h = f"greatest(least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1), 0)"
    area = lambda x: f"({x}.x2 - {x}.x1) * ({x}.y2 - {x}.y1)"
    return f"({w} * {h})::double / greatest({area(a)} + {area(b)} - {w} * {h}, {least})"


@query(
    "W8_suppression",
    f"""with recursive {_BOXES_SQL},
o as (select *, row_number() over (partition by page order by conf desc, y1, x1, id) k from b),
r as (select page, k, [{{'id': id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] kept from o where k = 1
  union all select o.page, o.k, case when len(list_filter(kept, lambda q: {_iou_sql('q', 'o', '1')} >= 0.2)) = 0 then list_append(kept, {{'id': id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}) else kept end
  from r join o on o.page = r.page and o.k = r.k + 1),
l as (select page, unnest(arg_max(kept, k)).id id from r group by page)
select b.* from b join l using (page, id)""",
)
def w8(t):  # noqa: ANN001, ANN201
    return matching.suppress(placed_boxes(t), "page", 0.2)


def _greedy_sql(moved: str) -> str:
    """Pairs taken one by one, by falling overlap: a recursion over the candidates of a page."""
    return f"""{_BOXES_SQL}, m as ({moved}),
c as (select b.page, b.id l, m.id r, {_iou_sql('b', 'm', '0')} score from b join m on b.page = m.page where {_iou_sql('b', 'm', '0')} >= 0.25),
o as (select *, row_number() over (partition by page order by score desc, l desc, r desc) k from c),
g as (select page, k, [l] ls, [r] rs, [score] ss from o where k = 1
  union all select o.page, o.k, case when f then list_append(ls, l) else ls end, case when f then list_append(rs, r) else rs end, case when f then list_append(ss, score) else ss end
  from (select o.*, ls, rs, ss, not list_contains(ls, o.l) and not list_contains(rs, o.r) f from g join o on o.page = g.page and o.k = g.k + 1) o),
p as (select page, unnest(arg_max(ls, k)) left_id, unnest(arg_max(rs, k)) right_id, unnest(arg_max(ss, k)) score from g group by page)"""


@query("J14_box_match", f"with recursive {_greedy_sql('select page, id, x1 + 3 x1, y1, x2 + 3 x2, y2 from b')} select * from p")
def j14(t):  # noqa: ANN001, ANN201
    b = placed_boxes(t).drop("conf")
    moved = b.withColumns({"x1": F.col("x1") + 3, "x2": F.col("x2") + 3})
    return matching.match_boxes(b, moved, "page")


_CHANGED_SQL = """select page, case when page % 5 = 0 then 8 - id else id end id, x1 + d x1, y1, x2 + d x2, y2 from (select *, case when id = 1 then 9 when page % 7 = 0 then 400 else 0 end d from b) where id <> 2 or page % 3 = 0"""


@query(
    "S35_box_changes",
    f"""with recursive {_greedy_sql(_CHANGED_SQL)},
s as (select p.page, count(*) matched, count(*) filter (where greatest(abs(b.x1 - m.x1), abs(b.y1 - m.y1), abs(b.x2 - m.x2), abs(b.y2 - m.y2)) > 5) moved, count(*) filter (where left_id <> right_id) crossed
  from p join b on b.page = p.page and b.id = left_id join m on m.page = p.page and m.id = right_id group by 1),
x as (select page, list((x1, y1, x2, y2) order by id) o from b group by 1), y as (select page, list((x1, y1, x2, y2) order by id) n from m group by 1),
z as (select page, coalesce(len(o), 0) co, coalesce(len(n), 0) cn, coalesce(matched, 0) matched, coalesce(moved, 0) moved, coalesce(crossed, 0) crossed, coalesce(o <> n and len(o) = len(n), false) differ,
  coalesce(list_sort(o) = list_sort(n), false) same from x full join y using (page) left join s using (page))
select page, cn - matched added, co - matched removed, case when differ and matched = 0 then cn else moved end moved, (differ and (same or crossed > 0))::bigint reordered from z""",
)
def s35(t):  # noqa: ANN001, ANN201
    """Boxes of each page against their later state: one moved, one gone in most pages, other orders, and pages where all are far off."""
    b = placed_boxes(t).drop("conf")
    by = F.when(F.col("id") == 1, 9).when(F.col("page") % 7 == 0, 400).otherwise(0)
    new = b.where("id <> 2 or page % 3 = 0").withColumns({"x1": F.col("x1") + by, "x2": F.col("x2") + by})
    return matching.box_changes(b, new.withColumn("id", F.when(F.col("page") % 5 == 0, 8 - F.col("id")).otherwise(F.col("id"))), "page")


@query("W9_expected_prefix", "select conv_id, cast(case when min(case when turn <> p + f then p end) is null then count(*) else min(case when turn <> p + f then p end) end as integer) n from (select conv_id, turn, row_number() over (partition by conv_id order by turn) - 1 p, 0 f from conversations) group by 1")
def w9(t):  # noqa: ANN001, ANN201
    g = t("conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return g.select("conv_id", windows.expected_prefix(F.col("turns"), F.lit(0)).alias("n"))


@query("W10_unique_codes", "select p_partkey, case when k = 1 then p_brand else p_brand || '-' || k end code from (select p_partkey, p_brand, row_number() over (partition by p_brand order by p_partkey) k from part)")
def w10(t):  # noqa: ANN001, ANN201
    return windows.unique_codes(t("part").select("p_partkey", "p_brand"), "p_brand", "p_partkey").select("p_partkey", "code")


@query("W11_marker_suffix", "select l_orderkey, l_linenumber, case when k = 1 then l_returnflag else l_returnflag || '-' || k end unique_marker from (select *, row_number() over (partition by l_orderkey, lower(l_returnflag) order by l_linenumber) k from lineitem)")
def w11(t):  # noqa: ANN001, ANN201
    li = t("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return windows.suffixed(li, ["l_orderkey"], "l_returnflag", "l_linenumber").select("l_orderkey", "l_linenumber", "unique_marker")


@query(
    "W12_neighbour_merge",
    r"select conv_id, turn, coalesce(b is not null and b <> '' and not regexp_matches(b, '[.!?:)]$') and regexp_matches(trim(text), '^[a-záéíóúüñ,;]'), false) joins_previous from (select *, trim(lag(text) over (partition by conv_id order by turn)) b from conversations)",
)
def w12(t):  # noqa: ANN001, ANN201
    return windows.joins_previous(t("conversations"), ["conv_id"], "turn", "text").select("conv_id", "turn", "joins_previous")


@query("W13_slices", "select doc_id, pos, part from (select doc_id, unnest(string_split(text, '. ')) part, unnest(range(0, len(string_split(text, '. ')))) pos from documents)")
def w13(t):  # noqa: ANN001, ANN201
    """The text between consecutive marks."""
    return t("documents").select("doc_id", F.posexplode(F.split("text", r"\. ", -1)).alias("pos", "part"))


# -- O ---------------------------------------------------------------------------


@query("O1_problem_order", "select doc_id, row_number() over (order by lower(source), lower(lang), n_chars, doc_id) k from documents qualify k <= 100")
def o1(t):  # noqa: ANN001, ANN201

    top = t("documents").orderBy(F.lower("source"), F.lower("lang"), "n_chars", "doc_id").limit(100)
    return top.select("doc_id", F.row_number().over(W.orderBy(F.lower("source"), F.lower("lang"), "n_chars", "doc_id")).alias("k"))


@query("O2_rank_order", "select o_orderkey, row_number() over (order by case o_orderstatus when 'P' then 1 when 'O' then 2 when 'F' then 3 else 9 end, lower(o_orderpriority), o_orderkey) k from orders")
def o2(t):  # noqa: ANN001, ANN201
    order = [ordering.ranked(F.col("o_orderstatus"), {"P": 1, "O": 2, "F": 3}), F.lower("o_orderpriority"), F.col("o_orderkey")]
    return ordering.running(t("orders"), order, "k").select("o_orderkey", "k")


@query("O3_natural_sort", "select source, row_number() over (order by cast(substr(source, 4) as integer)) k from (select distinct source from documents)")
def o3(t):  # noqa: ANN001, ANN201

    s = t("documents").select("source").distinct()
    return s.select("source", F.row_number().over(W.orderBy(ordering.natural_key(F.col("source")))).alias("k"))


@query("O4_missing_last", "select event_id, row_number() over (order by case when user_id % 3 = 0 then 1000000000 else user_id end, event_id) k from events")
def o4(t):  # noqa: ANN001, ANN201
    p = F.when(F.col("user_id") % 3 != 0, F.col("user_id"))
    return ordering.running(t("events").select("event_id", "user_id"), [ordering.place(p), F.col("event_id")], "k").select("event_id", "k")


@query(
    "O5_reading_order",
    "select page, list(id order by y1, x1, y2, x2, id) ids from (select l_orderkey page, l_linenumber id, cast(l_partkey % 180 as integer) x1, cast(l_suppkey % 80 as integer) y1, x1 + cast(floor(l_quantity) as integer) + 10 x2, y1 + cast(floor(l_quantity) as integer) + 10 y2 from lineitem) group by 1",
)
def o5(t):  # noqa: ANN001, ANN201
    box = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    b = boxes(t).groupBy("page").agg(F.sort_array(F.collect_list(F.struct(geometry.reading_key(box).alias("r"), "id"))).alias("s"))
    return b.select("page", F.transform("s", lambda x: x["id"]).alias("ids"))


@query("O6_seeded_sample", "select doc_id from documents order by md5('7:' || coalesce(doc_id::varchar, '')), coalesce(doc_id::varchar, '') limit 25")
def o6(t):  # noqa: ANN001, ANN201
    return ordering.sample(t("documents").select("doc_id"), 25, "doc_id", 7)


@query("O6_grown_sample", "select event_id from events order by md5('7:' || event_id), event_id::varchar limit 400")
def o6_grown(t):  # noqa: ANN001, ANN201
    """A sample of the events before a time, grown by those since: that of all events."""
    e = t("events").select("event_id", "event_type")
    old = ordering.sample(e.where("event_type <> 'error'").select("event_id"), 400, "event_id", 7)
    return ordering.grown_sample(old, e.where("event_type = 'error' or event_type is null").select("event_id"), 400, ["event_id"], 7)


@query(
    "O7_vector_topk",
    "select vec_id, round(sqrt(list_sum(list_transform(list_zip(e, range(1, 65)), lambda z: power(z[1] - (z[2] - 32) / 320.0, 2)))), 6) distance from (select vec_id, cast(embedding as double[]) e from embeddings where label < 8) order by 2, 1 limit 10",
)
def o7(t):  # noqa: ANN001, ANN201
    query_vector = [(i - 32) / 320.0 for i in range(1, 65)]
    top = ordering.nearest(t("embeddings").where("label < 8").select("vec_id", "embedding"), "embedding", query_vector, 10, "vec_id")
    return top.select("vec_id", F.round("distance", 6).alias("distance"))


@query("O8_candidate_argmax", "select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by (o_orderstatus = 'O') desc, o_orderpriority desc, o_totalprice desc, o_orderkey desc) k from orders) where k = 1")
def o8(t):  # noqa: ANN001, ANN201
    o = t("orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    return windows.best_by(o, ["o_custkey"], [F.col("o_orderstatus") == "O", F.col("o_orderpriority"), F.col("o_totalprice"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("O9_null_order", "select event_id, row_number() over (order by v desc nulls last, event_id) k from (select event_id, case when user_id % 2 = 0 then value end v from events)")
def o9(t):  # noqa: ANN001, ANN201
    e = t("events").select("event_id", F.when(F.col("user_id") % 2 == 0, F.col("value")).alias("v"))
    return ordering.running(e, [F.col("v").isNull(), -F.col("v"), F.col("event_id")], "k").select("event_id", "k")


@query("O10_golden_order", "select doc_id, row_number() over (order by n_chars > 0 desc, quality is not null desc, coalesce(nullif(source, ''), '~'), lang, doc_id) k from documents left join labels using (doc_id)")
def o10(t):  # noqa: ANN001, ANN201
    d = t("documents").select("doc_id", "n_chars", "source", "lang").join(t("labels").select("doc_id", "quality"), "doc_id", "left")
    order = [~(F.col("n_chars") > 0), F.col("quality").isNull(), F.coalesce(F.nullif("source", F.lit("")), F.lit("~")), F.col("lang"), F.col("doc_id")]
    return ordering.running(d, order, "k").select("doc_id", "k")


@query("O11_capped", "select doc_id, lang from (select doc_id, lang from documents order by doc_id limit 120) order by lang, doc_id")
def o11(t):  # noqa: ANN001, ANN201
    return t("documents").select("doc_id", "lang").orderBy("doc_id").limit(120).orderBy("lang", "doc_id")


@query("O12_worst", "select l_orderkey, l_linenumber from lineitem order by l_discount desc, l_orderkey, l_linenumber, l_partkey limit 10")
def o12(t):  # noqa: ANN001, ANN201
    return t("lineitem").orderBy(F.desc("l_discount"), "l_orderkey", "l_linenumber", "l_partkey").select("l_orderkey", "l_linenumber").limit(10)


@query(
    "O13_page_window",
    "select doc_id, source, n - count(*) over (partition by source) hidden from (select doc_id, source, row_number() over (partition by source order by doc_id) a, row_number() over (partition by source order by doc_id desc) b, count(*) over (partition by source) n from documents) where a <= 5 or b <= 5 or abs(doc_id - 500) <= 12",
)
def o13(t):  # noqa: ANN001, ANN201
    return ordering.page_window(t("documents").select("doc_id", "source"), ["source"], "doc_id", 500, 5, 12)
