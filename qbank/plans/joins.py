"""Joins, and U1-U21: set operations, upserts, merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from qbank.functions import text
from qbank.operators import fuzzy, joins, merges, ordering
from qbank.operators.windows import keep
from qbank.plans.registry import query


@query("J1_catalogs", "select c_custkey, n_name, r_name from customer left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey")
def j1(t):  # noqa: ANN001, ANN201
    n, r = joins.catalog(t("nation")), joins.catalog(t("region"))
    out = t("customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return out.select("c_custkey", "n_name", "r_name")


@query(
    "J2_id_else_code",
    """with o as (select o_orderkey, case when o_orderkey % 3 = 0 then null else o_custkey end id, 'AUTOMOBILE' code from orders)
select o_orderkey, coalesce(a.c_name, (select c_name from customer where c_mktsegment = 'AUTOMOBILE' order by c_custkey limit 1)) c_name from o left join customer a on a.c_custkey = o.id""",
)
def j2(t):  # noqa: ANN001, ANN201
    o = t("orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")).alias("id"), F.lit("AUTOMOBILE").alias("code"))
    return joins.lookup_id_else_code(o, t("customer"), ("id", "c_custkey"), ("code", "c_mktsegment"), "c_name", "c_custkey").select("o_orderkey", "c_name")


@query("J3_lateral_first", "select c_custkey, (select o_orderkey from orders where o_custkey = c_custkey order by o_orderdate nulls last, o_orderkey limit 1) first_order from customer")
def j3(t):  # noqa: ANN001, ANN201
    first = t("orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct(F.col("o_orderdate").isNull(), "o_orderdate", "o_orderkey")).alias("first_order"))
    return t("customer").join(first, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "first_order")


@query(
    "J4_lateral_rank",
    "select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by case when o_orderpriority like '1%' then 0 else 1 end, case when o_orderstatus = 'O' then 0 else 1 end, o_orderdate desc, o_orderkey desc) k from orders) where k = 1",
)
def j4(t):  # noqa: ANN001, ANN201
    order = [F.when(F.col("o_orderpriority").startswith("1"), 0).otherwise(1), F.when(F.col("o_orderstatus") == "O", 0).otherwise(1), F.desc("o_orderdate"), F.desc("o_orderkey")]
    return joins.top_one(t("orders"), ["o_custkey"], order).select("o_custkey", "o_orderkey")


@query("J5_preaggregated", "select c_custkey, coalesce(n, 0) n from customer left join (select o_custkey, count(*) n from orders group by 1) on c_custkey = o_custkey")
def j5(t):  # noqa: ANN001, ANN201
    n = t("orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return t("customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("J6_computed_key", "select r_name, count(*) nations, count(s_suppkey) suppliers from region join nation on n_regionkey = r_regionkey left join supplier on s_nationkey = n_nationkey group by lower(coalesce(r_name, '')), r_name")
def j6(t):  # noqa: ANN001, ANN201
    n = t("nation").withColumn("k", F.coalesce(F.col("n_regionkey"), F.lit(-1)))
    out = joins.catalog(t("region")).join(n, F.col("r_regionkey") == F.col("k")).join(t("supplier"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return out.groupBy("r_name").agg(F.count("*").alias("nations"), F.count("s_suppkey").alias("suppliers"))


@query("J7_bridge", "select o_orderkey, list_sort(list(l_partkey) filter (where l_partkey is not null)) parts from orders left join lineitem on l_orderkey = o_orderkey group by 1")
def j7(t):  # noqa: ANN001, ANN201
    """One join and an ordered list instead of a query per row."""
    out = t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    parts = F.sort_array(F.collect_list("l_partkey"))
    return out.groupBy("o_orderkey").agg(F.when(F.count("l_partkey") > 0, parts).alias("parts"))


@query("J8_existing", "select count(*) filter (where exists (select 1 from orders where o_custkey = c_custkey)) found, count(*) filter (where not exists (select 1 from orders where o_custkey = c_custkey)) missing from customer")
def j8(t):  # noqa: ANN001, ANN201
    ids = t("customer").select(F.col("c_custkey").alias("o_custkey"))
    found, missing = joins.existing(ids, t("orders"), "o_custkey")
    both = found.withColumn("f", F.lit(1)).unionByName(missing.withColumn("f", F.lit(0)))
    return both.agg(F.count_if(F.col("f") == 1).alias("found"), F.count_if(F.col("f") == 0).alias("missing"))


@query("J9_number_lookup", "select l_linenumber, min(l_linestatus) state from lineitem where l_suppkey = 7 and l_returnflag = 'N' and l_linenumber in (1, 2, 9) group by 1")
def j9(t):  # noqa: ANN001, ANN201
    wanted = F.array(F.lit(1), F.lit(2), F.lit(9))
    asked = t("region").limit(1).select(F.lit(7).cast("bigint").alias("l_suppkey"), F.lit("N").alias("l_returnflag"), F.explode(wanted).alias("l_linenumber"))
    return t("lineitem").join(F.broadcast(asked), ["l_suppkey", "l_returnflag", "l_linenumber"]).groupBy("l_linenumber").agg(F.min("l_linestatus").alias("state"))


@query(
    "J10_identity",
    """with r as (select doc_id, case when doc_id % 3 = 0 then '' else lang end book, case when doc_id % 2 = 0 then source else '' end inst, n_chars % 50 num, lang file from documents),
k as (select doc_id key, lang book, source inst, n_chars % 50 num, lang file from documents where doc_id % 5 = 0)
select r.doc_id, case when book <> '' and inst <> '' then (select min(key) from k where k.book = r.book and k.inst = r.inst and k.num = r.num)
 when book <> '' then coalesce((select min(key) from k where k.book = r.book and k.num = r.num and k.file = r.file), (select min(key) from k where k.num = r.num and k.file = r.file), (select min(key) from k where k.num = r.num))
 when file <> '' then coalesce((select min(key) from k where k.num = r.num and k.file = r.file), (select min(key) from k where k.num = r.num))
 else (select min(key) from k where k.num = r.num) end key from r""",
)
def j10(t):  # noqa: ANN001, ANN201
    d = t("documents")
    num = (F.col("n_chars") % 50).alias("num")
    rows = d.select("doc_id", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang")).alias("book"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise("").alias("inst"), num, F.col("lang").alias("file"))
    known = d.where("doc_id % 5 = 0").select(F.col("doc_id").alias("key"), F.col("lang").alias("book"), F.col("source").alias("inst"), num, F.col("lang").alias("file"))
    return joins.resolve_identity(rows, known, "book", "inst", "num", "file", "key").select("doc_id", "key")


@query(
    "J11_sync",
    """with s as (select c_custkey k, c_acctbal v from customer where c_custkey % 3 <> 0), g as (select c_custkey k, case when c_custkey % 5 = 0 then 0 else c_acctbal end v from customer where c_custkey % 4 <> 0)
select coalesce(s.k, g.k) k, case when g.k is null then 'insert' when s.k is null then 'extra' when s.v is not distinct from g.v then 'skip' else 'update' end action from s full join g on s.k = g.k""",
)
def j11(t):  # noqa: ANN001, ANN201
    c = t("customer")
    s = c.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    g = c.where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 5 == 0, 0.0).otherwise(F.col("c_acctbal")).alias("v"))
    return joins.sync_actions(s, g, "k", ["v"])


@query("J12_gold_prediction", "select g.item_id, p.doc_id from benchmark g left join (select doc_id % 40 item_id, max(doc_id) doc_id from documents group by 1) p using (item_id)")
def j12(t):  # noqa: ANN001, ANN201
    """The last prediction of a number wins."""
    p = keep(t("documents").select((F.col("doc_id") % 40).alias("item_id"), "doc_id"), ["item_id"], [F.desc("doc_id")])
    return t("benchmark").select("item_id").join(p, "item_id", "left")


@query(
    "J13_binding",
    "select a.conv_id, a.turn, coalesce(b.text, c.text) bound from conversations a left join conversations b on b.conv_id = a.conv_id and b.turn = a.turn - 1 left join conversations c on c.conv_id = a.conv_id and c.turn = a.turn + 1",
)
def j13(t):  # noqa: ANN001, ANN201
    """One key first, then the next."""
    c = t("conversations").select("conv_id", "turn", "text")
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("b"))
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("a"))
    return c.join(before, ["conv_id", "turn"], "left").join(after, ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce("b", "a").alias("bound"))


@query("J15_continuations", "select conv_id, turn, sum(case when role = 'assistant' then 0 else 1 end) over (partition by conv_id order by turn rows unbounded preceding) group_no from conversations")
def j15(t):  # noqa: ANN001, ANN201
    return joins.continuation_groups(t("conversations"), ["conv_id"], "turn", F.col("role") == "assistant").select("conv_id", "turn", "group_no")


@query("J16_marker_resolution", "select p_partkey, coalesce(case when p_size % 4 = 0 then 'preview' end, case when p_size % 3 = 0 then p_brand end, p_type) target from part")
def j16(t):  # noqa: ANN001, ANN201
    p = t("part")
    preview = p.where("p_size % 4 = 0").select("p_partkey", F.lit("preview").alias("pre"))
    binding = p.where("p_size % 3 = 0").select("p_partkey", F.col("p_brand").alias("bind"))
    return p.join(preview, "p_partkey", "left").join(binding, "p_partkey", "left").select("p_partkey", F.coalesce("pre", "bind", "p_type").alias("target"))


@query("J17_two_collections", "select distinct n_name from nation where n_nationkey in (select c_nationkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 300000))")
def j17(t):  # noqa: ANN001, ANN201
    o = t("orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    c = t("customer").join(o, "c_custkey", "left_semi").select(F.col("c_nationkey").alias("n_nationkey"))
    return t("nation").join(c, "n_nationkey", "left_semi").select("n_name").distinct()


TRIGRAMS = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9áéíóúüñ]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


#: A part's name as it is asked for: as it is, with a word doubled, without its last letter, with a letter changed, in capitals, or of another sort.
_ASKED_SQL = """case p_partkey % 6 when 0 then p_name when 1 then p_name || ' ' || split_part(p_name, ' ', 1) when 2 then left(p_name, length(p_name) - 1)
  when 3 then replace(p_name, 'a', 'e') when 4 then upper(p_name) else p_name || ' xyz' end"""
_AREA_SQL = "case when p_partkey % 5 = 0 then '' when p_partkey % 7 = 0 then 'Other#9' else p_brand || case when p_partkey % 3 = 0 then ' x' else '' end end"


def _asked(t):  # noqa: ANN001, ANN202
    k, n = F.col("p_partkey"), F.col("p_name")
    name = F.when(k % 6 == 0, n).when(k % 6 == 1, F.concat(n, F.lit(" "), F.split_part(n, F.lit(" "), F.lit(1)))).when(k % 6 == 2, F.expr("left(p_name, length(p_name) - 1)"))
    name = name.when(k % 6 == 3, F.replace(n, F.lit("a"), F.lit("e"))).when(k % 6 == 4, F.upper(n)).otherwise(F.concat(n, F.lit(" xyz")))
    area = F.when(k % 5 == 0, "").when(k % 7 == 0, "Other#9").otherwise(F.concat("p_brand", F.when(k % 3 == 0, " x").otherwise("")))
    return t("part").select("p_partkey", name.alias("p_name"), area.alias("p_area"), "p_type")


def _resolve_sql(area: bool, within: bool) -> str:
    """A full comparison of all different names."""
    w = ", p_type w" if within else ", '' w"
    b_area = "p_brand" if area else "''"
    return f"""with a as (select p_partkey k, {_ASKED_SQL} n, {_AREA_SQL if area else "''"} m {w} from part),
b as (select p_name n, {b_area} m {w}, min(p_partkey) k from part group by all),
x as (select a.k left_key, b.k right_key from a join b using (n, m, w)),
an as (select n, w, {TRIGRAMS.format("n")} g from (select distinct n, w from a where k not in (select left_key from x))), bn as (select n, w, {TRIGRAMS.format("n")} g from (select distinct n, w from b)),
p as (select an.n, bn.n r, an.w, len(list_intersect(an.g, bn.g)) / len(list_distinct(an.g || bn.g)) s from an join bn on an.w = bn.w and len(an.g) > 0 and len(bn.g) > 0),
t as (select * from (select *, max(s) over (partition by n, w) best from p where s >= 0.8) where s = best),
ar as (select x, {TRIGRAMS.format("x")} g from (select m x from a union select m from b)),
c as (select a.k, a.m, b.k right_key, t.s, case when len(list_distinct(ga.g || gb.g)) = 0 then 0.0 else len(list_intersect(ga.g, gb.g)) / len(list_distinct(ga.g || gb.g)) end alike
  from a join t on a.n = t.n and a.w = t.w join b on b.n = t.r and b.w = t.w join ar ga on ga.x = a.m join ar gb on gb.x = b.m where a.k not in (select left_key from x)),
d as (select *, row_number() over (partition by k order by alike desc, right_key) i from c)
select left_key, right_key, 1.0::double score, 'exact' how from x union all select k, right_key, round(s, 9), 'similar' from d where i = 1 and (m = '' or alike >= 0.5)"""


@query("J18_fuzzy_match", _resolve_sql(area=True, within=False))
def j18(t):  # noqa: ANN001, ANN201
    """Topics with areas: all part names, altered, against all part names."""
    return fuzzy.resolve(_asked(t), t("part").withColumnRenamed("p_brand", "p_area"), "p_partkey", "p_name", "p_area").withColumn("score", F.round("score", 9))


@query("J18_subtopics", _resolve_sql(area=False, within=True))
def j18_subtopics(t):  # noqa: ANN001, ANN201
    """Subtopics within their topic (type)."""
    return fuzzy.resolve(_asked(t), t("part"), "p_partkey", "p_name", within="p_type").withColumn("score", F.round("score", 9))


@query(
    "J18_area_search",
    f"""with a as (select distinct replace(p_type, 'E', 'A') n from part union select distinct p_type || 'S' from part union select 'zzz'), b as (select distinct p_type n from part),
p as (select a.n, b.n area, case when a.n = b.n then 1.0 else len(list_intersect(ga, gb)) / len(list_distinct(ga || gb)) end::double s
  from (select n, {TRIGRAMS.format("n")} ga from a) a, (select n, {TRIGRAMS.format("n")} gb from b) b)
select n as name, area, round(s, 9) score from (select *, row_number() over (partition by n order by n = area desc, s desc, area desc) i from p where s >= 0.8) where i = 1""",
)
def j18_area(t):  # noqa: ANN001, ANN201
    """Areas asked for in a search against the known ones."""
    known = t("part").select("p_type")
    asked = known.select(F.replace("p_type", F.lit("E"), F.lit("A")).alias("p_type")).unionByName(known.select(F.concat("p_type", F.lit("S")).alias("p_type")))
    asked = asked.unionByName(known.select(F.lit("zzz").alias("p_type")).distinct())
    return fuzzy.nearest_area(asked, known, "p_type").withColumn("score", F.round("score", 9))


@query(
    "J19_incremental_sample",
    """select doc_id from documents where doc_id not in (select doc_id from labels where doc_id is not null) and n_chars > 40
order by md5('42:' || coalesce(source, '')), coalesce(source, ''), md5('42:' || doc_id), doc_id::varchar limit 200""",
)
def j19(t):  # noqa: ANN001, ANN201
    """Documents of sources in a seeded order, those with labels left out, up to the cap that is the feature."""
    d = t("documents").where("doc_id is not null")
    return ordering.incremental_sample(d, t("labels"), "doc_id", "source", F.col("n_chars") > 40, 200, 42).select("doc_id")


@query("J20_normalisation_base", "select doc_id, coalesce(case when quality = 1 then 'reviewed' end, 'pending') status from documents left join labels using (doc_id) where trim(text) <> '' and n_chars > 20")
def j20(t):  # noqa: ANN001, ANN201
    old = t("labels").where("quality = 1").select("doc_id", F.lit("reviewed").alias("old"))
    rows = t("documents").where("trim(text) <> '' and n_chars > 20")
    return rows.join(old, "doc_id", "left").select("doc_id", F.coalesce("old", F.lit("pending")).alias("status"))


# -- U ---------------------------------------------------------------------------


@query(
    "U1_best_display",
    """with v as (select r_name v from region union all select lower(r_name) from region union all select ' ' || r_name || ' ' from region union all select upper(substr(r_name, 1, 1)) || lower(substr(r_name, 2)) from region)
select key, value from (select lower(trim(v)) key, trim(v) value, row_number() over (partition by lower(trim(v)) order by length(trim(v)) desc, length(regexp_replace(trim(v), '[^A-Z]', '', 'g')), trim(v)) k from v) where k = 1""",
)
def u1(t):  # noqa: ANN001, ANN201
    r = t("region").select(F.col("r_name").alias("v"))
    v = r.unionByName(r.select(F.lower("v").alias("v"))).unionByName(r.select(F.concat(F.lit(" "), "v", F.lit(" ")).alias("v")))
    v = v.unionByName(r.select(F.concat(F.upper(F.substring("v", 1, 1)), F.lower(F.substring("v", 2, 100))).alias("v")))
    return merges.best_display(v, "v").orderBy("key")


@query("U2_distinct_values", "select distinct trim(p_type) v from part where trim(p_type) <> ''")
def u2(t):  # noqa: ANN001, ANN201
    return t("part").select(F.trim("p_type").alias("v")).where("v <> ''").distinct()


@query(
    "U3_upsert",
    """with o as (select c_custkey k, c_name a, c_mktsegment b from customer where c_custkey % 3 <> 0), n as (select c_custkey k, case when c_custkey % 2 = 0 then null else 'new' end a, case when c_custkey % 5 = 0 then ' ' else 'seg' end b from customer where c_custkey % 4 <> 0)
select coalesce(o.k, n.k) k, coalesce(n.a, o.a) a, coalesce(case when trim(n.b) <> '' then n.b end, o.b) b from o full join n on o.k = n.k""",
)
def u3(t):  # noqa: ANN001, ANN201
    c = t("customer")
    o = c.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("a"), F.col("c_mktsegment").alias("b"))
    n = c.where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 2 != 0, "new").alias("a"), F.when(F.col("c_custkey") % 5 == 0, " ").otherwise("seg").alias("b"))
    return merges.upsert(o, n, "k", {"a": "keep_if_null", "b": "keep_if_blank"})


@query("U4_insert_ignore", "select c_custkey k, 'old' v from customer where c_custkey % 2 = 0 union all select c_custkey, 'new' from customer where c_custkey % 3 = 0 and c_custkey % 2 <> 0")
def u4(t):  # noqa: ANN001, ANN201
    k = t("customer").select(F.col("c_custkey").alias("k"))
    return merges.insert_ignore(k.where("k % 2 = 0").withColumn("v", F.lit("old")), k.where("k % 3 = 0").withColumn("v", F.lit("new")), "k")


@query(
    "U5_fill",
    "with o as (select s_suppkey k, case when s_suppkey % 2 = 0 then s_name end v from supplier), n as (select s_suppkey k, 'filled' v from supplier where s_suppkey % 3 = 0) select coalesce(o.k, n.k) k, coalesce(o.v, n.v) v from o full join n on o.k = n.k",
)
def u5(t):  # noqa: ANN001, ANN201
    s = t("supplier")
    o = s.select(F.col("s_suppkey").alias("k"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("v"))
    n = s.where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("k"), F.lit("filled").alias("v"))
    return merges.upsert(o, n, "k", {"v": "fill"})


@query("U6_replace_source", "select doc_id, source, 'old' tag from documents where source not in ('src2', 'src4') union all select doc_id + 1000000, source, 'new' from documents where source in ('src2', 'src4') and doc_id % 2 = 0")
def u6(t):  # noqa: ANN001, ANN201
    d = t("documents")
    new = d.where("source in ('src2', 'src4') and doc_id % 2 = 0").select((F.col("doc_id") + 1000000).alias("doc_id"), "source", F.lit("new").alias("tag"))
    return merges.replace_source(d.select("doc_id", "source", F.lit("old").alias("tag")), new, "source").select("doc_id", "source", "tag")


@query(
    "U7_delete_obsolete",
    "select l_orderkey, l_linenumber from lineitem where l_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R') or l_returnflag = 'R' or (l_orderkey, l_linenumber) in (select l_orderkey, l_linenumber from lineitem where l_returnflag = 'R')",
)
def u7(t):  # noqa: ANN001, ANN201
    rows = t("lineitem").select("l_orderkey", "l_linenumber")
    kept = t("lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber")
    return merges.delete_obsolete(rows, kept, ["l_orderkey"], "l_linenumber").select("l_orderkey", "l_linenumber")


@query("U8_cascade_delete", "select 'orders' t, count(*) n from orders where o_custkey % 7 <> 0 union all select 'customer', count(*) from customer where c_custkey % 7 <> 0")
def u8(t):  # noqa: ANN001, ANN201
    c = t("customer")
    left = merges.cascade_delete(c, c.where("c_custkey % 7 = 0"), [(t("orders"), "o_custkey")], "c_custkey")
    return left[1].agg(F.count("*").alias("n")).select(F.lit("orders").alias("t"), "n").unionByName(left[0].agg(F.count("*").alias("n")).select(F.lit("customer").alias("t"), "n"))


@query("U9_swap", "select o_orderkey, case o_orderstatus when 'O' then 'F' when 'F' then 'O' else o_orderstatus end s from orders")
def u9(t):  # noqa: ANN001, ANN201
    return t("orders").select("o_orderkey", merges.swapped(F.col("o_orderstatus"), {"O": "F", "F": "O"}).alias("s"))


@query(
    "U10_fold_records",
    """select user_id, first(v) filter (where k = 1) kind, list_sort(list_distinct(list(err) filter (where err is not null))) errors, min(ts) created_at, count(*) merged from (
 select user_id, event_type v, ts, case when event_type = 'error' then 'e' || cast(event_id % 5 as varchar) end err, row_number() over (partition by user_id order by event_id) k from events) group by 1""",
)
def u10(t):  # noqa: ANN001, ANN201
    err = F.when(F.col("event_type") == "error", F.concat(F.lit("e"), (F.col("event_id") % 5).cast("string")))
    e = t("events").select("user_id", "event_id", F.col("event_type").alias("kind"), "ts", err.alias("err"))
    out = merges.fold_records(e, "user_id", "event_id", ["kind"], "err", "ts")
    return out.withColumn("errors", F.when(F.size("errors") > 0, F.col("errors")))


@query("U11_batch_upsert", "select user_id, max(event_id) last_event, count(*) writes from events group by 1")
def u11(t):  # noqa: ANN001, ANN201
    return t("events").groupBy("user_id").agg(F.max("event_id").alias("last_event"), F.count("*").alias("writes"))


@query("U12_dataset_merge", "select doc_id, min(src) src from (select doc_id, 1 src from documents where doc_id % 2 = 0 union all select doc_id, 2 from documents where doc_id % 3 = 0) group by 1")
def u12(t):  # noqa: ANN001, ANN201
    """The first source with an id wins."""
    d = t("documents").select("doc_id")
    both = d.where("doc_id % 2 = 0").withColumn("src", F.lit(1)).unionByName(d.where("doc_id % 3 = 0").withColumn("src", F.lit(2)))
    return keep(both, ["doc_id"], [F.asc("src")])


@query(
    "U13_promotion_report",
    "select case when l.quality is null then 'skipped' when d.n_chars < 100 then 'error' when l.quality = 1 then 'inserted' else 'updated' end action, count(*) n from documents d left join labels l using (doc_id) group by 1",
)
def u13(t):  # noqa: ANN001, ANN201
    action = F.when(F.col("quality").isNull(), "skipped").when(F.col("n_chars") < 100, "error").when(F.col("quality") == 1, "inserted").otherwise("updated")
    return t("documents").join(t("labels"), "doc_id", "left").groupBy(action.alias("action")).agg(F.count("*").alias("n"))


@query("U14_keep_review", "select o_orderkey, coalesce(nullif(case when o_orderkey % 2 = 0 then '' else 'new' end, ''), o_orderstatus) review from orders")
def u14(t):  # noqa: ANN001, ANN201
    new = F.when(F.col("o_orderkey") % 2 == 0, "").otherwise("new")
    return t("orders").select("o_orderkey", F.coalesce(F.nullif(new, F.lit("")), "o_orderstatus").alias("review"))


@query("U15_sanitise", "select o_orderkey, case when o_orderstatus in ('O', 'F') then o_orderstatus else 'Sin revisar' end s from orders")
def u15(t):  # noqa: ANN001, ANN201
    return t("orders").select("o_orderkey", F.when(F.col("o_orderstatus").isin("O", "F"), F.col("o_orderstatus")).otherwise("Sin revisar").alias("s"))


@query(
    "U16_item_merge",
    """with a as (select conv_id, turn n, text from conversations where turn % 3 <> 0), b as (select conv_id, turn + 1 n, text from conversations where turn % 2 = 0)
select coalesce(a.conv_id, b.conv_id) conv_id, coalesce(a.n, b.n) n, case when b.text is null then a.text when a.text is null then b.text when length(a.text) >= length(b.text) then a.text else b.text end text from a full join b on a.conv_id = b.conv_id and a.n = b.n""",
)
def u16(t):  # noqa: ANN001, ANN201
    """Whole texts on both sides; the other side's is the turn before, so that either may be the longer."""
    c = t("conversations")
    return items_merged(c, c.where("turn % 2 = 0").select("conv_id", (F.col("turn") + 1).alias("n"), F.col("text").alias("b")))


def items_merged(c, b):  # noqa: ANN001, ANN201
    a = c.where("turn % 3 <> 0").select("conv_id", F.col("turn").alias("n"), F.col("text").alias("a"))
    best = F.when(F.col("b").isNull(), F.col("a")).when(F.col("a").isNull(), F.col("b")).when(F.length("a") >= F.length("b"), F.col("a")).otherwise(F.col("b"))
    return a.join(b, ["conv_id", "n"], "full_outer").select("conv_id", "n", best.alias("text"))


@query("U19_replace_pages", "select page_id, 'old' v from pages where page_id % 10 <> 0 union all select page_id, 'new' from pages where page_id % 10 = 0")
def u19(t):  # noqa: ANN001, ANN201
    p = t("pages").select("page_id")
    return merges.replace_source(p.withColumn("v", F.lit("old")), p.where("page_id % 10 = 0").withColumn("v", F.lit("new")), "page_id")


@query(
    "U20_rematerialise",
    """select l_orderkey, l_linenumber, row_number() over (order by l_orderkey, l_linenumber, l_partkey) running, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) in_page from lineitem""",
)
def u20(t):  # noqa: ANN001, ANN201
    return rematerialised(t("lineitem"))


def rematerialised(rows):  # noqa: ANN001, ANN201
    """Global order from page offsets: counts of pages are summed up over ranges of pages, so no task sees all rows or all pages."""
    from pyspark.sql import Window as W

    rows = rows.select("l_orderkey", "l_linenumber", "l_partkey")
    pages = rows.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    before = ordering.running(pages, [F.col("l_orderkey")], "upto", F.col("n")).select("l_orderkey", (F.col("upto") - F.col("n")).alias("before"))
    own = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    return rows.withColumn("in_page", own).join(before, "l_orderkey").select("l_orderkey", "l_linenumber", (F.col("before") + F.col("in_page")).alias("running"), "in_page")


@query("U21_page_rebuild", "select l_orderkey, list_sort(list_distinct(list(l_partkey))) boxes from lineitem group by 1 having count(distinct l_partkey) > 2")
def u21(t):  # noqa: ANN001, ANN201
    boxes = t("lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_partkey")).alias("boxes"))
    return boxes.where(F.size("boxes") > 2)
