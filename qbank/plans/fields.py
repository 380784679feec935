"""Queries of fields, tags, markers and imported blocks over whole tables (S5-S10, S13, S16, S17, S26, S38, S39, U17, U18, SRC8, SRC10, SRC11, SRC14, SRC15, SNK2, A19).

Each document's words, all of them, stand where ``~`` is in one of several
forms, chosen by the document's number; the oracles say what each form must give.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qbank.functions import similarity, text
from qbank.operators import merges
from qbank.plans.registry import query
from qbank.plans.statements import chosen, chosen_sql, quoted
from qbank.sources import readers, writers
from qbank.tables import spread

_WORDS_SQL = "w as (select doc_id, trim(regexp_replace(coalesce(text, ''), '[^a-z]+', ' ', 'g')) w from documents where doc_id is not null)"


def _documents(t, forms: tuple[str, ...]) -> DataFrame:  # noqa: ANN001
    """``doc_id, w, x``: a document's words, and its form with the words in it."""
    words = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-z]+", " "))
    rows = spread(t("documents").where("doc_id is not null").select("doc_id", "text"), "doc_id").select("doc_id", words.alias("w"))
    return rows.withColumn("x", F.replace(F.replace(chosen(F.col("doc_id") % len(forms), forms), F.lit("~"), F.col("w")), F.lit("#"), F.col("doc_id").cast("string")))


def _filled(x: str | None) -> str:
    """A form as SQL: words for ``~``, the number for ``#``; ``=`` in front: an expression as it is."""
    if x is None:
        return "null"
    return x[1:] if x.startswith("=") else f"replace(replace({quoted(x)}, '~', w), '#', doc_id::varchar)"


def _table(forms: tuple, columns: dict[str, tuple]) -> str:
    """The oracle of a table of forms: what each column is for each form."""
    k = f"doc_id % {len(forms)}"
    return f"with {_WORDS_SQL} select doc_id, " + ", ".join(f"{chosen_sql(k, [_filled(x) if x is None or isinstance(x, str) else str(x) for x in of])} as {name}" for name, of in columns.items()) + " from w"


_S5 = ("[[curso=Algebra]] ~ [[curso=]] [[tema=~]]", "~ sin etiquetas", "[[ CURSO = Uno ]] ~ [[curso=Dos]][[tema= ]]", "[[curso=]] ~ [[Tema=x y]]")


@query("S5_tags", _table(_S5, {"first_course": ("Algebra", "", "Uno", ""), "last_course": ("Algebra", None, "Dos", None), "topic": ("=nullif(w, '')", None, None, "x y")}))
def s5(t):  # noqa: ANN001, ANN201
    d, x = _documents(t, _S5), F.col("x")
    return d.select("doc_id", text.first_tag(x, "curso").alias("first_course"), text.last_tag(x, "curso").alias("last_course"), text.last_tag(x, "tema").alias("topic"))


_S6 = ("[[a=1]]~[[b=2]]", r"\item[\textbf{#.}] ~", r"pre \item [ \textbf{ # } ] ~ [[t=]]", "~")
_S6_STRIPPED = ("=md5(w)", r"=md5(trim('\item[\textbf{' || doc_id || '.}] ' || w))", r"=md5(trim('pre \item [ \textbf{ ' || doc_id || ' } ] ' || w))", "=md5(w)")
_S6_INSERTED = (
    "=md5('[[x=1]][[a=1]]' || w || '[[b=2]]')", r"=md5('\item[\textbf{' || doc_id || '.}][[x=1]] ' || w)", r"=md5('pre \item [ \textbf{ ' || doc_id || ' } ][[x=1]] ' || w || ' [[t=]]')",
    "=md5('[[x=1]]' || w)",
)


@query("S6_tag_edit", _table(_S6, {"stripped": _S6_STRIPPED, "inserted": _S6_INSERTED}))
def s6(t):  # noqa: ANN001, ANN201
    d, x = _documents(t, _S6), F.col("x")
    return d.select("doc_id", F.md5(text.strip_tags(x)).alias("stripped"), F.md5(text.insert_after_header(x, F.lit("[[x=1]]"))).alias("inserted"))


_S7 = ("Examen 2023 Proceso: ii, Área A, ~", "Admisión 2019-1 area: b2 ~", "proc. 3, 12345 Área ## ~", "del 1899 y 2100; 1998. Proceso#IV area-c ~")
_S7_IN = tuple(x.replace("##", "9") .replace("#", "\x00") for x in _S7)


@query("S7_exam_metadata", _table(_S7, {"year": ("=2023", "=2019", "=null", "=1998"), "process": ("II", "2019-1", "3", "IV"), "area": ("A", "B2", "9", "C")}))
def s7(t):  # noqa: ANN001, ANN201
    d = _documents(t, _S7_IN)
    x = F.replace("x", F.lit("\x00"), F.lit("#"))
    return d.select("doc_id", text.exam_year(x).alias("year"), text.exam_process(x).alias("process"), text.exam_area(x).alias("area"))


_S8 = (r"\item[\textbf{12.}] ~", r"~ \item [\textbf{ 7 }]", "plain 7. ~", r"\item[\textbf{x}] ~", r"~\item[ \textbf{#.} ]")


@query("S8_item_number", _table(_S8, {"n": ("=12", "=7", "=null", "=null", "=doc_id::integer")}))
def s8(t):  # noqa: ANN001, ANN201
    return _documents(t, _S8).select("doc_id", text.item_number(F.col("x")).alias("n"))


_S9 = ("clave: b ~", "  E. ~", "12 (c) ~", "~", "xyz")


@query(
    "S9_answers",
    f"""with {_WORDS_SQL}, x as (select doc_id, {chosen_sql(f'doc_id % {len(_S9)}', [_filled(x) for x in _S9])} x from w)
select doc_id, nullif(upper(regexp_extract(x, '[A-Ea-e]')), '') any_answer, nullif(upper(regexp_extract(' ' || x || ' ', '[^A-Za-z0-9_]([A-Ea-e])[^A-Za-z0-9_]', 1)), '') word_answer,
  case when upper(left(trim(x), 1)) in ('A', 'B', 'C', 'D', 'E') then upper(left(trim(x), 1)) end first_answer from x""",
)
def s9(t):  # noqa: ANN001, ANN201
    x = F.col("x")
    return _documents(t, _S9).select("doc_id", text.answer_any(x).alias("any_answer"), text.answer_word(x).alias("word_answer"), text.answer_first(x).alias("first_answer"))


_S10 = ("~-12-c", "img-#", "a-b-9-E", "no marker", "x-3-Z", "-4")


@query("S10_marker_parts", _table(_S10, {"base": ("~", "img", "a-b", None, None, ""), "num": ("=12", "=doc_id::integer", "=9", "=null", "=null", "=4"), "opt": ("C", None, "E", None, None, None)}))
def s10(t):  # noqa: ANN001, ANN201
    return _documents(t, _S10).withColumn("m", text.marker_parts(F.col("x"))).select("doc_id", "m.base", "m.num", "m.opt")


@query(
    "S13_matching_ratio",
    """select p_partkey, round(case p_partkey % 6 when 0 then 2.0 * n / (2 * n + 2) when 1 then 2.0 * n / (2 * n + 1) when 2 then 2.0 * (n - 1) / (2 * n) when 3 then 0 when 4 then 1 else 2.0 * n / (2 * n + 6) end, 6) ratio
from (select p_partkey, length(p_name) n from part)""",
)
def s13(t):  # noqa: ANN001, ANN201
    """Each name against itself with signs at its ends, one in its middle, nothing, itself, and signs on both sides."""
    k, n = F.col("p_partkey") % 6, F.col("p_name")
    middle = F.concat(F.expr("left(p_name, length(p_name) div 2)"), F.lit("#"), F.expr("substring(p_name, length(p_name) div 2 + 2)"))
    other = F.when(k == 0, F.concat(n, F.lit("##"))).when(k == 1, F.concat(F.lit("#"), n)).when(k == 2, middle).when(k == 3, "").when(k == 4, n).otherwise(F.concat(F.lit("###"), n, F.lit("@@@")))
    return t("part").select("p_partkey", F.round(similarity.matching_ratio(n, other), 6).alias("ratio"))


_S16 = ("[CONT.] ~", "  <007.> ~", "<#> ~", "~", "[cont] ~", "x [CONT.] ~", "< 12 > ~")


@query("S16_prefix", _table(_S16, {"p": ("[CONT.]", "<7>", "<#>", "", "[CONT.]", "", "<12>")}))
def s16(t):  # noqa: ANN001, ANN201
    return _documents(t, _S16).select("doc_id", text.ocr_prefix(F.col("x")).alias("p"))


_S17 = ("A) ~ B) 2 C) 3 D) 4 E) 5", "~ none", "A)A) ~ B)", "xA) ~ (B) C)", "E) ~")


@query("S17_label_recall", _table(_S17, {"recall": ("=0.4::double", "=1.0::double", "=0.5::double", "=0.5::double", "=0.0::double")}))
def s17(t):  # noqa: ANN001, ANN201
    return _documents(t, _S17).select("doc_id", F.round(text.label_recall(F.col("x"), F.concat(F.lit("A) 1 C) "), "w")), 6).alias("recall"))


@query(
    "S26_render_item",
    rf"""with {_WORDS_SQL} select doc_id, md5('\item[\textbf{{' || doc_id || '.}}] ' || w || case when doc_id % 3 = 0 then ' [[Imagen=img-' || doc_id || ']]' else '' end
  || '£A)' || case when doc_id % 2 = 0 then w else '' end || 'æB)2æC)£D)ææE)' || doc_id || '£') rendered from w""",
)
def s26(t):  # noqa: ANN001, ANN201
    d, k = _documents(t, ("~",)), F.col("doc_id")
    options = F.create_map(F.lit("A"), F.when(k % 2 == 0, F.col("w")), F.lit("B"), F.lit("2"), F.lit("D"), F.lit(""), F.lit("E"), k.cast("string"))
    tag = F.when(k % 3 == 0, F.concat(F.lit("img-"), k.cast("string")))
    return d.select("doc_id", F.md5(text.render_item(k, F.col("w"), options, tag)).alias("rendered"))


_S38 = ("catalog:topic:#:~: x", "direct:topic:~:y", "#", "~ plain", "catalog:t:no:z", "direct:only", "catalog:")


@query(
    "S38_meta_reference",
    _table(
        _S38,
        {
            "source": ("catalog", "direct", "catalog", "direct", "catalog", "direct", "catalog"), "kind": ("topic", "topic", "", "", "t", "only", ""),
            "id": ("=doc_id", "=null", "=doc_id", "=null", "=null", "=null", "=null"), "text": ("~: x", "~:y", "", "~ plain", "z", "", ""),
        },
    ),
)
def s38(t):  # noqa: ANN001, ANN201
    return _documents(t, _S38).withColumn("m", text.meta_reference(F.col("x"))).select("doc_id", "m.source", "m.kind", "m.id", "m.text")


_S39 = (" TRIGONOMETRIA ", "Trigonometría", " ~ ", "trigonometrÍa", "  Álgebra")


@query("S39_canonical_course", _table(_S39, {"course": ("Trigonometría", "Trigonometría", "~", "Trigonometría", "Álgebra")}))
def s39(t):  # noqa: ANN001, ANN201
    return _documents(t, _S39).select("doc_id", text.canonical_course(F.col("x")).alias("course"))


@query("U17_map_merge", "select o_orderkey, 'A=' || case when o_orderkey % 2 = 0 then 'b' else o_orderpriority end || ';B=b;C=' || o_orderstatus merged from orders")
def u17(t):  # noqa: ANN001, ANN201
    k = F.col("o_orderkey")
    a = F.create_map(F.lit("A"), F.when(k % 2 == 0, " ").otherwise(F.col("o_orderpriority")), F.lit("C"), F.col("o_orderstatus"))
    m = merges.merge_maps(a, F.create_map(F.lit("A"), F.lit("b"), F.lit("B"), F.lit("b")))
    return t("orders").select("o_orderkey", F.concat(F.lit("A="), m["A"], F.lit(";B="), m["B"], F.lit(";C="), m["C"]).alias("merged"))


@query("U18_numeric_elements", "select o_orderkey, case o_orderkey % 3 when 0 then [o_orderkey::integer, 7] when 1 then [7] else []::integer[] end ids from orders")
def u18(t):  # noqa: ANN001, ANN201
    k = F.col("o_orderkey")
    raw = F.when(k % 3 == 0, F.concat(F.lit('["'), k.cast("string"), F.lit('", "x", "7", "-2", ""]'))).when(k % 3 == 1, '["7", "1.5", null, "7a"]').otherwise("[]")
    return t("orders").select("o_orderkey", merges.numeric_elements(raw).alias("ids"))


_ITEM1, _ITEM2 = r"\item[\textbf{1.}]", r"\item [ \textbf{ # } ]"


@query(
    "SRC8_problem_splitter",
    rf"""with {_WORDS_SQL} select doc_id, 1 as number, md5(trim('{_ITEM1} ' || w)) as block from w where doc_id % 3 < 2
union all select doc_id, doc_id::integer, md5(trim('\item [ \textbf{{ ' || doc_id || ' }} ] ' || w)) from w where doc_id % 3 = 0""",
)
def src8(t):  # noqa: ANN001, ANN201
    """Two problems behind an introduction, one, and none, around all the words of a document."""
    d = _documents(t, (f"intro {_ITEM1} ~\n{_ITEM2} ~\n", f"{_ITEM1} ~", "~ without a header"))
    return readers.problems(d.select("doc_id", F.col("x").alias("text"))).select("doc_id", "number", F.md5("block").alias("block"))


_UNIT = "--- INICIO UNIDAD ---\nNombre: {}\nEnunciado: ~\n y\nTema: z\n--- FIN UNIDAD ---"


@query(
    "SRC10_block_import",
    f"""with {_WORDS_SQL} select doc_id, 'u' || doc_id as name, md5(trim(w || ' y')) as statement from w where doc_id % 3 < 2
union all select doc_id, 'second', md5(trim(w || ' y')) from w where doc_id % 3 = 0 union all select doc_id, null, md5('k') from w where doc_id % 3 = 2""",
)
def src10(t):  # noqa: ANN001, ANN201
    """Two units, one, and one without a name and with an alias."""
    one = _UNIT.format("u#")
    d = _documents(t, (f"x\n{one}\n~\n{_UNIT.format('second')}", one, "--- INICIO UNIDAD ---\nEnunciado: k\nTema:\n--- FIN UNIDAD ---\n~"))
    n = d.select("doc_id", F.explode(readers.blocks_between(F.col("x"), "--- INICIO UNIDAD ---", "--- FIN UNIDAD ---")).alias("b"))
    statement = F.trim(F.regexp_replace(readers.block_field(F.col("b"), "Enunciado"), r"\s+", " "))
    return n.select("doc_id", readers.block_field(F.col("b"), "Nombre", "Name").alias("name"), F.md5(statement).alias("statement"))


@query(
    "SRC11_audit_import",
    f"with {_WORDS_SQL} select doc_id, case doc_id % 3 when 0 then [doc_id::integer, 7] when 1 then [3] else []::integer[] end rules, case doc_id % 3 when 0 then 2 when 1 then 1 else 0 end methods from w",
)
def src11(t):  # noqa: ANN001, ANN201
    forms = ("::ID:: #\nReglas: # y 7\n::METODO::~::FIN_METODO::::METODO::b::FIN_METODO::", "Reglas: [3]\n::METODO::\n~\n::FIN_METODO::", "::ID:: #\n~")
    x = F.col("x")
    return _documents(t, forms).select(
        "doc_id", readers.numbers_in(F.regexp_extract(x, "(?m)^Reglas: (.*)$", 1)).alias("rules"), F.size(readers.blocks_between(x, "::METODO::", "::FIN_METODO::")).alias("methods")
    )


@query(
    "SRC14_page_ranges",
    "select o_orderkey, case o_orderkey % 5 when 0 then [1, 2, 3, 7] when 1 then range(1, (o_orderkey % 40 + 2)::integer)::integer[] when 2 then [5]::integer[] when 3 then [4, 5, 6, 9] else []::integer[] end pages from orders",
)
def src14(t):  # noqa: ANN001, ANN201
    k = F.col("o_orderkey")
    selector = chosen(k % 5, ("3-1, 7,2", F.concat((k % 40 + 1).cast("string"), F.lit("-1")), " 5 ", "4-6,9,5 - 4,", ","))
    return t("orders").select("o_orderkey", readers.pages_of(selector, F.lit(41)).alias("pages"))


_REPLIES = ('Here:\n```json\n{"n": #}\n```', '{"n": #, "t": "~"}', 'so {"n": #} ok ~', '{"n": "~", ', "~ nothing", '```\n{"n": #}\n```\nand {broken')


@query("SRC15_json_recovery", _table(_REPLIES, {"n": ("=doc_id::integer", "=doc_id::integer", "=doc_id::integer", "=null", "=null", "=doc_id::integer"), "loose": (None, None, None, "=nullif(w, '')", None, None)}))
def src15(t):  # noqa: ANN001, ANN201
    x = F.col("x")
    loose = F.when(F.col("doc_id") % len(_REPLIES) == 3, readers.loose_field(x, "n"))
    return _documents(t, _REPLIES).select("doc_id", F.try_variant_get(readers.recovered_json(x), "$.n", "int").alias("n"), loose.alias("loose"))


@query("SNK2_csv_view", "select cast(c_custkey as varchar) c_custkey, '' missing, coalesce(nullif(c_mktsegment, 'BUILDING'), '') c_mktsegment, c_name from customer")
def snk2(t):  # noqa: ANN001, ANN201
    c: Column = F.nullif("c_mktsegment", F.lit("BUILDING"))
    return writers.csv_view(t("customer").withColumn("c_mktsegment", c), ["c_custkey", "missing", "c_mktsegment", "c_name"])


@query(
    "A19_scan_evaluation",
    """with g as (select p_partkey, p_name from part), p as (select p_partkey, case p_partkey % 4 when 1 then upper(p_name) when 2 then p_name else p_name || 'xy' end as name from part where p_partkey % 4 <> 0)
select count(*) items, round(avg(case when p.name = g.p_name then 1.0 else 0 end), 6) format_pass, round(avg(case when p.name is null then length(g.p_name) else levenshtein(g.p_name, p.name) end), 6) mean_distance,
  count(*) filter (where p.name is null) missing from g left join p using (p_partkey)""",
)
def a19(t):  # noqa: ANN001, ANN201
    """A missing item counts its whole length."""
    n, k = t("part").select("p_partkey", "p_name"), F.col("p_partkey") % 4
    p = n.where(k != 0).select("p_partkey", F.when(k == 1, F.upper("p_name")).when(k == 2, F.col("p_name")).otherwise(F.concat("p_name", F.lit("xy"))).alias("name"))
    d = F.when(F.col("name").isNull(), F.length("p_name")).otherwise(F.levenshtein("p_name", "name"))
    return n.join(p, "p_partkey", "left").agg(
        F.count("*").alias("items"), F.round(F.avg(F.coalesce((F.col("name") == F.col("p_name")).cast("double"), F.lit(0.0))), 6).alias("format_pass"),
        F.round(F.avg(d), 6).alias("mean_distance"), F.count_if(F.col("name").isNull()).alias("missing"),
    )
