"""Projections, filters, predicates, admission and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from qbank.functions import admission, classify, items, rendered, status, text
from qbank.operators import joins, reports
from qbank.plans.registry import query

#: labels.quality as a verdict: 1 good, 0 bad, absent unreviewed.
VERDICT_SQL = "case when l.quality = 1 then 'Consistente' when l.quality = 0 then 'Inconsistente' end"


def verdicts(t):  # noqa: ANN001, ANN201
    d, l = t("documents"), t("labels")  # noqa: E741
    v = F.when(F.col("quality") == 1, status.GOOD).when(F.col("quality") == 0, status.BAD)
    return d.join(l, "doc_id", "left").withColumn("verdict", v)


@query("F1_verdict_pending", "select d.doc_id, d.source from documents d left join labels l using (doc_id) where l.quality is null")
def f1(t):  # noqa: ANN001, ANN201
    return verdicts(t).where(status.verdict_filter(F.col("verdict"), "pendiente")).select("doc_id", "source")


@query("F1_verdict_good", "select doc_id from labels join documents using (doc_id) where quality = 1")
def f1b(t):  # noqa: ANN001, ANN201
    return verdicts(t).where(status.verdict_filter(F.col("verdict"), "Bien planteado".lower())).select("doc_id")


@query("F1_verdict_unknown_pending", "select d.doc_id from documents d left join labels l using (doc_id) where l.quality is null")
def f1c(t):  # noqa: ANN001, ANN201
    return verdicts(t).where(status.verdict_filter(F.col("verdict"), "otro", "pending")).select("doc_id")


@query(
    "F2_canonical_verdict",
    "select doc_id, case when doc_id % 5 in (0, 3) then 'Consistente' when doc_id % 5 in (1, 4) then 'Inconsistente' else 'Sin revisar' end verdict from documents",
)
def f2(t):  # noqa: ANN001, ANN201
    raw = F.element_at(F.array(*(F.lit(x) for x in ("Bien Planteado", "Mal Planteado", "Pendiente Revision", "consistente ", "AMBIGUO"))), (F.col("doc_id") % 5 + 1).cast("int"))
    return t("documents").select("doc_id", status.canonical_verdict(raw).alias("verdict"))


@query(
    "F3_composite_filter",
    f"""select d.doc_id from documents d left join labels l using (doc_id)
where (d.lang in ('en', 'es') or lower(d.source) = 'src3') and (d.source in ('src0', 'src1', 'src3') or d.n_chars > 3000)
  and {VERDICT_SQL} = 'Consistente'""",
)
def f3(t):  # noqa: ANN001, ANN201
    """AND across dimensions, OR within one."""
    course = F.col("lang").isin("en", "es") | (text.text_key(F.col("source")) == "src3")
    topic = F.col("source").isin("src0", "src1", "src3") | (F.col("n_chars") > 3000)
    return verdicts(t).where(course & topic & status.verdict_filter(F.col("verdict"), "consistente")).select("doc_id")


KEYED = "(regexp_matches(text, '(^|[^A-Za-z0-9_])[A-Ea-e]([^A-Za-z0-9_]|$)'))"
LOOKS = "regexp_matches(text, '(?i)(^|[^A-Za-z0-9])a[ ,.]')"


@query("F4_key_filters", f"select doc_id, {KEYED} has_key, {LOOKS} and not {KEYED} without_key, not {LOOKS} and not {KEYED} open_item from documents")
def f4(t):  # noqa: ANN001, ANN201
    has = text.answer_word(F.col("text")).isNotNull()
    looks = F.rlike("text", F.lit("(?i)(^|[^A-Za-z0-9])a[ ,.]"))
    return t("documents").select("doc_id", has.alias("has_key"), (looks & ~has).alias("without_key"), (~looks & ~has).alias("open_item"))


@query(
    "F5_problem_type",
    r"""select conv_id, turn, case when e in ('abierto', 'desarrollo', 'respuesta_abierta') then 'abierto' when e in ('opcion_multiple', 'opción_multiple', 'multiple', 'alternativas') then 'opcion_multiple'
  when conv_id % 7 = 0 then 'opcion_multiple' when regexp_matches(t, '(^|[^A-Za-z0-9])[aA]\)') and regexp_matches(t, '(^|[^A-Za-z0-9])[bB]\)') then 'opcion_multiple' else 'abierto' end kind
from (select *, case turn % 5 when 0 then 'opción_multiple' when 1 then 'desarrollo' end e, case when conv_id % 3 = 0 then text || ' a) uno B) dos' else text end t from conversations)""",
)
def f5(t):  # noqa: ANN001, ANN201
    """Each turn as a problem: an explicit type in some, an answer in some, labelled options in some."""
    explicit = F.when(F.col("turn") % 5 == 0, " Opción Multiple").when(F.col("turn") % 5 == 1, "DESARROLLO ")
    answer, body = F.when(F.col("conv_id") % 7 == 0, "B"), F.when(F.col("conv_id") % 3 == 0, F.concat("text", F.lit(" a) uno B) dos"))).otherwise(F.col("text"))
    return t("conversations").select("conv_id", "turn", classify.problem_type(body, answer, explicit).alias("kind"))


@query("F6_fallback_projection", "select c_custkey, coalesce(nullif(trim(case when c_custkey % 3 = 0 then ' ' else c_mktsegment end), ''), n_name, '') shown from customer left join nation on c_nationkey = n_nationkey")
def f6(t):  # noqa: ANN001, ANN201
    own = F.when(F.col("c_custkey") % 3 == 0, F.lit(" ")).otherwise(F.col("c_mktsegment"))
    out = t("customer").join(joins.catalog(t("nation")), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return out.select("c_custkey", F.coalesce(F.nullif(F.trim(own), F.lit("")), "n_name", F.lit("")).alias("shown"))


@query(
    "F7_practice_projection",
    f"select d.doc_id, coalesce({VERDICT_SQL}, 'Sin revisar') verdict, left(d.text, 240) statement, list_filter([d.source, '', d.lang], lambda x: x <> '') images from documents d left join labels l using (doc_id)",
)
def f7(t):  # noqa: ANN001, ANN201
    images = F.filter(F.array("source", F.lit(""), "lang"), lambda x: x != "")
    return verdicts(t).select("doc_id", F.coalesce("verdict", F.lit(status.OPEN)).alias("verdict"), text.snippet(F.col("text")).alias("statement"), images.alias("images"))


@query("F8_contains_any_case", "select doc_id from documents where source ilike '%RC1%'")
def f8(t):  # noqa: ANN001, ANN201
    return t("documents").where(F.col("source").ilike("%RC1%")).select("doc_id")


@query("F9_null_embeddings", "select count(*) filter (where embedding is null) missing, count(*) filter (where embedding is not null) present from embeddings")
def f9(t):  # noqa: ANN001, ANN201
    return t("embeddings").agg(F.count_if(F.col("embedding").isNull()).alias("missing"), F.count_if(F.col("embedding").isNotNull()).alias("present"))


@query("F10_request_order", "select r.pos, o_orderkey, o_custkey from (values (0, 7), (1, 3), (3, 1), (4, 33)) r(pos, id) join orders on o_orderkey = r.id")
def f10(t):  # noqa: ANN001, ANN201
    """Requested ids in request order, the first of repeats, ids that are no positive number dropped."""
    asked = F.array(*(F.lit(x) for x in ("7", "3", "7", "1", "33", "x", "-4", "0")))
    ids = t("orders").limit(1).select(F.posexplode(asked).alias("pos", "raw")).withColumn("id", F.col("raw").try_cast("bigint")).where("id > 0")
    ids = ids.groupBy("id").agg(F.min("pos").alias("pos"))
    return t("orders").join(F.broadcast(ids), F.col("o_orderkey") == F.col("id")).select("pos", "o_orderkey", "o_custkey").orderBy("pos")


@query("F11_library_filter", "select p_partkey from part where contains(lower(p_name), 'a') and lower(p_brand) = (select lower(min(p_brand)) from part) ")
def f11(t):  # noqa: ANN001, ANN201
    p = t("part")
    least = p.agg(F.min(F.lower("p_brand")).alias("b"))
    return p.where(F.contains(text.search_key(F.col("p_name")), F.lit("a"))).join(F.broadcast(least), F.lower("p_brand") == F.col("b")).select("p_partkey")


@query(
    "F12_any_instance",
    "select o_orderkey from orders o where contains(lower(o_orderpriority), 'u') and (exists (select 1 from lineitem where l_orderkey = o_orderkey and l_linestatus = 'O') or (not exists (select 1 from lineitem where l_orderkey = o_orderkey) and o_orderstatus = 'O'))",
)
def f12(t):  # noqa: ANN001, ANN201
    """An order matches if any line does, else by its own status."""
    lines = t("lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_linestatus") == "O").alias("hit"))
    out = t("orders").where(F.contains(F.lower("o_orderpriority"), F.lit("u"))).join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return out.where(F.coalesce("hit", F.col("o_orderstatus") == "O")).select("o_orderkey")


@query("F13_status_filter", "select l_orderkey, l_linenumber from lineitem where l_returnflag = 'R'")
def f13(t):  # noqa: ANN001, ANN201
    return t("lineitem").where(F.col("l_returnflag") == "R").select("l_orderkey", "l_linenumber")


@query(
    "F14_golden_admission",
    """select d.doc_id, case when d.text is null then 'invalid_json' when l.quality is null then 'status' when trim(d.text) = '' then 'missing_corrected_text'
  when contains(d.text, '***') then 'suspect_image_tags' when d.source in ('src3', 'src7') then 'missing_image' end reason from documents d left join labels l using (doc_id)""",
)
def f14(t):  # noqa: ANN001, ANN201
    """A cascade with one reason per reject; null admits."""
    state = F.when(F.col("verdict").isNull(), "pending").otherwise(" Reviewed ")
    tags = status.issues(("odd_tag", F.contains("text", F.lit("***"))))
    image = F.when(~F.col("source").isin("src3", "src7"), F.col("source"))
    reason = admission.golden_reason(F.col("text"), state, ("reviewed", "corrected"), F.col("text"), tags, image)
    return verdicts(t).select("doc_id", reason.alias("reason"))


@query(
    "F15_staging_admission",
    """select event_id, case when props is null then 'invalid_json' when event_type = 'error' then 'missing_raw_ocr' when value >= 10 and user_id % 3 <> 0 then 'raw_ocr_not_human_reviewed'
  when user_id % 4 = 0 then 'missing_crop' end reason from events""",
)
def f15(t):  # noqa: ANN001, ANN201
    """Each event as a staged record: its kind is the raw text, its value or user tells who reviewed it."""
    raw = F.when(F.col("event_type") == "error", " ").otherwise(F.col("event_type"))
    reviewed = admission.human_reviewed(F.when(F.col("value") < 10, admission.HUMAN_EDITOR), F.when(F.col("user_id") % 3 == 0, admission.HUMAN_EDITOR).otherwise("model"))
    crop = F.when(F.col("user_id") % 4 != 0, F.col("props"))
    return t("events").select("event_id", admission.staging_reason(F.col("props"), raw, F.coalesce(reviewed, F.lit(False)), crop).alias("reason"))


@query(
    "F16_normaliser_admission",
    """select reason, count(*) n from (select case when props is null then 'invalid_json' when event_type = 'error' or user_id % 7 = 0 then 'source_stale' when user_id % 4 = 0 then 'missing_crop'
 when event_type = 'view' and user_id % 3 = 0 then 'missing_raw_ocr' when user_id % 5 in (0, 1) then 'metadata_incomplete' else 'admitted' end reason from events) group by reason""",
)
def f16(t):  # noqa: ANN001, ANN201
    """Each event as a record; rejects by reason, and the admitted."""
    user = F.col("user_id")
    old = admission.stale(F.when(F.col("event_type") == "error", " Invalidated"), F.when(user % 7 == 0, "Sí").otherwise("no"))
    crop, raw = F.when(user % 4 != 0, F.col("props")), F.when((F.col("event_type") == "view") & (user % 3 == 0), "").otherwise(F.col("event_type"))
    missing = admission.input_issues(
        F.when(user % 5 != 0, user), F.lit(None).cast("string"), F.when(user % 5 != 1, F.array(*map(F.lit, (0, 0, 1, 1)))).otherwise(F.array(F.lit(0))), (F.col("event_id"),), (crop,)
    )
    reason = F.coalesce(admission.input_reason(F.col("props"), old, crop, raw, missing), F.lit("admitted"))
    return t("events").select(reason.alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(
    "F17_metadata_issues",
    """select p_partkey, list_filter([case when k % 11 = 0 then 'missing:source.book_code' end, case when k % 13 = 0 then 'missing:source.instance_type' end, case when k % 17 = 0 then 'missing:source.pdf_path' end,
 case when k % 19 = 0 then 'missing:source.page_number' end, case when k % 3 = 0 then 'invalid:source.bbox_px' end, case when k % 23 = 0 then 'missing:crop_path' end, case when k % 5 = 0 then 'missing:models' end,
 case when k % 5 = 1 then 'missing:models.stages.ocr.provider' end, case when k % 5 = 1 then 'missing:models.stages.ocr.fallback' end, case when k % 7 = 0 then 'missing:confidence' end,
 case when k % 4 = 0 then 'invalid:status:odd' end], lambda x: x is not null) issues from (select p_partkey, p_partkey k from part)""",
)
def f17(t):  # noqa: ANN001, ANN201
    """Each part as a staged record, with gaps by its key."""
    return t("part").select("p_partkey", part_issues().alias("issues"))


def part_issues():  # noqa: ANN201
    k = F.col("p_partkey")
    gap = lambda n, c: F.when(k % n != 0, c)
    source = {"book_code": gap(11, F.col("p_brand")), "instance_type": gap(13, F.col("p_type")), "pdf_path": F.when(k % 17 == 0, " ").otherwise(F.col("p_name")), "page_number": gap(19, F.col("p_size"))}
    box = F.when(k % 3 != 0, F.array(*map(F.lit, (0, 0, 9, 9)))).when(k % 2 == 0, F.array(F.lit(1)))
    stage = lambda full: F.array(
        F.struct(F.lit("ocr").alias("stage"), F.lit("m").alias("model_id"), F.lit("p" if full else " ").alias("provider"), F.lit("1").alias("version"), F.lit("no" if full else None).cast("string").alias("fallback"))
    )
    stages = F.when(k % 5 == 1, stage(False)).when(k % 5 != 0, stage(True))
    return admission.metadata_issues(source, box, gap(23, F.col("p_name")), stages, gap(7, F.lit(0.9)), F.when(k % 4 == 0, "odd").when(k % 4 == 1, " Listo").otherwise("review"))


@query(
    "F18_promotion_gate",
    """select p_partkey, n n_issues, n = 0 ready from (select p_partkey, cast(k % 11 = 0 as bigint) + (k % 13 = 0)::int + (k % 17 = 0)::int + (k % 19 = 0)::int + (k % 3 = 0)::int + (k % 23 = 0)::int + (k % 5 = 0)::int + 2 * (k % 5 = 1)::int
  + (k % 7 = 0)::int + (k % 4 = 0)::int + (k % 6 = 0)::int + (k % 6 = 1)::int + (k % 6 = 2)::int + (k % 29 = 0)::int + (k % 4 <> 1)::int n from (select p_partkey, p_partkey k from part))""",
)
def f18(t):  # noqa: ANN001, ANN201
    """The parts of F17 with a rendered item each, in some missing, blank, or without its head."""
    k = F.col("p_partkey")
    latex = F.when(k % 6 == 1, " ").when(k % 6 == 2, "12. x").when(k % 6 != 0, F.concat(F.lit("\\item [\\textbf{ "), k.cast("string"), F.lit(".}] x")))
    found = admission.blocking_issues(part_issues(), k % 6 != 0, latex, k % 29 == 0, F.when(k % 4 == 0, "odd").when(k % 4 == 1, " Listo").otherwise("review"))
    n = F.size(found)
    return t("part").select("p_partkey", n.cast("bigint").alias("n_issues"), (n == 0).alias("ready"))


@query("F19_contract", "select distinct event_type from events where event_type not in ('view', 'click', 'purchase')")
def f19(t):  # noqa: ANN001, ANN201
    """Statuses outside the allowed ones."""
    e = t("events").select("event_type").distinct()
    return e.where(~F.col("event_type").isin("view", "click", "purchase"))


@query(
    "F20_audit_validation",
    """select o_orderkey, list_filter([case when n_custkey is null then 'unknown_customer' end, case when o_totalprice <= 0 then 'no_price' end,
  case when o_orderstatus = 'F' and coalesce(n, 0) < 2 then 'few_methods' end], lambda x: x is not null) errors
from orders left join (select c_custkey n_custkey from customer where c_acctbal >= 0) on o_custkey = n_custkey
left join (select l_orderkey, count(*) n from lineitem group by 1) on l_orderkey = o_orderkey""",
)
def f20(t):  # noqa: ANN001, ANN201
    """Reference to known rows, and at least two methods for a final verdict."""
    known = t("customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("n_custkey"))
    methods = t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    out = t("orders").join(known, F.col("o_custkey") == F.col("n_custkey"), "left").join(methods, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    few = (F.col("o_orderstatus") == "F") & (F.coalesce("n", F.lit(0)) < 2)
    found = status.issues(("unknown_customer", F.col("n_custkey").isNull()), ("no_price", F.col("o_totalprice") <= 0), ("few_methods", few))
    return out.select("o_orderkey", found.alias("errors"))


def _item_sql() -> str:
    white = "' ' || chr(9) || chr(10) || chr(13)"
    mark = r"(|.*?[^A-Za-z0-9]){}\)"
    codes = {
        "schema_invalido": "u % 7 = 0", "n_invalido": "u % 5 < 2", "curso_faltante": "u % 3 = 0", "tema_faltante": "u % 4 = 0", "statement_vacio": "s = ''",
        "statement_multilinea": "contains(s, chr(10)) or contains(s, chr(13))",
        "statement_contiene_opciones": f"regexp_matches(s, '(?s)^{mark.format('A')}{mark.format('B')}{mark.format('C')}') and length(regexp_extract(s, '(?s)^{mark.format('A')}', 1)) > 8",
        "figure_tag_invalido": "u % 2 = 0 and not regexp_matches(tag, '^img-[0-9]+$')", "figure_tag_debe_estar_vacio": "u % 2 = 1 and tag <> ''",
        "image_binding_inconsistente": "u % 2 = 0 and u % 8 not in (0, 2)", "has_figure_debe_ser_derivado": "u % 8 = 3", "options_invalido": "u % 10 = 0",
        "opcion_C_faltante": "u % 10 <> 0 and u % 13 = 1", "opcion_E_faltante": "u % 10 <> 0 and u % 13 = 2",
    }
    cases = ", ".join(f"case when {when} then '{code}' end" for code, when in codes.items())
    return rf"""with c as (select conv_id, turn, conv_id + turn u, coalesce(text, '') x from conversations),
i as (select *, trim(x || case u % 6 when 0 then ' A) 1 B) 2 C) 3' when 1 then ' A) 1 C) 2 B) 3' else '' end, {white}) s,
  case when u % 11 = 3 then 'img-5' when u % 9 = 0 then 'img-x' when u % 9 = 1 or u % 2 = 1 then '' else 'img-' || turn end tag from c)
select conv_id, turn, list_filter([{cases}], lambda x: x is not null) codes from i"""


@query("F21_item_validation", _item_sql())
def f21(t):  # noqa: ANN001, ANN201
    """Each turn's whole text as an item's statement; the other fields by its place, so that every fault occurs."""
    u = F.col("conv_id") + F.col("turn")
    turn = F.col("turn").cast("string")
    value = lambda x, when, odd: (F.lit(x), F.when(when, odd).otherwise("1"))
    plain = [c for x in ("A", "B", "D") for c in value(x, F.lit(False), "")]
    item = {
        "schema": F.when(u % 7 == 0, "ScanItemJSON-v0").otherwise(items.SCHEMA), "n": F.when(u % 5 == 0, "0").when(u % 5 == 1, "x").otherwise("7"),
        "curso": F.when(u % 3 == 0, " ").otherwise("x"), "tema": F.when(u % 4 != 0, "y"),
        "statement": F.concat(F.coalesce("text", F.lit("")), F.when(u % 6 == 0, " A) 1 B) 2 C) 3").when(u % 6 == 1, " A) 1 C) 2 B) 3").otherwise("")),
        "has_figure": u % 2 == 0,
        "figure_tag": F.when(u % 11 == 3, "img-5").when(u % 9 == 0, "img-x").when((u % 9 == 1) | (u % 2 == 1), "").otherwise(F.concat(F.lit("img-"), turn)),
        "binding": F.when(u % 8 == 0, "confirmed").when(u % 8 == 2, " Manual_Confirmed").when(u % 8 == 3, "confirmed").otherwise("open"),
        "options": F.when(u % 10 != 0, F.create_map(*plain, *value("C", u % 13 == 1, " "), *value("E", u % 13 == 2, ""))),
    }
    made = t("conversations").select("conv_id", "turn", *(c.alias(name) for name, c in item.items()))
    return made.select("conv_id", "turn", items.item_issues({name: F.col(name) for name in item}).alias("codes"))


_GOOD_OPTIONS = "£A)$1$æB)$2$æC)$3$£D)$4$ææE)$5$£"


def _rendered_sql() -> str:
    codes = {
        "header_item_invalido": r"not regexp_matches(c, '^\\item\[\s*\\textbf\{[0-9]+\.\}\s*\]')", "tag_curso_faltante": r"not regexp_matches(c, '\[\[curso=[^\]]+\]\]')",
        "tag_tema_faltante": r"not regexp_matches(c, '\[\[tema=[^\]]+\]\]')", "palabra_opciones_prohibida": "contains(lower(c), 'opciones')",
        "patron_opciones_invalido": r"not regexp_matches(c, '(?s)£A\)\$.*?\$æB\)\$.*?\$æC\)\$.*?\$£D\)\$.*?\$ææE\)\$.*?\$£$')",
        "unicode_math_sin_normalizar": "regexp_matches(c, '[°∠⊥∥×÷≤≥≠≈∞α-ω]')", "math_delimiters_desbalanceados": "len(parts) % 2 = 0",
        "latex_special_sin_escape": r"""len(list_filter(list_filter(parts, lambda x, i: i % 2 = 1),
          lambda x: regexp_matches(regexp_replace(x, '\[\[[^\]]+\]\]|\\[A-Za-z]+\*?', ' ', 'g'), '(^|[^\\])[#%&_~^]'))) > 0""",
        "potencia_fuera_de_modo_math": r"regexp_matches(c, '\\textasciicircum\{\}[A-Za-z0-9{]')", "simbolos_unicode_no_mapeados": r"regexp_matches(c, '[^\x00-\x7F£æ]')",
        "imagen_tag_faltante": "has and image = 0", "imagen_tag_incorrecto": "has and image > 0 and not contains(c, ' [[Imagen=img-' || doc_id || ']]')",
        "imagen_tag_fuera_de_posicion": "has and image > 0 and options > 0 and image >= options", "imagen_tag_prohibido": "not has and image > 0",
    }
    cases = ", ".join(f"case when {when} then '{code}' end" for code, when in codes.items())
    return rf"""with r as (select doc_id, doc_id % 2 = 0 has, trim(case when doc_id % 5 = 0 then '' else '\item[\textbf{{' || doc_id || '.}}]' end || case when doc_id % 7 = 1 then '' else '[[curso=x_1]]' end
  || case when doc_id % 11 = 2 then '' else '[[tema=y]]' end || ' ' || coalesce(text, '') || case doc_id % 6 when 0 then ' [[Imagen=img-' || doc_id || ']]' when 1 then ' [[Imagen=img-0]]' when 2 then '' when 3 then ' \$5 y 5\% de $a_1$'
  when 4 then ' a_1 × \textasciicircum{{}}2 $' else ' Opciones:' end || case doc_id % 4 when 0 then '£A) 1' when 1 then '' else '{_GOOD_OPTIONS}' end || case when doc_id % 9 = 4 then ' [[Imagen=img-' || doc_id || ']]' else '' end,
  ' ' || chr(9) || chr(10) || chr(13)) c from documents),
s as (select *, string_split(regexp_replace(c, '(^|[^\\])((?:\\\\)*)\\\$', '\1\2' || chr(1), 'g'), '$') parts, strpos(c, '[[Imagen=') image, strpos(c, '£A)') options from r)
select doc_id, list_filter([{cases}], lambda x: x is not null) codes from s"""


@query("F22_rendered_validation", _rendered_sql())
def f22(t):  # noqa: ANN001, ANN201
    """Whole documents as statements of rendered items, with faults put in by their ids."""
    d, own = F.col("doc_id"), F.concat(F.lit(" [[Imagen=img-"), F.col("doc_id").cast("string"), F.lit("]]"))
    head = F.when(d % 5 == 0, "").otherwise(F.concat(F.lit("\\item[\\textbf{"), d.cast("string"), F.lit(".}]")))
    tags = F.concat(F.when(d % 7 == 1, "").otherwise("[[curso=x_1]]"), F.when(d % 11 == 2, "").otherwise("[[tema=y]]"))
    k = d % 6
    fault = F.when(k == 0, own).when(k == 1, " [[Imagen=img-0]]").when(k == 2, "").when(k == 3, " \\$5 y 5\\% de $a_1$").when(k == 4, " a_1 × \\textasciicircum{}2 $").otherwise(" Opciones:")
    options = F.when(d % 4 == 0, "£A) 1").when(d % 4 == 1, "").otherwise(_GOOD_OPTIONS)
    late = F.when(d % 9 == 4, own).otherwise("")
    item = F.concat(head, tags, F.lit(" "), F.coalesce("text", F.lit("")), fault, options, late)
    return t("documents").select("doc_id", item.alias("c")).select("doc_id", rendered.rendered_issues(F.col("c"), d, d % 2 == 0).alias("codes"))


#: Leads of the texts of F23, each with its own fault or none.
_LEADS = (
    "[Imagen=1] ", "[[Imagen=1]] [[Imagen=2]] ", "[[Imagen=1]] ", "[[Imagen=1] ", "[CONT.] [[Imagen=img-continuacion]] ", "<3.> [[imagen = IMG-continuacion ]] ",
    "[CONT.] <4.> [[Imagen=img-continuacion]] ",
)


@query(
    "F23_image_tags",
    rf"""with d as (select doc_id, case when doc_id % 19 = 0 then '' else trim(case doc_id % 7 {' '.join(f"when {i} then '{x}'" for i, x in enumerate(_LEADS))} end || coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) end s from documents),
n as (select *, list_transform(regexp_extract_all(s, '(?i)\[\[?\s*Imagen\s*=\s*([^\]]+?)\]?\]', 1), lambda x: lower(trim(x))) names from d)
select doc_id, list_filter([case when s = '' then 'empty_text' end, case when regexp_matches(s, '(?i)(^|[^\[])\[\s*Imagen\s*=\s*[^\]]+\]([^\]]|$)') then 'etiqueta_imagen_con_un_corchete' end,
  case when len(names) <> len(regexp_extract_all(s, '(?i)\[\[\s*Imagen\s*=\s*[^\]]+\]\]')) then 'etiqueta_imagen_mal_formada' end,
  case when list_contains(names, 'img-continuacion') and not (regexp_matches(s, '(?i)^\s*\[CONT\.\]') and not regexp_matches(s, '<\s*\d{{1,4}}\s*\.\s*>')) then 'img-continuacion_en_problema_numerado_o_no_cont' end,
  case when len(names) > 1 then 'multiples_etiquetas_imagen_en_registro' end], lambda x: x is not null) codes from n""",
)
def f23(t):  # noqa: ANN001, ANN201
    return image_tags(t("documents"))


def image_tags(docs):  # noqa: ANN001, ANN201
    """Whole texts with tags put ahead of them."""
    lead = F.get(F.array(*map(F.lit, _LEADS)), (F.col("doc_id") % 7).cast("int"))
    s = F.when(F.col("doc_id") % 19 == 0, "  ").otherwise(F.concat(lead, F.coalesce("text", F.lit(""))))
    return docs.select("doc_id", s.alias("s")).select("doc_id", items.image_tag_issues(F.col("s")).alias("codes"))


@query(
    "F24_key_page_score",
    rf"""with p as (select page_id, case when page_id % 7 = 0 then 'hoja-claves' else 'pagina' end stem, trim(case when page_id % 11 = 0 then E'Clave:\n1 A, 2) B;; 3.C | 4 D,, 5 E; 6 A ' when page_id % 11 = 1 then 'rpta 1 A ; 2 B . ' else '' end
  || regexp_replace(html, '<[^>]*>', ' ', 'g'), E' \t\n') x from pages),
n as (select *, len(regexp_extract_all(x, '{classify.KEY_PAIR}')) pairs, len(regexp_extract_all(x, '{classify.KEY_WORD}')) words, len(regexp_extract_all(lower(x), '{classify.KEY_LETTER}')) letters from p),
s as (select page_id, round(case when stem = 'hoja-claves' then 0.55 else 0 end + case when regexp_matches(x, '{classify.KEY_WORDS}') then 0.45 else 0 end
  + case when pairs >= 6 then 0.55 when pairs >= 4 then 0.45 when pairs >= 2 then 0.2 else 0 end + case when regexp_matches(x, '{classify.KEY_TITLE}') then 0.25 else 0 end
  + case when len(regexp_extract_all(x, '{classify.KEY_ROW}')) >= 6 then 0.35 else 0 end + case when letters >= 4 and letters / greatest(words, 1) > 0.28 then 0.2 else 0 end, 6) score from n)
select page_id, cast(least(score, 1) as double) confidence, score >= 0.75 is_key from s""",
)
def f24(t):  # noqa: ANN001, ANN201
    """Pages without their tags, some led by rows of answers or named as key sheets."""
    k = F.col("page_id")
    lead = F.when(k % 11 == 0, "Clave:\n1 A, 2) B;; 3.C | 4 D,, 5 E; 6 A ").when(k % 11 == 1, "rpta 1 A ; 2 B . ").otherwise("")
    found = classify.key_sheet(F.concat(lead, F.regexp_replace("html", "<[^>]*>", " ")), F.when(k % 7 == 0, "Hoja-Claves").otherwise("pagina"))
    return t("pages").select("page_id", found.alias("s")).select("page_id", "s.confidence", "s.is_key")


@query("F25_key_routing", "select page_id % 11 = 0 as key_sheet, count(*) n from pages group by 1")
def f25(t):  # noqa: ANN001, ANN201
    """Two frames, skipped and processed, counted."""
    p = t("pages").withColumn("key_sheet", F.col("page_id") % 11 == 0)
    return p.where("key_sheet").unionByName(p.where("not key_sheet")).groupBy("key_sheet").agg(F.count("*").alias("n"))


@query(
    "F26_token_search",
    """select p_partkey from (select p_partkey, lower(p_name) n from part) where contains(n, 'ed a')
  or (len(list_filter(string_split(n, ' '), lambda x: contains(x, 'ed'))) > 0 and len(list_filter(string_split(n, ' '), lambda x: contains(x, 'a'))) > 0)""",
)
def f26(t):  # noqa: ANN001, ANN201
    """The whole query, or every one of its tokens, in the name."""
    return t("part").where(classify.fuzzy_search(F.col("p_name"), F.lit("Éd  A"))).select("p_partkey")


@query(
    "F26_similar_search",
    """select p_partkey from (select p_partkey, p_partkey % 4 k, lower(p_name) n from part)
where case k when 0 then contains(n, 'widget') when 1 then contains(n, 'gizmo') and contains(n, 'small') when 2 then false else contains(n, 'ring') end""",
)
def f26_similar(t):  # noqa: ANN001, ANN201
    """Misspelt words that only similarity finds (ratio 0.83, 0.91), one that is too far off (0.67), and a plain one."""
    k = F.col("p_partkey") % 4
    asked = F.when(k == 0, "wodget").when(k == 1, "Gizzmo SMALL").when(k == 2, "wodgat").otherwise("ring")
    return t("part").where(classify.fuzzy_search(F.col("p_name"), asked)).select("p_partkey")


@query("F27_readiness", "select l_orderkey, count(*) filter (where l_linestatus = 'F') ready, count(*) n from lineitem group by 1 having count(*) filter (where l_linestatus = 'F') < count(*)")
def f27(t):  # noqa: ANN001, ANN201
    """Sessions with not every row ready."""
    s = t("lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_linestatus") == "F").alias("ready"), F.count("*").alias("n"))
    return s.where("ready < n")


_BOOKS_SQL = """from orders o left join (select l_orderkey, count(*) filter (where l_linestatus = 'F') ready, count(*) n from lineitem group by 1) on l_orderkey = o_orderkey"""


@query(
    "F27_session_browser",
    f"select o_orderkey {_BOOKS_SQL} where o_orderstatus = 'O' and o_orderpriority = '4-NOT SPECIFIED' and coalesce(ready, 0) > 0",
)
def f27_browser(t):  # noqa: ANN001, ANN201
    """Books by four fields, two of them open, in another spelling than theirs, and with some row ready."""
    wanted = {"o_orderstatus": " o ", "o_orderpriority": "4 not_Specified", "o_custkey": "Todos", "o_totalprice": "TODOS"}
    return reports.browsed(t("orders"), t("lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", F.col("l_linestatus") == "F", wanted, "listo").select("o_orderkey")


@query("F27_session_pending", f"select o_orderkey {_BOOKS_SQL} where o_orderpriority = '1-URGENT' and coalesce(ready, 0) < coalesce(n, 0)")
def f27_pending(t):  # noqa: ANN001, ANN201
    """Books of one kind whose rows are not all ready."""
    lines = t("lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return reports.browsed(t("orders"), lines, "o_orderkey", F.col("l_linestatus") == "F", {"o_orderpriority": "1 URGENT", "o_orderstatus": "todos"}, "pendiente").select("o_orderkey")
