"""Scalar functions over the driver tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from qbank.functions import candidates, classify, geometry, similarity, status, text
from qbank.plans.registry import query
from qbank.plans.sections import classify_sql, sections
from qbank.plans.windows import boxes

KEY = "lower(trim(regexp_replace(translate({0}, 'áéíóúüñàèìòùâêîôûäëïöçãõÁÉÍÓÚÜÑÀÈÌÒÙÂÊÎÔÛÄËÏÖÇÃÕ', 'aeiouunaeiouaeiouaeiocaoAEIOUUNAEIOUAEIOUAEIOCAO'), '\\s+', ' ', 'g')))"


# The keys of every whole text, as checksums.


@query("S1_text_key", f"select doc_id, md5({KEY.format('text')}) k from documents")
def s1(t):  # noqa: ANN001, ANN201
    return t("documents").select("doc_id", F.md5(text.text_key(F.col("text"))).alias("k"))


@query("S2_vowel_key", "select doc_id, md5(lower(translate(trim(text), 'ÁÉÍÓÚÜáéíóúü', 'AEIOUUaeiouu'))) k from documents")
def s2(t):  # noqa: ANN001, ANN201
    return t("documents").select("doc_id", F.md5(text.vowel_key(F.col("text"))).alias("k"))


@query("S3_search_key", f"select doc_id, md5(trim(regexp_replace({KEY.format('text')}, '[^a-z0-9]+', ' ', 'g'))) k from documents")
def s3(t):  # noqa: ANN001, ANN201
    return t("documents").select("doc_id", F.md5(text.search_key(F.col("text"))).alias("k"))


@query("S4_slug", "select p_partkey, coalesce(nullif(regexp_replace(regexp_replace(lower(trim(p_type)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'origen') slug from part")
def s4(t):  # noqa: ANN001, ANN201
    return t("part").select("p_partkey", text.slug(F.col("p_type")).alias("slug"))


@query("S11_single_line", "select doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) line from documents")
def s11(t):  # noqa: ANN001, ANN201
    return t("documents").select("doc_id", F.md5(text.single_line(F.col("text"))).alias("line"))


def _trigram_sql(c: str) -> str:
    words = f"list_filter(string_split_regex(lower({c}), '[^a-z0-9áéíóúüñ]+'), lambda w: w <> '')"
    return f"list_distinct(flatten(list_transform({words}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query(
    "S12_trigram_similarity",
    f"""with n as (select p_partkey, p_name a, lead(p_name) over (order by p_partkey) b from part), g as (select p_partkey, {_trigram_sql("a")} a, {_trigram_sql("b")} b from n where b is not null)
select p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) s from g""",
)
def s12(t):  # noqa: ANN001, ANN201
    """Each part's name against the next part's."""
    p = t("part").select("p_partkey", "p_name")
    other = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("o"))
    s = similarity.trigram_similarity(similarity.trigrams(F.col("p_name")), similarity.trigrams(F.col("o")))
    return p.join(other, "p_partkey").select("p_partkey", F.round(s, 6).alias("s"))


@query("S14_edit_distance", "select p_partkey, levenshtein(p_name, p_type) d from part")
def s14(t):  # noqa: ANN001, ANN201
    return t("part").select("p_partkey", F.levenshtein("p_name", "p_type").alias("d"))


@query("S15_metric_text", "select doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'))) m from documents")
def s15(t):  # noqa: ANN001, ANN201
    return t("documents").select("doc_id", F.md5(text.metric_text(F.col("text"))).alias("m"))


_FRAGMENT = """select *, {key_a} ka, {key_b} kb from (select p_partkey, case when p_partkey % 7 = 5 then 'área de f(x) y g (y) ' || p_name else p_name end a,
  case p_partkey % 7 when 0 then '  ' when 1 then p_name || ' Y más palabras' when 2 then array_to_string(string_split(p_name, ' ')[1:2], ' ') when 3 then p_name || '.'
  when 4 then p_type when 5 then 'otra area F (X) ' || p_name || ' junto con ' || lower(p_type) else reverse(p_name) end b from part)""".format(
    key_a=KEY.format("trim(a)"), key_b=KEY.format("trim(b)")
)


@query(
    "S18_merge_fragments",
    rf"""with k as ({_FRAGMENT}),
w as (select *, list_distinct(list_filter(regexp_extract_all(ka, '[a-z0-9\\]+'), lambda x: length(x) > 1 or x in ('x', 'y', 'f', 'g', 'h'))) ta,
  list_distinct(list_filter(regexp_extract_all(kb, '[a-z0-9\\]+'), lambda x: length(x) > 1 or x in ('x', 'y', 'f', 'g', 'h'))) tb,
  list_transform(regexp_extract_all(a, '[A-Za-z]\s*\([^)]{{0,16}}\)'), lambda x: lower(x)) aa, list_transform(regexp_extract_all(b, '[A-Za-z]\s*\([^)]{{0,16}}\)'), lambda x: lower(x)) ab from k),
h as (select *, len(list_intersect(ta, tb)) / nullif(least(len(ta), len(tb)), 0) share from w)
select p_partkey, case when ka = '' then trim(b) when kb = '' or contains(ka, kb) then trim(a)
  when contains(kb, ka) and length(kb) > floor(1.1 * length(ka)) then trim(b) when share >= 0.72 or (list_has_any(aa, ab) and share >= 0.55) then trim(a)
  else trim(a) || ' ' || trim(b) end m from h""",
)
def s18(t):  # noqa: ANN001, ANN201
    """Names with variants of themselves: blank, longer, shorter, nearly as long, another text, a shared anchor."""
    k, n, typ = F.col("p_partkey") % 7, F.col("p_name"), F.col("p_type")
    a = F.when(k == 5, F.concat(F.lit("área de f(x) y g (y) "), n)).otherwise(n)
    short = F.array_join(F.slice(F.split(n, " "), 1, 2), " ")
    b = F.when(k == 0, "  ").when(k == 1, F.concat(n, F.lit(" Y más palabras"))).when(k == 2, short).when(k == 3, F.concat(n, F.lit("."))).when(k == 4, typ)
    b = b.when(k == 5, F.concat(F.lit("otra area F (X) "), n, F.lit(" junto con "), F.lower(typ))).otherwise(F.reverse(n))
    return t("part").select("p_partkey", a.alias("a"), b.alias("b")).select("p_partkey", text.merge_fragments(F.col("a"), F.col("b")).alias("m"))


def _noise_sql() -> str:
    n = lambda c, x: f"(length({c}) - length(replace({c}, '{x}', '')))"
    label = r"'(^|[^A-Za-z0-9])[A-Ea-e]\)\s*', '\1', 'g'"
    return f"""select doc_id, {' + '.join(n('text', x) for x in ('Ã', 'â', 'Ë', chr(0xFFFD)))} mojibake, abs({n('p', '(')} - {n('p', ')')}) + abs({n('p', '[')} - {n('p', ']')}) + abs({n('p', '{')} - {n('p', '}')}) imbalance,
  len(w) >= 40 and len(list_distinct(w)) < 0.25 * len(w) few_words
from (select doc_id, text, regexp_replace(regexp_replace(text, {label}), {label}) p, regexp_extract_all(lower(coalesce(text, '')), '[A-Za-zÁÉÍÓÚáéíóúÑñ0-9]+') w from documents)"""


@query("S22_text_noise", _noise_sql())
def s22(t):  # noqa: ANN001, ANN201
    c = F.col("text")
    return t("documents").select("doc_id", text.mojibake(c).alias("mojibake"), text.imbalance(c).alias("imbalance"), text.few_words(c).alias("few_words"))


@query("S22_repetitive")
def s22_repetitive(t):  # noqa: ANN001, ANN201
    """No SQL of this kind has back-references; tested by hand."""
    return t("documents").where(text.repetitive(F.col("text"))).select("doc_id")


_ADDED = (r" \overline{x}", r" \sqrt{2} √", r" \frac{1}{2}", " no incluyas nada. Respuesta: ", " ((([", " Ã Ã")


def _readings(t):  # noqa: ANN001, ANN202
    """Whole documents as readings of pages: numbers, items and options by the id, so that every step of the ladders occurs."""
    d = F.col("doc_id")
    k, j, h, start = d % 7, d % 5, d % 11, 1 + d % 29
    raw = F.coalesce("text", F.lit(""))
    added = F.lit("")
    for i, x in enumerate(_ADDED, 1):
        added = F.when(d % 13 == i, x).otherwise(added)
    raw = F.when(d % 17 == 0, "  ").otherwise(F.concat(raw, added))
    long = lambda *x: F.array(*(c if isinstance(c, Column) else F.lit(c) for c in x)).cast("array<bigint>")
    numbers = F.when(k == 1, long(start)).when(k == 2, long(start, start + 1)).when(k == 3, long(start + 2, start + 3)).when(k == 4, long(1, 2, 3))
    numbers = numbers.when(k == 5, long(start, start + 3)).when(k == 6, long(2)).otherwise(F.array().cast("array<bigint>"))
    items = F.size(numbers) + F.when(j == 4, 1).otherwise(0)
    rows = t("documents").select(
        "doc_id", raw.alias("raw"), numbers.alias("numbers"), items.alias("items"), start.alias("start"),
        F.when(j == 0, items).when(j == 2, F.least(items, F.lit(1))).otherwise(0).alias("complete"),
        F.when(j == 0, 5 * items).when(j == 1, 2).when(j == 2, 5).when(j == 3, 4).otherwise(0).alias("labels"),
        (h % 3).alias("headers"), (h % 5).alias("leading"), F.when(h % 2 == 0, "x").otherwise("").alias("continuation"),
        F.when(d % 3 == 0, "Radicación").otherwise("Álgebra").alias("topic"),
    )
    c = F.col
    names = ("numbers", "items", "complete", "labels", "headers", "leading", "continuation", "start", "topic")
    return rows.select("doc_id", candidates.measured(candidates.Reading(c("raw"), *map(c, names), repeated=text.few_words(c("raw")))).alias("m"))


def _readings_sql() -> str:
    n = lambda c, x: f"(length({c}) - length(replace({c}, '{x}', '')))"
    label = r"'(^|[^A-Za-z0-9])[A-Ea-e]\)\s*', '\1', 'g'"
    phrases = " + ".join(f"contains(low, '{p}')::int" for p in candidates.PROMPT_PHRASES)
    added = " ".join(f"when {i} then '{x}'" for i, x in enumerate(_ADDED, 1))
    return rf"""with d as (select doc_id, doc_id % 7 k, doc_id % 5 j, doc_id % 11 h, 1 + doc_id % 29 s,
  case when doc_id % 17 = 0 then '' else trim(coalesce(text, '') || case doc_id % 13 {added} else '' end, ' ' || chr(9) || chr(10) || chr(13)) end raw from documents),
e as (select *, lower(raw) low, case k when 1 then [s] when 2 then [s, s + 1] when 3 then [s + 2, s + 3] when 4 then [1, 2, 3] when 5 then [s, s + 3] when 6 then [2] else [] end::bigint[] ns from d),
f as (select *, len(ns) + case when j = 4 then 1 else 0 end items from e),
g as (select *, case j when 0 then items when 2 then least(items, 1) else 0 end complete, case j when 0 then 5 * items when 1 then 2 when 2 then 5 when 3 then 4 else 0 end labels,
  h % 3 headers, h % 5 ahead, len(ns) n, ns[1] num, regexp_replace(regexp_replace(raw, {label}), {label}) p, regexp_extract_all(low, '[A-Za-zÁÉÍÓÚáéíóúÑñ0-9]+') w from f),
i as (select *, items <= 0 and (h % 2 = 0 or ahead >= 3) continued, n > 0 and ns = range(num, num + n) in_a_row,
  coalesce(s >= 20 and num < s and num <= 15 and items > 0 and (complete > 0 or labels >= 3) and (n >= 2 or num = 1 or (complete >= 1 and labels >= 5)), false) restart,
  {phrases} >= 2 echo, len(w) >= 40 and len(list_distinct(w)) < 0.25 * len(w) rep, {' + '.join(n('raw', x) for x in text.MOJIBAKE)} moji,
  abs({n('p', '(')} - {n('p', ')')}) + abs({n('p', '[')} - {n('p', ']')}) + abs({n('p', '{')} - {n('p', '}')}) imb from g),
m as (select *, case when restart then n when k in (1, 5) then 1 when k = 2 then 2 when k = 4 and s = 1 then 3 when k = 6 and s = 2 then 1 else 0 end prefix from i),
z as (select *, continued or (items > 0 and prefix > 0 and n = items and complete >= items) strong from m)"""


def _codes_sql(*of: tuple[str, str]) -> str:
    return "list_filter([" + ", ".join(f"case when {when} then '{code}' end" for code, when in of) + "], lambda x: x is not null)"


_SCORE_SQL = r"""(case when raw <> '' then 5 else 0 end + case when items > 0 then 22 when continued then 18 else -40 end + case when in_a_row and num = s then 26 when in_a_row then 16 else 0 end
 + case when n = 0 then 0 when num = s then 12 when restart then 10 when num < s then -18 else 0 end + case when headers > 0 then 10 when continued then 6 else 0 end
 + case when complete > 0 then 6 * complete when labels > 0 then least(8, labels) when ahead > 0 then least(6, ahead) else 0 end - case when echo then 100 else 0 end
 - case when rep and not (items > 0 and n = items and complete = items) then 60 else 0 end - least(36, 6 * moji) - least(20, 4 * imb) - case when contains(raw, '\overline') then 10 else 0 end
 - case when (contains(raw, '\sqrt') or contains(raw, '√')) and doc_id % 3 <> 0 then 8 else 0 end
 + case when moji = 0 and regexp_matches(raw, '\\(frac|sqrt|left|right|cdot|times|pi|theta|alpha|beta|gamma|delta)\b') then 4 else 0 end)"""
_BACKWARD = "n > 0 and num < s and not restart"
_INVALID_SQL = _codes_sql(
    ("vacio", "raw = ''"), ("echo_prompt", "echo"), ("mojibake", "moji >= 2 or (moji > 0 and not strong)"), ("delimitadores_graves", "imb >= 4 and not strong"),
    ("sin_items", "items <= 0 and not continued"), ("sin_numeracion_recuperable", "items > 0 and n = 0 and headers = 0"),
    ("cobertura_inicial_insuficiente", "items > 0 and (n > 0 or headers > 0) and prefix = 0"),
    ("arranque_regresivo", f"items > 0 and prefix > 0 and {_BACKWARD}"), ("opciones_incompletas", "items > 0 and labels > 0 and complete <= 0 and not (prefix > 0 and labels >= 3)"),
)
_UNRECOVERABLE_SQL = _codes_sql(
    ("vacio", "raw = ''"), ("echo_prompt", "echo"), ("mojibake_grave", "moji >= 4 and not strong"), ("sin_items", "items <= 0 and not continued"),
    ("sin_numeracion_recuperable", "items > 0 and n = 0 and headers = 0"),
    ("arranque_regresivo", f"items > 0 and {_BACKWARD} and not (n = items and complete >= items and in_a_row and moji < 2 and imb < 6)"),
    ("sin_cobertura_opciones", "items > 0 and complete <= 0 and labels < 3"), ("delimitadores_graves", "items > 0 and imb >= 6 and prefix <= 0 and not strong"),
)


@query("S23_candidate_score", f"{_readings_sql()} select doc_id, {_SCORE_SQL}::bigint score from z")
def s23(t):  # noqa: ANN001, ANN201
    """Additive bonuses and penalties; of S22's repetition its part that SQL can say."""
    return _readings(t).select("doc_id", candidates.score(F.col("m")).cast("bigint").alias("score"))


@query(
    "S24_candidate_validity",
    f"""{_readings_sql()}, v as (select doc_id, {_SCORE_SQL} score, {_INVALID_SQL} invalid, {_UNRECOVERABLE_SQL} unrecoverable from z)
select doc_id, invalid, unrecoverable, case when len(invalid) = 0 and score < 80 then ['score<80'] else invalid end not_fast from v""",
)
def s24(t):  # noqa: ANN001, ANN201
    m = F.col("m")
    return _readings(t).select(
        "doc_id", candidates.invalid(m).alias("invalid"), candidates.unrecoverable(m).alias("unrecoverable"), candidates.not_fast(m).alias("not_fast")
    )


@query("S27_small_number", "select p_partkey, case when p_size % 10 between 3 and 5 then p_size % 10 when p_size between 3 and 5 then p_size else p_size + 100 end n from part")
def s27(t):  # noqa: ANN001, ANN201
    return t("part").select("p_partkey", text.small_number(F.col("p_size") + 100, F.lit(3)).alias("n"))


@query("S28_section_classifier", classify_sql())
def s28(t):  # noqa: ANN001, ANN201
    """The course decides, else weighted keywords; ties by name."""
    return sections(t("part")).select("p_partkey", "s.section", "s.confidence")


@query(
    "S29_simple_section",
    """select p_partkey, case when p_partkey % 9 = 0 then 'Fisica' when p_partkey % 7 in (0, 1) then 'Geometria' when p_partkey % 7 = 2 then 'Trigonometria' when p_partkey % 7 = 3 then 'Aritmetica'
  when p_partkey % 7 = 4 then 'Algebra' else 'General' end section from part""",
)
def s29(t):  # noqa: ANN001, ANN201
    """A given section counts; accents hide a sign, as in the reference's plain case folding."""
    k = F.col("p_partkey")
    book = F.when(k % 7 == 0, "GEOMETRÍA-2").when(k % 7 == 1, "La Circunferencia y trigonometria").when(k % 7 == 2, "Trigonometría, aritmetica").when(k % 7 == 3, "ARITMETICA").when(k % 7 == 4, "Polinomios")
    book = book.when(k % 7 == 5, "Álgebra")
    return t("part").select("p_partkey", classify.simple_section(F.when(k % 9 == 0, " Fisica ").otherwise(" "), book, F.col("p_size")).alias("section"))


@query("S30_stable_split", "select doc_id, case when s < 80 then 'train' when s < 90 then 'val' else 'test' end split from (select doc_id, cast(('0x' || substr(sha1(cast(doc_id as varchar)), 1, 8)) as bigint) % 100 s from documents)")
def s30(t):  # noqa: ANN001, ANN201
    return t("documents").select("doc_id", text.split_of(F.col("doc_id").cast("string"), ("train", "val", "test")).alias("split"))


@query("S31_stable_id", "select doc_id, substr(sha1(source || '|' || cast(doc_id as varchar)), 1, 16) id from documents")
def s31(t):  # noqa: ANN001, ANN201
    return t("documents").select("doc_id", text.stable_id(F.col("source"), F.col("doc_id")).alias("id"))


@query("S32_l2_distance", "select a.vec_id, round(sqrt(list_sum(list_transform(list_zip(a.e, b.e), lambda z: power(z[1] - z[2], 2)))), 6) d from (select vec_id, cast(embedding as double[]) e from embeddings) a join (select vec_id - 1 vec_id, cast(embedding as double[]) e from embeddings) b using (vec_id)")
def s32(t):  # noqa: ANN001, ANN201
    e = t("embeddings")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("o"))
    return e.join(other, "vec_id").select("vec_id", F.round(similarity.l2_distance(F.col("embedding"), F.col("o")), 6).alias("d"))


BOX = "select l_orderkey page, l_linenumber id, cast(l_partkey % 180 as integer) x1, cast(l_suppkey % 80 as integer) y1, x1 + cast(floor(l_quantity) as integer) + 10 x2, y1 + cast(floor(l_quantity) as integer) + 10 y2 from lineitem"


@query("S33_overlap", f"select page, id, round(w * h / (2.0 * (x2 - x1) * (y2 - y1) - w * h), 6) iou, 7 shift from (select *, greatest(x2 - x1 - 7, 0) w, greatest(y2 - y1 - 2, 0) h from ({BOX}))")
def s33(t):  # noqa: ANN001, ANN201
    a = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    b = [a[0] + 7, a[1] + 2, a[2] + 7, a[3] + 2]
    return boxes(t).select("page", "id", F.round(geometry.iou(a, b), 6).alias("iou"), geometry.largest_shift(a, b).alias("shift"))


@query("S34_clamp_yolo", f"select page, id, least(x2, 200) x2c, printf('0 %.6f %.6f %.6f %.6f', (x1 + x2) / 2 / 200, (y1 + y2) / 2 / 100, (x2 - x1) / 200, (y2 - y1) / 100) line from ({BOX})")
def s34(t):  # noqa: ANN001, ANN201
    a = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    c = geometry.clamped(a, F.lit(200), F.lit(100))
    return boxes(t).select("page", "id", c[2].alias("x2c"), geometry.yolo_line(a, F.lit(200), F.lit(100)).alias("line"))


@query(
    "S36_status_alias",
    "select event_id, case event_type when 'purchase' then 'ready' when 'error' then 'error' when 'click' then 'processing' else 'pending' end status, case user_id % 4 when 0 then 'paginas' when 1 then 'boxes' when 2 then 'ocr' else '' end step from events",
)
def s36(t):  # noqa: ANN001, ANN201
    raw = F.when(F.col("event_type") == "purchase", " Listo").when(F.col("event_type") == "error", "FAILED").when(F.col("event_type") == "click", "procesando").otherwise("other")
    step = F.when(F.col("user_id") % 4 == 0, " PDF_pages ").when(F.col("user_id") % 4 == 1, "box_detection").when(F.col("user_id") % 4 == 2, "OCR")
    return t("events").select("event_id", status.normal_status(raw, status.STATUS_ALIASES).alias("status"), status.normal_step(step).alias("step"))


@query("S40_row_comparison", "select a.c_custkey, a.c_name is distinct from b.c_name or a.c_mktsegment is distinct from b.c_mktsegment as differs from customer a left join customer b on b.c_custkey = a.c_custkey + 1")
def s40(t):  # noqa: ANN001, ANN201
    c = t("customer").select("c_custkey", "c_name", "c_mktsegment")
    b = c.select((F.col("c_custkey") - 1).alias("c_custkey"), F.struct("c_name", "c_mktsegment").alias("o"))
    same = F.col("c_name").eqNullSafe(F.col("o.c_name")) & F.col("c_mktsegment").eqNullSafe(F.col("o.c_mktsegment"))
    return c.join(b, "c_custkey", "left").select("c_custkey", (~same).alias("differs"))


@query("S41_identity_key", "select doc_id, case when lang = 'en' then '' else source || '|' || lang || '|' || n_chars end k from documents")
def s41(t):  # noqa: ANN001, ANN201
    blank = F.trim(F.when(F.col("lang") == "en", "").otherwise(F.col("lang"))) == ""
    return t("documents").select("doc_id", F.when(~blank, F.concat_ws("|", "source", "lang", F.col("n_chars").cast("string"))).otherwise("").alias("k"))


@query("S42_snippet", "select doc_id, left(text, 240) s from documents")
def s42(t):  # noqa: ANN001, ANN201
    return t("documents").select("doc_id", text.snippet(F.col("text")).alias("s"))


@query("S43_safe_stem", "select p_partkey, regexp_replace(trim(p_type), '[^A-Za-z0-9._-]+', '_', 'g') stem from part")
def s43(t):  # noqa: ANN001, ANN201
    return t("part").select("p_partkey", text.safe_stem(F.col("p_type")).alias("stem"))


@query("S45_error_group", "select event_id, event_type || case when user_id % 2 = 0 then '' else ' #' end k from events")
def s45(t):  # noqa: ANN001, ANN201
    message = F.when(F.col("user_id") % 2 == 0, F.concat("event_type", F.lit(": at "), F.col("user_id").cast("string"))).otherwise(F.concat("event_type", F.lit(" "), F.col("user_id").cast("string")))
    return t("events").select("event_id", text.error_group(message).alias("k"))


@query("S46_error_entries", "select distinct user_id, event_type || '!' message from events where event_type in ('error', 'click')")
def s46(t):  # noqa: ANN001, ANN201
    own = F.array(F.when(F.col("event_type") == "error", "error!"), F.when(F.col("event_type") == "click", "click!"), F.when(F.col("event_type") == "error", "error!"))
    return t("events").select("user_id", F.explode(F.array_compact(own)).alias("message")).distinct()
