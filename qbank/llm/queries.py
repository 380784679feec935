"""The subpackage's queries: the operators over their whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qbank.llm import (
    embedding_dedup,
    html_extract,
    importance,
    line_dedup,
    ngram_join,
    packing,
    pii,
    quality_rules,
    sentencepiece_nbest,
    suffix_dedup,
    token_output,
    url_filter,
    whitening,
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(read(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_lines", "n_removed", F.length("deduped_text").cast("long").alias("left_chars"), F.md5("deduped_text").alias("left_md5")
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pieces(read(spark, sf_dir, "documents"), with_ids=False)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_nbest.digest(read(spark, sf_dir, "documents"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components_of(read(spark, sf_dir, "documents"))


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.pieces(token_output.with_positions(token_output.sequences(read(spark, sf_dir, "documents"))))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.dedup(read(spark, sf_dir, "embeddings"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_chars", "kept"
    )


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.pseudonymise(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("private_text").alias("text"), "n_private")


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(read(spark, sf_dir, "pages"))


#: Production rules of the url query.
POLICY = url_filter.Policy(
    block_rules=("net/", "example.com/de/"),
    allow_rules=("example.net/en/", "org/fr/"),
    block_hosts=("cheap-pills.example.com", "spam-farm.example.org", "casino-win.example.net"),
)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, POLICY).select("page_id", "host", "path", "rule", "verdict")


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "_row.doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_packing": op2_packing,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_ngram_join": op4_ngram_join,
    "op5_token_output": op5_token_output,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_pii": op8_pii,
    "op9_html_extract": op9_html_extract,
    "op10_url_filter": op10_url_filter,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_whitening": op12_whitening,
    "op13_importance": op13_importance,
}

_RULES = quality_rules.Rules()
_PHRASE = " or ".join("contains(lower(l), '{}')".format(p.replace("'", "''")) for p in _RULES.phrases)

_SPREAD = line_dedup.Spread()
ORACLE: dict[str, str] = {
    "op1_line_dedup": rf"""
with l as (select doc_id, coalesce(source, '') s, unnest(string_split(text, chr(10))) line,
        unnest(range(0, len(string_split(text, chr(10))))) i from documents where text is not null),
k as (select *, regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') t from l),
w as (select t, min((doc_id, i)) first from k where t <> '' group by t having count(distinct s) >= {_SPREAD.min_sites}),
o as (select doc_id, i, line, w.t is not null and (doc_id, i) <> w.first gone from k left join w using (t))
select doc_id, cast(count(*) as bigint) n_lines, cast(count(*) filter (where gone) as bigint) n_removed,
  cast(length(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as bigint) left_chars,
  md5(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) left_md5
from o group by doc_id
union all select doc_id, 0, 0, null, null from documents where text is null""",
    "op7_quality_rules": rf"""
with d as (select doc_id, coalesce(text, '') t from documents),
w as (select doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') ws, string_split(t, chr(10)) ls from d),
g as (select doc_id, i, ws[i] || chr(0) || ws[i + 1] || chr(0) || ws[i + 2] as g
      from (select doc_id, ws, unnest(range(1, len(ws) - 1)) i from w)),
r as (select doc_id, count(distinct i + k) n from
        (select doc_id, i from (select *, count(*) over (partition by doc_id, g) c from g) where c > 1), (values (0), (1), (2)) v(k)
      group by doc_id),
l as (select doc_id, l, i, length(regexp_replace(l, '[\x20\x09-\x0D]', '', 'g')) c, trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) bare,
        len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) n from (select doc_id, unnest(ls) l, unnest(range(len(ls))) i from w)),
x as (select *, c > 0 and (n > {_RULES.run_words} or length(bare) > {_RULES.run_chars} or contains('{quality_rules.END_MARKS}', right(bare, 1))) other from l),
y as (select *, count(*) filter (where other) over (partition by doc_id order by i) part from x),
m as (select *, not other and c > 0 and count(*) filter (where not other and c > 0) over (partition by doc_id, part) >= {_RULES.min_run} menu from y),
f as (select doc_id, c, l, c > 0 and (menu or {_PHRASE}
        or len(regexp_extract_all(l, '[#*$%&|<>]')) * 100 > c * {_RULES.max_symbol_percent}
        or (len(regexp_extract_all(l, '[|»›]')) >= {_RULES.min_bars} and len(regexp_extract_all(l, '[|»›]')) * 8 >= n)
        or len(regexp_extract_all(l, '!!(\s|$)')) * 100 > n * {_RULES.max_shout_percent}
        or (n >= {_RULES.long_line_words} and not regexp_matches(l, '[.!?…:;。！？]'))) bad from m),
s as (select doc_id, sum(c) chars, coalesce(sum(c) filter (where bad), 0) lost,
        count(*) filter (where c > 0) - count(distinct l) filter (where c > 0) dup from f group by doc_id),
o as (select doc_id, cast(len(ws) as bigint) n_words, cast(chars as bigint) word_chars,
        cast(len(regexp_extract_all(t, '[#*$%&|<>]')) as bigint) n_symbols, cast(dup as bigint) n_dup_lines,
        cast(coalesce(n, 0) as bigint) n_repeat_words, cast(lost as bigint) lost_chars
      from w join s using (doc_id) left join r using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {_RULES.min_words} or 100 * n_repeat_words > {_RULES.max_repeat_percent} * n_words as base_failed, lost_chars,
  not (n_words < {_RULES.min_words} or 100 * n_repeat_words > {_RULES.max_repeat_percent} * n_words)
    and 100 * lost_chars <= {_RULES.max_lost_percent} * word_chars as kept
from o""",
    "op10_url_filter": r"""
with u as (select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end r from pages),
p as (select page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
        regexp_extract(r, '^[^/?#]*([^?#]*)', 1) path from u),
q as (select *, '.' || host d from p),
m as (select *, case when d like '%.example.net' and path like '/en/%' then 'example.net/en/'
    when d like '%.example.com' and path like '/de/%' then 'example.com/de/'
    when d like '%.org' and path like '/fr/%' then 'org/fr/'
    when d like '%.net' and path like '/%' then 'net/' end rule from q)
select page_id, host, path, rule, case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow'
  when d like '%.cheap-pills.example.com' or d like '%.spam-farm.example.org' or d like '%.casino-win.example.net' then 'block'
  else 'allow' end verdict from m""",
    "op11_suffix_dedup": """
with d as (select row_number() over () r, doc_id, encode(coalesce(text, '')) b from documents),
w as (select r, i, md5(b[i + 1:i + 400]) m from (select r, b, unnest(range(octet_length(b) - 399)) i from d)),
h as (select r, i, i > coalesce(lag(i) over (partition by r order by i), -500) + 400 start
      from (select r, i, count(*) over (partition by m) c from w) where c > 1),
s as (select r, min(i) f, max(i) + 400 t from (select *, sum(start::int) over (partition by r order by i) g from h) group by r, g),
c as (select r, f, t from s union all select r, octet_length(b), octet_length(b) from d),
k as (select c.r, f, t, b[coalesce(lag(t) over (partition by c.r order by f, t), 0) + 1:f] piece from c join d using (r)),
o as (select r, sum(t - f) gone, count(*) - 1 n, sha256(unhex(string_agg(hex(piece), '' order by f, t))) sha from k group by r)
select doc_id, octet_length(b)::bigint n_bytes, gone::bigint n_removed, n::bigint n_spans, sha kept_sha256 from d join o using (r)""",
    "op13_importance": r"""
with f as (select 0 corpus, row_number() over () r, doc_id, coalesce(text, '') t from documents
      union all select 1, row_number() over (), null, coalesce(text, '') from benchmark),
w as (select corpus, r, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) w from f),
b as (select w, xor(list_reduce([4294967295::ubigint] || list_transform(range(1, octet_length(encode(w)) + 1), lambda i: ('0x' || hex(encode(w)[i:i]))::ubigint),
      lambda a, x: list_reduce([xor(a, x), 1, 1, 1, 1, 1, 1, 1, 1], lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295) % 10000 b
      from (select distinct w from w)),
x as (select corpus, r, b from w join b using (w)),
n as (select b, count(*) filter (where corpus = 0)::double s, count(*) filter (where corpus = 1)::double t from x group by b),
a as (select coalesce(sum(s), 0) + 10000 sa, coalesce(sum(t), 0) + 10000 ta from n),
g as (select b, floor(1000 * ln(((t + 1) * sa) / ((s + 1) * ta)))::bigint g from n, a),
v as (select r, count(*) n, sum(g)::bigint weight from x join g using (b) where corpus = 0 group by r),
e as (select doc_id, coalesce(n, 0) n_features, coalesce(weight, 0) weight, ('0x' || sha256('2024:' || coalesce(doc_id::varchar, ''))[1:8])::bigint h
      from f left join v using (r) where corpus = 0),
c as (select *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::bigint score from e),
o as (select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id) k from c)
select doc_id, n_features::bigint n_features, weight::bigint weight, score::bigint score,
  case when n_features >= 20 and k <= (select count(*) from c where n_features >= 20) * 10 // 100 then k end::bigint as rank from o""",
}
