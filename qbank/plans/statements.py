"""Queries of statements, headers, roles, solution groups and profiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from qbank.functions import headers, statements, variants
from qbank.plans.registry import query
from qbank.tables import short_batches, spread


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def chosen(k: Column, of) -> Column:  # noqa: ANN001
    """The k-th of some texts, counting from nought."""
    out = F.lit(None).cast("string")
    for i, x in enumerate(of):
        out = F.when(k == i, x if isinstance(x, Column) else F.lit(x)).otherwise(out)
    return out


def chosen_sql(k: str, of) -> str:  # noqa: ANN001
    return f"case {k} " + " ".join(f"when {i} then {x}" for i, x in enumerate(of)) + " end"


# -- S25 ----------------------------------------------------------------------------------------------

#: What is put into a document's words, what a statement makes of it, its unknown characters and its warnings.
_STATEMENTS = (
    (" y ", " y ", "", ()),
    (" ∠ABC = 30° ", r" $\angle ABC = 30^\circ$ ", "", ()),
    (r" ecuaci\\'on ", r" ecuaci\'on ", "", ("accent_escape_canonicalized",)),
    (" ecuaciÃ³n ", r" ecuaci\'on ", "", ("accent_mojibake_fixed",)),
    (r" un mismo \angle, y ", r" un mismo \'angulo, y ", "", ("angle_word_restored",)),
    (r" \textit{ángulo \textbf{agudo}} ", r" \'angulo agudo ", "", ()),
    (r" \overline{OB} ", r" $\overline{OB}$", "", ()),
    (" 50% #_& ", r" 50\% \#\_\& ", "", ()),
    (" x $2 = 3 ", " x $2 = 3$ ", "", ("unbalanced_math_delimiters",)),
    (" $a ≤  b$ £ c ", r" $a \leq b$ c ", "", ()),
    (" C_{36}^{n-1} ", " $C_{36}^{n-1}$ ", "", ()),
    (r" \frac{1}{2} = \sqrt[3]{\frac{x}{y}} ", r" $\frac{1}{2} = \sqrt[3]{\frac{x}{y}}$", "", ()),
    (" 日 ", " 日 ", "日", ("unknown_symbols",)),
    (" [[ocr#dudoso]] ~ ", r" [[ocr#dudoso]] \textasciitilde{} ", "", ()),
    (r" \left( a \right) ", r" $\left( a \right)$ ", "", ()),
    (" x^2 ", " $x^2$ ", "", ("bare_exponent_wrapped",)),
    (" y £££ renglón ", r" y£rengl\'on ", "", ()),
    (" $$θ + α = π$$ ", r" $\theta + \alpha = \pi$ ", "", ()),
    (r" \frac{a}{b ", r" \frac\{a\}\{b ", "", ()),
    ("\n$x$\n", " $x$ ", "", ()),
    (r" m \angle ABC, si ", r" m$\angle ABC$, si ", "", ()),
)
#: The same for a rendered item.
_ITEMS = (
    (" y ", " y ", "", ()),
    (" $15°$æB)$ 27 ° $ ", r" $15^\circ$æB)$27^\circ$ ", "", ()),
    (" [[tema=∠ x]] £A) ", " [[tema=∠ x]] £A) ", "∠", ("unknown_symbols",)),
    (r" ecuaci\\'on Ã³ ", " ecuación ó ", "óó", ("accent_escape_canonicalized", "accent_mojibake_fixed", "unknown_symbols")),
    (" a $ b ", " a b ", "", ("unbalanced_math_delimiters",)),
    (" $$x ≠ y$$ £ ", r" $x \neq y$ £ ", "", ()),
    (" 50% ∞ [[Imagen=img-3]] ", r" 50% \infty [[Imagen=img-3]] ", "", ()),
    (" Sen x tg ", r" \sin x \tan ", "", ()),
    (" $ $ 日 ", " 日 ", "日", ("unknown_symbols",)),
)
_WORDS = "[^a-z]+"
_AROUND = ("dado que ", "fin del texto")


def _latex_sql(cases) -> str:  # noqa: ANN001
    k = f"doc_id % {len(cases)}"
    words = rf"regexp_replace(regexp_replace(w, '\bsen\b', '\\sin', 'g'), '\b(c?)tg\b', '\\\1', 'g')"  # no such word is in the texts but these
    return rf"""with d as (select doc_id, trim(regexp_replace(coalesce(text, ''), '{_WORDS}', ' ', 'g')) w from documents where doc_id is not null),
e as (select doc_id, '{_AROUND[0]}' || w || {chosen_sql(k, [quoted(c[0].replace(chr(10), '¶')) for c in cases])} || '{_AROUND[1]}' c,
  trim(regexp_replace('{_AROUND[0]}' || {words} || {chosen_sql(k, [quoted(c[1]) for c in cases])} || '{_AROUND[1]}', '\s+', ' ', 'g')) s, {k} k from d)
select doc_id, md5(s) s, replace(c, '¶', chr(10)) <> s changed, {chosen_sql('k', ["[" + ", ".join(map(quoted, sorted(set(c[2])))) + "]::varchar[]" for c in cases])} as "unknown",
  {chosen_sql('k', ["[" + ", ".join(map(quoted, c[3])) + "]::varchar[]" for c in cases])} warnings from e"""


def _latex(t, cases, normal):  # noqa: ANN001, ANN202
    words = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), _WORDS, " "))
    made = F.concat(F.lit(_AROUND[0]), words, chosen(F.col("doc_id") % len(cases), [c[0] for c in cases]), F.lit(_AROUND[1]))
    d = t("documents").where("doc_id is not null").select("doc_id", "text")
    short_batches(d.sparkSession)
    done = spread(d, "doc_id").select("doc_id", normal(made).alias("s"))
    return done.select("doc_id", F.md5("s.text").alias("s"), F.col("s.changed").alias("changed"), F.col("s.unknown").alias("unknown"), F.col("s.warnings").alias("warnings"))


@query("S25_statements", _latex_sql(_STATEMENTS))
def s25_statements(t):  # noqa: ANN001, ANN201
    """Statements of all the words of documents, with mathematics, damage and tags put in by id."""
    return _latex(t, _STATEMENTS, statements.statements)


@query("S25_items", _latex_sql(_ITEMS))
def s25_items(t):  # noqa: ANN001, ANN201
    """Rendered items of all the words of documents, with separators, tags and formulas put in by id."""
    return _latex(t, _ITEMS, statements.items)


@query("S25_latex_normalise")
def s25(t):  # noqa: ANN001, ANN201
    """Whole documents as they are, as statements; the rules' pattern language has no look-around in SQL."""
    d = t("documents").select("doc_id", "text")
    short_batches(d.sparkSession)
    done = spread(d, "doc_id", "text").select("doc_id", statements.statements(F.col("text")).alias("s"))
    return done.select("doc_id", F.md5("s.text").alias("s"), "s.unknown", "s.warnings", "s.changed")


# -- S20, S21 -----------------------------------------------------------------------------------------

_PAGES = (
    "", "<12.> Halle x\n< 13 > y", "③ Calcule ⑮ z ⑳ w ❿ b", "(7) uno\n [8] dos", "n. 8\nN. 9)\ntexto", "45\n\n 46 \nalgo", "3) Foo 4: bar 5. A) no 6] ¿sí? 7. e x",
    "12. dos\n12. tres\n0) cero\n12345. no", "ver 5.3 y 9 : cosa, (4)x",
)
_HEADERS_SQL = rf"""t0 as (select doc_id, regexp_replace({chosen_sql(f'doc_id % {len(_PAGES)}', [quoted(x) for x in _PAGES])} || chr(10) || coalesce(text, ''), '\r\n?', chr(10), 'g') c from documents where doc_id is not null),
t1 as (select doc_id, regexp_replace(regexp_replace(c, '(^|\s)<\s*(\d{{1,4}})\s*(?:\.\s*)?>', '\1\2. ', 'g'), '([{headers.CIRCLED}])', '\1. ', 'g') c from t0),
t2 as (select doc_id, {"".join("replace(" for _ in headers.CIRCLED)}c{"".join(f", '{x}', '{(i if i < 20 else i - 20) + 1}')" for i, x in enumerate(headers.CIRCLED))} c from t1),
t3 as (select doc_id, regexp_replace(c, '(?m)^(\s*)[(\[]\s*(\d{{1,4}})\s*[)\]](\s)', '\1\2. \3', 'g') c from t2),
t4 as (select doc_id, regexp_replace(regexp_replace(c, '(?im)^(\s*)n\.\s*(\d{{1,4}})\s*[.)]?\s*$', '\1\2. ', 'g'), '(?m)^(\s*)(\d{{1,4}})\s*$', '\1\2. ', 'g') c from t3),
t5 as (select doc_id, regexp_extract_all(c, '(?m)^\s*(\d{{1,4}})\s*[.)]\s', 1) a,
  regexp_extract_all(regexp_replace(regexp_replace(c, '\s', '  ', 'g'), '([A-Ea-e])(\s*[)\].:])', '§\2', 'g'), '(?:^|\s)(\d{{1,4}})\s*[\].:)]\s*[A-Za-zÀ-ÿ¿¡]', 1) b from t4),
t6 as (select doc_id, list_filter(list_transform(a || b, lambda x: x::integer), lambda x: x > 0) l from t5),
numbers as (select doc_id, list_filter(l, lambda x, i: list_position(l, x) = i) numbers from t6)"""


def _paged(t) -> tuple:  # noqa: ANN001
    d = spread(t("documents").where("doc_id is not null").select("doc_id", "text"), "doc_id")
    return d, headers.header_numbers(F.concat(chosen(F.col("doc_id") % len(_PAGES), _PAGES), F.lit("\n"), F.coalesce("text", F.lit(""))))


@query("S20_numbered_headers", f"with {_HEADERS_SQL} select doc_id, numbers from numbers")
def s20(t):  # noqa: ANN001, ANN201
    """Headers of whole documents, with every form of header put before them by id."""
    d, numbers = _paged(t)
    return d.select("doc_id", numbers.alias("numbers"))


@query(
    "S21_image_role",
    f"""with {_HEADERS_SQL},
m as (select doc_id d, doc_id % 13 = 0 as item, len(numbers) > 0 and doc_id % 3 > 0 as head, doc_id % 2 = 0 as pending, doc_id % 5 = 0 as keyed, doc_id % 7 = 1 as txt, doc_id % 7 in (2, 3) as opt,
  doc_id % 7 in (3, 4) as lab, doc_id % 7 in (4, 5) and doc_id % 11 > 3 as fig, doc_id % 4 = 0 as seg, doc_id % 17 = 0 as pre from numbers)
select d doc_id, case when item or head then case when pending and (txt or opt or lab or fig or pre) then 'continuation_plus_new_items' else 'new_items_only' end
  when pending and (txt or opt or lab or fig or pre or seg) then case when lab and not opt and not txt then 'continuation_labels_only' when fig and not (txt or opt or lab) then 'continuation_graphic_only'
    else 'continuation_only' end when keyed then 'pure_key_image' else 'unknown' end as role from m""",
)
def s21(t):  # noqa: ANN001, ANN201
    """Roles by the headers of whole documents (a third of the pages show none) and measures by id."""
    d, numbers = _paged(t)
    k = F.col("doc_id")
    count = lambda c: F.when(c, 2).otherwise(0)
    evidence = headers.Evidence(
        headers=F.when(k % 3 > 0, F.col("numbers")).otherwise(F.array().cast("array<int>")), pending=k % 2 == 0, key_candidate=k % 5 == 0, items=count(k % 13 == 0),
        continuation=F.when(k % 7 == 1, " y ").otherwise("  "), options=count((k % 7).isin(2, 3)), labels=count((k % 7).isin(3, 4)),
        figure=(k % 7).isin(4, 5) & (k % 11 > 3), segments=count(k % 4 == 0), pending_prefix=k % 17 == 0,
    )
    return d.select("doc_id", numbers.alias("numbers")).select("doc_id", headers.image_role(evidence).alias("role"))


# -- S37 ----------------------------------------------------------------------------------------------

_GROUPS = (
    None, "null", '"img-{}"', '["a", "b {}", "a", " "]', '[["x{}", "x"], ["y", "x"], []]', '{"images": ["p", "p{}"], "paths": ["q"]}', '{"paths": "q{}"}',
    '[{"images": ["p"]}, "z{}", {"other": 1}]', '{"images": null, "paths": ["n"]}', "[]", "[3, 3, 0, 2.5, true, false, null, {}]", "broken {", '"  "', "{}", "[[null, 0], [[]], 7]",
)
_PLACED = [x if x is None or "{}" not in x or x == "{}" else x.split("{}") for x in _GROUPS]
_GROUPS_SQL = chosen_sql(
    f"o_orderkey % {len(_GROUPS)}", ["null" if x is None else quoted(x) if isinstance(x, str) else quoted(x[0]) + " || o_orderkey || " + quoted(x[1]) for x in _PLACED]
)


@query(
    "S37_solution_groups",
    rf"""with s as (select o_orderkey k, {_GROUPS_SQL} j from orders),
v as (select k, j::json j from s where json_valid(j) and json_type(j::json) <> 'NULL'),
e as (select k, 0 i, j from v where json_type(j) <> 'ARRAY' or len(list_filter(json_extract(j, '$[*]'), lambda x: json_type(x) in ('ARRAY', 'OBJECT'))) = 0
  union all select k, i, j[i] from (select k, json_extract(j, '$[*]') j, unnest(range(1, json_array_length(j)::bigint + 1)) i from v
    where json_type(j) = 'ARRAY' and len(list_filter(json_extract(j, '$[*]'), lambda x: json_type(x) in ('ARRAY', 'OBJECT'))) > 0)),
h as (select k, i, case when json_type(j) <> 'OBJECT' then j when json_exists(j, '$.images') then json_extract(j, '$.images') else json_extract(j, '$.paths') end j from e),
l as (select k, i, case when json_type(j) = 'ARRAY' then json_extract(j, '$[*]') else [j] end l from h),
n as (select k, i, list_filter(list_transform(l, lambda x: case when x is null or json_type(x) = 'NULL' then '' when json_type(x) = 'BOOLEAN' then case when x::varchar = 'true' then 'True' else '' end
  when json_type(x) in ('UBIGINT', 'BIGINT', 'DOUBLE') and x::varchar::double = 0 then '' else trim(coalesce(json_extract_string(x, '$'), '')) end), lambda x: x <> '') l from l),
u as (select k, i, list_filter(l, lambda x, p: list_position(l, x) = p) l from n)
select s.k o_orderkey, coalesce(list(l order by i) filter (where len(l) > 0), []) "groups" from s left join u using (k) group by all""",
)
def s37(t):  # noqa: ANN001, ANN201
    """Solution lists of every shape, by order."""
    k = F.col("o_orderkey")
    made = [F.lit(x).cast("string") if x is None or isinstance(x, str) else F.concat(F.lit(x[0]), k.cast("string"), F.lit(x[1])) for x in _PLACED]
    return t("orders").select("o_orderkey", variants.solution_groups(F.try_parse_json(chosen(k % len(_GROUPS), made))).alias("groups"))


# -- S44 ----------------------------------------------------------------------------------------------

_PROFILE = (
    '{"schema_version": "problem_semantic_profile_v1", "problem_id": "#", "modality": "text_only", "course": "c", "topic": "", "statement_summary": "s", "concepts": ["a", "b"], "skills": [], '
    '"objects": {"geometry": [], "algebra": ["x"], "arithmetic": []}, "given_conditions": ["g", "g"], "unknowns": ["x"], '
    '"representation": {"embedding_text": "e", "search_keywords": ["k"], "canonical_problem_type": "t"}, '
    '"difficulty": {"estimated_level": 3, "scale": "1-5", "signals": {"steps_estimated": 2, "requires_graph_reading": false, "requires_formula_memory": true, '
    '"requires_multi_case_reasoning": false, "requires_algebraic_manipulation": "low"}, "reason": "r"}, '
    '"evidence": {"uses_text": true, "uses_figure": false, "figure_tags": [], "source_fields": ["f"]}, "review": {"status": "revisado", "human_verified": true, "notes": ""}}'
)
#: A change of the profile's text, and the faults that it makes.
_CHANGES = (
    ("", "", ()),
    ('"problem_id": "#", ', "", ("$.problem_id:required",)),
    ('"problem_id": "#"', '"problem_id": ""', ("$.problem_id:minLength",)),
    ('"text_only"', '"text"', ("$.modality:enum",)),
    ('"text_only"', "7", ("$.modality:type",)),
    ('["a", "b"]', '["a", "", "a", 5]', ("$.concepts:uniqueItems", "$.concepts[1]:minLength", "$.concepts[3]:type")),
    ('"geometry": [], ', "", ("$.objects.geometry:required",)),
    ('"geometry": []', '"geometry": [], "other": ["o", 1]', ("$.objects.other[1]:type",)),
    ('"estimated_level": 3', '"estimated_level": 6', ("$.difficulty.estimated_level:maximum",)),
    ('"estimated_level": 3', '"estimated_level": 2.5', ("$.difficulty.estimated_level:type",)),
    ('"estimated_level": 3', '"estimated_level": 2.0', ()),
    ('"1-5"', '"1-9"', ("$.difficulty.scale:const",)),
    ('"steps_estimated": 2', '"steps_estimated": -1, "more": {}', ("$.difficulty.signals.steps_estimated:minimum",)),
    ('"review": {', '"review": {"extra": 1, ', ("$.review.extra:additionalProperties",)),
    ('"uses_text": true', '"uses_text": "yes"', ("$.evidence.uses_text:type",)),
    ('"review": {"status"', '"also": 1, "review": {"state"', ("$.review.status:required", "$.review.state:additionalProperties", "$.also:additionalProperties")),
    ("profile_v1", "profile_v9", ("unknown:schema_version:problem_semantic_profile_v9",)),
    ('"schema_version"', '"version"', ("missing:schema_version",)),
    ('{"schema', '{schema', ("invalid_json",)),
    ('"skills": []', '"skills": null', ("$.skills:type",)),
    ('"topic": "", ', '"topic": "", "subtopic": 4, ', ("$.subtopic:type",)),
)


@query(
    "S44_profile_validation",
    f"select p_partkey, faults, len(faults) = 0 as valid from (select p_partkey, {chosen_sql(f'p_partkey % {len(_CHANGES)}', ['[' + ', '.join(map(quoted, c[2])) + ']::varchar[]' for c in _CHANGES])} faults from part)",
)
def s44(t):  # noqa: ANN001, ANN201
    """A semantic profile for each part, with a fault of each kind put in by its number."""
    k = F.col("p_partkey") % len(_CHANGES)
    made = chosen(k, [_PROFILE.replace(c[0], c[1], 1) if c[0] else _PROFILE for c in _CHANGES])
    text = F.replace(made, F.lit("#"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")))
    done = spread(t("part").select("p_partkey"), "p_partkey").select("p_partkey", variants.profile_faults(text).alias("faults"))
    return done.select("p_partkey", "faults", (F.size("faults") == 0).alias("valid"))
