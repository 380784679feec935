"""Statements, rendered items, headers, roles, solution groups and profiles, case by case."""

import json
import random
import weakref

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from qbank.functions import headers, latex, statements, variants
from qbank.plans.statements import _PROFILE
from qbank.queries import QUERIES


@pytest.mark.parametrize(
    ("text", "want", "warnings"),
    [
        (None, "[[ocr_sin_texto]]", []),
        ("  ", "[[ocr_sin_texto]]", []),
        (" \n ", "£", []),
        ("Halla ∠ABC = 30°", r"Halla $\angle ABC = 30^\circ$", []),
        ("Si θ + α = π", r"Si $\theta + \alpha = \pi$", []),
        (r"De la siguiente ecuaci\\'on, halle x^1", r"De la siguiente ecuaci\'on, halle $x^1$", ["accent_escape_canonicalized", "bare_exponent_wrapped"]),
        ("De la siguiente ecuaciÃ³n", r"De la siguiente ecuaci\'on", ["accent_mojibake_fixed"]),
        (r"Siendo conocidos para un mismo \angle, calcule", r"Siendo conocidos para un mismo \'angulo, calcule", ["angle_word_restored"]),
        (r"Halle el \angle formado por dos rectas", r"Halle el \'angulo formado por dos rectas", ["angle_word_restored"]),
        (r"Calcule m\angle AOB", r"Calcule m$\angle AOB$", []),
        (r"Si $S^\circ$ y $C^g$ de un mismo \textit{ángulo}", r"Si $S^\circ$ y $C^g$ de un mismo \'angulo", []),
        (r"Si \overline{OB} es bisectriz del angulo", r"Si $\overline{OB}$es bisectriz del angulo", []),
        (r"De la siguiente, halle \frac{x+1}{x-1}=\frac{1}{2}", r"De la siguiente, halle $\frac{x+1}{x-1} = \frac{1}{2}$", []),
        (
            r"De la siguiente, halle x^1 \frac{x+1}{x-1} = \frac{5^8 + \frac{5^8}{3}}{2^8}",
            r"De la siguiente, halle $x^1$ $\frac{x+1}{x-1} = \frac{5^8 + \frac{5^8}{3}}{2^8}$",
            ["bare_exponent_wrapped"],
        ),
        ("x + $2 = 3", "$x + 2 = 3$", ["unbalanced_math_delimiters"]),
        ("a£$x$£b", "a $x$ b", []),
        ("uno\r\ndos", "uno£dos", []),
    ],
)
def test_statement(text, want, warnings):
    got = statements.statement(text)
    assert (got.text, sorted(got.warnings)) == (want, warnings)


def test_angle_with_vertices_is_no_word():
    got = statements.statement(r"Halle el ∠ABC = 30° y un ∠ que mide, el \angle Formado")
    assert got.text == r"Halle el $\angle ABC = 30^\circ$ y un \'angulo que mide, el \'angulo Formado" and got.warnings == {"angle_word_restored"}
    assert statements.statement("el ∠ABC").warnings == set()


def test_item_keeps_tags_and_separators():
    raw = r"\item[\textbf{3.}] [[curso=SIN_CURSO]] Si $\overline{OB}$ y $\angle AOC$ [[Imagen=img-3]]£A)$15°$æB)$27°$£"
    assert statements.item(raw).text == raw.replace("°", r"^\circ")
    assert statements.item("a $ b").warnings == {"unbalanced_math_delimiters"}
    assert statements.item("ok").changed is False and statements.item(None).text == ""


def test_plain_and_display():
    assert statements.plain_text("¿Qué es #_ %?") == r"\textquestiondown{}Qu\'e es \#\_ \%?"
    assert statements.plain_text(r"ecuaci\'{o}n") == r"ecuaci\'on"
    assert statements.display(r"un mismo \angle, la expresi\'on") == "un mismo ángulo, la expresión"
    assert statements.display(r"$\left(4n-\frac{4}{3}\right)^\circ \text{rad}$") == r"$(4n-\frac{4}{3})^\circ rad$"


def test_damage_is_that_of_the_codec():
    def damaged(c):
        try:
            return c.encode().decode("cp1252")
        except UnicodeDecodeError:
            return c.encode().decode("latin-1")

    assert {damaged(c): c for c in "áéíóúÁÉÍÓÚñÑüÜ¿¡"} == latex.DAMAGED


def test_formula_is_the_same_as_a_column(spark):
    texts = ["$ x $", "∠ABC y m ∠def", "3 ° + x° ≤ ½", "Sen x · TG y", "Ã¡rea £ a æ 2", r"\'{a}rea \~n", r"\\'area", "ctg(α) ≠ tgx", "m∠ABC"]
    got = spark.createDataFrame([(x,) for x in texts], "x string").select("x", latex.formula(F.col("x")).alias("f")).collect()
    assert {r.x: r.f for r in got} == {x: statements.formula(x) for x in texts}


def test_statements_are_linear_in_long_texts(spark):
    long = "palabra larga $x$ " * 20_000
    got = spark.createDataFrame([(long,), (None,)], "x string").select(statements.statements("x").alias("s")).collect()
    assert sorted(len(r.s.text) for r in got) == [17, len(long.strip())]


def test_headers(spark):
    texts = {
        None: [], "": [], "1. uno\n2) dos\n1. uno": [1, 2], "<12.> Halle\n< 13 > y": [12, 13], "①  a ⑳ b ❿ c": [1, 20, 10], "(7) x\n[8] y": [7, 8],
        "n. 8\nN. 9)": [8, 9], "45\n 46 ": [45, 46], "a 4: bar\n3) Foo": [3, 4], "5. A) no 6] ¿sí?": [5, 6], "x 5. A) no": [], "12345. no 0) z": [],
    }
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").select("i", headers.header_numbers(F.col("x")).alias("n")).collect()
    assert {r.i: r.n for r in rows} == dict(enumerate(texts.values()))


def test_headers_of_shortened_prose(spark):
    r = random.Random(3)
    bits = ["12", "7", ".", ")", "]", ":", "(", "[", "<", ">", " ", "  ", "\n", "n", "N.", "ab", "A", "e", "E)", "foo bar", "ñ", "é de", "¿", "③", "⑳", "x", "\u00a0", "×"]
    rows = spark.createDataFrame([(i, "".join(r.choice(bits) for _ in range(r.randint(1, 16)))) for i in range(4000)], "i int, x string")
    whole = F.concat(*(F.regexp_extract_all(headers.plain_numbers(F.col("x")), F.lit(p), 1) for p in (headers.LINE_HEADER, headers.WORD_HEADER)))
    whole = F.array_distinct(F.filter(F.transform(whole, lambda x: x.cast("int")), lambda x: x > 0))
    got = rows.select("x", headers.header_numbers(F.col("x")).alias("n"), whole.alias("w")).collect()
    assert [r.x for r in got if r.n != r.w] == [] and sum(len(r.n) for r in got) > 200
    long = spark.createDataFrame([("palabra larga de texto " * 50_000 + "\n5. fin",)], "x string").select(F.length(headers.shortened(F.col("x"))).alias("l"), headers.header_numbers(F.col("x")).alias("n")).first()
    assert long.l < 20 and long.n == [5]


@pytest.mark.parametrize("name", ["S17_label_recall", "S20_numbered_headers", "S21_image_role", "S25_items", "S25_latex_normalise", "S25_statements", "S44_profile_validation"])
def test_rows_are_dealt_out(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    assert "RepartitionByExpression" in plan


def test_whole_texts_go_in_short_batches(spark):
    for name in ("S25_items", "S25_latex_normalise"):
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        QUERIES[name](spark, "/root/testdata/sf0.001")
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "1000"


def test_few_texts_of_a_batch_are_objects_at_once():
    made, most = [], 0

    def one(text):
        nonlocal most
        out = statements.Found(text or "")
        made.append(weakref.ref(out))
        most = max(most, sum(r() is not None for r in made))
        return out

    got = statements._column(one).func(pa.array(["a", None] * 400))
    assert got.to_pylist()[:2] == [{"text": x, "unknown": [], "warnings": [], "changed": False} for x in ("a", "")]
    assert len(got) == 800 and most <= 2 * statements.AT_ONCE
    assert len(statements._column(one).func(pa.array([], pa.string()))) == 0


def test_solution_groups(spark):
    cases = {
        None: [], "null": [], '"a"': [["a"]], "0": [], "7": [["7"]], '["a", "a", " b "]': [["a", "b"]], '[["a"], [], ["b", "a"]]': [["a"], ["b", "a"]],
        '{"images": ["p"], "paths": ["q"]}': [["p"]], '{"paths": "q"}': [["q"]], '[{"images": ["p"]}, "z"]': [["p"], ["z"]], "no json": [], "[]": [],
    }
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(cases)], "i int, x string")
    got = rows.select("i", variants.solution_groups(F.try_parse_json("x")).alias("g")).collect()
    assert {r.i: r.g for r in got} == dict(enumerate(cases.values()))


def test_schema_faults(spark):
    ok = json.loads(_PROFILE)
    both = {**ok, "objects": {"geometry": [1], "algebra": [], "arithmetic": []}, "difficulty": {**ok["difficulty"], "estimated_level": 0}}
    cases = [(json.dumps(ok), []), (json.dumps(both), ["$.objects.geometry[0]:type", "$.difficulty.estimated_level:minimum"]), ("[]", ["not_an_object"]), (None, ["invalid_json"])]
    cases.append((json.dumps({k: v for k, v in ok.items() if k not in ("course", "review")}), ["$.course:required", "$.review:required"]))
    got = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, x string").select("i", variants.profile_faults(F.col("x")).alias("f")).collect()
    assert {r.i: r.f for r in got} == {i: c[1] for i, c in enumerate(cases)}
