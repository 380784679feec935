"""Column functions and operators on hand-made rows."""

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qbank.functions import geometry, latex, similarity, status, text
from qbank.operators import fuzzy, joins, matching, merges, ordering, windows
from qbank.sources import readers, writers
from qbank.streaming import changes


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_keys_agree_on_tilde_and_spaces(spark):
    assert one(spark, text.text_key(F.lit("  Año   ÚNICO "))) == "ano unico"
    assert one(spark, text.text_key(F.lit(None).cast("string"))) == ""
    assert one(spark, text.search_key(F.lit("Geometría, plana!"))) == "geometria plana"
    assert one(spark, text.slug(F.lit("¡¡!!"))) == "origen"


def test_tags_and_headers(spark):
    x = F.lit("[[curso=A]] t [[curso=B]] [[curso= ]]")
    assert one(spark, text.first_tag(x, "curso")) == "A"
    assert one(spark, text.last_tag(x, "curso")) == "B"
    assert one(spark, text.item_number(F.lit("\\item[\\textbf{12.}] x"))) == 12
    assert one(spark, text.item_number(F.lit("x"))) is None


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("catalog:topic:12:Triángulos: extra", ("catalog", "topic", 12, "Triángulos: extra")),
        ("direct:topic:Polígonos", ("direct", "topic", None, "Polígonos")),
        ("9", ("catalog", "", 9, "")),
        ("Geometría plana", ("direct", "", None, "Geometría plana")),
    ],
)
def test_meta_reference(spark, raw, want):
    assert tuple(one(spark, text.meta_reference(F.lit(raw)))) == want


def test_ocr_prefix_and_recall(spark):
    assert one(spark, text.ocr_prefix(F.lit("<03.> x"))) == "<3>"
    assert one(spark, text.ocr_prefix(F.lit("[CONT.] x"))) == "[CONT.]"
    assert one(spark, text.label_recall(F.lit("A) 1 B) 2"), F.lit("A) 1"))) == 0.5
    assert one(spark, text.label_recall(F.lit("none"), F.lit(""))) == 1.0


def test_render_item(spark):
    options = F.create_map(*(F.lit(x) for k in "ABCDE" for x in (k, f"${'ABCDE'.index(k) + 1}$")))
    got = one(spark, text.render_item(F.lit(3), F.lit("Resuelve x+2=5"), options))
    assert got == "\\item[\\textbf{3.}] Resuelve x+2=5£A)$1$æB)$2$æC)$3$£D)$4$ææE)$5$£"
    assert "[[Imagen=img-7]]£A)" in one(spark, text.render_item(F.lit(3), F.lit("x"), options, F.lit("img-7")))


def test_stable_split(spark):
    assert one(spark, text.stable_percent(F.lit("abc"))) == 38
    assert one(spark, text.split_of(F.lit("abc"))) == "train"


def test_similarity(spark):
    a, b = similarity.trigrams(F.lit("word")), similarity.trigrams(F.lit("two words"))
    assert one(spark, F.round(similarity.trigram_similarity(a, b), 6)) == 0.363636
    assert one(spark, F.levenshtein(F.lit("é"), F.lit("e"))) == 1
    assert one(spark, similarity.matching_ratio(F.lit("abcd"), F.lit("bcde"))) == 0.75
    assert one(spark, similarity.l2_distance(F.array(F.lit(0.0), F.lit(3.0)), F.array(F.lit(4.0), F.lit(0.0)))) == 5.0


def test_verdicts(spark):
    for raw, want in [("Bien Planteado", "Consistente"), ("ambiguo", "Inconsistente"), ("Pendiente Revision", "Sin revisar"), (None, "Sin revisar")]:
        assert one(spark, status.canonical_verdict(F.lit(raw).cast("string"))) == want


def test_boxes(spark):
    rows = spark.createDataFrame([("p", 1, 10, 20, 100, 80), ("p", 2, 120, 20, 180, 80)], "page string, id long, x1 int, y1 int, x2 int, y2 int")
    new = spark.createDataFrame([("p", 1, 12, 22, 110, 82)], rows.schema)
    got = matching.match_boxes(rows, new, "page").collect()
    assert [(r.left_id, r.right_id) for r in got] == [(1, 1)]
    conf = rows.unionByName(rows.withColumn("id", F.col("id") + 10)).withColumn("conf", F.col("id") * 1.0)
    assert {r.id for r in matching.suppress(conf, "page").collect()} == {11, 12}
    a = [F.lit(v) for v in (0, 0, 10, 10)]
    assert one(spark, geometry.iou(a, a)) == 1.0
    assert one(spark, geometry.iou([F.lit(0)] * 4, [F.lit(0)] * 4)) == 0.0
    assert one(spark, geometry.yolo_line(a, F.lit(20), F.lit(20))) == "0 0.250000 0.250000 0.500000 0.500000"


def test_identity_tiers(spark):
    known = spark.createDataFrame([(7, "B", "s1", 3, "f"), (8, "B", "s2", 4, "g")], "key long, b string, i string, n int, f string")
    rows = spark.createDataFrame([("B", "s9", 3, "f"), ("B", "", 3, "f"), ("", "", 4, "g"), ("B", "s2", 4, "x")], "b string, i string, n int, f string")
    got = {(r.b, r.i, r.n): r.key for r in joins.resolve_identity(rows, known, "b", "i", "n", "f", "key").collect()}
    assert got == {("B", "s9", 3): None, ("B", "", 3): 7, ("", "", 4): 8, ("B", "s2", 4): 8}


def test_catalogs_are_counted(spark):
    rows, few = spark.range(500).withColumnRenamed("id", "k"), spark.range(20).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    plan = lambda most: rows.join(joins.catalog(few, most), "k")._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan(20) and "broadcast" not in plan(19)


def test_fuzzy_resolve(spark):
    left = spark.createDataFrame([(1, "Geometria plana", "x"), (2, "zzz", ""), (3, "geometria", "a"), (4, None, "a"), (5, "geometria plan", ""), (6, "geometria", "b")], "k long, name string, area string")
    right = spark.createDataFrame([(5, "geometria plana", "y"), (6, "geometria", "a"), (7, "geometria", "a"), (8, "geometria plana", "x y")], "k long, name string, area string")
    got = {(r.left_key, r.right_key, r.how) for r in fuzzy.resolve(left, right, "k", "name", "area").collect()}
    assert got == {(1, 8, "similar"), (3, 6, "exact"), (5, 5, "similar")}
    assert "Cartesian" not in fuzzy.resolve(left, right, "k", "name", "area")._jdf.queryExecution().toString()


@pytest.mark.parametrize("least", [0.3, 0.8, 1.0])
def test_prefixes_lose_no_pair(spark, monkeypatch, least):
    """A hot trigram is salted, and the pairs are those of a full comparison."""
    monkeypatch.setattr(fuzzy, "SHARE", 3)
    r = random.Random(2)
    names = [" ".join(r.choice(["alfa", "beta", "alfabeto", "gama", "delta"]) + r.choice(["", "s", "x"]) for _ in range(r.randint(1, 4))) for _ in range(60)]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = {(x.l, x.r) for x in fuzzy.similar_names(df, df, least).collect()}
    sets = {n: {p[i : i + 3] for w in n.split() for p in [f"  {w} "] for i in range(len(w) + 1)} for n in names}
    assert got == {(a, b) for a in sets for b in sets if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])}


def test_delete_obsolete_without_kept_is_no_op(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "g string, n int")
    kept = spark.createDataFrame([("a", 2)], "g string, n int")
    assert sorted(map(tuple, merges.delete_obsolete(rows, kept, ["g"], "n").select("g", "n").collect())) == [("a", 2), ("b", 1)]


def test_best_display_prefers_accents(spark):
    v = spark.createDataFrame([("Geometria",), ("Geometría",), ("GEOMETRIA",), ("Algebra",)], "v string")
    assert [r.value for r in merges.best_display(v, "v").orderBy("key").collect()] == ["Algebra", "Geometría"]


def test_upsert_policies(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "k long, v string, w string")
    new = spark.createDataFrame([(1, None, "y"), (2, " ", "z"), (3, "c", "q")], "k long, v string, w string")
    got = {r.k: (r.v, r.w) for r in merges.upsert(old, new, "k", {"v": "keep_if_blank", "w": "fill"}).collect()}
    assert got == {1: ("a", "x"), 2: ("b", "z"), 3: ("c", "q")}


def test_running_sequence(spark):
    rows = spark.createDataFrame([("d", i, n) for i, n in enumerate([None, 5, None, 2, None])], "d string, i int, n int")
    got = [r.seq for r in windows.running_sequence(rows, ["d"], "i", F.col("n")).orderBy("i").collect()]
    assert got == [1, 5, 6, 7, 8]


def test_expected_prefix_and_natural_key(spark):
    assert one(spark, windows.expected_prefix(F.array(F.lit(4), F.lit(5), F.lit(9)), F.lit(4))) == 2
    names = spark.createDataFrame([("img10.png",), ("img2.png",), ("note.txt",)], "path string")
    assert [r.path for r in readers.images_in_order(names).collect()] == ["img2.png", "img10.png"]
    assert one(spark, ordering.place(F.lit(-1))) == 10**9


def test_latex():
    assert latex.split_options("Halle el area A) x B) ... C) 3æE) - z ;") == ("Halle el area", {"A": "x", "C": "3", "E": "z"})
    for none in ("Halle el area A) x B) y", "Halle A) x B) y C) z", "Halle el area A) x B) y D) z"):
        assert latex.split_options(none) == (none, {})


def test_page_ranges(spark):
    assert one(spark, readers.pages_of(F.lit("3-1,7"), F.lit(9))) == [1, 2, 3, 7]
    with pytest.raises(Exception, match="page out of range"):
        one(spark, readers.pages_of(F.lit("3-10"), F.lit(9)))


def test_file_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": 1}')
    (tmp_path / "b.json").write_text("{broken")
    schema = T.StructType([T.StructField("id", T.IntegerType())])
    good, bad = readers.json_records(spark, str(tmp_path), schema)
    assert [r.id for r in good.collect()] == [1]
    assert [r.file.rsplit("/", 1)[1] for r in bad.collect()] == ["b.json"]
    tex = tmp_path / "tex"
    tex.mkdir()
    (tex / "u.tex").write_bytes("año".encode())
    (tex / "w.tex").write_bytes("año".encode("cp1252"))
    assert {r.text for r in readers.latex_files(spark, str(tex)).collect()} == {"año"}
    lines = tmp_path / "l.jsonl"
    lines.write_text('{"id": 1}\n\n{"id": 2}\n')
    assert readers.jsonl(spark, str(lines), schema).count() == 2


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "train", None), (2, "test", None), (3, None, "bad")], "id long, split string, reason string")
    manifest = {r.what: r.n for r in writers.write_splits(rows, "reason", str(tmp_path / "out")).collect()}
    assert manifest == {"train": 1, "test": 1, "bad": 1}
    assert spark.read.json(str(tmp_path / "out/splits")).count() == 2
    assert spark.read.json(str(tmp_path / "out/skipped")).count() == 1
    writers.write_csv(rows, ["id", "none", "split"], str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["id", "none", "split"]
    writers.write_records(rows.limit(1), rows, "id", str(tmp_path / "rec"))
    assert spark.read.parquet(str(tmp_path / "rec")).count() == 3
    made = writers.report(rows.groupBy("split").count().where("split = 'test'"))
    assert json.loads(made["json"]) == [{"split": "test", "count": 1}]
    with pytest.raises(ValueError, match="more than"):
        writers.report(spark.range(20), 10)


def test_change_queue_stream(spark, tmp_path):
    schema = "key long, revision long, ts timestamp, published boolean"
    src = str(tmp_path / "in")
    rows = spark.createDataFrame([(1, 1, None, False), (1, 2, None, False), (2, 1, None, False), (2, 2, None, True), (2, 3, None, False)], schema)
    rows.coalesce(1).write.parquet(src)
    out = str(tmp_path / "table")
    stream = changes.change_queue(spark.readStream.schema(schema).parquet(src))
    q = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(changes.upserting(out, "key")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.key: (r.base, r.local, r.pending, r.status) for r in spark.read.parquet(f"{out}/v=0").collect()}
    assert got == {1: (1, 2, 2, "pending"), 2: (3, 3, 1, "pending")}


def test_empty_input(spark):
    empty = spark.createDataFrame([], "d string, i int, n int")
    assert windows.running_sequence(empty, ["d"], "i", F.col("n")).count() == 0
    assert windows.runs(empty, ["d"], "i", F.col("n") > 0).count() == 0
    assert joins.continuation_groups(empty, ["d"], "i", F.col("n") > 0).count() == 0


def test_classifiers(spark):
    from qbank.functions import classify

    none = F.lit("")
    assert tuple(one(spark, classify.training_section(text.search_key(F.lit("Trigonometría")), book_code=none))) == ("Trigonometria", "alta")
    assert tuple(one(spark, classify.training_section(none, book_code=text.search_key(F.lit("ALGEBRA-1")), text=F.lit("seno")))) == ("Algebra", "alta")
    assert tuple(one(spark, classify.training_section(none, tema=F.lit("seno"), text=F.lit("matrices")))) == ("Trigonometria", "media")
    assert tuple(one(spark, classify.training_section(none, text=F.lit("nada")))) == ("General", "baja")
    key = "CLAVES\n1. A 2. B 3. C 4. D 5. E 6. A"
    assert one(spark, classify.key_sheet(F.lit(key), F.lit("pag1")))["is_key"]
    assert not one(spark, classify.key_sheet(F.lit("Resuelve la ecuacion x + 2 = 5"), F.lit("pag2")))["is_key"]
    assert one(spark, classify.problem_type(F.lit("x A) 1 B) 2"), none, none)) == "opcion_multiple"
    assert one(spark, classify.problem_type(F.lit("x A) 1"), none, F.lit("Desarrollo"))) == "abierto"
    for query, want in [("geometria", True), ("gmtr plana", True), ("geometira", True), ("algebra", False), ("pl", True)]:
        assert one(spark, classify.fuzzy_search(F.lit("Geometría plana I"), F.lit(query))) is want
    counts = dict(source_images=2, missing_source_images=0, segment_boxes=3, manifest_segments=0, bindings_confirmed=1, bindings_review=2, items=9, pairs_ready=4, pairs_missing_image=1, raw_blocks=1, structured_blocks=0)
    assert tuple(one(spark, classify.audit_scores({k: F.lit(v) for k, v in counts.items()}))) == (90, 73, 82, "listo")


def test_metadata_and_outliers(spark):
    x = F.lit("UNI 2020 Proceso: ii - Área A")
    assert (one(spark, text.exam_year(x)), one(spark, text.exam_process(x)), one(spark, text.exam_area(x))) == (2020, "II", "A")
    for n, start, want in [(93, 3, 3), (108, 7, 8), (93, 16, 93), (89, 9, 89), (112, 12, 12)]:
        assert one(spark, text.small_number(F.lit(n), F.lit(start))) == want
    assert one(spark, text.error_group(F.lit("ocr:[timeout] job 77"))) == "ocr:[timeout]"
    assert one(spark, text.error_group(F.lit("missing file: C:\\a\\b.png"))) == "missing file"
    assert one(spark, text.error_group(F.lit("job deadbeef01 failed 12"))) == "job <id> failed #"
    assert one(spark, status.normal_status(F.lit("Requiere revision"), status.STATUS_ALIASES)) == "needs_review"
    assert one(spark, status.normal_step(F.lit("Box_Detection"))) == "boxes"
    assert one(spark, text.merge_fragments(F.lit("sea x la base"), F.lit("sea x la base del triangulo"))) == "sea x la base del triangulo"


def test_text_noise(spark):
    assert one(spark, text.mojibake(F.lit("a\u00c3b \u00e2\u20ac \u00cb \ufffd"))) == 4
    assert one(spark, text.imbalance(F.lit("A) 1 B) 2 (x) [y"))) == 1 and one(spark, text.imbalance(F.lit("xA) {"))) == 2
    assert one(spark, text.repetitive(F.lit("No agregue texto. no agregue texto")))
    assert one(spark, text.repetitive(F.lit("la raiz de la raiz de la raiz de la raiz de"))) and not one(spark, text.repetitive(F.lit("la raiz de dos y la raiz de tres")))
    assert one(spark, text.repetitive(F.lit("uno dos tres " * 20))) and not one(spark, text.repetitive(F.lit(" ".join(f"w{k}" for k in range(60)))))


def test_admission(spark):
    from qbank.functions import admission

    none = F.lit(None).cast("string")
    golden = lambda st, tx, tags, im: one(spark, admission.golden_reason(F.lit("{}"), F.lit(st), ("reviewed",), F.lit(tx), F.array(*map(F.lit, tags)), im))
    assert [golden("Reviewed ", "x", [], F.lit("p")), golden("open", "x", [], F.lit("p")), golden("reviewed", " ", [], F.lit("p")), golden("reviewed", "x", ["t"], F.lit("p")), golden("reviewed", "x", [], none)] == [
        None, "status", "missing_corrected_text", "suspect_image_tags", "missing_image"]
    assert one(spark, admission.stale(none, F.lit("Sí"))) and one(spark, admission.stale(F.lit("INVALIDATED"), none)) and not one(spark, admission.stale(none, F.lit("no")))
    gate = lambda latex, st: one(spark, admission.blocking_issues(F.array().cast("array<string>"), F.lit(True), F.lit(latex), F.lit(False), F.lit(st)))
    assert gate("\\item[\\textbf{3.}] x", "listo") == [] and gate("3. x", "listo") == ["invalid:final_latex_item"] and gate("", "review") == ["missing:final_latex", "not_ready:human_review"]


def test_merge_fragments(spark):
    merge = lambda a, b: one(spark, text.merge_fragments(F.lit(a), F.lit(b)))
    assert merge(" ", "b") == "b" and merge("a", " ") == "a" and merge(" uno ", "dos") == "uno dos"
    assert merge("El Área total", "area TOTAL") == "El Área total"
    assert merge("sea la base del triangulo", "sea la base del triangulos") == "sea la base del triangulo"  # not longer by a tenth; the tokens overlap
    assert merge("dada f (x) con valor minimo", "halle f (x) si valor minimo") == "dada f (x) con valor minimo"  # 4 of 6 tokens and an anchor
    assert merge("dada f x con valor minimo", "halle f x si valor minimo") == "dada f x con valor minimo halle f x si valor minimo"


def test_candidates(spark):
    from qbank.functions import candidates

    def of(raw="texto", numbers=(), items=0, complete=0, labels=0, headers=0, leading=0, continuation="", start=1, topic="", f=candidates.score):
        ints = F.array(*map(F.lit, numbers)).cast("array<bigint>")
        r = candidates.Reading(F.lit(raw), ints, *map(F.lit, (items, complete, labels, headers, leading, continuation, start, topic)))
        return one(spark, f(candidates.measured(r)))

    whole = {"numbers": (3, 4), "items": 2, "complete": 2, "labels": 10, "headers": 2, "start": 3}
    assert of() == 5 - 40 and of("") == -40
    assert of(**whole) == 5 + 22 + 26 + 12 + 10 + 12 and of(**whole, f=candidates.not_fast) == []
    assert of("no incluyas. Respuesta: Ã", **whole) == 87 - 100 - 6
    assert of(**whole | {"start": 1}) == 5 + 22 + 16 + 10 + 12 and of(**whole | {"start": 9}) == 5 + 22 + 16 - 18 + 10 + 12
    assert of(**whole | {"start": 20}) == 5 + 22 + 16 + 10 + 10 + 12 and of(**whole | {"start": 20}, f=candidates.invalid) == []
    assert of(**whole | {"start": 9}, f=candidates.invalid) == ["cobertura_inicial_insuficiente"] and of(**whole | {"start": 9}, f=candidates.unrecoverable) == []
    assert of(leading=3) == 5 + 18 + 6 + 3 and of(leading=3, f=candidates.not_fast) == ["score<80"]
    assert of("\\sqrt{2}", **whole) == 87 - 8 + 4 and of("\\sqrt{2}", topic="Raíces", **whole) == 87 - 8 + 4 and of("\\sqrt{2}", topic="Radicación", **whole) == 87 + 4
    assert of("", f=candidates.unrecoverable) == ["vacio", "sin_items"]
    assert of("x ((((((", numbers=(7,), items=1, labels=2, start=1, f=candidates.unrecoverable) == ["sin_cobertura_opciones", "delimitadores_graves"]


def test_rendered(spark):
    from qbank.functions import rendered

    check = lambda x, *item: one(spark, rendered.rendered_issues(F.lit(x), *map(F.lit, item)))
    good = "\\item[\\textbf{3.}] [[curso=a_b]][[tema=y]] si $x_1$ vale 5\\%"
    options = "£A)$1$æB)$2$æC)$3$£D)$4$ææE)$5$£"
    assert check(good + options) == [] and check(good + " [[Imagen=img-3]]" + options, 3, True) == []
    assert check(good + " a_1" + options) == ["latex_special_sin_escape"] and check(good + " \\$a_1" + options) == ["latex_special_sin_escape"]
    assert check(good + " $b" + options)[0] == "math_delimiters_desbalanceados"
    assert check(good + " ≤" + options) == ["unicode_math_sin_normalizar", "simbolos_unicode_no_mapeados"]
    assert check(good + options, 3, True) == ["imagen_tag_faltante"] and check(good + " [[Imagen=img-3]]" + options, 3, False) == ["imagen_tag_prohibido"]
    assert check(good + " [[Imagen=img-4]]" + options, 3, True) == ["imagen_tag_incorrecto"]
    assert check(None) == ["header_item_invalido", "tag_curso_faltante", "tag_tema_faltante", "patron_opciones_invalido"]


def test_items(spark):
    from qbank.functions import items

    def check(**changed):
        fields = {"schema": items.SCHEMA, "n": "3", "curso": "x", "tema": "y", "statement": "Halle el area", "has_figure": False, "figure_tag": "", "binding": "", "options": dict.fromkeys("ABCDE", "1")} | changed
        options = fields.pop("options")
        made = F.lit(None).cast("map<string,string>") if options is None else F.create_map(*(F.lit(x) for kv in options.items() for x in kv))
        return one(spark, items.item_issues({name: F.lit(v) for name, v in fields.items()} | {"options": made}))

    assert check() == [] and check(has_figure=True, figure_tag="img-3", binding=" Confirmed") == []
    assert check(schema="", n="0", curso=" ", tema="") == ["schema_invalido", "n_invalido", "curso_faltante", "tema_faltante"]
    assert check(statement=" ") == ["statement_vacio"] and check(statement="a\nb") == ["statement_multilinea"]
    assert check(statement="Halle el area A) 1 B) 2 C) 3") == ["statement_contiene_opciones"] and check(statement="Halle A) 1 B) 2 C) 3") == []
    assert check(figure_tag="img-3") == ["figure_tag_debe_estar_vacio"] and check(binding="confirmed") == ["has_figure_debe_ser_derivado"]
    assert check(has_figure=True, figure_tag="3") == ["figure_tag_invalido", "image_binding_inconsistente"]
    assert check(options=None) == ["options_invalido"] and check(options={"A": "1", "B": "1", "C": " ", "D": "1"}) == ["opcion_C_faltante", "opcion_E_faltante"]
    tags = lambda x: one(spark, items.image_tag_issues(F.lit(x)))
    assert tags(" ") == ["empty_text"] and tags("x [[Imagen=img-1]]") == [] and tags("[CONT.] [[Imagen=img-continuacion]]") == []
    assert tags("x [Imagen=img-1]") == ["etiqueta_imagen_con_un_corchete", "etiqueta_imagen_mal_formada"]
    assert tags("<3.> [[Imagen=img-continuacion]]") == ["img-continuacion_en_problema_numerado_o_no_cont"]


def test_providers(spark):
    from qbank.operators import providers

    two = {"plain": lambda c: c, "upper": F.upper}
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, x string")
    rows = {(r.id, r.provider, r.reading) for r in providers.readings(df, "x", two).collect()}
    assert rows == {(1, "plain", "a"), (1, "upper", "A"), (2, "plain", None), (2, "upper", None)}
    assert providers.requested(" Upper ,", two) == ["upper"] and providers.requested("all", two) == ["plain", "upper"]
    with pytest.raises(ValueError, match="unknown providers: z"):
        providers.requested("upper,z", two)


def test_retried():
    calls = []

    def fails(message, times):
        calls.append(message)
        if calls.count(message) <= times:
            raise OSError(message)
        return len(calls)

    assert readers.retried(lambda: fails("Connection refused", 2), 3, 0) == 3
    for message, times in (("FATAL: timeout expired", 9), ("syntax error", 1)):
        with pytest.raises(OSError, match=message):
            readers.retried(lambda: fails(message, times), 2, 0)  # noqa: B023
    assert calls.count("FATAL: timeout expired") == 2 and calls.count("syntax error") == 1


def test_latex_option(spark):
    def option(x):
        done = latex.option_text(F.lit(x))
        return one(spark, done), one(spark, latex.option_warnings(F.lit(x), done))

    assert option("$ 3  ≤ x $") == (r"$3 \leq x$", []) and option("  ") == ("$...$", []) and option(None) == ("$...$", [])
    assert option("∠ABC y m ∠ DEF") == (r"$\angle ABC y m\angle DEF$", []) and option("30 ° + °") == (r"$30^\circ + ^\circ$", [])
    assert option("Sen x + ctg y - seno") == (r"$\sin x + \cot y - seno$", []) and option("√2 £ 3æ4") == (r"$\sqrt{}2 3 4$", [])
    assert option("Ã¡rea Ã\u0081") == ("$área Á$", ["accent_mojibake_fixed", "unknown_symbols"])
    assert option(r"\\'{a}rea \~n") == ("$área ñ$", ["accent_escape_canonicalized", "unknown_symbols"])
