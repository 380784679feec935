"""what is wrong with an item before it is rendered, and with the image tags of a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from qbank.functions.status import issues

#: The schema's name, the option labels, and the states in which an image is bound.
SCHEMA, LABELS = "ScanItemJSON-v1", ("A", "B", "C", "D", "E")
BOUND = ("confirmed", "manual_confirmed")
#: Fixed value: up to this many characters ahead of A) an item is no statement with options.
SHORTEST = 8
#: Fixed formats: image tags with one bracket, with two, and with either; numbered items and continuations.
ONE_BRACKET = r"(?i)(?<!\[)\[\s*Imagen\s*=\s*[^\]]+\](?!\])"
TWO_BRACKETS = r"(?i)\[\[\s*Imagen\s*=\s*[^\]]+\]\]"
ANY_BRACKETS = r"(?i)\[\[?\s*Imagen\s*=\s*([^\]]+?)\]?\]"
NUMBERED, CONTINUED = r"<\s*\d{1,4}\s*\.\s*>", r"(?i)^\s*\[CONT\.\]"


def clean(c: Column) -> Column:
    return F.btrim(F.coalesce(c.cast("string"), F.lit("")), F.lit(" \t\r\n"))


def holds_options(c: Column) -> Column:
    """A), B) and C) follow each other, and A) is not at the very start; each is looked for once, behind the one before."""
    mark = lambda label: rf"(?<![A-Za-z0-9]){label}\)"
    at_a = F.split(c, mark("A"), 2)
    at_b = F.split(F.get(at_a, F.lit(1)), mark("B"), 2)
    return F.coalesce((F.length(at_a[0]) > SHORTEST) & F.rlike(F.get(at_b, F.lit(1)), F.lit(mark("C"))), F.lit(False))


def item_issues(item: dict[str, Column]) -> Column:
    """the codes of an item's faults.

    ``item`` has columns ``schema n curso tema statement has_figure figure_tag binding`` and the map ``options``.
    """
    statement, tag = clean(item["statement"]), clean(item["figure_tag"])
    figure, bound = F.coalesce(item["has_figure"], F.lit(False)), F.lower(clean(item["binding"])).isin(*BOUND)
    options = item["options"]
    missing = ((f"opcion_{x}_faltante", options.isNotNull() & (clean(F.try_element_at(options, F.lit(x))) == "")) for x in LABELS)
    return issues(
        ("schema_invalido", clean(item["schema"]) != SCHEMA), ("n_invalido", F.coalesce(item["n"].try_cast("int") <= 0, F.lit(True))),
        ("curso_faltante", clean(item["curso"]) == ""), ("tema_faltante", clean(item["tema"]) == ""), ("statement_vacio", statement == ""),
        ("statement_multilinea", F.rlike(statement, F.lit("[\r\n]"))), ("statement_contiene_opciones", holds_options(statement)),
        ("figure_tag_invalido", figure & ~F.rlike(tag, F.lit("^img-[0-9]+$"))), ("figure_tag_debe_estar_vacio", ~figure & (tag != "")),
        ("image_binding_inconsistente", figure & ~bound), ("has_figure_debe_ser_derivado", bound & ~figure), ("options_invalido", options.isNull()), *missing,
    )


def image_tag_issues(c: Column) -> Column:
    """the faults of a text's image tags that keep it from training."""
    raw = clean(c)
    names = F.transform(F.regexp_extract_all(raw, F.lit(ANY_BRACKETS), 1), lambda x: F.lower(F.trim(x)))
    goes_on = F.rlike(raw, F.lit(CONTINUED)) & ~F.rlike(raw, F.lit(NUMBERED))
    return issues(
        ("empty_text", raw == ""), ("etiqueta_imagen_con_un_corchete", F.rlike(raw, F.lit(ONE_BRACKET))),
        ("etiqueta_imagen_mal_formada", F.size(names) != F.regexp_count(raw, F.lit(TWO_BRACKETS))),
        ("img-continuacion_en_problema_numerado_o_no_cont", F.array_contains(names, "img-continuacion") & ~goes_on),
        ("multiples_etiquetas_imagen_en_registro", F.size(names) > 1),
    )
