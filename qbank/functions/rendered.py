"""what is wrong with a rendered item."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from qbank.functions.status import issues

#: Fixed formats of a rendered item: head, tags, options, and what must not be left in it.
HEAD = r"^\\item\[\s*\\textbf\{[0-9]+\.\}\s*\]"
COURSE, TOPIC = r"\[\[curso=[^\]]+\]\]", r"\[\[tema=[^\]]+\]\]"
OPTIONS = r"(?s)£A\)\$.*?\$æB\)\$.*?\$æC\)\$.*?\$£D\)\$.*?\$ææE\)\$.*?\$£$"
RAW_MATH = "[°∠⊥∥×÷≤≥≠≈∞α-ω]"
POWER = r"\\textasciicircum\{\}[A-Za-z0-9{]"
UNKNOWN = r"[^\x00-\x7F£æ]"
TAG_OR_MACRO = r"\[\[[^\]]+\]\]|\\[A-Za-z]+\*?"
BARE_SPECIAL = r"(?<!\\)[#%&_~^]"
IMAGE, FIRST_OPTION = "[[Imagen=", "£A)"


def outside_math(c: Column) -> Column:
    """The parts of a text outside ``$...$``; escaped dollars are no delimiters, and a span left open has no outside."""
    plain = F.regexp_replace(c, r"(?<!\\)((?:\\\\)*)\\\$", "$1\u0001")
    return F.filter(F.split(plain, r"\$"), lambda x, i: i % 2 == 0)


def odd_dollars(c: Column) -> Column:
    return F.size(F.split(F.regexp_replace(c, r"\\[\s\S]", ""), r"\$")) % 2 == 0


def rendered_issues(text: Column, number: Column | None = None, has_figure: Column | None = None) -> Column:
    """the codes of all that is wrong; with an item's number and figure flag its image tag is checked, else only the tag's place."""
    c = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\r\n"))
    lacks = lambda p: ~F.rlike(c, F.lit(p))
    image, options = F.instr(c, F.lit(IMAGE)), F.instr(c, F.lit(FIRST_OPTION))
    behind = (image > 0) & (options > 0) & (image >= options)
    bare = F.exists(outside_math(c), lambda s: F.rlike(F.regexp_replace(s, TAG_OR_MACRO, " "), F.lit(BARE_SPECIAL)))
    found = [
        ("header_item_invalido", lacks(HEAD)), ("tag_curso_faltante", lacks(COURSE)), ("tag_tema_faltante", lacks(TOPIC)),
        ("palabra_opciones_prohibida", F.contains(F.lower(c), F.lit("opciones"))), ("patron_opciones_invalido", lacks(OPTIONS)),
        ("unicode_math_sin_normalizar", F.rlike(c, F.lit(RAW_MATH))), ("math_delimiters_desbalanceados", odd_dollars(c)),
        ("latex_special_sin_escape", bare), ("potencia_fuera_de_modo_math", F.rlike(c, F.lit(POWER))), ("simbolos_unicode_no_mapeados", F.rlike(c, F.lit(UNKNOWN))),
    ]
    if number is None or has_figure is None:
        return issues(*found, ("imagen_tag_fuera_de_posicion", behind))
    own = F.contains(c, F.concat(F.lit(" [[Imagen=img-"), number.cast("string"), F.lit("]]")))
    has = F.coalesce(has_figure, F.lit(False))
    return issues(
        *found, ("imagen_tag_faltante", has & (image == 0)), ("imagen_tag_incorrecto", has & (image > 0) & ~own),
        ("imagen_tag_fuera_de_posicion", has & behind), ("imagen_tag_prohibido", ~has & (image > 0)),
    )
