"""How good a page reading is, and why one is not taken."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from qbank.functions.status import issues
from qbank.functions.text import imbalance, mojibake, repetitive, text_key

#: Phrases of a prompt, two of which show that it came back as a reading.
PROMPT_PHRASES = (
    "regla fundamental", "estructura general", "prohibiciones absolutas", "validacion final", "validación final", "patron obligatorio",
    "patrón obligatorio", "tu unica funcion", "tu única función", "respuesta:", "no incluyas", "no incluyes", "no agregue texto",
    "no agregues texto", "no agregue", "no agregues",
)
#: Stems of the topics in which roots are expected; macros that speak for good LaTeX.
ROOT_TOPICS = ("radic", "raiz", "teoria de exponentes", "exponent", "potenci")
GOOD_MACRO = r"\\(?:frac|sqrt|left|right|cdot|times|pi|theta|alpha|beta|gamma|delta)\b"
#: From which expected number on a page may restart its numbering, and up to which first number.
RESTART_FROM, RESTART_AT_MOST = 20, 15
MIN_SCORE = 80


@dataclass(frozen=True)
class Reading:
    """What was read from a page, as columns."""

    text: Column
    numbers: Column  #: the items' numbers, in order (array of integers)
    items: Column  #: items found
    complete: Column  #: items with all of A-E
    labels: Column  #: options with a text, over all items
    headers: Column  #: numbered headers in the text
    leading: Column  #: options ahead of the first item
    continuation: Column  #: text that continues the page before
    start: Column  #: the number expected first
    topic: Column
    repeated: Column | None = None  #: the text repeats itself; by default as S22 has it


def measured(r: Reading) -> Column:
    """The figures that score and verdicts are made of, as one struct: make it a column of its own, so that texts are scanned once."""
    raw = F.btrim(F.coalesce(r.text, F.lit("")), F.lit(" \t\r\n"))
    low = F.lower(raw)
    nothing = F.array().cast("array<bigint>")
    numbers = F.filter(F.coalesce(r.numbers.cast("array<bigint>"), nothing), lambda x: x.isNotNull())
    n = F.size(numbers)
    first = F.get(numbers, F.lit(0))
    start = F.coalesce(r.start.cast("bigint"), F.lit(0))
    in_a_row = F.size(F.array_distinct(F.transform(numbers, lambda x, i: x - i))) == 1
    off = F.array_position(F.transform(numbers, lambda x, i: x == start + i), F.lit(False))
    continued = (r.items <= 0) & ((F.trim(F.coalesce(r.continuation, F.lit(""))) != "") | (r.leading >= 3))
    positive = F.filter(numbers, lambda x: x > 0)
    head = F.get(positive, F.lit(0))
    shown = (r.complete > 0) | (r.labels >= 3)
    restart = (
        (start >= RESTART_FROM) & (head < start) & (head <= RESTART_AT_MOST) & (r.items > 0) & shown
        & ((F.size(positive) >= 2) | (head == 1) | ((r.complete >= 1) & (r.labels >= 5)))
    )
    phrases = sum((F.contains(low, F.lit(p)).cast("int") for p in PROMPT_PHRASES), F.lit(0))
    topic = text_key(r.topic)
    roots = (F.contains(raw, F.lit("\\sqrt")) | F.contains(raw, F.lit("√"))) & ~F.rlike(topic, F.lit("|".join(ROOT_TOPICS)))
    fields = {
        "blank": raw == "", "items": r.items, "complete": r.complete, "labels": r.labels, "headers": r.headers, "leading": r.leading,
        "n": n, "first": first, "start": start, "continued": continued, "in_a_row": in_a_row, "restart": F.coalesce(restart, F.lit(False)),
        "prefix": F.when(F.coalesce(restart, F.lit(False)) | (off == 0), n).otherwise(F.greatest(off - 1, F.lit(0)).cast("int")),
        "echo": phrases >= 2, "repeated": repetitive(raw) if r.repeated is None else r.repeated, "mojibake": mojibake(raw), "imbalance": imbalance(raw),
        "overline": F.contains(raw, F.lit("\\overline")), "roots": roots, "macro": F.rlike(raw, F.lit(GOOD_MACRO)),
        "all_positive": F.size(positive) == n,
    }
    return F.struct(*(c.alias(name) for name, c in fields.items()))


def score(m: Column) -> Column:
    """The sum over ladders of the first step that holds."""
    ladders = (
        ((~m["blank"], 5),),
        ((m["items"] > 0, 22), (m["continued"], 18), (F.lit(True), -40)),
        ((m["in_a_row"] & (m["first"] == m["start"]), 26), (m["in_a_row"], 16)),
        ((m["first"] == m["start"], 12), ((m["n"] > 0) & m["restart"], 10), (m["first"] < m["start"], -18)),
        ((m["headers"] > 0, 10), (m["continued"], 6)),
        ((m["complete"] > 0, m["complete"] * 6), (m["labels"] > 0, F.least(m["labels"], F.lit(8))), (m["leading"] > 0, F.least(m["leading"], F.lit(6)))),
        ((m["echo"], -100),),
        ((m["repeated"] & ~_whole(m), -60),),
        ((m["mojibake"] > 0, -F.least(m["mojibake"] * 6, F.lit(36))),),
        ((m["imbalance"] > 0, -F.least(m["imbalance"] * 4, F.lit(20))),),
        ((m["overline"], -10),),
        ((m["roots"], -8),),
        ((m["macro"] & (m["mojibake"] == 0), 4),),
    )
    total = F.lit(0)
    for ladder in ladders:
        (holds, points), *more = ladder
        step = F.when(holds, points)
        for holds, points in more:
            step = step.when(holds, points)
        total = total + F.coalesce(step, F.lit(0))
    return total


def _whole(m: Column) -> Column:
    """Every item has a number and all options."""
    return (m["items"] > 0) & (m["n"] == m["items"]) & (m["complete"] == m["items"])


def _strong(m: Column) -> Column:
    return m["continued"] | ((m["items"] > 0) & (m["prefix"] > 0) & (m["n"] == m["items"]) & (m["complete"] >= m["items"]))


def _backward(m: Column) -> Column:
    return F.coalesce(m["first"] < m["start"], F.lit(False)) & ~m["restart"]


def invalid(m: Column) -> Column:
    """Why a reading is not valid; none is valid.

    A continuation has text or three options by its definition, so there is no weak one.
    """
    strong, some = _strong(m), m["items"] > 0
    unnumbered = (m["n"] == 0) & (m["headers"] <= 0)
    uncovered = (m["start"] > 0) & (m["prefix"] <= 0) & ~m["restart"]
    return issues(
        ("vacio", m["blank"]), ("echo_prompt", m["echo"]), ("mojibake", (m["mojibake"] >= 2) | ((m["mojibake"] > 0) & ~strong)),
        ("delimitadores_graves", (m["imbalance"] >= 4) & ~strong), ("sin_items", ~some & ~m["continued"]),
        ("sin_numeracion_recuperable", some & unnumbered), ("cobertura_inicial_insuficiente", some & ~unnumbered & uncovered),
        ("arranque_regresivo", some & ~unnumbered & ~uncovered & _backward(m)),
        ("opciones_incompletas", some & (m["labels"] > 0) & (m["complete"] <= 0) & ~((m["prefix"] > 0) & (m["labels"] >= 3))),
    )


def unrecoverable(m: Column) -> Column:
    """Why a reading can't be mended; none can be."""
    strong, some = _strong(m), m["items"] > 0
    moved = (  # whole and in a row, from a number too low
        (m["start"] > 0) & (m["first"] < m["start"]) & some & m["all_positive"] & (m["n"] == m["items"]) & (m["complete"] >= m["items"]) & m["in_a_row"]
        & (m["mojibake"] < 2) & (m["imbalance"] < 6)
    )
    return issues(
        ("vacio", m["blank"]), ("echo_prompt", m["echo"]), ("mojibake_grave", (m["mojibake"] >= 4) & ~strong), ("sin_items", ~some & ~m["continued"]),
        ("sin_numeracion_recuperable", some & (m["n"] == 0) & (m["headers"] <= 0)),
        ("arranque_regresivo", some & _backward(m) & ~F.coalesce(moved, F.lit(False))),
        ("sin_cobertura_opciones", some & (m["complete"] <= 0) & (m["labels"] < 3)),
        ("delimitadores_graves", some & (m["imbalance"] >= 6) & (m["prefix"] <= 0) & ~strong),
    )


def not_fast(m: Column, least: int = MIN_SCORE) -> Column:
    """Why a reading is not taken at once: what makes it invalid, or else its score."""
    why = invalid(m)
    return F.when((F.size(why) == 0) & (score(m) < least), F.array(F.lit(f"score<{least}"))).otherwise(why)
