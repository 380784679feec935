"""LaTeX of options as expressions, and scanners whose state no built-in expression holds, Arrow-batched."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qbank.functions.status import issues

#: The characters that the normaliser of formulas knows, and their macros.
FORMULA = {
    "∠": r"\angle", "⊥": r"\perp", "∥": r"\parallel", "×": r"\times", "÷": r"\div", "≤": r"\leq", "≥": r"\geq", "≠": r"\neq", "≈": r"\approx", "∞": r"\infty",
    "±": r"\pm", "∓": r"\mp", "·": r"\cdot", "•": r"\cdot", "√": r"\sqrt{}", "α": r"\alpha", "β": r"\beta", "γ": r"\gamma", "δ": r"\delta", "ε": r"\epsilon",
    "θ": r"\theta", "λ": r"\lambda", "μ": r"\mu", "π": r"\pi", "ρ": r"\rho", "σ": r"\sigma", "τ": r"\tau", "φ": r"\phi", "ω": r"\omega",
}
#: Function names and their macros, and the accents of LaTeX with the letters that take them.
FUNCTIONS = {"sen": r"\sin", "tg": r"\tan", "ctg": r"\cot"}
ACCENTS = {"'": ("\u0301", "AaEeIiOoUu"), "~": ("\u0303", "Nn"), '"': ("\u0308", "Uu")}
SIGNS = {"textquestiondown": "¿", "textexclamdown": "¡"}
#: What separates lines and options, and what damage makes of it.
SEPARATORS = ("\\u00a3", "Â£", "£", "\\u00e6", "Ã¦", "æ")
DOUBLE_ESCAPED = r"""\\{2,}(?:['~"]\{?[A-Za-z]\}?|textquestiondown\{\}|textexclamdown\{\})"""


#: Spanish letters and signs, as their UTF-8 looks when it was read as Windows-1252 (Latin-1 where that has no character).
DAMAGED = {
    "Ã¡": "á", "Ã©": "é", "Ã\xad": "í", "Ã³": "ó", "Ãº": "ú", "Ã\x81": "Á", "Ã‰": "É", "Ã\x8d": "Í", "Ã“": "Ó", "Ãš": "Ú",
    "Ã±": "ñ", "Ã‘": "Ñ", "Ã¼": "ü", "Ãœ": "Ü", "Â¿": "¿", "Â¡": "¡",
}


def formula(c: Column) -> Column:
    """A formula's characters as macros, without separators and dollars, on one line."""
    c = F.coalesce(c, F.lit(""))
    for x in SEPARATORS:
        c = F.replace(c, F.lit(x), F.lit(" "))
    for x, good in DAMAGED.items():
        c = F.replace(c, F.lit(x), F.lit(good))
    for name, sign in SIGNS.items():
        c = F.regexp_replace(c, rf"\\+{name}\{{\}}", sign)
    for accent, (mark, letters) in ACCENTS.items():
        for x in letters:
            c = F.regexp_replace(c, rf"\\+{accent}\{{?{x}\}}?", unicodedata.normalize("NFC", x + mark))
    c = F.replace(F.regexp_replace(F.replace(c, F.lit("$"), F.lit(" ")), r"(?<=[0-9A-Za-z])\s+°", "°"), F.lit("°"), F.lit(r"^\circ"))
    for x, macro in FORMULA.items():
        c = F.replace(c, F.lit(x), F.lit(macro))
    c = F.regexp_replace(c, r"(?i)\bm\s*\\angle\s*([A-Z]{3})\b", r"m\\angle $1")
    c = F.regexp_replace(c, r"(?<![mM])\\angle\s*([A-Z]{3})\b", r"\\angle $1")
    for name, macro in FUNCTIONS.items():
        c = F.regexp_replace(c, rf"(?i)\b{name}\b", "\\" + macro)
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def option_text(c: Column) -> Column:
    """An option as one formula; a blank one becomes three dots."""
    return F.concat(F.lit("$"), F.coalesce(F.nullif(formula(c), F.lit("")), F.lit("...")), F.lit("$"))


def option_warnings(source: Column, done: Column) -> Column:
    """What had to be repaired in an option, and whether characters are left that LaTeX may not know."""
    c = F.coalesce(source, F.lit(""))
    for x in SEPARATORS:
        c = F.replace(c, F.lit(x), F.lit(" "))
    return issues(
        ("accent_escape_canonicalized", F.rlike(c, F.lit(DOUBLE_ESCAPED))), ("accent_mojibake_fixed", F.rlike(c, F.lit("|".join(DAMAGED)))),
        ("unknown_symbols", F.rlike(done, F.lit(r"[^\x00-\x7F£æ]"))),
    )


OPTION = re.compile(r"(?<![A-Za-z0-9])([A-E])\)")
#: A statement ahead of its options is longer than this, and what stands for a missing option.
SHORTEST, MISSING = 8, ("", "...")


def split_options(text: str) -> tuple[str, dict[str, str]]:
    """The statement and its options: each label's first mark behind the marks before it, those not found skipped.

    Without A), B) and C), or with an A) at the very start, there are none, and the text stays as it is.
    """
    marks: list[tuple[str, int, int]] = []
    for label in "ABCDE":
        behind = marks[-1][2] if marks else 0
        marks += [(label, m.start(), m.end()) for m in OPTION.finditer(text, behind) if m[1] == label][:1]
    if "".join(m[0] for m in marks)[:3] != "ABC" or marks[0][1] <= SHORTEST:
        return text, {}
    ends = [m[1] for m in marks[1:]] + [len(text)]
    values = {m[0]: " ".join(re.sub("[£æ]", " ", text[m[2] : end]).split()).strip(" -:;") for m, end in zip(marks, ends, strict=True)}
    return " ".join(text[: marks[0][1]].rstrip(" £æ").split()), {k: v for k, v in values.items() if v not in MISSING}


@F.pandas_udf(T.StructType([T.StructField("statement", T.StringType()), T.StructField("options", T.MapType(T.StringType(), T.StringType()))]))
def with_options(text: pd.Series) -> pd.DataFrame:
    """Statements and their options; null stays null."""
    got = [split_options(x) if x is not None else (None, {}) for x in text]
    return pd.DataFrame({"statement": [g[0] for g in got], "options": [g[1] for g in got]})
