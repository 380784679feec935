"""Numbers of problem headers in a page's text, and the role that a page's image plays."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from qbank.functions.variants import let

#: Digits in circles, plain from 1 to 20 and filled from 1 to 10: Unicode has them in order.
CIRCLED = "".join(chr(0x2460 + i) for i in range(20)) + "".join(chr(0x2776 + i) for i in range(10))
ONES, TENS, TWENTY, FILLED_TEN = CIRCLED[:9] + CIRCLED[20:29], CIRCLED[9:19], CIRCLED[19], CIRCLED[29]
#: Fixed patterns of headers: at a line's start, and before a word that is no option's label. The flags make white space and digits those of Unicode.
_U = "(?dU)"
LINE_HEADER = _U + r"(?m)^\s*(\d{1,4})\s*[.)](?=\s)"
WORD_HEADER = _U + r"(?<!\S)(\d{1,4})\s*[\].:)](?=\s*(?![A-Ea-e]\s*[)\].:])[A-Za-zÀ-ÿ¿¡])"
#: Fixed pattern: letters and blanks, two letters at least.
PROSE = "[A-Za-zÀ-ÿ][A-Za-zÀ-ÿ ]*[A-Za-zÀ-ÿ]"
#: Fixed patterns of numbers in other dress: in angle brackets anywhere, in brackets, as ``n. 8``, or alone on their line.
DRESSED = (
    (_U + r"(?<!\S)<\s*(\d{1,4})\s*(?:\.\s*)?>", "$1. "),
    (f"([{CIRCLED}])", "$1. "),
    (f"([{TENS}])", "1$1"),
)
AFTER_CIRCLES = (
    (_U + r"(?m)^(\s*)[(\[]\s*(\d{1,4})\s*[)\]](?=\s)", "$1$2. "),
    (_U + r"(?im)^(\s*)n\.\s*(\d{1,4})\s*[.)]?\s*$", "$1$2. "),
    (_U + r"(?m)^(\s*)(\d{1,4})\s*$", "$1$2. "),
)


def plain_numbers(c: Column) -> Column:
    """A text whose dressed numbers are written ``8. ``."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n?", "\n")
    for found, to in DRESSED:
        c = F.regexp_replace(c, found, to)
    c = F.translate(c, ONES + TENS, "123456789" * 2 + "0123456789")
    c = F.replace(F.replace(c, F.lit(TWENTY), F.lit("20")), F.lit(FILLED_TEN), F.lit("10"))
    for found, to in AFTER_CIRCLES:
        c = F.regexp_replace(c, found, to)
    return c


def shortened(c: Column) -> Column:
    """Prose as two letters: headers look at the first letter behind them, and whether it stands alone."""
    return F.regexp_replace(c, PROSE, "zz")


def header_numbers(c: Column) -> Column:
    """The different numbers of headers, those at line starts first, then those before words, each in the text's order."""
    found = let(plain_numbers(shortened(c)), lambda text: F.concat(*(F.regexp_extract_all(text, F.lit(p), 1) for p in (LINE_HEADER, WORD_HEADER))))
    return F.array_distinct(F.filter(F.transform(found, lambda x: x.cast("int")), lambda x: x > 0))


@dataclass(frozen=True)
class Evidence:
    """What is known of an image; booleans, counts and a text."""

    headers: Column
    pending: Column
    key_candidate: Column
    items: Column
    continuation: Column
    options: Column
    labels: Column
    figure: Column
    segments: Column
    pending_prefix: Column


#: The seven roles.
BOTH, NEW, LABELS, GRAPHIC, CONTINUED, KEY, UNKNOWN = (
    "continuation_plus_new_items", "new_items_only", "continuation_labels_only", "continuation_graphic_only", "continuation_only", "pure_key_image", "unknown",
)


def image_role(e: Evidence) -> Column:
    """New items first, then what goes on with a pending one, then keys."""
    new = (e.items > 0) | (F.size(e.headers) > 0)
    text, options, labels = F.trim(F.coalesce(e.continuation, F.lit(""))) != "", e.options > 0, e.labels > 0
    goes_on = text | options | labels | e.figure | e.pending_prefix
    more = (
        F.when(labels & ~options & ~text, LABELS)
        .when(e.figure & ~(text | options | labels), GRAPHIC)
        .otherwise(CONTINUED)
    )
    return (
        F.when(new & e.pending & goes_on, BOTH)
        .when(new, NEW)
        .when(e.pending & (goes_on | (e.segments > 0)), more)
        .when(e.key_candidate, KEY)
        .otherwise(UNKNOWN)
    )
