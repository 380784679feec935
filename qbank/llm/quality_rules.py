r"""Line-first quality rules, with DataFrame functions only.

Every line is judged on its own (end punctuation, navigation, boilerplate,
symbol noise) and by its neighbours (runs of short lines without end marks are
navigation, a heading alone is not); lines that fail are removed; a document that loses too much of
its text that way, or fails a base measure, is rejected.

Defined results: null text counts as no words and is rejected; an empty text
likewise; lines without a word are neither judged nor counted; a repeated row
is judged again, with the same verdict; columns of other names pass through
untouched, and ``text`` is the only one read.  There is no shuffle: each
document is judged where it is read, whatever its length.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qbank.llm.common import SPACE, fence

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rules:
    """Parameters; shares are of the text's word characters."""

    min_words: int = 50
    max_repeat_percent: int = 50
    #: A line of at least so many words must hold a sentence end somewhere.
    long_line_words: int = 25
    #: A line is noise above this share of symbol characters.
    max_symbol_percent: int = 8
    #: A line is navigation with so many bars, or chevrons, at a bar per 8 words or more.
    min_bars: int = 3
    #: So many lines on end of at most so many words (and characters), none with an end mark, are navigation; blank lines between them don't count.
    min_run: int = 6
    run_words: int = 4
    run_chars: int = 60
    #: A line with more than this share of its words shouted (ending in ``!!``) is boilerplate.
    max_shout_percent: int = 30
    #: Lower-case substrings of boilerplate lines, in English, German, French and Spanish.
    phrases: tuple[str, ...] = (
        "cookie policy", "accept cookies", "terms of use", "privacy policy", "sign in to",
        "subscribe to our newsletter", "javascript is disabled", "enable javascript", "lorem ipsum",
        "click here to", "share on facebook",
        "cookie-richtlinie", "cookies akzeptieren", "datenschutzerklärung", "nutzungsbedingungen", "newsletter abonnieren", "javascript ist deaktiviert",
        "politique de cookies", "accepter les cookies", "politique de confidentialité", "conditions d'utilisation", "abonnez-vous à notre", "javascript est désactivé",
        "política de cookies", "aceptar cookies", "política de privacidad", "términos de uso", "suscríbete a nuestr", "javascript está desactivado",
    )
    #: A document that loses more than this share of its word characters is rejected.
    max_lost_percent: int = 40


def words(text: Column) -> Column:
    r"""The words ``[^\x20\x09-\x0D]+`` of a text; of null, an empty array."""
    spaced = F.translate(F.coalesce(text, F.lit("")), SPACE[1:], " " * len(SPACE[1:]))
    return F.array_remove(F.split(spaced, " "), "")  # splitting at one character needs no pattern


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def window_hashes(words: Column) -> Column:
    """64-bit hashes of the three-word windows, in place; with fewer words, none."""
    at = F.sequence(F.lit(1), F.size(words) - 2)
    hashed = F.transform(at, lambda i: F.xxhash64(F.get(words, i - 1), F.get(words, i), F.get(words, i + 1)))
    return F.when(F.size(words) >= 3, hashed).otherwise(F.array().cast("array<bigint>"))


def sorted_windows(hashes: Column) -> Column:
    """The windows as (hash, place) in order, null if no two are equal: most texts are done by then."""
    pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), (i + 1).alias("i")))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), F.sort_array(pairs))


def repeat_words(windows: Column) -> Column:
    """Words inside three-word windows that occur twice or more, the first included.

    Sorting (hash, place) has brought equal windows together, so a text of n
    words costs n log n, not n squared.  ``windows`` must be a column, not an
    expression: it is read at every place.
    """
    again = F.filter(
        windows,
        lambda x, k: F.coalesce(F.get(windows, k + 1)["h"] == x["h"], F.lit(False))
        | F.coalesce(F.get(windows, k - 1)["h"] == x["h"], F.lit(False)),
    )
    covered = F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
    return F.coalesce(F.size(F.array_distinct(covered)), F.lit(0)).cast("long")


def _measures(df: DataFrame, rules: Rules) -> DataFrame:
    """``df`` and the base measures of its column ``text``.

    The word, line and window arrays are columns of inner projections, so that
    each is computed once.  ``_phrase``, ``_bars``, ``_shout`` tell of the whole
    text whether any line can fail a rule at all.
    """
    df = df.withColumn("_text", F.coalesce(F.col("text"), F.lit("")))
    df = df.withColumns({"_words": words(F.col("text")), "_lines": F.split("_text", "\n", -1), "_low": F.lower("_text")})
    df = df.withColumns(
        {
            "_full": F.filter("_lines", lambda x: F.btrim(x, F.lit(SPACE)) != ""),
            "_hashes": window_hashes(F.col("_words")),
            "n_symbols": (F.length("_text") - F.length(without(F.col("_text"), SYMBOLS))).cast("long"),
            "_bars": F.contains("_text", F.lit("|")) | F.contains("_text", F.lit("»")) | F.contains("_text", F.lit("›")),
            "_shout": F.contains("_text", F.lit("!!")),
            "_phrase": reduce(or_, (F.contains("_low", F.lit(x)) for x in rules.phrases), F.lit(False)),
        }
    )
    df = df.withColumn("_windows", sorted_windows(F.col("_hashes")))
    return df.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_dup_lines": (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long"),
            "n_repeat_words": repeat_words(F.col("_windows")),
        }
    )


def line_fails(line: Column, rules: Rules) -> Column:
    """Whether a line is removed.  A line without a word never fails.

    Cheap tests come first; the counts behind them run only where those hold.
    """
    chars = F.length(without(line, SPACE))
    n = F.size(words(line))
    bars = F.length(line) - F.length(without(line, "|»›"))
    symbols = F.length(line) - F.length(without(line, SYMBOLS))
    shouts = F.regexp_count(line, F.lit(r"!!(?=\s|$)"))
    phrases = "|".join(re.escape(x) for x in rules.phrases) or "(?!)"
    fails = (
        (F.col("_phrase") & F.rlike(F.lower(line), F.lit(phrases)))
        | ((F.col("n_symbols") > 0) & (symbols * 100 > chars * rules.max_symbol_percent))
        | (F.col("_bars") & (bars >= rules.min_bars) & (bars * 8 >= n))
        | (F.col("_shout") & (shouts * 100 > n * rules.max_shout_percent))
        | ((F.length(line) >= 2 * rules.long_line_words - 1) & ~F.rlike(line, F.lit(r"[.!?…:;。！？]")) & (n >= rules.long_line_words))
    )
    return fails & (chars > 0)


#: Columns that ``judge`` adds.
ADDED = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "cleaned_text", "lost_chars", "base_failed", "kept",
)


#: Marks that end a line of prose or a part of it.
END_MARKS = ".!?…:;,。！？"


def runs_of_short_lines(lines: Column, rules: Rules) -> Column:
    """For each line ``1`` if it is one of a run of short lines without end marks, else ``0``: menus, lists of links.

    Each line becomes a letter (n: such a line, b: blank, x: another), so that a run is a run of letters.
    """

    def letter(line: Column) -> Column:
        bare = F.btrim(line, F.lit(SPACE))
        open_ = F.instr(F.lit(END_MARKS), F.right(bare, F.lit(1))) == 0
        short = (F.length(bare) <= rules.run_chars) & open_ & (F.size(words(bare)) <= rules.run_words)
        return F.when(bare == "", "b").when(short, "n").otherwise("x")

    parts = F.regexp_extract_all(F.array_join(F.transform(lines, letter), ""), F.lit("[nb]+|x"), 0)
    short = lambda t: F.length(t) - F.length(F.replace(t, F.lit("n"), F.lit("")))
    told = F.transform(parts, lambda t: F.repeat(F.when(short(t) >= rules.min_run, "1").otherwise("0"), F.length(t)))
    return F.when(F.size(lines) >= rules.min_run, F.split(F.array_join(told, ""), ""))


def judge(df: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``df`` with the columns of ``ADDED``, which replace columns of the same names."""
    out = _measures(df.select(F.struct(*df.columns).alias("_row"), F.col("text")), rules)
    out = out.withColumn("_menu", runs_of_short_lines(F.col("_lines"), rules))
    out = out.withColumn("_menus", F.coalesce(F.array_contains("_menu", "1"), F.lit(False)))
    menu = lambda x, i: F.col("_menus") & (F.btrim(x, F.lit(SPACE)) != "") & (F.get("_menu", i) == "1")
    out = out.withColumn("_left", F.filter("_lines", lambda x, i: ~(menu(x, i) | line_fails(x, rules))))
    out = out.withColumns(
        {
            "cleaned_text": F.when(F.col("text").isNotNull(), F.array_join("_left", "\n")),
            "base_failed": fence(
                (F.col("n_words") < rules.min_words)
                | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
            ),
        }
    )
    left = F.when(F.size("_left") == F.size("_lines"), F.col("word_chars")).otherwise(
        F.length(without(F.coalesce("cleaned_text", F.lit("")), SPACE))
    )
    out = out.withColumn("lost_chars", (F.col("word_chars") - left).cast("long"))
    verdict = 100 * F.col("lost_chars") <= rules.max_lost_percent * F.col("word_chars")
    out = out.withColumn("kept", fence(~F.col("base_failed") & verdict))
    return out.select(*(F.col("_row")[c].alias(c) for c in df.columns if c not in ADDED), *ADDED)


def clean(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The documents that are kept, with their failing lines removed; columns as before."""
    judged = judge(docs.select(F.struct(*docs.columns).alias("_doc"), "text"), rules).where("kept")
    new = {"text": F.col("cleaned_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("cleaned_text").cast(dict(docs.dtypes)["n_chars"])
    return judged.select(*(new.get(c, F.col("_doc")[c]).alias(c) for c in docs.columns))
