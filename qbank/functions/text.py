"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from qbank.functions.variants import let

#: The accented Latin letters that keys fold, and what they become.
ACCENTED = "áéíóúüñàèìòùâêîôûäëïöçãõÁÉÍÓÚÜÑÀÈÌÒÙÂÊÎÔÛÄËÏÖÇÃÕ"
FOLDED = "aeiouunaeiouaeiouaeiocaoAEIOUUNAEIOUAEIOUAEIOCAO"
#: The vowels that the SQL-side key folds.
VOWELS, PLAIN_VOWELS = "ÁÉÍÓÚÜáéíóúü", "AEIOUUaeiouu"


def text_key(c: Column) -> Column:
    """Accent-free key: folded accents, one space, trimmed, lower case.  One key for both sides."""
    return F.lower(F.trim(F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), ACCENTED, FOLDED), r"\s+", " ")))


def vowel_key(c: Column) -> Column:
    """Trimmed, vowels without accents, lower case."""
    return F.lower(F.translate(F.trim(c), VOWELS, PLAIN_VOWELS))


def search_key(c: Column) -> Column:
    """S3: the key with punctuation as spaces."""
    return F.trim(F.regexp_replace(text_key(c), "[^a-z0-9]+", " "))


def slug(c: Column, default: str = "origen") -> Column:
    """Runs outside a-z0-9 become one underscore; nothing left gives the default."""
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(text_key(c), "[^a-z0-9]+", "_"), "^_+|_+$", ""), F.lit("")), F.lit(default))


def safe_stem(c: Column, default: str = "item") -> Column:
    """A file stem of letters, digits, dot, dash and underscore."""
    kept = F.regexp_replace(F.regexp_replace(F.trim(c), "[^A-Za-z0-9._-]+", "_"), "^[._]+|[._]+$", "")
    return F.coalesce(F.nullif(kept, F.lit("")), F.lit(default))


def tag_pattern(name: str) -> str:
    return rf"(?i)\[\[\s*{name}\s*=\s*([^\]]*?)\s*\]\]"


def first_tag(c: Column, name: str) -> Column:
    """The first value of ``[[name=value]]``, blank if there is none."""
    return F.regexp_extract(c, tag_pattern(name), 1)


def last_tag(c: Column, name: str) -> Column:
    """The last value that is not blank; null if there is none."""
    values = F.filter(F.regexp_extract_all(c, F.lit(tag_pattern(name)), 1), lambda x: F.trim(x) != "")
    return F.get(values, F.size(values) - 1)


def strip_tags(c: Column) -> Column:
    """The text without its ``[[name=value]]`` tags."""
    return F.trim(F.regexp_replace(c, r"\[\[[^\]]*\]\]", ""))


HEADER = r"\\item\s*\[\s*\\textbf\{\s*([0-9]+)\s*\.?\s*\}\s*\]"


def insert_after_header(c: Column, tag: Column) -> Column:
    """A tag put right behind the item header, or in front where there is none."""
    at = F.regexp_extract(c, HEADER, 0)
    return F.when(at == "", F.concat(tag, c)).otherwise(
        F.concat(F.substring(c, F.lit(1), F.instr(c, at) + F.length(at) - 1), tag, F.substring(c, F.instr(c, at) + F.length(at), F.length(c)))
    )


def exam_year(c: Column) -> Column:
    """A year of 1900-2099 standing alone."""
    return F.nullif(F.regexp_extract(c, "(?:^|[^0-9])((?:19|20)[0-9]{2})(?:[^0-9]|$)", 1), F.lit("")).try_cast("int")


def exam_process(c: Column) -> Column:
    """The roman or arabic number behind ``proceso``, ``proc`` or ``admisión``."""
    p = r"(?i)(?:^|[^A-Za-z0-9_])(?:proceso|proc\.?|admisi[oóÓ]n)\s*[:#-]?\s*([0-9IVXLCDM-]+)(?![A-Za-z0-9_])"
    return F.nullif(F.upper(F.regexp_extract(c, p, 1)), F.lit(""))


def exam_area(c: Column) -> Column:
    """The code behind ``área``."""
    return F.nullif(F.upper(F.regexp_extract(c, r"(?i)(?:^|[^A-Za-z0-9_])[aáÁ]rea\s*[:#-]?\s*([A-Z0-9]+)(?![A-Za-z0-9_])", 1)), F.lit(""))


def item_number(c: Column) -> Column:
    """The number of an item header ``\\item[\\textbf{n.}]``; null if there is none."""
    return F.nullif(F.regexp_extract(c, HEADER, 1), F.lit("")).try_cast("int")


def answer_any(c: Column) -> Column:
    """S9, loader: the first letter A-E anywhere."""
    return F.nullif(F.upper(F.regexp_extract(c, "(?i)([A-E])", 1)), F.lit(""))


def answer_word(c: Column) -> Column:
    """S9, schema: the first letter A-E that stands alone."""
    return F.nullif(F.upper(F.regexp_extract(c, r"(?i)(?:^|[^A-Za-z0-9_])([A-E])(?:[^A-Za-z0-9_]|$)", 1)), F.lit(""))


def answer_first(c: Column) -> Column:
    """S9, sanitiser: the first character, if it is one of A-E."""
    first = F.upper(F.substring(F.trim(c), 1, 1))
    return F.when(first.isin("A", "B", "C", "D", "E"), first)


def marker_parts(c: Column) -> Column:
    """An image marker ``base-num[-opt]`` as struct(base, num, opt)."""
    p = r"^(.*?)-([0-9]+)(?:-([A-Ea-e]))?$"
    hit = F.rlike(c, F.lit(p))
    return F.when(
        hit,
        F.struct(
            F.regexp_extract(c, p, 1).alias("base"),
            F.regexp_extract(c, p, 2).cast("int").alias("num"),
            F.nullif(F.upper(F.regexp_extract(c, p, 3)), F.lit("")).alias("opt"),
        ),
    )


def single_line(c: Column) -> Column:
    """Lines trimmed and joined, spaces collapsed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def metric_text(c: Column) -> Column:
    """CRLF as LF, runs of blanks as one, three line ends or more as two, trimmed."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n?", "\n")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def ocr_prefix(c: Column) -> Column:
    """``[CONT.]``, or ``<n>`` without leading zeros, or blank."""
    number = F.regexp_extract(c, r"^\s*<\s*0*([0-9]+)\s*\.?\s*>", 1)
    return F.when(F.rlike(c, F.lit(r"(?i)^\s*\[CONT\.?\]")), F.lit("[CONT.]")).when(number != "", F.concat(F.lit("<"), number, F.lit(">"))).otherwise("")


def option_labels(c: Column) -> Column:
    """The distinct labels A-E before a bracket, in first order."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?:^|[^A-Za-z0-9])([A-E])\)"), 1))


def label_recall(target: Column, got: Column) -> Column:
    """The share of the target's labels that are found; 1 where it has none."""
    return let(
        option_labels(target),
        lambda want: F.when(F.size(want) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(want, option_labels(got))) / F.size(want)),
    )


#: What counts as a token or an anchor of a statement, the letters that are tokens alone, and the shares that make two statements one.
TOKEN, ANCHOR = r"[a-z0-9\\]+", r"[A-Za-z]\s*\([^)]{0,16}\)"
LONE_TOKENS = ("x", "y", "f", "g", "h")
SAME_SHARE, ANCHORED_SHARE, LONGER = 0.72, 0.55, 1.1


def merge_fragments(a: Column, b: Column) -> Column:
    """One statement of two: the one that contains the other, the first if tokens overlap enough, else both joined.

    A fragment that contains the first one replaces it only if clearly longer.
    """
    white = F.lit(" \t\r\n")
    a, b = F.btrim(F.coalesce(a, F.lit("")), white), F.btrim(F.coalesce(b, F.lit("")), white)
    ka, kb = text_key(a), text_key(b)
    tokens = lambda k: F.array_distinct(
        F.filter(F.regexp_extract_all(k, F.lit(TOKEN), 0), lambda x: (F.length(x) > 1) | x.isin(*LONE_TOKENS))
    )
    anchors = lambda c: F.transform(F.regexp_extract_all(c, F.lit(ANCHOR), 0), text_key)
    ta, tb = tokens(ka), tokens(kb)
    share = F.try_divide(F.size(F.array_intersect(ta, tb)), F.least(F.size(ta), F.size(tb)))
    return (
        F.when(ka == "", b)
        .when((kb == "") | F.contains(ka, kb), a)
        .when(F.contains(kb, ka) & (F.length(kb) > F.floor(LONGER * F.length(ka))), b)
        .when((share >= SAME_SHARE) | (F.arrays_overlap(anchors(a), anchors(b)) & (share >= ANCHORED_SHARE)), a)
        .otherwise(F.concat(a, F.lit(" "), b))
    )


#: Tokens that damaged UTF-8 leaves, and phrases of a prompt that came back.
MOJIBAKE = ("Ã", "â", "Ë", "\ufffd")
ECHOES = ("no agregue texto", "no agregues texto")
#: Fixed formats: option labels, words, and a phrase of two to six words that comes again three times or more.
LABEL = r"(?<![A-Za-z0-9])([A-Ea-e])\)\s*"
PLAIN_WORD = r"[A-Za-zÁÉÍÓÚáéíóúÑñ0-9]+"
PHRASE_AGAIN = r"(?i)(\b[\wáéíóúñ]{2,}\b(?:\s+\b[\wáéíóúñ]{2,}\b){1,5})\s+(?:\1\b[\s\.,;:!?-]*){3,}"


def mojibake(c: Column) -> Column:
    """How often damaged UTF-8 shows."""
    return F.length(c) - F.length(F.translate(c, "".join(MOJIBAKE), ""))


def imbalance(c: Column) -> Column:
    """The open and closed delimiters' differences, summed; option labels such as ``A)`` don't count."""
    plain = F.regexp_replace(c, LABEL, "")
    n = lambda x: F.length(plain) - F.length(F.replace(plain, F.lit(x), F.lit("")))
    return F.abs(n("(") - n(")")) + F.abs(n("[") - n("]")) + F.abs(n("{") - n("}"))


def few_words(c: Column) -> Column:
    """Of 40 words or more, less than a quarter are different."""
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(PLAIN_WORD), 0)
    return (F.size(words) >= 40) & (F.size(F.array_distinct(words)) < 0.25 * F.size(words))


def repetitive(c: Column) -> Column:
    """An echoed phrase of the prompt, a phrase repeated on the spot, or few different words."""
    low = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    twice = F.lit(False)
    for echo in ECHOES:
        twice = twice | ((F.length(low) - F.length(F.replace(low, F.lit(echo), F.lit("")))) >= 2 * len(echo))
    return twice | few_words(low) | F.rlike(low, F.lit(PHRASE_AGAIN))


def small_number(n: Column, start: Column) -> Column:
    """An outlier from 90 up becomes its last digit, or else its last two, if that is at most two beyond an expected 1-15."""
    near = lambda x: (x > 0) & (x - start).between(0, 2)
    one, two = F.pmod(n, F.lit(10)), F.pmod(n, F.lit(100))
    may = (n >= 90) & start.between(1, 15)
    return F.when(may & near(one), one).when(may & near(two), two).otherwise(n)


def stable_percent(key: Column) -> Column:
    """The first 8 hex digits of the key's SHA-1, modulo 100."""
    return F.pmod(F.conv(F.substring(F.sha1(key), 1, 8), 16, 10).cast("bigint"), F.lit(100)).cast("int")


def split_of(key: Column, labels: tuple[str, str, str] = ("train", "validation", "test")) -> Column:
    """80/10/10 by the key."""
    p = stable_percent(key)
    return F.when(p < 80, labels[0]).when(p < 90, labels[1]).otherwise(labels[2])


def stable_id(*parts: Column) -> Column:
    """The first 16 hex digits of the SHA-1 of the joined parts."""
    return F.substring(F.sha1(F.concat_ws("|", *(p.cast("string") for p in parts))), 1, 16)


def meta_reference(c: Column) -> Column:
    """``catalog:kind:id:text``, ``direct:kind:text``, a bare id, or text."""
    p4, p3 = F.split(c, ":", 4), F.split(c, ":", 3)
    s = lambda source, kind, ident, text: F.struct(source.alias("source"), kind.alias("kind"), ident.alias("id"), text.alias("text"))
    none, null_id = F.lit(""), F.lit(None).cast("bigint")
    return (
        F.when(F.startswith(c, F.lit("catalog:")), s(F.lit("catalog"), F.coalesce(F.get(p4, F.lit(1)), none), F.get(p4, F.lit(2)).try_cast("bigint"), F.coalesce(F.get(p4, F.lit(3)), none)))
        .when(F.startswith(c, F.lit("direct:")), s(F.lit("direct"), F.coalesce(F.get(p3, F.lit(1)), none), null_id, F.coalesce(F.get(p3, F.lit(2)), none)))
        .when(F.rlike(c, F.lit("^[0-9]+$")), s(F.lit("catalog"), none, c.try_cast("bigint"), none))
        .otherwise(s(F.lit("direct"), none, null_id, c))
    )


def canonical_course(c: Column) -> Column:
    """One spelling of the course whose key is ``trigonometria``."""
    return F.when(text_key(c) == "trigonometria", F.lit("Trigonometría")).otherwise(F.trim(c))


def error_group(message: Column) -> Column:
    """The key under which error messages are gathered: ``code:[x]``, the text before a path, before a colon, or with ids masked."""
    m = F.trim(F.coalesce(message, F.lit("")))
    code = F.regexp_extract(m, r"^([A-Za-z0-9_.-]+:\[[^\]]+\])", 1)
    path = F.trim(F.regexp_extract(m, r"^(.+?):\s*[A-Za-z]:\\", 1))
    colon = F.trim(F.regexp_extract(m, "^([^:]{3,80}):", 1))
    masked = F.regexp_replace(F.regexp_replace(m, "[A-Fa-f0-9]{8,}", "<id>"), "[0-9]+", "#")
    blank = F.lit("")
    return F.coalesce(F.nullif(code, blank), F.nullif(path, blank), F.nullif(colon, blank), F.trim(F.substring(masked, 1, 120)))


def snippet(c: Column, n: int = 240) -> Column:
    """The first n characters."""
    return F.substring(c, 1, n)


def render_item(number: Column, statement: Column, options: Column, tag: Column | None = None) -> Column:
    """An item with its options between £ and æ."""
    parts = F.transform(F.array(*(F.lit(x) for x in "ABCDE")), lambda k: F.concat(k, F.lit(")"), F.coalesce(options[k], F.lit(""))))
    p = lambda i: F.get(parts, F.lit(i))
    body = F.concat(F.lit("£"), p(0), F.lit("æ"), p(1), F.lit("æ"), p(2), F.lit("£"), p(3), F.lit("ææ"), p(4), F.lit("£"))
    image = F.when(tag.isNull(), F.lit("")).otherwise(F.concat(F.lit(" [[Imagen="), tag, F.lit("]]"))) if tag is not None else F.lit("")
    return F.concat(F.lit("\\item[\\textbf{"), number.cast("string"), F.lit(".}] "), statement, image, body)
