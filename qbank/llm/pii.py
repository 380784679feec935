r"""Format-preserving pseudonyms for personal data, with DataFrame functions only.

Personal data are found by pattern, validated (Luhn, mod 97, octets, areas,
calendar), and replaced by a keyed Feistel permutation within their own format:
a card number becomes a card number with a right check digit, a date another
date in the same notation.  The permutation depends on the key and the value
alone, so equal values stay linked across documents, whatever their separators,
and different values stay different.

What is found: e-mail addresses (the local part is permuted, letters of any
script belong to it), access keys and values after ``password=``, ``"token":``,
``Bearer`` and the like, card numbers, IBANs, IPv4 and IPv6 addresses, US social
security numbers, telephone numbers (international, and the national forms of
the United States, France, Spain and Germany), dates of 1900-2099.
The pattern that matched decides the kind.  Secrets (keys, tokens, values after
a keyword) are permuted whatever they look like; any other text that fits a
pattern and fails its validation is left as it is, but for a card number inside
what looks like an IBAN.

One pass over a text marks every match and its kind, so the cost is linear in
the text: no pattern looks further than its own run of characters.

Defined results: null stays null, empty stays empty; texts are read whole;
repeated rows and values come out alike; other columns pass through.  There is
no shuffle and no Python on the data's path.
"""

from __future__ import annotations

import secrets
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qbank.llm.common import fence

DIGITS, LOWER, UPPER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
#: Letters of names beyond ASCII: those of Latin-1, Greek and Cyrillic, by case; characters of no alphabet stay.
NAMES = (DIGITS, LOWER, UPPER, *("".join(c for c in map(chr, span) if c.isalpha() and c.islower() == low and c.isupper() != low) for span in (range(0xC0, 0x100), range(0x391, 0x3CA), range(0x410, 0x450)) for low in (True, False)))
#: Digits and letters of an IPv6 address, by case.
GROUPS_OF_HEX = (DIGITS, "abcdef", "ABCDEF")


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: Every match holds a match of this; a text without any kind's sign isn't searched.
    sign: str


#: Where several fit at one place, the first one has it.  No pattern has a numbered group.
KINDS = (
    Kind(
        "email",
        r"(?<![\p{L}0-9._%+\-])[._%+\-]*+[\p{L}0-9][\p{L}0-9._%+\-]*+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+){0,125}\.[A-Za-z]{2,}",
        "@",
    ),
    Kind("access", r"(?<![A-Za-z0-9])(?:AKIA|ASIA|AROA|AIDA)[A-Z0-9]{16}(?![A-Za-z0-9])", "AKIA|ASIA|AROA|AIDA"),
    Kind(
        "prefixed",
        r"(?<![A-Za-z0-9])(?:ghp_|gho_|sk-|sk_live_|xoxb-|xoxp-|glpat-|github_pat_)[A-Za-z0-9_\-]{16,}",
        "ghp_|gho_|sk-|sk_live_|xoxb-|xoxp-|glpat-|github_pat_",
    ),
    Kind(
        "secret",
        r"(?<=(?i:password|passwd|passwort|pwd|token|secret|api[ _\-]{0,1}key)[\"']{0,1}[ ]{0,2}[=:][ ]{0,2}[\"']{0,1})"
        r"(?:[A-Za-z0-9+/_.~!@#$%^&*?\-]{6,}|(?=[A-Za-z]{0,4}[0-9])[A-Za-z0-9]{4,5}(?![A-Za-z0-9]))"
        r"|(?<=\b(?i:bearer)[ ]{1,2})[A-Za-z0-9+/_.~=\-]{16,}",
        "(?i:password|passwd|passwort|pwd|token|secret|api|bearer)",
    ),
    Kind("hex", r"(?<![A-Za-z0-9])[0-9a-f]{32,128}(?![A-Za-z0-9])", "[0-9]|[a-f]{32}"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "[0-9]"),
    Kind("ip", r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])", "[0-9]"),
    Kind(
        "ip6",
        r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]{0,39}[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}"
        r"|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|(?:[0-9A-Fa-f]{1,4}:){1,7}:)(?![0-9A-Za-z:])",
        ":[0-9A-Fa-f]{0,4}:",
    ),
    Kind("iso_date", r"(?<![0-9\-/.])[0-9]{4}(?<s1>[\-/.])[0-9]{1,2}\k<s1>[0-9]{1,2}(?![0-9]|[\-/.][0-9])", "[0-9]"),
    Kind("day_date", r"(?<![0-9\-/.])[0-9]{1,2}(?<s2>[\-/.])[0-9]{1,2}\k<s2>[0-9]{4}(?![0-9]|[\-/.][0-9])", "[0-9]"),
    Kind(
        "card",
        r"(?<![0-9])(?:[0-9]{4}(?<s3>[ \-])[0-9]{4}\k<s3>[0-9]{4}\k<s3>[0-9]{4}|3[0-9]{3}(?<s4>[ \-])[0-9]{6}\k<s4>[0-9]{5}|[0-9]{13,19})(?![0-9])",
        "[0-9]",
    ),
    Kind("ssn", r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])", "[0-9]"),
    Kind(
        "phone",
        r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .\-]?)?(?:\([0-9]{2,4}\)[ .\-]?|[0-9]{3}[ .\-])[0-9]{3}[ .\-]?[0-9]{4}(?![0-9])"
        r"|(?<![0-9A-Za-z])\+[0-9]{1,3}(?:[ .\-]?[0-9]{1,4}){2,6}(?![0-9])"
        # National forms: France, Spain, Germany.
        r"|(?<![0-9A-Za-z+])0[1-9](?:[ .\-]?[0-9]{2}){4}(?![0-9])"
        r"|(?<![0-9A-Za-z+])[6-9][0-9]{2}(?<s5>[ .\-])[0-9]{3}\k<s5>[0-9]{3}(?![0-9])"
        r"|(?<![0-9A-Za-z+])0[1-9][0-9]{1,4}[ /\-][0-9]{4,9}(?![0-9])",
        "[0-9]",
    ),
)
FOUND = "|".join(f"(?<{k.name.replace('_', '')}>{k.pattern})" for k in KINDS)
HINT = "|".join(dict.fromkeys(k.sign for k in KINDS))
#: A match is put between two marks, behind as many ticks as there are kinds before its own.
MARK, OWN, TICK = "\x01\x02", "\x01\x03", "\x04"
MARKED = MARK + TICK.join(f"${{{k.name.replace('_', '')}}}" for k in KINDS) + MARK

FIRST_DAY, DAYS = "1900-01-01", 73_049  # to 2099-12-31
AREAS, GROUPS, SERIALS = 898, 99, 9999


@dataclass(frozen=True)
class Pseudonyms:
    #: The secret that the permutations depend on.
    key: str
    rounds: int = 8  # even

    def __post_init__(self) -> None:
        if not self.key or self.rounds < 4 or self.rounds % 2:
            raise ValueError("a key, and an even number of rounds from four, are needed")


#: The session setting that holds the key; its name makes Spark redact it in logs and pages.
KEY_SETTING = "spark.qbank.pseudonyms.secret"


def session_key(spark: SparkSession) -> Pseudonyms:
    """Pseudonyms with the session's key.

    Where none is set, a random one is made and kept for the session: values
    then stay linked within it, and with no other.
    """
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, key)
    return Pseudonyms(key)


def _hash(p: Pseudonyms, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(p.key), *(x.cast("string") for x in parts)), 512)


def once(value: Column, use) -> Column:  # noqa: ANN001
    """``use(value)``, with ``value`` computed a single time: as a lambda's variable, not written out at each use."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def permute_text(s: Column, p: Pseudonyms, alphabets: tuple[str, ...] | Column = (DIGITS, LOWER, UPPER)) -> Column:
    """Feistel over the halves of a string: each character moves within its own alphabet; others stay."""
    sets = alphabets if isinstance(alphabets, Column) else F.array(*map(F.lit, alphabets))

    def shifted(half: Column, key: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            k = F.conv(F.substring(key, F.pmod(i, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int")
            moved = lambda a: F.substring(a, F.pmod(F.instr(a, c) - 1 + k, F.length(a)) + 1, F.lit(1))
            return F.coalesce(F.get(F.transform(F.filter(sets, lambda a: F.instr(a, c) > 0), moved), F.lit(0)), c)

        return F.when(F.length(half) == 0, F.lit("")).otherwise(F.array_join(F.transform(F.split(half, ""), one), ""))

    def step(acc: Column, r: Column) -> Column:
        new = once(_hash(p, r, F.length(s), acc["b"]), lambda key: shifted(acc["a"], key))
        return F.struct(acc["b"].alias("a"), new.alias("b"))

    cut = F.floor(F.length(s) / 2).cast("int")
    start = F.struct(F.substring(s, F.lit(1), cut).alias("a"), F.substring(s, cut + 1, F.length(s)).alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(p.rounds)), start, step, lambda acc: F.concat(acc["a"], acc["b"]))


def permute_number(x: Column, left: int, right: int, p: Pseudonyms, kind: str) -> Column:
    """Feistel over a number below left * right, as the pair (x div right, x mod right)."""
    x = x.cast("bigint")
    start = F.struct(F.floor(x / right).cast("bigint").alias("a"), F.pmod(x, F.lit(right)).cast("bigint").alias("b"))

    def step(acc: Column, r: Column) -> Column:
        size = F.when(r % 2 == 1, F.lit(left)).otherwise(F.lit(right))
        key = F.conv(F.substring(_hash(p, F.lit(kind), r, acc["b"]), 1, 14), 16, 10).cast("bigint")
        return F.struct(acc["b"].alias("a"), F.pmod(acc["a"] + key, size).cast("bigint").alias("b"))

    return F.aggregate(
        F.sequence(F.lit(1), F.lit(p.rounds)), start, step, lambda acc: acc["a"] * F.lit(right).cast("bigint") + acc["b"]
    )


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _laid(form: Column, chars: Column, places: str = "[0-9]") -> Column:
    """``chars`` put in those places of ``form`` that match ``places``, one by one."""
    return F.aggregate(
        F.sequence(F.lit(1), F.length(form)),
        F.struct(F.lit("").alias("out"), F.lit(0).alias("n")),
        lambda acc, i: F.when(
            F.rlike(F.substring(form, i, F.lit(1)), F.lit(places)),
            F.struct(F.concat(acc["out"], F.substring(chars, acc["n"] + 1, F.lit(1))).alias("out"), (acc["n"] + 1).alias("n")),
        ).otherwise(F.struct(F.concat(acc["out"], F.substring(form, i, F.lit(1))).alias("out"), acc["n"].alias("n"))),
        lambda acc: acc["out"],
    )


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def _mod97(s: Column) -> Column:
    """An IBAN, moved and with letters as numbers, modulo 97: 1 if it is valid."""
    moved = F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))
    return F.aggregate(
        F.sequence(F.lit(1), F.length(moved)),
        F.lit(0),
        lambda acc, i: F.pmod(
            F.when(
                F.instr(F.lit(UPPER), F.substring(moved, i, F.lit(1))) > 0,
                acc * 100 + F.instr(F.lit(UPPER), F.substring(moved, i, F.lit(1))) + 9,
            ).otherwise(acc * 10 + F.instr(F.lit(DIGITS), F.substring(moved, i, F.lit(1))) - 1),
            F.lit(97),
        ).cast("int"),
    )


def _valid_iban(m: Column) -> Column:
    """The longest valid number, without spaces, that ends at a space or the end (words in capitals may follow it); else null."""
    ends = F.filter(
        F.sequence(F.length(m), F.lit(15), F.lit(-1)), lambda i: (i == F.length(m)) | (F.substring(m, i + 1, F.lit(1)) == " ")
    )
    heads = F.transform(ends, lambda i: F.replace(F.substring(m, F.lit(1), i), F.lit(" "), F.lit("")))
    valid = F.filter(heads, lambda s: (F.length(s) >= 15) & (_mod97(s) == 1))
    return F.when(F.length(m) >= 15, F.get(valid, F.lit(0)))


def _new_iban(m: Column, body: Column) -> Column:
    check = F.lpad((98 - _mod97(F.concat(F.substring(m, 1, 2), F.lit("00"), body))).cast("string"), 2, "0")
    rest = F.substring(F.replace(m, F.lit(" "), F.lit("")), F.length(body) + 5, F.length(m))
    return _laid(m, F.concat(F.substring(m, 1, 2), check, body, rest), "[^ ]")


def _ip(m: Column, p: Pseudonyms) -> Column:
    at = lambda y, k: F.pmod(F.floor(y / k), F.lit(256)).cast("string")
    new = lambda y: F.concat_ws(".", at(y, 16777216), at(y, 65536), at(y, 256), at(y, 1))
    number = F.aggregate(F.split(m, r"\."), F.lit(0).cast("bigint"), lambda acc, x: acc * 256 + x.cast("bigint"))
    valid = F.forall(F.split(m, r"\."), lambda x: x.cast("int") < 256)
    return F.when(valid, once(permute_number(number, 65536, 65536, p, "ip"), new)).otherwise(m)


def _ssn(m: Column, p: Pseudonyms) -> Column:
    a, g, s = (F.get(F.split(m, "-"), F.lit(i)).cast("bigint") for i in range(3))
    valid = (a > 0) & (a != 666) & (a < 900) & (g > 0) & (s > 0)
    x = (F.when(a > 666, a - 2).otherwise(a - 1) * GROUPS + g - 1) * SERIALS + s - 1
    pad = lambda v, n: F.lpad(v.cast("string"), n, "0")

    def new(y: Column) -> Column:
        top = F.floor(y / SERIALS).cast("bigint")
        area = F.floor(top / GROUPS).cast("bigint") + 1
        area = F.when(area >= 666, area + 1).otherwise(area)
        return F.concat_ws("-", pad(area, 3), pad(F.pmod(top, F.lit(GROUPS)) + 1, 2), pad(F.pmod(y, F.lit(SERIALS)) + 1, 4))

    return F.when(valid, once(permute_number(x, AREAS * GROUPS, SERIALS, p, "ssn"), new)).otherwise(m)


def _date(m: Column, p: Pseudonyms) -> Column:
    """Another day of 1900-2099 in the same notation; day/month/year, or month/day/year where only that is a date.

    Days up to the 12th move among themselves, and so do the later ones: only
    the latter tell which of the two orders was written, and go on telling it.
    """
    mark = F.regexp_extract(m, "[^0-9]", 0)
    start = F.lit(FIRST_DAY).cast("date")
    as_date = lambda y, mo, d: F.try_to_date(F.concat_ws("-", y, F.lpad(mo, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
    field = lambda new, pattern, old: F.when(F.length(old) == 1, F.date_format(new, pattern)).otherwise(F.date_format(new, pattern * 2))

    def walked(value: Column) -> Column:
        # 271 * 270 is a little above the days; a walk of 128 steps fails to end once in 10^27 values.
        early = F.dayofmonth(value) <= 12
        arrived = lambda v: (v < DAYS) & ((F.dayofmonth(F.date_add(start, v.cast("int"))) <= 12) == early)
        step = lambda v: permute_number(v, 271, 270, p, "date")
        first = F.struct(F.datediff(value, start).cast("bigint").alias("v"), F.lit(False).alias("done"))

        def go(acc: Column, _: Column) -> Column:
            return F.when(acc["done"], acc).otherwise(once(step(acc["v"]), lambda v: F.struct(v.alias("v"), arrived(v).alias("done"))))

        y = F.aggregate(F.sequence(F.lit(1), F.lit(128)), first, go, lambda acc: acc["v"])
        return F.when((value >= start) & (F.datediff(value, start) < DAYS), F.date_add(start, y.cast("int")))

    def parts(x: Column) -> Column:
        one, two, three = x[0], x[1], x[2]
        iso, day_first = as_date(one, two, three), as_date(three, two, one)
        year_first = F.length(one) == 4
        value = F.when(year_first, iso).otherwise(F.coalesce(day_first, as_date(three, one, two)))

        def out(new: Column) -> Column:
            year = F.date_format(new, "yyyy")
            return (
                F.when(year_first, F.concat(year, mark, field(new, "M", two), mark, field(new, "d", three)))
                .when(day_first.isNotNull(), F.concat(field(new, "d", one), mark, field(new, "M", two), mark, year))
                .otherwise(F.concat(field(new, "M", one), mark, field(new, "d", two), mark, year))
            )

        return once(once(value, walked), out)

    return F.coalesce(once(F.split(m, r"[\-/.]"), parts), m)


#: What stays at the head of an e-mail's local part, and of a prefixed key.
EMAIL_HEAD, KEY_HEAD = r"^[._%+\-]*", "^(?:ghp_|gho_|sk_live_|sk-|xoxb-|xoxp-|glpat-|github_pat_)"


def pseudonym(m: Column, kind: Column, p: Pseudonyms) -> Column:
    """The pseudonym of a match of the kind of that number, or the match itself if it isn't valid.

    What looks like an IBAN and is none is searched once more, for a card number.
    """
    numbers = [k for k, of in enumerate(KINDS) if of.name == "iban"]
    card = [k for k, of in enumerate(KINDS) if of.name == "card"][0]
    held = F.when(kind.isin(numbers) & _valid_iban(m).isNull(), F.regexp_extract(m, KINDS[card].pattern, 0)).otherwise("")

    def found(inside: Column) -> Column:
        own = inside == ""
        seen, of = F.when(own, m).otherwise(inside), F.when(own, kind).otherwise(card)
        return once(F.struct(seen.alias("m"), of.alias("k")), lambda x: once(_pseudonym(x["m"], x["k"], p), lambda new: F.when(own, new).otherwise(F.replace(m, inside, new))))

    return once(held, found)


def _pseudonym(m: Column, kind: Column, p: Pseudonyms) -> Column:
    is_a = lambda *names: kind.isin([k for k, of in enumerate(KINDS) if of.name in names])
    digits = _digits(m)
    lead = F.length(F.when(is_a("email"), F.regexp_extract(m, EMAIL_HEAD, 0)).otherwise(F.regexp_extract(m, KEY_HEAD, 0)))
    in_email = F.substring(m, lead + 1, F.instr(m, "@") - 1 - lead)
    body = (
        F.when(is_a("email"), in_email)
        .when(is_a("access"), F.substring(m, F.lit(5), F.length(m)))
        .when(is_a("prefixed"), F.substring(m, lead + 1, F.length(m)))
        .when(is_a("secret", "hex", "ip6"), m)
        .when(is_a("card"), F.when(_luhn(digits), F.substring(digits, F.lit(1), F.length(digits) - 1)))
        .when(is_a("iban"), once(_valid_iban(m), lambda s: F.substring(s, F.lit(5), F.length(s))))
        .when(is_a("phone") & F.length(digits).between(7, 15), F.substring(digits, F.greatest(F.length(digits) - 9, F.lit(1)), F.lit(10)))
    )
    sets = (
        F.when(is_a("hex"), F.array(F.lit(HEX)))
        .when(is_a("access"), F.array(F.lit(DIGITS + UPPER)))
        .when(is_a("card", "phone"), F.array(F.lit(DIGITS)))
        .when(is_a("iban"), F.array(F.lit(DIGITS), F.lit(UPPER)))
        .when(is_a("email"), F.array(*map(F.lit, NAMES)))
        .when(is_a("ip6"), F.array(*map(F.lit, GROUPS_OF_HEX)))
        .otherwise(F.array(F.lit(DIGITS), F.lit(LOWER), F.lit(UPPER)))
    )

    def laid(new: Column) -> Column:
        right = F.filter(F.sequence(F.lit(0), F.lit(9)), lambda c: _luhn(F.concat(new, c.cast("string"))))
        return (
            F.when(is_a("email"), F.concat(F.substring(m, F.lit(1), lead), new, F.substring(m, F.instr(m, "@"), F.length(m))))
            .when(is_a("access"), F.concat(F.substring(m, 1, 4), new))
            .when(is_a("prefixed"), F.concat(F.substring(m, F.lit(1), lead), new))
            .when(is_a("secret", "hex", "ip6"), new)
            .when(is_a("card"), _laid(m, F.concat(new, F.get(right, F.lit(0)).cast("string"))))
            .when(is_a("iban"), _new_iban(m, new))
            .when(is_a("phone"), _laid(m, F.concat(F.substring(digits, F.lit(1), F.length(digits) - F.length(new)), new)))
        )

    by_text = lambda b: F.when(b.isNotNull(), once(once(sets, lambda a: permute_text(b, p, a)), laid))
    return F.coalesce(
        F.when(is_a("ip"), _ip(m, p)).when(is_a("ssn"), _ssn(m, p)).when(is_a("iso_date", "day_date"), _date(m, p)).otherwise(once(body, by_text)), m
    )


ADDED = ("private_text", "n_private")


def pseudonymise(docs: DataFrame, p: Pseudonyms | None = None) -> DataFrame:
    """``docs`` with ``private_text`` and ``n_private`` (replacements), which replace such columns.

    Without ``p`` the session's key counts.
    """
    p = p or session_key(docs.sparkSession)
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("text").cast("string").alias("_text"))
    rows = rows.withColumn("_may", F.coalesce(F.rlike("_text", F.lit(HINT)), F.lit(False)))
    own, kept = F.lit(MARK[0]), F.lit(OWN)  # the text's own first marks are told from ours
    safe = F.when(F.contains("_text", own), F.replace("_text", own, kept)).otherwise(F.col("_text"))
    rows = rows.withColumn("_parts", F.when(F.col("_may"), F.split(F.regexp_replace(safe, FOUND, MARKED), MARK, -1)))
    rows = rows.withColumn("_any", F.coalesce(F.size("_parts") > 1, F.lit(False)))

    def one(x: Column, i: Column) -> Column:
        ticks = F.length(F.regexp_extract(x, f"^{TICK}*", 0))
        match = F.struct(F.translate(x, TICK, "").alias("m"), ticks.alias("kind"))
        both = lambda m, new: F.struct(new.alias("x"), (new != m).alias("hit"))
        changed = once(match, lambda v: once(pseudonym(v["m"], v["kind"], p), lambda new: both(v["m"], new)))
        return F.when(i % 2 == 1, changed).otherwise(F.struct(F.replace(x, kept, own).alias("x"), F.lit(False).alias("hit")))

    rows = rows.withColumn("_new", F.when(F.col("_any"), F.transform("_parts", one)))
    added = {
        "private_text": F.when(F.col("_any"), F.array_join(F.col("_new")["x"], "")).otherwise(F.col("_text")),
        "n_private": F.when(F.col("_any"), F.size(F.filter(F.col("_new")["hit"], lambda x: x))).otherwise(F.lit(0)).cast("long"),
    }
    return rows.select(
        *(F.col("_row")[c].alias(c) for c in docs.columns if c not in ADDED), *(fence(v).alias(c) for c, v in added.items())
    )


def clean(docs: DataFrame, p: Pseudonyms | None = None) -> DataFrame:
    """The documents with pseudonyms in their texts; columns as before."""
    out = pseudonymise(docs.select(F.struct(*docs.columns).alias("_doc"), "text"), p)
    new = {"text": F.col("private_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("private_text").cast(dict(docs.dtypes)["n_chars"])
    return out.select(*(new.get(c, F.col("_doc")[c]).alias(c) for c in docs.columns))
