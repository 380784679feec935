"""Reports over sessions and errors whose groups are never gathered whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from qbank.functions import text, variants

#: Fixed patterns of an item's tags.
KEY_TAG = r"(?i)\[\[\s*clave\s*=\s*[^\]]+?\s*\]\]"
SOLUTION_TAG = r"(?i)\[\[\s*solucion(?:ario)?\s*=\s*[^\]]+?\s*\]\]"
#: What stands for an unclassified error, and for no filter.
UNCLASSIFIED, ALL = "Error sin clasificar", "todos"


def first_of_each(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each key with their rank; Spark cuts to ``k`` a key before the shuffle and again behind it."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def error_report(entries: DataFrame, record: str, scope: str, message: str, order: str, examples: int = 3) -> DataFrame:
    """Errors by the key of their message: count, scopes, records, and the first different messages.

    Only one row for each key and message, and then ``examples`` a key, are sorted.
    """
    key = F.coalesce(F.nullif(text.error_group(F.col(message)), F.lit("")), F.lit(UNCLASSIFIED))
    rows = entries.select(key.alias("k"), F.col(record).alias("record"), F.col(scope).alias("scope"), F.trim(F.coalesce(message, F.lit(""))).alias("message"), F.col(order).alias("at"))
    counted = rows.groupBy("k").agg(F.count("*").alias("n"), F.countDistinct("scope").alias("scopes"), F.countDistinct("record").alias("records"))
    seen = rows.groupBy("k", "message").agg(F.min("at").alias("at"))
    shown = first_of_each(seen, ["k"], [F.col("at"), F.col("message")], examples)
    listed = shown.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("rank", "message"))).alias("first"))
    return counted.join(listed, "k").select("k", "n", "scopes", "records", F.transform("first", lambda x: x["message"]).alias("examples"))


def numbered_solutions(sessions: DataFrame, session: str, solutions: str) -> DataFrame:
    """``session, number``: the numbers (above 0) for which a session's JSON map has a solution group that is not empty."""
    each = sessions.select(session, F.explode(variants.members(F.try_parse_json(solutions))).alias("key", "held"))
    number = F.trim("key").try_cast("int")
    return each.where((number > 0) & (F.size(variants.solution_groups(F.col("held"))) > 0)).select(session, number.alias("number")).distinct()


def session_stats(items: DataFrame, solved: DataFrame, session: str, number: str, item: str) -> DataFrame:
    """Items of each session with and without key and solution (by tag, or by ``solved``, session and number), and different numbers."""
    keyed = F.rlike(F.coalesce(item, F.lit("")), F.lit(KEY_TAG))
    rows = items.join(solved.select(session, F.col("number").alias(number), F.lit(True).alias("_solved")), [session, number], "left")
    has = F.rlike(F.coalesce(item, F.lit("")), F.lit(SOLUTION_TAG)) | (F.coalesce("_solved", F.lit(False)) & (F.col(number) > 0))
    out = rows.groupBy(session).agg(
        F.count("*").alias("items"), F.count_if(keyed).alias("with_key"), F.count_if(has).alias("with_solution"),
        F.countDistinct(F.when(F.col(number) > 0, F.col(number))).alias("numbers"),
    )
    return out.withColumns({"without_key": F.col("items") - F.col("with_key"), "without_solution": F.col("items") - F.col("with_solution")})


def browsed(books: DataFrame, rows: DataFrame, book: str, ready: Column, wanted: dict[str, str], word: str = ALL) -> DataFrame:
    """books whose fields equal the wanted ones (all: no filter) as search keys; ``listo``: some row ready, ``pendiente``: not every one."""
    out = books
    for column, value in wanted.items():
        key = text.search_key(F.lit(value))
        out = out.where((key == ALL) | (text.search_key(F.col(column)) == key))
    if word in ("listo", "pendiente"):
        counts = rows.groupBy(book).agg(F.count_if(ready).alias("_ready"), F.count("*").alias("_all"))
        some, all_ = F.coalesce("_ready", F.lit(0)), F.coalesce("_all", F.lit(0))
        out = out.join(counts, book, "left").where(some > 0 if word == "listo" else some < all_).drop("_ready", "_all")
    return out
