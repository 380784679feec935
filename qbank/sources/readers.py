"""SRC1-SRC15: SQL, JSON, text and file sources."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import TypeVar

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qbank.operators.ordering import natural_key


def stripped(c: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(c, F.lit(" \t\r\n"))


def sql_rows(spark: SparkSession, sql: str, tables: dict[str, DataFrame]) -> DataFrame:
    """SRC1: a query over named frames, without leaving views behind."""
    return spark.sql(sql, **tables)


#: Parts of messages of connection errors that pass.
PASSING = (
    "server closed the connection unexpectedly", "connection unexpectedly", "connection refused", "connection reset by peer", "could not connect to server",
    "could not receive data from server", "ssl syscall error: eof detected", "terminating connection", "connection timed out", "timeout expired",
    "network is unreachable",
)
Got = TypeVar("Got")


def passes(error: BaseException) -> bool:
    """SRC2: the error is one of a connection that may work the next time."""
    said = str(error).lower()
    return any(x in said for x in PASSING)


def retried(connect: Callable[[], Got], attempts: int = 3, delay_s: float = 0.25) -> Got:
    """SRC2: ``connect()``, again after an error that passes; any other error, and the last one, is raised."""
    for left in reversed(range(max(1, attempts))):
        try:
            return connect()
        except Exception as e:
            if not left or not passes(e):
                raise
            time.sleep(max(0.0, delay_s))
    raise AssertionError


def jdbc(spark: SparkSession, url: str, query: str, attempts: int = 3, **options: str) -> DataFrame:
    """SRC1, SRC2: rows of a database; the driver's schema probe is retried here, lost tasks by Spark."""
    return retried(lambda: spark.read.format("jdbc").options(url=url, query=query, **options).load(), attempts)


def capabilities(df: DataFrame, optional: dict[str, tuple[str, ...]]) -> dict[str, str | None]:
    """SRC3: for each optional field the first of its column names that the frame has."""
    return {field: next((c for c in names if c in df.columns), None) for field, names in optional.items()}


def optional_column(df: DataFrame, found: dict[str, str | None], field: str, kind: str = "string") -> Column:
    """SRC3: the field's column, or typed nulls."""
    name = found.get(field)
    return F.col(name).cast(kind) if name else F.lit(None).cast(kind)


def json_records(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """SRC4: a folder of one-record JSON files as (good records, unreadable file names)."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    raw = spark.read.option("wholetext", True).text(path).select("value", F.col("_metadata.file_path").alias("file"))
    rows = raw.select("file", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    bad = F.col("r").isNull() | F.col("r._corrupt").isNotNull()
    return rows.where(~bad).select("r.*", "file").drop("_corrupt"), rows.where(bad).select("file")


def jsonl(spark: SparkSession, path: str, schema: T.StructType, limit: int | None = None) -> DataFrame:
    """SRC5: one record a line; blank lines are no records."""
    out = spark.read.schema(schema).json(path)
    return out.limit(limit) if limit else out


def paired_files(names: DataFrame, name: str = "path") -> DataFrame:
    """SRC6: every ``x.session.json`` with its ``x.session__images.json``, by canonical path."""
    p = names.select(F.regexp_replace(F.col(name), r"[\\/]+", "/").alias("p")).dropDuplicates(["p"])
    a = p.where(F.endswith("p", F.lit(".session.json"))).select(F.regexp_replace("p", r"\.session\.json$", "").alias("stem"), F.col("p").alias("session"))
    b = p.where(F.endswith("p", F.lit(".session__images.json"))).select(F.regexp_replace("p", r"\.session__images\.json$", "").alias("stem"), F.col("p").alias("images"))
    return a.join(b, "stem", "left").orderBy(F.lower("session")).select("session", "images")


def file_names(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """SRC6, SRC9: the files below a folder, without their contents."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path", "length")


@F.pandas_udf(T.StringType())
def decoded(raw: pd.Series) -> pd.Series:
    """SRC7: bytes as utf-8, else windows-1252, else latin-1."""

    def one(b: bytes | None) -> str | None:
        if b is None:
            return None
        for name in ("utf-8", "cp1252"):
            try:
                return bytes(b).decode(name)
            except UnicodeDecodeError:
                continue
        return bytes(b).decode("latin-1")

    return raw.map(one)


def latex_files(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.tex").load(path)
    return raw.select("path", decoded("content").alias("text"))


ITEM = r"(?=\\item\s*\[\s*\\textbf\{\s*[0-9]+\s*\.?\s*\}\s*\])"


def problems(df: DataFrame, text: str = "text") -> DataFrame:
    """SRC8: the blocks that begin with an item header, with their numbers and places."""
    from qbank.functions.text import item_number

    keep = [c for c in df.columns if c != text]
    rows = df.select(*keep, F.posexplode(F.split(F.col(text), ITEM, -1)).alias("place", "block"))
    return rows.withColumn("number", item_number(F.col("block"))).where("number is not null").withColumn("block", stripped(F.col("block")))


def images_in_order(names: DataFrame, extensions: tuple[str, ...] = ("png", "jpg", "jpeg", "webp"), name: str = "path") -> DataFrame:
    """SRC9: image files by natural order."""
    pattern = rf"(?i)\.({'|'.join(extensions)})$"
    return names.where(F.rlike(name, F.lit(pattern))).orderBy(natural_key(F.col(name)))


def blocks_between(text: Column, start: str, end: str) -> Column:
    """SRC10, SRC11: the texts between start and end marks."""
    return F.transform(F.regexp_extract_all(text, F.lit(rf"(?s){start}(.*?){end}"), 1), stripped)


def block_field(block: Column, name: str, *aliases: str) -> Column:
    """SRC10, SRC11: a ``Name: value`` field, up to the next field or the block's end; null if it is missing or blank."""
    names = "|".join((name, *aliases))
    value = stripped(F.regexp_extract(block, rf"(?sim)^\s*(?:{names})\s*:\s*(.*?)(?=^\s*[\w ]+:|\z)", 1))
    return F.nullif(value, F.lit(""))


def numbers_in(c: Column) -> Column:
    """SRC11: the whole numbers in a text."""
    return F.transform(F.regexp_extract_all(c, F.lit("[0-9]+"), 0), lambda x: x.cast("int"))


def session_items(docs: DataFrame, items: str = "items") -> DataFrame:
    """SRC12: one row an item of a session document, with its place; sessions without items vanish."""
    keep = [c for c in docs.columns if c != items]
    return docs.select(*keep, F.posexplode(items).alias("place", "item")).select(*keep, "place", "item.*")


def predictions(df: DataFrame) -> DataFrame:
    """SRC13: (id, text) of records that say ``id`` or ``record_id``, ``prediction`` or ``text``."""
    first = lambda *names: F.coalesce(*(F.col(n) for n in names if n in df.columns))
    return df.select(first("id", "record_id").alias("id"), first("prediction", "text").alias("text")).where("id is not null")


def pages_of(selector: Column, last: Column) -> Column:
    """SRC14: ``1-3,7`` as sorted distinct pages; reversed ranges turn round; a page out of range is an error."""
    parts = F.filter(F.split(F.regexp_replace(selector, r"\s+", ""), ","), lambda x: x != "")
    ranges = F.transform(parts, lambda p: F.transform(F.split(p, "-", 2), lambda x: x.cast("int")))
    pages = F.flatten(F.transform(ranges, lambda r: F.sequence(F.array_min(r), F.array_max(r))))
    pages = F.array_sort(F.array_distinct(pages))
    outside = (F.array_min(pages) < 1) | (F.array_max(pages) > last)
    return F.when(outside, F.raise_error(F.lit("page out of range"))).otherwise(pages)


def recovered_json(reply: Column) -> Column:
    """SRC15: a model's reply as a variant: fenced or bare JSON, or the outermost braces; null if none parses."""
    fenced = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braces = F.regexp_extract(reply, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.try_parse_json(F.nullif(fenced, F.lit(""))), F.try_parse_json(reply), F.try_parse_json(F.nullif(braces, F.lit(""))))


def loose_field(reply: Column, name: str) -> Column:
    """SRC15: a string field of a reply that is no JSON."""
    return F.nullif(F.regexp_extract(reply, rf'"{name}"\s*:\s*"((?:[^"\\]++|\\.)*+)"', 1), F.lit(""))
