"""SRC2, SRC4, SRC5, SRC7, SRC9 as Python data sources: planned partitions, pushed filters, retries inside a partition.

``register(spark)`` makes two formats known:

* ``qbank_files``: files below ``path`` (any store that Arrow's file systems know),
  dealt out by size; ``kind`` is ``json`` (a record a file), ``jsonl`` (a record a
  line, blank lines none), ``text`` (decoded as utf-8, else windows-1252, else
  latin-1) or ``names`` (no contents). Rows are ``path, name, line, value``.
  Filters on path and name are pushed to the listing.
* ``qbank_sql``: a table of any DB-API database, parted by ranges of a unique
  integer key and read in pages of that key, each page as a whole. ``connect`` names the
  function that opens a connection (``module:function``, it gets the options).

A read that meets an error that passes (``readers.passes``) is tried again: of a
file that file, of a database that page. What was handed on before stays, so no row
is lost or repeated. Files of lines are read piece by piece, a batch of lines at a time.
"""

from __future__ import annotations

import importlib
from codecs import getincrementaldecoder
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from heapq import heapify, heapreplace
from itertools import islice
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from qbank.sources.readers import retried

ROWS = "path string, name string, line int, value string"
#: Rows of an Arrow batch.
BATCH = 1000
#: Bytes of a file that are read at once, and of files that one task reads where there are more of them.
PIECE, MOST_BYTES = 1 << 20, 64 << 20
#: Suffixes of each kind; fixed values are those of images.
SUFFIXES = {"json": (".json",), "jsonl": (".jsonl", ".json"), "text": (".tex",), "names": (".png", ".jpg", ".jpeg", ".webp", ".bmp", ".tif", ".tiff")}


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Files)
    spark.dataSource.register(Sql)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def files(path: str, spark: SparkSession, **options: str) -> DataFrame:
    """``path, name, line, value`` of the files below a folder."""
    register(spark)
    options.setdefault("partitions", str(max(8, 2 * spark.sparkContext.defaultParallelism)))
    return spark.read.format("qbank_files").options(path=path, **options).load()


def _retrying(options: dict, read: Callable[[], Any]) -> Any:
    return retried(read, int(options.get("attempts", 3)), float(options.get("delay_s", 0.25)))


def _named(name: str) -> Callable[..., Any]:
    module, function = name.split(":")
    return getattr(importlib.import_module(module), function)


# -- files ----------------------------------------------------------------------------------------------


def decode(raw: bytes) -> str:
    """SRC7: utf-8, else windows-1252, else latin-1."""
    for name in ("utf-8", "cp1252"):
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            continue
    return raw.decode("latin-1")


def encoding_of(pieces: Iterable[bytes]) -> str:
    """The encoding that ``decode`` takes for a file, told from its pieces."""
    tried = {name: getincrementaldecoder(name)() for name in ("utf-8", "cp1252")}
    for piece, last in _with_end(pieces):
        for name in [*tried]:
            try:
                tried[name].decode(piece, last)
            except UnicodeDecodeError:
                del tried[name]
    return next(iter(tried), "latin-1")


def _with_end(pieces: Iterable[bytes]) -> Iterator[tuple[bytes, bool]]:
    for piece in pieces:
        yield piece, False
    yield b"", True


def lines_of(pieces: Iterable[bytes]) -> Iterator[bytes]:
    """The parts between line ends, the last one too; no byte of a line end is part of a character."""
    rest: list[bytes] = []
    for piece in pieces:
        first, *others = piece.split(b"\n")
        rest.append(first)
        for x in others:
            yield b"".join(rest)
            rest = [x]
    yield b"".join(rest)


@dataclass
class Lot(ds.InputPartition):
    """Files that one task reads."""

    paths: list[str] = field(default_factory=list)
    size: int = 0


class FileReader(ds.DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = dict(options)
        self.kind = options.get("kind", "json")
        if self.kind not in SUFFIXES:
            raise ValueError(f"kind {self.kind!r}: one of {', '.join(SUFFIXES)}")
        self.suffixes = tuple(options["suffixes"].split(",")) if "suffixes" in options else SUFFIXES[self.kind]
        self.tests: list[tuple[int, set]] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:  # noqa: N802
        """Equality and membership of path or name are settled by the listing; the others stay Spark's."""
        for f in filters:
            values = {f.value} if isinstance(f, ds.EqualTo) else set(f.value) if isinstance(f, ds.In) else None
            if values is None or f.attribute not in (("path",), ("name",)):
                yield f
            else:
                self.tests.append((0 if f.attribute == ("path",) else 1, values))

    def _store(self) -> tuple[pa.fs.FileSystem, str]:
        from pyarrow import fs

        if "store" in self.options:  # a function that opens another store
            return _named(self.options["store"])(self.options), self.options["path"]
        return fs.FileSystem.from_uri(self.options["path"]) if ":" in self.options["path"] else (fs.LocalFileSystem(), self.options["path"])

    def partitions(self) -> list[ds.InputPartition]:
        from pyarrow import fs

        store, path = self._store()
        found = _retrying(self.options, lambda: store.get_file_info(fs.FileSelector(path, recursive=True)))
        files = [
            f for f in found
            if f.is_file and f.base_name.lower().endswith(self.suffixes) and not f.base_name.startswith(("_", "."))
            and all((f.path, f.base_name)[k] in values for k, values in self.tests)
        ]
        wanted = max(int(self.options.get("partitions", 8)), sum(f.size for f in files) // MOST_BYTES)
        lots = [Lot() for _ in range(min(len(files), wanted))]
        least = [(0, k) for k in range(len(lots))]
        heapify(least)
        for f in sorted(files, key=lambda f: (-f.size, f.path)):  # the largest first, each to the lot with the least
            lot = lots[least[0][1]]
            lot.paths.append(f.path)
            lot.size += f.size + 1
            heapreplace(least, (lot.size, least[0][1]))
        return lots or [Lot()]

    def read(self, partition: ds.InputPartition) -> Iterator[pa.RecordBatch]:
        store, _ = self._store()
        rows: list[tuple] = []
        for path in partition.paths:
            for some in self._pieces(store, path):
                rows += some
                while len(rows) >= BATCH:
                    yield self._batch(rows[:BATCH])
                    rows = rows[BATCH:]
        if rows:
            yield self._batch(rows)

    def _pieces(self, store: pa.fs.FileSystem, path: str) -> Iterator[list[tuple]]:
        """A file's rows, a batch at a time; after an error that passes it is opened again, and what was handed on is skipped."""
        done, going = 0, None

        def more() -> list[tuple]:
            nonlocal going
            try:
                going = going or islice(self._rows(store, path), done, None)
                return list(islice(going, BATCH))
            except Exception:
                going = None
                raise

        while some := _retrying(self.options, more):
            done += len(some)
            yield some

    def _rows(self, store: pa.fs.FileSystem, path: str) -> Iterator[tuple]:
        name = path.rsplit("/", 1)[-1]
        if self.kind == "names":
            yield path, name, 0, None
            return
        if self.kind != "jsonl":
            with store.open_input_stream(path) as f:
                text = decode(f.read())
            yield path, name, 0, text
            return
        with store.open_input_stream(path) as f:
            encoding = encoding_of(iter(lambda: f.read(PIECE), b""))
        with store.open_input_stream(path) as f:
            for k, raw in enumerate(lines_of(iter(lambda: f.read(PIECE), b""))):
                line = raw.decode(encoding)
                if line.strip():
                    yield path, name, k, line.rstrip("\r")

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.int32(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "name", "line", "value"])


class Files(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "qbank_files"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema: StructType) -> ds.DataSourceReader:  # noqa: ARG002
        return FileReader(self.options)


# -- databases ------------------------------------------------------------------------------------------

_SIGNS = {ds.EqualTo: "=", ds.GreaterThan: ">", ds.GreaterThanOrEqual: ">=", ds.LessThan: "<", ds.LessThanOrEqual: "<="}


@dataclass
class KeyRange(ds.InputPartition):
    """Keys from ``low`` up to, but without, ``high``."""

    low: int
    high: int


class SqlReader(ds.DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.options, self.columns, self.arrow = dict(options), schema.names, to_arrow_schema(schema)
        self.key, self.table = options["key"], options["table"]
        self.mark = options.get("placeholder", "?")
        self.where: list[str] = []
        self.values: list[Any] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:  # noqa: N802
        """Comparisons of a column with a number or text become conditions; the others stay Spark's."""
        for f in filters:
            sign = _SIGNS.get(type(f))
            if sign and len(f.attribute) == 1 and f.attribute[0] in self.columns and isinstance(f.value, (int, float, str)) and not isinstance(f.value, bool):
                self.where.append(f"{f.attribute[0]} {sign} {self.mark}")
                self.values.append(f.value)
            elif isinstance(f, ds.IsNotNull) and f.attribute[0] in self.columns:
                self.where.append(f"{f.attribute[0]} is not null")
            else:
                yield f

    def _rows(self, sql: str, values: list) -> list[tuple]:
        """All rows of a query, over a connection of its own, again after an error that passes."""

        def once() -> list[tuple]:
            connection = _named(self.options["connect"])(self.options)
            try:
                cursor = connection.cursor()
                cursor.execute(sql, values)
                return cursor.fetchall()
            finally:
                connection.close()

        return _retrying(self.options, once)

    def _conditions(self, *more: str) -> str:
        found = [*self.where, *more]
        return " where " + " and ".join(found) if found else ""

    def partitions(self) -> list[ds.InputPartition]:
        low, high = self._rows(f"select min({self.key}), max({self.key}) from {self.table}{self._conditions()}", self.values)[0]
        if low is None:
            return [KeyRange(0, 0)]
        n = max(1, min(int(self.options.get("partitions", 8)), high - low + 1))
        cuts = [low + (high + 1 - low) * k // n for k in range(n + 1)]
        return [KeyRange(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]

    def read(self, partition: ds.InputPartition) -> Iterator[pa.RecordBatch]:
        page, low = int(self.options.get("page", 5000)), partition.low
        wanted = ", ".join([*self.columns, self.key])
        where = self._conditions(f"{self.key} >= {self.mark}", f"{self.key} < {self.mark}")
        while low < partition.high:
            rows = self._rows(f"select {wanted} from {self.table}{where} order by {self.key} limit {page}", [*self.values, low, partition.high])
            if rows:
                columns = list(zip(*rows, strict=True))[:-1]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.arrow, strict=True)], schema=self.arrow)
            if len(rows) < page:
                return
            low = rows[-1][-1] + 1


class Sql(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "qbank_sql"

    def schema(self) -> str:
        raise ValueError("give the columns that are read: .schema(...)")

    def reader(self, schema: StructType) -> ds.DataSourceReader:
        return SqlReader(schema, self.options)
