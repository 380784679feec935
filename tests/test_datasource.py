"""The Python data sources: parts, pushed filters, and errors that pass."""

import json
import sqlite3
import tracemalloc

import pytest
from pyspark.sql import functions as F

from qbank.plans import io
from qbank.queries import QUERIES
from qbank.sources import datasource


@pytest.fixture(scope="module")
def known(spark):
    datasource.register(spark)
    return spark


@pytest.fixture
def database(tmp_path):
    (tmp_path / "marks").mkdir()
    with sqlite3.connect(tmp_path / "db") as c:
        c.execute("create table problems (id integer primary key, name text, level real, done integer)")
        c.executemany("insert into problems values (?, ?, ?, ?)", [(i * 3, f"n{i % 7}", i / 2, None if i % 5 == 0 else i % 2) for i in range(2000)])
    c.close()
    return {"connect": "tests.flaky:connect", "file": str(tmp_path / "db"), "marks": str(tmp_path / "marks"), "table": "problems", "key": "id", "page": "150", "partitions": "4", "delay_s": "0"}


SCHEMA = "id long, name string, level double, done long"


def test_sql_loses_and_repeats_no_row(known, database):
    df = known.read.format("qbank_sql").schema(SCHEMA).options(**database).load()
    rows = df.collect()
    assert sorted(r.id for r in rows) == [3 * i for i in range(2000)]
    assert {(r.id, r.name, r.level, r.done) for r in rows} == {(3 * i, f"n{i % 7}", i / 2, None if i % 5 == 0 else i % 2) for i in range(2000)}
    assert df.rdd.getNumPartitions() == 4


def test_sql_filters_are_pushed(known, database):
    df = known.read.format("qbank_sql").schema(SCHEMA).options(**database).load()
    got = df.where((F.col("id") >= 300) & (F.col("name") == "n3") & (F.length("name") == 2)).collect()
    assert sorted(r.id for r in got) == [3 * i for i in range(100, 2000) if i % 7 == 3]
    said = open(database["marks"] + "/sql.log").read()
    assert "id >= ?" in said and "name = ?" in said


def test_sql_other_errors_are_raised(known, database):
    df = known.read.format("qbank_sql").schema("id long, nothing string").options(**database).load()
    with pytest.raises(Exception, match="nothing"):
        df.collect()
    lasting = known.read.format("qbank_sql").schema(SCHEMA).options(**database, said="permission denied").load()
    with pytest.raises(Exception, match="permission denied"):
        lasting.collect()
    empty = known.read.format("qbank_sql").schema(SCHEMA).options(**database).load().where("id < 0")
    assert empty.count() == 0


def test_files(known, tmp_path):
    (tmp_path / "marks").mkdir()
    top = tmp_path / "in" / "deep"
    top.mkdir(parents=True)
    for i in range(30):
        (top / f"r{i}.json").write_text(json.dumps({"id": i}))
    (top / "bad.json").write_text("{")
    (tmp_path / "in" / "all.jsonl").write_text('{"id": 1}\n\n  \r\n{"id": 2}\r\n{"id": 3}')
    (top / "a.tex").write_bytes("año".encode("cp1252"))
    (top / "b.tex").write_bytes("año 日".encode())
    (top / "c.tex").write_bytes(b"a\x81o")
    for name in ("img10.png", "img2.PNG", "note.txt"):
        (top / name).write_bytes(b"")
    read = lambda kind, **more: known.read.format("qbank_files").options(path=str(tmp_path / "in"), kind=kind, store="tests.flaky:store", marks=str(tmp_path / "marks"), delay_s=0, **more).load()
    records = read("json", partitions=5)
    assert records.rdd.getNumPartitions() == 5
    good = records.select(F.get_json_object("value", "$.id").cast("int").alias("id"), "name").collect()
    assert sorted(r.id for r in good if r.id is not None) == list(range(30)) and [r.name for r in good if r.id is None] == ["bad.json"]
    assert [r.name for r in records.where("name in ('r7.json', 'r8.json')").orderBy("name").collect()] == ["r7.json", "r8.json"]
    lines = read("jsonl", suffixes=".jsonl").orderBy("line").collect()
    assert [(r.line, json.loads(r.value)["id"]) for r in lines] == [(0, 1), (3, 2), (4, 3)]
    assert {r.name: r.value for r in read("text").collect()} == {"a.tex": "año", "b.tex": "año 日", "c.tex": "a\x81o"}
    assert {(r.name, r.value) for r in read("names").collect()} == {("img10.png", None), ("img2.PNG", None)}
    assert read("text", suffixes=".none").count() == 0
    assert len(list((tmp_path / "marks").iterdir())) == 2 * 35  # every file that was read stumbled twice


@pytest.mark.parametrize("raw", [b"", b"a", b"a\n\nb\r\n c", "ñ\nó\n".encode(), "ñ\n€".encode("cp1252"), b"\x81\n\xf1", "é".encode()[:1]])
def test_lines_piece_by_piece(raw):
    for n in (1, 2, 100):
        pieces = [raw[i : i + n] for i in range(0, len(raw), n)]
        name = datasource.encoding_of(pieces)
        assert [x.decode(name) for x in datasource.lines_of(pieces)] == datasource.decode(raw).split("\n")


def test_a_large_file_is_not_held(tmp_path):
    (tmp_path / "x.jsonl").write_text("".join(f"{i} " + "x" * 1000 + "\n" for i in range(40_000)))
    reader = datasource.FileReader({"path": str(tmp_path), "kind": "jsonl"})
    tracemalloc.start()
    rows = sum(b.num_rows for lot in reader.partitions() for b in reader.read(lot))
    assert rows == 40_000 and tracemalloc.get_traced_memory()[1] < 16_000_000
    tracemalloc.stop()


def test_files_are_written_and_read_by_all_cores(spark, monkeypatch, tmp_path):
    told = []

    class Told(io.WrittenText):
        def __init__(self, df, tag, by=None):
            told.append(df._jdf.queryExecution().analyzed().toString())
            super().__init__(df, tag, by)

    monkeypatch.setattr(io, "WrittenText", Told)
    for name in ("SRC4_record_files", "SRC5_jsonl"):
        QUERIES[name](spark, "/root/testdata/sf0.001")
    assert len(told) == 2 and all("RepartitionByExpression" in x for x in told)
    for i in range(20):
        (tmp_path / f"{i}.jsonl").write_text("x\n" * 50)
    monkeypatch.setattr(datasource, "MOST_BYTES", 200)
    assert len(datasource.FileReader({"path": str(tmp_path), "kind": "jsonl"}).partitions()) == 10
