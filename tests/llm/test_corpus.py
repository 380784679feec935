"""Passage dedup, whitening and importance resampling against brute force."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import oracle, rows_of, rows_of_sql
from qbank.llm import importance, queries, suffix_dedup, whitening

DOCS = "doc_id long, text string, spans string, kept map<string,string>, n_chars long, n_bytes string"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(["alfa", "beta", "gámma", "delta", "uno", "dos"]) + str(r.randint(0, 400)) for _ in range(n))


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "clash", {"a": "b"}, None if t is None else len(t), "clash") for i, t in texts], DOCS)


# -- 11 --------------------------------------------------------------------------


def brute_removed(texts, length):
    """For each text: which bytes a string covers that starts twice."""
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        out.append((b, gone))
    return out


def held(texts, length):
    rows = []
    for b, gone in brute_removed(texts, length):
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        n_spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        rows.append((len(b), sum(gone), n_spans, hashlib.sha256(kept).hexdigest()))
    return rows


@pytest.fixture(scope="module")
def passages():
    shared = prose(1, 90)
    texts = [None, "", "short", "a" * 399, "a" * 400, "b" * 900, prose(2, 700), prose(2, 700), prose(2, 700) + "x", "ab" * 700]
    texts += [prose(10 + i, 30 + i) + shared + prose(50 + i, 20) for i in range(40)]
    texts += [prose(3, 50) + " " + shared[:500] + prose(4, 9) + shared[200:], "éé" * 500, "中" * 300 + prose(5, 40), prose(6, 30) * 3]
    return texts


@pytest.mark.parametrize("crowd", [4096, 3])
def test_passages(spark, passages, crowd):
    """With ``crowd`` 3 nearly every anchor is parted by windows, and those start by start."""
    p = suffix_dedup.Repeats(crowd=crowd, batch=50, share=4, stretch=700)
    docs = documents(spark, list(enumerate(passages))).repartition(3)
    got = {r[0].doc_id: (r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffix_dedup.dedup(docs, p).collect()}
    want = held(passages, 400)
    assert [got[i] for i in range(len(passages))] == want
    assert sum(w[1] > 0 for w in want) > 40 and any(w[2] > 1 for w in want)


def test_passages_random_small_alphabet():
    r = random.Random(5)
    strings = ["".join(r.choice("ab") for _ in range(r.randint(40, 90))).encode() for _ in range(60)]
    offsets = np.array([r.randint(0, 10) for _ in strings])
    copies = np.array([1 if i % 9 else 2 for i in range(60)])
    length = 12
    width = min(len(s) - o for s, o in zip(strings, offsets, strict=True))
    cut = [s[: o + min(width, length)] for s, o in zip(strings, offsets, strict=True)]
    cut = [s if len(s) >= length else s + b"c" * length for s in cut]
    seen = collections.Counter()
    for s, o, c in zip(cut, offsets, copies, strict=True):
        for i in range(len(s) - length + 1):
            seen[s[i : i + length], i - o] += int(c)
    want = {k: [seen[s[i : i + length], i - o] > 1 for i in range(len(s) - length + 1)] for k, (s, o) in enumerate(zip(cut, offsets, strict=True))}
    got = dict(suffix_dedup.columns(cut, offsets, copies, length))
    assert {k: list(map(bool, v)) for k, v in got.items()} == {k: v for k, v in want.items() if any(v)}


def test_passages_odd_tables(spark, passages):
    assert suffix_dedup.dedup(documents(spark, [])).count() == 0
    docs = documents(spark, [(None, passages[6]), (7, passages[6]), (7, passages[6]), (8, passages[9]), (None, None)])
    cleaned = suffix_dedup.clean(docs)
    assert cleaned.columns == docs.columns
    texts = sorted(((r.doc_id, r.text) for r in cleaned.collect()), key=str)
    assert texts == sorted([(None, ""), (7, ""), (7, ""), (8, ""), (None, None)], key=str)
    once = suffix_dedup.clean(documents(spark, [(1, passages[6] + "é"), (2, "only")])).collect()
    assert {r.text for r in once} == {passages[6] + "é", "only"}


# -- 12 --------------------------------------------------------------------------


def test_jacobi_small_eigenvalues():
    r = np.random.default_rng(3)
    for d in (1, 2, 3, 7, 64):
        q = np.linalg.qr(r.standard_normal((d, d)))[0]
        e = 10.0 ** -np.linspace(0, 9, d)
        values, vectors = whitening.jacobi(q * e @ q.T)
        assert np.allclose(values, np.sort(e)[::-1], rtol=1e-6)
        assert np.allclose(vectors.T @ vectors, np.eye(d), atol=1e-12)
    graded = np.diag(10.0 ** -np.arange(6)) @ (np.eye(6) + 0.1) @ np.diag(10.0 ** -np.arange(6))
    values, _ = whitening.jacobi(graded)
    assert np.isclose(values.prod(), np.prod(10.0 ** (-2 * np.arange(6))) * np.linalg.det(np.eye(6) + 0.1), rtol=1e-12)
    assert sorted((i, j) for a, b in whitening.pairings(5) for i, j in zip(a.tolist(), b.tolist(), strict=True)) == [(i, j) for i in range(5) for j in range(i + 1, 5)]


def test_whitening(spark):
    r = np.random.default_rng(0)
    base = r.standard_normal((60, 6)) * [3, 2, 1, 0.5, 0.2, 0.1]
    rows = [(i, base[i % 50].tolist(), "x") for i in range(120)] + [(200, None, "x"), (201, [1.0, None] + [0.0] * 4, "x"), (202, [float("nan")] * 6, "x")]
    rows += [(203, [float("inf")] + [0.0] * 5, "x"), (204, [], "x"), (205, [1.5, 2.5], "x"), (206, [1.5, 2.5], "x"), (207, [1e300] * 6, "x"), (None, base[55].tolist(), "x")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n string").repartition(3)
    got = whitening.whiten(vectors).collect()
    x = np.floor(256 * np.vstack([base[:50], base[55:56]])).astype(np.int64)
    n, s = len(x), x.sum(0)
    c = (x - s / n).T @ (x - s / n) / n
    e, v = np.linalg.eigh(c)
    e, v = e[::-1], v[:, ::-1]
    seen = {(g.vec_id, g.component): g for g in got}
    assert {k for k, _ in seen} == {*range(120), 205, 206, None} and len(got) == 121 * 4 + 4
    turn = None
    for (i, k), g in seen.items():
        if i in (205, 206):
            assert (g.n, g.deviation, g.whitened, g.explained, g.identity_error) == (1, 0, None, 0.0, 0.0)
            continue
        mine = np.floor(256 * base[55 if i is None else i % 50]).astype(np.int64)
        assert g.n == n and g.deviation == int(((n * mine - s) ** 2).sum())
        assert abs(g.explained - e[k - 1] / e.sum()) < 1e-9 and g.identity_error < 1e-9
        assert abs(abs(g.whitened) - abs((mine - s / n) @ v[:, k - 1] / math.sqrt(e[k - 1]))) < 1e-6
    turn = [np.sign(seen[7, k].whitened * ((np.floor(256 * base[7]) - s / n) @ v[:, k - 1])) for k in range(1, 5)]
    for i in range(50):
        for k in range(1, 5):
            assert abs(seen[i, k].whitened - turn[k - 1] * ((np.floor(256 * base[i]) - s / n) @ v[:, k - 1]) / math.sqrt(e[k - 1])) < 1e-6
    assert whitening.whiten(vectors.limit(0)).count() == 0


def test_whitening_exact_beyond_64_bits():
    fit = whitening.Fit(10**9, [0], np.ones(1), np.eye(1), 1.0)
    assert whitening._deviations(np.array([[2], [10]]), fit) == [4 * 10**18, None]


# -- 13 --------------------------------------------------------------------------


def grams(text, longest):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = "".join(c if c.isascii() and (c.isdigit() or c.islower()) or ord(c) >= 128 else " " for c in folded).split(" ")
    words = [w for w in words if w]
    return len(words), [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute_draw(docs, target, p):
    bucket = lambda g: zlib.crc32(g.encode()) % p.buckets
    s = collections.Counter(bucket(g) for _, t in docs for g in grams(t, p.longest)[1])
    t = collections.Counter(bucket(g) for x in target for g in grams(x, p.longest)[1])
    ss, tt = sum(s.values()) + p.buckets, sum(t.values()) + p.buckets
    gain = [math.floor(1000 * math.log((t[b] + 1) * ss / ((s[b] + 1) * tt))) for b in range(p.buckets)]
    rows = []
    for i, text in docs:
        n, features = grams(text, p.longest)
        weight = sum(gain[bucket(g)] for g in features)
        h = int(hashlib.sha256(f"{p.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    fit = sorted((r for r in rows if r[4] >= p.min_words), key=lambda r: (-r[3], r[0] is None, r[0]))
    rank = {}
    for k, r in enumerate(fit[: len(fit) * p.percent // 100]):
        rank.setdefault(r[0], []).append(k + 1)
    return sorted(((*r[:4], (rank.get(r[0]) or [None]).pop(0) if rank.get(r[0]) and r[4] >= p.min_words else None) for r in rows), key=str)


@pytest.mark.parametrize("longest", [1, 2, 3, 5])
def test_importance(spark, longest):
    texts = [(i, prose(i % 30, 5 + i % 60)) for i in range(120)] + [(500, None), (501, ""), (502, "Ünïcode 中文 x'y\x1cz w " * 8), (503, "ONE Two two"), (None, prose(9, 40))]
    texts += [(7, prose(7, 12)), (504, "la " * 3000)]
    target = [prose(3, 50), None, "", "two two"]
    p = importance.Target(longest=longest, percent=30, block=2000)
    docs = documents(spark, texts).repartition(5)
    got = importance.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), p)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_draw(texts, target, p)


def test_importance_odd_tables(spark):
    docs, none = documents(spark, [(1, "a b")]), documents(spark, [])
    assert importance.resample(none, docs).count() == 0
    assert [tuple(r)[:2] for r in importance.resample(docs, none).collect()] == [(1, 2)]
    ranks = importance.resample(documents(spark, [(1, prose(1, 30))] * 50), docs).where(F.col("rank").isNotNull()).collect()
    assert sorted(r["rank"] for r in ranks) == [1, 2, 3, 4, 5]


def test_suffix_array_orders_places():
    r = random.Random(1)
    ids, ends = [], []
    for _ in range(30):
        n = r.randint(1, 40)
        ends += [len(ids) + n] * n
        ids += [r.randint(0, 3) for _ in range(n)]
    ids, ends = np.array(ids, np.int32), np.array(ends)
    for depth in (1, 2, 3, 4, 7):
        order, common = importance.suffix_array(ids, ends, depth)
        suffix = [tuple(ids[i : min(i + depth, ends[i])]) for i in order]
        assert suffix == sorted(suffix)
        for k in range(1, len(suffix)):
            same = 0
            while same < min(len(suffix[k]), len(suffix[k - 1])) and suffix[k][same] == suffix[k - 1][same]:
                same += 1
            assert common[k] == same


@pytest.mark.parametrize("name", ["op11_suffix_dedup", "op13_importance"])
def test_oracle_larger(spark, name):
    sf = "/root/testdata/sf0.01"
    assert rows_of(queries.QUERIES[name](spark, sf)) == rows_of_sql(oracle(sf), queries.ORACLE[name])
