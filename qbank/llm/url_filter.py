"""URL filter by Bloom filter cascades: exact membership without joins.

A cascade alternates Bloom filters: level 1 encodes the listed keys, level 2
those keys of the corpus's complete key universe that level 1 wrongly passes,
level 3 the listed keys that level 2 wrongly passes, and so on until nothing is
wrong.  For every key of the universe the first level that rejects it then
tells the exact answer.  Only the filters' bits reach the driver and are
broadcast; their size follows the number of listed keys (about
1.44 * log2(universe / listed) bits each) and is checked.

A url's keys are its host and its parent domains, alone and followed by the
path prefixes whose lengths occur among the rules.  Only domains of as many
labels, and keys of as many characters, as some listed key has are spelt out:
nothing longer can be listed, and the work is linear in a url's length.

Defined results: a null url, or one without ``://``, has an empty host and
path, no keys, no rule, and is allowed; repeated urls are judged alike; an
empty list gives a cascade that holds nothing; other columns pass through,
except those named like the results, which are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qbank.llm.common import Table, table

#: The filters of one cascade may hold so many bytes at most (they are broadcast).
MOST_BYTES = 256 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MASK = (1 << 64) - 1


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` up to /, ?, # (A-Z lower-cased); path up to ? or #."""
    cut = F.instr(url, "://")
    rest = F.when(cut > 0, F.substring(url, cut + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def suffixes(host: Column, most: int) -> Column:
    """The host's last 1 to ``most`` labels, fewest first; of an empty host none.

    No listed key has more labels, so no more of a host is ever spelt out.
    """
    made = F.array(*(F.substring_index(host, ".", -k) for k in range(1, most + 1)))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(made))


def keys_of(host: Column, path: Column, lengths: Iterable[int], most: int) -> Column:
    """All keys of a url that may be listed: domains alone, and with each path prefix of the given lengths."""
    wanted = F.array(*(F.lit(n) for n in sorted({0, *lengths})))
    heads = F.transform(
        F.filter(wanted, lambda n: n <= F.length(path)), lambda n: F.substring(path, F.lit(1), n)
    )
    return F.flatten(F.transform(suffixes(host, most), lambda s: F.transform(heads, lambda h: F.concat(s, h))))


def hashes(keys: Iterable[str]) -> np.ndarray:
    """Two 64-bit hashes a key, the second odd; shape (n, 2)."""
    digest = xxhash.xxh3_128_intdigest
    raw = [(d & MASK, (d >> 64) | 1) for d in map(digest, keys)]
    return np.array(raw, dtype=np.uint64).reshape(-1, 2)


@dataclass
class Bloom:
    bits: int
    probes: int
    level: int
    words: np.ndarray  # uint64

    def places(self, hashed: np.ndarray) -> np.ndarray:
        # Each level hashes anew: a key that one level passes is an independent trial at the next.
        step = hashed[:, 1] * np.uint64(2 * self.level + 1)
        first = hashed[:, 0] ^ (hashed[:, 1] * np.uint64(self.level))
        i = np.arange(self.probes, dtype=np.uint64)
        spread = first[:, None] + i * step[:, None]
        spread ^= spread >> np.uint64(29)
        return spread % np.uint64(self.bits)

    def passes(self, hashed: np.ndarray) -> np.ndarray:
        at = self.places(hashed)
        return ((self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=1)


@dataclass
class Cascade:
    levels: list[Bloom] = field(default_factory=list)

    def contains(self, hashed: np.ndarray) -> np.ndarray:
        """Exact for keys of the universe that the cascade was built over."""
        inside = np.zeros(len(hashed), dtype=bool)
        going = np.arange(len(hashed))
        for k, level in enumerate(self.levels):
            passed = level.passes(hashed[going])
            # rejected by an odd level: not listed; by an even level: listed
            inside[going[~passed]] = k % 2 == 1
            going = going[passed]
        inside[going] = len(self.levels) % 2 == 1
        return inside

    def bytes(self) -> int:
        return sum(x.words.nbytes for x in self.levels)


def _encode(keys: DataFrame, n: int, rate: float, level: int) -> Bloom:
    """A Bloom filter of ``keys``: partial bitmaps by task, OR-ed by aggregation."""
    probes = max(1, round(math.log2(1 / rate)))
    bits = max(64, math.ceil(n * probes / math.log(2)))
    if bits > 8 * MOST_BYTES:
        raise ValueError(f"a level of {bits >> 23} MB is beyond MOST_BYTES; list fewer keys")
    shape = Bloom(bits, probes, level, np.zeros(0, np.uint64))

    def partial(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(bits // 64 + 1, np.uint64)
        for b in got:
            at = shape.places(hashes(b.column(0).to_pylist())).ravel()
            np.bitwise_or.at(words, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
        where = np.flatnonzero(words)
        yield pa.RecordBatch.from_pydict({"at": where.astype(np.int64), "bits": words[where].view(np.int64)})

    rows = keys.mapInArrow(partial, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits"))
    words = np.zeros(bits // 64 + 1, np.uint64)
    got = rows.toArrow()  # one row a 64-bit word of the filter, at most
    words[got["at"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return Bloom(bits, probes, level, words)


def _passing(keys: DataFrame, level: Bloom) -> DataFrame:
    def keep(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in got:
            if b.num_rows:
                yield b.filter(pa.array(level.passes(hashes(b.column(0).to_pylist()))))

    return keys.mapInArrow(keep, "key string")


def build_cascade(listed: DataFrame, universe: DataFrame, most_levels: int = 64) -> Cascade:
    """The cascade of ``listed(key)`` over ``universe(key)``; both distinct, without nulls.

    The first level's rate makes its wrong passes about as many as the listed
    keys; the later levels halve. Each level's set is a table in the shared
    folder, and only its filter's bits come to the driver.
    """
    listed, n = Table(listed, "listed").df, 0
    n, total = listed.count(), universe.count()
    if not n:
        return Cascade()
    out, inside, outside = Cascade(), listed, None
    rate = min(0.5, n / (math.sqrt(2) * max(total, 1)))
    out.levels.append(_encode(listed, n, rate, 0))
    outside = table(_passing(universe, out.levels[0]).join(listed, "key", "left_anti"), "wrong")
    while (n := outside.count()) and len(out.levels) < most_levels:
        out.levels.append(_encode(outside, n, 0.5, len(out.levels)))
        inside, outside = outside, table(_passing(inside, out.levels[-1]), "wrong")
    if n:
        raise RuntimeError("the cascade did not end")
    if out.bytes() > MOST_BYTES:
        raise ValueError("the cascade is beyond MOST_BYTES")
    return out


Keys = tuple[str, ...] | DataFrame


@dataclass(frozen=True)
class Policy:
    """Rules ``host/path`` with their actions, and blocked domains for urls that no rule fits.

    Each list is a tuple, or a table with a column ``key``; tables never come to the driver.
    """

    block_rules: Keys = ()
    allow_rules: Keys = ()
    block_hosts: Keys = ()


def _listed(spark: SparkSession, keys: Keys) -> DataFrame:
    if isinstance(keys, DataFrame):
        return keys.select(F.col("key").cast("string").alias("key")).where("key is not null").distinct()
    return spark.createDataFrame([(k,) for k in dict.fromkeys(keys)], "key string")


def judge(pages: DataFrame, policy: Policy, url: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    Three cascades (allow rules, block rules, blocked hosts) are built over all
    keys that occur in ``pages``; then every url is judged where it is read: of
    its keys that are rules the longest wins, else a blocked domain blocks.
    """
    spark = pages.sparkSession
    allows, blocks, blocked_hosts = (_listed(spark, x) for x in (policy.allow_rules, policy.block_rules, policy.block_hosts))
    rules = allows.unionByName(blocks)
    if not rules.groupBy("key").count().where("count > 1").isEmpty():
        raise ValueError("a rule both allows and blocks")
    host, path = host_and_path(F.col(url))
    # As many lengths as rules' paths have, none beyond the longest path.
    lengths = sorted(r[0] for r in rules.where("instr(key, '/') > 0").select(F.length("key") - F.instr("key", "/") + 1).distinct().collect())
    # As many labels as the longest listed host has, as many characters as the longest key.
    every = rules.unionByName(blocked_hosts)
    labels = F.size(F.split(F.substring_index("key", "/", 1), r"\.", -1))
    most, longest = every.agg(F.coalesce(F.max(labels), F.lit(1)), F.coalesce(F.max(F.length("key")), F.lit(0))).first()
    parts = pages.select(host.alias("host"), path.alias("path"))
    keys = parts.select(F.explode(keys_of(F.col("host"), F.col("path"), lengths, most)).alias("key")).where(F.length("key") <= longest)
    universe = Table(keys.distinct(), "keys")
    allow, block, hosts = (build_cascade(x, universe.df) for x in (allows, blocks, blocked_hosts))
    universe.drop()

    @F.pandas_udf("rule string, verdict string")
    def decide(hosts_in, paths_in):  # noqa: ANN001, ANN202
        import pandas as pd

        keys, owner = [], []
        for i, (h, p) in enumerate(zip(hosts_in, paths_in, strict=True)):
            at, left = len(h), most if h else 0
            while left and at >= 0:
                at, left = h.rfind(".", 0, at), left - 1
                if len(h) - at - 1 > longest:
                    break
                name = h[at + 1 :]
                keys += [name, *(name + p[:n] for n in lengths if n <= min(len(p), longest - len(name)))]
            owner += [i] * (len(keys) - len(owner))
        rules, verdicts = [None] * len(hosts_in), ["allow"] * len(hosts_in)
        if keys:
            hashed = hashes(keys)
            permits, blocks, blocked = allow.contains(hashed), block.contains(hashed), hosts.contains(hashed)
            for i in np.flatnonzero(permits | blocks | blocked):
                at, key = owner[i], keys[i]
                if permits[i] or blocks[i]:
                    if rules[at] is None or len(key) > len(rules[at]):
                        rules[at], verdicts[at] = key, "allow" if permits[i] else "block"
                elif rules[at] is None:
                    verdicts[at] = "block"
        return pd.DataFrame({"rule": rules, "verdict": verdicts})

    mine = ("host", "path", "rule", "verdict")
    out = pages.select(F.struct(*pages.columns).alias("_row"), host.alias("host"), path.alias("path"))
    out = out.withColumn("_said", decide("host", "path"))
    return out.select(
        *(F.col("_row")[c].alias(c) for c in pages.columns if c not in mine),
        "host", "path", F.col("_said.rule").alias("rule"), F.col("_said.verdict").alias("verdict"),
    )
