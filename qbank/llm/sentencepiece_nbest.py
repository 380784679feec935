"""SentencePiece encoding and decoding with exact N-best segmentations.

A text's piece lattice has an edge for every vocabulary piece that matches, and
byte edges for characters without a piece; a segmentation's score is the sum of
its pieces' scores.  A forward Viterbi pass gives the best score up to every
place; backward A* search then takes those scores as its exact heuristic, so it
pops segmentations best first and never expands one that is not needed.

The lattice falls apart at places that no piece of the vocabulary can cross (a
character pair that occurs in no piece, such as before a word's mark), so words
are solved alone and kept in a bounded cache.  The new words of a lot of texts
go through the forward pass together, an edge length at a place after the other;
long words go alone.  The forward pass also keeps each place's second-best
score: the gap of a word.  The N best segmentations of a
text differ from its best one in the N-1 words of least gap at most, and only
those words are searched.

Defined results: null and empty texts have no pieces, a score of 0 and no
alternatives; ties go to the segmentation whose last differing piece is longer;
text is read whole, whatever its length; repeated rows come out alike; other
columns are not read.  Decoding undoes encoding exactly.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qbank.llm.common import text_batches
from qbank.llm.tokens import vocabulary

MARK = "▁"
CACHE = 800_000
#: Words whose n best segmentations are kept.
FEW = 20_000
#: Characters of texts whose new words are looked for together; characters of words that are solved together.
LOT = 500_000
TOGETHER = 200_000
#: Longer words are solved alone.
LONG = 64
#: A byte's score lies so far below the least single piece's.
BYTE_GAP = 10.0
#: Scores below this mark pieces that merging never makes; they do not count for the byte score.
UNUSED = -1e8
WORDS = re.compile(" +[^ ]*")


class Numbers:
    """Places of whole numbers in a list without repetition, -1 for others: open addressing, many at once."""

    def __init__(self, keys: np.ndarray) -> None:
        bits = max(4, 2 + len(keys).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, np.int32)
        self.keys = np.append(keys, -1)  # the last is that of place -1
        left, at = np.arange(len(keys), dtype=np.int32), self._slot(keys)
        while left.size:
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            later = self.slots[at] != left
            left, at = left[later], (at[later] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        got = self.slots[at]
        other = np.flatnonzero((got >= 0) & (self.keys[got] != keys))
        while other.size:
            at[other] = (at[other] + 1) & self.mask
            got[other] = now = self.slots[at[other]]
            other = other[(now >= 0) & (self.keys[now] != keys[other])]
        return got


class Model:
    """A vocabulary of pieces with scores; ``pieces`` are text with spaces instead of marks."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=vocabulary(path))
        self.pieces: dict[str, tuple[int, float]] = {}
        self.bytes: list[int] = [-1] * 256
        self.raw: list[bytes] = [b""] * m.get_piece_size()
        for i in range(m.get_piece_size()):
            piece = m.id_to_piece(i)
            if m.is_byte(i):
                self.bytes[int(piece[1:-1], 16)] = i
                self.raw[i] = bytes([int(piece[1:-1], 16)])
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
                piece = piece.replace(MARK, " ")
                self.pieces[piece] = i, m.get_score(i)
                self.raw[i] = piece.encode()
        self.finish()

    def finish(self) -> None:
        self.longest = max(map(len, self.pieces), default=1)
        self.byte_score = min((s for p, (_, s) in self.pieces.items() if len(p) == 1 and s > UNUSED), default=0.0) - BYTE_GAP
        #: Every prefix of a piece; those that are pieces have their ids and score.
        self.prefixes: dict[str, tuple] = {p[:i]: (None, 0.0) for p in self.pieces for i in range(1, len(p))}
        self.prefixes |= {p: ((i,), s) for p, (i, s) in self.pieces.items()}
        self.pairs = {p[i : i + 2] for p in self.pieces for i in range(len(p) - 1)}
        self.words_apart = not any(a != " " and b == " " for a, b in self.pairs)
        self.scores = np.full(len(self.raw), self.byte_score)
        for i, s in self.pieces.values():
            self.scores[i] = s
        self.cache: dict[str, tuple[bytes, float]] = {}
        self.old: dict[str, tuple[bytes, float]] = {}
        self.searched: dict[tuple[str, int], list[tuple[bytes, float]]] = {}
        self._number()

    def _number(self) -> None:
        """Characters of pieces by kind (from 1; 0: all others), prefixes by node (0: the root), and what leads to each."""
        kinds = {c: k for k, c in enumerate(sorted({p[-1] for p in self.prefixes}), 1)}
        self.kind = np.zeros(0x110000, np.int64)
        self.kind[list(map(ord, kinds))] = list(kinds.values())
        self.width = len(kinds) + 1
        nodes = {"": 0} | {p: k for k, p in enumerate(self.prefixes, 1)}
        self.steps = Numbers(np.array([nodes[p[:-1]] * self.width + kinds[p[-1]] for p in self.prefixes], np.int64))
        self.crossed = Numbers(np.array([kinds[a] * self.width + kinds[b] for a, b in self.pairs], np.int64))
        self.node_id = np.array([-1, *(-1 if ids is None else ids[0] for ids, _ in self.prefixes.values())], np.int64)
        self.node_score = np.array([0.0, *(s for _, s in self.prefixes.values())])

    # -- one chunk -------------------------------------------------------------

    def edges_to(self, s: str, end: int) -> list[tuple[int, tuple[int, ...], float]]:
        """Edges that end at a place: (start, ids, score), longest first."""
        out = []
        for start in range(max(0, end - self.longest), end):
            got = self.pieces.get(s[start:end])
            if got is not None:
                out.append((start, (got[0],), got[1]))
        if s[end - 1] not in self.pieces:
            out.append((end - 1, *self.byte_edge(s[end - 1])))
        return out

    def forward(self, s: str) -> tuple[list[float], list[float], list[tuple[int, tuple[int, ...]]]]:
        """Best and second-best scores up to each place, and the best's last edge.

        From each place pieces are followed as far as the vocabulary has a
        prefix; an earlier start comes first, so of equal scores the longer last
        piece stays.
        """
        n = len(s)
        first, second = [-np.inf] * (n + 1), [-np.inf] * (n + 1)
        back: list[tuple[int, tuple[int, ...]]] = [(0, ())] * (n + 1)
        first[0] = 0.0
        get = self.prefixes.get
        for start in range(n):
            best, next_best = first[start], second[start]
            for end in range(start + 1, n + 1):
                got = get(s[start:end])
                if got is None or got[0] is None:
                    if end == start + 1:
                        done = got is None
                        ids, gain = self.byte_edge(s[start])
                    elif got is None:
                        break
                    else:
                        continue
                else:
                    done = False
                    ids, gain = got
                score = best + gain
                now = first[end]
                if score > now:
                    first[end], back[end] = score, (start, ids)
                    if now > second[end]:
                        second[end] = now
                elif score > second[end]:
                    second[end] = score
                if next_best + gain > second[end]:
                    second[end] = next_best + gain
                if done:
                    break
        return first, second, back

    def byte_edge(self, c: str) -> tuple[tuple[int, ...], float]:
        raw = c.encode("utf-8", "surrogatepass")
        return tuple(self.bytes[b] for b in raw), self.byte_score * len(raw)

    def n_best(self, s: str, n: int) -> list[tuple[list[int], float]]:
        """The n best segmentations of ``s``, best first: A* from the end, with exact heuristics."""
        first, _, _ = self.forward(s)
        tie = count()
        # (negative of heuristic + gone, place, order, gone, ids from here on): of equals, the one nearest to its end
        heap = [(-first[len(s)], len(s), next(tie), 0.0, ())]
        out: list[tuple[list[int], float]] = []
        while heap and len(out) < n:
            _, end, _, gone, ids = heapq.heappop(heap)
            if not end:
                flat: list[int] = []
                while ids:
                    flat += ids[0]
                    ids = ids[1]
                out.append((flat, gone))
                continue
            for start, own, score in self.edges_to(s, end):
                total = first[start] + gone + score
                if total > -np.inf:
                    heapq.heappush(heap, (-total, start, next(tie), gone + score, (own, ids)))
        return out

    def _chunk(self, s: str) -> tuple[bytes, float]:
        """Best ids of a chunk and the gap to its second-best segmentation."""
        first, second, back = self.forward(s)
        own: list[tuple[int, ...]] = []
        at = len(s)
        while at:
            at, edge = back[at]
            own.append(edge)
        return array("I", [i for edge in reversed(own) for i in edge]).tobytes(), first[-1] - second[-1]

    def _word(self, word: str) -> tuple[bytes, float]:
        """The same of a word, from its chunks."""
        pairs = self.pairs
        cuts = [0, *(i for i in range(1, len(word)) if word[i - 1 : i + 1] not in pairs), len(word)]
        done = [self._chunk(word[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]
        return b"".join([x[0] for x in done]), min(x[1] for x in done)

    # -- many words --------------------------------------------------------------

    def _edges(self, kinds: np.ndarray, room: np.ndarray, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All edges of the lattices: start, length, id (-1: bytes) and score; ``room`` is what a chunk has from a place on."""
        at, node = np.arange(len(kinds)), np.zeros(len(kinds), np.int64)
        starts, lengths, ids, gains = [], [], [], []
        for length in range(1, self.longest + 1):
            node = self.steps.find(node * self.width + kinds[at + (length - 1)]).astype(np.int64) + 1
            own = self.node_id[node]
            ends = own >= 0
            if length == 1:
                gain = np.where(ends, self.node_score[node], self.byte_score * widths)
                ends[:] = True
            else:
                gain = self.node_score[node]
            starts.append(at[ends])
            lengths.append(np.full(len(starts[-1]), length))
            ids.append(own[ends])
            gains.append(gain[ends])
            on = (node > 0) & (room[at] > length)
            at, node = at[on], node[on]
            if not at.size:
                break
        return tuple(map(np.concatenate, (starts, lengths, ids, gains)))  # type: ignore[return-value]

    def _together(self, words: list[str]) -> list[tuple[bytes, float]]:
        """``_word`` of each word, by one forward pass over all their chunks.

        Edges are taken by the place of their end in its chunk, then longest
        first: as in ``forward``, where an earlier start comes first.
        """
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        kinds = self.kind[code]
        widths = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        tails = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        cut = np.ones(len(code), bool)
        cut[1:] = self.crossed.find(kinds[:-1] * self.width + kinds[1:]) < 0
        cut[tails[:-1]] = True
        begins = np.flatnonzero(cut)
        sizes = np.diff(begins, append=len(code))
        chunk = np.cumsum(cut) - 1
        place = np.arange(len(code)) - begins[chunk]
        start, length, ids, gains = self._edges(kinds, sizes[chunk] - place, widths)
        turn = (place[start] + length) * (LONG + 1) + LONG - length
        order = np.argsort(turn.astype(np.uint16), kind="stable")
        bounds = np.append(0, np.cumsum(np.bincount(turn)))
        bounds = bounds[np.append(True, bounds[1:] > bounds[:-1])].tolist()
        start, length, ids, gains = start[order], length[order], ids[order], gains[order]
        chars = start
        start = start + chunk[start]  # a chunk has a place more than characters
        end = start + length
        heads = begins + np.arange(len(begins))
        last = heads + sizes
        first, second = np.full(len(code) + len(begins), -np.inf), np.full(len(code) + len(begins), -np.inf)
        back = np.full(len(first), -1)
        first[heads] = 0.0
        for i, j in zip(bounds, bounds[1:], strict=False):
            s, e, gain = start[i:j], end[i:j], gains[i:j]
            score, now = first[s] + gain, first[e]
            second[e] = np.maximum(np.maximum(second[e], np.minimum(now, score)), second[s] + gain)
            better = np.flatnonzero(score > now)
            first[e[better]] = score[better]
            back[e[better]] = i + better
        used = np.zeros(len(first), bool)
        at = last
        while at.size:
            used[at] = True
            at = start[back[at]]
            at = at[back[at] >= 0]
        ends = np.flatnonzero(used)
        edges = back[ends]
        own, chars = ids[edges], chars[edges]
        spelt = own < 0
        after = np.cumsum(np.where(spelt, widths[chars], 1))
        out = np.empty(after[-1], np.int64)
        out[after[~spelt] - 1] = own[~spelt]
        if spelt.any():
            raw = np.frombuffer(code[chars[spelt]].tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
            sizes = widths[chars[spelt]]
            out[np.arange(len(raw)) + np.repeat(after[spelt] - np.cumsum(sizes), sizes)] = np.array(self.bytes)[raw]
            if out.min() < 0:
                raise ValueError("the vocabulary has neither a piece nor a byte for a character")
        flat = out.astype("<u4").tobytes()
        stops = 4 * after[np.searchsorted(ends, last[chunk[tails - 1]], "right") - 1]
        gaps = np.minimum.reduceat(first[last] - second[last], chunk[np.append(0, tails[:-1])])
        stops = stops.tolist()
        return [(flat[i:j], gap) for i, j, gap in zip([0, *stops], stops, gaps.tolist(), strict=False)]

    def _learn(self, words: set[str]) -> dict[str, tuple[bytes, float]]:
        """Words that the younger half of the cache lacks, from the older half or solved."""
        if len(self.cache) + len(words) > CACHE:
            self.cache, self.old = {}, self.cache
        old = self.old.get
        out = {w: x for w in words if (x := old(w)) is not None}
        some: list[str] = []
        size = 0
        for w in words - out.keys():
            if len(w) > LONG:
                out[w] = self._word(w)
                continue
            some.append(w)
            size += len(w)
            if size > TOGETHER:
                out.update(zip(some, self._together(some), strict=True))
                some, size = [], 0
        if some:
            out.update(zip(some, self._together(some), strict=True))
        self.cache.update(out)
        return out

    # -- texts -------------------------------------------------------------------

    def split(self, text: str) -> list[str]:
        if not text:
            return []
        return WORDS.findall(" " + text) if self.words_apart else [" " + text]

    def looked_up(self, texts: Iterable[str | None]) -> Iterator[tuple[list[str], list[tuple[bytes, float]]]]:
        """The words of each text, with their best ids and gaps."""
        lot: list[list[str]] = []
        size = 0
        for text in texts:
            lot.append(self.split(text or ""))
            size += len(text or "")
            if size > LOT:
                yield from self._lot(lot)
                lot, size = [], 0
        yield from self._lot(lot)

    def _lot(self, lot: list[list[str]]) -> Iterator[tuple[list[str], list[tuple[bytes, float]]]]:
        find = self.cache.get
        found = [list(map(find, words)) for words in lot]
        holes = [[k for k, x in enumerate(got) if x is None] for got in found]
        missing = {words[k] for words, gone in zip(lot, holes, strict=True) for k in gone}
        now = self._learn(missing) if missing else {}
        for words, got, gone in zip(lot, found, holes, strict=True):
            for k in gone:
                got[k] = now[words[k]]
            yield words, got

    def options(self, word: str, n: int) -> list[tuple[bytes, float]]:
        """The n best segmentations of a word as 32-bit ids, with what they lose against the best."""
        got = self.searched.get((word, n))
        if got is None:
            found = self.n_best(word, n)
            got = [(np.array(ids, "<u4").tobytes(), found[0][1] - s) for ids, s in found]
            if len(word) <= LONG:
                if len(self.searched) >= FEW:
                    self.searched.clear()
                self.searched[word, n] = got
        return got

    def choose(self, words: list[str], found: list[tuple[bytes, float]], n: int) -> tuple[list[bytes], list[float]]:
        """The n best segmentations of a text of these words, best first, as 32-bit ids, and their scores."""
        if not words:
            return [], []
        parts = [x[0] for x in found]
        gaps = np.array([x[1] for x in found])
        if n == 1:
            near = []
        elif len(gaps) >= n:
            near = np.flatnonzero(gaps <= np.partition(gaps, n - 2)[n - 2]).tolist()
        else:
            near = range(len(gaps))
        least = [x for x in sorted((float(gaps[k]), k) for k in near)[: n - 1] if x[0] < np.inf]
        places = sorted(k for _, k in least)
        options = [self.options(words[k], n) for k in places]
        combos: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
        for own in options:
            combos = heapq.nsmallest(n, [(loss + more, (*pick, i)) for loss, pick in combos for i, (_, more) in enumerate(own)])
        between = [b"".join(parts[i:j]) for i, j in zip([0, *(k + 1 for k in places)], [*places, len(parts)], strict=True)]

        def with_options(pick: tuple[int, ...]) -> bytes:
            some = [between[0]]
            for k, own, i, rest in zip(places, options, pick, between[1:], strict=True):
                some += [own[i][0] if i else parts[k], rest]
            return b"".join(some)

        score = float(self.scores[np.frombuffer(with_options((0,) * len(places)), "<u4")].sum())
        out = [with_options(pick) for _, pick in combos]
        return out, [score - loss for loss, _ in combos]

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(b"".join(x[0] for _, found in self.looked_up([text]) for x in found), "<u4").tolist()

    def n_best_ids(self, text: str | None, n: int) -> tuple[list[bytes], list[float]]:
        """The n best segmentations of a whole text, best first, as 32-bit ids, and their scores."""
        return self.choose(*next(self.looked_up([text])), n)

    def n_best_texts(self, text: str | None, n: int) -> list[tuple[list[int], float]]:
        """The n best segmentations of a whole text with their scores; of no text, the empty one."""
        ids, scores = self.n_best_ids(text, n)
        return [(np.frombuffer(x, "<u4").tolist(), s) for x, s in zip(ids, scores, strict=True)] or [([], 0.0)]

    def decode(self, ids: np.ndarray | list[int]) -> str:
        raw = b"".join(map(self.raw.__getitem__, ids if isinstance(ids, list) else ids.tolist()))
        return raw.decode("utf-8", "surrogatepass")[1:]


_loaded: dict[str, Model] = {}


def model(path: str) -> Model:
    if path not in _loaded:
        _loaded[path] = Model(path)
    return _loaded[path]


def encoded(docs: DataFrame, path: str = "piece_bpe_32k.model", n: int = 4, checksums: bool = False) -> DataFrame:
    """``doc_id, ids, nbest_ids, nbest_scores, decoded``: best ids (32-bit), the n best segmentations with their scores, the text decoded again.

    With ``checksums``, ``nbest_crc32`` takes the place of ``nbest_ids``.
    """
    name, of_java, of_arrow = ("nbest_crc32", "array<long>", pa.list_(pa.int64())) if checksums else ("nbest_ids", "array<binary>", pa.list_(pa.binary()))

    def run(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for whole in got:
            for at in range(0, whole.num_rows, 128):
                b = whole.slice(at, 128)
                ids, best, scores, back = [], [], [], []
                for words, found in m.looked_up(b.column(1).to_pylist()):
                    own, score = m.choose(words, found, n)
                    ids.append(own[0] if own else b"")
                    best.append([zlib.crc32(x) for x in own] if checksums else own)
                    scores.append(score)
                    back.append(m.decode(np.frombuffer(ids[-1], "<u4")) if own else "")
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0), pa.array(ids, pa.binary()), pa.array(best, of_arrow),
                        pa.array(scores, pa.list_(pa.float64())), pa.array(back, pa.string()),
                    ],
                    names=["doc_id", "ids", name, "nbest_scores", "decoded"],
                )

    rows = text_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, f"doc_id long, ids binary, {name} {of_java}, nbest_scores array<double>, decoded string")


def digest(docs: DataFrame, path: str = "piece_bpe_32k.model", n: int = 4) -> DataFrame:
    """``doc_id, n_pieces, ids_crc32, nbest_crc32, nbest_scores, decoded_md5``."""
    return encoded(docs, path, n, checksums=True).select(
        "doc_id",
        F.floor(F.length("ids") / 4).cast("long").alias("n_pieces"),
        F.crc32("ids").alias("ids_crc32"),
        "nbest_crc32",
        "nbest_scores",
        F.md5("decoded").alias("decoded_md5"),
    )
