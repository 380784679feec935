"""Token ids of whole texts by the ``tokenizers`` library, with a cache of words.

The vocabulary drops white space and splits texts at it, so a text's ids are
those of its white-space separated words in turn; ``Words`` looks each word up
in a cache of bounded size and encodes only new ones.  Whether a vocabulary allows that
is checked when it is loaded; if not, texts are encoded whole.
"""

from __future__ import annotations

import re

import numpy as np

#: Words in each half of a worker's cache: a full younger half becomes the older one.
#: One lot with more may grow it beyond that while it is encoded.
CACHE = 550_000
#: Texts that are looked up before the new words among them are encoded together.
LOT = 48
#: What ``str.split`` takes for white space beyond Unicode's White_Space, which the vocabulary uses.
ODD = re.compile("[\x1c-\x1f]")
SPLIT = re.compile(r"[^\S\x1c-\x1f]+")


def split(text: str) -> list[str]:
    return SPLIT.split(text) if ODD.search(text) else text.split()


#: Runs of these after a letter are a piece of their own (the apostrophe is not: it starts endings).
TAIL = ".,!?;:*#&%$|<>()[]"
#: Lower-case words of these letters are left as they are by normalising, and are one piece.
PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")


def _byte_letters() -> dict[int, str]:
    """Letters beyond ASCII as byte-level vocabularies spell their UTF-8: visible bytes as themselves, others from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spell = {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in seen)}
    return {i: "".join(spell[b] for b in chr(i).encode()) for i in range(128, 256)}


BYTES = _byte_letters()
PROBE = "Aé b c d  é\n'll x's 12a\tß."


def vocabulary(name_or_path: str) -> str:
    """The place of a vocabulary file: a path as it is, a bare name from the public set."""
    if "/" in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


class Words:
    def __init__(self, path: str, end_id: int | None = 2) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary(path))
        self.tokenizer.encode_special_tokens = True
        self.end = end_id
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        whole = self.tokenizer.encode(PROBE, add_special_tokens=False).ids
        apart = [i for w in split(PROBE) for i in self.tokenizer.encode(w, add_special_tokens=False).ids]
        self.apart = whole == apart
        self.bare = self._bare() if self.apart else None

    def _bare(self):  # noqa: ANN202
        """The same model without normalising and splitting, for words that neither would change."""
        import json

        from tokenizers import Tokenizer

        spec = json.loads(self.tokenizer.to_str())
        spec["normalizer"] = spec["post_processor"] = None
        spec["pre_tokenizer"], spec["added_tokens"] = None, []
        bare = Tokenizer.from_str(json.dumps(spec))
        letters = [chr(i) for i in range(256) if PLAIN.fullmatch(chr(i))]
        plain = [*letters, "".join(letters), *(w for w in split(PROBE.lower()) if PLAIN.fullmatch(w))]
        fits = all(
            bare.encode(w.translate(BYTES), add_special_tokens=False).ids == self.tokenizer.encode(w, add_special_tokens=False).ids
            for w in plain
        )
        suffix = spec["model"].get("end_of_word_suffix")
        if not (plain and fits and suffix):
            return None
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        self.ends[[i for piece, i in self.tokenizer.get_vocab().items() if piece.endswith(suffix)]] = True
        return bare

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """The ids of words that the younger half of the cache lacks: from the older half, from their parts, or encoded.

        The vocabulary folds case and splits letters from what follows, so
        ``Word,`` is ``word`` and ``,``: only the parts are encoded.  Such a form
        is kept itself once its word has been met before; most forms never come again.
        """
        if len(self.cache) + len(words) > CACHE:
            self.cache, self.old = {}, self.cache
        cache, old = self.cache, self.old
        out: dict[str, bytes] = {}
        made: list[tuple[str, str, str, bool]] = []
        plain: set[str] = set()
        other: set[str] = set()
        for w in words:
            got = old.get(w)
            if got is not None:
                cache[w] = out[w] = got
                continue
            if w.isascii() and w.isalpha() and w.islower():
                plain.add(w)
                continue
            core = w.rstrip(TAIL)
            low = core.lower()
            if not (low.isascii() and low.isalpha()) and not PLAIN.fullmatch(low):
                other.add(w)
                continue
            if low == w:
                plain.add(w)
                continue
            tail = w[len(core) :]
            known = low in cache
            if not known:
                got = old.get(low)
                if got is None:
                    plain.add(low)
                else:
                    known = True
                    cache[low] = got
            made.append((w, low, tail, known))
            if tail and tail not in cache:
                other.add(tail)
        if self.bare is None:
            other |= plain
        elif plain:
            todo = list(plain)
            for at in range(0, len(todo), 1000):
                some = todo[at : at + 1000]
                spelt = [w if w.isascii() else w.translate(BYTES) for w in some]
                ids = self.bare.encode_batch_fast([spelt], is_pretokenized=True, add_special_tokens=False)[0].ids
                ids = np.array(ids, self.dtype)
                cuts = np.flatnonzero(self.ends[ids]) + 1  # a word's last piece is marked in the vocabulary
                raw = ids.tobytes()
                cuts = [0, *(cuts * self.dtype.itemsize).tolist()]
                cache.update(zip(some, (raw[i:j] for i, j in zip(cuts, cuts[1:], strict=False)), strict=True))
        todo = list(other)
        for w, e in zip(todo, self.tokenizer.encode_batch_fast(todo, add_special_tokens=False), strict=True):
            cache[w] = np.array(e.ids, self.dtype).tobytes()
        for w, low, tail, known in made:
            out[w] = cache[low] + cache[tail] if tail else cache[low]
            if known:
                cache[w] = out[w]
        for w in words:
            if w not in out:
                out[w] = cache[w]
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian integers of ``dtype``, ``end_id`` last; null is empty."""
        tail = b"" if self.end is None else np.array([self.end], self.dtype).tobytes()
        if not self.apart:
            got = self.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
            return [np.array(e.ids, self.dtype).tobytes() + tail for e in got]
        out: list[bytes] = []
        for at in range(0, len(texts), LOT):
            out += self._lot(texts[at : at + LOT], tail)
        return out

    def _lot(self, texts: list[str | None], tail: bytes) -> list[bytes]:
        find = self.cache.get
        parted: list[list[str]] = []
        found: list[list[bytes | None]] = []
        holes: list[list[int]] = []
        missing: set[str] = set()
        for text in texts:
            words = split(text) if text else []
            ids = list(map(find, words))
            gaps = [k for k, x in enumerate(ids) if x is None] if None in ids else []
            missing.update([words[k] for k in gaps])
            parted.append(words)
            found.append(ids)
            holes.append(gaps)
        now = self._learn(missing) if missing else {}
        for words, ids, gaps in zip(parted, found, holes, strict=True):
            for k in gaps:
                ids[k] = now[words[k]]
        return [b"".join(ids) + tail for ids in found]  # type: ignore[arg-type]


_loaded: dict[tuple[str, int | None], Words] = {}


def words(path: str, end_id: int | None = 2) -> Words:
    """One encoder a worker process."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if (path, end_id) not in _loaded:
        _loaded[path, end_id] = Words(path, end_id)
    return _loaded[path, end_id]
