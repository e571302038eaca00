"""Word rules and batch hashing shared by the text operators.

Words of a text: Unicode NFKD, combining marks (Mn) and format characters (Cf) removed,
lower case, then the maximal runs of letters or digits.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash

_MARKS = regex.compile(r"[\p{Mn}\p{Cf}]+")
_WORD = re.compile(r"[^\W_]+")
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)


def fold(text: str) -> str:
    """NFKD without marks and format characters, lower-cased."""
    if text.isascii():
        return text.lower()
    return _MARKS.sub("", unicodedata.normalize("NFKD", text)).lower()


def words(text: str | None) -> list[str]:
    """The words of a text; none for a null text."""
    return _WORD.findall(fold(text)) if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def slices(batch: pa.RecordBatch, text: int, most_rows: int = 2000, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most most_rows rows and most_bytes of text (or one longer text), which bounds a worker's memory."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and (i - start >= most_rows or held + n > most_bytes):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


class WordHashes(dict):
    """Word -> 64-bit hash, remembered up to a bound (then the memory is cleared, results stay the same)."""

    def __init__(self, bound: int = 500_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: str) -> int:
        if len(self) >= self.bound:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        self[word] = h
        return h

    def of(self, flat: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, flat), np.uint64, len(flat))


class Batch:
    """The words of several texts as one flat hash array with offsets."""

    def __init__(self, texts: Iterable[str | None], hashes: WordHashes):
        lists = [words(t) for t in texts]
        self.counts = np.fromiter(map(len, lists), np.int64, len(lists))
        self.offsets = np.concatenate([[0], np.cumsum(self.counts)])
        flat: list[str] = []
        for one in lists:
            flat.extend(one)
        self.flat = flat
        self.hashes = hashes.of(flat)

    def __len__(self) -> int:
        return len(self.counts)

    def runs(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of all runs of n words inside one text, the text of each, and its first word's place."""
        h, total = self.hashes, len(self.hashes)
        if total < n:
            return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        with np.errstate(over="ignore"):
            acc = np.zeros(total - n + 1, np.uint64)
            for k in range(n):
                acc = mix64(acc * _GOLD + h[k : total - n + 1 + k] + np.uint64(k + 1))
        doc = np.repeat(np.arange(len(self)), self.counts)
        keep = doc[: total - n + 1] == doc[n - 1 :]
        at = np.flatnonzero(keep)
        return acc[at], doc[at], at

    def distinct_runs(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The different runs of n words of each text, sorted inside each text, and each text's offsets."""
        run, doc, _ = self.runs(n)
        return _distinct(run, doc, len(self))

    def distinct_words(self) -> tuple[np.ndarray, np.ndarray]:
        """The different word hashes of each text and each text's offsets."""
        doc = np.repeat(np.arange(len(self)), self.counts)
        return _distinct(self.hashes, doc, len(self))


def _distinct(values: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((values, doc))
    v, d = values[order], doc[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
    v, d = v[keep], d[keep]
    return v, np.concatenate([[0], np.cumsum(np.bincount(d, minlength=n_docs))]).astype(np.int64)


def set_key(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """An order-free 64-bit key of each text's set of runs (equal sets have equal keys)."""
    with np.errstate(over="ignore"):
        mixed = np.concatenate([[np.uint64(0)], np.cumsum(mix64(values * _GOLD + np.uint64(7)), dtype=np.uint64)])
        sums = mixed[offsets[1:]] - mixed[offsets[:-1]]
        return mix64(sums + (offsets[1:] - offsets[:-1]).astype(np.uint64) * _M1)
