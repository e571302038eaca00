"""Problem 7: evaluation passages inside corpus documents, by pigeonhole edit matching.

A passage is a window of RUN words of an item's text. With an error budget of e word edits
it is cut into e + 1 pieces, one of which must stand unchanged in any place within e edits.
Documents are scanned once for exact piece hits; hits on one diagonal chain up, and the
passages that a chain lies in are verified with Myers' bit-parallel distance, all of a
batch at once. A row is a passage whose distance is within the budget; without edits the
one piece is the passage itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..plans.shared import byte_size
from .textnorm import Batch, WordHashes, slices

RUN = 10  # words of a passage
EDITS = 1  # word edits a passage may have
BLOCK_BYTES = 16 << 20  # item text indexed at once; more items are handled in further blocks of the same scan
GROUP_BYTES = 4 << 20  # document text held against one block after the other
MOST_HITS = 1 << 20  # piece hits looked at together, but at least those of one document

FIELDS = [T.StructField(n, T.LongType()) for n in ("item_id", "longest_run", "edits", "passage_words")]


def myers(pattern: Sequence[int], text: Sequence[int]) -> int:
    """Least edit distance between pattern and any part of text, bit-parallel; patterns of any length."""
    m = len(pattern)
    if not m:
        raise ValueError("an empty pattern")
    full, top = (1 << m) - 1, 1 << (m - 1)
    where: dict[int, int] = {}
    for i, x in enumerate(pattern):
        where[x] = where.get(x, 0) | 1 << i
    up, down, score, best = full, 0, m, m
    for x in text:
        eq = where.get(x, 0)
        vertical = eq | down
        horizontal = (((eq & up) + up) ^ up) | eq
        plus, minus = down | (full & ~(horizontal | up)), up & horizontal
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = plus << 1 & full, minus << 1 & full
        up, down = minus | (full & ~(vertical | plus)), plus & vertical
        best = min(best, score)
    return best


def myers_all(patterns: np.ndarray, texts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """myers of each row of patterns (n x m words) against the first sizes[i] words of that row of texts, all rows at once."""
    n, m = patterns.shape
    if m > 64:
        return np.fromiter((myers(p.tolist(), t[:k].tolist()) for p, t, k in zip(patterns, texts, sizes)), np.int64, n)
    one, top, full = np.uint64(1), np.uint64(m - 1), np.uint64((1 << m) - 1)
    weights = one << np.arange(m, dtype=np.uint64)
    up, down = np.full(n, full), np.zeros(n, np.uint64)
    score, best = np.full(n, m), np.full(n, m)
    with np.errstate(over="ignore"):
        for j in range(texts.shape[1]):
            eq = ((patterns == texts[:, j, None]) * weights).sum(1, dtype=np.uint64)
            vertical = eq | down
            horizontal = (((eq & up) + up) ^ up) | eq
            plus, minus = (down | ~(horizontal | up)) & full, up & horizontal
            score = score + (plus >> top & one).astype(np.int64) - (minus >> top & one).astype(np.int64)
            plus, minus = plus << one & full, minus << one & full
            up, down = (minus | ~(vertical | plus)) & full, plus & vertical & full
            best = np.where(j < sizes, np.minimum(best, score), best)
    return best


class PieceIndex:
    """All pieces of the passages of item fields: sorted piece hashes and where each stands."""

    def __init__(self, fields: list[tuple[int, str]], run: int = RUN, edits: int = EDITS):
        self.run, self.edits, self.piece = run, edits, run // (edits + 1)
        batch = Batch([t for _, t in fields], WordHashes())
        self.item = np.array([i for i, _ in fields], np.int64)
        self.words, self.offsets, self.counts = batch.hashes, batch.offsets, batch.counts
        h, field, at = batch.runs(self.piece)
        long_enough = self.counts[field] >= run
        h, field, at = h[long_enough], field[long_enough], at[long_enough]
        order = np.argsort(h, kind="stable")
        self.field, self.place = field[order], (at - self.offsets[field])[order]
        self.pieces, first = np.unique(h[order], return_index=True)
        self.first = np.append(first, len(order))

    def scan(self, batch: Batch) -> tuple[np.ndarray, ...]:
        """doc, item, longest exact run, least edits, words of the item field, for pairs within the budget."""
        h, doc, at = batch.runs(self.piece)
        slot = np.searchsorted(self.pieces, h) if len(self.pieces) else np.zeros(len(h), np.int64)
        hit = np.flatnonzero((slot < len(self.pieces)) & (self.pieces[np.minimum(slot, len(self.pieces) - 1)] == h)) if len(self.pieces) else np.empty(0, np.int64)
        slot, doc, at = slot[hit], doc[hit], at[hit]
        upto = np.cumsum(self.first[slot + 1] - self.first[slot])
        found, start = [], 0
        while start < len(slot):
            # Whole documents whose hits in the items, however frequent a piece is, stay within the bound together.
            base = upto[start - 1] if start else 0
            end = max(int(np.searchsorted(upto, base + MOST_HITS, "right")), int(np.searchsorted(doc, doc[start], "right")))
            if end < len(slot) and doc[end] == doc[end - 1]:
                end = max(int(np.searchsorted(doc, doc[end])), int(np.searchsorted(doc, doc[start], "right")))
            found.append(self._chains(batch, slot[start:end], doc[start:end], at[start:end]))
            start = end
        none = np.empty(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (none,) * 5

    def _chains(self, batch: Batch, slot: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        n = self.first[slot + 1] - self.first[slot]
        posting = np.repeat(self.first[slot] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        doc, at, field, place = np.repeat(doc, n), np.repeat(at, n), self.field[posting], self.place[posting]
        # Chains: hits of one document and field on one diagonal, word after word.
        order = np.lexsort((at, at - place, field, doc))
        doc, at, field, place = doc[order], at[order], field[order], place[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (field[1:] != field[:-1]) | (at[1:] != at[:-1] + 1) | (place[1:] != place[:-1] + 1)
        start = np.flatnonzero(new)
        length = np.diff(np.append(start, len(doc))) + self.piece - 1
        doc, at, field, place = doc[start], at[start], field[start], place[start]
        edits = self._verified(batch, doc, at, field, place, length)
        near = edits <= self.edits
        return self._best(doc[near], field[near], length[near], edits[near])

    def _verified(self, batch: Batch, doc: np.ndarray, at: np.ndarray, field: np.ndarray, place: np.ndarray, length: np.ndarray, most: int = 1 << 16) -> np.ndarray:
        """Least distance of a passage that holds the chain (of one whole passage where the chain is longer)."""
        run, size, e = self.run, self.counts[field], self.edits
        lo = np.where(length >= run, place, np.maximum(0, place + length - run))
        hi = np.where(length >= run, place, np.minimum(place, size - run))
        n = np.maximum(hi - lo + 1, 0)
        chain = np.repeat(np.arange(len(doc)), n)
        begin = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else n
        best = np.full(len(doc), e + 1)
        for k in range(0, len(chain), most):
            c, s = chain[k : k + most], begin[k : k + most]
            patterns = self.words[(self.offsets[field[c]] + s)[:, None] + np.arange(run)]
            middle = at[c] - place[c] + s
            left = np.maximum(batch.offsets[doc[c]], middle - e)
            right = np.minimum(batch.offsets[doc[c] + 1], middle + run + e)
            texts = batch.hashes[np.minimum(left[:, None] + np.arange(run + 2 * e), len(batch.hashes) - 1)]
            np.minimum.at(best, c, myers_all(patterns, texts, right - left))
        return best

    def _best(self, doc: np.ndarray, field: np.ndarray, length: np.ndarray, edits: np.ndarray) -> tuple[np.ndarray, ...]:
        item = self.item[field]
        order = np.lexsort((-length, edits, item, doc))
        doc, item, length, edits, size = doc[order], item[order], length[order], edits[order], self.counts[field[order]]
        first = np.ones(len(doc), bool)
        first[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])
        return doc[first], item[first], length[first], edits[first], size[first]


def _fields(items: DataFrame) -> DataFrame:
    return items.select("item_id", F.explode(F.array("text_a", "text_b")).alias("t")).where("t is not null and item_id is not null")


def leaks(documents: DataFrame, items: DataFrame, run: int = RUN, edits: int = EDITS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, longest_run, edits, passage_words: documents that hold a passage of an item within the edit budget.

    documents: doc_id, text; items: item_id, text_a, text_b; other columns are not read.
    Null texts and ids hold nothing, without documents or items there are no rows,
    repeated documents have repeated rows, and item texts shorter than a passage leak
    nothing (item_report lists them). longest_run is the longest exact run (in words) of
    the best match, edits its least distance to a passage, passage_words the length of the
    item text matched. The items are the query set: their index is broadcast in blocks of
    at most block_bytes of text (or one item's), every document is read and split into
    words once and meets every block, and a worker holds one block at a time.
    """
    spark = documents.sparkSession
    schema = T.StructType([documents.schema["doc_id"], *FIELDS])
    target = to_arrow_schema(schema)
    flat = _fields(items)
    count = max(1, math.ceil(byte_size(flat) / block_bytes))
    blocks = []
    for b in range(count):
        part = flat.where(F.pmod(F.xxhash64("item_id"), F.lit(count)) == b) if count > 1 else flat
        blocks.append(spark.sparkContext.broadcast(PieceIndex([(r["item_id"], r["t"]) for r in part.toLocalIterator()], run, edits)))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for whole in batches:
            for part in slices(whole, 1, most_bytes=GROUP_BYTES):
                texts = Batch(part.column(1).to_pylist(), hashes)
                for block in blocks:
                    doc, *values = block.value.scan(texts)
                    if len(blocks) > 1:
                        block.__dict__.pop("_value", None)  # read again from the executor's disk when it is its turn
                    cols = [part.column(0).take(pa.array(doc))] + [pa.array(v.astype(np.int64)) for v in values]
                    yield pa.RecordBatch.from_arrays([c.cast(t.type) for c, t in zip(cols, target)], schema=target)

    return documents.where("text is not null and doc_id is not null").select("doc_id", "text").mapInArrow(go, schema)


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id of documents that hold at least RUN words in a row of an item unchanged: leaks without edits."""
    return leaks(documents, items, edits=0).select("doc_id", "item_id").distinct()


def item_words(items: DataFrame) -> DataFrame:
    """item_id and the words of its longer text."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for whole in batches:
            for part in slices(whole, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(Batch(part.column(1).to_pylist(), hashes).counts)], names=["item_id", "n"])

    return _fields(items).mapInArrow(go, T.StructType([items.schema["item_id"], T.StructField("n", T.LongType())])).groupBy("item_id").agg(F.max("n").alias("n"))


def item_report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """By item: its words, whether it is too short for a passage, documents that hold it exactly or with edits, longest run, and its leaked share.

    Every item has a row, those that leak nowhere and those too short to be searched too.
    """
    hits = leaks(documents, items).groupBy("item_id").agg(
        F.count(F.when(F.col("edits") == 0, 1)).alias("exact_documents"), F.count(F.when(F.col("edits") > 0, 1)).alias("edited_documents"),
        F.max("longest_run").alias("longest_run"), F.round(F.max(F.col("longest_run") / F.col("passage_words")), 4).alias("largest_share"),
    )
    rows = items.select("item_id", "task", "split").join(item_words(items), "item_id", "left").join(hits, "item_id", "left")
    n = F.coalesce("n", F.lit(0))
    return rows.select(
        "item_id", "task", "split", n.alias("words"), (n < RUN).alias("too_short"), F.coalesce("exact_documents", F.lit(0)).alias("exact_documents"),
        F.coalesce("edited_documents", F.lit(0)).alias("edited_documents"), "longest_run", "largest_share",
    )
