"""Online sequence packing: greedy best fit over a bounded buffer, masking on packed batches, no-wrap concatenation.

These are sequential by nature. Parallelism comes from shards: each shard (rank) packs its
own stream, ordered by the shuffle and read as a stream, so a task holds the packer's
buffer and one batch whatever the size of the shard. The number of shards is the reader's choice.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby, islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

_LONGS, _INTS = T.ArrayType(T.LongType()), T.ArrayType(T.IntegerType())
_KINDS = {"batch": T.LongType(), "pseq": T.IntegerType(), "input_ids": _LONGS, "labels": _LONGS, "cu_seqlens": _INTS, "max_seqlen": T.IntegerType(), "attention_mask": _INTS}
PACKED = [T.StructField(name, kind) for name, kind in _KINDS.items()]


@dataclass(frozen=True)
class PackConfig:
    """source_batch sequences are read at once into a buffer of buffer_size; a batch has bins rows of width tokens."""

    source_batch: int
    bins: int
    width: int
    buffer_size: int
    pad: int = -1
    mask: int = 0
    ignore: int = -100
    mask_prob: float = 0.3
    seed: int = 42
    masking: bool = True
    drop_last: bool = True

    @classmethod
    def from_batch(cls, batch_size: int, micro_batch: int, max_seq_len: int, buffer_size: int, source_batch: int, warmup_least: int | None = None, **more) -> PackConfig:
        """bins = batch_size / micro_batch rows of micro_batch * max_seq_len tokens; warmup_least is the batch size a warm-up begins with."""
        if batch_size % micro_batch:
            raise ValueError("batch_size is a multiple of micro_batch")
        if warmup_least is not None and warmup_least % micro_batch:
            raise ValueError("the batch size a warm-up begins with is a multiple of micro_batch")
        return cls(source_batch, batch_size // micro_batch, micro_batch * max_seq_len, buffer_size, **more)


def mask_tokens(ids: np.ndarray, config: PackConfig, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Masked ids and labels from one uniform draw: below 0.8 p the mask, up to 0.9 p a random id, up to p unchanged.

    Random ids run up to the largest id of the batch after masking. Pads may be drawn in
    the ids (as any place may), but their labels stay ignored.
    """
    u, p = rng.random(ids.shape), config.mask_prob
    labels = np.where((u < p) & (ids != config.pad), ids, config.ignore)
    masked = np.where(u < 0.8 * p, config.mask, ids)
    other = rng.integers(0, max(int(masked.max()) + 1, 1), ids.shape)
    return np.where((u >= 0.8 * p) & (u < 0.9 * p), other, masked), labels


class _Intake:
    """Whole source batches until the buffer has no room for one more; empty sequences are left out."""

    def __init__(self, sequences: Iterator[np.ndarray], config: PackConfig):
        self.sequences, self.config, self.buffer = sequences, config, deque()

    def refill(self, room: int) -> bool:
        added, step = 0, self.config.source_batch
        while self.config.buffer_size - len(self.buffer) > step and added + step <= room:
            batch = [s for _, s in zip(range(step), self.sequences)]
            if not batch:
                break
            kept = [s for s in batch if len(s)]
            self.buffer.extend(kept)
            added += len(kept)
        return added > 0


def _pieces(sequences: Iterator[np.ndarray], width: int) -> Iterator[np.ndarray]:
    for s in sequences:
        yield from (s[i : i + width] for i in range(0, max(len(s), 1), width))


def pack_stream(sequences: Iterator[np.ndarray], config: PackConfig, epoch: int = 0) -> Iterator[list[dict]]:
    """Packed batches, each a list of rows.

    A sequence longer than a bin comes as pieces of the bin's width and a rest. Each goes into
    the bin with the least room that still holds it (the first of equals). What fits nowhere
    waits, the latest first, for the next batch; so a bin stays empty only where the stream is at its
    end. That batch is dropped, or with drop_last=False emitted with its non-empty bins.
    """
    if config.buffer_size <= config.source_batch:
        raise ValueError("buffer_size is more than source_batch: else nothing would be read")
    rng = np.random.default_rng(epoch + config.seed)
    intake = _Intake(_pieces(sequences, config.width), config)
    number = 0
    while True:
        room = np.full(config.bins, config.width)
        content: list[list[np.ndarray]] = [[] for _ in range(config.bins)]
        waiting: list[np.ndarray] = []
        while intake.buffer or intake.refill(config.buffer_size - len(waiting)):
            s = intake.buffer.popleft()
            fits = np.where(room >= len(s), room, config.width + 1)
            b = int(fits.argmin())
            if fits[b] > config.width:
                waiting.append(s)
            else:
                room[b] -= len(s)
                content[b].append(s)
        intake.buffer.extendleft(waiting)
        if not all(content):
            if not config.drop_last and any(content):
                yield _rows(number, [c for c in content if c], config, rng)
            return
        yield _rows(number, content, config, rng)
        number += 1


def _rows(number: int, content: list[list[np.ndarray]], config: PackConfig, rng: np.random.Generator) -> list[dict]:
    ids = np.full((len(content), config.width), config.pad, np.int64)
    bounds = []
    for i, parts in enumerate(content):
        flat = np.concatenate(parts)
        ids[i, : len(flat)] = flat
        ends = np.cumsum([0, *map(len, parts)])
        bounds.append(ends if ends[-1] == config.width else np.append(ends, config.width))
    labels, mask = None, None
    if config.masking:
        mask = (ids != config.pad).astype(np.int32)
        ids, labels = mask_tokens(ids, config, rng)
    return [
        {
            "batch": number, "pseq": i, "input_ids": ids[i], "labels": None if labels is None else labels[i], "cu_seqlens": bounds[i].astype(np.int32),
            "max_seqlen": int(np.diff(bounds[i]).max()), "attention_mask": None if mask is None else mask[i],
        }
        for i in range(len(content))
    ]


def _by_shard(df: DataFrame, shard: str, key: str, ids: str, run: Callable[[Iterator], Iterator[tuple]], fields: list[T.StructField], chunk: int = 256) -> DataFrame:
    """shard and fields: run over each shard's sequences (lists) in order of key.

    Rows are partitioned by shard and sorted in the shuffle; a task walks its shards one
    after the other and holds what run holds, never a whole shard.
    """
    schema = T.StructType([df.schema[shard], *fields])
    target = to_arrow_schema(schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, part in groupby(rows(batches), key=itemgetter(0)):
            found = ((name, *row) for row in run(x or [] for _, x in part))
            while block := list(islice(found, chunk)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*block), target)], schema=target)

    return df.select(shard, key, ids).repartition(F.col(shard)).sortWithinPartitions(shard, key).select(shard, ids).mapInArrow(go, schema)


def pack_best_fit(df: DataFrame, shard: str, key: str, ids: str, config: PackConfig, epoch: int = 0) -> DataFrame:
    """Packed batches of each shard's sequences in order of key; null sequences count as empty, over-long ones come in pieces. Runs one packer a shard."""

    def run(sequences: Iterator[list]) -> Iterator[tuple]:
        for batch in pack_stream((np.asarray(x, np.int64) for x in sequences), config, epoch):
            for r in batch:
                yield tuple(r[f.name] for f in PACKED)

    return _by_shard(df, shard, key, ids, run, PACKED)


def concat_nowrap(df: DataFrame, shard: str, key: str, ids: str, length: int) -> DataFrame:
    """shard, chunk, input_ids: sequences gathered until length is reached; the first length tokens are kept, the rest of the buffer discarded."""

    def run(sequences: Iterator[list]) -> Iterator[tuple]:
        number, buffer = 0, []
        for x in sequences:
            buffer += x
            if len(buffer) >= length:
                yield number, buffer[:length]
                number, buffer = number + 1, []

    return _by_shard(df, shard, key, ids, run, [T.StructField("chunk", T.LongType()), T.StructField("input_ids", df.schema[ids].dataType)])


def split_packed(packed: DataFrame, rows_per_micro: int, tolerance: float = 1.0, pad: int = -1) -> DataFrame:
    """packed with micro (which micro-batch of its batch a row is in); rows with more than tolerance of pads lose those after the last real token, and the last bound.

    Pads are read from the attention mask (masking may have written over them in the ids),
    where there is none from the ids.
    """
    mask = F.coalesce("attention_mask", F.transform("input_ids", lambda x: (x != pad).cast("int")))
    real = F.aggregate(mask, F.lit(0), lambda s, x: s + x)
    last = F.size(mask) - F.coalesce(F.nullif(F.array_position(F.reverse(mask), 1), F.lit(0)).cast("int") - 1, F.size(mask))
    strip = F.size(mask) - real > F.size(mask) * F.lit(tolerance)

    def cut(c: str) -> Column:
        return F.when(strip, F.slice(c, F.lit(1), last)).otherwise(F.col(c))

    out = packed.withColumn("micro", F.floor(F.col("pseq") / rows_per_micro).cast("int"))
    arrays = {c: cut(c) for c in ("input_ids", "labels", "attention_mask")}
    return out.withColumns(arrays | {"cu_seqlens": F.when(strip, F.slice("cu_seqlens", F.lit(1), F.size("cu_seqlens") - 1)).otherwise(F.col("cu_seqlens"))})
