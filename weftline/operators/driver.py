"""Arithmetic and checks on configurations, done once before a plan is built; and seeded draws in row order."""

from __future__ import annotations

import random
import warnings
from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merged(*layers: Mapping) -> dict:
    """Nested configurations laid over one another; a later one wins, key by key."""
    out: dict = {}
    for layer in layers:
        for k, v in layer.items():
            out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def flattened(config: Mapping, required: Mapping) -> dict:
    """Values out of their {'desc': ..., 'value': x} wraps; only required keys are kept, absent ones take their default."""
    bare = {k: v["value"] if isinstance(v, Mapping) and "value" in v and set(v) <= {"desc", "value"} else v for k, v in config.items()}
    return {k: bare.get(k, default) for k, default in required.items()}


def batch_sizes(global_batch: int, world: int, microbatch: int | str) -> tuple[int, int | str]:
    """(batch of a device, its micro-batch): the global batch must divide; a micro-batch above the device's batch is cut to it."""
    if global_batch % world:
        raise ValueError(f"a global batch of {global_batch} does not divide by {world}")
    device = global_batch // world
    if isinstance(microbatch, int) and microbatch > device:
        warnings.warn(f"the micro-batch {microbatch} is cut to the device's batch {device}", stacklevel=2)
        microbatch = device
    return device, microbatch


def padded_vocabulary(size: int, multiple: int = 64) -> int:
    return -(-size // multiple) * multiple


def check_separators(bos: list[int], eos: list[int], added: list[int]) -> None:
    """Refuse to concatenate without any separator; warn of ones longer than a token or added twice.

    added: the ids the tokenizer puts around an empty text by itself.
    """
    if not bos and not eos and not added:
        raise ValueError("texts would be concatenated without a separator")
    for name, ids in (("bos", bos), ("eos", eos)):
        if len(ids) > 1:
            warnings.warn(f"{name} is {len(ids)} tokens long", stacklevel=2)
    if bos and added and added[0] == bos[0]:
        warnings.warn("bos is added twice", stacklevel=2)
    if eos and added and added[-1] == eos[-1]:
        warnings.warn("eos is added twice", stacklevel=2)


def disjoint(*names: set[str]) -> None:
    """Split names must not overlap."""
    seen: set[str] = set()
    for part in names:
        if seen & part:
            raise ValueError(f"splits overlap: {sorted(seen & part)}")
        seen |= part


def epoch_indices(n: int, ranks: int, rank: int, seed: int, epoch: int, shuffle: bool = True, drop_last: bool = False) -> np.ndarray:
    """The row numbers a rank reads in an epoch: a seeded permutation, wrapped round (or cut) to a multiple of ranks, every ranks-th of it."""
    order = np.random.Generator(np.random.PCG64DXSM(seed + epoch)).permutation(n) if shuffle else np.arange(n)
    total = n // ranks * ranks if drop_last else -(-n // ranks) * ranks
    return np.resize(order, total)[rank::ranks] if n else order[:0]


def draw_split(df: DataFrame, source: str, order: str, fraction: float, seeds: dict[str, int]) -> DataFrame:
    """split by one draw a row in order, from the Mersenne generator of the source's seed. Each source's keys pass through one task; use hash_split for large sources."""
    kinds = {c: df.schema[c].dataType.simpleString() for c in (source, order)}

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        draw = random.Random(seeds[pdf[source].iloc[0]])
        return pdf.assign(split=["validation" if draw.random() < fraction else "train" for _ in range(len(pdf))])

    drawn = df.select(source, order).groupBy(source).applyInPandas(one, f"{source} {kinds[source]}, {order} {kinds[order]}, split string")
    return df.join(drawn, [source, order])


def from_bytes(df: DataFrame, column: str, dtype: str = "<i8") -> DataFrame:
    """df with a binary column of little-endian integers as an array of bigint; lengths that do not divide are an error."""
    schema = ", ".join(f"{f.name} {'array<bigint>' if f.name == column else f.dataType.simpleString()}" for f in df.schema.fields)

    def go(batches):
        import pyarrow as pa

        for batch in batches:
            i = batch.schema.get_field_index(column)
            values = [None if b is None else np.frombuffer(b, dtype).astype(np.int64) for b in batch.column(i).to_pylist()]
            columns = [pa.array(values, pa.list_(pa.int64())) if k == i else batch.column(k) for k in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return df.mapInArrow(go, schema)


def to_bytes(df: DataFrame, column: str) -> DataFrame:
    """df with an array of bigint as little-endian bytes."""
    schema = ", ".join(f"{f.name} {'binary' if f.name == column else f.dataType.simpleString()}" for f in df.schema.fields)

    def go(batches):
        import pyarrow as pa

        for batch in batches:
            i = batch.schema.get_field_index(column)
            values = [None if v is None else np.asarray(v, "<i8").tobytes() for v in batch.column(i).to_pylist()]
            columns = [pa.array(values, pa.binary()) if k == i else batch.column(k) for k in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return df.mapInArrow(go, schema)


def pretokenized(df: DataFrame, length: int) -> DataFrame:
    """input_ids (kept where the table has them, bytes decoded) cut to length, with attention_mask and token_type_ids; a table with neither ids nor text is an error."""
    if "input_ids" not in df.columns:
        raise ValueError("no input_ids; tokenize the text first" if "text" in df.columns else "neither input_ids nor text")
    if dict(df.dtypes)["input_ids"] == "binary":
        df = from_bytes(df, "input_ids")
    out = df.withColumn("input_ids", F.slice("input_ids", 1, length))
    return out.withColumn("attention_mask", F.transform("input_ids", lambda _: F.lit(1))).withColumn("token_type_ids", F.transform("input_ids", lambda _: F.lit(0)))
