"""Problem 4: groups of near-duplicate records, by circulant MinHash, banding and exact verification.

Two permutations give every signature coordinate: sigma scatters the runs over the ring of
64-bit integers, pi is shifted circularly by k for coordinate k, and the coordinate is the
least pi(sigma(x) + k) over the text's runs. Bands of ROWS coordinates are joined, a
sketch of one bit for each coordinate discards pairs far below the threshold inside
the join, and the exact share of common runs decides. Members of crowded bands are joined
without comparing all of them with one another.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.shared import materialise, partitions_for, shuffle_join
from .similar import THRESHOLD, components, crowded, ends, fetched, prefix_pairs, run_sets, verified
from .textnorm import Batch, mix64

BANDS, ROWS = 36, 3  # a pair of similarity s meets with 1 - (1 - s^ROWS)^BANDS: 0.99999 at 0.65, 0.9998 at 0.6
MOST_TOGETHER = 1024  # members of a band whose sketches are all compared; larger bands go by pivot and rarest runs
SKETCH_BITS = 128  # also the number of coordinates; the bands take the first BANDS * ROWS
LEAST_AGREE = 84  # of the sketch bits; at 0.6 similarity 102.4 agree on average, 84 lies 4.1 standard deviations below

SKETCH, KEYS = [f"f{k}" for k in range(SKETCH_BITS // 64)], [f"b{k}" for k in range(BANDS)]
EXTRA = [T.StructField(f, T.LongType()) for f in SKETCH + KEYS]
_SIGMA, _STEP = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9FB21C651E98DF25)


def sigma(x: np.ndarray) -> np.ndarray:
    """The initial permutation of the 64-bit ring."""
    return mix64(x * _SIGMA + _STEP)


def pi(x: np.ndarray) -> np.ndarray:
    """The permutation that is shifted circularly: pi shifted by k sends x to pi(x + k)."""
    return mix64(x)


def signature(values: np.ndarray, offsets: np.ndarray, size: int) -> np.ndarray:
    """Circulant MinHash (texts x size) of run sets; texts without runs get the largest value."""
    n = np.diff(offsets)
    some = np.flatnonzero(n)
    out = np.full((len(n), size), np.uint64(0xFFFFFFFFFFFFFFFF))
    if len(some):
        with np.errstate(over="ignore"):
            base, starts = sigma(values), offsets[:-1][some]
            for k in range(size):
                out[some, k] = np.minimum.reduceat(pi(base + np.uint64(k)), starts)
    return out


def _extra_of(batch: Batch, values: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
    sig = signature(values, offsets, SKETCH_BITS)
    with np.errstate(over="ignore"):
        bands = np.zeros((len(sig), BANDS), np.uint64)
        for r in range(ROWS):
            bands = mix64(bands * _STEP + sig[:, r : BANDS * ROWS : ROWS])
        bands = mix64(bands + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
    sketch = np.packbits(mix64(sig) & np.uint64(1), axis=1).view(">i8").astype(np.int64)
    return [pa.array(np.ascontiguousarray(x[:, k])) for x in (sketch, bands) for k in range(x.shape[1])]


def links(records: DataFrame, threshold: float = THRESHOLD, most_together: int = MOST_TOGETHER) -> tuple[DataFrame, DataFrame]:
    """(members, edges): rec_id with its class (smallest rec_id with an equal run set), and verified links a < b of classes."""
    sets = materialise(run_sets(records.where("rec_id is not null"), ["rec_id"], EXTRA, _extra_of), "nearsets")
    # Fixed-width columns only, combined before the shuffle: a text of many copies moves as one row a task.
    classes = materialise(sets.groupBy("set_key").agg(F.min("rec_id").alias("id"), *[F.first(f).alias(f) for f in SKETCH + KEYS]), "classes")
    members = shuffle_join(sets.select("rec_id", "set_key").distinct(), classes.select("set_key", "id"), "set_key").select("rec_id", "id")
    rows = classes.select(F.explode(F.array(*KEYS)).alias("band"), "id", *SKETCH)
    full = crowded(rows, "band", "id", most_together)
    crowds = not full.isEmpty()
    rows = rows.repartition(partitions_for(classes, 32 * BANDS), "band")
    cold = shuffle_join(rows, full, "band", "left_anti") if crowds else rows
    agree = SKETCH_BITS - sum((F.bit_count(F.col(f"l.{f}").bitwiseXOR(F.col(f"r.{f}"))) for f in SKETCH), F.lit(0))
    met = shuffle_join(cold.alias("l"), cold.alias("r"), (F.col("l.band") == F.col("r.band")) & (F.col("l.id") < F.col("r.id")) & (agree >= LEAST_AGREE))
    met = materialise(met.select(F.col("l.id").alias("a"), F.col("r.id").alias("b")).distinct(), "met")
    wanted = ends(met)
    if crowds:
        crowd = materialise(shuffle_join(rows, full, "band", "left_semi").select("band", "id"), "crowd")
        wanted = wanted.unionByName(crowd.select("id"))
    runs = fetched(sets.withColumnRenamed("rec_id", "id"), wanted)
    edges = verified(met, runs, threshold).select("a", "b")
    if crowds:
        edges = edges.unionByName(_crowded_links(crowd, runs, threshold))
    return members, edges


def _crowded_links(rows: DataFrame, runs: DataFrame, threshold: float) -> DataFrame:
    """Links that join the members of crowded bands (band, id) as all pairs would.

    Every member is held against its band's smallest id. Two members that both reach it are
    joined through it; only pairs with a member that does not are left, and those are found
    by their rarest runs. Copies of one text thus cost a comparison each, and texts of one
    form that differ otherwise do not meet at all.
    """
    pivots = rows.groupBy("band").agg(F.min("id").alias("a"))
    held = materialise(shuffle_join(rows, pivots, "band").where("id <> a").select("a", F.col("id").alias("b")).distinct(), "held")
    reached = materialise(verified(held, runs, threshold).select("a", "b"), "reached")
    others = shuffle_join(held, reached, ["a", "b"], "left_anti").select(F.col("b").alias("id"))
    met = prefix_pairs(runs, others, rows.select("id"), threshold)
    met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return reached.unionByName(verified(met, runs, threshold).select("a", "b"))


def groups(records: DataFrame, threshold: float = THRESHOLD, most_together: int = MOST_TOGETHER) -> DataFrame:
    """group_id, rec_id of all records in a group of two or more; group_id is the group's smallest rec_id.

    records: rec_id, text; other columns are not read. Null ids and texts and texts with
    too few runs are in no group; a record delivered twice counts once; an empty table has
    no groups.
    """
    members, edges = links(records, threshold, most_together)
    found = components(edges.select("a", "b"))
    placed = shuffle_join(members, found, "id", "left").select("rec_id", F.coalesce("component", "id").alias("group_id"))
    placed = materialise(placed, "placed")
    large = placed.groupBy("group_id").agg(F.count("*").alias("n")).where("n > 1").select("group_id")
    return shuffle_join(placed, large, "group_id").select("group_id", "rec_id")
