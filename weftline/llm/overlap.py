"""Problem 3: same or near-same records across splits, by similarity-hash bit fingerprints.

A text's fingerprint has TABLES segments of code, each of ROWS minwise coordinates of its
three-word runs cut to BITS_EACH bits, and RADIUS_BITS more bits, one of each coordinate.
Two texts of similarity s agree in a coordinate with probability s, so a segment is equal
with s ** ROWS and a bit differs with (1 - s) / 2: what is lost is known beforehand and
does not depend on the data. Segments are joined between the train and the evaluation
side, pairs within the Hamming radius are candidates, and the exact share of common runs
decides. Texts with equal run sets are collapsed to one representative on each side first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import canonical_source
from ..plans.shared import materialise, partitions_for, shuffle_join
from .neardup import signature
from .similar import RUN, THRESHOLD, crowded, ends, fetched, prefix_pairs, run_sets, verified
from .textnorm import Batch, mix64

TABLES, ROWS, BITS_EACH = 32, 3, 10  # a pair of similarity s meets with 1 - (1 - s^3)^32: 0.99997 at 0.65, 0.9996 at 0.6
BITS = 128  # bits of the fingerprint that the radius is taken of
RADIUS = 48  # at 0.6 similarity 25.6 bits differ on average, 48 lies 4.9 standard deviations above; unrelated texts differ in 64
MOST_TOGETHER = 4096  # texts with one segment whose fingerprints are all compared; more share nearly all they have and go by their rarest runs

CODES, LANES = [f"c{k}" for k in range(TABLES // 2)], [f"f{k}" for k in range(BITS // 64)]
EXTRA = [T.StructField(f, T.LongType()) for f in CODES + LANES]


def blocks() -> Column:
    """The join keys of a fingerprint: each segment with the number of its table."""
    half = [F.shiftright(F.col(CODES[t // 2]), 32 * (t % 2)).bitwiseAND(F.lit(0xFFFFFFFF)) + F.lit(t << 32) for t in range(TABLES)]
    return F.array(*half)


def codes(batch: Batch, size: int = BITS) -> np.ndarray:
    """Minwise coordinates (texts x size) of the different runs of each text."""
    return signature(*batch.distinct_runs(RUN), size)


def fingerprints(batch: Batch) -> np.ndarray:
    """A bit matrix (texts x BITS): bit k is a hash bit of coordinate k."""
    return _bits(codes(batch))


def _bits(sig: np.ndarray) -> np.ndarray:
    return (mix64(sig) >> np.uint64(40) & np.uint64(1)).astype(bool)


def _extra_of(batch: Batch, values: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
    sig = signature(values, offsets, BITS)
    part = sig[:, : TABLES * ROWS] & np.uint64((1 << BITS_EACH) - 1)
    segment = np.zeros((len(sig), TABLES), np.uint64)
    for r in range(ROWS):
        segment = segment << np.uint64(BITS_EACH) | part[:, r::ROWS]
    packed = (segment[:, 1::2] << np.uint64(32) | segment[:, ::2]).view(np.int64)
    lanes = np.packbits(_bits(sig), axis=1).view(">i8").astype(np.int64)
    return [pa.array(np.ascontiguousarray(x[:, k])) for x in (packed, lanes) for k in range(x.shape[1])]


def split_sets(records: DataFrame) -> DataFrame:
    """rec_id, is_eval, run set and fingerprint of every record with a split; repeated deliveries once."""
    known = records.where(F.col("split").isin("train", "validation", "test") & F.col("rec_id").isNotNull()).withColumn("is_eval", F.col("split") != "train")
    sets = run_sets(known, ["rec_id", "is_eval"], EXTRA, _extra_of)
    return materialise(sets, "splitsets")


def class_links(sets: DataFrame, threshold: float = THRESHOLD, most_together: int = MOST_TOGETHER, exhaustive: bool = False) -> DataFrame:
    """key_e, key_t, similarity: near-same run sets, one of an evaluation record and one of a train record.

    exhaustive also lets all texts meet by their rarest runs, which leaves out nothing at a
    multiple of the cost.
    """
    # A representative of each set on each side; fixed-width columns only, combined before the shuffle.
    reps = materialise(sets.groupBy("set_key", "is_eval").agg(F.min("rec_id").alias("id"), *[F.first(f).alias(f) for f in CODES + LANES]), "reps")
    evals, trains = (reps.where(F.col("is_eval") == F.lit(flag)) for flag in (True, False))
    parts = partitions_for(reps, 32 * TABLES)

    def side(rows: DataFrame, tag: str) -> DataFrame:
        out = rows.select(F.explode(blocks()).alias("block"), F.col("id").alias(f"id_{tag}"), *[F.col(f).alias(f"{f}_{tag}") for f in LANES])
        return out.repartition(parts, "block")

    distance = sum((F.bit_count(F.col(f"{f}_e").bitwiseXOR(F.col(f"{f}_t"))) for f in LANES), F.lit(0))
    full = crowded(reps.select(F.explode(blocks()).alias("block"), "id"), "block", "id", most_together)
    crowds = not full.isEmpty()
    evals_of = side(evals, "e")
    cold = shuffle_join(evals_of, full, "block", "left_anti") if crowds else evals_of
    met = shuffle_join(side(trains, "t"), cold, "block").where(distance <= RADIUS).select(F.col("id_e").alias("a"), F.col("id_t").alias("b"))
    # Equal sets meet by their key.
    met = met.unionByName(shuffle_join(trains.select("set_key", F.col("id").alias("b")), evals.select("set_key", F.col("id").alias("a")), "set_key").select("a", "b"))
    met = materialise(met.distinct(), "met")
    wanted, left, right = ends(met), evals.select("id"), trains.select("id")
    if crowds and not exhaustive:
        left, right = (shuffle_join(side(x, t), full, "block", "left_semi").select(F.col(f"id_{t}").alias("id")).distinct() for x, t in ((evals, "e"), (trains, "t")))
    if crowds or exhaustive:
        wanted = wanted.unionByName(left).unionByName(right)
    runs = fetched(sets.withColumnRenamed("rec_id", "id"), wanted)
    if crowds or exhaustive:
        met = met.unionByName(prefix_pairs(runs, left, right, threshold)).distinct()
    keys = [x.select(F.col("id").alias(i), F.col("set_key").alias(k)) for x, i, k in ((evals, "a", "key_e"), (trains, "b", "key_t"))]
    linked = shuffle_join(shuffle_join(verified(met, runs, threshold), keys[0], "a"), keys[1], "b")
    return linked.select("key_e", "key_t", "similarity")


def _members(sets: DataFrame, is_eval: bool, key: str, name: str) -> DataFrame:
    return sets.where(F.col("is_eval") == F.lit(is_eval)).select(F.col("set_key").alias(key), F.col("rec_id").alias(name)).distinct()


def overlap_pairs(records: DataFrame, threshold: float = THRESHOLD, most_together: int = MOST_TOGETHER, exhaustive: bool = False) -> DataFrame:
    """eval_id, train_id, similarity: every near-same pair of a train record and a validation or test record.

    records: rec_id, text, split; other columns are not read. Null ids, splits and texts,
    and texts with too few runs, are in no pair; a record is never paired with itself, and
    repeated rows pair once. An empty side gives no pairs.
    """
    sets = split_sets(records)
    linked = class_links(sets, threshold, most_together, exhaustive)
    pairs = shuffle_join(_members(sets, True, "key_e", "eval_id"), linked, "key_e")
    pairs = shuffle_join(_members(sets, False, "key_t", "train_id"), pairs, "key_t").where("eval_id <> train_id")
    return pairs.groupBy("eval_id", "train_id").agg(F.max("similarity").alias("similarity"))


def found(records: DataFrame, threshold: float = THRESHOLD, most_together: int = MOST_TOGETHER, exhaustive: bool = False) -> DataFrame:
    """rec_id_a, rec_id_b (smaller first) of the overlapping pairs."""
    pairs = overlap_pairs(records, threshold, most_together, exhaustive)
    return pairs.select(F.least("eval_id", "train_id").alias("rec_id_a"), F.greatest("eval_id", "train_id").alias("rec_id_b")).distinct()


def report(records: DataFrame) -> DataFrame:
    """By split and true source of the evaluation record: records, records that overlap with train, pairs.

    Counted from classes of equal run sets: copies are never expanded into pairs. A record
    that stands in both splits does not count as overlapping with itself.
    """
    sets = split_sets(records)
    links = materialise(class_links(sets), "links")
    evals, trains = _members(sets, True, "key_e", "rec_id"), _members(sets, False, "key_t", "rec_id")
    equal = F.col("similarity") == 1.0
    sizes = shuffle_join(trains.groupBy("key_t").agg(F.count("*").alias("size")), links, "key_t")
    sizes = sizes.groupBy("key_e").agg(F.sum("size").alias("n"), F.sum(F.when(equal, F.col("size")).otherwise(0)).alias("n_equal"))
    both = shuffle_join(shuffle_join(evals, trains, "rec_id"), links, ["key_e", "key_t"])
    both = both.groupBy("rec_id", "key_e").agg(F.count("*").alias("own"), F.count(F.when(equal, 1)).alias("own_equal"))
    own = records.where(F.col("split").isin("validation", "test")).select("rec_id", "split", canonical_source(F.col("_source")).alias("source")).dropDuplicates(["rec_id"])
    own = shuffle_join(shuffle_join(own, evals, "rec_id", "left"), both, ["rec_id", "key_e"], "left").fillna(0, ["own", "own_equal"])
    # Records of a class count together, so a class of many copies meets its figures as a row for each split and source.
    alike = own.groupBy("split", "source", "key_e", "own", "own_equal").agg(F.count("*").alias("c"))
    figures = shuffle_join(alike, sizes, "key_e", "left")
    left, left_equal = F.coalesce(F.col("n") - F.col("own"), F.lit(0)), F.coalesce(F.col("n_equal") - F.col("own_equal"), F.lit(0))
    total = lambda c: F.sum(c).alias
    return figures.groupBy("split", "source").agg(
        total(F.col("c"))("records"), total(F.when(left > 0, F.col("c")).otherwise(0))("overlapping"), total(left * F.col("c"))("pairs"),
        total(F.when(left_equal > 0, F.col("c")).otherwise(0))("with_equal_text"),
    )
