"""What the two similarity problems share: run sets of texts, exact verification, connected components.

Two texts are near-same if, of the different three-word runs in either, at least 60
percent stand in both; texts with fewer than 20 different runs are never near-same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..plans.shared import discard, lookup_join, materialise, shuffle_join
from .textnorm import Batch, WordHashes, set_key, slices

RUN = 3  # words in a run
LEAST_RUNS = 20  # different runs a text needs
THRESHOLD = 0.6  # share of runs that must stand in both texts
SLICE = 16  # buckets with more are told by one member in SLICE

RUN_FIELDS = [T.StructField("set_key", T.LongType()), T.StructField("runs", T.ArrayType(T.IntegerType(), False))]


def run_sets(df: DataFrame, keep: list[str], extra: list[T.StructField], extra_of: Callable, run: int = RUN, least_runs: int = LEAST_RUNS) -> DataFrame:
    """keep columns, set_key and runs (different runs, as 32-bit hashes) and extra columns of each text with enough runs.

    Texts that are null or have fewer than least_runs different runs have no row.
    extra_of(batch, values, offsets) gives the extra columns of a batch whose different
    runs are values[offsets[i]:offsets[i + 1]].
    """
    schema = T.StructType([df.schema[c] for c in keep] + RUN_FIELDS + extra)
    target = to_arrow_schema(schema)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for whole in batches:
            for part in slices(whole, whole.num_columns - 1):
                batch = Batch(part.column(part.num_columns - 1).to_pylist(), hashes)
                values, offsets = batch.distinct_runs(run)
                full = np.flatnonzero(np.diff(offsets) >= least_runs)
                extras = extra_of(batch, values, offsets)
                keys = set_key(values, offsets).view(np.int64)
                short = (values & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
                runs = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(short))
                cols = [part.column(i) for i in range(len(keep))] + [pa.array(keys), runs] + extras
                at = pa.array(full)
                yield pa.RecordBatch.from_arrays([c.take(at).cast(t.type) for c, t in zip(cols, target)], schema=target)

    return df.where(F.col("text").isNotNull()).select(*keep, "text").mapInArrow(go, schema)


def jaccard(a: Column, b: Column) -> Column:
    """Share of the elements of either set (arrays without repeats) that stand in both."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def fetched(sets: DataFrame, ids: DataFrame) -> DataFrame:
    """id and runs of the sets named in ids, each once, as a table of its own.

    All sets are passed once; they are shuffled only if the ids are too many to broadcast.
    """
    wanted = materialise(ids.select("id").distinct(), "wanted")
    return materialise(lookup_join(sets.select("id", "runs"), wanted, "id", "left_semi").dropDuplicates(["id"]), "sets")


def verified(pairs: DataFrame, sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs (a, b) whose run sets (id, runs, each id once) reach the threshold, with their similarity."""
    left = sets.select(F.col("id").alias("a"), F.col("runs").alias("runs_a"))
    right = sets.select(F.col("id").alias("b"), F.col("runs").alias("runs_b"))
    out = shuffle_join(shuffle_join(pairs, left, "a"), right, "b")
    # Sets whose sizes differ too much cannot reach the threshold.
    out = out.where(F.least(F.size("runs_a"), F.size("runs_b")) >= F.greatest(F.size("runs_a"), F.size("runs_b")) * F.lit(threshold))
    out = out.withColumn("similarity", jaccard(F.col("runs_a"), F.col("runs_b")))
    return out.where(F.col("similarity") >= threshold).drop("runs_a", "runs_b")


def ends(pairs: DataFrame) -> DataFrame:
    """The ids of pairs (a, b)."""
    return pairs.select(F.explode(F.array("a", "b")).alias("id"))


def crowded(rows: DataFrame, key: str, member: str, most: int) -> DataFrame:
    """Keys that clearly more than most members share, judged by the members of one hash slice in SLICE.

    This only chooses the way a key's members are compared; both ways find the same pairs.
    """
    seen = rows.where(F.pmod(F.xxhash64(member), F.lit(SLICE)) == 0)
    return materialise(seen.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > most / SLICE).select(key), "crowded")


def prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """id, n, run: the rarest runs of each set (id, runs), enough of them that two sets at the threshold share one.

    A set of n runs needs n - ceil(threshold n) + 1 of them, in one order for all: by how
    many of these sets have the run, then by the run. Runs of a common form stand last, so
    texts that share only the form do not meet.
    """
    flat = sets.select("id", F.size("runs").alias("n"), F.explode("runs").alias("run"))
    common = flat.groupBy("run").agg(F.count("*").alias("df"))
    ordered = shuffle_join(flat, common, "run").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "run"))).alias("r"))  # the runs of one text
    enough = F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - 1e-9).cast("int") + 1
    return ordered.select("id", "n", F.explode(F.slice(F.col("r.run"), F.lit(1), enough)).alias("run"))


def prefix_pairs(sets: DataFrame, left: DataFrame, right: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """a, b: pairs of an id of left and one of right that may reach the threshold, none that does left out.

    sets: id, runs, each id once, of at least all ids of left and right.
    """
    sides = left.select("id", F.lit(1).alias("side")).unionByName(right.select("id", F.lit(2).alias("side"))).distinct()
    sides = materialise(sides.groupBy("id").agg(F.sum("side").alias("side")), "sides")  # 1 left, 2 right, 3 both
    index = materialise(shuffle_join(prefixes(shuffle_join(sets, sides, "id", "left_semi"), threshold), sides, "id"), "prefixes")
    a, b = index.where("side in (1, 3)"), index.where("side in (2, 3)")
    met = shuffle_join(a.select("run", F.col("id").alias("a"), F.col("n").alias("na")), b.select("run", F.col("id").alias("b"), F.col("n").alias("nb")), "run")
    return met.where((F.col("a") != F.col("b")) & (F.least("na", "nb") >= F.greatest("na", "nb") * threshold)).select("a", "b").distinct()


def _state(edges: DataFrame) -> tuple:
    """What tells two sets of different edges (u, v) apart: their number and two order-free sums of hashes."""
    low, high = F.xxhash64("u", "v"), F.xxhash64("v", F.lit(7), "u")
    return tuple(edges.agg(F.count("*"), F.bit_xor(low), F.sum(F.shiftright(high, 24))).first())


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """id and component (smallest id reached) of all ids in edges (a, b).

    Alternates large-star and small-star rounds; every round is written to the shared
    folder and read once more for the sums that tell whether it changed anything. Nothing
    but these comes to the driver.
    """
    current = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    state = _state(current)
    for _ in range(most_rounds):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = shuffle_join(both, low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = shuffle_join(large, low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        settled = materialise(small.where("u <> v").distinct(), "edges")
        before, state = state, _state(settled)
        discard(current)
        current = settled
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = current.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
