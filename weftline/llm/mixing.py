"""Problem 5: mixing sources to target weights by hierarchical budgeting.

Weights go down a domain - language - source tree. A node gets its share of the budget up
to what its leaves can give; what a leaf lacks goes to its siblings before it goes to
other languages of the domain, and then to other domains. Each leaf is filled with whole
seeded epochs of its records and the prefix of one more.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import canonical_source
from ..plans.shared import lookup_join, materialise

SEED = 42
SLICES = 4096  # slices of a leaf's seeded order; only the slice where the prefix ends is ordered record by record

PLAN_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("mix_name", "source_name", "domain", "lang")]
    + [T.StructField("target_share", T.DoubleType()), T.StructField("target_size", T.DoubleType())]
    + [T.StructField(n, T.LongType()) for n in ("max_repeats", "total_size", "source_size", "capacity")]
    + [T.StructField("short", T.BooleanType()), T.StructField("planned_size", T.DoubleType())]
)


def fill(budget: float, weights: np.ndarray, caps: np.ndarray) -> np.ndarray:
    """Split budget by weight, no part above its cap; what a part lacks goes to the others by weight."""
    given, open_ = np.zeros(len(weights)), (weights > 0) & (caps > 0)
    left = min(budget, float(caps[open_].sum()))
    while left > 1e-9 and open_.any():
        part = np.where(open_, left * weights / weights[open_].sum(), 0.0)
        full = open_ & (given + part >= caps)
        if not full.any():
            return given + part
        left -= float((caps - given)[full].sum())
        given[full] = caps[full]
        open_ &= ~full
        # The others are filled afresh from the budget that the full ones leave.
        left += float(given[open_].sum())
        given[open_] = 0.0
    return given


def allocate(budget: float, leaves: pd.DataFrame, path: tuple[str, ...] = ("domain", "lang", "source_name")) -> pd.Series:
    """Sizes of the leaves (target_share, capacity) of one mix, top down along path."""
    if not path:
        return pd.Series(fill(budget, leaves["target_share"].to_numpy(float), leaves["capacity"].to_numpy(float)), index=leaves.index)
    groups = [g for _, g in leaves.groupby(path[0], sort=True, dropna=False)]
    given = fill(budget, np.array([g["target_share"].sum() for g in groups], float), np.array([g["capacity"].where(g["target_share"] > 0, 0).sum() for g in groups], float))
    return pd.concat([allocate(b, g, path[1:]) for b, g in zip(given, groups)])


def train_records(records: DataFrame) -> DataFrame:
    """rec_id, source, size (code points) of train records with a text and a source, each once, under the true source."""
    known = records.where("split = 'train' and text is not null and _source is not null and rec_id is not null")
    sized = known.select("rec_id", canonical_source(F.col("_source")).alias("source"), F.char_length("text").cast("long").alias("size"))
    return sized.groupBy("rec_id").agg(F.max("source").alias("source"), F.max("size").alias("size")).where("source is not null")


def plan(sized: DataFrame, targets: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row per target: what its source can give (max_repeats times its size), whether that falls short, and the planned size.

    sized: source, size of the records to choose from. A source without records has size 0;
    null shares count as 0, null repeats as 0; targets without a mix or a source name are left out. The plan has a row per target (the targets
    and the catalogue are parameter tables); each mix is planned in one group.
    """
    sizes = materialise(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sizes")
    name = canonical_source(F.col("source_name"))
    places = catalog.select(name.alias("source"), "domain", "lang").dropDuplicates(["source"])
    wanted = targets.where("mix_name is not null and source_name is not null").select(
        "mix_name", "source_name", name.alias("source"), F.coalesce(F.col("target_share"), F.lit(0.0)).alias("target_share"),
        F.coalesce(F.col("max_repeats"), F.lit(0)).cast("long").alias("max_repeats"), F.coalesce(F.col("total_chars"), F.lit(0)).cast("long").alias("total_size"),
    )
    rows = lookup_join(lookup_join(wanted, sizes, "source"), places, "source").drop("source")
    rows = rows.withColumn("source_size", F.coalesce("source_size", F.lit(0)))
    rows = rows.withColumn("capacity", F.col("max_repeats") * F.col("source_size")).withColumn("target_size", F.col("target_share") * F.col("total_size"))
    rows = rows.withColumn("short", F.col("capacity") < F.col("target_size"))

    def one(mix: pd.DataFrame) -> pd.DataFrame:
        mix = mix.reset_index(drop=True)
        mix["planned_size"] = allocate(float(mix["total_size"].max()), mix.assign(domain=mix["domain"].fillna(""), lang=mix["lang"].fillna("")))
        return mix[[f.name for f in PLAN_SCHEMA.fields]]

    return rows.groupBy("mix_name").applyInPandas(one, PLAN_SCHEMA)


def choose(sized: DataFrame, planned: DataFrame, seed: int = SEED) -> DataFrame:
    """mix_name, source_name, rec_id, times: how often each record is used.

    A leaf uses every record floor(planned / size) times, and once more those in the prefix
    of the next seeded epoch that is still needed (with the record that crosses the end,
    unless max_repeats would be passed, which cannot be: an epoch uses a record once). The order of an
    epoch is cut into SLICES by hash; sums of slices place the prefix, so no source is ever
    ordered in one task.
    """
    leaf = planned.where("planned_size > 0 and source_size > 0").select(
        "mix_name", "source_name", canonical_source(F.col("source_name")).alias("source"), "source_size",
        F.least(F.floor(F.col("planned_size") / F.col("source_size")), F.col("max_repeats")).alias("epochs"), "planned_size", "max_repeats",
    )
    leaf = leaf.withColumn("rest", F.when(F.col("epochs") < F.col("max_repeats"), F.col("planned_size") - F.col("epochs") * F.col("source_size")).otherwise(0.0))
    rows = lookup_join(sized, leaf, "source", "inner")
    order = F.xxhash64("rec_id", F.lit(seed), "epochs")
    rows = rows.withColumn("place", order).withColumn("slice", F.shiftrightunsigned(order, 52))
    keys = ["mix_name", "source_name"]
    by_slice = rows.groupBy(*keys, "slice").agg(F.sum("size").alias("slice_size"))
    before = F.coalesce(F.sum("slice_size").over(Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(by_slice.withColumn("before", before), [*keys, "slice"])
    inside = F.sum("size").over(Window.partitionBy(*keys, "slice").orderBy("place", "rec_id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    # Only a slice the prefix ends in needs its records' order.
    cut = (F.col("before") < F.col("rest")) & (F.col("before") + F.col("slice_size") > F.col("rest"))
    ends = rows.where(cut).withColumn("more", (F.col("before") + inside < F.col("rest")).cast("long"))
    others = rows.where(~cut).withColumn("more", (F.col("before") < F.col("rest")).cast("long"))
    both = ends.unionByName(others)
    return both.withColumn("times", F.col("epochs") + F.col("more")).where("times > 0").select(*keys, "rec_id", "size", "times")


def mix(records: DataFrame, targets: DataFrame, catalog: DataFrame, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(plan, choice) of all mixes; see plan and choose."""
    sized = materialise(train_records(records), "sized")
    planned = materialise(plan(sized, targets, catalog), "plan")
    return planned, choose(sized, planned, seed)


def shares(planned: DataFrame, chosen: DataFrame) -> DataFrame:
    """The plan with what was reached: records and size used, most repeats, share of the mix."""
    keys = ["mix_name", "source_name"]
    used = chosen.groupBy(*keys).agg(F.count("*").alias("records"), F.sum(F.col("size") * F.col("times")).alias("used_size"), F.max("times").alias("most_times"))
    rows = planned.join(used, keys, "left").fillna({"records": 0, "used_size": 0, "most_times": 0})
    reached = F.col("used_size") / F.when(F.sum("used_size").over(Window.partitionBy("mix_name")) > 0, F.sum("used_size").over(Window.partitionBy("mix_name")))
    return rows.withColumn("reached_share", F.round(reached, 6)).withColumn("planned_size", F.round("planned_size", 2))


def checks(planned: DataFrame, chosen: DataFrame) -> DataFrame:
    """By mix: its targets, whether the plans add up to what total and capacities allow, no record is used more than max_repeats times, and every source reaches its plan and at most one record more."""
    keys = ["mix_name", "source_name"]
    used = chosen.groupBy(*keys).agg(F.sum(F.col("size") * F.col("times")).alias("used"), F.max("times").alias("most"), F.max("size").alias("largest"))
    rows = planned.join(used, keys, "left").fillna(0, ["used", "most", "largest"])
    reached = (F.col("used") >= F.col("planned_size") - 1e-6) & (F.col("used") <= F.col("planned_size") + F.col("largest") + 1e-6)
    possible = F.least(F.max("total_size").cast("double"), F.sum(F.when(F.col("target_share") > 0, F.col("capacity")).otherwise(0)).cast("double"))
    return rows.groupBy("mix_name").agg(
        F.count("*").alias("targets"), (F.abs(F.sum("planned_size") - possible) < 1e-3).alias("planned_in_full"),
        F.min(F.col("most") <= F.col("max_repeats")).alias("within_repeats"), F.min(reached).alias("reached_as_planned"),
    )


def found(records: DataFrame, targets: DataFrame, catalog: DataFrame) -> DataFrame:
    """mix_name, source_name of the targets that their source cannot meet."""
    return plan(train_records(records), targets, catalog).where("short").select("mix_name", "source_name")


