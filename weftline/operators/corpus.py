"""Corpus building: union, filtering, de-duplication, splitting, sampling and weighting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.texts import hash_order, unit_hash
from ..plans.ordered import position, prefix


def filter_union(df: DataFrame, criteria: list[dict]) -> DataFrame:
    """Rows of df for each criterion (all its columns equal, null equal to null), one after the other.

    A row that matches k criteria appears k times. No criteria: df itself.
    """
    if not criteria:
        return df
    parts = [df.where(reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(v)) for c, v in m.items()], F.lit(True))) for m in criteria]
    return reduce(DataFrame.unionAll, parts)


def keep_columns(df: DataFrame, columns: list[str], required: str | None = None) -> DataFrame:
    """The columns kept, in the order given; a missing one, or a required one not kept, is an error."""
    missing = [c for c in columns if c not in df.columns]
    if missing or required and required not in columns:
        raise ValueError(f"missing columns: {missing or [required]}")
    return df.select(*columns)


def narrowed(ids: Column, largest: int, type_name: str) -> Column:
    """An integer array in a narrower type; a value above largest or below zero stops the query."""
    fits = F.coalesce(F.array_max(ids) <= largest, F.lit(True)) & F.coalesce(F.array_min(ids) >= 0, F.lit(True))
    return F.when(fits, ids.cast(f"array<{type_name}>")).otherwise(F.raise_error(F.lit(f"a token id does not fit {type_name}")).cast(f"array<{type_name}>"))


def union_sources(parts: list[DataFrame], index: str = "src_idx") -> DataFrame:
    """The parts one after the other with their place in the configuration."""
    return reduce(DataFrame.unionByName, [p.withColumn(index, F.lit(i)) for i, p in enumerate(parts)])


def dedup_first(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The first row in order of each key, nulls first; rows with a null key are all kept. Of rows equal in order one is kept.

    The least row of each key is found by an aggregate that combines before the shuffle, so
    a key that a third of the rows share moves one row a task.
    """
    keyed = df.withColumn("__key", key)
    row = F.struct(*df.columns)
    first = keyed.where("__key is not null").groupBy("__key").agg(F.min_by(row, F.struct(*order)).alias("__row"))
    return first.select("__row.*").unionByName(keyed.where("__key is null").drop("__key"))


def build(rows: DataFrame, source: str, order: list[str], limit: int = 0, fraction: float = 0.01, seed: int = 42) -> DataFrame:
    """A corpus: at most limit rows of each source, the first of equal records over all sources, and a split of each source.

    rows: text, guid (may be absent), source and the order columns (whose first is numeric);
    others are not kept. The limit counts the rows of a source in order (0: all). Records are equal by
    their guid where they have one, else by the sha256 of their whole text; the first in
    (source, order) stays, a null source coming first. A share fraction of each source, by
    hash of source and record, is validation. Rows without text are left out.
    """
    guid = F.col("guid") if "guid" in rows.columns else F.lit(None).cast("string").alias("guid")
    held = rows.where(F.col("text").isNotNull()).select("text", guid, source, *order)
    if limit:
        held = prefix(held, order[0], F.lit(1), limit, ties=order[1:], by=[source])
    held = held.withColumn("guid", F.coalesce("guid", F.sha2("text", 256)))
    kept = dedup_first(held, F.col("guid"), [source, *order])
    drawn = F.concat(F.coalesce(source, F.lit("")), F.lit(":"), F.col("guid"))
    return kept.withColumn("split", F.when(unit_hash(seed, drawn) < fraction, "validation").otherwise("train"))


def hash_split(df: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    """split: validation for a fraction of the rows chosen by hash of the key, else train."""
    return df.withColumn("split", F.when(unit_hash(seed, F.col(key)) < fraction, "validation").otherwise("train"))


def positional_split(df: DataFrame, key: str, first: int, most_validation: int | None = None) -> DataFrame:
    """The first rows in order of key are train, the following validation (at most most_validation, others are left out)."""
    rows = position(df, key, "__pos").withColumn("split", F.when(F.col("__pos") <= first, "train").otherwise("validation"))
    if most_validation is not None:
        rows = rows.where(F.col("__pos") <= first + most_validation)
    return rows.drop("__pos")


def token_budget(df: DataFrame, key: str, size: Column, budget: int, by: list[str] | None = None) -> DataFrame:
    """Rows in order of key until their sizes reach the budget, with the row that crosses it; at least one row."""
    if budget <= 0:
        return position(df, key, "__pos", by=by).where("__pos = 1").drop("__pos")
    return prefix(df, key, F.coalesce(size.cast("long"), F.lit(0)), budget, by=by)


def shuffled(df: DataFrame, key: str, seed: int, limit: int | None = None) -> DataFrame:
    """Rows by hash of the key with their place (_row_number from 0), the first limit ones or all."""
    ordered = df.withColumn("__h", hash_order(seed, F.col(key)))
    if limit is None:
        ordered = ordered.withColumn("__n", F.conv(F.substring("__h", 1, 15), 16, 10).cast("long"))
        return position(ordered, "__n", "_row_number", ties=["__h"]).withColumn("_row_number", F.col("_row_number") - 1).drop("__h", "__n")
    top = ordered.orderBy("__h").limit(limit)
    return top.withColumn("_row_number", F.row_number().over(Window.orderBy("__h")).cast("long") - 1).drop("__h")  # limit rows


def block_sample(df: DataFrame, shard: str, size: int, seed: int, key: str | None = None) -> DataFrame:
    """Whole shards in hash order until size rows are reached; with the rows before the shard. Rows without a shard are in none.

    With a key, the rows of a shard are read in its order, place is a row's number in the
    sample (from 0), and the last shard is cut so that size rows come out.
    """
    shards = df.where(F.col(shard).isNotNull()).groupBy(shard).agg(F.count("*").alias("n")).withColumn("h", hash_order(seed, F.col(shard)))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = shards.withColumn("before", before).where(F.col("before") < size).select(shard, "before")  # a row per shard
    rows = df.join(taken, shard)
    if key is None:
        return rows
    rows = position(rows, key, "place", by=[shard])
    return rows.withColumn("place", F.col("before") + F.col("place") - 1).where(F.col("place") < size)


def top_per_shard(df: DataFrame, shard: str, key: str, n: int) -> DataFrame:
    """The first n rows of each shard in order of key."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(shard).orderBy(key))).where(F.col("__rn") <= n).drop("__rn")


def document_sample(df: DataFrame, shard: str, key: str, text: str, n: int, shards: int = 50, per_shard: int = 60, seed: int = 5) -> DataFrame:
    """Of at most shards shards (by hash) the first per_shard rows in order of key; those with text, the first n of them in (shard, key) order."""
    names = df.where(F.col(shard).isNotNull()).select(shard).distinct().withColumn("__h", hash_order(seed, F.col(shard))).orderBy("__h").limit(shards)
    rows = top_per_shard(df.join(F.broadcast(names), shard), shard, key, per_shard)  # the limit bounds the broadcast side
    return rows.where(F.col(text).isNotNull() & (F.col(text) != "")).orderBy("__h", key).limit(n).drop("__h")


def synthetic_lengths(spark: SparkSession, rows: int, mean: float, sd: float, least: int, most: int, vocabulary: int = 1000) -> DataFrame:
    """id, n, input_ids, labels: normal lengths kept within least and most, tokens and labels (7 in 10 are -100) that follow from id and place."""

    def unit(name: str) -> Column:
        return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{name}:"), F.col("id")), 256), 1, 8), 16, 10).cast("double") / 4294967296.0

    z = F.sqrt(-2 * F.log(1 - unit("a"))) * F.cos(F.lit(6.283185307179586) * unit("b"))
    made = spark.range(rows).withColumn("n", F.least(F.greatest(F.floor(z * sd + mean), F.lit(least)), F.lit(most)))
    made = made.withColumn("input_ids", F.transform(F.sequence(F.lit(1).cast("long"), F.col("n")), lambda i: (F.col("id") * 31 + i * 17) % vocabulary))
    return made.withColumn("labels", F.transform("input_ids", lambda x, i: F.when((F.col("id") * 7 + (i + 1) * 13) % 10 < 7, F.lit(-100).cast("long")).otherwise(x)))


def rank_shards(df: DataFrame, key: str, ranks: int, drop_last: bool = False) -> DataFrame:
    """pos (from 0) and rank of each row: position modulo ranks; the end is padded by wrapping round to the first rows, or dropped.

    Positions are numbers, so the padding is the few rows at the start (at most ranks - 1 of
    them; where the table is shorter, they repeat).
    """
    rows = position(df, key, "pos").withColumn("pos", F.col("pos") - 1)
    total = df.count()
    if drop_last:
        rows = rows.where(F.col("pos") < total - total % ranks)
    elif total and total % ranks:
        missing = ranks - total % ranks
        repeats = F.explode(F.sequence(F.lit(0), F.lit(-(-missing // total) - 1))).alias("__turn")
        pad = rows.where(F.col("pos") < missing).select("*", repeats).where(F.col("pos") + F.col("__turn") * total < missing)
        pad = pad.withColumn("pos", F.lit(total) + F.col("pos") + F.col("__turn") * total).drop("__turn")
        rows = rows.unionByName(pad)
    return rows.withColumn("rank", F.pmod("pos", F.lit(ranks)).cast("long"))


def epoch_shards(df: DataFrame, key: str, ranks: int, seed: int, epoch: int, drop_last: bool = False) -> DataFrame:
    """rank_shards of an epoch's permutation: the rows in hash order of the key under seed + epoch."""
    numbered = df.withColumn("__order", F.conv(F.substring(hash_order(seed + epoch, F.col(key)), 1, 15), 16, 10).cast("long"))
    return rank_shards(numbered, "__order", ranks, drop_last).drop("__order")


def instance_weights(weights: DataFrame, counts: DataFrame, key: str, target: float) -> DataFrame:
    """instances = round half even of coefficient x count x target; a weight without a count stops the query."""
    rows = weights.join(counts, key, "left")
    checked = F.when(F.col("n").isNotNull(), F.col("n")).otherwise(F.raise_error(F.concat(F.lit("no count for "), F.col(key))).cast("long"))
    return rows.withColumn("instances", F.bround(F.col("coefficient") * checked * target, 0).cast("long"))


def stream_mix(df: DataFrame, source: str, key: str, choose: dict[str, int], repeat: dict[str, int], seed: int, proportion: dict[str, float] | None = None, total: int = 0) -> DataFrame:
    """Per source: the first choose rows by hash of the key, each repeated; sources in neither stay as they are.

    proportion gives sources a share of total rows instead: their rows are repeated whole
    as often as the share holds them, and the first ones by hash once more for the rest. A
    source has a proportion or a choice, not both; one without rows gives none.
    """
    proportion = proportion or {}
    if set(proportion) & (set(choose) | set(repeat)):
        raise ValueError("a source has a proportion or a choice and repeats, not both")
    name, order = F.col(source), Window.partitionBy(source).orderBy(hash_order(seed, F.col(key)))

    def of(values: dict, default: Column) -> Column:
        return F.coalesce(*[F.when(name == s, F.lit(v)) for s, v in values.items()], default) if values else default

    first = df.where(name.isin(list(choose))) if choose else df.limit(0)
    # The literal bound lets every task drop what cannot be among the first before the shuffle.
    first = first.withColumn("__rn", F.row_number().over(order)).where((F.col("__rn") <= max(choose.values(), default=0)) & (F.col("__rn") <= of(choose, F.lit(0)))).drop("__rn")
    rest = df.where(~F.coalesce(name.isin([*choose, *proportion]), F.lit(False))) if choose or proportion else df
    out = first.unionByName(rest).withColumn("copy", F.explode(F.sequence(F.lit(1), of(repeat, F.lit(1)))))
    if not proportion:
        return out
    held = df.where(name.isin(list(proportion)))
    sizes = {r[source]: r["n"] for r in held.groupBy(source).agg(F.count("*").alias("n")).collect()}  # a row for each source named
    wanted = {s: round(p * total) for s, p in proportion.items() if sizes.get(s)}
    more = {s: n % sizes[s] for s, n in wanted.items()}
    whole = held.withColumn("copy", F.explode(F.when(of({s: n // sizes[s] for s, n in wanted.items()}, F.lit(0)) > 0, F.sequence(F.lit(1), of({s: n // sizes[s] for s, n in wanted.items()}, F.lit(1))))))
    numbered = held.withColumn("__at", F.conv(F.substring(hash_order(seed, F.col(key)), 1, 15), 16, 10).cast("long"))
    again = [prefix(numbered.where(name == s), "__at", F.lit(1), n, ties=[key]).drop("__at").withColumn("copy", F.lit(wanted[s] // sizes[s] + 1)) for s, n in more.items() if n]
    return reduce(DataFrame.unionByName, [out, whole, *again])
