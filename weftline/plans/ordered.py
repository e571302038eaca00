"""Running totals and positions over a whole table without putting it in one task.

The order key is cut into slices at approximate quantiles, as many as the rows need; a
small aggregate gives each slice's total, and only the running total inside a slice needs
the rows of that slice. A table that fits one slice takes one window and nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import BROADCAST_BYTES, byte_size, materialise

ROWS_OF_SLICE, MOST_SLICES = 50_000, 10_000


def slice_count(rows: int, each: int = ROWS_OF_SLICE) -> int:
    """Slices for a number of rows: so many rows each, at most MOST_SLICES (larger ones then; a slice's sort may spill)."""
    return max(1, min(MOST_SLICES, -(-rows // each)))


def _bounds(df: DataFrame, key: str, slices: int | None) -> list:
    """The upper ends of all slices but the last."""
    slices = slices or slice_count(df.count())
    if slices < 2:
        return []
    cuts = ", ".join(f"{k / slices}D" for k in range(1, slices))
    return sorted(set(df.agg(F.expr(f"percentile_approx({key}, array({cuts}), {max(10_000, 10 * slices)})").alias("b")).first()["b"] or []))


def _slice_of(key: str, bounds: list, step: int = 100) -> Column:
    """The slice (0 ..) of a numeric key, found in two steps; null keys come first."""
    if not bounds:
        return F.lit(0)

    def below(values: Column) -> Column:
        return F.size(F.filter(values, lambda b: b < F.col(key)))

    if len(bounds) <= step:
        found = below(F.array(*map(F.lit, bounds)))
    else:
        groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
        coarse = below(F.array(*[F.lit(g[-1]) for g in groups]))
        inner = F.get(F.array(*[F.array(*map(F.lit, g)) for g in groups]), F.least(coarse, F.lit(len(groups) - 1)))
        found = F.when(coarse == len(groups), F.lit(len(bounds))).otherwise(coarse * step + below(inner))
    return F.when(F.col(key).isNull(), 0).otherwise(found)


def _earlier(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, __slice, __sum and __before (the sum of the slices before), one row for each slice and value of by."""
    totals = rows.groupBy(*by, "__slice").agg(F.sum("__value").alias("__sum"))
    earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn("__before", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)))


def _inside(key: str, ties: list[str], by: list[str]) -> Window:
    return Window.partitionBy(*by, "__slice").orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, 0)


def _totals(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """columns of the totals of each slice and value of by; broadcast if they are small, so that the rows they meet stay where they are."""
    named = materialise(_earlier(rows, by).select(*[F.col(c).alias(f"__t_{c}") for c in [*by, "__slice"]], *columns), "slices")
    return F.broadcast(named) if byte_size(named) <= BROADCAST_BYTES else named


def _joined(rows: DataFrame, totals: DataFrame, by: list[str]) -> DataFrame:
    return rows.join(totals, [F.col(c).eqNullSafe(F.col(f"__t_{c}")) for c in [*by, "__slice"]]).drop(*[f"__t_{c}" for c in [*by, "__slice"]])


def running_total(df: DataFrame, key: str, value: Column, alias: str, ties: list[str] | None = None, by: list[str] | None = None, slices: int | None = None, sizes: DataFrame | None = None, keep_slice: bool = False) -> DataFrame:
    """df with the sum of value over the rows up to and including each one, in order of key (and ties), within by.

    key is numeric; rows equal in key and ties are ordered arbitrarily. Null keys come
    first, nulls in by are a group. The cuts are read once from the data and become
    literals, so recomputed tasks see the same slices. sizes (by, key and __value of the same
    rows) spares reading wide rows for cuts and sums. keep_slice also gives __slice, by
    which (and by) the result is partitioned, and the slice's __before and __sum.
    """
    by, ties = by or [], ties or []
    small = df.withColumn("__value", value).select(*dict.fromkeys([*by, key, "__value"])) if sizes is None else sizes
    bounds = _bounds(small, key, slices)
    rows = df.withColumn("__slice", _slice_of(key, bounds)).withColumn("__value", value)
    total = F.sum("__value").over(_inside(key, ties, by))
    kept = [*df.columns, *["__slice", "__before", "__sum"][: 3 * keep_slice]]
    if not bounds:
        return rows.withColumn(alias, total).withColumns({"__before": F.lit(0), "__sum": F.lit(None).cast("long")}).select(*kept, alias)
    before = _totals(small.withColumn("__slice", _slice_of(key, bounds)), by, ["__before", "__sum"])
    out = _joined(rows.withColumn("__inside", total), before, by)
    return out.withColumn(alias, F.col("__inside") + F.col("__before")).select(*kept, alias)


def position(df: DataFrame, key: str, alias: str, ties: list[str] | None = None, by: list[str] | None = None, slices: int | None = None) -> DataFrame:
    """df with each row's number, 1, 2, ..., in order of key."""
    return running_total(df, key, F.lit(1).cast("long"), alias, ties, by, slices)


def prefix(df: DataFrame, key: str, value: Column, limit: int, ties: list[str] | None = None, by: list[str] | None = None, slices: int | None = None) -> DataFrame:
    """The rows of df, in order of key within by, before which the sum of value (not negative) is still below limit.

    Slices that end below the limit are taken whole and those that begin beyond it are left
    out; only the slice where the limit lies is ordered.
    """
    by, ties, bounds = by or [], ties or [], _bounds(df, key, slices)
    rows = df.withColumn("__slice", _slice_of(key, bounds)).withColumn("__value", value)
    inside = F.sum("__value").over(_inside(key, ties, by))
    if not bounds:
        return rows.withColumn("__upto", inside).where(F.col("__upto") - F.col("__value") < limit).select(*df.columns)
    rows = _joined(rows, _totals(rows, by, ["__before", "__sum"]), by)
    whole = F.col("__before") + F.col("__sum") < limit
    last = rows.where(~whole & (F.col("__before") < limit)).withColumn("__upto", inside)
    last = last.where(F.col("__before") + F.col("__upto") - F.col("__value") < limit)
    return rows.where(whole).select(*df.columns).unionByName(last.select(*df.columns))
