"""Problem 6: filling fixed-capacity containers, by variable-capacity best fit on the length histogram.

Lengths are integers up to the largest capacity, so the number of different lengths is
bounded whatever the number of documents. The plan is made on their histogram: a bin is
opened in the permitted size that costs least for each token it will hold, filled with the
largest lengths that still fit, and repeated as often as its lengths last; finally each bin
is downsized to the smallest permitted size that holds its contents. Items are then placed
by their rank within their length, found with distributed counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..plans.shared import materialise
from .tokens import TOKENIZER, TOKENIZER_DIR, with_token_counts

OVERHEAD = 8  # what opening a bin costs besides its size, in tokens
ROWS_OF_SLICE, MOST_SLICES = 20_000, 10_000  # items of the commonest length that are ranked in one independent slice, and the most slices

PLACED = T.StructType(
    [T.StructField("plan", T.StringType()), T.StructField("container", T.LongType()), T.StructField("opened", T.IntegerType()), T.StructField("size", T.IntegerType()), T.StructField("used", T.IntegerType())]
)


class Plan:
    """Patterns of lengths for one plan, from a histogram; counts[length] items of each length."""

    def __init__(self, counts: np.ndarray, capacities: list[int], sizes: list[int], overhead: int = OVERHEAD):
        """capacities: sizes a bin may be opened in; sizes: sizes it may be downsized to."""
        left = counts.astype(np.int64).copy()
        self.capacities, self.sizes = sorted(capacities), sorted(set(sizes) | set(capacities))
        if len(left) > self.capacities[-1] + 1 and left[self.capacities[-1] + 1 :].any():
            raise ValueError("an item is longer than the largest capacity")
        rows, bins, taken = [], 0, np.zeros(len(left), np.int64)
        while (live := np.flatnonzero(left)).size:
            longest = int(live[-1])
            best = None
            for capacity in (c for c in self.capacities if c >= longest):
                pattern = self._fill(left, live, capacity)
                used = sum(n * k for n, k in pattern)
                cost = (capacity + overhead) / max(used, 1)
                if best is None or cost < best[0] - 1e-12:
                    best = (cost, capacity, used, pattern)
            _, opened, used, pattern = best
            times = min(int(left[n] // k) for n, k in pattern)
            size = next(s for s in self.sizes if s >= used)
            for n, k in pattern:
                rows.append((n, int(taken[n]), bins, k, opened, size, used))
                taken[n] += k * times
                left[n] -= k * times
            bins += times
        rows.sort(key=lambda r: (r[0], r[1]))
        self.bins = bins
        #: length, first rank, first container, items of the length in each container, opened, size, used
        self.rows = np.array(rows, np.int64).reshape(-1, 7)
        self.key = (self.rows[:, 0] << np.int64(44)) + self.rows[:, 1]

    @staticmethod
    def _fill(left: np.ndarray, live: np.ndarray, capacity: int) -> list[tuple[int, int]]:
        """Best fit: again and again the largest length that still fits."""
        room, at, pattern = capacity, len(live), []
        while room >= 0 and at > 0:
            at = int(np.searchsorted(live[:at], room, side="right"))
            if at == 0:
                break
            length = int(live[at - 1])
            k = int(left[length]) if length == 0 else min(int(left[length]), room // length)
            pattern.append((length, k))
            room -= k * length
            at -= 1
        return pattern

    def place(self, length: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """container, opened, size, used (columns) of items by length and rank within it."""
        i = np.searchsorted(self.key, (length.astype(np.int64) << np.int64(44)) + rank, side="right") - 1
        r = self.rows[i]
        return np.stack([r[:, 2] + (rank - r[:, 1]) // r[:, 3], r[:, 4], r[:, 5], r[:, 6]], axis=1)


def items(counted: DataFrame, windows: DataFrame) -> DataFrame:
    """plan, doc_id, piece, tokens, length: the items of every plan.

    counted: doc_id, n_tokens. There is a plan for each window and one ('joint') that may use all their
    capacities. An item needs its tokens and the window's specials. A text longer than
    the (largest) capacity by itself is cut into full pieces and a rest; others stay
    whole. Texts without tokens, null ones included, and null ids are no items; windows
    without a capacity are left out, one that its specials fill is an error, and without
    windows there are no items. Repeated documents are packed as often as they come.
    """
    windows = windows.where("window_name is not null and capacity is not null")
    plans = windows.select(F.col("window_name").alias("plan"), "capacity", "specials_per_item")
    joint = windows.agg(F.max("capacity").alias("capacity"), F.max("specials_per_item").alias("specials_per_item"))
    plans = plans.unionByName(joint.where("capacity is not null").select(F.lit("joint").alias("plan"), "capacity", "specials_per_item"))
    # A handful of parameter rows: they become columns of literals, not a join.
    specs = [(r["plan"], int(r["capacity"]), int(r["specials_per_item"] or 0)) for r in plans.collect()]
    if any(c <= s for _, c, s in specs):
        raise ValueError("a window's specials fill its capacity")
    if not specs:
        kind = counted.schema["doc_id"].dataType.simpleString()
        return counted.sparkSession.createDataFrame([], f"plan string, doc_id {kind}, piece int, tokens int, length int")
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("plan"), F.lit(c - s).alias("room"), F.lit(s).alias("specials")) for p, c, s in specs])).alias("w")
    rows = counted.where("n_tokens > 0 and doc_id is not null").select("doc_id", "n_tokens", each).select("doc_id", "n_tokens", "w.*")
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_tokens") - 1) / F.col("room")))).alias("piece"))
    tokens = F.least(F.col("n_tokens") - F.col("piece") * F.col("room"), F.col("room").cast("long"))
    return rows.select("plan", "doc_id", F.col("piece").cast("int").alias("piece"), tokens.cast("int").alias("tokens"), (tokens + F.col("specials")).cast("int").alias("length"))


def ranked(rows: DataFrame, slices: int) -> DataFrame:
    """rows with rank: 0, 1, ... within plan and length.

    Each length is ranked in slices by hash and shifted by the counts of the slices before,
    so a length that a third of the items have is spread over many tasks.
    """
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(slices)))
    keys = ["plan", "length"]
    sizes = rows.groupBy(*keys, "slice").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy(*keys, "slice").orderBy("doc_id", "piece")) - 1
    return rows.withColumn("inside", inside).join(sizes.withColumn("before", before).drop("n"), [*keys, "slice"]).withColumn("rank", (F.col("inside") + F.col("before")).cast("long")).drop("slice", "inside", "before")


def pack(counted: DataFrame, windows: DataFrame, overhead: int = OVERHEAD) -> DataFrame:
    """plan, container, opened, size, used, doc_id, piece, tokens, length: every item in its container.

    Only the histogram of lengths (at most one row for each plan and length up to the
    largest capacity) comes to the driver; the patterns made of it go to the executors.
    """
    spark = counted.sparkSession
    rows = materialise(items(counted, windows), "items")
    capacities = {r["window_name"]: int(r["capacity"]) for r in windows.where("window_name is not null and capacity is not null").collect()}
    sizes = sorted(set(capacities.values()))
    histogram: dict[str, np.ndarray] = {}
    for r in rows.groupBy("plan", "length").agg(F.count("*").alias("n")).toLocalIterator():
        histogram.setdefault(r["plan"], np.zeros(max(sizes) + 1, np.int64))[r["length"]] = r["n"]
    plans = {}
    for name, counts in histogram.items():
        opened = sizes if name == "joint" else [capacities[name]]
        plans[name] = Plan(counts[: max(opened) + 1], opened, [s for s in sizes if s <= max(opened)], overhead)
    shared = spark.sparkContext.broadcast(plans)
    commonest = max((int(c.max()) for c in histogram.values()), default=0)
    ranks = ranked(rows, max(1, min(MOST_SLICES, -(-commonest // ROWS_OF_SLICE))))
    schema = T.StructType(PLACED.fields + [f for f in ranks.schema.fields if f.name in ("doc_id", "piece", "tokens", "length")])
    target, names = to_arrow_schema(schema), [f.name for f in schema.fields]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            plan, length, rank = np.array(column["plan"].to_pylist(), object), column["length"].to_numpy(), column["rank"].to_numpy()
            out = np.zeros((batch.num_rows, 4), np.int64)
            for name in set(plan):
                mine = plan == name
                out[mine] = shared.value[name].place(length[mine], rank[mine])
            column |= {"container": pa.array(out[:, 0]), "opened": pa.array(out[:, 1]), "size": pa.array(out[:, 2]), "used": pa.array(out[:, 3])}
            yield pa.RecordBatch.from_arrays([column[n].cast(target.field(n).type) for n in names], schema=target)

    return ranks.mapInArrow(go, schema)


def packed_documents(documents: DataFrame, windows: DataFrame, tokenizer: str = TOKENIZER, folder: str = TOKENIZER_DIR) -> DataFrame:
    """pack of the documents' texts, counted once with a public tokenizer."""
    counted = with_token_counts(documents.where("text is not null"), ["doc_id"], tokenizer, folder)
    return pack(materialise(counted, "counted"), windows)


def checks(documents: DataFrame, windows: DataFrame) -> DataFrame:
    """By plan: containers that hold more than their size, documents whose pieces do not add up to their tokens, documents split though they fit, and documents packed."""
    counted = materialise(with_token_counts(documents.where("text is not null"), ["doc_id"]), "counted")
    placed = materialise(pack(counted, windows), "placed")
    over = placed.groupBy("plan", "container").agg(F.sum("length").alias("held"), F.max("size").alias("size"), F.max("opened").alias("opened"))
    over = over.groupBy("plan").agg(F.sum(((F.col("held") > F.col("size")) | (F.col("size") > F.col("opened"))).cast("long")).alias("overfull"))
    own = placed.groupBy("plan", "doc_id").agg(F.sum("tokens").alias("placed"), F.count("*").alias("pieces"), F.max(F.col("length") - F.col("tokens")).alias("specials"))
    own = own.join(counted.where("n_tokens > 0"), "doc_id", "left")
    rooms = placed.groupBy("plan").agg(F.max("length").alias("room"))  # a row for each plan
    own = own.join(F.broadcast(rooms), "plan")
    needless = (F.col("pieces") > 1) & (F.col("n_tokens") + F.col("specials") <= F.col("room"))
    parts = own.groupBy("plan").agg(
        F.sum((~F.col("placed").eqNullSafe(F.col("n_tokens"))).cast("long")).alias("documents_cut_short"), F.sum(needless.cast("long")).alias("split_without_need"), F.count("*").alias("documents")
    )
    return over.join(parts, "plan")


def usage(placed: DataFrame) -> DataFrame:
    """By plan and final size: containers, items, tokens held, share of room unused, and share unused of the sizes the bins were opened in."""
    bins = placed.groupBy("plan", "size", "opened", "container").agg(F.count("*").alias("items"), F.sum("length").alias("held"))
    out = bins.groupBy("plan", "size").agg(F.count("*").alias("containers"), F.sum("items").alias("items"), F.sum("held").alias("held"), F.sum("opened").alias("__opened"))
    out = out.withColumn("unused_share", F.round(1 - F.col("held") / (F.col("containers") * F.col("size")), 6))
    return out.withColumn("unused_of_opened", F.round(1 - F.col("held") / F.col("__opened"), 6)).drop("__opened")
