"""Sequence operators on small known cases."""

import pytest
from pyspark.sql import functions as F

from weftline.operators import sequences as seq
from weftline.operators import tasks
from weftline.operators.corpus import dedup_first, filter_union, instance_weights, keep_columns, narrowed, rank_shards, token_budget
from weftline.plans.ordered import position, running_total

# A padded batch of two rows, its kept places and bounds.
ROWS = [(0, [1, 2, 3, 0], [1, 1, 1, 0], [0, 1, 2, 3], [1, 2, 3, -100]), (1, [4, 5, 0, 0], [1, 1, 0, 0], [0, 1, 2, 3], [4, 5, -100, -100])]
INDICES, BOUNDS, POSITIONS, LABELS = [0, 1, 2, 4, 5], [3, 5], [0, 1, 2, 0, 1], [1, 2, 3, 4, 5]


def one(spark, column, schema="x int", row=(0,)):
    return spark.createDataFrame([row], schema).select(column.alias("v")).first()["v"]


def test_unpad_and_repad(spark):
    df = spark.createDataFrame(ROWS, "r int, ids array<bigint>, m array<int>, p array<bigint>, l array<bigint>")
    flat = seq.unpad(df, "r", "ids", "m", ["p", "l"]).orderBy("index").collect()
    assert [x["index"] for x in flat] == INDICES and [x["p"] for x in flat] == POSITIONS and [x["l"] for x in flat] == LABELS
    lengths = seq.cumulative_lengths(df, "r", "m").orderBy("r").collect()
    assert [x["cu_seqlen"] for x in lengths] == BOUNDS and max(x["seqlen"] for x in lengths) == 3
    rows = seq.unpad(df, "r", "ids", "m", ["l"])
    assert [x["values"] for x in seq.repad(rows, df, "r", 4).orderBy("r").collect()] == [x[1] for x in ROWS]
    assert [x["values"] for x in seq.repad(rows, df, "r", 4, "l", seq.IGNORE).orderBy("r").collect()] == [x[4] for x in ROWS]


@pytest.mark.parametrize("mode, expected", [
    ("middle", [[4, 3, 4, 3], [2, 1, 2, 1], [4, 3, 4, 3], [2, 1, 2, 1]]),
    ("edge", [[1, 2, 1, 2], [3, 4, 3, 4], [1, 2, 1, 2], [3, 4, 3, 4]]),
    ("center", [[0, 0, 0, 0], [0, 1, 2, 0], [0, 3, 4, 0], [0, 0, 0, 0]]),
])
def test_tiling(spark, mode, expected):
    matrix = F.array(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3), F.lit(4)))
    assert one(spark, seq.tiled_matrix(matrix, 4, 4, mode)) == expected


def test_segments(spark):
    ids = F.array(*map(F.lit, [9, 1, 2, 9, 3, 9]))
    assert one(spark, seq.segment_ids(ids, F.lit(9), "bos")) == [1, 1, 1, 2, 2, 3]
    assert one(spark, seq.segment_ids(ids, F.lit(9), "eos")) == [0, 1, 1, 1, 2, 2]
    df = spark.createDataFrame([(1, [9, 1, 2, 9, 3, 9])], "k int, ids array<int>")
    for mode in ("bos", "eos"):
        assert [r["sequence_id"] for r in seq.segment_rows(df, "k", "ids", 9, mode).orderBy("pos").collect()] == one(spark, seq.segment_ids(ids, F.lit(9), mode))
    with pytest.raises(ValueError):
        seq.segment_ids(ids, F.lit(9), "both")


def test_chunks(spark):
    df = spark.createDataFrame([(0, [1, 2, 3]), (1, []), (2, None), (3, [4, 5, 6, 7, 8, 9, 10]), (4, [11])], "k int, ids array<int>")
    assert [r["input_ids"] for r in seq.concat_chunks(df, "k", "ids", 4).orderBy("chunk").collect()] == [[1, 2, 3, 4], [5, 6, 7, 8]]
    assert seq.concat_chunks(df, "k", "ids", 4, most_tokens=4).count() == 1
    assert seq.concat_chunks(df.limit(0), "k", "ids", 4).count() == 0


def test_chunks_keep_null_groups_and_a_null_key(spark):
    rows = [(None, 1, [1, 2, 3]), (None, 2, [4, 5]), ("x", 1, [6, 7]), ("x", None, [8, 9]), (None, 3, [10, 11, 12]), ("x", 2, None)]
    df = spark.createDataFrame(rows, "g string, k int, ids array<int>")
    got = {(r["g"], r["chunk"]): r["input_ids"] for r in seq.concat_chunks(df, "k", "ids", 4, by=["g"]).collect()}
    assert got == {(None, 0): [1, 2, 3, 4], (None, 1): [5, 10, 11, 12], ("x", 0): [8, 9, 6, 7]}


def test_bounds_and_pairs(spark):
    ids = lambda *v: F.array(*map(F.lit, v)) if v else F.array().cast("array<int>")
    assert one(spark, seq.ensure_bounds(ids(5, 6), F.lit(1), F.lit(2), 4)) == [1, 5, 6, 2]
    assert one(spark, seq.ensure_bounds(ids(1, 5, 6, 7), F.lit(1), F.lit(2), 4)) == [1, 5, 6, 2]
    assert one(spark, seq.ensure_bounds(ids(1, 2), F.lit(1), F.lit(2), 4)) == [1, 2]
    assert one(spark, seq.pair_with_specials(ids(*range(10, 20)), ids(30, 31), F.lit(1), F.lit(2), 9)) == [1, 10, 11, 12, 13, 2, 30, 31, 2]
    assert one(spark, seq.pair_with_specials(ids(*range(10, 20)), ids(*range(30, 40)), F.lit(1), F.lit(2), 10)) == [1, 10, 11, 12, 13, 2, 30, 31, 32, 2]
    assert one(spark, seq.truncate_pad(ids(), 3, F.lit(0))) == [0, 0, 0] and one(spark, seq.truncate_pad(ids(1, 2, 3, 4), 3, F.lit(0))) == [1, 2, 3]


def test_hash_mask_rates(spark):
    df = spark.range(200).select("id", F.transform(F.sequence(F.lit(1), F.lit(500)), lambda i: (i + 10).cast("long")).alias("ids"))
    out = seq.hash_mask(df, "id", "ids", 0.3, 4, 0, 3000, 1)
    flat = out.select(F.explode(F.arrays_zip("ids", "masked_ids", "labels")).alias("z")).select("z.*").toPandas()
    chosen = flat["labels"] != seq.IGNORE
    assert abs(chosen.mean() - 0.3) < 0.01 and abs((flat.masked_ids[chosen] == 4).mean() - 0.8) < 0.01
    assert (flat.masked_ids[~chosen] == flat.ids[~chosen]).all() and (flat.labels[chosen] == flat.ids[chosen]).all()
    again = seq.hash_mask(df.repartition(7), "id", "ids", 0.3, 4, 0, 3000, 1)
    assert out.exceptAll(again).count() == 0


def test_warmup_sizes(spark):
    steps = seq.warmup_thresholds(2, 5, 100, 2)
    assert steps == [12, 28, 50] or steps[-1] == 50
    got = [one(spark, seq.warmup_batch_size(F.lit(s), 2, 5, 100, 2)) for s in (0, steps[0], steps[1], 50, 999)]
    assert got == [2, 3, 4, 5, 5]
    assert one(spark, seq.warmup_batch_size(F.lit(7), 4, 4, 100, 2)) == 4


def test_running_totals_match_a_plain_loop(spark):
    rows = [((i * 37) % 500, i % 7, i % 3) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, v int, g int").repartition(5)
    total, expected = 0, {}
    for k, v, _ in sorted(rows):
        total += v
        expected[k] = total
    assert {r["k"]: r["t"] for r in running_total(df, "k", F.col("v").cast("long"), "t").collect()} == expected
    got = {r["k"]: r["n"] for r in position(df, "k", "n", by=["g"]).collect()}
    seen = {}
    for k, _, g in sorted(rows):
        seen[g] = seen.get(g, 0) + 1
        assert got[k] == seen[g]
    assert running_total(df.limit(0), "k", F.col("v").cast("long"), "t").count() == 0


def test_corpus_edges(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", 5), (3, None, 5), (4, None, 6)], "k int, s string, n int")
    assert sorted(r["k"] for r in dedup_first(df, F.col("s"), ["k"]).collect()) == [1, 3, 4]
    assert sorted(r["k"] for r in filter_union(df, [{"s": "a"}, {"n": None}, {"n": 5}]).collect()) == [1, 1, 2, 2, 3]
    assert filter_union(df, []).count() == 4
    assert sorted(r["k"] for r in token_budget(df, "k", F.col("n"), 5).collect()) == [1, 2]
    assert [r["k"] for r in token_budget(df, "k", F.col("n"), 0).collect()] == [1]
    with pytest.raises(ValueError):
        keep_columns(df, ["k", "absent"])
    with pytest.raises(Exception, match="does not fit"):
        spark.range(1).select(narrowed(F.array(F.lit(70000)), 32767, "smallint")).collect()
    ranks = rank_shards(df.select("k"), "k", 3).orderBy("pos").collect()
    assert [(r["k"], r["rank"]) for r in ranks] == [(1, 0), (2, 1), (3, 2), (4, 0), (1, 1), (2, 2)]
    assert [r["pos"] for r in rank_shards(df.select("k").limit(1), "k", 3).orderBy("pos").collect()] == [0, 1, 2]
    assert rank_shards(df.select("k"), "k", 3, drop_last=True).count() == 3
    weights = spark.createDataFrame([("x", 0.5)], "s string, coefficient double")
    with pytest.raises(Exception, match="no count for x"):
        instance_weights(weights, spark.createDataFrame([("y", 3)], "s string, n int"), "s", 1.0).collect()


def test_task_edges(spark):
    with pytest.raises(ValueError):
        tasks.task_columns("unknown")
    options = F.array(F.lit("a"), F.lit("b"))
    assert one(spark, tasks.padded_options(options, 4)) == ["a", "b", "NA", "NA"]
    with pytest.raises(Exception, match="more than 1 options"):
        one(spark, tasks.padded_options(options, 1))
    df = spark.createDataFrame([("m-task=a_b_seed=3",), ("task=x_seed=1",), ("nothing",)], "n string")
    assert [(r["task"], r["seed"]) for r in df.select(*tasks.key_values(F.col("n"), ["task", "seed"])).collect()] == [(None, "3"), ("x", "1"), (None, None)]
    assert one(spark, tasks.rope_theta(F.lit(10**12), 10_000, 160_000, 10**9)) == 160_000
    with pytest.raises(ValueError):
        tasks.cosine_inverse_sqrt(F.lit(1), 10, 50, 10, 1000, final=0.9)
