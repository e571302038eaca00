"""Null and repeated keys, many slices, no limits: nothing is lost."""

import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import corpus, metrics, tasks
from weftline.operators import sequences as seq
from weftline.plans import ordered


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_first_rows_with_null_and_equal_order_keys(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, 5, "b"), (3, 6, "b"), (4, None, "b"), (4, None, "b"), (5, 1, None), (5, 1, None), (None, 1, "c")], "k int, o int, t string")
    got = sorted(map(str, corpus.dedup_first(df, F.col("t"), ["k", "o"]).collect()))
    assert got == sorted(["Row(k=1, o=None, t='a')", "Row(k=2, o=5, t='b')", "Row(k=5, o=1, t=None)", "Row(k=5, o=1, t=None)", "Row(k=None, o=1, t='c')"])
    assert corpus.dedup_first(df.limit(0), F.col("t"), ["k"]).count() == 0


@pytest.mark.parametrize("slices", [1, 7, 350])
def test_running_totals_in_any_number_of_slices(spark, slices):
    r = random.Random(slices)
    data = [(i, r.choice([None, "x", "y"]), r.choice([None, *range(300)]), r.randrange(9)) for i in range(900)]
    df = spark.createDataFrame(data, "i int, g string, k int, v int")
    got = {x["i"]: x["t"] for x in ordered.running_total(df, "k", F.col("v"), "t", ties=["i"], by=["g"], slices=slices).collect()}
    sums, expected = {}, {}
    for i, g, k, v in sorted(data, key=lambda x: (x[2] is not None, x[2] or 0, x[0])):
        sums[g] = sums.get(g, 0) + v
        expected[i] = sums[g]
    assert got == expected
    for limit in (0, 1, 500, 10_000):
        kept = {x["i"] for x in ordered.prefix(df, "k", F.col("v"), limit, ties=["i"], by=["g"], slices=slices).collect()}
        value = {i: v for i, _, _, v in data}
        assert kept == {i for i, t in expected.items() if t - value[i] < limit}


def test_slices_follow_the_rows():
    assert [ordered.slice_count(n) for n in (0, ordered.ROWS_OF_SLICE, ordered.ROWS_OF_SLICE + 1, 10**12)] == [1, 1, 2, ordered.MOST_SLICES]


def test_budget_keeps_at_least_a_row(spark):
    df = spark.createDataFrame([(3, 5), (1, 4), (2, None)], "k int, n int")
    assert [rows(corpus.token_budget(df, "k", F.col("n"), b), "k") for b in (0, 4, 5, 99)] == [[(1,)], [(1,)], [(1,), (2,), (3,)], [(1,), (2,), (3,)]]


def test_chunks_of_repeated_keys_and_of_long_sequences(spark):
    df = spark.createDataFrame([(1, [1, 2]), (1, [3, 4, 5]), (2, list(range(6, 26))), (None, [0])], "k int, ids array<int>")
    got = {r["chunk"]: r["input_ids"] for r in seq.concat_chunks(df, "k", "ids", 4).collect()}
    assert sorted(x for c in got.values() for x in c) == list(range(24)) and got[0][0] == 0 and set(map(len, got.values())) == {4} and set(got) == set(range(6))


def test_segments_repad_and_unpad_of_odd_rows(spark):
    df = spark.createDataFrame([(1, [9, 9, 1], [1, 0, 1]), (2, [], []), (3, None, None), (4, [5], [0])], "k int, ids array<int>, m array<int>")
    assert {r["k"]: r["s"] for r in df.select("k", seq.segment_ids(F.col("ids"), F.lit(9), "eos").alias("s")).collect()} == {1: [0, 1, 2], 2: [], 3: None, 4: [0]}
    assert rows(seq.segment_lengths(df, "k", "ids", 9, "bos"), "k", "sequence_id", "n") == [(1, 1, 1), (1, 2, 2), (4, 0, 1)]
    packed = seq.unpad_rows(df, "k", "ids", "m", width=3)
    assert {r["k"]: (r["row"], r["index"], r["value"]) for r in packed.collect()} == {1: (0, [0, 2], [9, 1]), 2: (1, [], []), 3: (2, [], []), 4: (3, [], [])}
    assert {r["k"]: r["values"] for r in seq.repad_rows(packed, "k", 2, fill=7).collect()} == {1: [9, 7], 2: [7, 7], 3: [7, 7], 4: [7, 7]}


def test_full_shuffle_numbers_every_row(spark):
    df = spark.range(500).withColumnRenamed("id", "k").withColumn("_row_number", F.lit("clash"))
    got = corpus.shuffled(df.drop("_row_number"), "k", 3).collect()
    assert sorted(r["_row_number"] for r in got) == list(range(500)) and [r["k"] for r in sorted(got, key=lambda r: r["_row_number"])] != list(range(500))
    head = {r["_row_number"]: r["k"] for r in corpus.shuffled(df.drop("_row_number"), "k", 3, 20).collect()}
    assert head == {r["_row_number"]: r["k"] for r in got if r["_row_number"] < 20}


def test_more_classes_than_the_plan_holds(spark):
    df = spark.createDataFrame([(1, ["b", "a"], 1), (2, ["c", "x", "c"], 0), (3, [], 1), (4, None, 1), (5, ["c", None], 1)], "k int, l array<string>, t int")
    few = {r["k"]: r["multi_hot"] for r in tasks.multi_hot(df, "l", F.col("t") == 1).collect()}
    many = {r["k"]: r["multi_hot"] for r in tasks.multi_hot(df, "l", F.col("t") == 1, most_classes=2).collect()}
    assert few == many == {1: [1.0, 1.0, 0.0], 2: [0.0, 0.0, 1.0], 3: [0.0] * 3, 4: [0.0] * 3, 5: [0.0, 0.0, 1.0]}


def test_stream_proportions(spark):
    df = spark.createDataFrame([(i, "a" if i < 10 else "b" if i < 40 else None) for i in range(50)], "k int, s string")
    got = corpus.stream_mix(df, "s", "k", {}, {}, 1, {"a": 0.25, "b": 0.2, "z": 0.5}, 100).collect()
    by = {s: [r["k"] for r in got if r["s"] == s] for s in ("a", "b", None)}
    assert {s: len(v) for s, v in by.items()} == {"a": 25, "b": 20, None: 10} and all(2 <= by["a"].count(k) <= 3 for k in range(10)) and len(set(by["b"])) == 20
    with pytest.raises(ValueError):
        corpus.stream_mix(df, "s", "k", {"a": 1}, {}, 1, {"a": 0.5}, 10)


def test_corpus_build_order_limit_and_guid(spark):
    data = [("b", 1, "same", None), ("a", 2, "same", None), ("a", 3, "other", "g"), ("b", 4, "third", "g"), (None, 5, "same", None), ("a", 9, "late", None), ("b", 6, None, None)]
    df = spark.createDataFrame(data, "source string, k int, text string, guid string")
    assert rows(corpus.build(df, "source", ["k"]), "k") == [(3,), (5,), (9,)]
    assert rows(corpus.build(df, "source", ["k"], limit=1), "k") == [(5,)]
    assert corpus.build(df.limit(0), "source", ["k"]).count() == 0


def test_ranks_of_null_groups_and_null_values(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 1.0), (None, 3.0), ("x", 5.0), ("x", None)], "g string, v double")
    got = sorted(map(str, ((r["g"], r["v"], r["r"]) for r in metrics.average_ranks(df, ["g"], "v", "r").collect())))
    assert got == sorted(map(str, [(None, 1.0, 1.5), (None, 1.0, 1.5), (None, 3.0, 3.0), ("x", 5.0, 1.0), ("x", None, None)]))


def test_batches_of_choices(spark):
    df = spark.createDataFrame([(("t" if i else None), i, [i], (i, 2 * i)) for i in range(5)], "task string, i int, c array<int>, idx struct<a: int, b: int>")
    got = {(r["task"], r["number"]): (r["n"], r["c"], r["idx"]) for r in tasks.collated(df, "task", "i", ["c"], "idx", 3).collect()}
    assert got == {(None, 0): (1, [[0]], [[0, 0]]), ("t", 0): (3, [[1], [2], [3]], [[1, 2], [2, 4], [3, 6]]), ("t", 1): (1, [[4]], [[4, 8]])}
