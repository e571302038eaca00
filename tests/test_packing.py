"""Online packing against known batches, and the statistics of masking."""

import numpy as np
import pytest

from weftline.operators.packing import PackConfig, concat_nowrap, mask_tokens, pack_best_fit, pack_stream, split_packed

# Lengths of sequences 0 to 25 (each made of its own number) and the batches they give.
LENGTHS = [4, 5, 10, 3, 6, 6, 7, 3, 2, 0, 7, 4, 4, 8, 3, 7, 7, 8, 1, 4, 10, 4, 8, 2, 10, 7]
SEQUENCES = [np.full(n, i) for i, n in enumerate(LENGTHS)]
EXPECTED_IDS = [
    [
        [0, 0, 0, 0, 1, 1, 1, 1, 1, 4, 4, 4, 4, 4, 4],
        [2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 3, 3, 3, 8, 8],
        [5, 5, 5, 5, 5, 5, 6, 6, 6, 6, 6, 6, 6, -1, -1],
        [7, 7, 7, 10, 10, 10, 10, 10, 10, 10, 11, 11, 11, 11, 18],
        [12, 12, 12, 12, 13, 13, 13, 13, 13, 13, 13, 13, 14, 14, 14],
    ],
    [
        [19, 19, 19, 19, 17, 17, 17, 17, 17, 17, 17, 17, 23, 23, -1],
        [16, 16, 16, 16, 16, 16, 16, 15, 15, 15, 15, 15, 15, 15, -1],
        [20, 20, 20, 20, 20, 20, 20, 20, 20, 20, 21, 21, 21, 21, -1],
        [22, 22, 22, 22, 22, 22, 22, 22, 25, 25, 25, 25, 25, 25, 25],
        [24, 24, 24, 24, 24, 24, 24, 24, 24, 24, -1, -1, -1, -1, -1],
    ],
]
EXPECTED_BOUNDS = [
    [[0, 4, 9, 15], [0, 10, 13, 15], [0, 6, 13, 15], [0, 3, 10, 14, 15], [0, 4, 12, 15]],
    [[0, 4, 12, 14, 15], [0, 7, 14, 15], [0, 10, 14, 15], [0, 8, 15], [0, 10, 15]],
]
EXPECTED_LONGEST = [[6, 10, 7, 7, 8], [8, 7, 10, 8, 10]]
MASKED_IDS = [
    [
        [0, 4, 0, 0, -2, 1, 1, 1, -2, 4, -2, 4, 4, 4, 6],
        [-2, 2, -2, 2, 2, 2, -2, 2, 2, 2, -2, 3, -2, -2, 8],
        [5, 5, -2, -2, 5, -2, -2, 6, -2, 6, 10, 6, 6, -2, -1],
        [7, -2, -2, 10, -2, -2, -2, 10, 10, 10, 11, 11, 11, -2, -2],
        [12, 12, 12, 12, 13, 13, 13, -2, -2, 13, -2, 6, 14, -2, -2],
    ],
    [
        [19, -2, 19, 19, 17, 0, 17, 17, 17, -2, 3, -2, 23, -2, -2],
        [-2, 16, -2, 16, 16, -2, 16, -2, 15, 15, 15, -2, 15, 15, -1],
        [20, 20, -2, -2, 20, 4, -2, 20, 20, -2, 21, -2, 21, -2, -1],
        [22, 22, -2, 22, -2, -2, 22, -2, 25, 25, -2, 25, -2, 25, -2],
        [24, -2, -2, 2, 24, 24, 24, 24, 24, 24, -2, -1, -1, -2, -2],
    ],
]
MASKED_LABELS = [
    [
        [-3, 0, -3, -3, 1, -3, -3, -3, 1, 4, 4, -3, -3, -3, 4],
        [2, -3, 2, -3, -3, -3, 2, -3, -3, -3, 3, 3, 3, 8, -3],
        [-3, -3, 5, 5, 5, 5, 6, 6, 6, -3, 6, -3, -3, -3, -3],
        [-3, 7, 7, -3, 10, 10, 10, -3, -3, -3, -3, 11, -3, 11, 18],
        [-3, 12, -3, -3, -3, -3, -3, 13, 13, 13, 13, 13, -3, 14, 14],
    ],
    [
        [-3, 19, -3, -3, -3, 17, -3, -3, -3, 17, 17, 17, 23, 23, -3],
        [16, -3, 16, -3, -3, 16, -3, 15, -3, 15, -3, 15, 15, 15, -3],
        [-3, 20, 20, 20, -3, 20, 20, -3, -3, 20, -3, 21, -3, 21, -3],
        [-3, -3, 22, -3, 22, 22, -3, 22, -3, -3, 25, -3, 25, -3, 25],
        [-3, 24, 24, 24, -3, -3, -3, -3, -3, -3, -3, -3, -3, -3, -3],
    ],
]


def config(**more):
    return PackConfig(source_batch=4, bins=5, width=15, buffer_size=5, pad=-1, mask=-2, ignore=-3, **more)


def column(batches, name):
    return [[np.asarray(r[name]).tolist() for r in b] for b in batches]


def test_unmasked_batches():
    got = list(pack_stream(iter(SEQUENCES), config(masking=False)))
    assert column(got, "input_ids") == EXPECTED_IDS
    assert column(got, "cu_seqlens") == EXPECTED_BOUNDS
    assert column(got, "max_seqlen") == EXPECTED_LONGEST
    assert all(r["labels"] is None for b in got for r in b)


def test_nothing_masked_at_rate_zero():
    got = list(pack_stream(iter(SEQUENCES), config(mask_prob=0.0)))
    assert column(got, "input_ids") == EXPECTED_IDS
    assert all(x == -3 for b in column(got, "labels") for r in b for x in r)
    assert column(got, "attention_mask") == [[[int(x != -1) for x in r] for r in b] for b in EXPECTED_IDS]


def test_masked_batches_of_seed_42():
    got = list(pack_stream(iter(SEQUENCES), config(mask_prob=0.5, seed=42)))
    assert column(got, "input_ids") == MASKED_IDS
    assert column(got, "labels") == MASKED_LABELS
    assert column(list(pack_stream(iter(SEQUENCES), config(mask_prob=0.5, seed=43))), "input_ids") != MASKED_IDS


def test_partial_last_batch_is_kept_on_request():
    got = list(pack_stream(iter(SEQUENCES), config(masking=False, drop_last=False)))
    assert column(got, "input_ids")[:2] == EXPECTED_IDS
    kept = sorted(x for b in got for r in b for x in np.asarray(r["input_ids"]) if x >= 0)
    assert kept == sorted(x for s in SEQUENCES for x in s)


@pytest.mark.parametrize("drop_last", [False, True])
def test_no_token_of_overlong_sequences_is_lost(drop_last):
    c = PackConfig(source_batch=16, bins=8, width=10, buffer_size=128, masking=False, drop_last=drop_last)
    sequences = np.split(np.arange(150 * 25 + 400 * 3), [*range(25, 150 * 25 + 1, 25), *range(150 * 25 + 3, 150 * 25 + 400 * 3, 3)])
    batches = list(pack_stream(iter(sequences), c))
    got = sorted(x for b in batches for r in b for x in r["input_ids"] if x >= 0)
    if drop_last:  # only the batch at the end may be lost
        assert all(len(b) == c.bins for b in batches) and 0 <= 4950 - len(got) < c.bins * c.width
    else:
        assert got == list(range(4950))
    parts = [len(x) for b in batches for r in b for x in np.split(r["input_ids"], r["cu_seqlens"][1:-1]) if x[0] >= 0]
    assert max(parts) == c.width


def test_buffer_that_reads_nothing_is_refused():
    with pytest.raises(ValueError):
        next(pack_stream(iter(SEQUENCES), PackConfig(source_batch=5, bins=5, width=15, buffer_size=5)))


@pytest.mark.parametrize("rate", [0.1, 0.15, 0.3, 0.5])
def test_masking_statistics(rate):
    ids = np.arange(100_000)
    c = PackConfig(1, 1, 1, 1, mask=-1, ignore=-100, mask_prob=rate)
    masked, labels = mask_tokens(ids, c, np.random.default_rng(1))
    chosen = labels != -100
    assert abs(chosen.mean() - rate) < 0.01
    assert abs((masked[chosen] == -1).mean() - 0.8) < 0.01
    assert abs((masked[chosen] == ids[chosen]).mean() - 0.1) < 0.01
    assert (masked[~chosen] == ids[~chosen]).all() and (labels[chosen] == ids[chosen]).all()


def test_packing_by_shard(spark):
    rows = [(s, i, x.tolist()) for s in (0, 1) for i, x in enumerate(SEQUENCES)] + [(1, 99, None)]
    df = spark.createDataFrame(rows, "shard int, k int, ids array<bigint>")
    got = pack_best_fit(df, "shard", "k", "ids", config(masking=False)).orderBy("shard", "batch", "pseq").collect()
    assert [r["input_ids"] for r in got] == [r for b in EXPECTED_IDS for r in b] * 2
    micro = split_packed(pack_best_fit(df, "shard", "k", "ids", config(mask_prob=0.0)), 3, 0.2).where("shard = 0").orderBy("batch", "pseq").collect()
    last = micro[-1]
    assert last["input_ids"] == [24] * 10 and last["cu_seqlens"] == [0, 10] and last["attention_mask"] == [1] * 10 and last["micro"] == 1
    assert [len(r["input_ids"]) for r in micro[:-1]] == [15] * 9


def test_nowrap_discards_the_rest(spark):
    df = spark.createDataFrame([(0, 0, [1, 2]), (0, 1, [3, 4, 5]), (0, 2, []), (0, 3, None), (0, 4, [6, 7, 8, 9]), (0, 5, [1])], "s int, k int, ids array<int>")
    assert [r["input_ids"] for r in concat_nowrap(df, "s", "k", "ids", 4).orderBy("chunk").collect()] == [[1, 2, 3, 4], [6, 7, 8, 9]]
    assert concat_nowrap(df.limit(0), "s", "k", "ids", 4).count() == 0


def test_geometry():
    c = PackConfig.from_batch(512, 32, 1024, 5120, 32)
    assert (c.bins, c.width) == (16, 32 * 1024)
    with pytest.raises(ValueError):
        PackConfig.from_batch(10, 3, 8, 5, 1)
