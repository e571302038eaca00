import random

import numpy as np
import pytest

from weftline.operators import driver


def test_merge_and_flatten():
    assert driver.merged({"a": {"x": 1, "y": 2}, "b": 1}, {"a": {"y": 3}}, {"b": {"c": 2}}) == {"a": {"x": 1, "y": 3}, "b": {"c": 2}}
    assert driver.flattened({"a": {"desc": None, "value": 3}, "b": 4, "z": 9}, {"a": 0, "b": 0, "c": 7}) == {"a": 3, "b": 4, "c": 7}


def test_batches_and_vocabulary():
    assert driver.batch_sizes(64, 8, 4) == (8, 4) and driver.batch_sizes(64, 8, "auto") == (8, "auto")
    with pytest.warns(UserWarning):
        assert driver.batch_sizes(64, 8, 16) == (8, 8)
    with pytest.raises(ValueError):
        driver.batch_sizes(65, 8, 1)
    assert [driver.padded_vocabulary(v) for v in (1, 64, 65, 50368)] == [64, 64, 128, 50368]


def test_separators_and_splits():
    with pytest.raises(ValueError):
        driver.check_separators([], [], [])
    with pytest.warns(UserWarning):
        driver.check_separators([1], [2, 3], [1, 9])
    driver.disjoint({"train"}, {"validation"})
    with pytest.raises(ValueError):
        driver.disjoint({"a", "b"}, {"b"})


def test_epoch_indices():
    parts = [driver.epoch_indices(10, 4, r, 7, 2) for r in range(4)]
    assert all(len(p) == 3 for p in parts) and set(np.concatenate(parts)) == set(range(10))
    order = np.random.Generator(np.random.PCG64DXSM(9)).permutation(10)
    assert np.stack(parts, 1).ravel().tolist() == [*order, *order[:2]]
    assert [driver.epoch_indices(10, 4, r, 7, 2, shuffle=False, drop_last=True).tolist() for r in (0, 3)] == [[0, 4], [3, 7]]
    assert len(driver.epoch_indices(0, 4, 0, 7, 0)) == 0 and driver.epoch_indices(2, 5, 4, 0, 0, shuffle=False).tolist() == [0]


def test_drawn_split(spark):
    df = spark.createDataFrame([(s, i) for s in "ab" for i in range(50)], "s string, k int")
    got = {(r["s"], r["k"]): r["split"] for r in driver.draw_split(df, "s", "k", 0.2, {"a": 42, "b": 43}).collect()}
    for s, seed in (("a", 42), ("b", 43)):
        draw = random.Random(seed)
        assert [got[s, i] for i in range(50)] == ["validation" if draw.random() < 0.2 else "train" for _ in range(50)]


def test_pretokenized(spark):
    df = spark.createDataFrame([(1, [5, 6, -7]), (2, []), (3, None)], "k int, input_ids array<bigint>")
    raw = driver.to_bytes(df, "input_ids")
    assert raw.where("k = 1").first()["input_ids"] == np.array([5, 6, -7], "<i8").tobytes()
    got = {r["k"]: r for r in driver.pretokenized(raw, 2).collect()}
    assert got[1]["input_ids"] == [5, 6] and got[1]["attention_mask"] == [1, 1] and got[1]["token_type_ids"] == [0, 0]
    assert got[2]["input_ids"] == [] and got[3]["input_ids"] is None
    with pytest.raises(ValueError):
        driver.pretokenized(df.drop("input_ids"), 2)
