"""Problems 5 and 6: budgets, selections and containers."""

import random

import numpy as np
import pandas as pd
import pytest

from weftline.llm import mixing, packing


def test_fill_respects_weights_and_caps():
    assert mixing.fill(100, np.array([1.0, 1.0]), np.array([1e9, 1e9])).tolist() == [50, 50]
    assert mixing.fill(100, np.array([1.0, 1.0]), np.array([10.0, 1e9])).tolist() == [10, 90]
    assert mixing.fill(100, np.array([0.5, 0.3, 0.2]), np.array([10.0, 20.0, 5.0])).tolist() == [10, 20, 5]
    assert mixing.fill(100, np.array([0.0, 1.0]), np.array([50.0, 60.0])).tolist() == [0, 60]
    r = np.random.default_rng(1)
    for _ in range(200):
        w, c = r.random(6), r.random(6) * 40
        g = mixing.fill(100, w, c)
        assert (g <= c + 1e-9).all() and abs(g.sum() - min(100, c.sum())) < 1e-6
        free = g < c - 1e-9
        if free.sum() > 1:
            ratio = g[free] / w[free]
            assert np.allclose(ratio, ratio[0])


def test_shortage_goes_to_siblings_first():
    leaves = pd.DataFrame(
        [("news", "en", "a", 0.25, 10.0), ("news", "en", "b", 0.25, 1000.0), ("news", "he", "c", 0.25, 1000.0), ("web", "en", "d", 0.25, 1000.0)],
        columns=["domain", "lang", "source_name", "target_share", "capacity"],
    )
    got = dict(zip(leaves["source_name"], mixing.allocate(100.0, leaves).sort_index()))
    assert got == {"a": 10.0, "b": 40.0, "c": 25.0, "d": 25.0}
    leaves.loc[1, "capacity"] = 20.0  # siblings cannot take it all: the other language, not the other domain, does
    got = dict(zip(leaves["source_name"], mixing.allocate(100.0, leaves).sort_index()))
    assert got == {"a": 10.0, "b": 20.0, "c": 45.0, "d": 25.0}


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(8)
    rows = [(i, "x" * r.randint(1, 200), r.choice(["engmix_a-01.jsonl", " ENGMIX_A-01", "hebmix_b-01.jsonl", "codemix_c-01"]), "train", "s", 1) for i in range(3000)]
    rows += [rows[0], (9001, None, "engmix_a-01", "train", "s", 1), (9002, "xx", None, "train", "s", 1), (9003, "xx", "engmix_a-01", "test", "s", 1), (None, "xx", "engmix_a-01", "train", "s", 1)]
    records = spark.createDataFrame(rows, "rec_id bigint, text string, _source string, split string, source string, size int")
    sizes = pd.DataFrame({x[0]: (x[2].strip().lower().removesuffix(".jsonl"), len(x[1])) for x in rows if x[0] is not None and x[1] and x[2] and x[3] == "train"}.values(), columns=["s", "n"]).groupby("s").n.sum()
    catalog = spark.createDataFrame([("engmix_a-01.jsonl", "en", "web"), ("hebmix_b-01.jsonl", "he", None), ("codemix_c-01.jsonl", "code", "github")], "source_name string, lang string, domain string")
    total = int(sizes["engmix_a-01"] * 4)
    targets = [("m", "engmix_a-01.jsonl", 0.5, 4, total), ("m", "hebmix_b-01.jsonl", 0.3, 9, total), ("m", "codemix_c-01.jsonl", 0.2, 1, total), ("m", "absent_x.jsonl", 0.0, 2, total)]
    targets += [("n", "engmix_a-01.jsonl", 1.0, 1, total), ("o", "hebmix_b-01.jsonl", None, None, None), (None, "hebmix_b-01.jsonl", 0.5, 1, 10)]
    return records, spark.createDataFrame(targets, "mix_name string, source_name string, target_share double, max_repeats int, total_chars bigint"), catalog, sizes, total


def test_mix(spark, tables):
    records, targets, catalog, sizes, total = tables
    planned, chosen = mixing.mix(records, targets, catalog)
    shares = {(r["mix_name"], r["source_name"]): r for r in mixing.shares(planned, chosen).collect()}
    assert len(shares) == 6
    a = shares["m", "engmix_a-01.jsonl"]
    assert a["source_size"] == sizes["engmix_a-01"] and not a["short"] and a["most_times"] in (2, 3, 4)
    c = shares["m", "codemix_c-01.jsonl"]
    assert c["short"] == bool(sizes["codemix_c-01"] < 0.2 * total) and c["most_times"] <= 1
    assert shares["n", "engmix_a-01.jsonl"]["used_size"] == sizes["engmix_a-01"] and shares["n", "engmix_a-01.jsonl"]["short"]
    for r in shares.values():
        assert r["planned_size"] - 1e-6 <= r["used_size"] <= r["planned_size"] + 201
        assert r["most_times"] <= r["max_repeats"]
    again = sorted(map(tuple, mixing.choose(mixing.train_records(records), planned).collect()))
    assert again == sorted(map(tuple, chosen.collect()))
    found = {tuple(r) for r in mixing.found(records, targets, catalog).collect()}
    assert found == {k for k, r in shares.items() if r["short"]}
    assert mixing.found(records.limit(0), targets, catalog).count() == 4  # all with a positive target
    assert mixing.found(records, targets.limit(0), catalog).count() == 0


def first_fit_decreasing(lengths, capacity):
    room = []
    for n in sorted(lengths, reverse=True):
        for i, r in enumerate(room):
            if r >= n:
                room[i] -= n
                break
        else:
            room.append(capacity - n)
    return len(room)


def test_patterns_equal_item_by_item_packing():
    r = random.Random(6)
    for _ in range(60):
        capacity = r.choice([20, 64, 100])
        lengths = [r.randint(1, capacity) for _ in range(r.randint(1, 150))]
        plan = packing.Plan(np.bincount(lengths, minlength=capacity + 1), [capacity], [capacity])
        assert plan.bins == first_fit_decreasing(lengths, capacity)


WINDOWS = "window_name string, capacity int, specials_per_item int"


def test_pack(spark):
    r = random.Random(7)
    counts = [(i, r.choice([5, 5, 5, 14, 30, 62, 63, 200, 1000, r.randint(1, 900)])) for i in range(1200)] + [(5000, None), (5001, 0), (None, 7)]
    windows = [("small", 64, 2), ("large", 256, 2), (None, 9, 1), ("none", None, 1)]
    df, w = spark.createDataFrame(counts, "doc_id bigint, n_tokens bigint"), spark.createDataFrame(windows, WINDOWS)
    rows = packing.pack(df, w).toPandas()
    sizes = {i: n for i, n in counts if n and i is not None}
    for plan, capacity in (("small", 64), ("large", 256), ("joint", 256)):
        mine = rows[rows.plan == plan]
        assert mine.groupby("doc_id").tokens.sum().to_dict() == sizes
        pieces = mine.groupby("doc_id").size()
        assert all(pieces[i] == -(-n // (capacity - 2)) for i, n in sizes.items())
        bins = mine.groupby("container").agg(held=("length", "sum"), used=("used", "first"), size=("size", "first"), opened=("opened", "first"))
        assert (bins.held == bins.used).all() and (bins.held <= bins["size"]).all() and (bins["size"] <= bins.opened).all()
        assert bins.opened.isin([64, 256] if plan == "joint" else [capacity]).all()
        assert sorted(bins.index) == list(range(len(bins)))
        assert bins.held.sum() / bins["size"].sum() > 0.95
    usage = packing.usage(packing.pack(df, w)).collect()
    assert sum(u["containers"] for u in usage if u["plan"] == "small") == rows[rows.plan == "small"].container.nunique()


def test_pack_of_nothing_and_bad_windows(spark):
    df, w = spark.createDataFrame([(1, 5)], "doc_id bigint, n_tokens bigint"), spark.createDataFrame([("a", 8, 2)], WINDOWS)
    assert packing.pack(df.limit(0), w).count() == 0 and packing.pack(df, w.limit(0)).count() == 0
    assert packing.pack(df, w).count() == 2  # the window's plan and the joint one
    with pytest.raises(ValueError):
        packing.pack(df, spark.createDataFrame([("a", 2, 2)], WINDOWS))
