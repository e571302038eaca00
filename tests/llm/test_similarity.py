"""Problems 3 and 4 against brute force, and their edge cases."""

import random

import numpy as np
import pytest

from weftline.llm import neardup, overlap, similar
from weftline.llm.textnorm import Batch, WordHashes, set_key, words

SCHEMA = "rec_id bigint, text string, _source string, split string, is_eval string, runs string, f0 int"


def runs_of(text):
    w = words(text)
    return set(zip(w, w[1:], w[2:]))


def near(a, b):
    x, y = runs_of(a), runs_of(b)
    return min(len(x), len(y)) >= 20 and len(x & y) / len(x | y) >= 0.6


@pytest.fixture(scope="module")
def records():
    r = random.Random(3)
    vocabulary = ["w%d" % i for i in range(400)]
    rows, n = [], 0
    for _ in range(60):
        base = [r.choice(vocabulary) for _ in range(r.randint(25, 120))]
        for copy in range(r.randint(1, 5)):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 3, 9])):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            if r.random() < 0.2:
                k = r.randrange(len(w))
                w[k:k] = [r.choice(vocabulary) for _ in range(5)]
            text = " ".join(w) if r.random() < 0.7 else ", ".join(w).upper()
            rows.append((n, text, "s", r.choice(["train", "train", "validation", "test", None]), "x", "y", 1))
            n += 1
    rows.append(rows[0])  # delivered twice
    rows += [(n, None, None, "train", None, None, None), (n + 1, "", "s", "test", "", "", 0), (n + 2, "a short text", "s", "train", "", "", 0), (None, rows[0][1], "s", "train", "", "", 0)]
    rows += [(n + 3, "long " * 3 + " ".join("v%d" % i for i in range(60_000)), "s", "train", "", "", 0), (n + 4, " ".join("v%d" % i for i in range(60_000)), "s", "test", "", "", 0)]
    return rows


@pytest.fixture(scope="module")
def truth(records):
    one = {x[0]: x for x in records if x[0] is not None and x[1]}
    ids = sorted(one)
    sets = {i: runs_of(one[i][1]) for i in ids}
    pairs = set()
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) >= 20 and len(x & y) / len(x | y) >= 0.6:
                pairs.add((a, b))
    return one, pairs


def test_groups_against_brute_force(spark, records, truth):
    one, pairs = truth
    root = {i: i for i in one}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    members = {}
    for i in one:
        members.setdefault(find(i), []).append(i)
    expected = {(g, i) for g, m in members.items() if len(m) > 1 for i in m}
    got = [tuple(r) for r in neardup.groups(spark.createDataFrame(records, SCHEMA)).collect()]
    assert len(got) == len(set(got)) and set(got) == expected


def test_cross_split_pairs_against_brute_force(spark, records, truth):
    one, pairs = truth
    evals = ("validation", "test")
    expected = {(a, b) for a, b in pairs if {one[a][3] in evals, one[b][3] in evals} == {True, False} and "train" in (one[a][3], one[b][3])}
    got = [tuple(r) for r in overlap.found(spark.createDataFrame(records, SCHEMA)).collect()]
    assert len(got) == len(set(got))
    assert set(got) <= expected and len(set(got)) >= 0.98 * len(expected)
    report = overlap.report(spark.createDataFrame(records, SCHEMA)).collect()
    assert sum(r["pairs"] for r in report) == len(got)


def test_report_counts_classes_like_pairs(spark):
    text = " ".join(f"w{i}" for i in range(40))
    near_text = text.replace("w39", "x39")
    rows = [(1, text, "a", "train"), (1, text, "a", "test"), (2, text, "A.jsonl", "train"), (3, near_text, None, "train"), (4, text, "b", "validation"), (5, text, "b", "validation"), (6, "short", "b", "test"), (7, text, "a", None)]
    df = spark.createDataFrame(rows, "rec_id bigint, text string, _source string, split string")
    got = {(r["split"], r["source"]): (r["records"], r["overlapping"], r["pairs"], r["with_equal_text"]) for r in overlap.report(df).collect()}
    # Record 1 stands in both splits and does not overlap with itself.
    assert got == {("test", "a.jsonl"): (1, 1, 2, 1), ("validation", "b.jsonl"): (2, 2, 6, 2), ("test", "b.jsonl"): (1, 0, 0, 0)}
    assert overlap.overlap_pairs(df).count() == 8


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert neardup.groups(none).count() == 0 and overlap.found(none).count() == 0 and overlap.report(none).count() == 0


def test_circulant_signature_estimates_similarity():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    a, b = np.sort(base[:300]), np.sort(base[100:])
    values, offsets = np.concatenate([a, b]), np.array([0, 300, 600])
    sig = neardup.signature(values, offsets, 1024)
    assert abs((sig[0] == sig[1]).mean() - 0.5) < 0.06  # 200 of 400 in common
    # Coordinate k is the least pi(sigma(x) + k): the same permutation, shifted.
    with np.errstate(over="ignore"):
        assert sig[0][7] == neardup.pi(neardup.sigma(a) + np.uint64(7)).min()


def test_set_keys_and_fingerprints_are_those_of_the_runs():
    h = WordHashes()
    batch = Batch(["a b c d e", "c d e x a b c d e"[10:] + "", "e d c b a", "a b c d e"], h)
    values, offsets = batch.distinct_runs(3)
    keys = set_key(values, offsets)
    assert keys[0] == keys[3] and keys[0] != keys[2]
    bits = overlap.fingerprints(batch)
    assert (bits[0] == bits[3]).all() and (bits[0] != bits[2]).any() and bits.shape == (4, overlap.BITS)


def test_fingerprints_meet_as_often_as_stated():
    """Pairs of similarity 0.62: segments agree with s^3, bits differ with (1 - s) / 2."""
    rng, met, apart = np.random.default_rng(8), 0, []
    for _ in range(150):
        base = rng.integers(0, 2**63, 123, dtype=np.uint64)
        values, offsets = np.concatenate([np.sort(base[:100]), np.sort(base[23:])]), np.array([0, 100, 200])
        extra = [x.to_numpy() for x in overlap._extra_of(None, values, offsets)]
        packed, lanes = np.array(extra[: len(overlap.CODES)]).view(np.uint64), np.array(extra[len(overlap.CODES) :]).view(np.uint64)
        segments = np.concatenate([packed & np.uint64(0xFFFFFFFF), packed >> np.uint64(32)])
        met += int((segments[:, 0] == segments[:, 1]).sum())
        apart.append(sum(int(x).bit_count() for x in lanes[:, 0] ^ lanes[:, 1]))
    s = 77 / 123
    assert abs(met / (150 * overlap.TABLES) - s**3) < 0.04
    assert abs(np.mean(apart) - overlap.BITS * (1 - s) / 2) < 2 and max(apart) <= overlap.RADIUS


@pytest.mark.parametrize("module, query", [(overlap, overlap.found), (overlap, overlap.report), (neardup, neardup.groups)])
def test_no_exploded_side_is_broadcast(spark, records, monkeypatch, module, query):
    plans, write = [], similar.materialise

    def kept(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, label)

    for m in (module, similar):
        monkeypatch.setattr(m, "materialise", kept)
    last = query(spark.createDataFrame(records, SCHEMA))
    plans.append(last._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 3
    for plan in plans:
        depth = lambda line: len(line) - len(line.lstrip(" :+-|"))
        lines = plan.split("\n")
        for i, line in enumerate(lines):
            if "BroadcastExchange" in line:
                below = []
                for x in lines[i + 1 :]:
                    if depth(x) <= depth(line):
                        break
                    below.append(x)
                assert not any("Generate" in x for x in below), plan


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = {r["id"]: r["component"] for r in similar.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[k] == 100 for k in range(100, 140))
