"""Crowded buckets: many lightly edited copies of one text, and many texts of one form with other content."""

import random

import pytest

from weftline.llm import neardup, overlap, similar
from weftline.llm.textnorm import words

SCHEMA = "rec_id bigint, text string, split string"


@pytest.fixture(scope="module")
def crowd():
    r = random.Random(9)
    word = lambda: "w%d" % r.randrange(3000)
    copied, form = [word() for _ in range(90)], [word() for _ in range(60)]
    rows = []
    for _ in range(260):
        w = list(copied)
        for _ in range(r.randrange(5)):
            w[r.randrange(len(w))] = word()
        rows.append(w)
    for k in range(260):
        w = form + [word() for _ in range(45)]
        rows.append(w)
        if k % 20 == 0:  # a near copy of a letter
            rows.append(w[:-2] + [word(), word()])
    rows += [[word() for _ in range(60)] for _ in range(40)]
    r.shuffle(rows)
    return [(i, " ".join(w), r.choice(["train", "train", "test"])) for i, w in enumerate(rows)]


@pytest.fixture(scope="module")
def near(crowd):
    sets = [set(zip(w, w[1:], w[2:])) for w in (words(t) for _, t, _ in crowd)]
    return {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6}


def test_crowded_groups(spark, crowd, near, monkeypatch):
    met = []
    original = similar.prefix_pairs

    def counted(*args):
        pairs = original(*args)
        met.append(pairs.count())
        return pairs

    monkeypatch.setattr(neardup, "prefix_pairs", counted)
    root = list(range(len(crowd)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in near:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    members = {}
    for i in range(len(crowd)):
        members.setdefault(find(i), []).append(i)
    expected = {(g, i) for g, m in members.items() if len(m) > 1 for i in m}
    got = {tuple(x) for x in neardup.groups(spark.createDataFrame(crowd, SCHEMA), most_together=100).collect()}
    assert got == expected
    assert met and met[0] < 5000  # the letters alone would be 35,000 pairs


def test_crowded_overlap(spark, crowd, near):
    side = {i: s for i, _, s in crowd}
    expected = {(a, b) for a, b in near if side[a] != side[b]}
    got = {tuple(x) for x in overlap.found(spark.createDataFrame(crowd, SCHEMA), most_together=100).collect()}
    assert got == expected


def test_overlap_of_texts_that_share_no_block(spark, crowd, near, monkeypatch):
    side = {i: s for i, _, s in crowd}
    monkeypatch.setattr(overlap, "blocks", lambda: overlap.F.array(overlap.F.hash("id")))
    got = {tuple(x) for x in overlap.found(spark.createDataFrame(crowd, SCHEMA), exhaustive=True).collect()}
    assert got == {(a, b) for a, b in near if side[a] != side[b]}


def test_prefixes_meet_every_near_pair(spark, crowd, near):
    sets = spark.createDataFrame([(i, sorted({hash(x) % (1 << 31) for x in zip(w, w[1:], w[2:])})) for i, w in ((i, words(t)) for i, t, _ in crowd)], "id bigint, runs array<int>")
    ids = sets.select("id")
    met = {tuple(x) for x in similar.prefix_pairs(sets, ids, ids).collect()}
    assert near <= met
