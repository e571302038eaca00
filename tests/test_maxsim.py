"""Late-interaction scores against brute force: every vector of every document counts."""

from pathlib import Path

import numpy as np
import pytest

from weftline import registry
from weftline.operators.metrics import maxsim

DATA = Path("/root/testdata/sf0.001")


def test_operator_in_small_blocks(spark):
    rng = np.random.default_rng(3)
    q = [(f"q{i % 5}", rng.normal(size=4).tolist()) for i in range(23)]
    docs = [(i % 17, rng.normal(size=4).tolist()) for i in range(300)]
    want = {}
    for a, x in q:
        for doc in range(17):
            want[a, doc] = want.get((a, doc), 0) + max(np.dot(x, y) for k, y in docs if k == doc)
    left = spark.createDataFrame([*q, ("q0", None), (None, [1.0] * 4)], "query_id string, vector array<double>")
    right = spark.createDataFrame([*docs, (3, None), (None, [9.0] * 4)], "doc_id int, vector array<double>")
    for more in ({}, {"block_bytes": 400, "most_held": 30}):
        got = {(r["query_id"], r["doc_id"]): r["score"] for r in maxsim(left, right, **more).collect()}
        assert got == pytest.approx(want)
    pairs = spark.createDataFrame([("q1", 2), ("q4", 16), ("q9", 1)], "query_id string, doc_id int")
    assert {(r["query_id"], r["doc_id"]): r["score"] for r in maxsim(left, right, pairs).collect()} == pytest.approx({k: want[k] for k in (("q1", 2), ("q4", 16))})
    assert maxsim(left.limit(0), right).count() == 0 and maxsim(left, right.limit(0)).count() == 0


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
def test_every_vector_and_label_takes_part(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "label", "embedding").collect()
    e = np.array([r["embedding"] for r in rows], np.float64)
    label, query = np.array([r["label"] for r in rows]), np.array([r["vec_id"] // 20 * 20 for r in rows])
    dots = e @ e.T
    want = {(q, x): dots[query == q][:, label == x].max(1).sum() for q in set(query.tolist()) for x in set(label.tolist())}
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in registry.queries()["maxsim_exact"](spark, str(DATA)).collect()}
    assert got == pytest.approx(want, abs=2e-6)
