"""Retrieval through cells against the exact search."""

import numpy as np
import pytest

from weftline.operators import index, metrics


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(30, 16))
    data = centers[rng.integers(0, 30, 3000)] + 0.25 * rng.normal(size=(3000, 16))
    data /= np.linalg.norm(data, axis=1, keepdims=True)
    rows = [(i, [float(x) for x in v], "clash") for i, v in enumerate(data)]
    return spark.createDataFrame([*rows, (3000, None, "x"), (None, rows[0][1], "x")], "vec_id bigint, embedding array<float>, cell string")


def test_recall_and_all_cells(spark, vectors):
    q = vectors.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    cells = index.build(vectors, "vec_id", "embedding", 24, sample=1000)
    assert cells.rows.count() == 3000 and len(cells.centroids) == 24
    exact = metrics.search(vectors.where("vec_id is not null"), q, 10)
    assert index.recall(index.search(cells, q, 10, 6), exact) >= 0.9
    every = index.search(cells, q, 10, 24)
    assert sorted(map(tuple, every.select("query_id", "vec_id", "rank").collect())) == sorted(map(tuple, exact.select("query_id", "vec_id", "rank").collect()))


def test_nothing_to_index(spark, vectors):
    cells = index.build(vectors.limit(0), "vec_id", "embedding", 4)
    assert index.search(cells, vectors.withColumnRenamed("vec_id", "query_id"), 3, 2).count() == 0
    one = index.build(vectors.where("vec_id = 5"), "vec_id", "embedding", 4)
    assert [r["vec_id"] for r in index.search(one, vectors.where("vec_id = 7").withColumnRenamed("vec_id", "query_id"), 3, 2).collect()] == [5]


def test_late_interaction_of_all_cells_is_exact(spark, vectors):
    rows = vectors.where("vec_id < 600").selectExpr("vec_id div 6 as doc_id", "vec_id % 6 as token", "embedding as vector")
    asked = vectors.where("vec_id >= 2960 and embedding is not null").selectExpr("vec_id div 4 as query_id", "vec_id % 4 as token", "embedding as vector")
    exact = {(r["query_id"], r["doc_id"]): round(r["score"], 6) for r in metrics.maxsim(asked.drop("token"), rows.drop("token")).collect()}
    got = {(r["query_id"], r["doc_id"]): round(r["score"], 6) for r in index.late_interaction(rows, asked, 10, 10).collect()}
    assert got == exact
    few = {(r["query_id"], r["doc_id"]): round(r["score"], 6) for r in index.late_interaction(rows, asked, 10, 5, candidates=40).collect()}
    best = {q: max((v, d) for (x, d), v in exact.items() if x == q) for q, _ in exact}
    assert all(exact[k] == v for k, v in few.items()) and sum((q, d) in few for q, (_, d) in best.items()) >= 0.9 * len(best)
    assert index.late_interaction(rows.limit(0), asked, 4, 2).count() == 0
