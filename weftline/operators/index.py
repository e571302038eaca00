"""Vector retrieval through an index: cells around centroids, searched cell by cell.

Centroids are fitted by k-means on a bounded sample; every row is put in its nearest cell
and the index is a table partitioned by cell. A query is held against its nearest cells
only; how many of the exact neighbours that finds is measured by recall.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..plans.shared import BROADCAST_BYTES, byte_size, materialise

SAMPLE = 50_000  # rows that the centroids are fitted on, chosen by hash of their key
ROUNDS, SEED = 12, 7


@dataclass
class CellIndex:
    """rows: key, vector, cell of every row; centroids: cells x dimensions."""

    rows: DataFrame
    centroids: np.ndarray


def kmeans(data: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """Centroids by Lloyd's rounds from a spread-out start; an empty cell takes the row farthest from its centroid."""
    rng = np.random.default_rng(seed)
    cells = max(1, min(cells, len(data)))
    centroids, far = [data[rng.integers(len(data))]], np.full(len(data), np.inf)
    for _ in range(1, cells):
        far = np.minimum(far, ((data - centroids[-1]) ** 2).sum(1))
        weight = far.sum()
        centroids.append(data[rng.choice(len(data), p=far / weight) if weight > 0 else rng.integers(len(data))])
    centers = np.array(centroids, np.float64)
    for _ in range(rounds):
        cell = nearest(data, centers, 1)[:, 0]
        n = np.bincount(cell, minlength=cells)
        sums = np.zeros_like(centers)
        np.add.at(sums, cell, data)
        centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centers)
        if (n == 0).any():
            gap = ((data - centers[cell]) ** 2).sum(1)
            centers[n == 0] = data[np.argsort(-gap)[: int((n == 0).sum())]]
    return centers


def nearest(data: np.ndarray, centers: np.ndarray, count: int) -> np.ndarray:
    """The count nearest centroids of each row, nearest first, ties to the smaller number."""
    distance = (centers**2).sum(1)[None, :] - 2 * data @ centers.T
    return np.argsort(distance, axis=1, kind="stable")[:, :count]


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def _with_cells(df: DataFrame, key: str, vector: str, centroids: np.ndarray, count: int) -> DataFrame:
    """key, vector and its count nearest cells, a row for each."""
    shared = df.sparkSession.sparkContext.broadcast(centroids)  # cells x dimensions numbers
    schema = T.StructType([df.schema[key], df.schema[vector], T.StructField("cells", T.ArrayType(T.IntegerType()))])
    target = to_arrow_schema(schema)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = nearest(_matrix(batch.column(1), batch.num_rows), shared.value, count).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * cells.shape[1]), pa.array(cells.ravel()))
                yield pa.RecordBatch.from_arrays([c.cast(t.type) for c, t in zip([batch.column(0), batch.column(1), lists], target)], schema=target)

    return df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(key, vector).mapInArrow(go, schema).select(key, vector, F.explode("cells").alias("cell"))


def build(vectors: DataFrame, key: str, vector: str, cells: int, sample: int = SAMPLE) -> CellIndex:
    """The index of all rows. Centroids are fitted on at most sample rows, the first by hash of the key; null keys and vectors are not indexed."""
    held = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull())
    some = held.orderBy(F.xxhash64(key), key).limit(sample).select(vector).collect()
    if not some:
        return CellIndex(materialise(held.select(key, vector, F.lit(0).alias("cell")), "cells"), np.zeros((0, 0)))
    centroids = kmeans(np.array([r[0] for r in some], np.float64), cells)
    return CellIndex(materialise(_with_cells(vectors, key, vector, centroids, 1), "cells"), centroids)


def search(index: CellIndex, queries: DataFrame, k: int, probes: int, key: str = "vec_id", vector: str = "embedding", query_key: str = "query_id", salts: int = 16) -> DataFrame:
    """query_id, vec_id, score, rank: of each query's probes nearest cells the k rows with the largest dot product.

    Rows meet the queries of their cell by a join on the cell: a cell's rows are spread over
    salts tasks, its queries go to each of them, and a task hands on only the k best of a
    query, so a cell that holds a third of the rows is no hot spot. Ties go to the smaller key.
    """
    spark = queries.sparkSession
    out = T.StructType([T.StructField(query_key, T.LongType()), T.StructField(key, T.LongType()), T.StructField("score", T.DoubleType())])
    if not len(index.centroids):
        return spark.createDataFrame([], out).withColumn("rank", F.lit(1))
    target = to_arrow_schema(out)
    asked = _with_cells(queries, query_key, vector, index.centroids, probes)
    asked = asked.select("cell", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.col(query_key).cast("long").alias("id"), F.col(vector).alias("v"), F.lit(True).alias("asks"))
    rows = index.rows.select("cell", F.pmod(F.xxhash64(key), F.lit(salts)).cast("int").alias("salt"), F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), F.lit(False).alias("asks"))
    both = rows.unionByName(asked).repartition("cell", "salt").sortWithinPartitions("cell", "salt", F.desc("asks"))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix, best, place = [], [], None, None  # queries of the present cell, and their best rows so far

        def ended() -> Iterator[pa.RecordBatch]:
            if best is not None:
                n = best[0].shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(ids, np.int64), n)), pa.array(best[0].ravel()), pa.array(best[1].ravel())], schema=target)

        for batch in batches:
            if not batch.num_rows:
                continue
            places = batch.column(0).to_numpy().astype(np.int64) * salts + batch.column(1).to_numpy()
            asks = batch.column(4).to_numpy(zero_copy_only=False)
            names, values = batch.column(2).to_numpy(), _matrix(batch.column(3), batch.num_rows)
            edges = np.flatnonzero(np.r_[True, places[1:] != places[:-1]])
            for a, b in zip(edges, np.r_[edges[1:], batch.num_rows]):
                if places[a] != place:
                    yield from ended()
                    ids, matrix, best, place = [], [], None, places[a]
                new = asks[a:b]
                ids += names[a:b][new].tolist()
                matrix += list(values[a:b][new])
                if ids and (~new).any():
                    score = np.array(matrix) @ values[a:b][~new].T
                    held = np.broadcast_to(names[a:b][~new], score.shape)
                    if best is not None:
                        held, score = np.concatenate([best[0], held], 1), np.concatenate([best[1], score], 1)
                    order = np.lexsort((held, -np.round(score, 9)), axis=1)[:, :k]
                    best = np.take_along_axis(held, order, 1), np.take_along_axis(score, order, 1)
        yield from ended()

    found = both.select("cell", "salt", "id", "v", "asks").mapInArrow(go, out)
    order = Window.partitionBy(query_key).orderBy(F.desc(F.round("score", 9)), key)  # k rows of every probed cell and salt
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame, query_key: str = "query_id", key: str = "vec_id") -> float:
    """Share of the exact neighbours that were found."""
    total = exact.count()
    return found.join(exact.select(query_key, key), [query_key, key], "left_semi").count() / total if total else 1.0


def late_interaction(doc_tokens: DataFrame, query_tokens: DataFrame, cells: int, probes: int, candidates: int = 8192, most_doc_tokens: int = 300, sample: int = SAMPLE) -> DataFrame:
    """query_id, doc_id, score: documents that have a token in a cell near one of the query's tokens, scored exactly by MaxSim.

    doc_tokens: doc_id, token, vector (of a document the first most_doc_tokens by token are
    indexed); query_tokens: query_id, token, vector. A query's candidates are the documents
    with the best sum, over its tokens, of the closest cell's score; the first candidates
    of them are scored with all their tokens.
    """
    kept = doc_tokens.where(F.col("token") < most_doc_tokens).select("doc_id", "vector")
    some = kept.where("doc_id is not null and vector is not null").orderBy(F.xxhash64("doc_id", F.to_json(F.struct("vector")))).limit(sample).select("vector").collect()
    if not some:
        return doc_tokens.sparkSession.createDataFrame([], "query_id bigint, doc_id bigint, score double")
    centroids = kmeans(np.array([r[0] for r in some], np.float64), cells)
    docs = materialise(_with_cells(kept, "doc_id", "vector", centroids, 1).select("doc_id", "cell").distinct(), "doccells")
    asked = _with_cells(query_tokens.withColumn("__q", F.struct("query_id", "token")), "__q", "vector", centroids, probes)
    near = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centroids])
    score = F.aggregate(F.zip_with(F.col("vector"), F.get(near, F.col("cell")), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    asked = asked.select("__q.query_id", "__q.token", "cell", score.alias("s"))
    met = docs.join(asked.hint("merge"), "cell").groupBy("query_id", "token", "doc_id").agg(F.max("s").alias("s")).groupBy("query_id", "doc_id").agg(F.sum("s").alias("s"))
    order = Window.partitionBy("query_id").orderBy(F.desc("s"), "doc_id")
    pairs = met.withColumn("r", F.row_number().over(order)).where(F.col("r") <= candidates).select("query_id", "doc_id")
    return score_pairs(pairs, query_tokens, kept)


def score_pairs(pairs: DataFrame, query_tokens: DataFrame, doc_tokens: DataFrame, block_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """query_id, doc_id, score: MaxSim of the given pairs only. The queries, a stated set, are sent in blocks of at most block_bytes."""
    spark = pairs.sparkSession
    queries = query_tokens.where("query_id is not null and vector is not null").select("query_id", "vector")
    schema = T.StructType([pairs.schema["query_id"], pairs.schema["doc_id"], T.StructField("token", T.LongType()), T.StructField("best", T.DoubleType())])
    target = to_arrow_schema(schema)
    rows = materialise(pairs.join(doc_tokens.where("vector is not null").hint("merge"), "doc_id").select("query_id", "doc_id", "vector"), "candidates")
    blocks = max(1, -(-byte_size(queries.select("query_id", F.to_json(F.struct("vector")).alias("v"))) // block_bytes))
    found = spark.createDataFrame([], schema)
    for b in range(blocks):
        held: dict = {}
        for r in queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toLocalIterator():
            held.setdefault(r[0], []).append(r[1])
        shared = spark.sparkContext.broadcast({q: np.array(v, np.float64) for q, v in held.items()})

        def go(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                names, docs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                values, best = _matrix(batch.column(2), batch.num_rows), {}
                for i, key in enumerate(zip(names, docs)):
                    if key[0] in shared.value:
                        score = shared.value[key[0]] @ values[i]
                        best[key] = np.maximum(best[key], score) if key in best else score
                out = [(q, d, t, float(x)) for (q, d), scores in best.items() for t, x in enumerate(scores)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(target)], schema=target)

        found = found.unionByName(rows.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).mapInArrow(go, schema))
    tops = found.groupBy("query_id", "doc_id", "token").agg(F.max("best").alias("best"))
    return tops.groupBy("query_id", "doc_id").agg(F.sum("best").alias("score"))
