"""Classification, regression and ranking metrics as aggregates; exact vector search."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..plans.ordered import running_total
from ..plans.shared import BROADCAST_BYTES, byte_size


def accuracy(label: Column, pred: Column) -> Column:
    """Share of rows whose prediction equals the label."""
    return F.avg((label == pred).cast("double"))


def f1(label: Column, pred: Column, positive: int = 1) -> Column:
    """Binary F1 of the positive class; null where neither labels nor predictions hold it."""
    tp = F.sum(((label == positive) & (pred == positive)).cast("long"))
    wrong = F.sum(((label == positive) != (pred == positive)).cast("long"))
    return F.try_divide(2 * tp, 2 * tp + wrong)


def mse(label: Column, score: Column) -> Column:
    return F.avg((label - score) * (label - score))


def masked_accuracy(label: Column, pred: Column, ignore: int = -100) -> Column:
    """Accuracy over rows whose label is not ignore."""
    return F.avg(F.when(label != ignore, (label == pred).cast("double")))


def argmax(logits: Column) -> Column:
    """The class (from 0) of the largest logit, the first of equal ones; null for null or empty logits."""
    return F.nullif(F.array_position(logits, F.array_max(logits)), F.lit(0)).cast("int") - 1


def cross_entropy(logits: Column, label: Column, ignore: int = -100) -> Column:
    """Mean cross-entropy of labels under the softmax of logits, over rows whose label is not ignore."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x.cast("double") - top.cast("double")))
    return F.avg(F.when(label != ignore, F.log(total) + top.cast("double") - F.get(logits, label).cast("double")))


def pearson(a: Column, b: Column) -> Column:
    return F.corr(a, b)


def multilabel(df: DataFrame, by: list[str], labels: str, scores: str, threshold: float = 0.5) -> DataFrame:
    """by, accuracy and f1 over all labels of all rows together; labels (0 or 1) and scores are arrays of equal length. Rows are counted in place."""
    hit = F.zip_with(labels, scores, lambda t, p: F.struct((t == 1).alias("t"), (p >= threshold).alias("p")))

    def count(of) -> Column:
        return F.sum(F.size(F.filter(hit, of)))

    both, wrong = count(lambda x: x["t"] & x["p"]), count(lambda x: x["t"] != x["p"])
    return df.groupBy(*by).agg(F.try_divide(F.sum(F.size(labels)) - wrong, F.sum(F.size(labels))).alias("accuracy"), F.try_divide(2 * both, 2 * both + wrong).alias("f1"))


def task_scores(df: DataFrame, task: str, registry: dict[str, list[str]], label: str = "label", pred: str = "pred", score: str = "score") -> DataFrame:
    """task, metric, value: of each task the metrics that the registry names (accuracy, f1, mcc, spearman, macro_f1); tasks it lacks have none."""
    known = df.where(F.col(task).isin(list(registry)))
    plain = known.groupBy(task).agg(accuracy(F.col(label), F.col(pred)).alias("accuracy"), f1(F.col(label), F.col(pred)).alias("f1"))
    parts = [plain, matthews(known, [task], label, pred), macro_f1(known, [task], label, pred).select(task, "macro_f1"), spearman(known.where(F.col(score).isNotNull()), [task], label, score)]
    every = [p.select(task, F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for p in parts for c in p.columns if c != task]
    wanted = [F.when(F.col(task) == t, F.col("metric").isin(names)) for t, names in registry.items()]
    return reduce(DataFrame.unionByName, every).where(F.coalesce(*wanted, F.lit(False)))


def matthews(df: DataFrame, by: list[str], label: str = "label", pred: str = "pred") -> DataFrame:
    """by and mcc: the multiclass correlation coefficient, 0 where it is undefined. Works on confusion counts."""
    cells = df.groupBy(*by, label, pred).agg(F.count("*").alias("n"))
    rows = cells.groupBy(*by, F.col(label).alias("c")).agg(F.sum("n").alias("t"))
    cols = cells.groupBy(*by, F.col(pred).alias("c")).agg(F.sum("n").alias("p"))
    both = rows.join(cols, [*by, "c"], "full").fillna(0, ["t", "p"])
    sums = both.groupBy(*by).agg(F.sum(F.col("t") * F.col("p")).alias("tp"), F.sum(F.col("t") * F.col("t")).alias("tt"), F.sum(F.col("p") * F.col("p")).alias("pp"))
    totals = cells.groupBy(*by).agg(F.sum("n").alias("s"), F.sum(F.when(F.col(label) == F.col(pred), F.col("n")).otherwise(0)).alias("c"))
    j = sums.join(totals, by)
    s = F.col("s").cast("double")
    bottom = F.sqrt((s * s - F.col("pp")) * (s * s - F.col("tt")))
    return j.select(*by, F.coalesce(F.try_divide(F.col("c") * s - F.col("tp"), bottom), F.lit(0.0)).alias("mcc"))


def macro_f1(df: DataFrame, by: list[str], label: str = "label", pred: str = "pred") -> DataFrame:
    """by, accuracy and macro_f1 (mean F1 of the classes seen in labels or predictions)."""
    cells = df.groupBy(*by, label, pred).agg(F.count("*").alias("n"))
    sides = F.explode(F.array(F.struct(F.col(label).alias("c"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col(pred).alias("c"), F.lit(0).alias("t"), F.lit(1).alias("p")))).alias("x")
    flat = cells.select(*by, "n", (F.col(label) == F.col(pred)).cast("long").alias("hit"), sides)
    per = flat.groupBy(*by, F.col("x.c").alias("c")).agg(F.sum(F.col("n") * F.col("hit")).alias("tp2"), F.sum("n").alias("both"))
    # tp is counted on both sides, so tp2 is 2 tp and both is labels plus predictions of the class.
    macro = per.groupBy(*by).agg(F.avg(F.col("tp2") / F.col("both")).alias("macro_f1"))
    acc = cells.groupBy(*by).agg((F.sum(F.when(F.col(label) == F.col(pred), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    return acc.join(macro, by)


def average_ranks(df: DataFrame, by: list[str], value: str, alias: str) -> DataFrame:
    """df with the average rank of value (numeric) within by, nulls in by being a group; rows with a null value have none.

    Ranks come from counts of different values; their running total is taken in slices, so
    a group of many different scores is not ordered in one task.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n"))
    ranks = running_total(counts, value, F.col("__n"), "__upto", by=by)
    ranks = ranks.select(*[F.col(c).alias(f"__r_{c}") for c in [*by, value]], (F.col("__upto") - (F.col("__n") - 1) / 2.0).alias(alias))
    same = [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in by] + [F.col(value) == F.col(f"__r_{value}")]
    return df.join(ranks, same, "left").drop(*[f"__r_{c}" for c in [*by, value]])


def spearman(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """by and spearman: the correlation of average ranks."""
    ranked = average_ranks(average_ranks(df, by, a, "__ra"), by, b, "__rb")
    return ranked.groupBy(*by).agg(F.corr("__ra", "__rb").alias("spearman"))


def auroc(df: DataFrame, by: list[str], label: str, score: str) -> DataFrame:
    """by and auroc of a binary label, by the rank sum of the positives; null where a class is missing."""
    ranked = average_ranks(df, by, score, "__r")
    pos = F.sum(F.col(label).cast("long"))
    neg = F.count("*") - pos
    top = F.sum(F.when(F.col(label) == 1, F.col("__r")).otherwise(0.0)) - pos * (pos + 1) / 2.0
    return ranked.groupBy(*by).agg(F.try_divide(top, (pos * neg).cast("double")).alias("auroc"))


def multirc(df: DataFrame) -> DataFrame:
    """f1_a over all answers and em: share of questions all of whose answers are predicted right."""
    label, pred = F.col("label") == 1, F.col("pred") == 1
    questions = df.groupBy("paragraph", "question").agg(
        F.sum((label & pred).cast("long")).alias("tp"), F.sum((label != pred).cast("long")).alias("wrong"), F.min((F.col("label") == F.col("pred")).cast("int")).alias("right")
    )
    return questions.agg(F.try_divide(2 * F.sum("tp"), 2 * F.sum("tp") + F.sum("wrong")).alias("f1_a"), F.avg("right").alias("em"))


def search(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", query_key: str = "query_id", block_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """query_id, vec_id, score, rank: the k vectors with the largest dot product for each query.

    queries (query_id, vector) are a stated set held against all rows in blocks of at most
    block_bytes. Every task keeps its k best for each query; ties go to the smaller key.
    Null vectors are in no result.
    """
    spark = vectors.sparkSession
    schema = T.StructType([T.StructField(query_key, T.LongType()), T.StructField(key, T.LongType()), T.StructField("score", T.DoubleType())])
    target = to_arrow_schema(schema)
    queries = queries.where(F.col(vector).isNotNull())
    blocks = max(1, -(-byte_size(queries.select(query_key, F.to_json(F.struct(vector)).alias("v"))) // block_bytes))
    found = None
    for b in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64(query_key), F.lit(blocks)) == b).select(query_key, vector).collect()
        if not rows:
            continue
        shared = spark.sparkContext.broadcast((np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64)))

        def go(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, matrix = shared.value
            best: tuple[np.ndarray, np.ndarray] | None = None  # keys and scores, a row for each query
            for batch in batches:
                if not batch.num_rows:
                    continue
                keys = batch.column(0).to_numpy()
                values = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                score = matrix @ values.T
                held = np.broadcast_to(keys, score.shape)
                if best is not None:
                    held, score = np.concatenate([best[0], held], 1), np.concatenate([best[1], score], 1)
                order = np.lexsort((held, -np.round(score, 9)), axis=1)[:, :k]
                best = np.take_along_axis(held, order, 1), np.take_along_axis(score, order, 1)
            if best is not None:
                n = best[0].shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(best[0].ravel()), pa.array(best[1].ravel())], schema=target)

        part = vectors.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias(key), vector).mapInArrow(go, schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], schema)
    order = Window.partitionBy(query_key).orderBy(F.desc(F.round("score", 9)), key)  # k rows of every task for each query
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ndcg(run: DataFrame, relevance: DataFrame, k: int = 10, gain: str = "linear") -> DataFrame:
    """query_id and ndcg at k of a run (query_id, doc_id, rank) against relevance (query_id, doc_id, rel); unjudged documents gain nothing.

    gain: 'linear' (rel) or 'exponential' (2^rel - 1). Queries of the run without relevant documents have 0.
    """
    value = F.col("rel").cast("double") if gain == "linear" else F.pow(F.lit(2.0), F.col("rel")) - 1
    got = run.where(F.col("rank") <= k).join(relevance, ["query_id", "doc_id"], "left")
    dcg = got.groupBy("query_id").agg(F.sum(F.coalesce(value, F.lit(0.0)) / F.log2(F.col("rank") + 1)).alias("dcg"))
    w = Window.partitionBy("query_id").orderBy(F.desc("rel"), "doc_id")
    ideal = relevance.where("rel > 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).groupBy("query_id").agg(F.sum(value / F.log2(F.col("rank") + 1)).alias("ideal"))
    return dcg.join(ideal, "query_id", "left").select("query_id", F.coalesce(F.try_divide("dcg", "ideal"), F.lit(0.0)).alias("ndcg"))


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def maxsim(query_tokens: DataFrame, doc_tokens: DataFrame, pairs: DataFrame | None = None, block_bytes: int = BROADCAST_BYTES, most_held: int = 4 << 20) -> DataFrame:
    """query_id, doc_id, score: the sum over the query's vectors of the best dot product with the document's.

    pairs names the pairs to score; without it every query is scored against every document.
    The query's vectors are held against all document rows in blocks of at most block_bytes.
    A task keeps the best of each query vector and document, at most most_held numbers at
    once, so no document is gathered in one place. Null ids and vectors take no part.
    """
    spark = doc_tokens.sparkSession
    schema = T.StructType([query_tokens.schema["query_id"], T.StructField("token", T.LongType()), doc_tokens.schema["doc_id"], T.StructField("best", T.DoubleType())])
    target = to_arrow_schema(schema)
    queries = query_tokens.where("query_id is not null and vector is not null").select("query_id", "vector")
    docs = doc_tokens.where("doc_id is not null and vector is not null").select("doc_id", "vector")
    blocks = max(1, -(-byte_size(queries.select("query_id", F.to_json(F.struct("vector")).alias("v"))) // block_bytes))
    found, first = None, 0
    for b in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect()
        if not rows:
            continue
        shared = spark.sparkContext.broadcast((first, [r[0] for r in rows], np.array([r[1] for r in rows], np.float64)))
        first += len(rows)

        def go(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            start, ids, matrix = shared.value
            n, best = len(ids), {}
            fixed = [pa.array(ids, target.field(0).type), pa.array(np.arange(start, start + n))]

            def held() -> Iterator[pa.RecordBatch]:
                for doc, top in best.items():
                    yield pa.RecordBatch.from_arrays([*fixed, pa.array([doc] * n, target.field(2).type), pa.array(top)], schema=target)
                best.clear()

            step = max(1, most_held // n)
            for batch in batches:
                for part in (batch.slice(i, step) for i in range(0, batch.num_rows, step)):
                    docs = part.column(0).dictionary_encode()
                    values = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
                    codes = docs.indices.to_numpy()
                    order = np.argsort(codes, kind="stable")
                    names, begins = np.unique(codes[order], return_index=True)
                    tops = np.maximum.reduceat(matrix @ values[order].T, begins, axis=1)
                    for k, doc in enumerate(docs.dictionary.take(pa.array(names)).to_pylist()):
                        best[doc] = np.maximum(best[doc], tops[:, k]) if doc in best else tops[:, k].copy()
                    if len(best) * n > most_held:
                        yield from held()
            yield from held()

        part = docs.mapInArrow(go, schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], schema)
    tops = found.groupBy("query_id", "token", "doc_id").agg(F.max("best").alias("best"))
    scores = tops.groupBy("query_id", "doc_id").agg(F.sum("best").alias("score"))
    return scores if pairs is None else pairs.join(scores, ["query_id", "doc_id"])
