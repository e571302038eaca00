"""Problem 8: reading level of each document.

Each word's acquisition grade comes from the distribution of graded (labelled) texts it
stands in; a document's level is predicted from calibrated quantiles of the grades of its
known words. Grades and calibration are fitted on a bounded sample of labelled documents
(max_labelled), all of whose words have a grade; every document of the table is then
scored in one Arrow pass.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.names import canonical_source
from ..operators.metrics import spearman
from ..plans.shared import materialise
from . import prose
from .textnorm import WordHashes, slices, words

LEVELS = (1, 2, 3, 4)
QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)
MAX_LABELLED = 20_000  # labelled documents used for fitting, chosen by a hash of their id


def graded(labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, level (median of its ratings), fold. At most max_labelled documents, by hash of the id."""
    one = labels.where(F.col("doc_id").isNotNull() & F.col("level_rated").isNotNull()).groupBy("doc_id").agg(F.percentile("level_rated", 0.5).alias("level"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled).withColumn("fold", F.pmod(F.xxhash64(F.col("doc_id"), F.lit(5)), F.lit(2)).cast("int"))


def word_grades(texts: DataFrame, smoothing: float = 0.5) -> DataFrame:
    """Acquisition grades of all words of graded texts (doc_id, text, level, fold).

    With c_l the documents of level l that hold the word and N_l all documents of that
    level, the grade is the mean of l weighted by (c_l + s) / (N_l + s). grade_0 and
    grade_1 leave out the documents of fold 0 and 1, for calibration on unseen texts; they
    are null for words of that fold alone.
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, 2):
                held = Counter()
                for level, fold, text in zip(*(c.to_pylist() for c in part.columns)):
                    held.update((w, level, fold) for w in ["", *set(words(text))])
                rows = [(*k, n) for k, n in held.items()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.int64()))], names=["word", "l", "fold", "n"])

    rounded = F.least(F.greatest(F.round("level"), F.lit(LEVELS[0])), F.lit(LEVELS[-1])).cast("int")
    cells = [(lv, fo) for lv in LEVELS for fo in (0, 1)]
    flat = texts.select(rounded.alias("l"), "fold", "text").mapInArrow(go, "word string, l int, fold int, n bigint")
    counts = flat.groupBy("word").agg(*[F.sum(F.when((F.col("l") == lv) & (F.col("fold") == fo), F.col("n")).otherwise(0)).alias(f"c{lv}_{fo}") for lv, fo in cells])
    counts = materialise(counts, "counts")
    totals = counts.where("word = ''").first()  # stands once in every document

    def grade(folds):
        weights = []
        for lv in LEVELS:
            n = sum(totals[f"c{lv}_{fo}"] for fo in folds) if totals else 0
            c = sum((F.col(f"c{lv}_{fo}") for fo in folds), F.lit(0))
            weights.append((lv, (c + smoothing) / F.lit(n + smoothing) if n else F.lit(0.0)))
        total = sum((w for _, w in weights), F.lit(0.0))
        known = sum((F.col(f"c{lv}_{fo}") for lv in LEVELS for fo in folds), F.lit(0)) > 0
        return F.when(known, F.try_divide(sum((w * lv for lv, w in weights), F.lit(0.0)), total))

    return counts.where("word <> ''").select("word", grade((1,)).alias("grade_0"), grade((0,)).alias("grade_1"), grade((0, 1)).alias("grade"))


class Grades:
    """Word hash -> grades, as sorted arrays; 20 bytes a word of the labelled documents."""

    def __init__(self, rows: list[tuple[str, float | None, float | None, float | None]]):
        hashes = WordHashes(len(rows) + 1).of([r[0] for r in rows])
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.values = np.array([[np.nan if g is None else g for g in r[1:]] for r in rows], np.float32).reshape(-1, 3)[order]

    def profile(self, split: list[list[str]], which: np.ndarray, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
        """Known words of each text and the QUANTILES of their grades; which: the column of grades for each text."""
        counts = np.fromiter(map(len, split), np.int64, len(split))
        doc = np.repeat(np.arange(len(split)), counts)
        h = hashes.of([w for one in split for w in one])
        at = np.minimum(np.searchsorted(self.hashes, h), max(len(self.hashes) - 1, 0))
        grade = np.where(self.hashes[at] == h, self.values[at, which[doc]], np.nan) if len(self.hashes) else np.full(len(h), np.nan)
        known = ~np.isnan(grade)
        doc, grade = doc[known], grade[known]
        n = np.bincount(doc, minlength=len(split))
        grade = grade[np.lexsort((grade, doc))].astype(float)
        first = np.cumsum(n) - n
        out = np.full((len(split), len(QUANTILES)), np.nan)
        some = np.flatnonzero(n)
        for k, q in enumerate(QUANTILES):
            place = (n[some] - 1) * q
            low = np.floor(place).astype(np.int64)
            a, b = grade[first[some] + low], grade[first[some] + np.minimum(low + 1, n[some] - 1)]
            out[some, k] = a + (b - a) * (place - low)
        return n, out


def _ridge(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Intercept and a weight for each quantile; the mean alone from fewer than 8 texts, the middle level from none."""
    if len(y) < 8:
        return np.array([y.mean() if len(y) else 2.5, *np.zeros(len(QUANTILES))])
    mean = x.mean(0)
    slope = np.linalg.solve((x - mean).T @ (x - mean) + 1e-2 * len(y) * np.eye(len(QUANTILES)), (x - mean).T @ (y - y.mean()))
    return np.concatenate([[y.mean() - mean @ slope], slope])


def _levels(weights: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.clip(weights[0] + x @ weights[1:], LEVELS[0], LEVELS[-1])


def _seen(documents: DataFrame, labels: DataFrame, max_labelled: int) -> tuple[Grades, list]:
    """The grades, and of every labelled document its id, lang, level, fold and quantiles under the grades of the other fold."""
    docs = documents.where(F.col("text").isNotNull()).select("doc_id", "lang", "text").join(F.broadcast(graded(labels, max_labelled)), "doc_id")
    docs = materialise(docs, "graded")
    grades = Grades([tuple(r) for r in word_grades(docs).toLocalIterator()])
    shared = docs.sparkSession.sparkContext.broadcast(grades)
    schema = T.StructType([docs.schema[c] for c in ("doc_id", "lang", "level", "fold")] + [T.StructField("q", T.ArrayType(T.DoubleType()))])
    target = to_arrow_schema(schema)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for whole in batches:
            for part in slices(whole, 4):
                n, q = shared.value.profile([words(t) for t in part.column(4).to_pylist()], part.column(3).to_numpy(), hashes)
                at = pa.array(np.flatnonzero(n))
                yield pa.RecordBatch.from_arrays([*[part.column(i).take(at) for i in range(4)], pa.array(q[n > 0].tolist(), target.field("q").type)], schema=target)

    return grades, docs.select("doc_id", "lang", "level", "fold", "text").mapInArrow(features, schema).collect()  # at most max_labelled short rows


def fit(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> tuple[Grades, np.ndarray]:
    """The word grades and the calibration weights (intercept, one per quantile).

    The calibration is a ridge regression of the rated levels on the quantiles, each
    document's under the grades of the other fold. Without labels every level is 2.5.
    """
    grades, seen = _seen(documents, labels, max_labelled)
    x = np.array([r["q"] for r in seen]).reshape(-1, len(QUANTILES))
    return grades, _ridge(x, np.array([r["level"] for r in seen], float))


def accuracy(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """By lang of the labelled documents (and for all, lang '*'): how well the level is predicted for texts not fitted on.

    Each document is predicted by grades and a calibration of the other fold. documents,
    mean_error and mean_error_of_mean (of always saying the other fold's mean level) in
    levels, and rank_correlation with the ratings.
    """
    _, seen = _seen(documents, labels, max_labelled)
    rows = []
    for fold in (0, 1):
        own, other = ([r for r in seen if (r["fold"] == fold) == same] for same in (True, False))
        x, y = (np.array([r[c] for r in other], float) for c in ("q", "level"))
        if own:
            weights = _ridge(x.reshape(-1, len(QUANTILES)), y)
            said = _levels(weights, np.array([r["q"] for r in own]))
            mean = float(y.mean()) if len(y) else 2.5
            rows += [(r["lang"] or "?", float(r["level"]), float(p), mean) for r, p in zip(own, said)]
    table = documents.sparkSession.createDataFrame(rows, "lang string, level double, said double, mean double")
    table = table.unionByName(table.withColumn("lang", F.lit("*")))
    errors = table.groupBy("lang").agg(
        F.count("*").alias("documents"), F.round(F.avg(F.abs(F.col("said") - F.col("level"))), 4).alias("mean_error"),
        F.round(F.avg(F.abs(F.col("mean") - F.col("level"))), 4).alias("mean_error_of_mean"),
    )
    return errors.join(spearman(table, ["lang"], "level", "said").select("lang", F.round("spearman", 4).alias("rank_correlation")), "lang")


def levels(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """One row per document with a text: level (1 to 4, null without known words), its figures, is_prose.

    documents: doc_id, text, lang, source, domain; labels: doc_id, level_rated; other
    columns are not read. Null and blank texts and null ids have no row; repeated rows stay
    repeated. Null ratings are left out, and without any rating no level is given.
    """
    grades, weights = fit(documents, labels, max_labelled)
    shared = documents.sparkSession.sparkContext.broadcast(grades)
    extra = [T.StructField("known_words", T.LongType()), T.StructField("level", T.DoubleType())]
    hashes = WordHashes()

    def extra_of(split: list[list[str]]) -> list[pa.Array]:
        n, q = shared.value.profile(split, np.full(len(split), 2), hashes)
        return [pa.array(n), pa.array(_levels(weights, q), mask=n == 0)]

    rows = documents.where("doc_id is not null").select("doc_id", F.col("lang").alias("__lang"), "source", "domain", "text")
    stats = prose.measured(rows, ["doc_id", "__lang", "source", "domain"], extra=extra, extra_of=extra_of)
    out = prose.document_prose(materialise(stats, "reading"))
    ratio = F.col("n_words") / F.when(F.col("sentences") > 0, F.col("sentences"))
    return out.select(
        "doc_id", F.col("__lang").alias("lang"), canonical_source(F.col("source")).alias("source"), "domain", "script", "is_prose",
        F.col("n_words").cast("long").alias("n_words"), "sentences", "long_words", "known_words", "level",
        ratio.alias("words_per_sentence"), F.try_divide(F.col("long_words"), F.col("n_words")).alias("long_word_share"),
    )


def demanding(levelled: DataFrame, words_per_sentence: float = 20, long_share: float = 0.25) -> DataFrame:
    """doc_id of running prose whose sentences and words are both long."""
    return levelled.where(F.col("is_prose") & (F.col("words_per_sentence") >= words_per_sentence) & (F.col("long_word_share") >= long_share)).select("doc_id")


def profile(levelled: DataFrame) -> DataFrame:
    """Documents and levels by every combination of lang, source and domain (a cube)."""
    prose_level = F.when(F.col("is_prose"), F.col("level"))
    cube = levelled.cube("lang", "source", "domain").agg(
        F.grouping_id().alias("grouping"), F.count("*").alias("documents"), F.sum(F.col("is_prose").cast("long")).alias("prose_documents"),
        F.round(F.avg(prose_level), 4).alias("mean_level"), F.round(F.percentile_approx(prose_level, 0.9, 1000), 4).alias("p90_level"),
    )
    return cube
