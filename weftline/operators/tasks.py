"""Task-dataset shaping: choices, options, labels, name parsing, schedules."""

from __future__ import annotations

import math
import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordered import position
from ..plans.shared import materialise

# The text columns of the tasks of two suites, and the metrics each task is judged by.
GLUE_COLUMNS = {
    "cola": ("sentence", None), "mnli": ("premise", "hypothesis"), "mrpc": ("sentence1", "sentence2"), "qnli": ("question", "sentence"),
    "qqp": ("question1", "question2"), "rte": ("sentence1", "sentence2"), "sst2": ("sentence", None), "stsb": ("sentence1", "sentence2"),
}
SUPERGLUE_COLUMNS = {
    "boolq": ("question", "passage"), "cb": ("premise", "hypothesis"), "copa": ("premise", "choice1", "choice2", "question"),
    "multirc": ("paragraph", "question", "answer"), "rte": ("premise", "hypothesis"), "wic": ("sentence1", "sentence2"),
}
TASK_METRICS = {
    "mnli": ["accuracy"], "rte": ["accuracy"], "qnli": ["accuracy"], "sst2": ["accuracy"], "qqp": ["accuracy", "f1"], "mrpc": ["accuracy", "f1"],
    "cola": ["mcc"], "stsb": ["spearman"], "boolq": ["accuracy"], "wic": ["accuracy"], "copa": ["accuracy"], "swag": ["accuracy"], "cb": ["accuracy", "macro_f1"], "multirc": ["f1_a", "em"],
}


def task_columns(task: str, names: dict[str, tuple] = GLUE_COLUMNS, max_seq_length: int = 256) -> tuple[str | None, ...]:
    """The text columns of a task; an unknown task is an error, a length that is no multiple of 8 a warning."""
    if task not in names:
        raise ValueError(f"task ({task}) must be one of {sorted(names)}")
    if max_seq_length % 8:
        warnings.warn("a max_seq_length that is a multiple of 8 is faster", stacklevel=2)
    return names[task]


def task_rows(items: DataFrame, task: str, split: str, columns: tuple[str | None, ...], subset: tuple[str, str] | None = None) -> DataFrame:
    """The examples of one task (and subset: a column and its value) and split with the task's text columns first; a missing column is an error."""
    rows = items.where((F.col("task") == task) & (F.col("split") == split))
    if subset:
        rows = rows.where(F.col(subset[0]) == subset[1])
    named = [c for c in columns if c]
    if missing := [c for c in named if c not in items.columns]:
        raise ValueError(f"missing columns: {missing}")
    return rows.select(*named, *[c for c in rows.columns if c not in named])


def renamed_labels(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Label columns under their task's own names; one that is missing is an error."""
    if missing := [c for c in names if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df.withColumnsRenamed(names)


def job_label(task: Column, seed: Column) -> Column:
    """TASK(seed=n)."""
    return F.concat(F.upper(task), F.lit("(seed="), seed.cast("string"), F.lit(")"))


def choices(stem: Column, lead: Column, endings: Column) -> Column:
    """An array of (first, second): the stem with lead + ' ' + each ending."""
    return F.transform(endings, lambda e: F.struct(stem.alias("first"), F.concat_ws(" ", lead, e).alias("second")))


def padded_options(options: Column, n: int, filler: str = "NA") -> Column:
    """Options filled up to n; more than n stop the query."""
    full = F.concat(options, F.array_repeat(F.lit(filler), F.greatest(F.lit(n) - F.size(options), F.lit(0))))
    return F.when(F.size(options) <= n, full).when(options.isNotNull(), F.raise_error(F.lit(f"more than {n} options")).cast("array<string>"))


def collated(df: DataFrame, task: str, order: str, lists: list[str], index: str, size: int) -> DataFrame:
    """task, number, n, and of each batch of size rows (in order of a numeric key) the lists' values and the fields of the index struct as arrays."""
    fields = [f.name for f in df.schema[index].dataType.fields]
    rows = position(df, order, "__n", by=[task]).withColumn("number", F.expr(f"(__n - 1) div {size}"))
    rows = rows.withColumn(index, F.array(*[F.col(index)[f] for f in fields]))
    held = rows.groupBy(task, "number").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("__n", *lists, index))).alias("__z"))  # at most size rows
    return held.select(task, "number", "n", *[F.col("__z")[c].alias(c) for c in [*lists, index]])


def _many_classes(df: DataFrame, labels: str, classes: DataFrame) -> DataFrame:
    """multi_hot over a class list that stays distributed: the labels of each row meet their class numbers by a join."""
    # One row a class.
    numbered = classes.select("c", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("c")) - 1).alias("__i"))
    n = numbered.count()
    rows = df.withColumn("__row", F.monotonically_increasing_id())
    rows = materialise(rows, "multihot")
    hit = rows.select("__row", F.explode(F.array_distinct(labels)).alias("c")).join(numbered.hint("merge"), "c").groupBy("__row").agg(F.collect_list("__i").alias("__hit"))
    parts = F.transform(F.sort_array(F.coalesce("__hit", F.array().cast("array<int>"))), lambda i: i)
    bounds = F.arrays_zip(F.concat(F.array(F.lit(-1)), parts).alias("a"), F.concat(parts, F.array(F.lit(n))).alias("b"))
    zeros = F.transform(bounds, lambda x: F.concat(F.array_repeat(F.lit(0.0), x["b"] - x["a"] - 1), F.when(x["b"] < n, F.array(F.lit(1.0))).otherwise(F.array().cast("array<double>"))))
    return rows.join(hit.hint("merge"), "__row", "left").withColumn("multi_hot", F.flatten(zeros)).drop("__row", "__hit")


def multi_hot(df: DataFrame, labels: str, train: Column, most_classes: int = 10_000) -> DataFrame:
    """df with multi_hot: a 1.0 for each class of the train rows (sorted) among the row's labels; other labels are ignored.

    Up to most_classes classes become literals of the plan; more stay a table that is joined.
    """
    seen = df.where(train).select(F.explode(labels).alias("c")).where("c is not null").distinct()
    found = seen.limit(most_classes + 1).collect()
    if len(found) > most_classes:
        return _many_classes(df, labels, seen)
    classes = sorted(r["c"] for r in found)
    hot = F.transform(F.array(*map(F.lit, classes)), lambda c: F.coalesce(F.array_contains(labels, c), F.lit(False)).cast("double"))
    return df.withColumn("multi_hot", hot if classes else F.array().cast("array<double>"))


def key_values(text: Column, names: list[str], stop: str = "_") -> list[Column]:
    """The values of name=value parts, a value reaching up to the next name or the end (so values may hold the separator)."""
    others = "|".join(names)
    return [F.nullif(F.regexp_extract(text, rf"(?:^|{stop}){n}=(.*?)(?:{stop}(?:{others})=|$)", 1), F.lit("")).alias(n) for n in names]


#: model, size, version, step, task, seed of a run name
RUN_NAME = r"^([a-z0-9]+)-([a-z]+)-v([0-9]+)-ba([0-9]+)_task=(.+)_seed=([0-9]+)$"


def run_name(name: Column) -> list[Column]:
    """The parts of a run name as columns model, size, version, step, task, seed; nulls where it does not parse."""
    parts = [("model", "string"), ("size", "string"), ("version", "int"), ("step", "bigint"), ("task", "string"), ("seed", "int")]
    return [F.when(name.rlike(RUN_NAME), F.regexp_extract(name, RUN_NAME, i)).cast(t).alias(n) for i, (n, t) in enumerate(parts, 1)]


def path_to_name(path: Column) -> Column:
    """A path as a name: leading slashes off, the others become |."""
    return F.translate(F.regexp_replace(path, "^/+", ""), "/", "|")


def artifact_folder(name: Column) -> Column:
    """The base folder of an artifact name: its last path part without the batch number."""
    return F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"-ba[0-9]+.*$", "")


def artifact_batch(name: Column) -> Column:
    """The batch number of an artifact name, null without one."""
    return F.nullif(F.regexp_extract(name, r"-ba([0-9]+)", 1), F.lit("")).cast("bigint")


def label_maps(labels: Column) -> tuple[Column, Column]:
    """(id to name, name to id) of an array of label names, in upper case; null without names."""
    names = F.transform(labels, lambda x: F.upper(x))
    ids = F.transform(F.sequence(F.lit(0), F.size(labels) - 1), lambda i: i)
    usable = labels.isNotNull() & (F.size(labels) > 0)
    return F.when(usable, F.map_from_arrays(ids, names)), F.when(usable, F.map_from_arrays(names, ids))


def _unit(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def linear(x: Column, start: float = 1.0, end: float = 0.0) -> Column:
    """A line from start to end for x in 0 .. 1."""
    return start + (end - start) * _unit(x)


def cosine(x: Column, start: float = 1.0, end: float = 0.0) -> Column:
    """Half a cosine wave from start to end for x in 0 .. 1."""
    return end + (start - end) * (1 + F.cos(_unit(x) * math.pi)) / 2


def inverse_sqrt(x: Column, alpha: float = 1.0, beta: float = 0.0) -> Column:
    """alpha / sqrt(x + beta) for x from 0."""
    return alpha / F.sqrt(F.greatest(x, F.lit(0.0)) + beta)


def warmup_stable_decay(step: Column, warmup: int, decay: int, total: int, final: float = 0.1) -> Column:
    """A line up from nearly 0 over warmup steps, then 1, then over the last decay steps a line down to final, never below 0."""
    falling = F.greatest(F.lit(0.0), 1 - (step - (total - decay)) / float(max(decay, 1)) * (1 - final))
    return F.when(step < warmup, linear(step / float(max(warmup, 1)), 1e-10, 1.0)).when(step < total - decay, 1.0).otherwise(falling)


def one_minus_sqrt(step: Column, decay: int, total: int, final: float = 0.1) -> Column:
    """1 until the last decay steps, then final + (1 - final) (1 - sqrt of the share passed)."""
    share = F.greatest((step - (total - decay)) / float(max(decay, 1)), F.lit(0.0))
    return F.when(step <= total - decay, 1.0).otherwise(F.greatest(F.lit(final), final + (1 - final) * (1 - F.sqrt(share))))


def cosine_inverse_sqrt(step: Column, warmup: int, cosine_steps: int, cooldown: int, total: int, start: float = 0.0, final: float = 0.0) -> Column:
    """A line from start to 1, the first half of a cosine, an inverse square root that joins it smoothly, and a line to final.

    The inverse square root has the cosine's value and slope where they meet, halfway down.
    """
    slope = math.pi * (1 - final)
    beta = cosine_steps * (1 + final - slope) / slope
    alpha = (1 + final) / 2 * math.sqrt(cosine_steps + beta)
    before_cooldown = alpha / math.sqrt(total - cooldown - warmup + beta)
    if cooldown and final > before_cooldown:
        raise ValueError("final lies above the value at which the cooldown begins")
    since = step - warmup
    return (
        F.when(step < warmup, linear(step / float(max(warmup, 1)), start, 1.0))
        .when(step >= total - cooldown, linear((step - (total - cooldown)) / float(max(cooldown, 1)), before_cooldown, final))
        .when(since <= cosine_steps, cosine(since * 0.5 / float(max(cosine_steps, 1)), 1.0, final))
        .otherwise(inverse_sqrt(since, alpha, beta))
    )


def rope_theta(tokens: Column, least: int, most: int, warmup_tokens: int, increment: int = 10_000) -> Column:
    """least plus an increment for every full interval of tokens passed, at most most; the intervals share warmup_tokens."""
    interval = warmup_tokens // ((most - least) / increment)
    return F.least(F.lit(most).cast("long"), least + F.floor(tokens / F.lit(float(interval))) * increment)


def concat_fields(columns: list[str], separator: str = " ") -> Column:
    """Fields one after the other, nulls left out."""
    return reduce(lambda a, b: F.concat_ws(separator, a, b), [F.col(c) for c in columns])
