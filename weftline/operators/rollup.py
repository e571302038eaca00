"""Results across runs: seeds, tasks, suites, checkpoints, live evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The tasks of each suite.
SUITES = {
    "glue": ["mnli", "qnli", "qqp", "rte", "sst2", "mrpc", "cola", "stsb"],
    "superglue": ["boolq", "cb", "copa", "multirc", "wic"],
    "hebrew": ["heb_nli", "heb_qa"],
}


def suite_of(task: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, tasks in SUITES.items():
        out = F.when(task.isin(tasks), name).otherwise(out)
    return out


def task_means(results: DataFrame, by: list[str]) -> DataFrame:
    """by, task and mean: 100 times the mean over seeds and metrics; repeated rows count once, null values not."""
    return results.dropDuplicates().where("value is not null").groupBy(*by, "task").agg((F.avg("value") * 100).alias("mean"))


def suite_means(means: DataFrame, by: list[str]) -> DataFrame:
    """by, suite, tasks, mean: the mean of the task means of each suite; tasks of no suite are left out."""
    return means.withColumn("suite", suite_of(F.col("task"))).where("suite is not null").groupBy(*by, "suite").agg(F.count("*").alias("tasks"), F.avg("mean").alias("mean"))


def latest_checkpoint(files: DataFrame, by: list[str], name: str) -> DataFrame:
    """by and the file with the largest epoch, then batch, of names like ep3-ba120; names without both rank lowest; ties go to the first name."""
    ep = F.coalesce(F.nullif(F.regexp_extract(name, r"ep([0-9]+)", 1), F.lit("")).cast("long"), F.lit(-1))
    ba = F.coalesce(F.nullif(F.regexp_extract(name, r"ba([0-9]+)", 1), F.lit("")).cast("long"), F.lit(-1))
    best = files.withColumn("__at", F.struct(ep.alias("ep"), ba.alias("ba"))).groupBy(*by).agg(F.max("__at").alias("__best"))
    tied = files.withColumn("__at", F.struct(ep.alias("ep"), ba.alias("ba"))).join(best, by).where("__at = __best")
    return tied.groupBy(*by).agg(F.min(name).alias(name), F.max("__at.ba").alias("batch"))


def live_means(runs: DataFrame, keys: list[str], score: str = "score", seed: str = "seed") -> DataFrame:
    """keys, mean score and number of different seeds, in one aggregate. A score of zero counts, a null one does not."""
    return runs.where(F.col(score).isNotNull()).groupBy(*keys).agg(F.avg(score).alias("mean"), F.countDistinct(seed).alias("seeds"))


def complete_prefix(means: DataFrame, by: list[str], step: str, task: str, required: list[str], least_seeds: int) -> DataFrame:
    """Rows of each step, in ascending order, up to before the first step where a required task is missing or has too few seeds."""
    ok = means.groupBy(*by, step).agg(F.count_distinct(F.when(F.col(task).isin(required) & (F.col("seeds") >= least_seeds), F.col(task))).alias("n"))
    w = Window.partitionBy(*by).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)  # a row for each step
    kept = ok.withColumn("bad", F.max((F.col("n") < len(required)).cast("int")).over(w)).where("bad = 0").select(*by, step)
    return means.join(kept, [*by, step], "left_semi")


def start_points(jobs: DataFrame, parents: DataFrame, by: list[str], default: str) -> DataFrame:
    """jobs with start: the checkpoint of their parent task (its first seed's last one), or the default.

    parents: by, order, checkpoint, position of the checkpoint in its job.
    """
    first = parents.groupBy(*by).agg(F.min_by("checkpoint", F.struct("job_order", -F.col("position"))).alias("__start"))
    return jobs.join(first, by, "left").withColumn("start", F.coalesce("__start", F.lit(default))).drop("__start")


def last_metric(results: DataFrame, by: list[str], order: Column) -> DataFrame:
    """Of several metrics of an evaluation set, the last in order (as a single-valued collector would keep)."""
    return results.groupBy(*by).agg(F.max_by("metric", order).alias("metric"), F.max_by("value", order).alias("value"))
