"""Sinks: columnar shards, JSON lines, text lines, result files, split-partitioned writes, resumable ledgers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import files


def write_shards(df: DataFrame, path: str, columns: list[str], rows_per_file: int = 0, compression: str = "zstd", mode: str = "error") -> DataFrame:
    """Write the declared columns as parquet shards and read them back.

    mode 'ignore' keeps what a finished run left (its _SUCCESS is there) and writes a
    half-written folder anew.
    """
    spark = df.sparkSession
    if mode == "ignore":
        if files.exists(spark, f"{path}/_SUCCESS"):
            return spark.read.parquet(path)
        mode = "overwrite"
    writer = df.select(*columns).write.mode(mode).option("compression", compression)
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.parquet(path)
    return spark.read.schema(df.select(*columns).schema).parquet(path)


INDEX = T.StructType([T.StructField("shard", T.StringType()), T.StructField("rows", T.LongType()), T.StructField("bytes", T.LongType())])


def write_indexed(df: DataFrame, path: str, rows_per_file: int = 0) -> None:
    """Shards below path/shards and, last of all, path/index: name, rows and bytes of each shard."""
    spark = df.sparkSession
    write_shards(df, f"{path}/shards", df.columns, rows_per_file)
    rows = spark.read.schema(df.schema).parquet(f"{path}/shards").groupBy(F.col("_metadata.file_name").alias("shard")).agg(F.count("*").alias("rows")).collect()  # a row for each shard
    held, sizes = {r["shard"]: r["rows"] for r in rows}, files.sizes(spark, f"{path}/shards")
    index = [(name, held.get(name, 0), size) for name, size in sorted(sizes.items()) if name.endswith(".parquet")]
    spark.createDataFrame(index, INDEX).coalesce(1).write.json(f"{path}/index")


def read_indexed(spark: SparkSession, path: str, most_length: int = 0, ids: str = "input_ids") -> DataFrame:
    """The shards that path/index names, after checking that each is there with its size; ids cut to most_length if given.

    A missing index, shard or size is an error, as is a shard that the index does not name.
    """
    if not files.exists(spark, f"{path}/index/_SUCCESS"):
        raise ValueError(f"no index in {path}")
    index = {r["shard"]: r["bytes"] for r in spark.read.schema(INDEX).json(f"{path}/index").collect()}
    found = {n: b for n, b in files.sizes(spark, f"{path}/shards").items() if n.endswith(".parquet")}
    if index != found:
        raise ValueError(f"shards that differ from the index: {sorted(n for n in {*index, *found} if index.get(n) != found.get(n))}")
    if not index:
        raise ValueError(f"the index of {path} is empty")
    df = spark.read.parquet(*[f"{path}/shards/{n}" for n in sorted(index)])
    return df.withColumn(ids, F.slice(ids, 1, most_length)) if most_length and ids in df.columns else df


def json_line(df: DataFrame, columns: list[str]) -> Column:
    """A row as one JSON line, characters unescaped, null fields written."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def text_line(text: Column) -> Column:
    """A text on one line: line feeds become blanks, carriage returns stay."""
    return F.translate(text, "\n", " ")


def write_results(df: DataFrame, path: str, kind: str = "csv") -> DataFrame:
    """A small table of results as one CSV (with header), JSON-lines or markdown file in a folder, read back (markdown: as lines)."""
    one = df.coalesce(1)
    if kind == "csv":
        one.write.option("header", "true").option("escape", '"').csv(path)
        return df.sparkSession.read.schema(df.schema).option("header", "true").option("escape", '"').csv(path)
    if kind == "json":
        one.write.option("ignoreNullFields", "false").json(path)
        return df.sparkSession.read.schema(df.schema).json(path)
    if kind == "markdown":
        cells = [F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit("")) for c in df.columns]
        head = df.sparkSession.createDataFrame([("| " + " | ".join(df.columns) + " |",), ("|" + "-|" * len(df.columns),)], "value string").coalesce(1)
        head.unionByName(one.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))).coalesce(1).write.text(path)
        return df.sparkSession.read.text(path)
    raise ValueError("kind is 'csv', 'json' or 'markdown'")


def write_splits(df: DataFrame, path: str, columns: list[str], splits: tuple[str, ...] = ("train", "validation", "test")) -> DataFrame:
    """Write all splits in one pass, partitioned by split, and count the rows of each; another split stops the query.

    The counts are observed while the rows are written, so nothing is read again.
    """
    known = F.when(F.col("split").isin(*splits), F.col("split")).otherwise(F.raise_error(F.concat(F.lit("unknown split "), F.coalesce("split", F.lit("null")))))
    seen = Observation(f"splits-{uuid.uuid4().hex}")
    rows = df.withColumn("split", known).observe(seen, *[F.count(F.when(F.col("split") == n, 1)).alias(n) for n in splits])
    rows.select(*columns, "split").write.partitionBy("split").parquet(path)
    return df.sparkSession.createDataFrame([(n, seen.get[n]) for n in splits if seen.get[n]], "split string, n bigint")


def pending(work: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    """Work not yet in the ledger."""
    return work.join(ledger, keys, "left_anti")


def append_ledger(done: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Add finished work to a ledger, what it holds already left out, and read it back."""
    spark = done.sparkSession
    if files.exists(spark, path):
        done = pending(done, spark.read.schema(done.schema).parquet(path), keys)
    done.write.mode("append").parquet(path)
    return spark.read.schema(done.schema).parquet(path)


def recompress(spark: SparkSession, path: str, compression: str = "none", keep: bool = False) -> DataFrame:
    """Shards rewritten in place: written beside under a temporary name, then renamed; keep leaves the old ones at path.old.

    Called again after it was interrupted, it goes on where it stopped.
    """
    fresh, old = f"{path}.new", f"{path}.old"
    if not files.exists(spark, old):
        spark.read.parquet(path).write.mode("overwrite").option("compression", compression).parquet(fresh)
        files.move(spark, path, old)
    if not files.exists(spark, path):
        files.move(spark, fresh, path)
    if not keep:
        files.remove(spark, old)
    return spark.read.parquet(path)
