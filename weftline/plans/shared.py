"""Helpers every plan uses: table paths, lineage cuts in the shared folder, size-checked broadcasts."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side may be broadcast only if its serialised rows stay below this many bytes.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or in local mode, where it is unset, a temporary one. A cluster without one is an error."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = getattr(spark, "_weftline_dir", None)
    if own is None:
        holder = tempfile.TemporaryDirectory(prefix="weftline-")
        atexit.register(holder.cleanup)
        own = f"file://{holder.name}"
        spark._weftline_dir = own
    return own


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted when the session's driver ends."""
    path = f"{shared_dir(spark)}/weftline-{label}-{uuid.uuid4().hex}"
    made = getattr(spark, "_weftline_made", None)
    if made is None:
        made = spark._weftline_made = set()
        atexit.register(_clear, spark)
    made.add(path)
    return path


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    getattr(spark, "_weftline_made", set()).discard(name)


def _clear(spark: SparkSession) -> None:
    for name in list(spark._weftline_made):
        try:
            _delete(spark, name)
        except Exception:  # noqa: BLE001 - the session may have ended before
            return


def release(spark: SparkSession) -> None:
    """Delete every table materialised so far in this session; for long sessions, between queries whose results were read."""
    for name in list(getattr(spark, "_weftline_made", ())):
        _delete(spark, name)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    This cuts the lineage in a way that survives the loss of executors, and keeps
    Python stages from running twice where their result is used twice. The table is
    deleted by discard or release, or when the driver ends.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._weftline_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a materialised table that no later plan reads."""
    if path := getattr(df, "_weftline_path", None):
        _delete(df.sparkSession, path)


def byte_size(df: DataFrame, column: str | None = None) -> int:
    """Upper estimate of the bytes of a table's rows (or one column), as one small aggregate."""
    cols = [column] if column else df.columns
    per_row = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 16 for c in cols), F.lit(0))
    return int(df.agg(F.coalesce(F.sum(per_row), F.lit(0)).alias("b")).first()["b"])


def partitions_for(df: DataFrame, bytes_per_row: int, small: int = 16 << 20, large: int = 512 << 20, many: int = 2000) -> int:
    """Shuffle partitions for rows of df that take bytes_per_row each.

    A task has small bytes while there are at most many tasks, then more, up to large. df
    is a materialised table: its rows are counted from the file footers.
    """
    least, total = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), df.count() * bytes_per_row
    return max(least, min(-(-total // small), many), -(-total // large))


def shuffle_join(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join that is never broadcast: for sides whose size Spark cannot estimate, such as exploded rows."""
    return left.join(right.hint("merge"), on=on, how=how)


def lookup_join(left: DataFrame, right: DataFrame, on, how: str = "left", limit: int = BROADCAST_BYTES) -> DataFrame:
    """Join a small side: broadcast it when its measured size is below limit, else a shuffled join."""
    return left.join(F.broadcast(right) if byte_size(right) <= limit else right, on=on, how=how)
