"""Queries of the streaming operators, run over what the tables hold, with the SQL of their results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.texts import tokens, tokens_sql
from ..streaming import corpus
from .shared import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _stream(spark, d, name, columns):
    """A table as a stream of files: one file of a folder, or a folder of its own."""
    schema = table(spark, d, name).select(*columns).schema
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/{name}.parquet")
    single = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isFile()
    reader = spark.readStream.schema(schema)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(d) if single else reader.parquet(f"{d}/{name}.parquet")


@query("select distinct rec_id from corpus_records")
def stream_dedup(spark, d):
    rows = _stream(spark, d, "corpus_records", ["rec_id", "ingested_at"]).withColumn("ingested_at", F.col("ingested_at").cast("timestamp"))
    return corpus.run_to_table(corpus.keep_first(rows, ["rec_id"], "ingested_at", "120 days").select("rec_id"), "dedup")


@query("select split, date_trunc('day', collected_at)::VARCHAR as day, count(*) as n from corpus_records where collected_at is not null group by 1, 2")
def stream_window_counts(spark, d):
    rows = _stream(spark, d, "corpus_records", ["split", "collected_at"]).withColumn("collected_at", F.col("collected_at").cast("timestamp"))
    counted = corpus.counts_by_time(rows, "collected_at", "1 day", "60 days", ["split"])
    return corpus.run_to_memory(counted, "counts").select("split", F.date_format(F.col("w.start"), "yyyy-MM-dd HH:mm:ss").alias("day"), "n")


@query(f"""with k as (select task, item_id, list_transform({tokens_sql("text_a")}, lambda w: length(w)::BIGINT) as t from eval_items),
o as (select *, (sum(len(t)) over (partition by task order by item_id rows unbounded preceding) - len(t))::BIGINT as off from k),
x as (select task, off + i as p, t[i + 1] as w from (select task, off, t, unnest(range(0, len(t))) as i from o)),
c as (select task, p // 256 as chunk, list(w order by p) as input_ids, count(*) as n from x group by 1, 2)
select task, chunk, input_ids from c where n = 256""")
def stream_chunks(spark, d):
    rows = _stream(spark, d, "eval_items", ["task", "item_id", "text_a"]).select("task", "item_id", F.transform(tokens(F.col("text_a")), lambda w: F.char_length(w).cast("long")).alias("ids"))
    return corpus.run_to_table(corpus.chunks(rows, "task", "item_id", "ids", 256), "chunks")
