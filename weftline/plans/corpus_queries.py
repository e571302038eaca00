"""Queries of the corpus operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.names import canonical_source, canonical_source_sql
from ..functions.texts import clean, clean_sql, hash_order_sql, tokens, tokens_sql, unit_hash_sql
from ..operators import corpus
from ..sources import jsonl, sinks
from .ordered import position, running_total
from .shared import scratch, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_BUILD = f"""
with rows as (select rec_id, ingested_at, guid, text, {canonical_source_sql("_source")} as source from corpus_records where text is not null and text <> ''),
numbered as (select *, row_number() over (partition by source order by rec_id, ingested_at) as n, coalesce(guid, sha256(text)) as key from rows),
firsts as (select *, row_number() over (partition by key order by source nulls first, n) as r from numbered where n <= {{limit}}),
kept as (select *, case when {unit_hash_sql(42, "coalesce(source, '') || ':' || key")} < 0.1 then 'validation' else 'train' end as split, len({tokens_sql("text")}) as t from firsts where r = 1),
sums as (select split, source, count(*) as documents, sum(t)::BIGINT as tokens from kept group by split, source)
select split, source, documents, tokens, round(tokens / (sum(tokens) over (partition by split))::DOUBLE, 6) as fraction from sums"""


def _built(spark, d, limit):
    rows = table(spark, d, "corpus_records").where("text is not null and text <> ''").withColumn("source", canonical_source(F.col("_source")))
    kept = corpus.build(rows, "source", ["rec_id", "ingested_at"], limit, 0.1, 42)
    sums = kept.groupBy("split", "source").agg(F.count("*").alias("documents"), F.sum(F.size(tokens(F.col("text")))).alias("tokens"))
    total = F.sum("tokens").over(Window.partitionBy("split"))  # a row for each split and source
    return sums.withColumn("fraction", F.round(F.col("tokens") / total, 6))


@query(_BUILD.format(limit="9223372036854775807"))
def corpus_build(spark, d):
    """The first of equal records (by guid, else by the sha256 of the whole text) over all sources, a split of each source; documents and tokens by split and source."""
    return _built(spark, d, 0)


@query(_BUILD.format(limit=40))
def corpus_build_limited(spark, d):
    """corpus_build of the first 40 records of each source."""
    return _built(spark, d, 40)


@query("""select doc_id, count(*) as times from (select doc_id from documents where lang is not distinct from 'he' and domain is not distinct from 'news'
union all select doc_id from documents where lang is not distinct from 'he' union all select doc_id from documents where domain is not distinct from null) group by doc_id""")
def filter_union_all(spark, d):
    docs = table(spark, d, "documents")
    parts = [{"lang": "he", "domain": "news"}, {"lang": "he"}, {"domain": None}]
    return corpus.filter_union(docs.select("doc_id", "lang", "domain"), parts).groupBy("doc_id").agg(F.count("*").alias("times"))


@query("select doc_id, lang from documents where text is not null and text <> ''")
def nonempty(spark, d):
    return table(spark, d, "documents").where("text is not null and text <> ''").select("doc_id", "lang")


@query(f"select doc_id, sha256({clean_sql('text')}) as digest, length({clean_sql('text')}) as n from documents where {clean_sql('text')} is not null")
def clean_text(spark, d):
    rows = table(spark, d, "documents").select("doc_id", clean(F.col("text"), 20_000).alias("t")).where("t is not null")
    return rows.select("doc_id", F.sha2("t", 256).alias("digest"), F.char_length("t").cast("long").alias("n"))


@query("select rec_id, split, _row_number from corpus_records")
def keep_columns(spark, d):
    return corpus.keep_columns(table(spark, d, "corpus_records"), ["rec_id", "split", "_row_number"], "rec_id")


@query("select window_name, [capacity, specials_per_item]::SMALLINT[] as ids from pack_windows")
def narrow_ids(spark, d):
    return table(spark, d, "pack_windows").select("window_name", corpus.narrowed(F.array("capacity", "specials_per_item"), 32767, "smallint").alias("ids"))


@query("""select 0 as src_idx, rec_id as id, text_hash from (select rec_id, sha256(text) as text_hash from corpus_records)
union all select 1, doc_id, sha256(text) from documents""")
def union_sources(spark, d):
    a = table(spark, d, "corpus_records").select(F.col("rec_id").alias("id"), F.sha2("text", 256).alias("text_hash"))
    b = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("text_hash"))
    return corpus.union_sources([a, b])


@query(f"select distinct {canonical_source_sql('_source')} as source from corpus_records where _source is not null except select source_name from source_catalog")
def set_difference(spark, d):
    used = table(spark, d, "corpus_records").where("_source is not null").select(canonical_source(F.col("_source")).alias("source")).distinct()
    return used.join(table(spark, d, "source_catalog").select(F.col("source_name").alias("source")), "source", "left_anti")


@query(f"select distinct {canonical_source_sql('_source')} as source from corpus_records intersect select source_name from source_catalog")
def set_intersect(spark, d):
    used = table(spark, d, "corpus_records").select(canonical_source(F.col("_source")).alias("source")).distinct()
    return used.intersect(table(spark, d, "source_catalog").select(F.col("source_name").alias("source")))


@query("""select rec_id from (select rec_id, row_number() over (partition by sha256(text) order by rec_id nulls first, ingested_at nulls first) as r
from corpus_records where text is not null) where r = 1 union all select rec_id from corpus_records where text is null""")
def dedup_first(spark, d):
    rows = table(spark, d, "corpus_records").select("rec_id", "ingested_at", "text")
    return corpus.dedup_first(rows, F.sha2("text", 256), ["rec_id", "ingested_at"]).select("rec_id")


@query("""select doc_id, n from (select doc_id, n, row_number() over (order by doc_id) as r, sum(n) over (order by doc_id rows unbounded preceding) as c
from (select doc_id, coalesce(length(text), 0) as n from documents)) where c - n < 100000 or r = 1""")
def token_budget(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n"))
    return corpus.token_budget(docs, "doc_id", F.col("n"), 100_000)


@query(f"select doc_id, case when {unit_hash_sql(42, 'doc_id')} < 0.1 then 'validation' else 'train' end as split from documents")
def hash_split(spark, d):
    return corpus.hash_split(table(spark, d, "documents").select("doc_id"), "doc_id", 0.1, 42)


@query("""select doc_id, case when r <= 600 then 'train' else 'validation' end as split from (select doc_id, row_number() over (order by doc_id) as r from documents) where r <= 900""")
def positional_split(spark, d):
    return corpus.positional_split(table(spark, d, "documents").select("doc_id"), "doc_id", 600, 300)


@query(f"""with c as (select {canonical_source_sql("_source")} as source_name, count(*) as n from corpus_records where _source is not null group by 1),
w as (select m.source_name, m.target_share as coefficient, m.mix_name from mix_targets m)
select w.mix_name, w.source_name, c.n, round_even(coefficient * n * 2.5, 0)::BIGINT as instances,
greatest(1, round_even(n * 0.01, 0))::BIGINT as n_validation from w join c using (source_name)""")
def mix_weights(spark, d):
    counts = table(spark, d, "corpus_records").where("_source is not null").groupBy(canonical_source(F.col("_source")).alias("source_name")).agg(F.count("*").alias("n"))
    weights = table(spark, d, "mix_targets").select("mix_name", "source_name", F.col("target_share").alias("coefficient")).join(counts.select("source_name"), "source_name", "left_semi")
    rows = corpus.instance_weights(weights, counts, "source_name", 2.5)
    return rows.select("mix_name", "source_name", "n", "instances", F.greatest(F.lit(1), F.bround(F.col("n") * 0.01, 0)).cast("long").alias("n_validation"))


@query("""select lang, count(*) as samples, (sum(length(text)) // count(*))::BIGINT as chars_per_sample,
(count(*) * ((sum(length(text)) // count(*)) // 4) // 1024)::BIGINT as est_chunks from documents where text is not null group by lang""")
def est_chunks(spark, d):
    agg = table(spark, d, "documents").where("text is not null").groupBy("lang").agg(F.count("*").alias("samples"), F.expr("sum(char_length(text)) div count(*)").alias("chars_per_sample"))
    return agg.withColumn("est_chunks", F.expr("samples * (chars_per_sample div 4) div 1024"))


@query("select rec_id, ingested_at, sha256(text) as digest from corpus_records order by rec_id, ingested_at limit 500")
def source_limit(spark, d):
    return table(spark, d, "corpus_records").select("rec_id", "ingested_at", F.sha2("text", 256).alias("digest")).orderBy("rec_id", "ingested_at").limit(500)


@query(f"select doc_id, row_number() over (order by h) - 1 as _row_number from (select doc_id, {hash_order_sql(42, 'doc_id')} as h from documents order by h limit 200)")
def shuffle_head(spark, d):
    return corpus.shuffled(table(spark, d, "documents").select("doc_id"), "doc_id", 42, 200)


@query(f"select doc_id, row_number() over (order by {hash_order_sql(42, 'doc_id')}) - 1 as _row_number from documents")
def shuffle_all(spark, d):
    return corpus.shuffled(table(spark, d, "documents").select("doc_id"), "doc_id", 42)


@query(f"select doc_id, case when row_number() over (order by {hash_order_sql(12, 'doc_id')}) <= 100 then 'test' else 'train' end as split from documents")
def fixed_test_split(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    test = corpus.shuffled(docs, "doc_id", 12, 100).select("doc_id", F.lit("test").alias("split"))
    return docs.join(F.broadcast(test), "doc_id", "left").select("doc_id", F.coalesce("split", F.lit("train")).alias("split"))


@query(f"""with s as (select source, count(*) as n, {hash_order_sql(42, "source")} as h from documents where source is not null group by source),
b as (select source, coalesce(sum(n) over (order by h rows between unbounded preceding and 1 preceding), 0) as before from s),
r as (select doc_id, source, before + row_number() over (partition by source order by doc_id) - 1 as place from documents join b using (source) where before < 300)
select doc_id, source, place::BIGINT as place from r where place < 300""")
def shard_sample(spark, d):
    return corpus.block_sample(table(spark, d, "documents").select("doc_id", "source"), "source", 300, 42, "doc_id").select("doc_id", "source", "place")


@query(f"select source, doc_id from (select source, doc_id, row_number() over (partition by source order by doc_id) as r from documents where {clean_sql('text')} is not null) where r <= 60")
def topk_per_shard(spark, d):
    rows = table(spark, d, "documents").where(clean(F.col("text")).isNotNull()).select("source", "doc_id")
    return corpus.top_per_shard(rows, "source", "doc_id", 60)


@query(f"""with s as (select source from (select distinct source from documents where source is not null) order by {hash_order_sql(5, "source")} limit 50),
r as (select source, doc_id, row_number() over (partition by source order by doc_id) as r from documents join s using (source)),
k as (select *, {hash_order_sql(5, "source")} as h from r join documents using (doc_id, source) where r <= 60 and {clean_sql("text")} is not null)
select source, doc_id from k order by h, doc_id limit 200""")
def doc_sample(spark, d):
    """Of at most 50 shards the first 60 rows, those with text, the first 200 of them in shard order."""
    return corpus.document_sample(table(spark, d, "documents").withColumn("text", clean(F.col("text"))), "source", "doc_id", "text", 200, seed=5).select("source", "doc_id")


@query(f"""select doc_id, _source, _row_number, digest from (select doc_id, 'docs' as _source, sha256(text) as digest, row_number() over (order by substr({hash_order_sql(42, "doc_id")}, 1, 15), doc_id) - 1 as _row_number
from documents where lang = 'he') where _row_number < 250""")
def src_parquet_filter_shuffle(spark, d):
    rows = jsonl.read_parquet_source(table(spark, d, "documents"), "docs", "doc_id", [{"lang": "he"}], 250)
    return rows.select("doc_id", "_source", "_row_number", F.sha2("text", 256).alias("digest"))


@query("select rec_id, _source from corpus_records where (contains(_source, 'news') or contains(_source, 'web')) and not contains(_source, 'hebmix')")
def src_path_filter(spark, d):
    return jsonl.by_path(table(spark, d, "corpus_records").select("rec_id", "_source"), "_source", ["news", "web"], ["hebmix"])


@query(f"""with r as (select doc_id, domain, row_number() over (partition by domain order by {hash_order_sql(7, "doc_id")}) as k from documents)
select doc_id, domain, unnest(range(1, case when domain = 'law' then 3 else 1 end + 1))::INTEGER as copy from r where domain is null or domain <> 'web' or k <= 40""")
def stream_mix(spark, d):
    return corpus.stream_mix(table(spark, d, "documents").select("doc_id", "domain"), "domain", "doc_id", {"web": 40}, {"law": 3}, 7)


@query("select doc_id, octet_length(encode(text)) as n_bytes from documents where text is not null")
def text_to_bytes(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.octet_length(F.encode("text", "UTF-8")).cast("long").alias("n_bytes"))


@query("select item_id, sha256(case when text_b is not null and text_b <> '' then text_b || chr(10) || text_a else text_a end) as digest, row_number() over (order by item_id) - 1 as int_id from eval_items")
def make_passage(spark, d):
    title = F.when(F.col("text_b") != "", F.col("text_b"))
    rows = table(spark, d, "eval_items").select("item_id", F.sha2(F.concat_ws("\n", title, F.col("text_a")), 256).alias("digest"))
    return position(rows, "item_id", "n").select("item_id", "digest", (F.col("n") - 1).alias("int_id"))


_U = "((('0x' || substr(sha256('{0}:' || id), 1, 8))::BIGINT) / 4294967296.0::DOUBLE)"
_Z = f"(sqrt(-2 * ln(1 - {_U.format('a')})) * cos(6.283185307179586::DOUBLE * {_U.format('b')}))"


def _synth_sql(mean: int, sd: int, least: int, most: int, rows: int) -> str:
    return f"""with n as (select id, least(greatest(floor({_Z} * {sd} + {mean})::BIGINT, {least}), {most}) as n from (select unnest(range(0, {rows})) as id)),
x as (select id, n, unnest(range(1, n + 1)) as i from n)
select id, n, sum((id * 31 + i * 17) % 1000)::BIGINT as ids_sum, count(*) filter ((id * 7 + i * 13) % 10 < 7) as ignored from x group by id, n"""


def _synth(spark, mean, sd, least, most, rows):
    made = corpus.synthetic_lengths(spark, rows, mean, sd, least, most)
    zero = F.lit(0).cast("long")
    return made.select("id", "n", F.aggregate("input_ids", zero, lambda s, x: s + x).alias("ids_sum"), F.size(F.filter("labels", lambda x: x == -100)).cast("long").alias("ignored"))


@query(_synth_sql(256, 64, 16, 512, 8192))
def synth_lengths(spark, d):
    """Normal lengths (256, 64) kept within 16 and 512, a token matrix of each and labels of which 7 in 10 are ignored."""
    return _synth(spark, 256, 64, 16, 512, 8192)


@query(_synth_sql(4096, 1024, 16, 8192, 512))
def synth_long_lengths(spark, d):
    """Normal lengths (4096, 1024) kept within 16 and 8192."""
    return _synth(spark, 4096, 1024, 16, 8192, 512)


@query("select run_id, name from tracker_runs where state = 'finished' and contains(name, 'task=')")
def runs_filter(spark, d):
    return table(spark, d, "tracker_runs").where("state = 'finished'").where(F.contains(F.col("name"), F.lit("task="))).select("run_id", "name")


@query("select file, row_number() over (partition by file order by doc_id) - 1 as _row_number, sha256(text) as digest from (select doc_id, text, doc_id % 3 as file from documents where text is not null)")
def src_jsonl(spark, d):
    """Documents written as three JSON-lines files and scanned back with exact line numbers."""
    folder = scratch(spark, "jsonl")
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", (F.col("doc_id") % 3).alias("file"), F.to_json(F.struct("text")).alias("value"))
    for k in range(3):
        jsonl.write_lines(docs.where(F.col("file") == k).select("doc_id", "value"), "doc_id", "value", f"{folder}/part{k}.jsonl")
    rows = jsonl.read_jsonl(spark, "docs", [folder], compute_guid=True)
    return rows.select(F.col("file_idx").cast("long").alias("file"), "_row_number", F.col("guid").alias("digest"))


@query("select doc_id, lang, sha256(text) as digest from documents")
def sink_roundtrip(spark, d):
    out = scratch(spark, "sink")
    return sinks.write_shards(table(spark, d, "documents"), out, ["doc_id", "lang", "text"], 1000).select("doc_id", "lang", F.sha2("text", 256).alias("digest"))


@query("select source, count(*) as documents, sum(length(text))::BIGINT as chars from documents where source is not null group by source")
def result_files(spark, d):
    """Figures by source written as CSV and as JSON, and read back from both."""
    rows = table(spark, d, "documents").where("source is not null").groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.char_length("text")).alias("chars"))
    both = [sinks.write_results(rows, scratch(spark, kind), kind) for kind in ("csv", "json")]
    return both[0].join(both[1], ["source", "documents", "chars"])


@query("select doc_id, lang, sha256(text) as digest from documents")
def indexed_shards(spark, d):
    """Documents written as shards with an index and read back after it was checked."""
    out = scratch(spark, "shards")
    sinks.write_indexed(table(spark, d, "documents").select("doc_id", "lang", "text"), out, 400)
    return sinks.read_indexed(spark, out).select("doc_id", "lang", F.sha2("text", 256).alias("digest"))


@query("select source_name, '{\"source_name\":\"' || source_name || '\",\"domain\":' || coalesce('\"' || domain || '\"', 'null') || '}' as line from source_catalog")
def to_jsonl_rows(spark, d):
    rows = table(spark, d, "source_catalog")
    return rows.select("source_name", sinks.json_line(rows, ["source_name", "domain"]).alias("line"))


@query("select doc_id, sha256(replace(text, chr(10), ' ')) as digest from documents where text is not null")
def txt_lines(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2(sinks.text_line(F.col("text")), 256).alias("digest"))


@query(f"select case when {unit_hash_sql(42, 'doc_id')} < 0.1 then 'validation' else 'train' end as split, count(*) as n from documents group by 1")
def split_counts(spark, d):
    out = scratch(spark, "splits")
    return sinks.write_splits(corpus.hash_split(table(spark, d, "documents"), "doc_id", 0.1, 42), out, ["doc_id", "text"])


@query("""select run_id from (select *, regexp_extract(name, 'task=(.+)_seed', 1) as task from tracker_runs) r
where not exists (select 1 from eval_results e where e.task = r.task and e.metric = r.metric)""")
def resume_antijoin(spark, d):
    """Runs whose task and metric the results table does not hold yet."""
    runs = table(spark, d, "tracker_runs").withColumn("task", F.regexp_extract("name", r"task=(.+)_seed", 1))
    done = table(spark, d, "eval_results").select("task", "metric").distinct()
    return sinks.pending(runs, done, ["task", "metric"]).select("run_id")


@query("""with n as (select count(*) as n from documents), p as (select doc_id, row_number() over (order by doc_id) - 1 as pos from documents),
w as (select doc_id, pos from p union all select doc_id, pos + n from p, n where n % 7 <> 0 and pos < 7 - n % 7)
select doc_id, pos, pos % 7 as rank from w""")
def rank_shard(spark, d):
    return corpus.rank_shards(table(spark, d, "documents").select("doc_id"), "doc_id", 7)


@query(f"""with n as (select count(*) as n from documents), p as (select doc_id, row_number() over (order by substr({hash_order_sql(45, "doc_id")}, 1, 15)) - 1 as pos from documents)
select doc_id, pos, pos % 7 as rank from p, n where pos < n - n % 7""")
def rank_epoch(spark, d):
    """The rows that each rank reads in the third epoch, the rest at the end dropped."""
    return corpus.epoch_shards(table(spark, d, "documents").select("doc_id"), "doc_id", 7, 42, 3, drop_last=True)


@query("""select doc_id, lang, n, sum(n) over (partition by lang order by doc_id rows unbounded preceding)::BIGINT as total from (select doc_id, lang, coalesce(length(text), 0) as n from documents)""")
def running_total_by_lang(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n"))
    return running_total(docs, "doc_id", F.col("n"), "total", by=["lang"])


