"""Queries of the task, metric, retrieval and rollup operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.names import canonical_source, canonical_source_sql
from ..functions.texts import tokens, tokens_sql
from ..operators import index, metrics, rollup, tasks
from ..operators import sequences as seq
from .shared import lookup_join, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- aggregations over token counts and vocabularies ---

_TOKENS = f"(select doc_id, lang, {canonical_source_sql('source')} as source, len({tokens_sql('text')}) as n from documents where text is not null)"


def _counts(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", "lang", canonical_source(F.col("source")).alias("source"), F.size(tokens(F.col("text"))).cast("long").alias("n"))


@query(f"select source, sum(n)::BIGINT as tokens, round(sum(n) / (sum(sum(n)) over ())::DOUBLE, 6) as fraction from {_TOKENS} group by source")
def source_fraction(spark, d):
    sums = _counts(spark, d).groupBy("source").agg(F.sum("n").alias("tokens"))
    total = F.sum("tokens").over(Window.partitionBy(F.lit(0)))  # a row for each source
    return sums.withColumn("fraction", F.round(F.col("tokens") / total, 6)).orderBy(F.desc("tokens"), "source")


_SHARES = sorted([1, 99, *range(0, 101, 5)])


@query(f"""select lang, percent, round(value, 6) as value, round(mean, 6) as mean, round(std, 6) as std from (
select lang, unnest([{",".join(map(str, _SHARES))}]) as percent, unnest(quantile_cont(n, [{",".join(str(p / 100) for p in _SHARES)}])) as value, avg(n) as mean, stddev_pop(n) as std from {_TOKENS} group by lang)""")
def token_percentiles(spark, d):
    shares = F.array(*[F.lit(p / 100) for p in _SHARES])
    agg = _counts(spark, d).groupBy("lang").agg(F.percentile("n", shares).alias("v"), F.avg("n").alias("mean"), F.stddev_pop("n").alias("std"))
    rows = agg.select("lang", "mean", "std", F.explode(F.arrays_zip(F.array(*map(F.lit, _SHARES)).alias("percent"), F.col("v").alias("value"))).alias("x"))
    return rows.select("lang", F.col("x.percent").alias("percent"), F.round("x.value", 6).alias("value"), F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("select sum(b)::BIGINT as total_bytes, sum(n)::BIGINT as instances from (select source, sum(octet_length(encode(text))) as b, count(*) as n from documents where text is not null group by source)")
def ledger_totals(spark, d):
    ledger = table(spark, d, "documents").where("text is not null").groupBy("source").agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n"))
    return ledger.agg(F.sum("b").alias("total_bytes"), F.sum("n").alias("instances"))


@query("select event_type, round(count(*) / (epoch_us(max(ts)) - epoch_us(min(ts)))::DOUBLE * 1e6, 6) as per_second, round(count(*) / (epoch_us(max(ts)) - epoch_us(min(ts)))::DOUBLE * 1e6 / 149.0::DOUBLE, 9) as per_second_per_million, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std from events group by event_type")
def throughput(spark, d):
    seconds = (F.unix_micros(F.max(F.col("ts").cast("timestamp"))) - F.unix_micros(F.min(F.col("ts").cast("timestamp")))).cast("double") / 1e6
    parameters = 149.0  # millions, of the model whose speed is told
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.count("*") / seconds, 6).alias("per_second"), F.round(F.count("*") / seconds / parameters, 9).alias("per_second_per_million"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("std"))


@query(f"""with t as (select doc_id, lang, text, {tokens_sql('text')} as t from documents where text is not null),
u as (select doc_id, count(*) as unknown from (select doc_id, unnest(t) as w from t) x where '▁' || w not in (select piece from vocab_pieces) group by doc_id)
select lang, round(sum(len(t)) / nullif(sum(len(regexp_extract_all(text, '[A-Za-z0-9א-ת]+'))), 0)::DOUBLE, 6) as per_word, round(sum(len(t)) / nullif(sum(length(text)), 0)::DOUBLE, 6) as per_char,
round(100 * sum(coalesce(unknown, 0)) / greatest(sum(len(t)), 1)::DOUBLE, 6) as unknown_percent from t left join u using (doc_id) group by lang""")
def fertility(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "lang", "text", tokens(F.col("text")).alias("t"))
    pieces = table(spark, d, "vocab_pieces").select(F.col("piece").alias("p"), F.lit(1).alias("known")).distinct()
    words = docs.select("lang", F.explode("t").alias("w")).groupBy("lang", "w").agg(F.count("*").alias("n"))
    unknown = lookup_join(words.withColumn("p", F.concat(F.lit("▁"), "w")), pieces, "p").where("known is null").groupBy("lang").agg(F.sum("n").alias("unknown"))
    sums = docs.groupBy("lang").agg(F.sum(F.size("t")).alias("tokens"), F.sum(F.regexp_count("text", F.lit("[A-Za-z0-9א-ת]+"))).alias("words"), F.sum(F.char_length("text")).alias("chars"))
    j = sums.join(unknown.withColumnRenamed("lang", "l"), F.col("lang").eqNullSafe(F.col("l")), "left")
    return j.select(
        "lang", F.round(F.try_divide("tokens", "words"), 6).alias("per_word"), F.round(F.try_divide("tokens", "chars"), 6).alias("per_char"),
        F.round(100 * F.coalesce("unknown", F.lit(0)) / F.greatest("tokens", F.lit(1)), 6).alias("unknown_percent"),
    )


@query("""select case when regexp_matches(p, '^\\s*$') then 'space' when regexp_matches(p, '[א-ת]') then 'hebrew' when regexp_matches(p, '[A-Za-z]') then 'latin' when regexp_matches(p, '[0-9]') then 'digit' else 'other' end as kind, count(*) as n
from (select replace(piece, '▁', '') as p from vocab_pieces) group by 1""")
def vocab_composition(spark, d):
    p = F.replace("piece", F.lit("▁"), F.lit(""))
    kind = F.when(p.rlike(r"^\s*$"), "space").when(p.rlike("[א-ת]"), "hebrew").when(p.rlike("[A-Za-z]"), "latin").when(p.rlike("[0-9]"), "digit").otherwise("other")
    return table(spark, d, "vocab_pieces").groupBy(kind.alias("kind")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind")


@query(f"select lang, sum(n)::BIGINT as tokens, count(*) as documents from {_TOKENS} group by lang")
def real_tokens(spark, d):
    return _counts(spark, d).groupBy("lang").agg(F.sum("n").alias("tokens"), F.count("*").alias("documents"))


# --- task shaping ---


@query(f"""with t as (select item_id, {tokens_sql('text_a')} as a, {tokens_sql('text_b')} as b from eval_items),
k as (select *, case when len(a) + len(b) <= 61 then len(a) when len(a) <= len(b) then least(len(a), 31) else greatest(61 - len(b), 31) end as ka from t),
e as (select item_id, case when b is null then list_concat(list_concat(['[CLS]'], a[1:62]), ['[SEP]']) else list_concat(list_concat(list_concat(['[CLS]'], a[1:ka]), ['[SEP]']), list_concat(b[1:least(len(b), 61 - ka)], ['[SEP]'])) end as x from k)
select item_id, md5(array_to_string(list_resize(x, 64, '[PAD]'), ' ')) as digest, len(x)::BIGINT as n from e""")
def pair_encode(spark, d):
    items = table(spark, d, "eval_items").select("item_id", tokens(F.col("text_a")).alias("a"), tokens(F.col("text_b")).alias("b"))
    x = items.select("item_id", seq.pair_with_specials(F.col("a"), F.col("b"), F.lit("[CLS]"), F.lit("[SEP]"), 64).alias("x"))
    return x.select("item_id", F.md5(F.array_join(seq.truncate_pad(F.col("x"), 64, F.lit("[PAD]")), " ")).alias("digest"), F.size("x").cast("long").alias("n"))


@query("""select item_id, i - 1 as choice, sha256(text_a) as first, sha256(coalesce(text_b, '') || (case when text_b is null then '' else ' ' end) || e[i]) as second from
(select *, ['yes', 'no', 'maybe', task] as e, unnest(range(1, 5)) as i from eval_items)""")
def choices_explode(spark, d):
    items = table(spark, d, "eval_items").withColumn("c", tasks.choices(F.col("text_a"), F.col("text_b"), F.array(F.lit("yes"), F.lit("no"), F.lit("maybe"), F.col("task"))))
    rows = items.select("item_id", F.posexplode("c").alias("choice", "x"))
    return rows.select("item_id", F.col("choice").cast("long").alias("choice"), F.sha2("x.first", 256).alias("first"), F.sha2("x.second", 256).alias("second"))


@query("""select item_id, list_resize(list_filter(string_split(text_b, ', '), lambda x: x <> ''), 10, 'NA') as options from eval_items where text_b is not null""")
def option_pad(spark, d):
    options = F.filter(F.split("text_b", ", "), lambda x: x != "")
    return table(spark, d, "eval_items").where("text_b is not null").select("item_id", tasks.padded_options(options, 10).alias("options"))


@query("select item_id, sha256(concat_ws(' ', text_a, text_b)) as joined, sha256(concat_ws(' [SEP] ', text_a, text_b)) as preferred from eval_items")
def concat_fields(spark, d):
    return table(spark, d, "eval_items").select("item_id", F.sha2(tasks.concat_fields(["text_a", "text_b"]), 256).alias("joined"), F.sha2(tasks.concat_fields(["text_a", "text_b"], " [SEP] "), 256).alias("preferred"))


@query("""with k as (select task, item_id, label, (row_number() over (partition by task order by item_id) - 1) // 32 as number, [[length(text_a), coalesce(length(text_b), 0)], [length(task), 0]] as c from eval_items)
select task, number, count(*) as n, list(c order by item_id) as batch, list([item_id, coalesce(label, -100)] order by item_id) as idx from k group by task, number""")
def mc_collate(spark, d):
    """Batches of 32 items of a task: their choices, and their index struct (item, label) as arrays."""
    c = F.array(F.array(F.char_length("text_a"), F.coalesce(F.char_length("text_b"), F.lit(0))), F.array(F.char_length("task"), F.lit(0))).cast("array<array<bigint>>")
    rows = table(spark, d, "eval_items").select("task", "item_id", c.alias("c"), F.struct(F.col("item_id"), F.coalesce("label", F.lit(-100)).cast("long").alias("label")).alias("idx"))
    return tasks.collated(rows, "task", "item_id", ["c"], "idx", 32).select("task", "number", "n", F.col("c").alias("batch"), "idx")


@query("""with c as (select list_sort(list(distinct x)) as classes from (select unnest([lang, domain]) as x from source_catalog where lang = 'he') where x is not null)
select source_name, list_transform(classes, lambda x: (x = lang or x is not distinct from domain)::INT::DOUBLE) as multi_hot from source_catalog, c""")
def multi_hot(spark, d):
    rows = table(spark, d, "source_catalog").withColumn("labels", F.filter(F.array("lang", "domain"), lambda x: x.isNotNull()))
    return tasks.multi_hot(rows, "labels", F.col("lang") == "he").select("source_name", "multi_hot")


@query("""select text_a as premise_digest, text_b as hypothesis_digest, item_id, gold from (select sha256(text_a) as text_a, sha256(text_b) as text_b, item_id, label as gold from eval_items where task = (select min(task) from eval_items) and split = 'validation')""")
def task_dataset(spark, d):
    """One task's validation examples with its text columns first and its label under the task's own name."""
    items = table(spark, d, "eval_items")
    task = items.agg(F.min("task")).first()[0]
    rows = tasks.renamed_labels(tasks.task_rows(items.withColumnsRenamed({"text_a": "premise", "text_b": "hypothesis"}), task, "validation", tasks.task_columns("mnli")), {"label": "gold"})
    return rows.select(F.sha2("premise", 256).alias("premise_digest"), F.sha2("hypothesis", 256).alias("hypothesis_digest"), "item_id", "gold")


@query("select distinct task, seed, upper(task) || '(seed=' || seed || ')' as label from eval_results")
def job_labels(spark, d):
    return table(spark, d, "eval_results").select("task", "seed", tasks.job_label(F.col("task"), F.col("seed")).alias("label")).distinct()


@query("select item_id, upper(lang) as lang_name, upper(coalesce(task, '')) as task_name from eval_items")
def label_maps(spark, d):
    ids, _ = tasks.label_maps(F.array("lang", "task"))
    return table(spark, d, "eval_items").select("item_id", F.try_element_at(ids, F.lit(0)).alias("lang_name"), F.try_element_at(ids, F.lit(1)).alias("task_name"))


_NAME = r"'^([a-z0-9]+)-([a-z]+)-v([0-9]+)-ba([0-9]+)_task=(.+)_seed=([0-9]+)$'"
_PARSED = f"""(select run_id, state, metric, score, regexp_extract(name, {_NAME}, 1) as model, regexp_extract(name, {_NAME}, 2) as size, regexp_extract(name, {_NAME}, 3)::INTEGER as version,
regexp_extract(name, {_NAME}, 4)::BIGINT as step, regexp_extract(name, {_NAME}, 5) as task, regexp_extract(name, {_NAME}, 6)::INTEGER as seed from tracker_runs where regexp_matches(name, {_NAME}))"""


@query(f"select run_id, model, size, version, step, task, seed from {_PARSED}")
def parse_run_name(spark, d):
    return _runs(spark, d).select("run_id", "model", "size", "version", "step", "task", "seed")


def _runs(spark, d):
    runs = table(spark, d, "tracker_runs")
    return runs.select("run_id", "state", F.col("metric"), "score", *tasks.run_name(F.col("name"))).where("model is not null")


@query("""select run_id, nullif(regexp_extract(name, '(?:^|_)task=(.*?)(?:_(?:task|seed)=|$)', 1), '') as task, nullif(regexp_extract(name, '(?:^|_)seed=(.*?)(?:_(?:task|seed)=|$)', 1), '') as seed from tracker_runs""")
def parse_kv(spark, d):
    return table(spark, d, "tracker_runs").select("run_id", *tasks.key_values(F.col("name"), ["task", "seed"]))


@query("select rec_id, replace(regexp_replace('/' || _source, '^/+', ''), '/', '|') as name from corpus_records")
def path_to_name(spark, d):
    return table(spark, d, "corpus_records").select("rec_id", tasks.path_to_name(F.concat(F.lit("/"), "_source")).alias("name"))


@query("select run_id, regexp_replace(string_split(name, '/')[-1], '-ba[0-9]+.*$', '') as folder, nullif(regexp_extract(name, '-ba([0-9]+)', 1), '')::BIGINT as ba from tracker_runs")
def artifact_parse(spark, d):
    return table(spark, d, "tracker_runs").select("run_id", tasks.artifact_folder(F.col("name")).alias("folder"), tasks.artifact_batch(F.col("name")).alias("ba"))


@query("select rec_id, sha256(text) as digest, sha256(text) = guid as agrees from corpus_records")
def text_guid(spark, d):
    return table(spark, d, "corpus_records").select("rec_id", F.sha2("text", 256).alias("digest"), (F.sha2("text", 256) == F.col("guid")).alias("agrees"))


@query("""with s as (select unnest(range(0, 10001, 10)) as step), k as (select 2500 * (1 - pi()) / pi() as beta, 0.5 * sqrt(2500 + 2500 * (1 - pi()) / pi()) as alpha)
select step, round(1 + (0.1 - 1) * step / 10000.0::DOUBLE, 9) as linear, round((1 + cos(step / 10000.0::DOUBLE * pi())) / 2, 9) as cosine, round(1 / sqrt(step + 1.0::DOUBLE), 9) as inverse_sqrt,
round(case when step < 500 then 1e-10 + (1 - 1e-10) * step / 500.0::DOUBLE when step < 9000 then 1 else greatest(0.0::DOUBLE, 1 - (step - 9000) / 1000.0::DOUBLE * 0.9) end, 9) as wsd,
round(case when step <= 9000 then 1 else 0.1 + 0.9 * (1 - sqrt((step - 9000) / 1000.0::DOUBLE)) end, 9) as one_minus_sqrt,
round(case when step < 500 then step / 500.0::DOUBLE when step >= 9000 then alpha / sqrt(8500 + beta) * (1 - (step - 9000) / 1000.0::DOUBLE)
when step - 500 <= 2500 then (1 + cos((step - 500) / 5000.0::DOUBLE * pi())) / 2 else alpha / sqrt(step - 500 + beta) end, 9) as cosine_inverse_sqrt from s, k""")
def lr_curve(spark, d):
    s = F.col("step")
    return spark.range(0, 10001, 10).select(F.col("id").alias("step")).select(
        "step", F.round(tasks.linear(s / 10000.0, 1.0, 0.1), 9).alias("linear"), F.round(tasks.cosine(s / 10000.0), 9).alias("cosine"), F.round(tasks.inverse_sqrt(s, 1.0, 1.0), 9).alias("inverse_sqrt"),
        F.round(tasks.warmup_stable_decay(s, 500, 1000, 10000), 9).alias("wsd"), F.round(tasks.one_minus_sqrt(s, 1000, 10000), 9).alias("one_minus_sqrt"),
        F.round(tasks.cosine_inverse_sqrt(s, 500, 2500, 1000, 10000), 9).alias("cosine_inverse_sqrt"),
    )


@query("select tokens, least(160000, 10000 + (tokens // 66666666) * 10000)::BIGINT as theta from (select unnest(range(0, 1500000001, 1000000)) as tokens)")
def rope_theta(spark, d):
    return spark.range(0, 1_500_000_001, 1_000_000).select(F.col("id").alias("tokens"), tasks.rope_theta(F.col("id"), 10_000, 160_000, 1_000_000_000).alias("theta"))


# --- metrics over predictions ---

_P = "(select distinct * from predictions where label is not null and pred is not null)"


def _predictions(spark, d):
    return table(spark, d, "predictions").where("label is not null and pred is not null").dropDuplicates()


@query(f"""select task, round(avg((label = pred)::INT), 6) as accuracy, round(2 * sum((label = 1 and pred = 1)::INT) / nullif(2 * sum((label = 1 and pred = 1)::INT) + sum(((label = 1) <> (pred = 1))::INT), 0)::DOUBLE, 6) as f1,
round(avg((label - score) * (label - score)), 6) as mse from {_P} group by task""")
def metric_accuracy(spark, d):
    lab, pred = F.col("label"), F.col("pred")
    return _predictions(spark, d).groupBy("task").agg(F.round(metrics.accuracy(lab, pred), 6).alias("accuracy"), F.round(metrics.f1(lab, pred), 6).alias("f1"), F.round(metrics.mse(lab, F.col("score")), 6).alias("mse"))


@query(f"""with t as (select task, sum((label = 1 and pred = 1)::INT)::DOUBLE as tp, sum((label = 0 and pred = 0)::INT)::DOUBLE as tn, sum((label = 0 and pred = 1)::INT)::DOUBLE as fp, sum((label = 1 and pred = 0)::INT)::DOUBLE as fn from {_P} group by task)
select task, round(coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) as mcc from t""")
def metric_mcc(spark, d):
    return metrics.matthews(_predictions(spark, d), ["task"]).select("task", F.round("mcc", 6).alias("mcc"))


@query(f"""with r as (select task, rank() over (partition by task order by label) + (count(*) over (partition by task, label) - 1) / 2.0 as a,
rank() over (partition by task order by score) + (count(*) over (partition by task, score) - 1) / 2.0 as b from {_P} where score is not null)
select task, round(corr(a, b), 6) as spearman from r group by task""")
def metric_spearman(spark, d):
    return metrics.spearman(_predictions(spark, d).where("score is not null"), ["task"], "label", "score").select("task", F.round("spearman", 6).alias("spearman"))


@query(f"""with r as (select task, label, rank() over (partition by task order by score) + (count(*) over (partition by task, score) - 1) / 2.0 as r from {_P} where score is not null),
s as (select task, sum(label) as np, count(*) - sum(label) as nn, sum(case when label = 1 then r else 0 end) as top from r group by task)
select task, round((top - np * (np + 1) / 2.0) / nullif(np * nn, 0)::DOUBLE, 6) as auroc from s""")
def metric_auroc(spark, d):
    return metrics.auroc(_predictions(spark, d).where("score is not null"), ["task"], "label", "score").select("task", F.round("auroc", 6).alias("auroc"))


@query(f"""with p as {_P}, c as (select distinct task, label as c from p union select distinct task, pred from p),
f as (select c.task, c.c, 2 * sum((label = c.c and pred = c.c)::INT) / (sum((label = c.c)::INT) + sum((pred = c.c)::INT))::DOUBLE as f1 from c join p on p.task = c.task group by 1, 2)
select task, round(accuracy, 6) as accuracy, round(macro_f1, 6) as macro_f1 from (select task, avg((label = pred)::INT) as accuracy from p group by task) join (select task, avg(f1) as macro_f1 from f group by task) using (task)""")
def metric_cb(spark, d):
    return metrics.macro_f1(_predictions(spark, d), ["task"]).select("task", F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1"))


@query(f"""with p as (select * from {_P} where task = 'multirc' and paragraph is not null)
select round(2 * sum((label = 1 and pred = 1)::INT) / (2 * sum((label = 1 and pred = 1)::INT) + sum(((label = 1) <> (pred = 1))::INT))::DOUBLE, 6) as f1_a,
round((select avg(ok) from (select min((label = pred)::INT) as ok from p group by paragraph, question)), 6) as em from p""")
def metric_multirc(spark, d):
    rows = _predictions(spark, d).where("task = 'multirc' and paragraph is not null")
    return metrics.multirc(rows).select(F.round("f1_a", 6).alias("f1_a"), F.round("em", 6).alias("em"))


@query("select task, round(avg((label = pred)::INT) filter (label <> -100), 6) as masked_accuracy, count(*) as n from (select task, pred, coalesce(label, -100) as label from (select distinct * from predictions where pred is not null)) group by task")
def metric_masked_acc(spark, d):
    rows = table(spark, d, "predictions").where("pred is not null").dropDuplicates().withColumn("label", F.coalesce("label", F.lit(-100)))
    return rows.groupBy("task").agg(F.round(metrics.masked_accuracy(F.col("label"), F.col("pred")), 6).alias("masked_accuracy"), F.count("*").alias("n"))


@query("""with x as (select vec_id % 3 as part, list_transform(range(0, len(embedding)), lambda i: ((vec_id + i) % 5 = 0)::INT) as t, list_transform(embedding, lambda x: (1 / (1 + exp(-x::DOUBLE)) >= 0.5)::INT) as p from embeddings),
u as (select part, unnest(t) as t, unnest(p) as p from x)
select part, round(avg((t = p)::INT), 6) as ml_accuracy, round(2 * sum((t = 1 and p = 1)::INT) / (2 * sum((t = 1 and p = 1)::INT) + sum((t <> p)::INT))::DOUBLE, 6) as ml_f1 from u group by part""")
def metric_multilabel(spark, d):
    """Micro accuracy and F1 over all labels of a row's vector, scores by the logistic function, at a threshold of 0.5."""
    labels = F.transform("embedding", lambda _, i: ((F.col("vec_id") + i) % 5 == 0).cast("int"))
    scores = F.transform("embedding", lambda x: 1 / (1 + F.exp(-x.cast("double"))))
    rows = table(spark, d, "embeddings").select((F.col("vec_id") % 3).alias("part"), labels.alias("t"), scores.alias("p"))
    return metrics.multilabel(rows, ["part"], "t", "p").select("part", F.round("accuracy", 6).alias("ml_accuracy"), F.round("f1", 6).alias("ml_f1"))


@query("""with x as (select vec_id % 3 as part, case when vec_id % 7 = 0 then -100 else label end as label, embedding[1:10]::DOUBLE[] as e from embeddings)
select part, round(avg((list_position(e, list_max(e)) - 1 = label)::INT) filter (label <> -100), 6) as accuracy, round(avg(ln(list_sum(list_transform(e, lambda v: exp(v)))) - e[label + 1]) filter (label <> -100), 6) as cross_entropy from x group by part""")
def metric_logits(spark, d):
    """Accuracy of the largest logit and cross-entropy, labels of -100 ignored; the first ten numbers of a vector are the logits of its label."""
    label = F.when(F.col("vec_id") % 7 == 0, -100).otherwise(F.col("label"))
    rows = table(spark, d, "embeddings").select((F.col("vec_id") % 3).alias("part"), label.alias("label"), F.slice("embedding", 1, 10).alias("e"))
    return rows.groupBy("part").agg(
        F.round(metrics.masked_accuracy(F.col("label"), metrics.argmax(F.col("e"))), 6).alias("accuracy"), F.round(metrics.cross_entropy(F.col("e"), F.col("label")), 6).alias("cross_entropy")
    )


@query(f"select task, round(corr(label, score), 6) as pearson from {_P} where score is not null group by task")
def metric_pearson(spark, d):
    return _predictions(spark, d).where("score is not null").groupBy("task").agg(F.round(metrics.pearson(F.col("label"), F.col("score")), 6).alias("pearson"))


_TASK_SQL = ", ".join(f"('{t}', '{m}')" for t, ms in tasks.TASK_METRICS.items() for m in ms)


@query(f"""with p as {_P}, want(task, metric) as (values {_TASK_SQL}),
t as (select task, avg((label = pred)::INT) as accuracy, 2 * sum((label = 1 and pred = 1)::INT) / nullif(2 * sum((label = 1 and pred = 1)::INT) + sum(((label = 1) <> (pred = 1))::INT), 0)::DOUBLE as f1,
  sum((label = 1 and pred = 1)::INT)::DOUBLE as tp, sum((label = 0 and pred = 0)::INT)::DOUBLE as tn, sum((label = 0 and pred = 1)::INT)::DOUBLE as fp, sum((label = 1 and pred = 0)::INT)::DOUBLE as fn from p group by task),
r as (select task, rank() over (partition by task order by label) + (count(*) over (partition by task, label) - 1) / 2.0 as a, rank() over (partition by task order by score) + (count(*) over (partition by task, score) - 1) / 2.0 as b from p where score is not null),
c as (select distinct task, label as c from p union select distinct task, pred from p),
f as (select c.task, c.c, 2 * sum((label = c.c and pred = c.c)::INT) / (sum((label = c.c)::INT) + sum((pred = c.c)::INT))::DOUBLE as f1 from c join p on p.task = c.task group by 1, 2),
v as (select task, 'accuracy' as metric, accuracy as value from t union all select task, 'f1', f1 from t
  union all select task, 'mcc', coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0) from t
  union all select task, 'spearman', corr(a, b) from r group by task union all select task, 'macro_f1', avg(f1) from f group by task)
select task, metric, round(value, 6) as value from v join want using (task, metric)""")
def task_metrics(spark, d):
    """Each task by the metrics of the task registry."""
    return metrics.task_scores(_predictions(spark, d), "task", tasks.TASK_METRICS).select("task", "metric", F.round("value", 6).alias("value"))


@query(f"select task, round(avg(loss), 6) as batch_mean_loss, count(*) as batches from (select task, example_id // 32 as batch, avg((label - score) * (label - score)) as loss from {_P} where score is not null group by 1, 2) group by task")
def batch_mean_loss(spark, d):
    batches = _predictions(spark, d).where("score is not null").groupBy("task", F.expr("example_id div 32").alias("batch")).agg(metrics.mse(F.col("label"), F.col("score")).alias("loss"))
    return batches.groupBy("task").agg(F.round(F.avg("loss"), 6).alias("batch_mean_loss"), F.count("*").alias("batches"))


# --- retrieval ---


@query("""select query_id, vec_id, rank, round(score, 6) as score from (select q.vec_id as query_id, v.vec_id, list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) as score,
row_number() over (partition by q.vec_id order by round(list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) desc, v.vec_id)::INTEGER as rank from embeddings q, embeddings v where q.vec_id % 20 = 0) where rank <= 10""")
def vector_topk(spark, d):
    """The queries are the rows whose id is divisible by 20; every row is searched."""
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    q = v.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    return metrics.search(v, q, 10).select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


@query("""select query_id, vec_id, rank, round(score, 6) as score from (select q.vec_id as query_id, v.vec_id, list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) as score,
row_number() over (partition by q.vec_id order by round(list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) desc, v.vec_id)::INTEGER as rank from embeddings q, embeddings v where q.vec_id % 20 = 0) where rank <= 10""")
def index_all_cells(spark, d):
    """vector_topk through the cell index with every cell searched, which is exact."""
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    cells = index.build(v, "vec_id", "embedding", 16)
    found = index.search(cells, v.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), 10, 16)
    return found.select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


@query("select true as enough, (select count(*) from embeddings where vec_id % 20 = 0) * 10 as exact_neighbours")
def index_recall(spark, d):
    """Whether 12 of 16 cells hold at least nine in ten of the exact ten neighbours of all queries, and how many these are (vectors without clusters need that many)."""
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    q = v.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    exact = metrics.search(v, q, 10)
    share = index.recall(index.search(index.build(v, "vec_id", "embedding", 16), q, 10, 12), exact)
    return exact.agg(F.lit(share >= 0.9).alias("enough"), F.count("*").alias("exact_neighbours"))


@query()
def late_interaction(spark, d):
    """Queries of twenty token vectors against labels as documents, through cells and candidates."""
    e = table(spark, d, "embeddings")
    q = e.select(F.expr("vec_id div 20 * 20").alias("query_id"), (F.col("vec_id") % 20).alias("token"), F.col("embedding").alias("vector"))
    docs = e.select(F.col("label").alias("doc_id"), F.expr("vec_id div 10").alias("token"), F.col("embedding").alias("vector"))
    return index.late_interaction(docs, q, 16, 8).withColumn("score", F.round("score", 6))


@query("""with n as (select label, min(vec_id) as a from embeddings group by label), p as (select e.vec_id, e.label, e.embedding, n.a, (e.label + 1) % 10 as other from embeddings e join n using (label) where e.vec_id <> n.a)
select p.label, count(*) as triplets, round(avg((list_inner_product(p.embedding::DOUBLE[], x.embedding::DOUBLE[]) > list_inner_product(p.embedding::DOUBLE[], y.embedding::DOUBLE[]))::INT), 6) as accuracy
from p join embeddings x on x.vec_id = p.a join n on n.label = p.other join embeddings y on y.vec_id = n.a group by p.label""")
def triplet_accuracy(spark, d):
    """Each row against the first row of its label (positive) and of the next label (negative)."""
    e = table(spark, d, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("pos"), F.min("vec_id").alias("first_id"))
    neg = first.select(F.col("label").alias("other"), F.col("pos").alias("neg"))
    rows = lookup_join(e, first, "label", "inner").where("vec_id <> first_id").withColumn("other", F.pmod(F.col("label") + 1, F.lit(10)))
    rows = lookup_join(rows, neg, "other", "inner")
    hit = (metrics.dot(F.col("embedding"), F.col("pos")) > metrics.dot(F.col("embedding"), F.col("neg"))).cast("double")
    return rows.groupBy("label").agg(F.count("*").alias("triplets"), F.round(F.avg(hit), 6).alias("accuracy"))


@query("""with s as (select q.vec_id as query_id, q.label as ql, v.vec_id, v.label, row_number() over (partition by q.vec_id order by round(list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) desc, v.vec_id) as rank
from embeddings q, embeddings v where q.vec_id % 20 = 0), i as (select query_id, sum(1 / log2(k + 1)) as ideal from (select query_id, row_number() over (partition by query_id) as k from s where label = ql) where k <= 10 group by 1)
select query_id, round(sum((label = ql)::INT / log2(rank + 1)) / any_value(ideal), 6) as ndcg from s join i using (query_id) where rank <= 10 group by query_id""")
def ndcg_at_10(spark, d):
    """Rows of the query's label are relevant."""
    v = table(spark, d, "embeddings")
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.col("label").alias("ql"))
    run = metrics.search(v.select("vec_id", "embedding"), q.select("query_id", "embedding"), 10).withColumnRenamed("vec_id", "doc_id")
    relevant = lookup_join(v.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("ql")), q.select("query_id", "ql"), "ql", "inner").select("query_id", "doc_id", F.lit(1).alias("rel"))
    return metrics.ndcg(run, relevant, 10).select("query_id", F.round("ndcg", 6).alias("ndcg"))


@query("""with t as (select (vec_id // 20) * 20 as query_id, vec_id, label as doc_id, embedding::DOUBLE[] as e from embeddings),
s as (select a.query_id, a.vec_id, b.doc_id, max(list_inner_product(a.e, b.e)) as best from t a, t b group by 1, 2, 3)
select query_id, doc_id, round(sum(best), 6) as score from s group by 1, 2""")
def maxsim_exact(spark, d):
    """Each twenty rows are a query's token vectors; documents are the labels, each row being a token vector of its label. All queries against all documents."""
    e = table(spark, d, "embeddings")
    q = e.select(F.expr("vec_id div 20 * 20").alias("query_id"), F.col("embedding").alias("vector"))
    return metrics.maxsim(q, e.select(F.col("label").alias("doc_id"), F.col("embedding").alias("vector"))).withColumn("score", F.round("score", 6))


# --- rollups over runs ---


@query("""with m as (select task, avg(value) * 100 as mean from (select distinct * from eval_results where value is not null) group by task),
s as (select case when task in ('mnli','qnli','qqp','rte','sst2','mrpc','cola','stsb') then 'glue' when task in ('boolq','cb','copa','multirc','wic') then 'superglue' when task in ('heb_nli','heb_qa') then 'hebrew' end as suite, mean from m)
select suite, count(*) as tasks, round(avg(mean), 4) as mean from s where suite is not null group by suite""")
def suite_rollup(spark, d):
    return rollup.suite_means(rollup.task_means(table(spark, d, "eval_results"), []), []).select("suite", "tasks", F.round("mean", 4).alias("mean"))


@query("""with p as (select *, coalesce(nullif(regexp_extract(name, 'ba([0-9]+)', 1), '')::BIGINT, -1) as ba, coalesce(nullif(regexp_extract(name, 'ep([0-9]+)', 1), '')::BIGINT, -1) as ep from tracker_runs)
select state, metric, name, ba as batch from (select *, row_number() over (partition by state, metric order by ep desc, ba desc, name) as r from p) where r = 1""")
def latest_checkpoint(spark, d):
    return rollup.latest_checkpoint(table(spark, d, "tracker_runs").select("state", "metric", "name"), ["state", "metric"], "name")


@query(f"select model, size, step, task, metric, round(avg(score), 6) as mean, count(distinct seed) as seeds from {_PARSED} where state = 'finished' and score is not null group by 1, 2, 3, 4, 5")
def live_eval_agg(spark, d):
    return rollup.live_means(_runs(spark, d).where("state = 'finished'"), ["model", "size", "step", "task", "metric"]).withColumn("mean", F.round("mean", 6))


@query(f"""with r as (select *, step // 20000 as bucket from {_PARSED} where state = 'finished' and score is not null), m as (select model, size, bucket, task, avg(score) as mean, count(distinct seed) as seeds from r group by 1, 2, 3, 4),
k as (select model, size, bucket, count(distinct task) filter (task in ('rte', 'copa') and seeds >= 1) < 2 as bad from m group by 1, 2, 3),
w as (select *, bool_or(bad) over (partition by model, size order by bucket rows unbounded preceding) as stop from k)
select m.model, m.size, m.bucket, m.task, round(m.mean, 6) as mean, m.seeds from m join w using (model, size, bucket) where not stop""")
def live_eval_prefix(spark, d):
    runs = _runs(spark, d).where("state = 'finished'").withColumn("bucket", F.expr("step div 20000"))
    means = rollup.live_means(runs, ["model", "size", "bucket", "task"])
    return rollup.complete_prefix(means, ["model", "size"], "bucket", "task", ["rte", "copa"], 1).select("model", "size", "bucket", "task", F.round("mean", 6).alias("mean"), "seeds")


@query("""with j as (select distinct job, regexp_extract(job, '-ba([0-9]+)_', 1) as ba from eval_results), c as (select distinct job, ba from j)
select r.job, r.task, r.metric, round(r.value, 6) as value, c.ba from (select distinct * from eval_results) r join c on c.job = r.job""")
def result_config_join(spark, d):
    results = table(spark, d, "eval_results").dropDuplicates()
    configs = results.select("job", F.regexp_extract("job", "-ba([0-9]+)_", 1).alias("ba")).distinct()
    return results.join(configs, "job").select("job", "task", "metric", F.round("value", 6).alias("value"), "ba")


@query(f"""with p as {_PARSED}, parents as (select model, size, version, 'run' || run_id as checkpoint, seed, step from p where task = 'mnli' and state = 'finished'),
f as (select model, size, version, checkpoint from (select *, row_number() over (partition by model, size, version order by seed, step desc) as r from parents) where r = 1)
select run_id, task, coalesce(f.checkpoint, 'base') as start from p left join f using (model, size, version) where task in ('rte', 'stsb')""")
def round2_start(spark, d):
    runs = _runs(spark, d)
    parents = runs.where("task = 'mnli' and state = 'finished'").select("model", "size", "version", F.concat(F.lit("run"), "run_id").alias("checkpoint"), F.col("seed").alias("job_order"), F.col("step").alias("position"))
    return rollup.start_points(runs.where(F.col("task").isin("rte", "stsb")), parents, ["model", "size", "version"], "base").select("run_id", "task", "start")


@query("""with x as (select job, task, metric, max(value) as value from eval_results where value is not null group by job, task, metric)
select job, task, last(metric order by metric) as metric, round(last(value order by metric), 6) as value from x group by job, task""")
def collect_metrics(spark, d):
    """The last metric of each evaluation set; of repeated values of a metric the largest."""
    rows = table(spark, d, "eval_results").where("value is not null").groupBy("job", "task", "metric").agg(F.max("value").alias("value"))
    return rollup.last_metric(rows, ["job", "task"], F.col("metric")).withColumn("value", F.round("value", 6))


@query("""with ids as (select vec_id // 32 as kd_id, list(vec_id order by vec_id) as ids from embeddings group by 1)
select kd_id, list(sha256(coalesce(text, '')) order by i) as texts from (select kd_id, ids[i] + 1 as doc_id, i from (select *, unnest(range(1, len(ids) + 1)) as i from ids)) join documents using (doc_id) group by kd_id""")
def kd_lookup(spark, d):
    """Lists of at most 32 document ids resolved to their texts, in the lists' order."""
    groups = table(spark, d, "embeddings").groupBy(F.expr("vec_id div 32").alias("kd_id")).agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    flat = groups.select("kd_id", F.posexplode("ids").alias("i", "v")).select("kd_id", "i", (F.col("v") + 1).alias("doc_id"))
    texts = table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("t"))
    found = lookup_join(texts, flat, "doc_id", "inner")
    return found.groupBy("kd_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "t"))), lambda x: x["t"]).alias("texts"))
