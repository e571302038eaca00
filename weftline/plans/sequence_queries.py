"""Queries of the sequence and packing operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.texts import tokens, tokens_sql
from ..functions import tokenizers
from ..operators import driver, packing
from ..operators import sequences as seq
from ..sources import sinks
from .shared import scratch, table

QUERIES, SQL = {}, {}
TOK = tokens_sql("text")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _docs(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", "lang", tokens(F.col("text")).alias("t"))


def _digest(c):
    return F.md5(F.array_join(c, " ", "-")).alias("digest")


@query(f"""select doc_id, md5(array_to_string(list_resize(list_concat(list_concat(['[CLS]'], t[1:62]), ['[SEP]']), 64, '[PAD]'), ' ')) as digest from (select doc_id, {TOK} as t from documents where text is not null)""")
def tokenize_trunc_pad(spark, d):
    return _docs(spark, d).select("doc_id", _digest(seq.truncate_pad(seq.with_specials(F.col("t"), F.lit("[CLS]"), F.lit("[SEP]"), 64), 64, F.lit("[PAD]"))))


@query(f"select doc_id, len({TOK}) as n, least(len({TOK}) + 2, 8192) as n_with_specials from documents where text is not null")
def token_count(spark, d):
    n = F.size("t").cast("long")
    return _docs(spark, d).select("doc_id", n.alias("n"), F.least(n + 2, F.lit(8192)).alias("n_with_specials"))


@query()
def tokenize_ids(spark, d):
    """Ids of a public tokenizer between bos and eos, cut and padded to 128."""
    docs = table(spark, d, "documents").where("text is not null")
    return tokenizers.token_ids(docs, ["doc_id"], tokenizers.read_tokenizer(spark), bos=50256, eos=50256, length=128, pad=50257, padded=True)


@query()
def token_id_counts(spark, d):
    """Tokens of a public tokenizer, with two specials and at most 8192 of them, and bare."""
    docs = table(spark, d, "documents").where("text is not null")
    bare = tokenizers.token_counts(docs, ["doc_id"], tokenizers.read_tokenizer(spark))
    return bare.select("doc_id", F.col("n_tokens").alias("n"), F.least(F.col("n_tokens") + 2, F.lit(8192)).alias("n_with_specials"))


@query()
def tokenize_write(spark, d):
    """Whole texts' ids written as shards and read back."""
    docs = table(spark, d, "documents").where("text is not null")
    ids = tokenizers.token_ids(docs, ["doc_id"], tokenizers.read_tokenizer(spark))
    written = sinks.write_shards(ids, scratch(spark, "ids"), ["doc_id", "input_ids"], 10_000)
    return written.select("doc_id", F.size("input_ids").cast("long").alias("n"), F.aggregate("input_ids", F.lit(0).cast("long"), lambda s, x: s + x).alias("checksum"))


@query(f"""with t as (select doc_id, {TOK} as t from documents where text is not null),
b as (select doc_id, case when t[1] is not distinct from 'The' then t else list_concat(['The'], t) end as t from t)
select doc_id, md5(array_to_string(case when t[-1] = '</s>' then t else list_concat(t[1:127], ['</s>']) end, ' ')) as digest from b""")
def ensure_bos_eos(spark, d):
    return _docs(spark, d).select("doc_id", _digest(seq.ensure_bounds(F.col("t"), F.lit("The"), F.lit("</s>"), 128)))


_CHUNKS = """with k as (select doc_id, {by} as g, list_concat(list_concat(['{bos}'], {tok}), ['{eos}']) as t from documents where text is not null),
o as (select *, (sum(len(t)) over (partition by g order by doc_id rows unbounded preceding) - len(t))::BIGINT as off from k),
x as (select g, off + i as p, t[i + 1] as w from (select g, off, t, unnest(range(0, len(t))) as i from o)),
c as (select g, p // {n} as chunk, string_agg(w, ' ' order by p) as s, count(*) as n from x group by 1, 2)
select {sel}chunk, md5(s) as digest from c where n = {n}"""


@query(_CHUNKS.format(by="0", bos="[CLS]", eos="[SEP]", tok=TOK, n=512, sel=""))
def concat_chunk(spark, d):
    docs = _docs(spark, d).withColumn("t", seq.with_specials(F.col("t"), F.lit("[CLS]"), F.lit("[SEP]")))
    return seq.concat_chunks(docs, "doc_id", "t", 512).select("chunk", _digest(F.col("input_ids")))


@query(_CHUNKS.format(by="lang", bos="<s>", eos="</s>", tok=TOK, n=128, sel="g as lang, "))
def concat_chunk_bos_eos(spark, d):
    """Documents of null lang are a group of their own."""
    docs = _docs(spark, d).withColumn("t", seq.with_specials(F.col("t"), F.lit("<s>"), F.lit("</s>")))
    return seq.concat_chunks(docs, "doc_id", "t", 128, by=["lang"]).select("lang", "chunk", _digest(F.col("input_ids")))


@query(_CHUNKS.format(by="0", bos="[CLS]", eos="[SEP]", tok=TOK, n=512, sel="").replace("where n = 512", "where n = 512 and chunk * 512 < 50000"))
def concat_chunk_budget(spark, d):
    """Only the chunks that begin before a number of tokens."""
    docs = _docs(spark, d).withColumn("t", seq.with_specials(F.col("t"), F.lit("[CLS]"), F.lit("[SEP]")))
    return seq.concat_chunks(docs, "doc_id", "t", 512, most_tokens=50_000).select("chunk", _digest(F.col("input_ids")))


@query(f"""with recursive k as (select doc_id, lang, {TOK} as t, row_number() over (partition by lang order by doc_id) as r from documents where text is not null and len({TOK}) > 0),
s(lang, r, buf, done) as (select lang, 0::BIGINT, []::VARCHAR[], null::VARCHAR[] from (select distinct lang from k)
union all select s.lang, k.r, case when len(s.buf) + len(k.t) >= 1024 then [] else list_concat(s.buf, k.t) end, case when len(s.buf) + len(k.t) >= 1024 then list_concat(s.buf, k.t)[1:1024] end
from s join k on k.lang is not distinct from s.lang and k.r = s.r + 1)
select lang, row_number() over (partition by lang order by r) - 1 as chunk, md5(array_to_string(done, ' ')) as digest from s where done is not null""")
def concat_nowrap(spark, d):
    """Documents of null lang are a stream of their own."""
    return packing.concat_nowrap(_docs(spark, d), "lang", "doc_id", "t", 1024).select("lang", "chunk", _digest(F.col("input_ids")))


def _id_docs(spark, d):
    ids = F.transform("t", lambda w: F.char_length(w).cast("long") + 5)
    return _docs(spark, d).select((F.pmod("doc_id", F.lit(8))).cast("int").alias("rank"), "doc_id", ids.alias("ids"))


PACK = packing.PackConfig(source_batch=16, bins=8, width=1024, buffer_size=128, pad=0, mask=4, mask_prob=0.3)


@query()
def pack_best_fit(spark, d):
    """Every rank packs and masks its share of the documents; the last batch is kept."""
    return packing.pack_best_fit(_id_docs(spark, d), "rank", "doc_id", "ids", packing.PackConfig(**{**PACK.__dict__, "drop_last": False}))


@query()
def split_packed(spark, d):
    return packing.split_packed(pack_best_fit(spark, d), 2, 0.2, 0)


@query(f"""with n as (select doc_id % 8 as rank, len({TOK}) as n from documents where text is not null)
select rank::INTEGER as rank, sum(n)::BIGINT as tokens, 0::BIGINT as loose_rows from n where n > 0 group by 1""")
def split_tokens(spark, d):
    """Tokens of each rank's micro-batches, and rows that kept more than a fifth of pads (none)."""
    real = F.aggregate("attention_mask", F.lit(0).cast("long"), lambda s, x: s + x)
    loose = F.size("input_ids") - real > F.size("input_ids") * F.lit(0.2)
    return split_packed(spark, d).groupBy("rank").agg(F.sum(real).alias("tokens"), F.sum(loose.cast("long")).alias("loose_rows"))


@query("""with b as (select unnest(range(32, 128)) as b), w as (select b, 1 + b - 32 as k, sum(b) over (order by b rows unbounded preceding) as c, (select sum(x) from (select unnest(range(32, 128)) as x)) as s from b),
t as (select k, ceil(ceil(1000000 / 4.0) / s * c)::BIGINT as reached from w)
select step, 32 + (select count(*) from t where reached <= step) as batch_size from (select unnest(range(0, 5001)) * 60 as step)""")
def batch_warmup(spark, d):
    return spark.range(5001).select((F.col("id") * 60).alias("step")).select("step", seq.warmup_batch_size(F.col("step"), 32, 128, 1_000_000, 4).cast("long").alias("batch_size"))


_DRAW = "((({x} * {x} + 12345 + {i}) % 2147483647) * 630360016 + {x}) % 2147483647 / 2147483647.0::DOUBLE"
_START = "((doc_id % 2147483647) * 48271 + {i} * 69621 + {salt} * 16807 + 1) % 2147483647"


@query(f"""with x as (select doc_id, i - 1 as i, length(t[i]) + 5 as x from (select doc_id, t, unnest(range(1, len(t) + 1)) as i from (select doc_id, {TOK} as t from documents where text is not null))),
s as (select *, {_START.format(i="i", salt=42)} as a, {_START.format(i="i", salt=43)} as b from x),
u as (select *, {_DRAW.format(x="a", i="i")} as u, floor({_DRAW.format(x="b", i="i")} * 3000)::BIGINT as other from s)
select doc_id, count(*) filter (u < 0.3) as chosen, sum((i + 1) * case when u >= 0.3 then x when u < 0.24 then 4 when u < 0.27 then other else x end)::BIGINT as ids_sum,
sum((i + 1) * case when u < 0.3 then x else -100 end)::BIGINT as labels_sum from u group by doc_id""")
def mlm_mask(spark, d):
    """Tokens chosen, and sums over the places of the masked ids and the labels."""
    docs = seq.hash_mask(_id_docs(spark, d), "doc_id", "ids", 0.3, 4, 0, 3000, 42).where(F.size("ids") > 0)
    zero = F.lit(0).cast("long")

    def total(c):
        return F.aggregate(F.transform(c, lambda x, i: (i + 1) * x), zero, lambda s, x: s + x)

    return docs.select("doc_id", F.size(F.filter("labels", lambda x: x != seq.IGNORE)).cast("long").alias("chosen"), total("masked_ids").alias("ids_sum"), total("labels").alias("labels_sum"))


@query(f"select doc_id, list_transform(list_resize(list_transform({TOK}, lambda w: 1), 64, 0)[1:64], lambda x: x::INTEGER) as attention_mask from documents where text is not null")
def attention_mask(spark, d):
    padded = seq.truncate_pad(F.col("t"), 64, F.lit("[PAD]"))
    return _docs(spark, d).select("doc_id", seq.attention_mask(padded, F.lit("[PAD]")).alias("attention_mask"))


_SEGMENTS = """with x as (select doc_id, i, t[i] as w from (select doc_id, t, unnest(range(1, len(t) + 1)) as i from (select doc_id, {tok} as t from documents where text is not null))),
s as (select doc_id, coalesce(sum((w = 'the' or w = 'של')::INT) over (partition by doc_id order by i rows between unbounded preceding and {end}), 0)::BIGINT as sequence_id from x)
select doc_id, sequence_id, count(*) as n from s group by 1, 2"""


def _segments(spark, d, mode):
    docs = _docs(spark, d).withColumn("t", F.transform("t", lambda w: F.when(w == "של", "the").otherwise(w)))
    return seq.segment_lengths(docs, "doc_id", "t", "the", mode)


@query(_SEGMENTS.format(tok=TOK, end="current row"))
def sequence_id_bos(spark, d):
    return _segments(spark, d, "bos")


@query(_SEGMENTS.format(tok=TOK, end="1 preceding"))
def sequence_id_eos(spark, d):
    return _segments(spark, d, "eos")


@query(f"select doc_id, md5(array_to_string(list_resize({TOK}, 128, '[PAD]'), ' ')) as digest, least(len({TOK}), 128) as kept from documents where text is not null")
def pad_truncate(spark, d):
    return _docs(spark, d).select("doc_id", _digest(seq.truncate_pad(F.col("t"), 128, F.lit("[PAD]"))), F.least(F.size("t"), F.lit(128)).cast("long").alias("kept"))


def _padded(spark, d):
    docs = _docs(spark, d).select("doc_id", seq.truncate_pad(F.transform("t", lambda w: F.char_length(w).cast("long")), 128, F.lit(0).cast("long")).alias("ids"))
    return docs.withColumn("mask", seq.attention_mask(F.col("ids"), F.lit(0)))


@query(f"""with t as (select doc_id, list_transform({TOK}, lambda w: length(w))[1:128] as t, row_number() over (order by doc_id) - 1 as row from documents where text is not null),
u as (select doc_id, row, i - 1 as pos, row * 128 + i - 1 as index, t[i] as value from (select *, unnest(range(1, len(t) + 1)) as i from t))
select doc_id, row, count(*) as n, sum(index)::BIGINT as index_sum, sum((pos + 1) * value)::BIGINT as checksum from u group by 1, 2""")
def unpad(spark, d):
    rows = seq.unpad_rows(_padded(spark, d), "doc_id", "ids", "mask", width=128).where(F.size("pos") > 0)
    zero = F.lit(0).cast("long")
    weighted = F.zip_with("pos", "value", lambda p, v: (p + 1) * v)
    return rows.select("doc_id", "row", F.size("pos").cast("long").alias("n"), F.aggregate("index", zero, lambda s, x: s + x).alias("index_sum"), F.aggregate(weighted, zero, lambda s, x: s + x).alias("checksum"))


@query(f"select doc_id, least(len({TOK}), 128)::BIGINT as seqlen, (sum(least(len({TOK}), 128)) over (order by doc_id rows unbounded preceding))::BIGINT as cu_seqlen from documents where text is not null")
def cu_seqlens(spark, d):
    return seq.cumulative_lengths(_padded(spark, d), "doc_id", "mask")


@query(f"select doc_id, md5(array_to_string(list_resize(list_transform({TOK}, lambda w: length(w)), 128, 0), ' ')) as digest from documents where text is not null")
def repad(spark, d):
    rows = seq.unpad_rows(_padded(spark, d), "doc_id", "ids", "mask", numbered=False)
    return seq.repad_rows(rows, "doc_id", 128).select("doc_id", _digest(F.col("values").cast("array<string>")))


@query(f"select lang, sum(least(len({TOK}), 256))::BIGINT as real_tokens, round(sum(least(len({TOK}), 256)) / (count(*) * 256.0::DOUBLE), 6) as efficiency from documents where text is not null group by lang")
def packing_efficiency(spark, d):
    mask = seq.attention_mask(seq.truncate_pad(F.col("t"), 256, F.lit("[PAD]")), F.lit("[PAD]"))
    rows = _docs(spark, d).select("lang", F.aggregate(mask, F.lit(0).cast("long"), lambda s, x: s + x).alias("real"), F.size(mask).alias("size"))
    return rows.groupBy("lang").agg(F.sum("real").alias("real_tokens"), F.round(F.sum("real") / F.sum("size"), 6).alias("efficiency"))


@query(f"""with n as (select doc_id % 8 as rank, len({TOK}) as n from documents where text is not null)
select rank::INTEGER as rank, sum(n)::BIGINT as tokens, sum(ceil(n / 1024.0))::BIGINT as sequences from n where n > 0 group by 1""")
def packed_samples(spark, d):
    """Tokens and sequences in each rank's packed batches, without the padding segments: every piece of every document once."""
    real = F.aggregate("attention_mask", F.lit(0).cast("long"), lambda s, x: s + x)
    segments = F.size("cu_seqlens") - 1 - (real < F.size("input_ids")).cast("int")
    return pack_best_fit(spark, d).groupBy("rank").agg(F.sum(real).alias("tokens"), F.sum(segments).cast("long").alias("sequences"))


@query(f"select doc_id, len({TOK}[1:256])::BIGINT as n, coalesce(list_sum(list_transform({TOK}[1:256], lambda w: length(w) + 5)), 0)::BIGINT as checksum from documents where text is not null")
def read_pretokenized(spark, d):
    """Token ids written as bytes and read back, cut to 256."""
    raw = driver.to_bytes(_id_docs(spark, d).select("doc_id", F.col("ids").alias("input_ids")), "input_ids")
    rows = driver.pretokenized(raw, 256)
    return rows.select("doc_id", F.size("attention_mask").cast("long").alias("n"), F.aggregate("input_ids", F.lit(0).cast("long"), lambda s, x: s + x).alias("checksum"))
