"""Problem 2: tokens by source, language and domain under an existing tokenizer.

The tokenizer is loaded once per worker, texts are encoded in batches, and exact counts
are summed over the cube of source, language and domain.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tokenizers
from ..functions.names import canonical_source
from ..plans.shared import lookup_join, materialise

#: Folder of the public tokenizer files, and the file used by default; both are parameters.
TOKENIZER_DIR, TOKENIZER = tokenizers.FOLDER, tokenizers.DEFAULT


def counter(path: str) -> Callable[[list[str]], list[int]]:
    """A function from texts to token counts, from a tokenizer file on this machine."""
    with open(path, "rb") as f:
        encode = tokenizers.TokenizerFile(path.rsplit(".", 1)[-1], f.read()).encoder()
    return lambda texts: [len(ids) for ids in encode(texts)]


def with_token_counts(df: DataFrame, keep: list[str], tokenizer: str = TOKENIZER, folder: str = TOKENIZER_DIR, text: str = "text", pattern: str = tokenizers.PATTERN) -> DataFrame:
    """keep columns and n_tokens of each text; a null text has null tokens, an empty one none."""
    return tokenizers.token_counts(df, keep, tokenizers.read_tokenizer(df.sparkSession, tokenizer, folder, pattern), text)


def record_tokens(records: DataFrame, catalog: DataFrame, tokenizer: str = TOKENIZER, folder: str = TOKENIZER_DIR) -> DataFrame:
    """rec_id, source, lang, domain, n_chars, n_tokens: each record once, under its true source.

    records: rec_id, _source, text; catalog: source_name, lang, domain; other columns are
    not read. Sources the catalogue lacks have null lang and domain; a null source stays
    null; a null text has null counts, an empty one 0; rows without an id are left out.
    """
    base = records.where("rec_id is not null").select("rec_id", canonical_source(F.col("_source")).alias("source"), F.char_length("text").cast("long").alias("n_chars"), "text")
    counted = with_token_counts(base, ["rec_id", "source", "n_chars"], tokenizer, folder)
    once = counted.groupBy("rec_id").agg(F.max("source").alias("source"), F.max("n_chars").alias("n_chars"), F.max("n_tokens").alias("n_tokens"))
    names = catalog.select(canonical_source(F.col("source_name")).alias("source"), "lang", "domain").where("source is not null").dropDuplicates(["source"])
    return lookup_join(once, names, "source")


def budget(counted: DataFrame) -> DataFrame:
    """The cube of source, lang and domain over record_tokens: records, records with text, characters, tokens, share of all tokens.

    grouping tells which columns a row is summed over (bits of source, lang, domain).
    """
    counted = materialise(counted.select("source", "lang", "domain", "n_chars", "n_tokens"), "tokens")
    cube = counted.cube("source", "lang", "domain").agg(
        F.grouping_id().alias("grouping"), F.count("*").alias("records"), F.count("n_tokens").alias("with_text"),
        F.coalesce(F.sum("n_chars"), F.lit(0)).alias("n_chars"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"),
    )
    whole = counted.agg(F.sum("n_tokens")).first()[0]
    return cube.withColumn("token_share", F.round(F.try_divide(F.col("n_tokens"), F.lit(whole).cast("long")), 6))
