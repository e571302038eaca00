"""Text expressions: white-space tokens, cleaning, hashes in the unit interval."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space between tokens, spelled out so that every engine reads it alike.
BLANKS = r"[ \t\n\r\f]+"


def tokens(text: Column) -> Column:
    """White-space tokens; null for a null text."""
    return F.filter(F.split(text, BLANKS), lambda t: t != "")


def tokens_sql(text: str) -> str:
    return rf"list_filter(string_split_regex({text}, '[ \t\n\r\f]+'), lambda t: t <> '')"


def clean(text: Column, most_chars: int | None = None) -> Column:
    """Line breaks to blanks, outer white space off, cut to most_chars if given; null where nothing is left."""
    flat = F.btrim(F.replace(F.replace(text, F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(" ")), F.lit(" \t\f"))
    some = F.nullif(flat, F.lit(""))
    return some if most_chars is None else F.substring(some, 1, most_chars)


def clean_sql(text: str, most_chars: int = 20_000) -> str:
    flat = rf"regexp_replace(translate({text}, chr(10) || chr(13), '  '), '^[ \t\f]+|[ \t\f]+$', '', 'g')"
    return f"substring(nullif({flat}, ''), 1, {most_chars})"


def unit_hash(seed: int, key: Column) -> Column:
    """A number in [0, 1) from seed and key, the same wherever it is computed (32 bits of a SHA-256)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def unit_hash_sql(seed: int, key: str) -> str:
    return f"(('0x' || substr(sha256('{seed}:' || {key}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def hash_order(seed: int, key: Column) -> Column:
    """A sortable hash of seed and key."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def hash_order_sql(seed: int, key: str) -> str:
    return f"sha256('{seed}:' || {key})"
