"""Source-name canonicalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_source(source: Column, extension: str = ".jsonl") -> Column:
    """The true name of a respelled source.

    Letter case, blanks around the name, a leading path and a missing extension are
    undone. Null and blank names give null.
    """
    base = F.lower(F.btrim(F.substring_index(F.replace(source, F.lit("\\"), F.lit("/")), "/", -1), F.lit(" \t\n\r\f")))
    full = F.when(base.endswith(extension), base).otherwise(F.concat(base, F.lit(extension)))
    return F.when(base != "", full)


def canonical_source_sql(column: str, extension: str = ".jsonl") -> str:
    """The same rule for the SQL check."""
    base = rf"lower(regexp_replace(regexp_extract({column}, '([^/\\]*)$', 1), '^\s+|\s+$', '', 'g'))"
    return f"case when {base} = '' then null when {base} like '%{extension}' then {base} else {base} || '{extension}' end"
