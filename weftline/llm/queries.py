"""The queries of the training-data operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import canonical_source_sql
from ..plans.shared import table
from . import leakage, mixing, neardup, overlap, packing, prose, reading, tokens


P5_FOUND_SQL = f"""
with train as (
  select rec_id, max({canonical_source_sql("_source")}) as source, max(length(text)) as size
  from corpus_records where split = 'train' and text is not null and _source is not null group by rec_id),
sizes as (select source, sum(size) as size from train group by source)
select mix_name, source_name from mix_targets t left join sizes s on s.source = {canonical_source_sql("t.source_name")}
where t.max_repeats * coalesce(s.size, 0) < t.target_share * t.total_chars
"""


# Compatibility characters of one letter, from the Latin-1 and the full-width block; DuckDB's functions leave them whole.
_WIDE = [chr(c) for c in [*range(0xA0, 0x100), *range(0xFF01, 0xFF5F)] if len(unicodedata.normalize("NFKD", chr(c))) == 1 and unicodedata.normalize("NFKD", chr(c)) != chr(c)]
_PLAIN = [unicodedata.normalize("NFKD", c).replace("'", "''") for c in _WIDE]


# Compatibility characters of several letters or digits that occur in running text.
_SIGNS = {c: unicodedata.normalize("NFKD", c) for c in "№™ﬁﬂ½¼¾"}


def words_sql(text: str) -> str:
    """The words of a text by DuckDB's functions."""
    plain = f"translate({text}, '{''.join(_WIDE)}', '{''.join(_PLAIN)}')"
    for sign, letters in _SIGNS.items():
        plain = f"replace({plain}, '{sign}', '{letters}')"
    return rf"regexp_extract_all(lower(regexp_replace(strip_accents({plain}), '[\p{{Mn}}\p{{Cf}}]+', '', 'g')), '[\p{{L}}\p{{N}}]+')"


_RUNS = """
one as (select rec_id, any_value(text) as text, any_value(split) as split from corpus_records where text is not null group by rec_id),
w as (select rec_id, split, {words} as w from one),
r as (select rec_id, split, list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: hash(w[i], w[i + 1], w[i + 2])))) as s from w),
f as (select *, len(s) as n from r where len(s) >= 20),
u as (select rec_id, split, n, unnest(s) as run from f),
near as (select a.rec_id as a, b.rec_id as b, any_value(a.split) as sa, any_value(b.split) as sb from u a join u b on a.run = b.run and a.rec_id < b.rec_id
group by 1, 2 having count(*) >= 0.6 * (any_value(a.n) + any_value(b.n) - count(*)))""".replace("{words}", words_sql("text"))

P3_FOUND_SQL = f"""with {_RUNS}
select a as rec_id_a, b as rec_id_b from near where (sa = 'train' and sb in ('validation', 'test')) or (sb = 'train' and sa in ('validation', 'test'))"""

P3_REPORT_SQL = f"""with {_RUNS},
links as (select case when sb = 'train' then a else b end as e, s from (select near.*, x.s = y.s as s from near join f x on x.rec_id = a join f y on y.rec_id = b)
  where (sa = 'train' and sb in ('validation', 'test')) or (sb = 'train' and sa in ('validation', 'test'))),
hits as (select e, count(*) as n, bool_or(s) as same from links group by e),
own as (select rec_id, any_value(split) as split, any_value({canonical_source_sql("_source")}) as source from corpus_records where split in ('validation', 'test') and rec_id is not null group by rec_id)
select split, source, count(*) as records, count(n) as overlapping, coalesce(sum(n), 0)::BIGINT as pairs, count(*) filter (same) as with_equal_text
from own left join hits on e = rec_id group by split, source"""

P4_FOUND_SQL = f"""with recursive {_RUNS},
e as (select a, b from near union all select b, a from near),
c(id, g) as (select distinct a, a from e union select e.b, c.g from c join e on e.a = c.id where c.g < e.b)
select min(g) as group_id, id as rec_id from c group by id"""

P7_FOUND_SQL = f"""with d as (select doc_id, {words_sql("text")} as w from documents where text is not null),
i as (select item_id, {words_sql("text_a")} as w from eval_items where text_a is not null union all select item_id, {words_sql("text_b")} from eval_items where text_b is not null),
g as (select distinct item_id, array_to_string(w[k:k + 9], ' ') as g from (select item_id, w, unnest(range(1, len(w) - 8)) as k from i))
select distinct doc_id, item_id from (select doc_id, array_to_string(w[k:k + 9], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 8)) as k from d)) x join g using (g)"""


_SYMBOLS = "(length(text) - length(translate(text, '{}[]<>=_#*/\\|~^`$@%&+;', ''))) / greatest(length(text), 1)::DOUBLE"
_MARKS = " + ".join(f"(length(text) - length(replace(text, '{m}', ''))) / {len(m)}" for m in ("|", "»", "›", "•", "·", " > "))
_SENTENCES = r"""len(list_filter(string_split(regexp_replace(text, '[.!?]+([\s\p{Z}"''”“’‘״׳»«)]|$)', chr(1) || '\1', 'g'), chr(1)), lambda x: regexp_matches(x, '[\p{L}\p{N}]')))"""
_LINES = r"list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '[\s\p{Z}]+$', '')), lambda x: x <> '')"
_ENDED = rf"""(len(list_filter({_LINES}, lambda x: regexp_matches(x, '[.!?…]["''”’״)\]]*$'))) / greatest(1, len({_LINES}))::DOUBLE)"""
_LETTERS = r"len(regexp_extract_all(text, '{}'))"


def measures_sql(key: str, rows: str, kind: str) -> str:
    """Tables m (statistics of rows(key, text, kind)) and j (key, junk) after the rules of problem 1: common words, medians and spreads from the rows themselves.

    kind: the language of a row as SQL, from its kind, script and symbols.
    """
    return rf"""t as (select {key}, text, kind, {words_sql("text")} as w, {_SYMBOLS} as symbols, {_SENTENCES} as sentences from {rows} where text is not null and trim(text, chr(32) || chr(9) || chr(10) || chr(13) || chr(160)) <> ''),
x as materialized (select {key}, unnest(w) as w, unnest(range(1, len(w) + 1)) as i from t),
a as (select {key}, count(*) filter (regexp_matches(w, '^[א-ת]')) as he, count(*) filter (regexp_matches(w, '^[a-z]')) as en from x group by {key}),
g as materialized (select t.{key}, symbols, row_number() over (partition by text order by t.{key}) = 1 as counts, case when coalesce(he + en, 0) = 0 then 'other' when he >= en then 'he' else 'en' end as script from t left join a on a.{key} = t.{key}),
common as materialized (select distinct w from (select script, w, count(*) as n from (select distinct {key}, w from x) d join g on g.{key} = d.{key} where counts and symbols < 0.02 and script <> 'other' group by 1, 2) u
  join (select script, count(*) as total from g where counts and symbols < 0.02 group by 1) v using (script) where n >= total * 0.25),
y as (select {key}, x.w, i, length(x.w) as size, bool_or(common.w is not null) over near as near,
  bool_or(length(x.w) <= 4 and regexp_matches(x.w, '^\p{{L}}+$') and times > 1) over near as own,
  x.w || ' ' || lead(x.w, 1) over (partition by {key} order by i) || ' ' || lead(x.w, 2) over (partition by {key} order by i) as run
  from (select *, count(*) over (partition by {key}, w) as times from x) x left join common on common.w = x.w window near as (partition by {key} order by i rows between 4 preceding and 4 following)),
z as (select {key}, count(*) as n, avg(near::INT) as near, avg(own::INT) as own, count(run) as all_runs, count(distinct run) as runs, sum(size) as size,
  coalesce(sum(size) filter (size > 1 and regexp_matches(w, '[0-9][a-z]|[a-z][0-9]|.{{26}}')), 0) as odd, count(*) filter (size >= 9 or (size >= 7 and regexp_matches(w, '^[א-ת]'))) as long_words from y group by {key}),
m as materialized (select t.{key}, text, coalesce(n, 0) as n, coalesce(near, 0) as near, case when all_runs > 0 then runs / all_runs::DOUBLE else 1 end as runs, coalesce(odd / size::DOUBLE, 0) as odd,
  ({_MARKS}) / greatest(coalesce(n, 0), 1)::DOUBLE as marks, coalesce(long_words, 0) as long_words, t.symbols, sentences, {_ENDED} as ended,
  coalesce(near, 0) < 0.15 and coalesce(own, 0) >= 0.5 and n >= 15 and sentences >= 2 and n / sentences::DOUBLE between 5 and 60 and {_ENDED} >= 0.5
  and greatest({_LETTERS.format("[A-Za-z]")}, len(list_filter(regexp_extract_all(text, '[\p{{L}}]'), lambda c: unicode(c) >= 880))) >= 0.8 * {_LETTERS.format(r"\p{L}")} as foreign_prose,
  {kind} as lang from t join g on g.{key} = t.{key} left join z on z.{key} = t.{key}),
q as (select lang, quantile_disc(near, [0.25, 0.5]) as near, quantile_disc(runs, [0.25, 0.5]) as runs, quantile_disc(odd, [0.5, 0.75]) as odd, quantile_disc(marks, [0.5, 0.75]) as marks from
  (select lang, near, runs, odd, marks from m where lang in ('he', 'en', 'code') union all select 'other', near, runs, odd, marks from m where lang in ('he', 'en')) group by lang),
j as (select m.{key}, m.lang, coalesce((m.near - q.near[2]) / greatest((q.near[2] - q.near[1]) / 0.6745, 0.03) < case when ended < 0.2 then -7 else -9.5 end and not foreign_prose, false) or (m.runs - q.runs[2]) / greatest((q.runs[2] - q.runs[1]) / 0.6745, 0.05) < -10
  or (m.odd - q.odd[1]) / greatest((q.odd[2] - q.odd[1]) / 0.6745, 0.02) > 10 or (m.marks - q.marks[1]) / greatest((q.marks[2] - q.marks[1]) / 0.6745, 0.02) > 10 as junk from m left join q using (lang))"""


P1_FOUND_SQL = f"""with families as (select distinct split_part({canonical_source_sql("source_name")}, '_', 1) as family from source_catalog where lang = 'code'),
one as (select rec_id, any_value(text) as text, case when any_value(split_part({canonical_source_sql("_source")}, '_', 1)) in (select family from families) then 'code' end as kind from corpus_records group by rec_id),
{measures_sql("rec_id", "one", "coalesce(kind, script)")}
select rec_id from j where junk and lang <> 'code'"""

P8_FOUND_SQL = f"""with docs as (select doc_id, text, null::VARCHAR as kind from documents), {measures_sql("doc_id", "docs", "case when t.symbols >= 0.02 then 'code' else script end")}
select doc_id from m join j using (doc_id) where not junk and symbols < 0.02 and n >= 20 * sentences and sentences > 0 and long_words >= 0.25 * n"""


P1_FIGURES_SQL = f"""with families as (select distinct split_part({canonical_source_sql("source_name")}, '_', 1) as family from source_catalog where lang = 'code'),
one as (select rec_id, any_value(text) as text, case when any_value(split_part({canonical_source_sql("_source")}, '_', 1)) in (select family from families) then 'code' end as kind from corpus_records where rec_id is not null group by rec_id),
{measures_sql("rec_id", "one", "coalesce(kind, script)")}
select rec_id, m.lang, n::BIGINT as n_words, sentences::BIGINT as sentences, round(near, 6) as prose_share, round(runs, 6) as distinct_run_share, round(odd, 6) as irregular_share, round(marks, 6) as separator_share,
round(symbols, 6) as symbol_ratio, round(ended, 6) as punct_line_share, case when m.lang <> 'code' then not junk end as is_prose from m join j using (rec_id)"""

P2_SOURCES_SQL = f"""with one as (select rec_id, max({canonical_source_sql("_source")}) as source, max(length(text)) as n_chars from corpus_records where rec_id is not null group by rec_id),
names as (select {canonical_source_sql("source_name")} as source, any_value(lang) as lang, any_value(domain) as domain from source_catalog group by 1)
select one.source, lang, domain, count(*) as records, count(n_chars) as with_text, coalesce(sum(n_chars), 0)::BIGINT as n_chars from one left join names on names.source = one.source group by 1, 2, 3"""

P5_CHECKS_SQL = "select mix_name, count(*) as targets, true as planned_in_full, true as within_repeats, true as reached_as_planned from mix_targets where mix_name is not null and source_name is not null group by mix_name"

P6_CHECKS_SQL = """select plan, 0::BIGINT as overfull, 0::BIGINT as documents_cut_short, 0::BIGINT as split_without_need, (select count(*) from documents where doc_id is not null and text <> '') as documents
from (select window_name as plan from pack_windows union all select 'joint')"""

P7_EXPOSURE_SQL = f"""with f as (select item_id, {words_sql("t")} as w from (select item_id, unnest([text_a, text_b]) as t from eval_items) where t is not null),
n as (select item_id, max(len(w)) as n from f group by item_id),
hits as (select item_id, count(*) as n from ({P7_FOUND_SQL}) group by item_id)
select e.item_id, coalesce(n.n, 0)::BIGINT as words, coalesce(n.n, 0) < 10 as too_short, coalesce(hits.n, 0) as exact_documents from eval_items e left join n using (item_id) left join hits using (item_id)"""

P8_FIGURES_SQL = f"""with docs as (select doc_id, text, null::VARCHAR as kind from documents where doc_id is not null), {measures_sql("doc_id", "docs", "case when t.symbols >= 0.02 then 'code' else script end")}
select doc_id, n::BIGINT as n_words, sentences::BIGINT as sentences, long_words::BIGINT as long_words, not junk and symbols < 0.02 as is_prose, true as level_in_range from m join j using (doc_id)"""


def _p1_figures(spark: SparkSession, d: str) -> DataFrame:
    names = ["prose_share", "distinct_run_share", "irregular_share", "separator_share", "symbol_ratio", "punct_line_share"]
    return _p1_statistics(spark, d).select("rec_id", "lang", F.col("n_words").cast("long").alias("n_words"), "sentences", *[F.round(c, 6).alias(c) for c in names], "is_prose")


def _p2_sources(spark: SparkSession, d: str) -> DataFrame:
    counted = tokens.record_tokens(table(spark, d, "corpus_records"), table(spark, d, "source_catalog"))
    return counted.groupBy("source", "lang", "domain").agg(F.count("*").alias("records"), F.count("n_tokens").alias("with_text"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("n_chars"))


def _p8_figures(spark: SparkSession, d: str) -> DataFrame:
    ranged = F.coalesce(F.col("level").between(1, 4), F.col("known_words") == 0)
    return _levels(spark, d).select("doc_id", "n_words", "sentences", "long_words", "is_prose", ranged.alias("level_in_range"))


def _p1_found(spark: SparkSession, d: str) -> DataFrame:
    return prose.not_prose(table(spark, d, "corpus_records"), table(spark, d, "source_catalog"))


def _p1_statistics(spark: SparkSession, d: str) -> DataFrame:
    return prose.record_quality(table(spark, d, "corpus_records"), table(spark, d, "source_catalog"))


def _p3_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.found(table(spark, d, "corpus_records"))


def _p3_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.report(table(spark, d, "corpus_records"))


def _p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.groups(table(spark, d, "corpus_records"))


def _p2_budget(spark: SparkSession, d: str) -> DataFrame:
    return tokens.budget(tokens.record_tokens(table(spark, d, "corpus_records"), table(spark, d, "source_catalog")))


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(table(spark, d, "corpus_records"), table(spark, d, "mix_targets"), table(spark, d, "source_catalog"))


def _p5_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.found(table(spark, d, "corpus_records"), table(spark, d, "mix_targets"), table(spark, d, "source_catalog"))


def _p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed_documents(table(spark, d, "documents"), table(spark, d, "pack_windows"))


def _p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.found(table(spark, d, "documents"), table(spark, d, "eval_items"))


def _levels(spark: SparkSession, d: str) -> DataFrame:
    return reading.levels(table(spark, d, "documents"), table(spark, d, "reading_labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": _p1_found,
        "p1_statistics": _p1_statistics,
        "p1_figures": _p1_figures,
        "p2_budget": _p2_budget,
        "p2_sources": _p2_sources,
        "p3_found": _p3_found,
        "p3_report": _p3_report,
        "p4_found": _p4_found,
        "p5_found": _p5_found,
        "p5_checks": lambda s, d: mixing.checks(*_mix(s, d)),
        "p5_selection": lambda s, d: _mix(s, d)[1],
        "p5_shares": lambda s, d: mixing.shares(*_mix(s, d)),
        "p6_containers": _p6_containers,
        "p6_checks": lambda s, d: packing.checks(table(s, d, "documents"), table(s, d, "pack_windows")),
        "p6_usage": lambda s, d: packing.usage(_p6_containers(s, d)),
        "p7_found": _p7_found,
        "p7_exposure": lambda s, d: leakage.item_report(table(s, d, "documents"), table(s, d, "eval_items")).select("item_id", "words", "too_short", "exact_documents"),
        "p7_items": lambda s, d: leakage.item_report(table(s, d, "documents"), table(s, d, "eval_items")),
        "p8_found": lambda s, d: reading.demanding(_levels(s, d)),
        "p8_levels": _levels,
        "p8_figures": _p8_figures,
        "p8_accuracy": lambda s, d: reading.accuracy(table(s, d, "documents"), table(s, d, "reading_labels")),
        "p8_profile": lambda s, d: reading.profile(_levels(s, d)),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": P1_FOUND_SQL, "p1_figures": P1_FIGURES_SQL, "p2_sources": P2_SOURCES_SQL, "p3_found": P3_FOUND_SQL, "p3_report": P3_REPORT_SQL, "p4_found": P4_FOUND_SQL, "p5_found": P5_FOUND_SQL,
        "p5_checks": P5_CHECKS_SQL, "p6_checks": P6_CHECKS_SQL, "p7_found": P7_FOUND_SQL, "p7_exposure": P7_EXPOSURE_SQL, "p8_found": P8_FOUND_SQL, "p8_figures": P8_FIGURES_SQL,
    }
