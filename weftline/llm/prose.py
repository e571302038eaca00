"""Problem 1: per-document text quality statistics, their distributions, and the records that are not prose.

A first pass counts in how many texts of each script every word stands; the words of a
large share of the texts are that language's common words. A second pass takes the
statistics of each text. Mergeable KLL sketches of every statistic are built per language;
the median and the spread between quartiles from those sketches turn each value into a
robust z-score, and records far out in a tail that marks lists, tables or junk are
flagged. Only common words and sketches (a row for each language) are sent around.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.names import canonical_source
from ..plans.shared import lookup_join, materialise
from .textnorm import slices, words

COMMON_SHARE = 0.25  # of the texts of a script that a common word stands in
COUNTERS = 1 << 16  # different words of a script that a task counts at once
MOST_SEEN = 1 << 20  # texts of a task remembered to know copies
KEPT = 4096  # counters that a task hands on; a word left out stands in less than 1 in KEPT of its words
CODE_SYMBOLS = 0.02  # texts with a larger share of symbols are not counted as natural language

# Characters that source code, markup and tables use far more often than prose.
SYMBOLS = "{}[]<>=_#*/\\|~^`$@%&+;"

# Marks that part the entries of menus and inline lists.
SEPARATORS = ("|", "»", "›", "•", "·", " > ")

REACH = 4  # words on either side that a common word vouches for
OWN_LETTERS, OWN_WORDS, OWN_SHARE = 4, 15, 0.5  # see own_share
SKETCH_K = 4096  # size of a quantile sketch: ranks are right to about 0.1 percent

_SYMBOL_BYTES, _DIGIT_BYTES = SYMBOLS.encode(), b"0123456789"
_MIXED = re.compile(r"\d[a-z]|[a-z]\d|.{26}")
#: A run of sentence ends: . ! ? followed by white space, a quote, ) or the end.
SENTENCE_END = re.compile(r"[.!?]+(?=[\s\"'”“’‘״׳»«)]|$)")
_WORDISH = re.compile(r"[^\W_]")
_CLOSERS, _ENDS = "\"'”’״)]", (".", "!", "?", "…")

#: name -> (tail that marks junk, smallest spread taken as one robust standard deviation, cut in robust z-scores).
#: The spread of prose_share is the data's own; its floor is a word or two of a short text. Of the other three flagged
#: statistics nearly every text of running prose has the same value, so their floor is the resolution.
STATISTICS = {
    "n_words": ("", 1.0, 0.0),
    "mean_word_len": ("", 0.25, 0.0),
    "symbol_ratio": ("", 0.005, 0.0),
    "digit_ratio": ("", 0.01, 0.0),
    "punct_line_share": ("", 0.05, 0.0),
    "common_share": ("", 0.03, 0.0),
    "prose_share": ("low", 0.03, -9.5),
    "distinct_run_share": ("low", 0.05, -10.0),
    "irregular_share": ("high", 0.02, 10.0),
    "separator_share": ("high", 0.02, 10.0),
}
#: Where hardly a line ends in punctuation (below UNENDED), the cut of prose_share.
UNENDED, UNENDED_CUT = 0.2, -7.0
_FIELDS = [*STATISTICS]


class WordFacts(dict):
    """Word -> what the statistics need of it, packed in one integer and remembered up to a bound."""

    COMMON, LONG, HEBREW, LATIN, IRREGULAR, LENGTH = 1, 2, 4, 8, 16, 8  # bits, and the shift of the length

    def __init__(self, common: frozenset[str] = frozenset()):
        super().__init__()
        self.common = common

    def __missing__(self, word: str) -> int:
        if len(self) >= 500_000:
            self.clear()
        n, hebrew = len(word), "א" <= word[0] <= "ת"
        facts = (word in self.common) * self.COMMON + (n >= 9 or hebrew and n >= 7) * self.LONG + hebrew * self.HEBREW
        facts += ("a" <= word[0] <= "z") * self.LATIN + (n > 1 and bool(_MIXED.search(word))) * self.IRREGULAR + (n << self.LENGTH)
        self[word] = facts
        return facts


def script_of(hebrew: np.ndarray, latin: np.ndarray) -> np.ndarray:
    """'he' or 'en', the alphabet most words begin with, 'other' without either."""
    return np.where((hebrew == 0) & (latin == 0), "other", np.where(hebrew >= latin, "he", "en"))


def _symbols(texts: list[str]) -> np.ndarray:
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    return np.fromiter((len(r) - len(r.translate(None, _SYMBOL_BYTES)) for r in raw), float, len(raw)) / np.maximum(np.fromiter(map(len, texts), np.int64, len(texts)), 1)


def common_words(df: DataFrame, text: str = "text", share: float = COMMON_SHARE) -> frozenset[str]:
    """Words that stand in at least a share of the texts of their script, by a heavy-hitter count of all texts.

    Texts in no known script and texts full of symbols (source code, markup) are not
    counted, and copies of a text count once a task, so that the words of a text that many
    rows hold do not become common. A task counts at most COUNTERS words of a script at once (the rarest go first)
    and hands on its KEPT most frequent ones; counts of tasks add up. A text has a bounded
    number of words, so at most mean words / share of them can be common: that is all that
    comes to the driver.
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        facts = WordFacts()
        counts, n, seen = {"he": Counter(), "en": Counter()}, Counter(), set()
        for whole in batches:
            for batch in slices(whole, 0):
                fresh = []
                texts = batch.column(0).to_pylist()
                for t, symbols in zip(texts, _symbols(texts)):
                    key = xxhash.xxh3_64_intdigest(t)
                    if symbols < CODE_SYMBOLS and key not in seen:
                        fresh.append(words(t))
                        if len(seen) >= MOST_SEEN:
                            seen.clear()
                        seen.add(key)
                size = np.fromiter(map(len, fresh), np.int64, len(fresh))
                flat = np.fromiter((f for w in fresh for f in map(facts.__getitem__, w)), np.int64, int(size.sum()))
                ends = np.cumsum(size)
                letters = [np.concatenate([[0], np.cumsum((flat & bit) > 0)]) for bit in (facts.HEBREW, facts.LATIN)]
                for w, script in zip(fresh, script_of(*(x[ends] - x[ends - size] for x in letters)).tolist()):
                    if script != "other":
                        n[script] += 1
                        counts[script].update(set(w))
                for c in counts.values():
                    if len(c) > COUNTERS:
                        for w, _ in c.most_common()[COUNTERS // 2 :]:
                            del c[w]
        rows = [(s, w, k) for s, c in counts.items() for w, k in [("", n[s]), *c.most_common(KEPT)] if k]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["script", "word", "n"])

    counted = df.where(F.col(text).isNotNull()).select(text).mapInArrow(go, "script string, word string, n bigint").groupBy("script", "word").agg(F.sum("n").alias("n"))
    counted = materialise(counted, "words")
    total = counted.where("word = ''").select("script", F.col("n").alias("total"))  # a row for each script
    return frozenset(r["word"] for r in counted.where("word <> ''").join(F.broadcast(total), "script").where(F.col("n") >= F.col("total") * share).select("word").collect())


def _lines_ended(text: str) -> float:
    lines = [x for x in map(str.rstrip, text.split("\n")) if x]
    return sum(x.rstrip(_CLOSERS).endswith(_ENDS) for x in lines) / max(1, len(lines))


def own_share(text: str, split: list[str], sentences: int) -> float:
    """Share of the words near a short word that the text itself repeats: running sentences of a language whose common words are not known.

    0 unless there are sentences of usual length, most lines end in punctuation, and the
    letters are mostly unaccented Latin ones or mostly of one other alphabet (which text
    read in a wrong encoding is not).
    """
    if len(split) < OWN_WORDS or sentences < 2 or not 5 <= len(split) / sentences <= 60 or _lines_ended(text) < 0.5:
        return 0.0
    letters = [c for c in text if c.isalpha()]
    if max(sum(c < "\x80" for c in letters), sum(c >= "\u0370" for c in letters)) < 0.8 * len(letters):
        return 0.0
    times = Counter(split)
    own = np.array([times[w] > 1 and len(w) <= OWN_LETTERS and w.isalpha() for w in split], bool)
    return float(_near(own, np.zeros(len(split), np.int64)).mean())


def _near(hit: np.ndarray, doc: np.ndarray) -> np.ndarray:
    near = hit.copy()
    for k in range(1, min(REACH, len(hit) - 1) + 1):
        same = doc[k:] == doc[:-k]
        near[k:] |= hit[:-k] & same
        near[:-k] |= hit[k:] & same
    return near


def measure(texts: list[str], split: list[list[str]], facts: WordFacts) -> dict[str, list | np.ndarray]:
    """Columns of script ('he', 'en' or 'other'), sentences, long words, own_share and statistics of texts.

    prose_share is the share of words with a common word within REACH words: lists,
    tables, keyword heaps and gibberish have none whatever their layout, running
    sentences have one nearly everywhere, whatever their line breaks, case or punctuation.
    distinct_run_share falls when a phrase is repeated over and over; irregular_share is
    the share of characters in words that mix letters and digits or are absurdly long;
    separator_share counts the marks between entries of menus for each word. own_share is
    taken of texts with hardly a common word only.
    """
    counts = np.fromiter(map(len, split), np.int64, len(split))
    ends = np.cumsum(counts)
    doc = np.repeat(np.arange(len(split)), counts)
    flat = np.fromiter((f for w in split for f in map(facts.__getitem__, w)), np.int64, int(counts.sum()))
    common = (flat & facts.COMMON).astype(bool)
    near = _near(common, doc)

    def total(values: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return sums[ends] - sums[ends - counts]

    lengths = flat >> facts.LENGTH
    n, size = np.maximum(counts, 1), total(lengths)
    hebrew, latin = total((flat & facts.HEBREW) > 0), total((flat & facts.LATIN) > 0)
    chars = np.maximum(np.fromiter(map(len, texts), np.int64, len(texts)), 1)
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    sentences = [sum(1 for p in SENTENCE_END.split(t) if _WORDISH.search(p)) for t in texts]
    prose_share = total(near) / n
    return {
        "script": script_of(hebrew, latin).tolist(),
        "sentences": sentences,
        "own_share": [own_share(t, w, k) if p < 0.15 else 0.0 for t, w, k, p in zip(texts, split, sentences, prose_share)],
        "long_words": total((flat & facts.LONG) > 0),
        "n_words": counts.astype(float),
        "mean_word_len": size / n,
        "symbol_ratio": _symbols(texts),
        "digit_ratio": np.fromiter((len(r) - len(r.translate(None, _DIGIT_BYTES)) for r in raw), float, len(raw)) / chars,
        "punct_line_share": [_lines_ended(t) for t in texts],
        "common_share": total(common) / n,
        "prose_share": prose_share,
        "distinct_run_share": [len(set(zip(w, w[1:], w[2:]))) / (len(w) - 2) if len(w) > 2 else 1.0 for w in split],
        "separator_share": np.fromiter((sum(map(t.count, SEPARATORS)) for t in texts), float, len(texts)) / n,
        "irregular_share": total(np.where(flat & facts.IRREGULAR, lengths, 0)) / np.maximum(size, 1),
    }


MEASURES = T.StructType(
    [T.StructField("script", T.StringType()), T.StructField("sentences", T.LongType()), T.StructField("long_words", T.LongType()), T.StructField("own_share", T.DoubleType())]
    + [T.StructField(f, T.DoubleType()) for f in _FIELDS]
)


def measured(df: DataFrame, keep: list[str], text: str = "text", extra: list[T.StructField] | None = None, extra_of: Callable | None = None) -> DataFrame:
    """keep columns of df and the measures of each text; rows with a null or blank text are left out.

    The common words are those of df's own texts. extra_of(words, kept values) gives the
    values of the extra columns of a slice, from the same pass.
    """
    extra = extra or []
    schema = T.StructType([df.schema[c] for c in keep] + MEASURES.fields + extra)
    target = to_arrow_schema(schema)
    common = common_words(df, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        facts = WordFacts(common)
        for whole in batches:
            for batch in slices(whole, whole.num_columns - 1):
                texts = batch.column(batch.num_columns - 1).to_pylist()
                full = [i for i, t in enumerate(texts) if t is not None and not t.isspace() and t]
                kept = [batch.column(i).take(pa.array(full, pa.int64())) for i in range(len(keep))]
                split = [words(texts[i]) for i in full]
                columns = measure([texts[i] for i in full], split, facts)
                cols = [*kept, *[columns[f.name] for f in MEASURES.fields]]
                if extra_of:
                    cols += extra_of(split)
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(cols, target)], schema=target)

    return df.where(F.col(text).isNotNull()).select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def sketches(stats: DataFrame, by: str = "lang") -> DataFrame:
    """A KLL sketch of each statistic for each value of by, plus one ('all') pooled over the natural languages. Sketches merge."""
    own = stats.groupBy(by).agg(*[F.expr(f"kll_sketch_agg_double({f}, {SKETCH_K})").alias(f) for f in _FIELDS])
    pooled = own.where(F.col(by).isin("he", "en")).groupBy(F.lit("all").alias(by)).agg(*[F.expr(f"kll_merge_agg_double({f}, {SKETCH_K})").alias(f) for f in _FIELDS])
    return own.unionByName(pooled)


def quantiles(sketched: DataFrame, by: str = "lang", grid: int = 20) -> DataFrame:
    """By value of by: an array of grid + 1 quantiles of each statistic, read from its sketch."""
    ranks = "array(" + ",".join(f"{k / grid}D" for k in range(grid + 1)) + ")"
    return sketched.select(by, *[F.expr(f"kll_sketch_get_quantile_double({f}, {ranks})").alias(f) for f in _FIELDS])


def scored(stats: DataFrame, grid: int = 20, percentiles: bool = True) -> DataFrame:
    """stats with robust z-scores (z_*), percentiles (pct_*) and the tail flags of each record.

    A language without letters ('other') has no prose of its own to compare with; it is
    measured against the pooled sketches. The joined side has a row for each language.
    """
    q = quantiles(sketches(stats), grid=grid)
    q = q.select(F.col("lang").alias("__of"), *[F.col(f).alias(f"q_{f}") for f in _FIELDS])
    on = F.when(F.col("lang").isin("he", "en", "code"), F.col("lang")).otherwise(F.lit("all")) == F.col("__of")
    out = stats.join(F.broadcast(q), on, "left")
    at = lambda share: round(grid * share)

    def z(f: str):
        qs, (tail, least, _) = F.col(f"q_{f}"), STATISTICS[f]
        # The spread is read on the marked side of the median, where junk may fill up to a quarter of the texts.
        lo, hi, sds = {"low": (0.25, 0.5, 0.6745), "high": (0.5, 0.75, 0.6745)}.get(tail, (0.25, 0.75, 1.349))
        return (F.col(f) - qs[at(0.5)]) / F.greatest((qs[at(hi)] - qs[at(lo)]) / sds, F.lit(least))

    out = out.withColumns({f"z_{f}": z(f) for f in _FIELDS})
    if percentiles:
        out = out.withColumns({f"pct_{f}": F.expr(f"size(filter(q_{f}, x -> x <= {f})) * {100 / (grid + 1)}D") for f in _FIELDS})
    flags = []
    for f, (tail, _, cut) in STATISTICS.items():
        if f == "prose_share":
            limit = F.when(F.col("punct_line_share") < UNENDED, F.lit(UNENDED_CUT)).otherwise(F.lit(cut))
            flags.append(F.when((F.col(f"z_{f}") < limit) & (F.col("own_share") < OWN_SHARE), F.lit(f)))
        elif tail == "low":
            flags.append(F.when(F.col(f"z_{f}") < cut, F.lit(f)))
        elif tail == "high":
            flags.append(F.when(F.col(f"z_{f}") > cut, F.lit(f)))
    out = out.withColumn("tails", F.array_compact(F.array(*flags)))
    return out.drop("__of", *[f"q_{f}" for f in _FIELDS])


def source_kinds(catalog: DataFrame) -> DataFrame:
    """The language of each family of sources (the name up to its first underscore), so that sources the catalogue lacks get their family's."""
    name = canonical_source(F.col("source_name"))
    votes = catalog.where(F.col("lang").isNotNull()).groupBy(F.split(name, "_")[0].alias("__family"), "lang").count()
    return votes.groupBy("__family").agg(F.max_by("lang", F.struct("count", "lang")).alias("__kind"))


def record_quality(records: DataFrame, catalog: DataFrame, percentiles: bool = True) -> DataFrame:
    """One row per record (rec_id) with its statistics, scores and is_prose.

    Records: rec_id, text, _source; other columns are not read. Null and blank texts and
    null ids have no row, an empty table gives none. Of a record
    delivered several times one row is kept. A null source counts as no code source.
    lang is 'code' for records of code sources, else the script most letters belong to;
    code records are described but never flagged (is_prose null).
    """
    base = records.where("rec_id is not null").select("rec_id", "text", canonical_source(F.col("_source")).alias("source"))
    stats = measured(base, ["rec_id", "source"]).dropDuplicates(["rec_id"])
    stats = lookup_join(stats, source_kinds(catalog), F.split("source", "_")[0] == F.col("__family"))
    stats = stats.withColumn("lang", F.when(F.col("__kind") == "code", "code").otherwise(F.col("script"))).drop("__kind", "__family")
    out = scored(materialise(stats, "prose"), percentiles=percentiles)
    return out.withColumn("is_prose", F.when(F.col("lang") != "code", F.size("tails") == 0))


def not_prose(records: DataFrame, catalog: DataFrame) -> DataFrame:
    """rec_id of the records, outside code sources, that lie in a junk tail of their language."""
    return record_quality(records, catalog, percentiles=False).where("not is_prose").select("rec_id")


def document_prose(stats: DataFrame) -> DataFrame:
    """is_prose for measured documents: scores within their own script, code by its symbols."""
    code = F.col("symbol_ratio") >= CODE_SYMBOLS
    out = scored(stats.withColumn("lang", F.when(code, "code").otherwise(F.col("script"))), percentiles=False)
    return out.withColumn("is_prose", (F.size("tails") == 0) & ~code)
