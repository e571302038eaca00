"""Token-sequence operators: separators, truncation, padding, chunking, masking, segment ids, unpadding."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import position, running_total, slice_count
from ..plans.shared import materialise

IGNORE = -100
SEQUENCES_OF_SLICE = 1_000  # whole sequences that are put in order together


def truncate_pad(ids: Column, length: int, pad: Column) -> Column:
    """ids cut or right-padded to length."""
    return F.slice(F.concat(ids, F.array_repeat(pad, F.greatest(F.lit(length) - F.size(ids), F.lit(0)))), 1, length)


def with_specials(ids: Column, cls: Column, sep: Column, length: int | None = None) -> Column:
    """cls + ids + sep, the ids cut so that all fit in length."""
    kept = ids if length is None else F.slice(ids, 1, length - 2)
    return F.concat(F.array(cls), kept, F.array(sep))


def pair_with_specials(a: Column, b: Column, cls: Column, sep: Column, length: int) -> Column:
    """cls + a + sep + b + sep within length, the longer one cut first; a null b gives a single sequence."""
    room = length - 3
    na, nb = F.size(a), F.size(b)
    # Longest first: the longer loses tokens until both fit; equal lengths lose b's first.
    keep_a = F.when(na + nb <= room, na).when(na <= nb, F.least(na, F.lit((room + 1) // 2))).otherwise(F.greatest(F.lit(room) - nb, F.lit((room + 1) // 2)))
    keep_b = F.least(nb, F.lit(room) - keep_a)
    both = F.concat(F.array(cls), F.slice(a, F.lit(1), keep_a), F.array(sep), F.slice(b, F.lit(1), keep_b), F.array(sep))
    return F.when(b.isNull(), with_specials(a, cls, sep, length)).otherwise(both)


def ensure_bounds(ids: Column, bos: Column, eos: Column, length: int) -> Column:
    """ids beginning with bos and ending with eos: bos goes in front where absent; where the last is not eos, ids are cut to length - 1 and eos follows."""
    begun = F.when(F.try_element_at(ids, F.lit(1)).eqNullSafe(bos), ids).otherwise(F.concat(F.array(bos), ids))
    return F.when(F.try_element_at(begun, F.lit(-1)).eqNullSafe(eos), begun).otherwise(F.concat(F.slice(begun, 1, length - 1), F.array(eos)))


def attention_mask(ids: Column, pad: Column) -> Column:
    return F.transform(ids, lambda x: F.when(x == pad, 0).otherwise(1))


def concat_chunks(df: DataFrame, key: str, ids: str, length: int, by: list[str] | None = None, most_tokens: int = 0) -> DataFrame:
    """chunk, input_ids: the sequences one after the other (in order of key, within by) cut into chunks of exactly length.

    The rest at the end is dropped; most_tokens > 0 keeps the chunks that begin before it.
    Each sequence is cut at chunk borders as a whole, so rows are sequences plus chunks,
    never single tokens. Null and empty sequences add nothing; nulls in by are a group, a
    null key comes first, rows with equal keys follow one another.
    """
    by = by or []
    rows = df.where(F.size(ids) > 0).select(*by, F.col(key).alias("__key"), F.col(ids).alias("__ids"))
    # The ids go through the window with their lengths: repeated keys stay apart, and chunks are put together where the rows lie.
    n = F.size("__ids").cast("long")
    sizes = materialise(rows.select(*by, "__key", n.alias("__value")), "sizes")
    slices = slice_count(sizes.count(), SEQUENCES_OF_SLICE)
    rows = running_total(rows, "__key", n, "__end", by=by, slices=slices, sizes=sizes, keep_slice=True).withColumn("__start", F.col("__end") - n)
    whole = F.lit(length)
    touched = F.sequence(F.floor(F.col("__start") / whole), F.floor((F.col("__end") - 1) / whole))
    parts = rows.select(*by, "__slice", "__before", "__sum", "__start", "__end", "__ids", F.explode(touched).alias("chunk"))
    lo = F.greatest(F.col("chunk") * whole, F.col("__start"))
    hi = F.least((F.col("chunk") + 1) * whole, F.col("__end"))
    first, last = F.floor(F.col("__before") / whole), F.floor((F.col("__before") + F.col("__sum") - 1) / whole)
    edge = F.coalesce((F.col("chunk") == first) | (F.col("chunk") == last), F.lit(False))
    parts = parts.select(*by, "__slice", "chunk", edge.alias("__edge"), lo.alias("__at"), F.slice("__ids", (lo - F.col("__start") + 1).cast("int"), (hi - lo).cast("int")).alias("__part"))

    def gathered(pieces: DataFrame, keys: list[str]) -> DataFrame:
        held = pieces.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("__at", "__part"))).alias("__parts"))  # at most length parts
        return held.select(*by, "chunk", F.flatten(F.col("__parts.__part")).alias("input_ids")).where(F.size("input_ids") == length)

    # Rows are partitioned by (by, slice), so this moves nothing; only the two chunks at the ends of a slice are moved.
    out = gathered(parts.where("not __edge") if slices > 1 else parts, [*by, "__slice", "chunk"])
    if slices > 1:
        out = out.unionByName(gathered(parts.where("__edge"), [*by, "chunk"]))
    return out.where(F.col("chunk") * length < most_tokens) if most_tokens else out


def segments(ids: Column, separator: Column, mode: str) -> Column:
    """An array of (start, end) of the segments that separators part; a separator begins its segment ('bos') or ends it ('eos')."""
    if mode not in ("bos", "eos"):
        raise ValueError("mode is 'bos' or 'eos'")
    cuts = F.filter(F.transform(ids, lambda x, i: F.when(x == separator, i + int(mode == "eos"))), lambda i: i.isNotNull())
    return F.arrays_zip(F.concat(F.array(F.lit(0)), cuts).alias("start"), F.concat(cuts, F.array(F.size(ids))).alias("end"))


def segment_ids(ids: Column, separator: Column, mode: str) -> Column:
    """The segment of each token: separators so far, counted with the token itself ('bos') or before it ('eos'). One pass over the row."""
    return F.flatten(F.transform(segments(ids, separator, mode), lambda x, k: F.array_repeat(k, x["end"] - x["start"])))


def segment_lengths(df: DataFrame, key: str, ids: str, separator, mode: str) -> DataFrame:
    """key, sequence_id, n: the tokens of each segment that has any; nothing is shuffled."""
    rows = df.select(key, F.posexplode(segments(F.col(ids), F.lit(separator), mode)).alias("sequence_id", "__s"))
    return rows.select(key, F.col("sequence_id").cast("long").alias("sequence_id"), (F.col("__s.end") - F.col("__s.start")).cast("long").alias("n")).where("n > 0")


def segment_rows(df: DataFrame, key: str, ids: str, separator, mode: str) -> DataFrame:
    """key, pos, token, sequence_id, one row per token; nothing is shuffled."""
    zipped = F.arrays_zip(F.col(ids).alias("token"), segment_ids(F.col(ids), F.lit(separator), mode).alias("sequence_id"))
    rows = df.select(key, F.posexplode(zipped).alias("pos", "__z"))
    return rows.select(key, "pos", F.col("__z.token").alias("token"), F.col("__z.sequence_id").cast("long").alias("sequence_id"))


def hash_mask(df: DataFrame, key: str, ids: str, rate: float, mask: int, pad: int, vocabulary: int, seed: int) -> DataFrame:
    """df with masked_ids and labels: each token is chosen with probability rate; of those 80 % become mask, 10 % another id, 10 % stay.

    The draw depends on seed, the integer key and the place alone, whatever the partitioning.
    Pads are never chosen; labels are IGNORE elsewhere.
    """

    def unit(i: Column, salt: int) -> Column:
        # Two rounds of a quadratic congruence modulo a prime, in 64-bit integers.
        prime = 2147483647
        x = (F.pmod(F.col(key), F.lit(prime)) * 48271 + i.cast("long") * 69621 + (seed + salt) * 16807 + 1) % prime
        return ((x * x + 12345 + i) % prime * 630360016 + x) % prime / F.lit(float(prime))

    def masked(x: Column, i: Column) -> Column:
        u = unit(i, 0)
        other = F.floor(unit(i, 1) * vocabulary).cast("long")
        return F.when((x == pad) | (u >= rate), x).when(u < rate * 0.8, F.lit(mask)).when(u < rate * 0.9, other).otherwise(x).cast("long")

    chosen = F.transform(ids, lambda x, i: F.when((x != pad) & (unit(i, 0) < rate), x).otherwise(IGNORE).cast("long"))
    return df.withColumn("masked_ids", F.transform(ids, masked)).withColumn("labels", chosen)


def unpad_rows(df: DataFrame, key: str, values: str, mask: str, extra: list[str] | None = None, numbered: bool = True, width: int | None = None) -> DataFrame:
    """One row per row of df: key, pos, value and extra arrays with the kept tokens only; numbered: also row (from 0 in order of key) and index (row * width + pos).

    Nothing is shuffled for the tokens; only the row numbers need an order.
    """
    names = ["value", *(extra or [])]
    zipped = F.arrays_zip(F.sequence(F.lit(0), F.size(mask) - 1).alias("pos"), F.col(mask).alias("__m"), *[F.col(c).alias(n) for c, n in zip([values, *(extra or [])], names)])
    kept = F.when(F.size(mask) > 0, F.filter(zipped, lambda x: x["__m"] == 1))
    rows = df.select(key, kept.alias("__z"), (F.lit(width) if width else F.size(values)).cast("long").alias("__w"))
    arrays = [F.coalesce(F.col(f"__z.{c}"), F.array()).alias(c) for c in ["pos", *names]]
    if not numbered:
        return rows.select(key, *arrays)
    rows = position(rows, key, "__row")
    index = F.transform(F.col("__z.pos"), lambda p: (F.col("__row") - 1) * F.col("__w") + p)
    return rows.select(key, (F.col("__row") - 1).alias("row"), F.coalesce(index, F.array()).alias("index"), *arrays)


def unpad(df: DataFrame, key: str, values: str, mask: str, extra: list[str] | None = None, width: int | None = None) -> DataFrame:
    """One row per kept token: key, row (from 0 in order of key), pos, index (row * width + pos), value and extra arrays' elements."""
    names = ["pos", "index", "value", *(extra or [])]
    rows = unpad_rows(df, key, values, mask, extra, width=width)
    return rows.select(key, "row", F.explode(F.arrays_zip(*names)).alias("__z")).select(key, "row", *[f"__z.{c}" for c in names])


def cumulative_lengths(df: DataFrame, key: str, mask: str) -> DataFrame:
    """key, seqlen and cu_seqlen (the kept tokens up to and including the row; the leading 0 is the row before the first)."""
    rows = df.select(key, F.aggregate(mask, F.lit(0).cast("long"), lambda a, x: a + x).alias("seqlen"))
    return running_total(rows, key, F.col("seqlen"), "cu_seqlen")


def repad_rows(rows: DataFrame, key: str, width: int, value: str = "value", fill: int = 0) -> DataFrame:
    """key and values: the tokens of unpad_rows (places ascending) scattered back to rows of width, fill elsewhere; nothing is shuffled. Places beyond width are left out."""
    held = F.filter(F.arrays_zip(F.col("pos").alias("p"), F.col(value).alias("v")), lambda x: x["p"] < width)
    rows = rows.select(key, held.alias("__h"))
    follow = F.concat(F.slice(F.col("__h.p"), 2, width), F.array(F.lit(width)))
    blank = F.lit(fill).cast("long")
    parts = F.transform(F.arrays_zip(F.col("__h").alias("h"), follow.alias("n")), lambda x: F.concat(F.array(x["h"]["v"].cast("long")), F.array_repeat(blank, x["n"] - x["h"]["p"] - 1)))
    lead = F.array_repeat(blank, F.coalesce(F.get(F.col("__h.p"), F.lit(0)), F.lit(width)))
    return rows.select(key, F.when(F.size("__h") > 0, F.concat(lead, F.flatten(parts))).otherwise(lead).alias("values"))


def repad(flat: DataFrame, rows: DataFrame, key: str, width: int, value: str = "value", fill: int = 0) -> DataFrame:
    """key and values: single tokens (key, pos, value) gathered and scattered back to rows of width. rows names every row, empty ones too.

    Tokens that still lie in rows need no gathering: see repad_rows.
    """
    held = flat.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col("pos").cast("int").alias("pos"), F.col(value).alias("value")))).alias("__z"))  # at most width tokens
    out = rows.select(key).join(held, key, "left").select(key, *[F.coalesce(F.col(f"__z.{c}"), F.array()).alias(c) for c in ("pos", "value")])
    return repad_rows(out, key, width, "value", fill)


def warmup_thresholds(least: int, most: int, warmup_tokens: int, world: int) -> list[int]:
    """Steps at which the batch size grows by one, from least to most, over warmup_tokens."""
    if least >= most:
        return []
    share = math.ceil(warmup_tokens / world)
    sizes = list(range(least, most))
    total, steps, so_far = sum(sizes), [], 0
    for b in sizes:
        so_far += b
        steps.append(math.ceil(share / total * so_far))
    return steps


def warmup_batch_size(step: Column, least: int, most: int, warmup_tokens: int, world: int) -> Column:
    """The batch size at a step: least plus the thresholds reached."""
    steps = warmup_thresholds(least, most, warmup_tokens, world)
    if not steps:
        return F.lit(least)
    return F.lit(least) + F.size(F.filter(F.array(*map(F.lit, steps)), lambda t: t <= step))


def tiled(items: Column, size: int, mode: str, fill: Column | None = None) -> Column:
    """A list grown to size: repeated from its start ('edge'), repeated outwards from the middle ('middle'), or centred in fill ('center')."""
    n = F.size(items)
    offset = F.lit(0) if mode == "edge" else F.floor((F.lit(size) - n) / 2).cast("int")
    if mode not in ("edge", "middle", "center"):
        raise ValueError("mode is 'edge', 'middle' or 'center'")
    places = F.sequence(F.lit(0), F.lit(size - 1))
    if mode == "center":
        return F.transform(places, lambda i: F.coalesce(F.get(items, i - offset), F.lit(0) if fill is None else fill))
    return F.transform(places, lambda i: F.get(items, F.pmod(i - offset, n)))


def tiled_matrix(rows: Column, height: int, width: int, mode: str) -> Column:
    """tiled in both directions; outside a centred matrix stands 0."""
    wide = F.transform(rows, lambda r: tiled(r, width, mode))
    return tiled(wide, height, mode, F.array_repeat(F.lit(0), width))
