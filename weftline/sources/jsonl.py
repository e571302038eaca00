"""JSON-lines scan with exact row numbers, over any Hadoop file system and in splittable blocks; other encodings by a Python data source."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..plans.ordered import position, prefix
from . import files

SCHEMA = "text string, _source string, file_idx int, _row_number bigint, guid string"


def resolve(spark: SparkSession, paths: list[str], exclude: list[str] | None = None) -> list[str]:
    """The .jsonl files of paths (folders are not searched recursively), sorted within a folder, without excluded base names."""
    found: list[str] = []
    for p in paths:
        found += [f"{p.rstrip('/')}/{f}" for f in files.listed(spark, p) if f.endswith(".jsonl")] if files.is_folder(spark, p) else [p]
    return [f for f in found if f.rsplit("/", 1)[-1] not in set(exclude or [])]


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file_idx, line, __n: every line of the files with its number (from 0) in its file.

    A file is read in blocks. Lines of a block are numbered as they come; the lines of the
    blocks before it, a row for each block, are added.
    """
    lines = spark.read.text(paths).select("value", F.monotonically_increasing_id().alias("__id"), "_metadata.file_path", F.col("_metadata.file_block_start").alias("__block"))
    blocks = lines.groupBy("file_path", "__block").agg(F.min("__id").alias("__first"), F.count("*").alias("__lines"))
    before = F.coalesce(F.sum("__lines").over(Window.partitionBy("file_path").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    names = F.array(*[F.lit(files.hadoop(spark, p)[1].makeQualified(files.hadoop(spark, p)[0]).toUri().toString()) for p in paths])
    blocks = blocks.withColumn("__before", before).drop("__lines")
    rows = lines.join(blocks, ["file_path", "__block"])
    bare = lambda n: F.regexp_replace(n, "^([a-z0-9]+):/+", "$1:/")  # noqa: E731 - one or three slashes after the scheme
    at = F.array_position(F.transform(names, bare), bare(F.col("file_path")))
    return rows.select((at.cast("int") - 1).alias("file_idx"), F.col("value").alias("line"), (F.col("__id") - F.col("__first") + F.col("__before")).alias("__n"), F.col("file_path"))


def _read_text(spark: SparkSession, name: str, paths: list[str], text_field: str, guid_field: str | None, compute_guid: bool) -> DataFrame:
    rows = _lines(spark, paths).withColumn("line", F.regexp_replace("line", "^\\x{FEFF}", ""))
    rows = rows.withColumn("__v", F.try_parse_json("line")).where("__v is not null")
    where = F.concat(F.col("file_path"), F.lit(", line "), F.col("__n") + 1)

    def field(f: str, needed: bool):
        path = "$." + f if f.replace("_", "a").isalnum() else f"$['{f}']"
        value = F.try_variant_get("__v", path, "string")
        if not needed:
            return value
        there = F.try_variant_get("__v", path, "variant").isNotNull()
        return F.when(there, value).otherwise(F.raise_error(F.concat(F.lit(f"no field '{f}' in "), where)).cast("string"))

    own = F.try_variant_get("__v", "$._source", "variant").isNotNull()
    base = F.concat(F.lit(f"{name}_"), F.element_at(F.array(*[F.lit(p.rsplit("/", 1)[-1]) for p in paths]), F.col("file_idx") + 1))
    text = field(text_field, True)
    guid = field(guid_field, True) if guid_field else F.sha2(text, 256) if compute_guid else F.lit(None).cast("string")
    return rows.select(text.alias("text"), F.when(own, field("_source", False)).otherwise(base).alias("_source"), "file_idx", F.col("__n").alias("_row_number"), guid.alias("guid"))


class _File(InputPartition):
    def __init__(self, index: int, path: str):
        super().__init__(index)
        self.index, self.path = index, path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.files = json.loads(options["files"])
        self.name, self.text = options["name"], options.get("textfield", "text")
        self.guid, self.compute = options.get("guidfield") or None, options.get("computeguid", "false") == "true"
        self.encoding = options.get("encoding", "utf-8-sig")

    def partitions(self) -> list[InputPartition]:
        return [_File(i, f) for i, f in enumerate(self.files)]

    def read(self, partition: _File) -> Iterator[tuple]:
        base = os.path.basename(partition.path)
        with open(partition.path.removeprefix("file://"), encoding=self.encoding) as lines:
            for number, line in enumerate(lines):
                try:
                    record = json.loads(line)
                except ValueError:
                    continue
                where = f"{partition.path}, line {number + 1}"
                if not isinstance(record, dict) or self.text not in record:
                    raise ValueError(f"no field {self.text!r} in {where}")
                text = record[self.text]
                guid = None
                if self.guid:
                    if self.guid not in record:
                        raise ValueError(f"no field {self.guid!r} in {where}")
                    guid = record[self.guid]
                elif self.compute:
                    guid = None if text is None else hashlib.sha256(text.encode()).hexdigest()
                yield (text, record.get("_source", f"{self.name}_{base}"), partition.index, number, None if guid is None else str(guid))


class JsonlSource(DataSource):
    """Format 'weftline_jsonl', for files in other encodings than UTF-8 on a mounted file system: one partition a file."""

    @classmethod
    def name(cls) -> str:
        return "weftline_jsonl"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(self.options)


def read_jsonl(
    spark: SparkSession, name: str, paths: list[str], exclude: list[str] | None = None, text_field: str = "text",
    guid_field: str | None = None, compute_guid: bool = False, limit: int = 0, encoding: str = "utf-8-sig",
) -> DataFrame:
    """text, _source, file_idx, _row_number, guid of the files' records; limit counts over all files of the source (0: all).

    Lines that do not parse are skipped, but counted in _row_number. A valid line without
    text_field (or guid_field, where named) stops the query. _source is the record's own,
    null too, or name_file where the record has none. No files: no rows.
    """
    found = resolve(spark, paths, exclude)
    if not found:
        return spark.createDataFrame([], SCHEMA)
    if encoding.lower().replace("_", "-") in ("utf-8", "utf-8-sig", "utf8"):
        df = _read_text(spark, name, found, text_field, guid_field, compute_guid)
    else:
        spark.dataSource.register(JsonlSource)
        options = {"files": json.dumps(found), "name": name, "textField": text_field, "guidField": guid_field or "", "computeGuid": str(compute_guid).lower(), "encoding": encoding}
        df = spark.read.format("weftline_jsonl").options(**options).load()
    if limit:
        df = prefix(df.withColumn("__at", F.col("file_idx").cast("long") * (1 << 40) + F.col("_row_number")), "__at", F.lit(1), limit).drop("__at")
    return df


def write_lines(df: DataFrame, key: str, line: str, path: str) -> None:
    """Lines in order of key as one file; for files of a size that one task may write."""
    folder = f"{path}.parts"
    df.coalesce(1).sortWithinPartitions(key).select(line).write.text(folder)
    part = next(f for f in files.listed(df.sparkSession, folder) if f.startswith("part-"))
    files.move(df.sparkSession, f"{folder}/{part}", path)
    files.remove(df.sparkSession, folder)


def read_dataset(spark: SparkSession, base: str, config: str | None = None, split: str | None = None) -> DataFrame:
    """A parquet data set kept as base[/config][/split]; the first of these folders that exists, the most specific first. None is an error."""
    names = [[config, split], [split], [config], []]
    for parts in names:
        folder = "/".join([base.rstrip("/"), *[p for p in parts if p]])
        if all(parts) and files.is_folder(spark, folder):
            return spark.read.parquet(folder)
    raise ValueError(f"no data set in {base}")


def read_parquet_source(df: DataFrame, name: str, key: str, criteria: list[dict] | None, limit: int = 0, seed: int = 42, text_field: str = "text") -> DataFrame:
    """A table as a corpus source: filtered (see filter_union), in hash order of key, numbered after the shuffle, cut to limit."""
    from ..functions.texts import hash_order
    from ..operators.corpus import filter_union

    rows = filter_union(df, criteria or []).withColumn("__h", F.conv(F.substring(hash_order(seed, F.col(key)), 1, 15), 16, 10).cast("long"))
    if limit:
        rows = prefix(rows, "__h", F.lit(1), limit, ties=[key])
    rows = position(rows, "__h", "__n", ties=[key])
    return rows.select(F.col(text_field).alias("text"), F.lit(name).alias("_source"), (F.col("__n") - 1).alias("_row_number"), F.col(key))


def by_path(df: DataFrame, path: str, include: list[str], exclude: list[str]) -> DataFrame:
    """Rows whose path holds one of include (none: all) and none of exclude."""
    kept = df.where(F.col(path).isNotNull())
    if include:
        hit = F.lit(False)
        for x in include:
            hit = hit | F.contains(F.col(path), F.lit(x))
        kept = kept.where(hit)
    for x in exclude:
        kept = kept.where(~F.contains(F.col(path), F.lit(x)))
    return kept


def read_gz_json(spark: SparkSession, folder: str, include: list[str] | None = None, exclude: list[str] | None = None, schema: str = "id string, text string, source string") -> DataFrame:
    """All *.json.gz below folder, pruned by substrings of the full path before they are read."""
    df = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json.gz").json(folder)
    return by_path(df.withColumn("path", F.col("_metadata.file_path")), "path", include or [], exclude or [])
