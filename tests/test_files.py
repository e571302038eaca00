"""Sources and sinks: exact line numbers, interrupted writes, indexes, result files."""

import codecs
import json

import pytest
from pyspark.sql import functions as F

from weftline.operators import corpus, metrics, packing, tasks
from weftline.sources import jsonl, sinks


def lines(path, rows, encoding="utf-8", bom=b""):
    path.write_bytes(bom + "\n".join(rows).encode(encoding) + b"\n")
    return str(path)


def read(df):
    return sorted((r["file_idx"], r["_row_number"], r["text"], r["_source"], r["guid"]) for r in df.collect())


def test_json_lines_as_they_stand(spark, tmp_path):
    a = lines(tmp_path / "a.jsonl", ['{"text": "x", "_source": "own"}', "not json", "", '{"text": null, "_source": null}', '{"text": "שלום", "id": 7}'], bom=codecs.BOM_UTF8)
    lines(tmp_path / "b b+c.jsonl", ['{"text": "y"}', '{"text": "z", "_source": ""}'])
    lines(tmp_path / "skip.jsonl", ['{"text": "no"}'])
    (tmp_path / "deep").mkdir()
    lines(tmp_path / "deep" / "c.jsonl", ['{"text": "no"}'])
    (tmp_path / "d.txt").write_text("no")
    got = read(jsonl.read_jsonl(spark, "n", [str(tmp_path)], exclude=["skip.jsonl"]).fillna("-", ["_source", "text", "guid"]))
    assert got == [(0, 0, "x", "own", "-"), (0, 3, "-", "-", "-"), (0, 4, "שלום", "n_a.jsonl", "-"), (1, 0, "y", "n_b b+c.jsonl", "-"), (1, 1, "z", "", "-")]
    limited = jsonl.read_jsonl(spark, "n", [str(tmp_path)], exclude=["skip.jsonl"], limit=4, compute_guid=True).where("text is not null").collect()
    assert sorted(r["text"] for r in limited) == ["x", "y", "שלום"] and all(len(r["guid"]) == 64 for r in limited)
    with pytest.raises(Exception, match="no field 'id'"):
        jsonl.read_jsonl(spark, "n", [a], guid_field="id").collect()
    with pytest.raises(Exception, match="no field"):
        jsonl.read_jsonl(spark, "n", [lines(tmp_path / "deep" / "e.jsonl", ["[1]"])]).collect()
    assert jsonl.read_jsonl(spark, "n", []).count() == 0
    other = lines(tmp_path / "deep" / "h.jsonl", ['{"text": "שלום", "_source": null}', "?"], encoding="cp1255")
    assert read(jsonl.read_jsonl(spark, "n", [other], encoding="cp1255").fillna("-")) == [(0, 0, "שלום", "-", "-")]


def test_line_numbers_across_blocks(spark, tmp_path):
    a = lines(tmp_path / "a.jsonl", [json.dumps({"text": f"t{i}", "fill": "x" * (i % 50)}) for i in range(5000)])
    b = lines(tmp_path / "b.jsonl", [json.dumps({"text": f"u{i}"}) for i in range(10)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = jsonl.read_jsonl(spark, "n", [b, a])
        assert df.rdd.getNumPartitions() > 1
        assert {r["text"]: (r["file_idx"], r["_row_number"]) for r in df.collect()} == {f"t{i}": (1, i) for i in range(5000)} | {f"u{i}": (0, i) for i in range(10)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_data_set_folders(spark, tmp_path):
    for folder in ("c/train", "test"):
        spark.range(3).withColumn("f", F.lit(folder)).write.parquet(f"{tmp_path}/{folder}")
    found = [jsonl.read_dataset(spark, str(tmp_path), c, s).first()["f"] for c, s in (("c", "train"), ("x", "test"), (None, "test"))]
    assert found == ["c/train", "test", "test"]
    with pytest.raises(ValueError):
        jsonl.read_dataset(spark, f"{tmp_path}/none")


def test_half_written_shards_are_written_anew(spark, tmp_path):
    path, df = f"{tmp_path}/out", spark.range(10)
    df.limit(3).write.parquet(path)
    (tmp_path / "out" / "_SUCCESS").unlink()
    assert sinks.write_shards(df, path, ["id"], mode="ignore").count() == 10
    assert sinks.write_shards(df.limit(1), path, ["id"], mode="ignore").count() == 10


def test_an_index_names_every_shard(spark, tmp_path):
    path = f"{tmp_path}/s"
    sinks.write_indexed(spark.range(100).select("id", F.array("id", "id", "id").alias("input_ids")), path, 30)
    assert sinks.read_indexed(spark, path).count() == 100 and sinks.read_indexed(spark, path, 2).first()["input_ids"] == [0, 0]
    next((tmp_path / "s" / "shards").glob("*.parquet")).unlink()
    with pytest.raises(ValueError, match="differ"):
        sinks.read_indexed(spark, path)
    with pytest.raises(ValueError, match="no index"):
        sinks.read_indexed(spark, f"{tmp_path}/none")


def test_recompression_goes_on_where_it_stopped(spark, tmp_path):
    path = tmp_path / "r"
    spark.range(50).write.parquet(str(path))
    assert sinks.recompress(spark, str(path), keep=True).count() == 50 and (tmp_path / "r.old").exists()
    (tmp_path / "r").rename(tmp_path / "r.new")  # stopped between the two renames
    assert sinks.recompress(spark, str(path)).count() == 50 and not (tmp_path / "r.old").exists() and not (tmp_path / "r.new").exists()


def test_result_files(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 1.5), (None, None), ('q"u, o', 2.0)], "k string, v double")
    for kind in ("csv", "json"):
        assert sorted(map(str, sinks.write_results(df, f"{tmp_path}/{kind}", kind).collect())) == sorted(map(str, df.collect()))
    got = [r["value"] for r in sinks.write_results(df, f"{tmp_path}/md", "markdown").collect()]
    assert got[0] == "| k | v |" and "| a\\|b | 1.5 |" in got and len(got) == 5
    with pytest.raises(ValueError):
        sinks.write_results(df, f"{tmp_path}/x", "xml")


def test_splits_and_ledger(spark, tmp_path):
    df = spark.range(20).withColumn("split", F.when(F.col("id") < 15, "train").otherwise("validation"))
    assert {tuple(r) for r in sinks.write_splits(df, f"{tmp_path}/w", ["id"]).collect()} == {("train", 15), ("validation", 5)}
    with pytest.raises(Exception, match="unknown split"):
        sinks.write_splits(df.withColumn("split", F.lit(None).cast("string")), f"{tmp_path}/v", ["id"])
    for n in (3, 5, 5):
        ledger = sinks.append_ledger(spark.range(n), f"{tmp_path}/ledger", ["id"])
    assert sorted(r["id"] for r in ledger.collect()) == list(range(5))


def test_registry_and_labels(spark):
    assert tasks.task_columns("wic", tasks.SUPERGLUE_COLUMNS) == ("sentence1", "sentence2") and tasks.task_columns("cola") == ("sentence", None)
    with pytest.warns(UserWarning, match="multiple of 8"):
        tasks.task_columns("rte", max_seq_length=100)
    items = spark.createDataFrame([("rte", "test", 1, "p", "h"), ("rte", "train", 2, "p", "h")], "task string, split string, label int, sentence1 string, sentence2 string")
    got = tasks.task_rows(items, "rte", "test", tasks.task_columns("rte"), ("label", 1))
    assert got.columns[:2] == ["sentence1", "sentence2"] and got.count() == 1
    with pytest.raises(ValueError):
        tasks.task_rows(items, "cola", "test", tasks.task_columns("cola"))
    with pytest.raises(ValueError):
        tasks.renamed_labels(items, {"absent": "x"})
    assert items.select(tasks.job_label(F.col("task"), F.col("label")).alias("v")).first()["v"] == "RTE(seed=1)"
    with pytest.raises(ValueError, match="warm-up"):
        packing.PackConfig.from_batch(8, 4, 16, 20, 4, warmup_least=6)


def test_metrics_of_logits_and_labels(spark):
    df = spark.createDataFrame([([0.0, 2.0], 1, [1, 0], [0.9, 0.6]), ([3.0, 3.0], 1, [0, 0], [0.1, 0.5]), ([], -100, [], []), (None, -100, None, None)], "e array<double>, y int, t array<int>, p array<double>")
    assert [r["c"] for r in df.select(metrics.argmax(F.col("e")).alias("c")).collect()] == [1, 0, None, None]
    import math

    expected = (math.log(1 + math.exp(-2)) + math.log(2)) / 2
    assert abs(df.agg(metrics.cross_entropy(F.col("e"), F.col("y")).alias("v")).first()["v"] - expected) < 1e-12
    row = metrics.multilabel(df.withColumn("g", F.lit(1)), ["g"], "t", "p").first()
    assert row["accuracy"] == 0.5 and row["f1"] == 0.5


def test_document_sample_is_bounded(spark):
    df = spark.createDataFrame([(f"s{i % 7}" if i % 9 else None, i, "t" if i % 5 else "") for i in range(400)], "s string, k int, t string")
    got = corpus.document_sample(df, "s", "k", "t", 25, shards=3, per_shard=10).collect()
    assert len(got) == 25 or len({r["s"] for r in got}) == 3
    assert all(r["t"] == "t" and r["s"] for r in got) and len({r["s"] for r in got}) <= 3
