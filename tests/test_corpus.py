"""Long texts count whole in the flagship query."""

import datetime

from weftline import registry


def test_texts_that_differ_late_are_two(spark, tmp_path):
    same, now = "word " * 4_000, datetime.datetime(2024, 1, 1)  # 20,000 characters
    texts = [same + "one end", same + "other end here", same + "one end", "short"]
    rows = [(i, "web", t, now) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "rec_id bigint, _source string, text string, ingested_at timestamp").write.parquet(f"{tmp_path}/corpus_records.parquet")
    got = registry.queries()["corpus_build"](spark, str(tmp_path)).collect()
    assert sum(r["documents"] for r in got) == 3 and sum(r["tokens"] for r in got) == 4_002 + 4_003 + 1
    docs = [(i, t) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"]: r["n"] for r in registry.queries()["clean_text"](spark, str(tmp_path)).collect()} == {0: 20_000, 1: 20_000, 2: 20_000, 3: 5}
