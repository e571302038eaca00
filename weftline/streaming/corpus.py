"""Streams of corpus records: keep-first within a watermark, counts by event time, concatenation into chunks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.shared import shared_dir


def keep_first(stream: DataFrame, keys: list[str], event_time: str, delay: str) -> DataFrame:
    """The first arrival of each key; a key is remembered for delay of event time, which bounds the state."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def counts_by_time(stream: DataFrame, event_time: str, width: str, delay: str, by: list[str]) -> DataFrame:
    """Rows by tumbling window of event time and by; rows later than delay behind the latest are left out once their window closed."""
    start = F.window(event_time, width)
    return stream.where(F.col(event_time).isNotNull()).withWatermark(event_time, delay).groupBy(start.alias("w"), *by).agg(F.count("*").alias("n"))


def chunks(stream: DataFrame, shard: str, order: str, ids: str, length: int) -> DataFrame:
    """shard, chunk, input_ids: each shard's sequences, in order within a micro-batch, concatenated and cut into chunks of length.

    The tokens over wait in the state (fewer than length of them) for the next micro-batch.
    """
    kind = stream.schema[shard].dataType.simpleString()

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, rest = state.get if state.exists else (0, [])
        rows = pd.concat(list(batches)).sort_values(order)
        tokens = np.concatenate([np.asarray(rest, np.int64), *[np.asarray(x, np.int64) for x in rows[ids] if x is not None]])
        full = len(tokens) // length
        out = [(key[0], number + i, tokens[i * length : (i + 1) * length].tolist()) for i in range(full)]
        state.update((number + full, tokens[full * length :].tolist()))
        if out:
            yield pd.DataFrame({"s": [o[0] for o in out], "c": [o[1] for o in out], "i": pd.Series([o[2] for o in out], dtype=object)}).set_axis([shard, "chunk", "input_ids"], axis=1)

    return stream.select(shard, order, ids).groupBy(shard).applyInPandasWithState(step, f"{shard} {kind}, chunk bigint, input_ids array<bigint>", "number bigint, rest array<bigint>", "append", GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, label: str) -> DataFrame:
    """Run an append stream over what its source holds now, into a table of the shared folder, and read that."""
    spark = stream.sparkSession
    out = f"{shared_dir(spark)}/weftline-{label}-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{out}-progress").option("path", out).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_to_memory(stream: DataFrame, label: str) -> DataFrame:
    """Run an aggregated stream over what its source holds now and give its complete result (a row for each group; small by design)."""
    spark = stream.sparkSession
    name = f"weftline_{label}_{uuid.uuid4().hex}"
    where = f"{shared_dir(spark)}/{name}-progress"
    query = stream.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", where).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)
