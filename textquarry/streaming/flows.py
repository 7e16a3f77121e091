"""Streaming counterparts: append-only sink, keyed deduplication, result upsert.

The reference works in batches; these flows carry its append-as-you-go sink and
resumable runs over to Structured Streaming.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textquarry.functions.tokens import word_count


def append_jsonl(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Every accepted record appended to JSON lines, exactly once over restarts (K5)."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def gated(stream: DataFrame, text: str, gate: Callable[[Column], Column]) -> DataFrame:
    """Records that pass a gate, with its reason and word count: stateless."""
    g = stream.withColumn("_gate", gate(F.col(text)))
    return g.filter("_gate.ok").withColumn("n_words", word_count(F.col(text))).drop("_gate")


def first_within(stream: DataFrame, key: Column, time: str, late: str = "1 day") -> DataFrame:
    """The first record of a key within the watermark: state is dropped after it."""
    return stream.withColumn("_key", F.md5(key)).withWatermark(time, late).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def upsert_batches(stream: DataFrame, write: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Hands each micro-batch to an upsert; the writer must be idempotent by key."""
    return stream.writeStream.foreachBatch(lambda df, _: write(df)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
