"""The check on a stream: tokenising and the dictionary join are row-local, so they run on ``readStream``
as they stand; reports are written batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexcheck.operators import check
from lexcheck.operators.tokenize import normalised, tokenize
from lexcheck.sources.settings import Settings


def unknown_words(texts: DataFrame, words: DataFrame, config: Settings, key: str, content: str) -> DataFrame:
    """The unknown tokens of a streaming (or static) frame; the dictionary is static."""
    return check.unknown(normalised(tokenize(texts, key, content, config)), words)


def windowed_counts(texts: DataFrame, words: DataFrame, config: Settings, key: str, content: str, time: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Unknown words by time window; texts later than the watermark are not counted."""
    marked = texts.withWatermark(time, late)
    rows = check.unknown(normalised(tokenize(marked.withColumn("_key", F.struct(key, time)), "_key", content, config)), words)
    return rows.groupBy(F.window(F.col(f"_key.{time}"), width)).agg(F.count(F.lit(1)).alias("errors"))


def start_check(texts: DataFrame, words: DataFrame, config: Settings, key: str, content: str, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Calls ``sink(errors, batch)`` for every batch; the checkpoint folder makes restarts resume."""

    def each(batch: DataFrame, number: int) -> None:
        sink(unknown_words(batch, words, config, key, content), number)

    return texts.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
