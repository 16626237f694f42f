"""Structured Streaming: events to tokens with a frozen vocabulary, and windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeloom.functions.columns import normalise_code
from timeloom.operators.quantize import apply_breaks
from timeloom.operators.vocab import Vocabulary, encode


def token_stream(events: DataFrame, vocabulary: Vocabulary, *, subject: str, ts: str, code: str, value: str, prefix: str) -> DataFrame:
    """sid, ts, word, token, bin for each event of a stream; joins with static, frozen tables only, so there is no state."""
    word = F.concat(F.lit(f"{prefix}_"), normalise_code(F.col(code)))
    rows = events.select(F.col(subject).cast("string").alias("sid"), F.col(ts).alias("ts"), word.alias("word"), F.col(value).cast("double").alias("value"))
    binned = apply_breaks(rows.withColumn("designator", F.col("word")), F.broadcast(vocabulary.aux)).drop("designator")
    return encode(binned, vocabulary.words, vocabulary.fixed)


def windowed_counts(events: DataFrame, *, ts: str, code: str, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Events per code and time window; rows later than ``late`` are dropped."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.window(ts, window), code).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), code, "n")
