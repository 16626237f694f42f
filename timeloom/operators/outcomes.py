"""Outcome flags and length of stay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeloom.functions.columns import whole_hours

LONG_STAY_HOURS = 7 * 24


def stay_lengths(timelines: DataFrame, times: str = "times") -> DataFrame:
    """Adds length_of_stay in whole hours and long_length_of_stay."""
    hours = whole_hours(F.try_element_at(times, F.lit(1)), F.try_element_at(times, F.lit(-1)))
    return timelines.withColumn("length_of_stay", hours).withColumn("long_length_of_stay", F.col("length_of_stay") > LONG_STAY_HOURS)


def flags(timelines: DataFrame, outcomes: dict[str, str], items: str = "words") -> DataFrame:
    """A boolean per outcome: whether its word is in the timeline; unknown words are in none."""
    return timelines.withColumns({name: F.array_contains(items, word) for name, word in outcomes.items()})


def with_early(full: DataFrame, cut: DataFrame, outcomes: dict[str, str], key: str = "sid", suffix: str = "_24h") -> DataFrame:
    """Cut timelines with outcomes of the whole timeline, and flags of their own."""
    early = flags(cut, {f"{n}{suffix}": w for n, w in outcomes.items()})
    late = flags(stay_lengths(full), outcomes).select(key, "length_of_stay", "long_length_of_stay", *outcomes)
    return early.join(late, key, "left")
