"""Validated, interval, band and as-of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from timeloom.functions.columns import micros


def assert_unique(df: DataFrame, keys: list[str], what: str = "right side") -> None:
    """Raises if a key occurs twice; nulls match nothing and don't count."""
    some = df.where(F.col(keys[0]).isNotNull()).groupBy(*keys).count().where("count > 1").take(1)
    if some:
        raise ValueError(f"{what} isn't unique by {keys}: {some[0].asDict()}")


def validated_join(left: DataFrame, right: DataFrame, on: list[str] | str, how: str = "left", validate: str = "m:1", suffix: str = "_right") -> DataFrame:
    """Equi-join with a check of its cardinality; clashing columns of the right side get a suffix."""
    on = [on] if isinstance(on, str) else list(on)
    from_left, from_right = validate.split(":")
    if from_right == "1":
        assert_unique(right, on)
    if from_left == "1":
        assert_unique(left, on, "left side")
    clash = {c: c + suffix for c in right.columns if c in left.columns and c not in on}
    return left.join(right.withColumnsRenamed(clash), on, how)


def interval_join(events: DataFrame, spans: DataFrame, on: list[str], ts: str, start: str, end: str, how: str = "inner") -> DataFrame:
    """Equi-join whose event time lies between start and end, both included."""
    right = spans.withColumnsRenamed({c: f"__{c}" for c in on})
    same = [events[c] == right[f"__{c}"] for c in on]
    within = events[ts].between(right[start], right[end])
    cond = same[0]
    for c in [*same[1:], within]:
        cond = cond & c
    return events.join(right, cond, how).drop(*[f"__{c}" for c in on])


def repeated_rows(joined: DataFrame, row_id: str) -> DataFrame:
    """How many rows of an interval join come from overlapping intervals."""
    return joined.agg((F.count(F.lit(1)) - F.countDistinct(row_id)).alias("n_overlaps"))


def band_join(left: DataFrame, right: DataFrame, on: str, ts: str, after: str, open_start: bool = False, how: str = "inner") -> DataFrame:
    """Pairs of one key whose right time lies up to ``after`` (an interval) behind the left one; right time as {ts}_right."""
    other = right.withColumnsRenamed({on: "__on", ts: f"{ts}_right"})
    lo = F.col(f"{ts}_right") > F.col(ts) if open_start else F.col(f"{ts}_right") >= F.col(ts)
    within = (F.col(on) == F.col("__on")) & lo & (F.col(f"{ts}_right") <= F.col(ts) + F.expr(f"INTERVAL {after}"))
    return left.join(other, within, how).drop("__on")


def flag_followed(left: DataFrame, right: DataFrame, on: str, ts: str, seconds: int, flag: str, open_start: bool = True) -> DataFrame:
    """Adds 0/1: whether ``right`` has a row of the same key within so many seconds behind.

    One sort per key of both sides' times, no pairs: the next right time is a
    window minimum.  Null keys and times match nothing.
    """
    marked = left.withColumn("__own", F.lit(True)).unionByName(right.select(on, ts).dropna().withColumn("__own", F.lit(False)), allowMissingColumns=True)
    at = micros(F.col(ts))
    ahead = Window.partitionBy(on).orderBy(at).rangeBetween(1 if open_start else 0, seconds * 1_000_000)
    hit = F.coalesce(F.max(F.when(~F.col("__own"), 1)).over(ahead), F.lit(0))
    return marked.withColumn(flag, hit.cast("int")).where("__own").drop("__own")


def asof_join(left: DataFrame, right: DataFrame, on: str, left_ts: str, right_ts: str, columns: list[str], backward: bool = True) -> DataFrame:
    """Left as-of join: the latest right row not after (or the earliest not before) the left row's time.

    Both sides are put in one order per key and the last right row seen is
    carried along: one shuffle and sort, linear in the rows.  ``columns`` of
    the right row come along; of equal right times that with the largest
    ``columns`` is used.  Null keys and times match nothing.
    """
    payload = F.struct(F.col(right_ts).alias("__t"), *[F.col(c).alias(c) for c in columns])
    lhs = left.withColumns({"__k": F.col(on), "__at": F.col(left_ts), "__right": F.lit(None).cast(right.select(payload.alias("x")).schema["x"].dataType), "__side": F.lit(1)})
    rhs = right.dropna(subset=[on, right_ts]).groupBy(F.col(on).alias("__k"), F.col(right_ts).alias("__at")).agg(F.max(payload).alias("__right")).withColumn("__side", F.lit(0))
    both = lhs.unionByName(rhs, allowMissingColumns=True)
    order = [F.col("__at").asc(), F.col("__side").asc()] if backward else [F.col("__at").desc(), F.col("__side").asc()]
    w = Window.partitionBy("__k").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("__seen", F.when(F.col("__at").isNotNull(), F.last("__right", ignorenulls=True).over(w))).where("__side = 1")
    names = {c: (c if c not in left.columns else f"{c}_right") for c in columns}
    matched = right_ts if right_ts not in left.columns else f"{right_ts}_right"
    return out.select(*left.columns, F.col("__seen.__t").alias(matched), *[F.col("__seen")[c].alias(n) for c, n in names.items() if c != right_ts])


def disjoint(frames: list[DataFrame], key: str) -> bool:
    """Whether no key is in two of the frames: one aggregation, not a join per pair."""
    tagged = None
    for i, df in enumerate(frames):
        one = df.select(key).distinct().withColumn("i", F.lit(i))
        tagged = one if tagged is None else tagged.unionByName(one)
    return tagged.groupBy(key).count().where("count > 1").isEmpty()
