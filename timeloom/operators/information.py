"""Token- and event-level information, redaction and representation jumps, on long rows (sid, pos, ts, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from timeloom.functions.arrays import minus, norm2

#: Reducers that may be named.
AGGREGATIONS = ("sum", "max")


def token_information(log_probs: DataFrame, value: str = "logp") -> DataFrame:
    """Adds bits: -log p / ln 2; the first token has none."""
    return log_probs.withColumn("bits", F.when(F.col("pos") == 0, F.lit(0.0)).otherwise(-F.col(value) / F.log(F.lit(2.0))))


def event_information(tokens: DataFrame, value: str = "value", how: str = "sum", sid: str = "sid", ts: str = "ts") -> DataFrame:
    """Adds event_value: the sum or maximum over the tokens of the same time."""
    if how not in AGGREGATIONS:
        raise ValueError(f"how must be one of {AGGREGATIONS}")
    return tokens.withColumn("event_value", getattr(F, how)(value).over(Window.partitionBy(sid, ts)))


def top_quantile_counts(rows: DataFrame, key: str, value: str, q: float) -> DataFrame:
    """Per key the number of values not below the quantile of all values; keys with null values only have 0."""
    limit = rows.agg(F.percentile(value, F.lit(q)).alias("__q"))  # one row
    return rows.crossJoin(F.broadcast(limit)).groupBy(key).agg(F.sum((F.coalesce(F.col(value) >= F.col("__q"), F.lit(False))).cast("int")).alias("n_top"))


def redact(
    tokens: DataFrame, value: str, *, k: int | None = None, pct: float | None = None, method: str = "top", how: str = "sum",
    sid: str = "sid", ts: str = "ts", pos: str = "pos", seed: int = 0,
) -> DataFrame:
    """Drops all tokens of the k (or the share pct) most, least or randomly informative events.

    The event of the first token is never dropped.  Ties go to the earlier event.
    """
    if (k is None) == (pct is None):
        raise ValueError("give k or pct")
    if how not in AGGREGATIONS or method not in ("top", "bottom", "random"):
        raise ValueError("how is sum or max; method is top, bottom or random")
    events = tokens.groupBy(sid, ts).agg(getattr(F, how)(value).alias("__v"), F.min(pos).alias("__first"))
    can = events.where("__first > 0")
    order = {"top": F.col("__v").desc(), "bottom": F.col("__v").asc(), "random": F.xxhash64(F.lit(seed), sid, ts).asc()}[method]
    w = Window.partitionBy(sid).orderBy(order, F.col(ts))
    ranked = can.withColumn("__r", F.row_number().over(w))
    most = F.lit(k) if k is not None else F.floor(F.lit(pct) * F.count(F.lit(1)).over(Window.partitionBy(sid)))
    gone = ranked.withColumn("__most", most).where(F.col("__r") <= F.col("__most")).select(sid, ts)
    return tokens.join(gone, [sid, ts], "left_anti")


def jumps(rows: DataFrame, vector: str, sid: str = "sid", pos: str = "pos") -> DataFrame:
    """Adds jump: the length of the step from the vector before; the first vector's own length."""
    before = F.lag(vector).over(Window.partitionBy(sid).orderBy(pos))
    return rows.withColumn("jump", F.when(before.isNull(), norm2(F.col(vector))).otherwise(norm2(minus(F.col(vector), before))))


def event_jumps(rows: DataFrame, vector: str, sid: str = "sid", ts: str = "ts", pos: str = "pos") -> DataFrame:
    """Per event: the length from the last vector before it to its own last one; the first event is left out."""
    events = rows.groupBy(sid, ts).agg(F.max_by(vector, pos).alias("__last"), F.min(pos).alias("__first"))
    before = F.lag("__last").over(Window.partitionBy(sid).orderBy("__first"))
    return events.withColumn("__before", before).where("__before is not null").select(sid, ts, norm2(minus(F.col("__last"), F.col("__before"))).alias("event_jump"))


def event_paths(rows: DataFrame, jump: str, value: str | None = None, sid: str = "sid", ts: str = "ts") -> DataFrame:
    """Per event: path length, number of tokens and, if asked, information."""
    more = [F.sum(value).alias("information")] if value else []
    return rows.groupBy(sid, ts).agg(F.sum(jump).alias("path_length"), F.count(F.lit(1)).alias("n_tokens"), *more)


def moving_average(rows: DataFrame, value: str, width: int = 4, sid: str = "sid", pos: str = "pos") -> DataFrame:
    """Adds mvg_avg: the mean of the last ``width`` values, the first value standing in for those before it."""
    order = Window.partitionBy(sid).orderBy(pos)
    near = order.rowsBetween(-(width - 1), 0)
    first = F.first(value).over(order.rowsBetween(Window.unboundedPreceding, 0))
    have = F.count(F.lit(1)).over(near)
    return rows.withColumn("mvg_avg", (F.sum(value).over(near) + (F.lit(width) - have) * first) / F.lit(float(width)))


def mc_estimates(rows: DataFrame, *, sid: str = "sid", sample: str = "sample", p: str = "p", hit: str = "hit") -> DataFrame:
    """Per subject: m0 share of samples that end in the outcome, m1 mean of summed p, m2 mean of 1 - prod(1 - p)."""
    none = F.exp(F.sum(F.when(F.col(p) < 1, F.log(1 - F.col(p)))))
    sure = F.max((F.col(p) >= 1).cast("int"))
    per = rows.groupBy(sid, sample).agg(F.max(F.col(hit).cast("int")).alias("h"), F.sum(p).alias("s"), F.when(sure == 1, 1.0).otherwise(1 - F.coalesce(none, F.lit(1.0))).alias("m"))
    return per.groupBy(sid).agg(F.avg("h").alias("m0"), F.avg("s").alias("m1"), F.avg("m").alias("m2"))


def prototype_projection(rows: DataFrame, vector: str, prototype: Column, sid: str = "sid", pos: str = "pos") -> DataFrame:
    """Adds proj_abs and proj_rel: the step along the prototype, and along the way that is left to it; null where there is none."""
    from timeloom.functions.arrays import dot

    zero = F.transform(vector, lambda x: x * 0)
    before = F.coalesce(F.lag(vector).over(Window.partitionBy(sid).orderBy(pos)), zero)
    rows = rows.withColumns({"__b": before, "__p": prototype})
    step, left = minus(F.col(vector), F.col("__b")), minus(F.col("__p"), F.col("__b"))
    return rows.withColumns({"proj_abs": F.try_divide(dot(step, F.col("__p")), norm2(F.col("__p"))), "proj_rel": F.try_divide(dot(step, left), norm2(left))}).drop("__b", "__p")


def final_states(rows: DataFrame, vector: str, token: str, pad: int, sid: str = "sid", pos: str = "pos") -> DataFrame:
    """Per subject the vector at the last position that isn't padding."""
    return rows.where(F.col(token) != pad).groupBy(sid).agg(F.max_by(vector, pos).alias(vector))
