"""Learning bin edges per designator, and bins by them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeloom.functions.arrays import digitize
from timeloom.functions.columns import finite

#: Bins of the quantizers.
BINS = {"centiles": 100, "deciles": 10, "ventiles": 20}
SIGMAS = ["Q3-", "Q2-", "Q1-", "Q0-", "Q0+", "Q1+", "Q2+", "Q3+"]
EPSILON = 2.220446049250313e-16


def bin_words(quantizer: str) -> list[str]:
    return SIGMAS if quantizer == "sigmas" else [f"Q{i}" for i in range(BINS[quantizer])]


def _shares(n: int) -> F.Column:
    return F.array(*[F.lit(i / n) for i in range(1, n)])


def learn_breaks(
    values: DataFrame, *, by: str = "designator", value: str = "value", quantizer: str = "deciles", detect_discrete: bool = False,
    ref_lower: str | None = None, ref_upper: str | None = None, ordinal: str | None = None, digits: int | None = None, accuracy: int | None = None,
) -> DataFrame:
    """(designator, breaks): one aggregation for all designators.

    Exact quantiles with linear interpolation over (value, count) pairs, which
    partial aggregation merges first; ``accuracy`` takes percentile_approx
    instead, whose state is bounded.  With ``ordinal`` a designator learns from
    the rows with its smallest ordinal only.
    """
    rows = values.where(finite(F.col(value))).withColumn("__v", F.col(value).cast("double"))
    if ordinal:
        first = rows.groupBy(by).agg(F.min(ordinal).alias("__first"))
        rows = rows.join(first, by).where(F.col(ordinal) == F.col("__first"))
    refs = []
    if ref_lower and ref_upper:
        # limits of a designator: the modes
        refs = [F.mode(ref_lower, True).alias("__lo"), F.mode(ref_upper, True).alias("__hi")]
        rows = rows.join(rows.groupBy(by).agg(*refs), by)
    keys = [by, "__lo", "__hi"] if refs else [by]
    counts = rows.groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__n"))
    if quantizer == "sigmas":
        breaks = F.transform(F.sequence(F.lit(-3), F.lit(3)), lambda i: F.col("__m") + i * (F.col("__s") + EPSILON))
        found = rows.groupBy(*keys).agg(F.avg("__v").alias("__m"), F.stddev_pop("__v").alias("__s")).select(by, breaks.alias("breaks"))
    else:
        quantiles = lambda cond, n: (
            F.percentile(F.when(cond, F.col("__v")), _shares(n), F.col("__n")) if accuracy is None
            else F.percentile_approx(F.when(cond, F.col("__v")), _shares(n), accuracy)
        )
        source = counts if accuracy is None else rows
        if refs:
            v, lo, hi = F.col("__v"), F.col("__lo"), F.col("__hi")
            none = F.array().cast("array<double>")
            found = source.groupBy(*keys).agg(
                quantiles(v < lo, 5).alias("__a"), quantiles(v.between(lo, hi), 10).alias("__b"), quantiles(v > hi, 5).alias("__c"),
                quantiles(F.lit(True), 20).alias("__all"),
            )
            ranged = F.array_sort(F.array_distinct(F.concat(
                F.coalesce("__a", none), F.array(lo.cast("double")), F.coalesce("__b", none), F.array(hi.cast("double")), F.coalesce("__c", none)
            )))
            found = found.select(by, F.when(lo.isNotNull() & hi.isNotNull(), ranged).otherwise(F.col("__all")).alias("breaks"))
        else:
            found = source.groupBy(by).agg(quantiles(F.lit(True), BINS[quantizer]).alias("breaks"))
    if detect_discrete:
        most = len(bin_words(quantizer))
        # at most ``most`` values are collected
        ranked = counts.groupBy(by, "__v").count().groupBy(by).agg(F.count(F.lit(1)).alias("__k"))
        few = counts.join(ranked.where(F.col("__k") <= most), by, "left_semi").groupBy(by).agg(F.array_sort(F.collect_set("__v")).alias("__u"))
        found = found.join(few, by, "left").select(
            by, F.when(F.col("__u").isNotNull(), F.slice("__u", 2, most)).otherwise(F.col("breaks")).alias("breaks")
        )
    if digits is not None:
        found = found.withColumn("breaks", F.transform("breaks", lambda b: F.round(b, digits)))
    return found


def apply_breaks(values: DataFrame, breaks: DataFrame, *, by: str = "designator", value: str = "value", digits: int | None = None) -> DataFrame:
    """Adds ``bin``: the number of edges not above the value; null for non-finite values and unknown designators."""
    x = F.when(finite(F.col(value)), F.col(value).cast("double"))
    x = F.round(x, digits) if digits is not None else x
    return values.join(breaks, by, "left").withColumn("bin", digitize(x, F.col("breaks"))).drop("breaks")
