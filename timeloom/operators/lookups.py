"""Raw-record lookups, unit conversion and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def new_codes(later: DataFrame, earlier: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``later`` whose keys the earlier rows haven't."""
    return later.join(earlier.select(*keys).distinct(), keys, "left_anti")


def earlier_visits(visits: DataFrame, subject: str, visit: str, start: str) -> DataFrame:
    """Adds how many visits of the subject started before."""
    w = Window.partitionBy(subject).orderBy(start, visit)
    return visits.withColumn("n_earlier", F.row_number().over(w) - 1)


def estimated_age(df: DataFrame, start: str, anchor_age: str, anchor_year: str) -> DataFrame:
    return df.withColumn("age", F.col(anchor_age) + F.year(start) - F.col(anchor_year))


def convert_units(doses: DataFrame, units: DataFrame, category: str, unit: str, value: str) -> DataFrame:
    """Value in the preferred unit by a (category, unit, factor, preferred) table; status tells what has no factor."""
    joined = doses.join(units.select(category, unit, "factor", "preferred"), [category, unit], "left")
    return joined.withColumn(f"{value}_converted", F.col(value) * F.col("factor")).withColumn("_convert_status", F.when(F.col("factor").isNotNull(), "success").otherwise("no factor"))


def follow_up_rate(first: DataFrame, second: DataFrame, key: str, ts: str, minutes: int) -> DataFrame:
    """Share of first-kind rows with a second-kind row of the same key within so many minutes."""
    from timeloom.operators.joins import flag_followed

    return flag_followed(first, second, key, ts, minutes * 60, "followed", open_start=False).agg(F.avg("followed").alias("rate"), F.count(F.lit(1)).alias("n"))


def value_shares(df: DataFrame, column: str, k: int | None = None) -> DataFrame:
    """Counts and shares of values, most frequent first, ties by value."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("__all"))  # one row
    out = counts.crossJoin(F.broadcast(total)).select(column, "n", (F.col("n") / F.col("__all")).alias("share")).orderBy(F.col("n").desc(), column)
    return out.limit(k) if k else out


def describe(df: DataFrame, value: str) -> DataFrame:
    """Count, nulls, mean, standard deviation, minimum, quartiles, maximum in one row."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return df.agg(
        F.count(value).alias("n"), F.count_if(F.col(value).isNull()).alias("n_null"), F.avg(value).alias("mean"), F.stddev(value).alias("std"),
        F.min(value).alias("min"), q.alias("q"), F.max(value).alias("max"),
    ).select("n", "n_null", "mean", "std", "min", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), "max")


def sample_keys(df: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """All rows of a share of the keys, chosen by a hash: no sort, the same on every run."""
    return df.where(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1_000_000)) < int(share * 1_000_000))


def split_evenly(df: DataFrame, parts: int, order: list[str], partition: list[str] | None = None) -> DataFrame:
    """Adds part: consecutive parts whose sizes differ by one at most, larger ones first."""
    return df.withColumn("part", F.ntile(parts).over(Window.partitionBy(*(partition or [])).orderBy(*order)) - 1)


def shuffled_epochs(df: DataFrame, epochs: int, keys: list[str], seed: int = 0) -> DataFrame:
    """All rows once per epoch, in an order that a hash of epoch and keys gives."""
    rows = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    return rows.orderBy("epoch", F.xxhash64(F.lit(seed), "epoch", *keys))


def first_non_null(df: DataFrame, key: str, columns: list[str], order: list[str]) -> DataFrame:
    """Per key the first value of each column that isn't null."""
    return df.groupBy(key).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in columns])


def overlay(base: DataFrame, shard: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Values of the shard where they aren't zero, else those of the base."""
    other = shard.select(*keys, F.col(value).alias("__v"))
    return base.join(other, keys, "full").withColumn(value, F.when(F.col("__v") != 0, F.col("__v")).otherwise(F.coalesce(value, "__v"))).drop("__v")


def label_grid(df: DataFrame, rows: str, columns: str) -> DataFrame:
    """Counts for every pair of labels of two columns, zero where none occur; labels are few."""
    grid = df.select(rows).distinct().crossJoin(F.broadcast(df.select(columns).distinct()))
    counts = df.groupBy(rows, columns).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, [rows, columns], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def log_means(df: DataFrame, by: str, value: str) -> DataFrame:
    """Mean and median of logarithms, and the most frequent value (the smallest of several)."""
    return df.groupBy(by).agg(F.avg(F.log(value)).alias("mean_log"), F.median(F.log(value)).alias("median_log"), F.mode(value, True).alias("mode"))
