"""Chronological group-level splits and routing of tables to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from timeloom.operators.joins import disjoint
from timeloom.sources.tables import first_column


def group_split(reference: DataFrame, group: str, start: str, train: float = 0.7, val: float = 0.1) -> DataFrame:
    """(group, split): groups by earliest start, then by id; floor(train * n) train, floor(val * n) val, the rest test.

    The rank of a group comes from two-level counts: groups per day, then the
    order inside the day.  Ties in a day are ordered in one task per day.
    """
    if not (0 <= train and 0 <= val and train + val <= 1):
        raise ValueError("shares must be between 0 and 1, their sum too")
    first = reference.groupBy(group).agg(F.min(start).alias("__first")).withColumn("__day", F.to_date("__first"))
    days = first.groupBy("__day").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.orderBy(F.col("__day").asc_nulls_last())
    before = days.select(F.col("__day").alias("__d"), (F.sum("__n").over(w) - F.col("__n")).alias("__before"), F.sum("__n").over(Window.partitionBy()).alias("__all"))
    rank = F.row_number().over(Window.partitionBy("__day").orderBy("__first", group)) + F.col("__before")
    ranked = first.join(before, F.col("__day").eqNullSafe(F.col("__d"))).withColumn("__rank", rank.cast("long"))
    n_train, n_val = F.floor(F.col("__all") * F.lit(train)), F.floor(F.col("__all") * F.lit(val))
    return ranked.select(
        group, F.when(F.col("__rank") <= n_train, "train").when(F.col("__rank") <= n_train + n_val, "val").otherwise("test").alias("split")
    )


def dev_sample(reference: DataFrame, group: str, start: str, share: float = 0.01) -> DataFrame:
    """The earliest groups, floor(share * n) of them."""
    return group_split(reference, group, start, share, 0.0).where("split = 'train'").select(group)


def route(table: DataFrame, ids: DataFrame, *keys: str) -> DataFrame:
    """Rows of a table that belong to the ids, by the first of the keys that the table has."""
    key = first_column(table, *keys)
    own = key if key in ids.columns else ids.columns[0]
    return table.join(ids.select(F.col(own).cast(table.schema[key].dataType).alias(key)).distinct(), key, "left_semi")


def assert_disjoint(frames: dict[str, DataFrame], key: str) -> None:
    if not disjoint(list(frames.values()), key):
        raise ValueError(f"splits {list(frames)} share values of {key}")
