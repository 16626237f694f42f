"""Word definitions and row identity shared by the text operators."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Between words that hold neither a space nor one of tab .. carriage return.
SPACES = r"[\x20\x09-\x0D]+"
#: Between words of a-z, digits and everything outside ASCII, once A-Z are lower-cased.
NOT_FOLDED = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; other letters stay.

    ``lower`` has a fast path for pure ASCII, where both are the same.
    """
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def words(text: Column, separators: str) -> Column:
    """Array of the words of ``text``, the stretches between ``separators``; an empty array for null.

    Splitting costs half of what matching the words themselves does.
    """
    return F.filter(F.split(F.coalesce(text, F.lit("")), separators), lambda w: w != "")


def text_key(text: Column) -> Column:
    """Tells apart rows that share an id but not a text."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


class Carried:
    """A table's columns under names (c0, c1, ...) that clash with none an operator uses; ``named`` gives them back."""

    def __init__(self, df: DataFrame):
        self.names = df.columns
        self.df = df.toDF(*[f"c{i}" for i in range(len(self.names))])

    def of(self, name: str) -> str:
        """The carried name of a column; as in Spark, case doesn't matter."""
        exact = [i for i, n in enumerate(self.names) if n == name] or [i for i, n in enumerate(self.names) if n.lower() == name.lower()]
        if len(exact) != 1:
            raise ValueError(f"{len(exact)} columns {name} among {self.names}")
        return f"c{exact[0]}"

    def named(self, df: DataFrame, results: Sequence[str] = ()) -> DataFrame:
        """Carried columns of ``df`` by their own names; one that is named as a result gets ``in_`` before its name."""
        taken = {r.lower() for r in results}
        back = {f"c{i}": n for i, n in enumerate(self.names)}
        out = []
        for c in df.columns:
            name = back.get(c, c)
            if c in back and c not in results:
                while name.lower() in taken:
                    name = f"in_{name}"
                taken.add(name.lower())
            out.append(name)
        return df.toDF(*out)


#: Estimates beyond that are Catalyst's for sources of unknown size and for joins without statistics.
UNKNOWN_BYTES = 1 << 50


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of ``df``; no job runs."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buckets_for(df: DataFrame, bytes_each: int = 16 << 20) -> int:
    """Number of buckets that keeps each near ``bytes_each`` of input, and all cores busy."""
    spark, size = df.sparkSession, input_bytes(df)
    if size > UNKNOWN_BYTES:
        return shuffle_partitions(spark)
    return max(shuffle_partitions(spark), math.ceil(size / bytes_each))
