"""Vocabulary: fixed words, then data words in a reproducible order; bin edges beside it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timeloom.operators.quantize import bin_words

#: Special words and time bins, with the seconds from which each holds.
SPECIALS = ["TL_START", "TL_END", "PAD", "TRUNC", "None", "nan", "ELLIPSIS"]
TIME_BINS = {
    "T_5m-15m": 300, "T_15m-1h": 900, "T_1h-2h": 3600, "T_2h-6h": 7200, "T_6h-12h": 21600, "T_12h-1d": 43200, "T_1d-3d": 86400,
    "T_3d-1w": 259200, "T_1w-2w": 604800, "T_2w-1mt": 1209600, "T_1mt-3mt": 2629800, "T_3mt-6mt": 7889400, "T_6mt+": 15778800,
}
#: Vocabularies of up to so many words are broadcast.
BROADCAST_WORDS = 500_000


def fixed_words(quantizer: str = "deciles", fused: bool = False, spacing: bool = True) -> list[str]:
    """Bins first, so that an unfused bin's number is its id; then specials, then time bins."""
    words = ([] if fused else bin_words(quantizer)) + SPECIALS + (list(TIME_BINS) if spacing else [])
    if len(set(words)) != len(words):
        raise ValueError("fixed words repeat")
    return words


@dataclass
class Vocabulary:
    """(word, token), (designator, breaks); frozen after training."""

    words: DataFrame
    aux: DataFrame | None
    fixed: list[str]

    def token(self, word: str) -> int:
        return self.fixed.index(word)

    def save(self, path: str) -> None:
        self.words.write.mode("overwrite").parquet(f"{path}/vocab")
        if self.aux is not None:
            self.aux.write.mode("overwrite").parquet(f"{path}/aux")

    @classmethod
    def load(cls, spark: SparkSession, path: str, fixed: list[str]) -> Vocabulary:
        words = spark.read.parquet(f"{path}/vocab")
        have = [r["word"] for r in words.where(F.col("token") < len(fixed)).orderBy("token").collect()]
        if have != fixed:
            raise ValueError("the vocabulary has other fixed words")
        return cls(words, spark.read.parquet(f"{path}/aux"), fixed)


def train(words: DataFrame, fixed: list[str], *, section: str | None = None) -> DataFrame:
    """(word, token): fixed words, then the distinct data words by (section, word).

    The order needs one task, over distinct words only.
    """
    spark = words.sparkSession
    first = spark.createDataFrame(list(enumerate(fixed)), "token long, word string").select("word", "token")
    rows = words.where(F.col("word").isNotNull() & ~F.col("word").isin(fixed))
    distinct = rows.groupBy("word").agg((F.min(section) if section else F.lit(0)).alias("s"))
    numbered = distinct.select("word", (F.expr("row_number() over (order by s, word)") + len(fixed) - 1).cast("long").alias("token"))
    return first.unionByName(numbered)


def encode(rows: DataFrame, vocab: DataFrame, fixed: list[str], *, word: str = "word", token: str = "token") -> DataFrame:
    """Adds the token of each word; words that the vocabulary hasn't get that of None, nulls stay null."""
    known = vocab.select(F.col("word").alias("__w"), F.col("token").alias("__t"))
    if known.count() <= BROADCAST_WORDS:
        known = F.broadcast(known)
    joined = rows.join(known, rows[word] == known["__w"], "left")
    out = F.when(F.col(word).isNotNull(), F.coalesce("__t", F.lit(fixed.index("None")).cast("long")))
    return joined.withColumn(token, out).drop("__w", "__t")
