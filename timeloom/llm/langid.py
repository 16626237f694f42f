"""Language identification by rank-order n-gram profiles.

A profile is the list of the most frequent character n-grams (1 to 3
characters, lower-cased, words framed by one space) of a language's training
texts, in order of frequency.  A text is given the language whose profile is
nearest by the out-of-place measure: the sum over the text's own most frequent
n-grams of the difference of ranks, or a fixed maximum for absent ones.

Training counts at most ``per_language`` texts of each language, chosen by a
hash of the id; the rows' labels are read, nothing else of them.  Profiles
have a fixed length and number of languages is that of the label's values, so
what is sent to the executors does not grow with the data.

Null texts and texts without a letter: ``und``, score 0.  Ties between n-grams
go to the smaller code points, ties between languages to the smaller name.
Without any labelled training text all rows are ``und``: there is no language
to name.  Repeated rows: a row each.  Other columns are carried; one named as
a result column comes back with ``in_`` before its name.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from timeloom.llm.arrow import map_chunks
from timeloom.llm.text import Carried

PROFILE = 300
PER_LANGUAGE = 2000
#: A text whose nearest profile is further than this share of the maximum is in none of the languages.
REJECT_BELOW = 0.05
UNDETERMINED = "und"

_GAP = re.compile(r"[\W\d_]+")
_BITS = 21  # of a code point


def held_out(doc_id: Column) -> Column:
    """Every fifth id by CRC-32 of its decimal text; null ids are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def has_letter(text: str) -> bool:
    """Whether a character is a letter by Unicode category; digits such as the superscript two are none."""
    return any(map(str.isalpha, text))


def words_only(text: str) -> str:
    """Lower-cased words, framed by one space.  Letters and the marks that belong to them stay, all else parts words."""
    text = text.lower()
    if text.isascii():
        return f" {_GAP.sub(' ', text).strip()} "
    kept = {c: c if unicodedata.category(c)[0] in "LM" else " " for c in set(text)}
    return f" {' '.join(text.translate({ord(c): x for c, x in kept.items()}).split())} "


def gram_codes(text: str) -> np.ndarray:
    """All n-grams of 1 to 3 characters as integers; runs of anything but letters are one space."""
    clean = words_only(text)
    c = np.frombuffer(clean.encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.int64)
    two = (c[:-1] << _BITS) | c[1:]
    three = (two[:-1] << _BITS) | c[2:]
    # a space alone says nothing; n-grams hold a space only at their ends
    return np.concatenate([c[c != 32], two, three[c[1:-1] != 32]])


def ranked(codes: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` most frequent codes, in order; ties by code."""
    values, counts = np.unique(codes, return_counts=True)
    if len(values) > most:
        least = np.partition(counts, len(counts) - most)[len(counts) - most]
        values, counts = values[counts >= least], counts[counts >= least]
    return values[np.lexsort((values, -counts))][:most]


def learn_profiles(
    docs: DataFrame, train: Column, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
    profile: int = PROFILE, per_language: int = PER_LANGUAGE,
) -> dict[str, np.ndarray]:
    """Profile of each language from a bounded sample of the rows where ``train`` holds."""
    rows = docs.where(train & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(doc_id)).alias("h"), F.col(doc_id).alias("doc_id")
    )
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return {}
    # share of the hash range that holds at most about per_language rows: no sort, no shuffle of texts
    share = F.lit(0.0)
    for name, n in sizes.items():
        share = F.when(F.col("lang") == name, F.lit(min(1.0, per_language / n))).otherwise(share)
    rows = rows.where(F.pmod("h", F.lit(1_000_000)) < share * 1_000_000)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, dict[int, int]] = {}
        for batch in batches:
            for name, t in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                counts = total.setdefault(name, {})
                for v, n in zip(*(x.tolist() for x in np.unique(gram_codes(t), return_counts=True)), strict=True):
                    counts[v] = counts.get(v, 0) + n
        for name, counts in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(counts)), pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())],
                names=["lang", "gram", "n"],
            )

    counts = rows.select("lang", "text").mapInArrow(work, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = counts.withColumn("r", F.expr("row_number() over (partition by lang order by n desc, gram)")).where(F.col("r") <= profile)
    found: dict[str, list] = {}
    for r in best.orderBy("lang", "r").collect():
        found.setdefault(r["lang"], []).append(r["gram"])
    return {k: np.array(v, dtype=np.int64) for k, v in sorted(found.items())}


class Ranker:
    """Out-of-place distances to all profiles at once."""

    def __init__(self, profiles: dict[str, np.ndarray], most: int = PROFILE):
        self.names, self.most = sorted(profiles), most
        self.grams = np.unique(np.concatenate(list(profiles.values()))) if profiles else np.zeros(0, np.int64)
        self.ranks = np.full((len(self.grams), len(self.names)), -1, np.int64)
        for j, name in enumerate(self.names):
            self.ranks[np.searchsorted(self.grams, profiles[name]), j] = np.arange(len(profiles[name]))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.names or not has_letter(text):
            return UNDETERMINED, 0.0
        own = ranked(gram_codes(text), self.most)
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        there = self.ranks[at]
        there[self.grams[at] != own] = -1
        apart = np.where(there < 0, self.most, np.abs(there - np.arange(len(own))[:, None])).sum(axis=0)
        j = int(np.argmin(apart))
        return self.names[j], float(1.0 - apart[j] / (self.most * len(own)))


def identify(
    docs: DataFrame, profiles: dict[str, np.ndarray], *, text: str = "text", most: int = PROFILE
) -> DataFrame:
    """``docs`` with lang_pred and score; no shuffle.  Predictions read the text only."""
    ranker = Ranker(profiles, most)
    carried = Carried(docs)
    body = carried.of(text)
    schema = StructType(list(carried.df.schema.fields))

    def work(chunk: pa.RecordBatch) -> dict:
        said = [ranker.predict(t) for t in chunk.column(body).to_pylist()]
        return {n: chunk.column(n) for n in chunk.schema.names} | {
            "lang_pred": pa.array([x for x, _ in said], pa.string()), "score": pa.array([x for _, x in said], pa.float64())
        }

    out = map_chunks(carried.df, body, schema.add("lang_pred", "string").add("score", "double"), work)
    return carried.named(out, ["lang_pred", "score"])


def identified(docs: DataFrame, profiles: dict[str, np.ndarray], *, text: str = "text", least: float = REJECT_BELOW) -> DataFrame:
    """The rows of ``docs`` that are in one of the languages, in its own columns."""
    carried = Carried(docs)
    found = identify(carried.df, profiles, text=carried.of(text))
    return carried.named(found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least)).drop("lang_pred", "score"))
