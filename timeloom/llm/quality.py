"""Quality rules: fixed limits, then robust multivariate outliers per language and source.  DataFrame functions only.

Every text gives counts (``base_counts``).  Texts that pass the fixed limits
give a vector of transformed statistics, and each (language, source) group an
estimate of centre and covariance by the minimum covariance determinant:

* three starts, none of them random: medians with median absolute deviations;
  mean and covariance of all rows; medians with the correlation of squashed
  scores (hyperbolic tangent);
* concentration steps from each: the half of the group (n // 2 + 1 rows) with
  the smallest distances gives the next centre and covariance, until the
  determinant falls by less than ``TOLERANCE``;
* the estimate with the smallest determinant is kept, scaled for consistency
  at the normal distribution, and a last step takes in all rows within the
  97.5 % quantile.

A document is rejected if its squared Mahalanobis distance is above the
chi-square quantile of ``REJECTED`` (62.2 in 4 dimensions): of 10^12 documents
that are normal, one or so is lost.  Every covariance has the squares of
``STATISTICS``' floors on its diagonal, differences that don't matter: a
statistic that is constant in a group (no symbols, say) rejects nobody, and a
group of a few rows has an estimate of its own, from its own rows: mostly the
floors around them.  A row alone in its group is kept.

Rows are only ever counted and summed per group and bin of a fixed grid
(medians per statistic, "the nearer half" per distance): exact sums of
integers that partial aggregation merges, so a group may hold any share of
the rows, and results don't depend on their order.  Of the bin that the half
ends in, the rows count in part, each alike.  A concentration step reads the
statistics once, and the loop ends by itself, as determinants fall each time
and the floors bound them.

Null texts have no words (rejected by the limits); null languages and sources
form groups of their own; ties share a bin and stay together; repeated rows:
a row each, each counts.  Other columns are carried; one named as a result
column comes back with ``in_`` before its name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timeloom.llm.storage import discard, stored
from timeloom.llm.text import SPACES, Carried, words

SYMBOLS = "#*$%&|<>"
#: Fixed limits.
LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent of words in repeated 3-word windows
#: (statistic, unit of its integer grid, floor of the standard deviation)
STATISTICS = (("len", 1 / 256, 0.5), ("chars", 1 / 256, 0.15), ("symbols", 1 / 4096, 0.02), ("repeats", 1 / 1024, 0.1))
DIM = len(STATISTICS)


def upper_share(x: float, dim: int) -> float:
    """Share of a chi-square distribution (even dimension) above ``x``."""
    return math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(dim // 2))


def quantile(share: float, dim: int) -> float:
    """The value that ``share`` of a chi-square distribution lies above."""
    low, high = 0.0, 1e4
    for _ in range(200):
        low, high = ((low + high) / 2, high) if upper_share((low + high) / 2, dim) > share else (low, (low + high) / 2)
    return high


#: Share of normal documents beyond the limit.
REJECTED = 1e-12
CUTOFF = quantile(REJECTED, DIM)
#: Least fall of the logarithm of the determinant that asks for another step.
TOLERANCE = 1e-3
HALF_FACTOR = 0.5 / (1 - upper_share(quantile(0.5, DIM), DIM + 2))
WITHIN = quantile(0.025, DIM)
WITHIN_FACTOR = 0.975 / (1 - upper_share(WITHIN, DIM + 2))


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (longs)."""
    t = F.coalesce(F.col(text), F.lit(""))
    keep = [c for c in docs.columns if c != text]
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
    first = docs.select(
        *keep,
        words(t, SPACES).alias("__w"),
        F.char_length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.char_length(t) - F.char_length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("__lines"),
    )
    # window hashes, the position in the low bits: sorted as plain longs, equal windows are neighbours
    bits = F.ceil(F.log2(F.size("__w") + F.lit(1))).cast("int")
    second = first.select(
        *keep, "word_chars", "n_symbols",
        F.size("__w").cast("long").alias("n_words"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        bits.alias("__bits"), "__w",
    )
    window = lambda i: F.call_function("shiftleft", F.xxhash64(F.col("__w")[i], F.col("__w")[i + 1], F.col("__w")[i + 2]), F.col("__bits")).bitwiseOR(i.cast("long"))
    packed = F.when(
        F.size("__w") >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), F.size("__w") - 3), window))
    ).otherwise(F.array().cast("array<bigint>"))
    third = second.select(*keep, "word_chars", "n_symbols", "n_words", "n_dup_lines", "__bits", "__w", packed.alias("__p"))
    bits_of = lambda x: F.call_function("shiftright", x, F.col("__bits"))
    n = F.size("__p")
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("__bits")) - 1
    # windows whose hash another one shares; only these are compared as they are
    maybe = F.filter(
        "__p",
        lambda x, i: ((i > 0) & (bits_of(F.get("__p", i - 1)) == bits_of(x))) | ((i < n - 1) & (bits_of(F.get("__p", i + 1)) == bits_of(x))),
    )
    at = lambda x, k: F.col("__w")[x.bitwiseAND(mask).cast("int") + k]
    named = F.transform(maybe, lambda x: F.struct(F.concat_ws(" ", at(x, 0), at(x, 1), at(x, 2)).alias("g"), x.bitwiseAND(mask).alias("p")))
    fourth = third.select(*keep, "word_chars", "n_symbols", "n_words", "n_dup_lines", F.sort_array(named).alias("__s"))
    m = F.size("__s")
    repeated = F.filter(
        "__s", lambda x, i: ((i > 0) & (F.get("__s", i - 1)["g"] == x["g"])) | ((i < m - 1) & (F.get("__s", i + 1)["g"] == x["g"]))
    )
    fourth = fourth.select(*keep, "word_chars", "n_symbols", "n_words", "n_dup_lines", F.sort_array(F.transform(repeated, lambda x: x["p"])).alias("__at"))
    # each repeated window covers 3 words, or as many as there are before the next one
    covered = F.aggregate(
        F.transform("__at", lambda x, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get("__at", i + 1) - x, F.lit(3).cast("long")))),
        F.lit(0).cast("long"), lambda a, x: a + x,
    )
    return fourth.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)


def statistics() -> list[Column]:
    """Transformed statistics in units of their grids, as longs."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    raw = {
        "len": F.log(n),
        "chars": F.log(F.greatest(F.col("word_chars") / n, F.lit(0.01))),
        "symbols": F.sqrt(F.col("n_symbols") / n),
        "repeats": F.sqrt((F.col("n_repeat_words") + F.col("n_dup_lines")) / n),
    }
    return [F.round(raw[name] / F.lit(unit)).cast("long").alias(f"s_{name}") for name, unit, _ in STATISTICS]


_S = [f"s_{name}" for name, _, _ in STATISTICS]
_PAIRS = [(i, j) for i in range(DIM) for j in range(i + 1)]


def _middle(binned: DataFrame, keys: list[str]) -> DataFrame:
    """Smallest bin at which half of a group's rows are reached; input: keys, bin, n."""
    least = F.expr(f"ceil(0.5 * sum(n) over (partition by {', '.join(keys)}))")
    upto = F.expr(f"sum(n) over (partition by {', '.join(keys)} order by bin)")
    return binned.withColumn("upto", upto).withColumn("least", least).where("upto >= least").groupBy(*keys).agg(F.min("bin").alias("bin"))


_T = [f"t_{i}" for i in range(DIM)]
_P = [f"p_{i}{j}" for i, j in _PAIRS]
_M = [f"m_{i}" for i in range(DIM)]
_L = [f"l_{i}{j}" for i, j in _PAIRS]
_UNIT = [u for _, u, _ in STATISTICS]
_FLOOR = [f * f for _, _, f in STATISTICS]


def _sums() -> list[Column]:
    """Sums and sums of products of the statistics: exact, as they are integers."""
    return [F.sum(s).alias(t) for s, t in zip(_S, _T, strict=True)] + [F.sum(F.col(_S[i]) * F.col(_S[j])).alias(f"p_{i}{j}") for i, j in _PAIRS]


def _with_factor(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, m_i, l_ij (lower triangle of the Cholesky factor) and logdet from m_i and the covariance c_ij."""
    for i in range(DIM):
        for j in range(i + 1):
            rest = F.col(f"c_{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l_{i}{k}") * F.col(f"l_{j}{k}")
            # rounding may take a pivot below zero, the floors keep it away from there
            df = df.withColumn(f"l_{i}{j}", F.sqrt(F.greatest(rest, F.lit(_FLOOR[i] * 1e-3))) if i == j else rest / F.col(f"l_{j}{j}"))
    logdet = sum((F.log(f"l_{i}{i}") for i in range(DIM)), F.lit(0.0)) * 2
    return df.select(*keys, *_M, *_L, logdet.alias("logdet"))


def _moments(sums: DataFrame, keys: list[str], factor: float) -> DataFrame:
    """Centre and factor, in natural units, from n and the sums (doubles)."""
    mean = [F.col(t) / F.col("n") for t in _T]
    cov = {
        (i, j): (F.col(f"p_{i}{j}") / F.col("n") - mean[i] * mean[j]) * (_UNIT[i] * _UNIT[j] * factor) + (_FLOOR[i] if i == j else 0.0) for i, j in _PAIRS
    }
    return _with_factor(sums.select(*keys, *[(mean[i] * _UNIT[i]).alias(_M[i]) for i in range(DIM)], *[c.alias(f"c_{i}{j}") for (i, j), c in cov.items()]), keys)


def _distance() -> Column:
    """Squared Mahalanobis distance, by forward substitution."""
    z: list[Column] = []
    for i in range(DIM):
        rest = F.col(_S[i]) * _UNIT[i] - F.col(_M[i])
        for k in range(i):
            rest = rest - F.col(f"l_{i}{k}") * z[k]
        z.append(rest / F.col(f"l_{i}{i}"))
    return sum((x * x for x in z[1:]), z[0] * z[0])


def _bin(d2: Column) -> Column:
    """Distances on a grid of 1/64 of a factor of two."""
    return F.floor(F.log2(F.greatest(d2, F.lit(1e-6))) * 64).cast("long")


def _starts(rows: DataFrame) -> DataFrame:
    """g, start, centre, factor and logdet of the three starts; one pass for medians, one for moments."""
    long = rows.select("g", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(s).alias("bin")) for i, s in enumerate(_S)])).alias("x")).select("g", "x.i", "x.bin")
    counts = long.groupBy("g", "i", "bin").agg(F.count(F.lit(1)).alias("n"))
    med = _middle(counts, ["g", "i"]).withColumnRenamed("bin", "med")
    off = counts.join(med, ["g", "i"]).groupBy("g", "i", F.abs(F.col("bin") - F.col("med")).alias("bin")).agg(F.sum("n").alias("n"))
    mad = _middle(off, ["g", "i"]).withColumnRenamed("bin", "mad")
    one = lambda i, c: F.max(F.when(F.col("i") == i, c))
    scale = lambda i: F.sqrt(F.pow(F.col("mad") * (1.4826 * _UNIT[i]), 2) + _FLOOR[i])
    middle = stored(med.join(mad, ["g", "i"]).groupBy("g").agg(
        *[one(i, F.col("med") * _UNIT[i]).alias(_M[i]) for i in range(DIM)], *[one(i, scale(i)).alias(f"d_{i}") for i in range(DIM)]
    ), "quality")
    squashed = [F.round(F.tanh((F.col(_S[i]) * _UNIT[i] - F.col(_M[i])) / F.col(f"d_{i}")) * 1024).cast("long").alias(f"y_{i}") for i in range(DIM)]
    scored = rows.join(middle, "g").select("g", *_S, *squashed)
    crossed = [F.sum(F.col(f"y_{i}") * F.col(f"y_{j}")).cast("double").alias(f"q_{i}{j}") for i, j in _PAIRS]
    sums = stored(scored.groupBy("g").agg(F.count(F.lit(1)).alias("n"), *_sums(), *crossed).join(middle, "g"), "quality")
    width = lambda i: F.sqrt(F.col(f"q_{i}{i}") + F.col("n") * (1024.0 * 1024.0 * 1e-3))
    spread = lambda r: [(F.pow(f"d_{i}", F.lit(2.0)) if i == j else r(i, j) * F.col(f"d_{i}") * F.col(f"d_{j}")).alias(f"c_{i}{j}") for i, j in _PAIRS]
    out = _moments(sums.select("g", *[F.col(c).cast("double").alias(c) for c in ("n", *_T, *_P)]), ["g"], 1.0).select(F.lit(0).alias("start"), "*")
    for start, rule in ((1, lambda i, j: F.lit(0.0)), (2, lambda i, j: F.col(f"q_{i}{j}") / (width(i) * width(j)))):
        out = out.unionByName(_with_factor(sums.select("g", *_M, *spread(rule)), ["g"]).withColumn("start", F.lit(start)))
    return out


def _half(rows: DataFrame, now: DataFrame) -> DataFrame:
    """A concentration step: g, start, and the estimate from the nearer half of the rows."""
    keys = ["g", "start"]
    binned = rows.join(now, "g").select(*keys, *_S, _bin(_distance()).alias("bin"))
    bins = binned.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"), *_sums())
    upto = F.expr("sum(n) over (partition by g, start order by bin)")
    bins = bins.withColumn("before", upto - F.col("n")).withColumn("half", F.expr("sum(n) over (partition by g, start) div 2 + 1"))
    # whole bins are added up as integers, in any order; of one bin a part is taken
    whole, part = F.col("before") + F.col("n") <= F.col("half"), (F.col("half") - F.col("before")) / F.col("n")
    taken = bins.where("before < half")
    both = [
        (F.coalesce(F.sum(F.when(whole, F.col(c).cast("decimal(20,0)"))).cast("double"), F.lit(0.0)) + F.coalesce(F.max(F.when(~whole, F.col(c) * part)), F.lit(0.0))).alias(c)
        for c in ("n", *_T, *_P)
    ]
    return _moments(taken.groupBy(*keys).agg(*both), keys, HALF_FACTOR)


def estimates(rows: DataFrame) -> DataFrame:
    """Centre and Cholesky factor of each group by the minimum covariance determinant; ``rows``: g and statistics."""
    keys = ["g", "start"]
    # the starts' own determinants are not those of a half
    now = stored(_starts(rows).withColumn("logdet", F.lit(float("inf"))).withColumn("moving", F.lit(True)), "quality")
    columns = [*_M, *_L, "logdet"]
    while not now.where("moving").isEmpty():
        fell = _half(rows, now.where("moving").drop("logdet", "moving")).select(*keys, *[F.col(c).alias(f"new_{c}") for c in columns])
        moving = F.coalesce(F.col("new_logdet") < F.col("logdet") - TOLERANCE, F.lit(False))
        step = now.join(fell, keys, "left").withColumn("moving", moving)
        before, now = now, stored(step.select(*keys, *[F.when(F.col("moving"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in columns], "moving"), "quality")
        discard(before)
    best = now.groupBy("g").agg(F.min_by(F.struct(*_M, *_L), F.struct("logdet", "start")).alias("e")).select("g", "e.*")
    best = stored(best, "quality")
    near = rows.join(best, "g").where(_distance() <= WITHIN).groupBy("g").agg(F.count(F.lit(1)).alias("n"), *_sums())
    final = _moments(near.select("g", *[F.col(c).cast("double").alias(c) for c in ("n", *_T, *_P)]), ["g"], WITHIN_FACTOR).drop("logdet")
    return stored(final, "quality")


def judged(docs: DataFrame, *, text: str = "text", by: tuple[str, ...] = ("lang", "source"), cutoff: float = CUTOFF) -> DataFrame:
    """``docs`` without ``text``, with the counts, base_failed, distance (null if base_failed) and kept."""
    carried = Carried(docs)
    counted = base_counts(carried.df, carried.of(text)).withColumn("base_failed", base_failed())
    group = F.to_json(F.struct(*[carried.of(c) for c in by]))
    rows = stored(counted.withColumn("g", group).withColumns({c: x for c, x in zip(_S, statistics(), strict=True)}), "quality")
    known = estimates(rows.where(~F.col("base_failed")).select("g", *_S))
    out = rows.join(known, "g", "left").withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff))
    return carried.named(out.select(*counted.columns, "distance", "kept"), [c for c in counted.columns if c not in carried.df.columns] + ["distance", "kept"])
