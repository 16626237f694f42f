"""Who is in an analysis: eligibility, qualifiers and predictions per outcome, subsets, sampled completions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeloom.functions.columns import to_ms
from timeloom.operators.timeline import global_index


def eligible(df: DataFrame, *, age: str, start: str, ids: list[str], least: int = 18, window: tuple[str, str] | None = None) -> DataFrame:
    """Rows of at least that age whose start is within the dates (both midnights belong to it); ids as strings, start in milliseconds.

    Null ages and, under a window, null starts are not eligible.
    """
    rows = df.where(F.col(age) >= least).withColumn(start, to_ms(F.col(start))).withColumns({i: F.col(i).cast("string") for i in ids})
    if window is None:
        return rows
    first, last = (F.to_date(F.lit(x)).cast("timestamp_ntz") for x in window)
    return rows.where(F.col(start).between(first, last))


def qualified(flags: DataFrame, outcomes: list[str], *, sid: str = "sid", early: str = "_24h", always: tuple[str, ...] = ()) -> DataFrame:
    """Long rows sid, outcome, qualifies, label: a subject qualifies unless it has the outcome early; for ``always`` all do."""
    one = lambda o: F.struct(
        F.lit(o).alias("outcome"), (F.lit(True) if o in always else ~F.coalesce(F.col(f"{o}{early}"), F.lit(False))).alias("qualifies"), F.col(o).alias("label")
    )
    return flags.select(sid, F.inline(F.array(*[one(o) for o in outcomes])))


def predictions(labels: DataFrame, scores: DataFrame, *, sid: str = "sid") -> DataFrame:
    """The long table of predictions: sid, outcome, qualifies, label and score; who doesn't qualify keeps a row without a score."""
    known = labels.join(scores.select(sid, "outcome", "score"), [sid, "outcome"], "left")
    return known.withColumn("score", F.when(F.col("qualifies"), F.col("score")))


def first_share(df: DataFrame, share: float, order: str) -> DataFrame:
    """The first int(rows * share) rows by ``order``, whose values must differ; no task sees all rows."""
    total = df.agg(F.count(F.lit(1)).alias("__all"))  # one row
    numbered = global_index(df, order, [order], "__at").crossJoin(F.broadcast(total))
    return numbered.where(F.col("__at") < F.floor(F.col("__all") * F.lit(share))).drop("__at", "__all")


def sample_rows(df: DataFrame, n: int, keys: list[str], seed: int = 0) -> DataFrame:
    """n rows by the smallest hashes of their keys: the same rows on every run."""
    return df.orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(n)


def with_provenance(frames: dict[str, DataFrame], name: str = "split") -> DataFrame:
    """All rows of several tables, each with the name of its table."""
    return reduce(lambda a, b: a.unionByName(b), [df.withColumn(name, F.lit(k)) for k, df in frames.items()])


def all_keys(frames: list[DataFrame], key: str) -> DataFrame:
    """The keys that any of the tables has, in order."""
    return reduce(lambda a, b: a.unionByName(b), [df.select(key) for df in frames]).distinct().orderBy(key)


def latest(df: DataFrame, by: str, ts: str, columns: list[str]) -> DataFrame:
    """Per key the last time and the columns' values at it; ties go to the largest values."""
    at = F.max(F.struct(ts, *columns)).alias("__at")
    return df.where(F.col(ts).isNotNull()).groupBy(by).agg(at).select(by, F.col(f"__at.{ts}").alias(ts), *[F.col(f"__at.{c}").alias(c) for c in columns])


def complete_positive(df: DataFrame, columns: list[str], positive: list[str]) -> DataFrame:
    """Rows without a null or NaN in ``columns`` and with all of ``positive`` above zero."""
    return reduce(lambda rows, c: rows.where(F.col(c) > 0), positive, df.na.drop(subset=columns))


def band_counts(df: DataFrame, key: str, value: str, low: float = 0.95, high: float = 0.99) -> DataFrame:
    """Per key the values not below the high quantile of all, and those from the low one up to it; nulls and NaNs are in neither."""
    x = F.when(~F.isnan(value), F.col(value))
    q = df.agg(F.percentile(x, F.array(F.lit(low), F.lit(high))).alias("__q"))  # one row
    lo, hi = F.col("__q")[0], F.col("__q")[1]
    return df.crossJoin(F.broadcast(q)).groupBy(key).agg(F.count_if(x >= hi).alias("n_top"), F.count_if((x >= lo) & (x < hi)).alias("n_band"))


def token_totals(df: DataFrame, tokens: str, by: list[str] | None = None) -> DataFrame:
    """Timelines, tokens and mean length."""
    n = F.size(tokens)
    return df.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n_timelines"), F.sum(n).alias("n_tokens"), F.avg(n).alias("mean_length"))


def completion_votes(samples: DataFrame, tokens: str, ended: int | str, target: int | str, *, sid: str = "sid") -> DataFrame:
    """Per subject: samples, those that ended, the share of samples with the target, and that share among the ended (null without any)."""
    done, hit = F.array_contains(tokens, ended), F.array_contains(tokens, target).cast("double")
    return samples.groupBy(sid).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(done).alias("n_ended"), F.avg(hit).alias("vote"), F.avg(F.when(done, hit)).alias("vote_ended")
    )


def completion_summary(samples: DataFrame, tokens: str, ended: int | str, target: int | str, *, sid: str = "sid") -> DataFrame:
    """One row: share of samples that ended, share of subjects all of whose samples did, tokens, mean and (population) deviation of length."""
    votes = completion_votes(samples, tokens, ended, target, sid=sid).agg(F.avg((F.col("n") == F.col("n_ended")).cast("double")).alias("share_all_ended"))
    n = F.size(tokens)
    whole = samples.agg(
        F.avg(F.array_contains(tokens, ended).cast("double")).alias("share_ended"), F.sum(n).alias("n_tokens"),
        F.avg(n).alias("mean_length"), F.stddev_pop(n).alias("std_length"),
    )
    return whole.crossJoin(F.broadcast(votes))  # one row each


def reaggregate(df: DataFrame, inner: list[str], outer: list[str], value: str) -> DataFrame:
    """Sums per outer keys over the counts per inner keys, with how many inner groups there are."""
    return df.groupBy(*inner).agg(F.sum(value).alias("__s")).groupBy(*outer).agg(F.sum("__s").alias("total"), F.count(F.lit(1)).alias("n_groups"))


def redacted_timelines(tokens: DataFrame, kept: DataFrame, length: int, pad: int, trunc: int, *, sid: str = "sid", **how) -> DataFrame:
    """Timelines of the subjects in ``kept``, without their redacted events, padded again, beside the columns of ``kept``.

    ``tokens`` are (sid, pos, ts, token, value) rows; ``how`` goes to ``information.redact``.
    """
    from timeloom.functions.arrays import pad_or_truncate
    from timeloom.operators.information import redact

    left = redact(tokens.join(kept.select(sid), sid, "left_semi"), "value", sid=sid, **how)
    items = F.array_sort(F.collect_list(F.struct("pos", "token")))
    lists = left.groupBy(sid).agg(F.transform(items, lambda x: x["token"]).alias("__t"))
    padded = lists.select(sid, F.size("__t").alias("seq_len"), pad_or_truncate(F.col("__t"), length, F.lit(pad), F.lit(trunc)).alias("padded"))
    return kept.join(padded, sid, "left")

