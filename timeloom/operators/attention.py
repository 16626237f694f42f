"""Attention rollout and token importance; one group is the matrices of one subject."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REDUCERS = ("mean", "median", "max", "min", "sum", "mean_log", "median_log")


def reducer(name: str):
    """NumPy reducer by name over leading axes; Qnn is a percentile."""
    if name.startswith("Q") and name[1:].isdigit():
        return lambda x, axis: np.nanquantile(x, int(name[1:]) / 100, axis=axis)
    if name in ("mean_log", "median_log"):
        base = np.nanmean if name == "mean_log" else np.nanmedian
        return lambda x, axis: base(np.log(x), axis=axis)
    if name not in REDUCERS:
        raise ValueError(f"no reducer {name}")
    return getattr(np, f"nan{name}")


def rollout_of(attention: np.ndarray) -> np.ndarray:
    """Per head the product over layers, later ones on the left, of half attention and half identity; layers x heads x n x n to heads x n x n."""
    same = np.eye(attention.shape[-1])
    out = np.broadcast_to(same, attention.shape[1:])
    for layer in attention:
        out = (layer + same) @ out / 2
    return out


def importance_of(attention: np.ndarray, *, values: np.ndarray | None = None, window: int | None = None, how: str = "mean") -> np.ndarray:
    """Importance of each key: attention that it gets from the queries (within ``window`` behind it), over layers and heads.

    ``values`` (layers x heads x n x d) weigh each query's row by the L1 norm of its value.
    """
    n = attention.shape[-1]
    weight = attention
    if window is not None:
        gap = np.arange(n)[:, None] - np.arange(n)[None, :]
        weight = weight * ((gap >= 0) & (gap < window))
    if values is not None:
        weight = weight * np.abs(values).sum(axis=-1)[..., None]
    return reducer(how)(weight.sum(axis=2), axis=(0, 1))


def _matrices(pdf: pd.DataFrame) -> np.ndarray:
    shape = tuple(int(pdf[c].max()) + 1 for c in ("layer", "head", "i"))
    out = np.zeros((*shape, shape[2]))
    out[pdf["layer"], pdf["head"], pdf["i"], pdf["j"]] = pdf["a"]
    return out


def rollout(rows: DataFrame) -> DataFrame:
    """(sid, head, i, j, r) from (sid, layer, head, i, j, a): heads are apart; a group is bounded by layers times the sequence length squared."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf["head"].iloc[0]
        r = rollout_of(_matrices(pdf.assign(head=0)))[0]
        i, j = np.indices(r.shape)
        return pd.DataFrame({"sid": pdf["sid"].iloc[0], "head": head, "i": i.ravel(), "j": j.ravel(), "r": r.ravel()})

    return rows.groupBy("sid", "head").applyInPandas(one, f"sid {rows.schema['sid'].dataType.simpleString()}, head int, i long, j long, r double")


def importance(rows: DataFrame, window: int | None = None, how: str = "mean") -> DataFrame:
    """(sid, j, importance): sums over queries and a reducer over layers and heads, in SQL; no matrices are built.

    A column ``v_norm`` (L1 norm of the query's value), if there is one, weighs the query's row.
    """
    if window is not None:
        rows = rows.where((F.col("i") - F.col("j") >= 0) & (F.col("i") - F.col("j") < window))
    weight = F.col("a") * F.col("v_norm") if "v_norm" in rows.columns else F.col("a")
    per = rows.groupBy("sid", "layer", "head", "j").agg(F.sum(weight).alias("__s"))
    if how.startswith("Q") and how[1:].isdigit():
        last = F.percentile("__s", F.lit(int(how[1:]) / 100))
    else:
        x = F.log("__s") if how.endswith("_log") else F.col("__s")
        last = {"mean": F.avg, "median": F.median, "max": F.max, "min": F.min, "sum": F.sum}[how.removesuffix("_log")](x)
    return per.groupBy("sid", "j").agg(last.alias("importance"))


def last_layer(rows: DataFrame) -> DataFrame:
    """Rows of the last layer of each subject."""
    top = rows.groupBy("sid").agg(F.max("layer").alias("__l"))
    return rows.join(top, "sid").where("layer = __l").drop("__l")


#: Metrics by name, as (window, weighed by value norms, last layer only, reducer over layers and heads).
METRICS = {
    "h2o-mean": (None, False, False, "mean"), "h2o-mean_log": (None, False, False, "mean_log"), "h2o-median": (None, False, False, "median"),
    "h2o-max": (None, False, False, "max"), "scissorhands-10": (10, False, False, "mean"), "scissorhands-20": (20, False, False, "mean"),
    "h2o-va-mean": (None, True, False, "mean"), "h2o-va-mean_log": (None, True, False, "mean_log"), "h2o-last-mean": (None, False, True, "mean"),
    "scissorhands-va-10": (10, True, False, "mean"), "scissorhands-va-20": (20, True, False, "mean"),
}


def until_stop(rows: DataFrame, stops: DataFrame, value: str = "importance") -> DataFrame:
    """Nulls ``value`` (sid, j, value) behind each subject's first stop token; ``stops``: sid, first_stop (0 or null: none)."""
    known = rows.join(stops, "sid", "left")
    return known.withColumn(value, F.when((F.col("first_stop") > 0) & (F.col("j") > F.col("first_stop")), None).otherwise(F.col(value))).drop("first_stop")


def metric(rows: DataFrame, name: str) -> DataFrame:
    """(sid, j, importance) of a named metric.

    ``rollout-`` takes the rolled-out attention; ``h2o-normed-`` weighs a
    query's row by ``f_norm``, the length of its transformed value.
    """
    if name in ("rollout-mean", "rollout-mean_log"):
        rolled = rollout(rows).select("sid", F.lit(0).alias("layer"), "head", "i", "j", F.col("r").alias("a"))
        return importance(rolled, None, name.split("-")[1])
    if name in ("h2o-normed-mean", "h2o-normed-mean_log"):
        return importance(rows.drop("v_norm").withColumn("a", F.abs("a") * F.col("f_norm")), None, name.split("-")[2])
    if name not in METRICS:
        raise ValueError(f"no metric {name}; there are {sorted(METRICS)}")
    window, weighed, last, how = METRICS[name]
    rows = last_layer(rows) if last else rows
    return importance(rows if weighed else rows.drop("v_norm"), window, how)
