"""Array functions of the timeline engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digitize(x: Column, breaks: Column) -> Column:
    """Number of edges that are not above x; null for null."""
    return F.when(x.isNotNull(), F.size(F.filter(breaks, lambda b: b <= x)))


def pad_right(items: Column, length: int, value: Column) -> Column:
    return F.concat(items, F.array_repeat(value, F.greatest(F.lit(length) - F.size(items), F.lit(0))))


def pad_or_truncate(tokens: Column, length: int, pad: Column, trunc: Column) -> Column:
    """Exactly ``length`` tokens; a longer list ends in the truncation token."""
    return F.when(F.size(tokens) <= length, pad_right(tokens, length, pad)).otherwise(
        F.concat(F.slice(tokens, 1, length - 1), F.array(trunc))
    )


def pad_to_left(tokens: Column, pad: Column) -> Column:
    """Moves the padding behind the first pad token to the front."""
    at = F.array_position(tokens, pad).cast("int")
    return F.when(at > 0, F.concat(F.array_repeat(pad, F.size(tokens) - at + 1), F.slice(tokens, F.lit(1), at - 1))).otherwise(tokens)


def until_stop(tokens: Column, values: Column, stops: list[int]) -> Column:
    """Values behind the first stop token are NaN; none are if there is no stop or it is the first token."""
    first = F.array_min(F.transform(F.array(*[F.lit(s) for s in stops]), lambda s: F.when(F.array_position(tokens, s) > 0, F.array_position(tokens, s))))
    return F.when(
        first > 1, F.transform(values, lambda v, i: F.when(i >= first, F.lit(float("nan"))).otherwise(v))
    ).otherwise(values)


def norm2(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def norm1(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + F.abs(x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def log_softmax_at(logits: Column, index: Column) -> Column:
    """log p of the entry at ``index`` (from 0) of a row of logits."""
    most = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x.cast("double") - most))
    return F.get(logits, index) - most - F.log(total)


def cut_to_left(tokens: Column, pad: Column, share: Column) -> Column:
    """Keeps a share (in [0, 1), one token at least) of the tokens before the first pad token, padded on the left to the old length.

    A uniform ``share``, such as one from a hash of the row's key, cuts timelines at random.
    """
    at = F.array_position(tokens, pad).cast("int")
    real = F.when(at > 0, at - 1).otherwise(F.size(tokens))
    kept = F.least(F.floor(real * share).cast("int") + 1, real)
    return F.concat(F.array_repeat(pad, F.size(tokens) - kept), F.slice(tokens, F.lit(1), kept))
