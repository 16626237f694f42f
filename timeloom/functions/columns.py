"""Scalar column functions of the timeline engine."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """Neither null, NaN nor infinite; never null itself."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def finite_or_null(x: Column) -> Column:
    return F.when(finite(x), x)


def normalise_code(code: Column) -> Column:
    """Lower case, spaces to underscores, full stops stripped from both ends."""
    return F.btrim(F.replace(F.lower(code.cast("string")), F.lit(" "), F.lit("_")), F.lit("."))


def static_word(value: Column, prefix: str | None) -> Column:
    """Word of a static attribute: case and full stops stay, null is the word None."""
    text = F.replace(F.coalesce(value.cast("string"), F.lit("None")), F.lit(" "), F.lit("_"))
    return F.concat(F.lit(f"{prefix}_"), text) if prefix else text


def token_type(word: Column, specials: list[str]) -> Column:
    """SPECIAL, QUANT, T_SPACER, or what stands before the first underscore."""
    return (
        F.when(word.isNull() | word.isin(specials), "SPECIAL")
        .when(word.rlike("^Q[0-9]"), "QUANT")
        .when(word.startswith("T_"), "T_SPACER")
        .otherwise(F.split_part(word, F.lit("_"), F.lit(1)))
    )


def short_label(text: Column, most: int = 23, head: int = 13, tail: int = 7) -> Column:
    """The first and last characters of long labels; null is None."""
    text = F.coalesce(text, F.lit("None"))
    return F.when(F.char_length(text) > most, F.concat(F.left(text, F.lit(head)), F.lit(".."), F.right(text, F.lit(tail)))).otherwise(text)


def replace_first(text: Column, pattern: str, by: str) -> Column:
    """Regular expression replaced once; ``pattern`` has no groups of its own."""
    return F.regexp_replace(text, f"^(?s)(.*?)(?:{pattern})", f"$1{by}")


def recode(value: Column, mapping: dict, strict: bool = False) -> Column:
    """Dictionary replacement; a value that isn't in it stays or, if strict, raises."""
    out = reduce(lambda acc, kv: acc.when(value == kv[0], kv[1]), list(mapping.items())[1:], F.when(value == next(iter(mapping)), next(iter(mapping.values()))))
    if strict:
        return out.when(value.isNull(), None).otherwise(F.raise_error(F.concat(F.lit("no code for "), value.cast("string"))))
    return out.otherwise(value)


def to_ms(ts: Column) -> Column:
    """Timestamp without zone, cut to milliseconds."""
    return F.date_trunc("MILLISECOND", ts).cast("timestamp_ntz")


def end_of_day(ts: Column) -> Column:
    """23:59:59 of the day; the part below a second stays."""
    return F.date_trunc("DAY", ts) + F.expr("INTERVAL '23:59:59' HOUR TO SECOND") + (ts - F.date_trunc("SECOND", ts))


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def whole_hours(start: Column, end: Column) -> Column:
    """Hours of a duration, cut towards zero."""
    return F.timestamp_diff("HOUR", start, end)


def minute_boundaries(start: Column, end: Column) -> Column:
    """How many full minutes of the clock are passed from start to end."""
    minute = lambda x: F.floor(micros(x) / F.lit(60_000_000))
    return (minute(end) - minute(start)).cast("long")


def bits(nats: Column) -> Column:
    """Log-likelihood in nats to information in bits."""
    return -nats / F.log(F.lit(2.0))


def all_of(predicates: list[str] | str | None) -> Column:
    """Conjunction of SQL predicates."""
    if not predicates:
        return F.lit(True)
    parts = [predicates] if isinstance(predicates, str) else list(predicates)
    return reduce(lambda a, b: a & b, map(F.expr, parts))


def any_null_or_nan(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, [c.isNull() | F.isnan(c) for c in columns])


def micros_between(start: Column, end: Column) -> Column:
    """Duration in microseconds as a double."""
    return (micros(end) - micros(start)).cast("double")


def parsed_time(text: Column, pattern: str | None = None) -> Column:
    """Timestamp without zone from text; null where it doesn't parse."""
    return F.try_to_timestamp(text, F.lit(pattern)).cast("timestamp_ntz") if pattern else F.try_to_timestamp(text).cast("timestamp_ntz")


def split_at(text: Column, separator: str, i: int) -> Column:
    """Part i, from 0, between literal separators; null where there is none."""
    return F.get(F.split(text, "\\Q" + separator + "\\E"), F.lit(i))


def piece(text: Column, offset: int, length: int) -> Column:
    """Characters from ``offset``, counted from 0."""
    return F.substring(text, offset + 1, length)


def float_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if f.dataType.typeName() in ("float", "double")]
