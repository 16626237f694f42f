"""Events to ordered tokens, spacers, cuts, padding, and whole timelines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from timeloom.functions.arrays import pad_or_truncate
from timeloom.functions.columns import end_of_day, micros, normalise_code, static_word, to_ms
from timeloom.operators.joins import validated_join
from timeloom.operators.quantize import apply_breaks, bin_words, learn_breaks
from timeloom.operators.vocab import TIME_BINS, Vocabulary, encode, fixed_words, train
from timeloom.sources.config import TimelineConfig
from timeloom.sources.tables import load, read_table

#: Order of the tokens of a subject, without ties.
ORDER = ["ts", "first_token", "ord", "key", "pos"]
#: Designator of the ages of the reference frame.
AGE = "AGE"


def event_rows(df: DataFrame, specs: list[dict], subject_id: str, key: Column, ref_ranges: bool = False) -> DataFrame:
    """All event specs of one table in one scan: sid, ts, ord, key, words, value, numeric, lower and upper.

    ``key`` comes back as (key, copy): rows that repeat have copies 1, 2, ..,
    so that their tokens do not mix.  ``ref_ranges`` takes the columns
    ref_range_lower and ref_range_upper along where the table has them.

    A spec: time, code (column or list), prefix, numeric_value, text_value,
    filter_expr, ordinal.  Each row yields a struct per spec whose filter it
    passes, instead of one scan and union branch per spec.
    """

    def one(spec: dict) -> Column:
        codes = spec["code"] if isinstance(spec["code"], list) else [spec["code"]]
        texts = spec.get("text_value") or []
        texts = texts if isinstance(texts, list) else [texts]
        prefix = spec.get("prefix")
        word = lambda c: F.concat(F.lit(f"{prefix}_" if prefix else ""), F.coalesce(normalise_code(F.col(c)), F.lit("None")))
        numeric = spec.get("numeric_value")
        filters = spec.get("filter_expr")
        keep = F.lit(True) if not filters else reduce(lambda a, b: a & b, map(F.expr, [filters] if isinstance(filters, str) else filters))
        ts = to_ms(F.col(spec["time"]))
        if spec.get("fix_date_to_time"):
            ts = end_of_day(ts).cast("timestamp_ntz")
        return F.when(keep, F.struct(
            ts.alias("ts"), F.lit(spec.get("ordinal", 0)).alias("ord"),
            F.array(*[word(c) for c in [*codes, *texts]]).alias("words"),
            (F.col(numeric).cast("double") if numeric else F.lit(None).cast("double")).alias("value"),
            F.lit(numeric is not None).alias("numeric"),
        ))

    events = F.array_compact(F.array(*[one(s) for s in specs]))
    has = ref_ranges and {"ref_range_lower", "ref_range_upper"} <= set(df.columns)
    limits = [(F.col(f"ref_range_{n}") if has else F.lit(None)).cast("double").alias(n) for n in ("lower", "upper")]
    rows = (
        df.select(F.col(subject_id).cast("string").alias("sid"), key.alias("key"), *limits, F.explode(events).alias("e"))
        .select("sid", "key", "lower", "upper", "e.*")
        .where("ts is not null")
    )
    # dealt by what the windows of ``long_tokens`` are dealt by: their shuffle is this one
    copy = F.row_number().over(Window.partitionBy("sid", "ts", "ord", "key").orderBy("ts"))
    return rows.withColumn("key", F.struct("key", copy.alias("copy")))


def designators(events: DataFrame) -> DataFrame:
    """Numeric rows as (designator, value, ord, lower, upper)."""
    return events.where("numeric").select(F.col("words")[0].alias("designator"), "value", "ord", "lower", "upper")


def with_bins(events: DataFrame, breaks: DataFrame, labels: list[str], fused: bool, digits: int | None = None) -> DataFrame:
    """Words of numeric events get their bin: [word, Q] or [word_Q]; numeric events without one are dropped."""
    rows = events.withColumn("designator", F.when(F.col("numeric"), F.col("words")[0]))
    rows = apply_breaks(rows, F.broadcast(breaks), value="value", digits=digits)
    name = F.get(F.array(*[F.lit(x) for x in labels]), F.col("bin"))
    both = F.array(F.concat_ws("_", F.col("words")[0], name)) if fused else F.array(F.col("words")[0], name)
    return (
        rows.where(~F.col("numeric") | F.col("bin").isNotNull())
        .withColumn("words", F.when(F.col("numeric"), both).otherwise(F.col("words")))
        .drop("designator", "bin")
    )


def long_tokens(events: DataFrame, vocab: DataFrame, fixed: list[str]) -> DataFrame:
    """One row per token: sid, ts, ord, key, pos, word, token, first_token; events with an unknown or nan word are dropped."""
    rows = events.select("sid", "ts", "ord", "key", F.posexplode("words").alias("pos", "word"))
    coded = encode(rows, vocab, fixed)
    per_event = Window.partitionBy("sid", "ts", "ord", "key")
    bad = F.max((F.col("token").isNull() | F.col("token").isin(fixed.index("None"), fixed.index("nan"))).cast("int")).over(per_event)
    first = F.min_by("token", "pos").over(per_event)
    return coded.withColumns({"__bad": bad, "first_token": first}).where("__bad = 0").drop("__bad")


def with_spacers(tokens: DataFrame, fixed: list[str]) -> DataFrame:
    """A time token before each token that comes 5 minutes or more after the one before; it carries the later time."""
    w = Window.partitionBy("sid").orderBy(*ORDER)
    gap = F.floor((micros(F.col("ts")) - F.lag(micros(F.col("ts"))).over(w)) / F.lit(1_000_000))
    word, token = F.lit(None).cast("string"), F.lit(None).cast("long")
    for name, seconds in TIME_BINS.items():
        word = F.when(F.col("__gap") >= seconds, F.lit(name)).otherwise(word)
        token = F.when(F.col("__gap") >= seconds, F.lit(fixed.index(name)).cast("long")).otherwise(token)
    rows = tokens.withColumn("__gap", gap)
    own = F.struct(F.lit(1).alias("sub"), "word", "token")
    spacer = F.when(F.col("__gap") >= min(TIME_BINS.values()), F.struct(F.lit(0).alias("sub"), word.alias("word"), token.alias("token")))
    kept = [c for c in tokens.columns if c not in ("word", "token")]
    return rows.select(*kept, F.explode(F.array_compact(F.array(spacer, own))).alias("x")).select(*kept, "x.*")


def collect_timelines(tokens: DataFrame) -> DataFrame:
    """sid, tokens, words, times: parallel arrays in timeline order; a list per subject, built at the output edge only."""
    order = [*ORDER, *(["sub"] if "sub" in tokens.columns else [])]
    items = F.array_sort(F.collect_list(F.struct(*order, "word", "token")))
    return (
        tokens.groupBy("sid").agg(items.alias("__x"))
        .select("sid", F.transform("__x", lambda x: x["token"]).alias("tokens"), F.transform("__x", lambda x: x["word"]).alias("words"), F.transform("__x", lambda x: x["ts"]).alias("times"))
    )


def _within(times: Column, seconds: float) -> Column:
    """Number of leading elements within the duration of the smallest time, 0 if all are or none after the first is."""
    limit = micros_array_min(times) + F.lit(int(seconds * 1e6))
    at = F.array_position(F.transform(times, lambda t: micros(t) > limit), True)
    return F.greatest(at - 1, F.lit(0)).cast("int")


def micros_array_min(times: Column) -> Column:
    return micros(F.array_min(times))


def cut_at(df: DataFrame, seconds: float, lists: tuple[str, ...] = ("tokens", "words"), times: str = "times") -> DataFrame:
    """Keeps what lies within the duration of the first time; rows that still span more are dropped."""
    first = _within(F.col(times), seconds)
    cut = lambda c: F.when(F.col("__first") == 0, F.col(c)).otherwise(F.slice(c, F.lit(1), F.col("__first")))
    out = df.withColumn("__first", first).withColumns({c: cut(c) for c in (*[x for x in lists if x in df.columns], times)}).drop("__first")
    return out.where(micros(F.array_max(times)) - micros(F.array_min(times)) <= int(seconds * 1e6))


def ellipsis(df: DataFrame, days: float, token: int, word: str = "ELLIPSIS", times: str = "times") -> DataFrame:
    """Events beyond so many days become one ellipsis token at the last time."""
    first = _within(F.col(times), days * 86400)
    last = F.array_max(times)
    tail = {"tokens": F.lit(token).cast("long"), "words": F.lit(word), times: last}
    cut = lambda c: F.when(F.col("__first") == 0, F.col(c)).otherwise(F.concat(F.slice(c, F.lit(1), F.col("__first")), F.array(tail[c])))
    return df.withColumn("__first", first).withColumns({c: cut(c) for c in tail if c in df.columns}).drop("__first")


def pad(df: DataFrame, length: int, fixed: list[str]) -> DataFrame:
    """Adds seq_len and padded."""
    code = lambda w: F.lit(fixed.index(w)).cast("long")
    return df.withColumn("seq_len", F.size("tokens")).withColumn("padded", pad_or_truncate(F.col("tokens"), length, code("PAD"), code("TRUNC")))


def day_stays(df: DataFrame, times: str = "times") -> DataFrame:
    """Timelines of a day or more from the first to the last time."""
    span = micros(F.try_element_at(times, F.lit(-1))) - micros(F.try_element_at(times, F.lit(1)))
    return df.where(span >= 86_400_000_000)


def static_words(specs: list[dict], start: bool) -> Column:
    """Prefix words begin with TL_START, suffix words end with TL_END; list columns give a word per entry."""
    parts = []
    for s in specs:
        c = F.col(s["column"])
        if s.get("is_list"):
            parts.append(_list_words(c, s.get("prefix")))
        else:
            parts.append(F.array(c if s["column"].startswith("quantized") else static_word(c, s.get("prefix"))))
    edge = F.array(F.lit("TL_START" if start else "TL_END"))
    return F.concat(edge, *parts) if start else F.concat(*parts, edge)


def _list_words(column: Column, prefix: str | None) -> Column:
    return F.transform(F.coalesce(column.cast("array<string>"), F.array().cast("array<string>")), lambda x: static_word(x, prefix))


def times_qc(reference: DataFrame, events: DataFrame, subject: str, time: str, start: str, end: str) -> DataFrame:
    """Start and end widened to the first and last event; rows that do not start before they end are dropped."""
    seen = events.groupBy(subject).agg(F.min(time).alias("__min"), F.max(time).alias("__max"))
    out = reference.join(seen, subject, "left").withColumn(start, F.least(start, "__min")).withColumn(end, F.greatest(end, "__max"))
    return out.drop("__min", "__max").where(F.col(start) < F.col(end))


class TimelineTokenizer:
    """Configuration to timelines: ``fit`` learns breaks and vocabulary, ``transform`` applies them."""

    def __init__(self, config: TimelineConfig, spark: SparkSession, data_dir: str, tables: dict[str, DataFrame] | None = None):
        self.config, self.spark, self.data_dir, self.tables = config, spark, data_dir, tables or {}
        o = config.options
        self.fixed = fixed_words(o.quantizer, o.fused_category_values, o.include_time_spacing_tokens)

    def table(self, name: str) -> DataFrame:
        return self.tables[name] if name in self.tables else read_table(self.spark, self.data_dir, name)

    def _loaded(self, spec: dict, key: str | None = None) -> DataFrame:
        names = ("filter_expr", "with_col_expr", "agg_expr", "subject_id_str")
        return load(self.table(spec["table"]), subject_id=self.config.subject_id, key=key or spec.get("key"), **{k: spec[k] for k in names if k in spec})

    def reference(self) -> DataFrame:
        """One row per subject."""
        spec, subject = self.config.reference, self.config.subject_id
        out = self._loaded(spec)
        for extra in spec.get("augmentation_tables", []):
            out = validated_join(out, self._loaded(extra), extra["key"], "left", extra.get("validation", "m:1"))
        for name, text in (spec.get("post_join_cols") or {}).items():
            out = out.withColumn(name, F.expr(text))
        for qc in self.config.times_qc:
            out = times_qc(out, self.table(qc["table"]), subject, qc["time"], spec["start_time"], spec["end_time"])
        return out

    def events(self) -> DataFrame:
        """Rows of all event specs; one scan per table and set of derivations."""
        groups: dict[tuple, list[dict]] = {}
        for i, spec in enumerate(self.config.events):
            key = (spec["table"], str(spec.get("with_col_expr")), str(spec.get("subject_id_str")), spec.get("reference_key"))
            groups.setdefault(key, []).append({**spec, "ordinal": spec.get("ordinal", i)})
        found = None
        for specs in groups.values():
            base = {k: v for k, v in specs[0].items() if k in ("table", "with_col_expr", "subject_id_str")}
            df = self._loaded(base)
            if ref_key := specs[0].get("reference_key"):
                ref, r = self.reference(), self.config.reference
                spans = ref.select(ref_key, self.config.subject_id, F.col(r["start_time"]).alias("__start"), F.col(r["end_time"]).alias("__end"))
                df = df.join(spans, ref_key).where(F.col(specs[0]["time"]).between(F.col("__start"), F.col("__end")))
            key = F.xxhash64(*[F.col(c) for c in sorted(df.columns) if not c.startswith("__")])
            rows = event_rows(df, specs, self.config.subject_id, key, self.config.options.include_ref_ranges)
            found = rows if found is None else found.unionByName(rows)
        return found

    def _statics(self, breaks: DataFrame) -> DataFrame:
        """sid, start, end, prefix and suffix words; ``quantized_age`` is the word of the age's bin."""
        c, o = self.config, self.config.options
        ref = self.reference()
        if age := c.reference.get("age"):
            ref = apply_breaks(ref.withColumn("designator", F.lit(AGE)), breaks.where(F.col("designator") == AGE), value=age)
            name = F.get(F.array(*[F.lit(x) for x in bin_words(o.quantizer)]), F.col("bin"))
            word = F.concat_ws("_", F.lit(AGE), name) if o.fused_category_values else name
            ref = ref.withColumn("quantized_age", F.when(name.isNotNull(), word).otherwise("None")).drop("designator", "bin")
        start, end = (to_ms(F.col(c.reference[k])) for k in ("start_time", "end_time"))
        columns = [F.col(c.subject_id).cast("string").alias("sid"), start.alias("start"), end.alias("end"), static_words(c.prefix, True).alias("prefix"), static_words(c.suffix, False).alias("suffix")]
        return ref.select(*columns)

    def fit(self) -> Vocabulary:
        o = self.config.options
        events = self.events()
        values = designators(events)
        if age := self.config.reference.get("age"):
            ages = self.reference().select(F.lit(AGE).alias("designator"), F.col(age).cast("double").alias("value"), F.lit(-1).alias("ord"))
            values = values.unionByName(ages, allowMissingColumns=True)
        limits = {"ref_lower": "lower", "ref_upper": "upper"} if o.include_ref_ranges else {}
        breaks = learn_breaks(values, quantizer=o.quantizer, detect_discrete=o.detect_discrete, ordinal="ord", **limits)
        statics = self._statics(breaks)
        binned = with_bins(events, breaks, bin_words(o.quantizer), o.fused_category_values)
        words = (
            binned.select(F.explode("words").alias("word"), F.lit(0).alias("s"))
            .unionByName(statics.select(F.explode("prefix").alias("word"), F.lit(1).alias("s")))
            .unionByName(statics.select(F.explode("suffix").alias("word"), F.lit(2).alias("s")))
        )
        return Vocabulary(train(words, self.fixed, section="s"), breaks, self.fixed)

    def transform(self, vocabulary: Vocabulary) -> DataFrame:
        """sid, tokens, words, times (and seq_len, padded), sorted by nothing: writers may sort."""
        o = self.config.options
        labels = bin_words(o.quantizer)
        tokens = long_tokens(with_bins(self.events(), vocabulary.aux, labels, o.fused_category_values), vocabulary.words, self.fixed)
        if o.max_event_days is None:
            spaced = with_spacers(tokens, self.fixed) if o.include_time_spacing_tokens else tokens
            lists = collect_timelines(spaced)
        else:
            lists = ellipsis(collect_timelines(tokens), o.max_event_days, self.fixed.index("ELLIPSIS"))
            if o.include_time_spacing_tokens:
                zipped = lists.select("sid", F.posexplode(F.arrays_zip("tokens", "words", "times")).alias("pos", "x"))
                flat = zipped.select("sid", F.col("x.times").alias("ts"), F.lit(0).cast("long").alias("first_token"), F.lit(0).alias("ord"), F.struct(F.lit(0).cast("long").alias("key"), F.lit(1).alias("copy")).alias("key"), "pos", F.col("x.words").alias("word"), F.col("x.tokens").alias("token"))
                lists = collect_timelines(with_spacers(flat, self.fixed))
        statics = self._statics(vocabulary.aux)
        ends = statics.select("sid", "start", "end", F.lit(0).alias("side"), F.posexplode("prefix").alias("pos", "word")).unionByName(
            statics.select("sid", "start", "end", F.lit(1).alias("side"), F.posexplode("suffix").alias("pos", "word"))
        )
        coded = encode(ends, vocabulary.words, self.fixed)
        item = F.struct("pos", "word", "token")
        sides = coded.groupBy("sid", "start", "end").agg(
            *[F.array_sort(F.collect_list(F.when(F.col("side") == i, item))).alias(n) for i, n in enumerate(("__p", "__s"))]
        )
        joined = sides.join(lists, "sid", "left")
        col = lambda side, name: F.transform(side, lambda x: x[name])
        middle = lambda c, kind: F.coalesce(c, F.array().cast(kind))
        out = joined.select(
            "sid",
            F.concat(col("__p", "token"), middle("tokens", "array<bigint>"), col("__s", "token")).alias("tokens"),
            F.concat(col("__p", "word"), middle("words", "array<string>"), col("__s", "word")).alias("words"),
            F.concat(F.array_repeat("start", F.size("__p")), middle("times", "array<timestamp_ntz>"), F.array_repeat("end", F.size("__s"))).alias("times"),
        )
        out = day_stays(out) if o.day_stay_filter else out
        return pad(out, o.max_padded_len, self.fixed) if o.max_padded_len else out


def global_index(rows: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """Adds the row's number, from 0, in the given order, which ``key`` (an orderable column) leads.

    Numbers are two-level prefix sums: within ranges of ``key``, then over the
    ranges' totals, so that no task sees all rows.
    """
    splits = rows.select(F.percentile_approx(key, [i / 64 for i in range(1, 64)], 1000).alias("q")).first()["q"] or []
    edges = F.array(*[F.lit(x) for x in sorted(set(splits))]) if splits else F.array(F.lit(None).cast(rows.schema[key].dataType))
    ranged = rows.withColumn("__r", F.size(F.filter(edges, lambda e: e <= F.col(key))))
    totals = ranged.groupBy("__r").agg(F.count(F.lit(1)).alias("__n"))
    # a row per range: 64 at most
    before = totals.select("__r", (F.sum("__n").over(Window.orderBy("__r")) - F.col("__n")).alias("__before"))
    at = F.row_number().over(Window.partitionBy("__r").orderBy(*order)) - 1 + F.col("__before")
    return ranged.join(F.broadcast(before), "__r").withColumn(name, at).drop("__r", "__before")


def pack_tokens(tokens: DataFrame, length: int, order: list[str], key: str) -> DataFrame:
    """Concatenates all tokens in the given order, which ``key`` leads, and gives full chunks of ``length``: chunk, pos, token."""
    total = tokens.agg(F.count(F.lit(1)).alias("__all"))  # one row
    out = global_index(tokens, key, order, "__at").crossJoin(F.broadcast(total))
    return out.where(F.floor(F.col("__at") / length) < F.floor(F.col("__all") / length)).select(
        F.floor(F.col("__at") / length).cast("long").alias("chunk"), (F.col("__at") % length).cast("long").alias("pos"), "token"
    )
