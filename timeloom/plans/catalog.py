"""All registered queries of the timeline engine, each with SQL for the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from timeloom.functions import arrays, columns
from timeloom.operators import attention, cohort, evaluation, information, islands, joins, lookups, outcomes, quantize, split, timeline, vocab
from timeloom.sources.config import TimelineConfig
from timeloom.sources.tables import load, ravel, read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with the SQL it is compared with."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def events_of(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "events")


# ---------------------------------------------------------------- loading, reference frame


@query("""
select user_id, count(*) as n, round(sum(value * 2), 4) as total, max(upper(event_type)) as last_type
from events where event_type <> 'view' and value > 10 group by user_id
""")
def load_filter_derive_agg(spark, d):
    return load(
        events_of(spark, d), subject_id="user_id", filter_expr=["event_type <> 'view'", "value > 10"],
        with_col_expr={"doubled": "value * 2", "loud": "upper(event_type)"},
        agg_expr={"n": "count(*)", "total": "round(sum(doubled), 4)", "last_type": "max(loud)"},
    )


@query("""
select o_orderkey, o_orderdate, c_mktsegment, n_name from orders
left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey
""")
def reference_augment_left_m1(spark, d):
    orders = read_table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey").select("o_orderkey", "o_orderdate", "c_custkey")
    customer = read_table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment")
    nation = read_table(spark, d, "nation").select("n_nationkey", "n_name")
    out = joins.validated_join(orders, customer, "c_custkey", "left", "m:1")
    return joins.validated_join(out, nation, "n_nationkey", "left", "m:1").select("o_orderkey", "o_orderdate", "c_mktsegment", "n_name")


@query("""
select user_id, arg_min(event_type, ts) filter (where event_type <> 'view') as first_type,
       round(arg_min(value, ts) filter (where value > 100), 4) as first_large
from events group by user_id
""")
def first_non_null_attrs(spark, d):
    rows = events_of(spark, d).select("user_id", "ts", "event_id", F.when(F.col("event_type") != "view", F.col("event_type")).alias("first_type"), F.when(F.col("value") > 100, F.round("value", 4)).alias("first_large"))
    return lookups.first_non_null(rows, "user_id", ["first_type", "first_large"], ["ts", "event_id"])


@query("select l_orderkey, string_agg(l_returnflag, ',' order by l_returnflag) as codes from lineitem group by l_orderkey")
def collect_sorted_codes(spark, d):
    return read_table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list("l_returnflag")), ",").alias("codes"))


@query("""
select o_orderkey, least(o_orderdate, lo) as start_time, greatest(o_orderdate, hi) as end_time
from orders left join (select l_orderkey, min(l_shipdate) as lo, max(l_shipdate) as hi from lineitem group by l_orderkey) on l_orderkey = o_orderkey
where least(o_orderdate, lo) < greatest(o_orderdate, hi)
""")
def times_qc(spark, d):
    ref = read_table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("start_time"), F.col("o_orderdate").alias("end_time"))
    events = read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate")
    return timeline.times_qc(ref, events, "o_orderkey", "l_shipdate", "start_time", "end_time")


# ---------------------------------------------------------------- splits


@query("""
with g as (select o_custkey, row_number() over (order by min(o_orderdate), o_custkey) as r, count(*) over () as n from orders group by o_custkey)
select o_custkey, case when r <= floor(0.7 * n) then 'train' when r <= floor(0.7 * n) + floor(0.1 * n) then 'val' else 'test' end as split from g
""")
def group_chrono_split(spark, d):
    return split.group_split(read_table(spark, d, "orders"), "o_custkey", "o_orderdate")


@query("""
with g as (select o_custkey, row_number() over (order by min(o_orderdate), o_custkey) as r, count(*) over () as n from orders group by o_custkey)
select o_orderkey, o_totalprice from orders where o_custkey in (select o_custkey from g where r > floor(0.7 * n) and r <= floor(0.7 * n) + floor(0.1 * n))
""")
def split_routing(spark, d):
    orders = read_table(spark, d, "orders")
    ids = split.group_split(orders, "o_custkey", "o_orderdate").where("split = 'val'")
    return split.route(orders, ids, "subject_id", "o_custkey").select("o_orderkey", "o_totalprice")


SPANS = """spans as (select user_id, date_trunc('day', ts) as d, min(ts) as lo, max(ts) + interval 2 hour as hi from events where event_type = 'purchase' group by all)"""


def purchase_spans(spark, d):
    rows = events_of(spark, d).where("event_type = 'purchase'")
    return rows.groupBy("user_id", F.date_trunc("DAY", "ts").alias("d")).agg(F.min("ts").alias("lo"), (F.max("ts") + F.expr("INTERVAL '2' HOUR")).alias("hi"))


@query(f"with {SPANS} select event_id, lo from events e join spans s on e.user_id = s.user_id and e.ts between s.lo and s.hi")
def posthoc_interval_join(spark, d):
    return joins.interval_join(events_of(spark, d), purchase_spans(spark, d), ["user_id"], "ts", "lo", "hi").select("event_id", "lo")


@query("""
with w as (select user_id, ts as lo, ts + interval 3 day as hi from events where event_type = 'signup')
select cast(count(*) - count(distinct event_id) as bigint) as n_overlaps from events e join w on e.user_id = w.user_id and e.ts between w.lo and w.hi
""")
def interval_overlap_count(spark, d):
    events = events_of(spark, d)
    spans = events.where("event_type = 'signup'").select("user_id", F.col("ts").alias("lo"), (F.col("ts") + F.expr("INTERVAL '3' DAY")).alias("hi"))
    return joins.repeated_rows(joins.interval_join(events.select("user_id", "ts", "event_id"), spans, ["user_id"], "ts", "lo", "hi"), "event_id")


# ---------------------------------------------------------------- quantization


def _breaks_rows(df):
    return df.select("designator", F.posexplode("breaks").alias("i", "edge")).select("designator", "i", F.round("edge", 6).alias("edge"))


def _quantity(spark, d):
    return read_table(spark, d, "lineitem").select(F.col("l_returnflag").alias("designator"), F.col("l_extendedprice").alias("value"))


def _quantile_sql(n: int) -> str:
    shares = ", ".join(str(i / n) for i in range(1, n))
    return f"""
select designator, cast(i as int) as i, round(edge, 6) as edge from (
  select l_returnflag as designator, unnest(range(0, {n - 1})) as i, unnest(quantile_cont(l_extendedprice, [{shares}])) as edge from lineitem group by l_returnflag)
"""


@query(_quantile_sql(10))
def deciles(spark, d):
    return _breaks_rows(quantize.learn_breaks(_quantity(spark, d), quantizer="deciles"))


@query(_quantile_sql(20))
def ventiles(spark, d):
    return _breaks_rows(quantize.learn_breaks(_quantity(spark, d), quantizer="ventiles"))


@query(_quantile_sql(100))
def centiles(spark, d):
    return _breaks_rows(quantize.learn_breaks(_quantity(spark, d), quantizer="centiles"))


@query("""
select designator, cast(k + 3 as int) as i, round(m + k * s, 6) as edge
from (select l_returnflag as designator, avg(l_extendedprice) as m, stddev_pop(l_extendedprice) as s from lineitem group by all) cross join (select unnest(range(-3, 4)) as k)
""")
def sigmas(spark, d):
    return _breaks_rows(quantize.learn_breaks(_quantity(spark, d), quantizer="sigmas"))


@query("""
select designator, cast(i - 2 as int) as i, edge from (
  select l_returnflag as designator, l_linenumber * 1.0::double as edge, row_number() over (partition by l_returnflag order by l_linenumber) as i
  from (select distinct l_returnflag, l_linenumber from lineitem)) where i > 1
""")
def discrete_breaks(spark, d):
    rows = read_table(spark, d, "lineitem").select(F.col("l_returnflag").alias("designator"), F.col("l_linenumber").alias("value"))
    return _breaks_rows(quantize.learn_breaks(rows, quantizer="deciles", detect_discrete=True))


@query("""
with v as (select l_returnflag as g, l_quantity as x from lineitem),
e as (select g, unnest(list_concat(list_concat(list_concat(list_concat(
        quantile_cont(x, [0.2, 0.4, 0.6, 0.8]) filter (where x < 10), [10.0::double]),
        quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) filter (where x between 10 and 40)), [40.0::double]),
        quantile_cont(x, [0.2, 0.4, 0.6, 0.8]) filter (where x > 40))) as edge from v group by g)
select g as designator, cast(row_number() over (partition by g order by edge) - 1 as int) as i, edge from (select distinct g, round(edge, 6) as edge from e)
""")
def ref_range_breaks(spark, d):
    rows = read_table(spark, d, "lineitem").select(F.col("l_returnflag").alias("designator"), F.col("l_quantity").alias("value"), F.lit(10.0).alias("lo"), F.lit(40.0).alias("hi"))
    return _breaks_rows(quantize.learn_breaks(rows, quantizer="ventiles", ref_lower="lo", ref_upper="hi", digits=6))


BINNED = """
b as (select l_returnflag as g, list_transform(quantile_cont(l_quantity, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]), lambda x : round(x, 6)) as e from lineitem group by all),
binned as (select l_returnflag as g, len(list_filter(e, lambda x : x <= round(l_quantity, 6))) as bin from lineitem join b on g = l_returnflag)
"""


def _binned(spark, d):
    rows = read_table(spark, d, "lineitem").select(F.col("l_returnflag").alias("designator"), F.col("l_quantity").alias("value"))
    return quantize.apply_breaks(rows, F.broadcast(quantize.learn_breaks(rows, digits=6)), digits=6)


@query(f"with {BINNED} select 'QTY_' || lower(g) || '_Q' || bin as word, count(*) as n from binned group by all")
def digitize_fused(spark, d):
    word = F.concat(F.lit("QTY_"), columns.normalise_code(F.col("designator")), F.lit("_Q"), F.col("bin").cast("string"))
    return _binned(spark, d).groupBy(word.alias("word")).agg(F.count(F.lit(1)).alias("n"))


@query(f"with {BINNED} select 'QTY_' || lower(g) as word, 'Q' || bin as q, cast(bin as int) as token, count(*) as n from binned group by all")
def digitize_unfused(spark, d):
    word = F.concat(F.lit("QTY_"), columns.normalise_code(F.col("designator")))
    return _binned(spark, d).groupBy(word.alias("word"), F.concat(F.lit("Q"), F.col("bin").cast("string")).alias("q"), F.col("bin").alias("token")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- vocabulary and timelines


FIXED = vocab.fixed_words()
VOCAB = "vocab as (select word, {n} + row_number() over (order by word) - 1 as token from (select distinct 'EVT_' || lower(event_type) as word from events))".format(n=len(FIXED))


@query("with " + VOCAB + " select word, cast(token as bigint) as token from vocab")
def vocab_train(spark, d):
    words = events_of(spark, d).select(F.concat(F.lit("EVT_"), columns.normalise_code(F.col("event_type"))).alias("word"))
    return vocab.train(words, FIXED).where(F.col("token") >= len(FIXED))


@query("with " + VOCAB.replace("from events", "from events where event_type <> 'error'") + f"""
select event_id, cast(coalesce(token, {FIXED.index('None')}) as bigint) as token from events left join vocab on word = 'EVT_' || lower(event_type)
""")
def vocab_frozen_apply(spark, d):
    word = F.concat(F.lit("EVT_"), columns.normalise_code(F.col("event_type")))
    rows = events_of(spark, d)
    trained = vocab.train(rows.where("event_type <> 'error'").select(word.alias("word")), FIXED)
    return vocab.encode(rows.select("event_id", word.alias("word")), trained, FIXED).select("event_id", "token")


def event_config(**options) -> TimelineConfig:
    return TimelineConfig.from_dict({
        "subject_id": "user_id", "group_id": "user_id",
        "reference": {"table": "events", "agg_expr": {"start_time": "min(ts)", "end_time": "max(ts)", "kind": "min(event_type)"}, "start_time": "start_time", "end_time": "end_time"},
        "prefix": [{"column": "kind", "prefix": "KIND"}], "suffix": [{"column": "kind", "prefix": "LAST"}],
        "events": [{"table": "events", "time": "ts", "code": "event_type", "prefix": "EVT", "numeric_value": "value"}],
        "options": {"quantizer": "deciles", **options},
    })


def event_tokens(spark, d, spaced=True):
    """Long tokens of the event stream: word, bin and, if asked, time tokens."""
    tokenizer = timeline.TimelineTokenizer(event_config(), spark, d)
    events = tokenizer.events()
    breaks = quantize.learn_breaks(timeline.designators(events), quantizer="deciles", digits=6)
    labels = quantize.bin_words("deciles")
    binned = timeline.with_bins(events, breaks, labels, fused=False, digits=6)
    trained = vocab.train(binned.select(F.explode("words").alias("word")), FIXED)
    tokens = timeline.long_tokens(binned, trained, FIXED)
    return timeline.with_spacers(tokens, FIXED) if spaced else tokens


def _time_bin_case(gap: str) -> str:
    return "case " + " ".join(f"when {gap} >= {s} then '{w}'" for w, s in reversed(vocab.TIME_BINS.items())) + " end"


LONG = f"""
e as (select user_id, date_trunc('millisecond', ts) as ts, event_id, 'EVT_' || lower(event_type) as word, value from events),
br as (select word, list_transform(quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]), lambda x : round(x, 6)) as edges from e group by word),
q as (select e.*, 'Q' || len(list_filter(edges, lambda x : x <= round(value, 6))) as qw,
        floor((epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id)) / 1e6) as gap from e join br using (word)),
long as (
  select user_id, ts, event_id, 0 as sub, {_time_bin_case('gap')} as w from q where gap >= 300
  union all select user_id, ts, event_id, 1, word from q
  union all select user_id, ts, event_id, 2, qw from q)
"""
PLAIN = LONG.replace("where gap >= 300", "where false")


@query(f"with {LONG} select cast(user_id as varchar) as sid, count(*) as n_tokens, string_agg(w, ' ' order by ts, event_id, sub) as words from long group by user_id")
def timeline_tokens(spark, d):
    lists = timeline.collect_timelines(event_tokens(spark, d))
    return lists.select("sid", F.size("tokens").cast("long").alias("n_tokens"), F.array_join("words", " ").alias("words"))


@query(f"""
with {LONG},
ids as (select word, row_number() over () - 1 as token from (select unnest([{', '.join(repr(w) for w in FIXED)}]) as word)),
data as (select word, {len(FIXED)} + row_number() over (order by word) - 1 as token from (select distinct word from e)),
v as (select * from ids union all select * from data)
select cast(user_id as varchar) as sid, string_agg(cast(token as varchar), ' ' order by ts, event_id, sub) as tokens from long join v on v.word = w group by user_id
""")
def timeline_token_ids(spark, d):
    lists = timeline.collect_timelines(event_tokens(spark, d))
    return lists.select("sid", F.array_join(F.transform("tokens", lambda t: t.cast("string")), " ").alias("tokens"))


@query(f"""
with {LONG}, k as (select user_id, min(event_type) as kind from events group by all)
select cast(l.user_id as varchar) as sid, 'TL_START KIND_' || any_value(kind) || ' ' || string_agg(w, ' ' order by ts, event_id, sub) || ' LAST_' || any_value(kind) || ' TL_END' as words,
       cast(count(*) + 4 as bigint) as n_tokens
from long l join k on l.user_id = k.user_id group by l.user_id
""")
def timeline_prefix_suffix(spark, d):
    tokenizer = timeline.TimelineTokenizer(event_config(), spark, d)
    out = tokenizer.transform(tokenizer.fit())
    return out.select("sid", F.array_join("words", " ").alias("words"), F.size("times").cast("long").alias("n_tokens"))


@query(f"with {LONG} select w as word, count(*) as n from long where sub = 0 group by w")
def time_spacers(spark, d):
    return event_tokens(spark, d).where("sub = 0").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


LISTS = "t as (select user_id, list(w order by ts, event_id, sub) as ws, list(ts order by ts, event_id, sub) as tt from long group by user_id)"
FIRST = "coalesce(greatest(list_position(list_transform(tt, lambda x : x > list_min(tt) + interval {n} day), true) - 1, 0), 0)"


@query(f"with {PLAIN}, {LISTS}, f as (select *, {FIRST.format(n=3)} as f from t)" + """
select cast(user_id as varchar) as sid, array_to_string(case when f = 0 then ws else ws[1:f] || ['ELLIPSIS'] end, ' ') as words,
       case when f = 0 then tt[-1] else list_max(tt) end as last_time from f
""")
def ellipsis_truncate(spark, d):
    lists = timeline.collect_timelines(event_tokens(spark, d, spaced=False))
    cut = timeline.ellipsis(lists, 3, FIXED.index("ELLIPSIS"))
    return cut.select("sid", F.array_join("words", " ").alias("words"), F.element_at("times", -1).alias("last_time"))


@query(f"with {PLAIN}, {LISTS}, f as (select *, {FIRST.format(n=1)} as f from t)" + """
select cast(user_id as varchar) as sid, array_to_string(case when f = 0 then ws else ws[1:f] end, ' ') as words from f
where list_max(case when f = 0 then tt else tt[1:f] end) - list_min(tt) <= interval 1 day
""")
def cut_24h(spark, d):
    lists = timeline.collect_timelines(event_tokens(spark, d, spaced=False))
    return timeline.cut_at(lists, 86400).select("sid", F.array_join("words", " ").alias("words"))


@query(f"with {PLAIN}, {LISTS}" + """
select cast(user_id as varchar) as sid, cast(len(ws) as int) as seq_len,
       array_to_string(case when len(ws) <= 120 then ws || list_transform(range(120 - len(ws)), lambda x : 'PAD') else ws[1:119] || ['TRUNC'] end, ' ') as padded from t
""")
def pad_truncate(spark, d):
    lists = timeline.collect_timelines(event_tokens(spark, d, spaced=False))
    padded = arrays.pad_or_truncate(F.col("words"), 120, F.lit("PAD"), F.lit("TRUNC"))
    return lists.select("sid", F.size("words").alias("seq_len"), F.array_join(padded, " ").alias("padded"))


@query("select cast(user_id as varchar) as sid from events where user_id % 3 = 0 or event_type = 'error' group by user_id having max(ts) - min(ts) >= interval 1 day")
def day_stay_filter(spark, d):
    rows = events_of(spark, d).where("user_id % 3 = 0 or event_type = 'error'")
    lists = rows.groupBy(F.col("user_id").cast("string").alias("sid")).agg(F.array_sort(F.collect_list("ts")).alias("times"))
    return timeline.day_stays(lists).select("sid")


@query(f"""
with {PLAIN}, n as (select w, row_number() over (order by user_id, ts, event_id, sub) - 1 as i, count(*) over () as c from long)
select cast(i // 64 as bigint) as chunk, string_agg(w, ' ' order by i) as words from n where i // 64 < c // 64 group by i // 64
""")
def token_packing(spark, d):
    tokens = event_tokens(spark, d, spaced=False)
    rows = tokens.select(F.col("sid").cast("long").alias("sid"), "ts", F.col("first_token"), "ord", "key", "pos", F.col("word").alias("token"))
    packed = timeline.pack_tokens(rows, 64, ["sid", "ts", "first_token", "ord", "key", "pos"], "sid")
    items = F.array_sort(F.collect_list(F.struct("pos", "token")))
    return packed.groupBy("chunk").agg(F.array_join(F.transform(items, lambda x: x["token"]), " ").alias("words"))


# ---------------------------------------------------------------- outcomes and summaries


@query("""
with t as (select user_id, min(ts) as lo, bool_or(event_type = 'error') as err, bool_or(event_type = 'signup') as su,
                  date_diff('hour', timestamp '2020-01-01', timestamp '2020-01-01' + (max(ts) - min(ts))) as los from events group by user_id),
c as (select e.user_id, bool_or(event_type = 'error') as err, bool_or(event_type = 'signup') as su from events e join t using (user_id) where ts <= lo + interval 1 day group by all)
select cast(t.user_id as varchar) as sid, t.err as had_error, t.su as had_signup, cast(los as bigint) as length_of_stay, los > 168 as long_length_of_stay,
       c.err as had_error_24h, c.su as had_signup_24h from t join c using (user_id)
""")
def outcome_flags(spark, d):
    item = F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type")))
    lists = events_of(spark, d).groupBy(F.col("user_id").cast("string").alias("sid")).agg(item.alias("x")).select(
        "sid", F.transform("x", lambda x: x["event_type"]).alias("words"), F.transform("x", lambda x: x["ts"]).alias("times")
    )
    named = {"had_error": "error", "had_signup": "signup"}
    out = outcomes.with_early(lists, timeline.cut_at(lists, 86400, ("words",)), named)
    return out.select("sid", *named, "length_of_stay", "long_length_of_stay", *[f"{n}_24h" for n in named])


@query("""
select cast(user_id as varchar) as sid, cast(floor(epoch(max(ts) - min(ts)) / 3600) as bigint) as length_of_stay, floor(epoch(max(ts) - min(ts)) / 3600) > 168 as long_length_of_stay
from events group by user_id
""")
def length_of_stay(spark, d):
    lists = events_of(spark, d).groupBy(F.col("user_id").cast("string").alias("sid")).agg(F.array_sort(F.collect_list("ts")).alias("times"))
    return outcomes.stay_lengths(lists).drop("times")


@query(f"with {LONG} select w as word, n, round(n / sum(n) over (), 6) as share from (select w, count(*) as n from long group by w) order by n desc, word limit 20")
def token_usage_topk(spark, d):
    found = lookups.value_shares(event_tokens(spark, d).select("word"), "word", 20)
    return found.select("word", "n", F.round("share", 6).alias("share"))


@query(f"""
with {LONG}, c as (select case when w like 'Q%' then 'QUANT' when w like 'T\\_%' escape '\\' then 'T_SPACER' else split_part(w, '_', 1) end as type, count(*) as n from long group by 1)
select type, n, round(n / sum(n) over (), 6) as share from c
""")
def token_type_share(spark, d):
    typed = event_tokens(spark, d).select(columns.token_type(F.col("word"), vocab.SPECIALS).alias("type"))
    return lookups.value_shares(typed, "type").select("type", "n", F.round("share", 6).alias("share"))


@query(f"""
with {LONG}, c as (select cast(count(*) as double) as n from long group by user_id)
select count(*) as n, 0::bigint as n_null, round(avg(n), 6) as mean, round(stddev_samp(n), 6) as std, min(n) as min, quantile_cont(n, 0.25) as q25,
       quantile_cont(n, 0.5) as q50, quantile_cont(n, 0.75) as q75, max(n) as max from c
""")
def timeline_length_describe(spark, d):
    sizes = event_tokens(spark, d).groupBy("sid").agg(F.count(F.lit(1)).cast("double").alias("size"))
    out = lookups.describe(sizes, "size")
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std")})


# ---------------------------------------------------------------- information


NUMBERED = "e as (select user_id, date_trunc('day', ts) as ts, value, row_number() over (partition by user_id order by ts, event_id) - 1 as pos from events)"


def numbered(spark, d):
    """The event stream as tokens of one-day events: sid, ts, pos, value."""
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return events_of(spark, d).select(F.col("user_id").alias("sid"), F.date_trunc("DAY", "ts").alias("ts"), "value", pos.alias("pos"))


@query(f"with {NUMBERED} select user_id as sid, cast(pos as int) as pos, round(sum(value) over (partition by user_id, ts), 4) as event_sum, max(value) over (partition by user_id, ts) as event_max from e")
def event_information(spark, d):
    rows = information.event_information(numbered(spark, d), how="sum").withColumnRenamed("event_value", "s")
    rows = information.event_information(rows, how="max")
    return rows.select("sid", "pos", F.round("s", 4).alias("event_sum"), F.col("event_value").alias("event_max"))


@query("select user_id as sid, cast(sum(case when value >= (select quantile_cont(value, 0.95) from events) then 1 else 0 end) as bigint) as n_top from events group by user_id")
def top_q_counts(spark, d):
    return information.top_quantile_counts(events_of(spark, d).withColumnRenamed("user_id", "sid"), "sid", "value", 0.95)


def _redacted_sql(limit: str, order: str) -> str:
    return f"""
with {NUMBERED}, ev as (select user_id, ts, max(value) as v, min(pos) as f from e group by all),
r as (select *, row_number() over (partition by user_id order by v {order}, ts) as r, count(*) over (partition by user_id) as n from ev where f > 0)
select e.user_id as sid, cast(e.pos as int) as pos from e anti join (select * from r where r <= {limit}) g on e.user_id = g.user_id and e.ts = g.ts
"""


@query(_redacted_sql("3", "desc"))
def redact_topk(spark, d):
    return information.redact(numbered(spark, d), "value", k=3, how="max").select("sid", "pos")


@query(_redacted_sql("floor(0.25 * n)", "asc"))
def redact_pct(spark, d):
    return information.redact(numbered(spark, d), "value", pct=0.25, method="bottom", how="max").select("sid", "pos")


@query(f"with {NUMBERED} select user_id as sid, cast(pos as int) as pos, round(-ln(1 / (1 + value)) / ln(2) * (pos > 0)::int, 6) as bits from e")
def token_information_bits(spark, d):
    rows = numbered(spark, d).withColumn("logp", F.log(1 / (1 + F.col("value"))))
    return information.token_information(rows).select("sid", "pos", F.round("bits", 6).alias("bits"))


VECTORS = "v as (select label as sid, vec_id as pos, vec_id // 10 as ts, embedding as x, lag(embedding) over (partition by label order by vec_id) as b from embeddings)"


def vectors(spark, d):
    return read_table(spark, d, "embeddings").select(F.col("label").alias("sid"), F.col("vec_id").alias("pos"), F.floor(F.col("vec_id") / 10).alias("ts"), F.col("embedding").cast("array<double>").alias("x"))


JUMP = "sqrt(list_sum(list_transform(range(1, len(x) + 1), lambda i : power(x[i]::double - coalesce(b[i]::double, 0), 2))))"


@query(f"with {VECTORS} select sid, pos, round({JUMP}, 5) as jump from v")
def vector_jumps(spark, d):
    return information.jumps(vectors(spark, d), "x").select("sid", "pos", F.round("jump", 5).alias("jump"))


@query(f"with {VECTORS} select sid, cast(ts as bigint) as ts, round(sum({JUMP}), 4) as path_length, count(*) as n_tokens from v group by sid, ts")
def event_path_length(spark, d):
    found = information.event_paths(information.jumps(vectors(spark, d), "x"), "jump")
    return found.select("sid", "ts", F.round("path_length", 4).alias("path_length"), "n_tokens")


@query(f"""
with {VECTORS}, l as (select sid, ts, arg_max(x, pos) as x, min(pos) as f from v group by sid, ts), p as (select *, lag(x) over (partition by sid order by f) as b from l)
select sid, cast(ts as bigint) as ts, round({JUMP}, 5) as event_jump from p where b is not null
""")
def event_level_jumps(spark, d):
    return information.event_jumps(vectors(spark, d), "x").select("sid", "ts", F.round("event_jump", 5).alias("event_jump"))


@query(f"""
with {NUMBERED}, f as (select *, first_value(value) over (partition by user_id order by pos) as first, count(*) over w as c, sum(value) over w as s from e
  window w as (partition by user_id order by pos rows between 3 preceding and current row))
select user_id as sid, cast(pos as int) as pos, round((s + (4 - c) * first) / 4, 4) as mvg_avg from f
""")
def moving_average_padded(spark, d):
    return information.moving_average(numbered(spark, d), "value", 4).select("sid", "pos", F.round("mvg_avg", 4).alias("mvg_avg"))


@query("""
with s as (select user_id % 7 as sid, user_id as sample, max((event_type = 'purchase')::int) as h, sum(value / 10000) as s, 1 - exp(sum(ln(1 - value / 10000))) as m from events group by 1, 2)
select sid, round(avg(h), 6) as m0, round(avg(s), 6) as m1, round(avg(m), 6) as m2 from s group by sid
""")
def mc_estimators(spark, d):
    rows = events_of(spark, d).select((F.col("user_id") % 7).alias("sid"), F.col("user_id").alias("sample"), (F.col("value") / 10000).alias("p"), (F.col("event_type") == "purchase").alias("hit"))
    found = information.mc_estimates(rows)
    return found.select("sid", *[F.round(c, 6).alias(c) for c in ("m0", "m1", "m2")])


# ---------------------------------------------------------------- episodes, as-of and range joins


@query("""
with c as (select user_id, ts, event_type, case when event_type is distinct from lag(event_type) over w then 1 else 0 end as chg from events window w as (partition by user_id order by ts)),
s as (select *, sum(chg) over (partition by user_id order by ts) as streak from c),
r as (select user_id, streak, max(event_type) as state, min(ts) as start, max(ts) as last, count(*) as n_rows from s group by all)
select user_id, cast(streak as bigint) as streak, state, start, n_rows, coalesce(lead(start) over (partition by user_id order by streak), last) as "end" from r
""")
def streaks_gaps_islands(spark, d):
    return islands.streaks(events_of(spark, d), "user_id", "ts", F.col("event_type")).select("user_id", "streak", "state", "start", "n_rows", "end")


@query("""
with c as (select user_id, ts, (value >= 50)::int as state, case when (value >= 50)::int is distinct from lag((value >= 50)::int) over w then 1 else 0 end as chg from events window w as (partition by user_id order by ts)),
s as (select *, sum(chg) over (partition by user_id order by ts) as streak from c),
r as (select user_id, streak, max(state) as state, min(ts) as start, max(ts) as last from s group by all),
e as (select *, coalesce(lead(start) over (partition by user_id order by streak), last) as fin from r)
select user_id, cast(streak as bigint) as streak, cast(date_diff('minute', start, fin) as bigint) as minutes, (date_diff('minute', start, fin) >= 30 and state = 1) as long_enough from e
""")
def block_durations(spark, d):
    runs = islands.streaks(events_of(spark, d), "user_id", "ts", F.when(F.col("value") >= 50, 1).otherwise(0))
    return runs.select("user_id", "streak", "minutes", ((F.col("minutes") >= 30) & (F.col("state") == 1)).alias("long_enough"))


RESP_SQL = """
resp_p as (select user_id as hospitalization_id, ts as recorded_dttm,
    case when event_type in ('click', 'purchase') then 'imv' when event_type = 'signup' then null else 'nippv' end as device_category,
    case when event_id % 5 = 0 then 't1-piece' else 'vent' end as device_name,
    case when event_type = 'click' then 'pressure support/cpap' else 'other' end as mode_category,
    value / 20 as peep_set, value / 15 as pressure_support_set, (event_id % 11 = 0)::int as tracheostomy from events)
"""


def respiratory(spark, d):
    """The event stream in the role of respiratory support rows."""
    kind = F.col("event_type")
    return events_of(spark, d).select(
        F.col("user_id").alias("hospitalization_id"), F.col("ts").alias("recorded_dttm"),
        F.when(kind.isin("click", "purchase"), "imv").when(kind == "signup", None).otherwise("nippv").alias("device_category"),
        F.when(F.col("event_id") % 5 == 0, "t1-piece").otherwise("vent").alias("device_name"),
        F.when(kind == "click", "pressure support/cpap").otherwise("other").alias("mode_category"),
        (F.col("value") / 20).alias("peep_set"), (F.col("value") / 15).alias("pressure_support_set"), (F.col("event_id") % 11 == 0).cast("int").alias("tracheostomy"),
    )


@query(f"""
with {RESP_SQL},
a as (select hospitalization_id as h, recorded_dttm as t, (device_category is not distinct from 'imv')::int as on_imv, tracheostomy as tr from resp_p),
b as (select *, lag(on_imv) over w as on0, lag(tr) over w as tr0 from a window w as (partition by h order by t)),
c as (select *, sum(case when (on_imv = 0 and on0 = 1) or (on_imv = 1 and on0 is distinct from 1) then 1 else 0 end) over w as streak,
        sum(case when tr = 1 and tr0 is distinct from 1 then 1 else 0 end) over w as flips, (tr = 1 and tr0 is distinct from 1) as flip from b window w as (partition by h order by t)),
s as (select h, streak, min(t) as t0, max(t) as t1, min(case when flip and flips = 1 then t end) as tt, max(on_imv) as on_imv from c group by all),
e as (select *, coalesce(tt, lead(t0) over (partition by h order by streak), t1) as t2 from s)
select h as hospitalization_id, cast(streak as bigint) as streak_id, on_imv, t0 as start_dttm, t2 as end_dttm, round(date_diff('minute', t0, t2) / 60, 6) as duration_hrs,
       (date_diff('minute', t0, t2) / 60 >= 24)::int as at_least_24h from e
""")
def ventilation_streaks(spark, d):
    out = islands.ventilation_streaks(respiratory(spark, d))
    return out.select(
        "hospitalization_id", F.col("_streak_id").alias("streak_id"), F.col("_on_imv").alias("on_imv"), F.col("_start_dttm").alias("start_dttm"),
        F.col("_end_dttm").alias("end_dttm"), F.round("_duration_hrs", 6).alias("duration_hrs"), F.col("_at_least_24h").alias("at_least_24h"),
    )


@query(f"""
with {RESP_SQL},
cs as (select user_id as h, ts as start_dttm, case when event_id % 3 = 0 then ' Full' else 'DNR' end as code from events where event_type = 'error'),
ds as (select user_id as h, max(ts) as discharge_dttm, case when user_id % 2 = 0 then 'Expired' else 'Home' end as dc from events group by user_id),
lv as (select user_id as h, max(ts) as t from events where event_type = 'view' group by user_id),
a as (select *, hospitalization_id as h, recorded_dttm as t,
        ((mode_category = 'pressure support/cpap' and peep_set <= 8 and pressure_support_set <= 8) or regexp_matches(device_name, 't1[\\s_-]?piece'))::int as sbt,
        (lag(device_category) over w is distinct from 'imv' and device_category is not distinct from 'imv')::int as intub,
        coalesce((lag(device_category) over w = 'imv' and device_category is distinct from 'imv')::int, 0) as extub,
        coalesce((lag(tracheostomy) over w = 0 and tracheostomy = 1)::int, 0) as flip
      from resp_p window w as (partition by hospitalization_id order by recorded_dttm)),
b as (select *, case when sbt is distinct from lag(sbt) over w then 1 else 0 end as chg, (extub = 1 and sum(extub) over w = 1)::int as extub1,
        (flip = 1 and sum(flip) over w = 1)::int as trach1 from a window w as (partition by h order by t)),
c as (select *, sum(chg) over (partition by h order by t) as block,
        (extub1 = 1 and exists (select 1 from a where a.h = b.h and a.intub = 1 and a.t > b.t and a.t <= b.t + interval 6 hour))::int as fail,
        (extub1 = 1 and exists (select 1 from lv where lv.h = b.h and lv.t >= b.t and lv.t <= b.t + interval 24 hour))::int as vit from b),
bl as (select h, block, min(t) as t0, max(t) as t1 from c group by all),
bd as (select h, block, date_diff('minute', t0, coalesce(lead(t0) over (partition by h order by block), t1)) as mins from bl),
j as (select c.*, bd.mins, cs.code, cs.start_dttm, ds.dc, ds.discharge_dttm from c left join bd on bd.h = c.h and bd.block = c.block
      asof left join cs on cs.h = c.h and cs.start_dttm <= c.t asof left join ds on ds.h = c.h and c.t <= ds.discharge_dttm),
k as (select *, coalesce((extub1 = 1 and trim(lower(code)) <> 'full' and trim(lower(dc)) in ('hospice', 'expired'))::int, 0) as wd from j)
select h as hospitalization_id, t as recorded_dttm, cast(mins as bigint) as block_mins, (mins >= 30 and sbt = 1)::int as sbt_done, extub1 as extub_1st, intub, trach1 as trach_1st, fail as fail_extub,
       code as code_status_category, start_dttm as cs_start_dttm, dc as discharge_category, vit as last_vitals_24h, wd as withdrawal,
       (extub1 = 1 and wd = 0 and fail = 0)::int as success_extub, coalesce((extub1 = 1 and vit = 1 and fail = 0 and trim(lower(dc)) in ('hospice', 'expired'))::int, 0) as death_wo_reintub
from k where tracheostomy = 0 or trach1 = 1
""")
def successful_extubation(spark, d):
    events = events_of(spark, d)
    key = F.col("user_id").alias("hospitalization_id")
    codes = events.where("event_type = 'error'").select(key, F.col("ts").alias("start_dttm"), F.when(F.col("event_id") % 3 == 0, " Full").otherwise("DNR").alias("code_status_category"))
    gone = events.groupBy(key).agg(F.max("ts").alias("discharge_dttm")).withColumn("discharge_category", F.when(F.col("hospitalization_id") % 2 == 0, "Expired").otherwise("Home"))
    vitals = events.where("event_type = 'view'").groupBy(key).agg(F.max("ts").alias("recorded_dttm"))
    out = islands.extubations(respiratory(spark, d), codes, gone, vitals)
    return out.select(
        "hospitalization_id", "recorded_dttm", F.col("_block_duration_mins").alias("block_mins"), "sbt_done", F.col("_extub_1st").alias("extub_1st"), F.col("_intub").alias("intub"),
        F.col("_trach_1st").alias("trach_1st"), F.col("_fail_extub").alias("fail_extub"), "code_status_category", "cs_start_dttm", "discharge_category",
        F.col("_last_vitals_within_24h_of_extub").alias("last_vitals_24h"), F.col("_withdrawl_lst").alias("withdrawal"), F.col("_success_extub").alias("success_extub"),
        F.col("_death_after_extub_wo_reintub").alias("death_wo_reintub"),
    )


def _kinds(spark, d):
    events = events_of(spark, d)
    left = events.where("event_type = 'error'").select("user_id", "event_id", "ts")
    right = events.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("p_ts"), F.col("event_id").alias("p_event"))
    return left, right


@query("""
select e.event_id, p.ts as p_ts, p.event_id as p_event from (select * from events where event_type = 'error') e
asof left join (select * from events where event_type = 'purchase') p on e.user_id = p.user_id and p.ts <= e.ts
""")
def asof_backward(spark, d):
    left, right = _kinds(spark, d)
    return joins.asof_join(left, right, "user_id", "ts", "p_ts", ["p_event"]).select("event_id", "p_ts", "p_event")


@query("""
select e.event_id, p.ts as p_ts, p.event_id as p_event from (select * from events where event_type = 'error') e
asof left join (select * from events where event_type = 'purchase') p on e.user_id = p.user_id and p.ts >= e.ts
""")
def asof_forward(spark, d):
    left, right = _kinds(spark, d)
    return joins.asof_join(left, right, "user_id", "ts", "p_ts", ["p_event"], backward=False).select("event_id", "p_ts", "p_event")


@query("""
select event_id, exists (select 1 from events p where p.user_id = e.user_id and p.event_type = 'purchase' and p.ts > e.ts and p.ts <= e.ts + interval 6 hour)::int as followed_6h,
       exists (select 1 from events p where p.user_id = e.user_id and p.event_type = 'purchase' and p.ts >= e.ts and p.ts <= e.ts + interval 24 hour)::int as followed_24h
from events e where event_type = 'error'
""")
def exists_within_interval(spark, d):
    left, _ = _kinds(spark, d)
    right = events_of(spark, d).where("event_type = 'purchase'").select("user_id", "ts")
    out = joins.flag_followed(left, right, "user_id", "ts", 6 * 3600, "followed_6h")
    return joins.flag_followed(out, right, "user_id", "ts", 24 * 3600, "followed_24h", open_start=False).drop("user_id", "ts")


@query("""
select a.event_id, b.event_id as other from events a join events b on a.user_id = b.user_id and b.ts >= a.ts and b.ts <= a.ts + interval 900 minute
where a.event_type = 'view' and b.event_type = 'click'
""")
def band_join(spark, d):
    events = events_of(spark, d)
    left = events.where("event_type = 'view'").select("event_id", "user_id", "ts")
    right = events.where("event_type = 'click'").select(F.col("event_id").alias("other"), "user_id", "ts")
    return joins.band_join(left, right, "user_id", "ts", "'900' MINUTE").select("event_id", "other")


@query("""
select round(avg(f), 6) as rate, count(*) as n from (select (exists (select 1 from events b where b.user_id = a.user_id and b.event_type = 'click' and b.ts >= a.ts and b.ts <= a.ts + interval 15 hour))::int as f
from events a where event_type = 'view')
""")
def follow_up_rate(spark, d):
    events = events_of(spark, d)
    pick = lambda kind: events.where(F.col("event_type") == kind).select("user_id", "ts")
    return lookups.follow_up_rate(pick("view"), pick("click"), "user_id", "ts", 900).select(F.round("rate", 6).alias("rate"), "n")


# ---------------------------------------------------------------- lookups and scalar functions


@query("""
select distinct o_custkey, l_partkey from orders join lineitem on l_orderkey = o_orderkey where o_orderdate >= timestamp '1997-01-01' and (o_custkey, l_partkey) not in
  (select (o_custkey, l_partkey) from orders join lineitem on l_orderkey = o_orderkey where o_orderdate < timestamp '1997-01-01')
""")
def anti_new_codes(spark, d):
    rows = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate").join(read_table(spark, d, "lineitem").select("l_orderkey", "l_partkey"), "l_orderkey")
    edge = F.lit("1997-01-01").cast("timestamp_ntz")
    keys = ["o_custkey", "l_partkey"]
    return lookups.new_codes(rows.where(F.col("o_orderdate") >= edge).select(*keys).distinct(), rows.where(F.col("o_orderdate") < edge), keys)


@query("""
select coalesce(p_partkey, l_partkey) as p_partkey, p_brand, n from (select p_partkey, p_brand from part where p_size > 10)
full join (select l_partkey, count(*) as n from lineitem where l_quantity > 25 group by l_partkey) on p_partkey = l_partkey
""")
def full_outer_dim(spark, d):
    part = read_table(spark, d, "part").where("p_size > 10").select("p_partkey", "p_brand")
    used = read_table(spark, d, "lineitem").where("l_quantity > 25").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    return part.join(used.withColumnRenamed("l_partkey", "p_partkey"), "p_partkey", "full")


@query("""
select c_custkey, case c_mktsegment when 'BUILDING' then 'construction' when 'MACHINERY' then 'industry' else c_mktsegment end as segment,
       case when length(c_name) > 15 then c_name[1:4] || '..' || right(c_name, 5) else c_name end as label, regexp_replace(c_name, '[#0]', '-') as name
from customer
""")
def recode_and_labels(spark, d):
    return read_table(spark, d, "customer").select(
        "c_custkey", columns.recode(F.col("c_mktsegment"), {"BUILDING": "construction", "MACHINERY": "industry"}).alias("segment"),
        columns.short_label(F.col("c_name"), 15, 4, 5).alias("label"), columns.replace_first(F.col("c_name"), "[#0]", "-").alias("name"),
    )


@query("""
select o_orderkey, year(o_orderdate) as year, cast(row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) - 1 as int) as n_earlier,
       date_trunc('day', o_orderdate) + interval '23:59:59' hour to second as day_end, cast(date_diff('minute', o_orderdate, o_orderdate + interval 59 second) as bigint) as crossed
from orders
""".replace("interval '23:59:59' hour to second", "interval 23 hour + interval 59 minute + interval 59 second"))
def visit_history(spark, d):
    rows = lookups.earlier_visits(read_table(spark, d, "orders"), "o_custkey", "o_orderkey", "o_orderdate")
    later = F.col("o_orderdate") + F.expr("INTERVAL '59' SECOND")
    return rows.select(
        "o_orderkey", F.year("o_orderdate").alias("year"), "n_earlier", columns.end_of_day(F.col("o_orderdate")).alias("day_end"),
        columns.minute_boundaries(F.col("o_orderdate"), later).alias("crossed"),
    )


@query("""
select event_type, 'click' in (event_type) as is_click, count(*) as n, cast(sum(case when f is null then 1 else 0 end) as bigint) as n_missing, round(sum(coalesce(v * f, 0)), 3) as converted
from (select event_type, value as v, case event_type when 'click' then 2.5 when 'view' then 0.1 end as f from events) group by event_type
""")
def unit_conversion(spark, d):
    units = spark.createDataFrame([("click", "u", 2.5, "v"), ("view", "u", 0.1, "v")], "event_type string, unit string, factor double, preferred string")
    out = lookups.convert_units(events_of(spark, d).withColumn("unit", F.lit("u")), F.broadcast(units), "event_type", "unit", "value")
    return out.groupBy("event_type").agg(
        (F.first("event_type") == "click").alias("is_click"), F.count(F.lit(1)).alias("n"), F.sum((F.col("_convert_status") != "success").cast("int")).alias("n_missing"),
        F.round(F.sum(F.coalesce("value_converted", F.lit(0.0))), 3).alias("converted"),
    )


@query("select vec_id, cast(i as int) as pos, x from (select vec_id, unnest(range(0, 4)) as i, unnest(embedding[1:4]) as x from embeddings) where x > 0")
def ravel_arrays(spark, d):
    rows = read_table(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 4).alias("e"))
    return ravel(rows, ["vec_id"], {"x": "e"}).where("x > 0")


@query("select metric, round(avg(v), 6) as mean, count(*) as n from (unpivot (select l_orderkey, l_quantity, l_discount, l_tax from lineitem) on l_quantity, l_discount, l_tax into name metric value v) group by metric")
def unpivot_metrics(spark, d):
    long = read_table(spark, d, "lineitem").unpivot(["l_orderkey"], ["l_quantity", "l_discount", "l_tax"], "metric", "v")
    return long.groupBy("metric").agg(F.round(F.avg("v"), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


@query("select event_id, cast(ntile(7) over (partition by user_id order by ts, event_id) - 1 as int) as part from events")
def array_split_parts(spark, d):
    return lookups.split_evenly(events_of(spark, d), 7, ["ts", "event_id"], ["user_id"]).select("event_id", "part")


@query("""
select coalesce(a.event_id, b.event_id) as event_id, case when b.v <> 0 then b.v else coalesce(a.v, b.v) end as v
from (select event_id, round(value, 3) as v from events where event_id % 3 <> 0) a full join (select event_id, case when event_id % 4 = 0 then 0 else -round(value, 3) end as v from events where event_id % 2 = 0) b on a.event_id = b.event_id
""")
def shard_overlay(spark, d):
    events = events_of(spark, d)
    base = events.where("event_id % 3 <> 0").select("event_id", F.round("value", 3).alias("v"))
    shard = events.where("event_id % 2 = 0").select("event_id", F.when(F.col("event_id") % 4 == 0, 0.0).otherwise(-F.round("value", 3)).alias("v"))
    return lookups.overlay(base, shard, ["event_id"], "v")


# ---------------------------------------------------------------- evaluation


SCORED = "s as (select d.doc_id, quality as y, round(least(n_chars, 5000) / 5000.0::double, 4) as score, lang from labels l join documents d using (doc_id))"


def scored(spark, d):
    """Labels with a score made of the text length."""
    docs = read_table(spark, d, "documents").select("doc_id", "lang", F.round(F.least(F.col("n_chars"), F.lit(5000)) / F.lit(5000.0), 4).alias("score"))
    return read_table(spark, d, "labels").select("doc_id", F.col("quality").alias("y")).join(docs, "doc_id")


AUC = """r as (select {by} y, rank() over ({p} order by score) + (count(*) over ({p2} score) - 1) / 2.0 as rk from s),
a as (select {by} sum(case when y = 1 then rk end) as rs, sum(y) as p, sum(1 - y) as n from r {g})"""


@query("with " + SCORED + ", " + AUC.format(by="", p="", p2="partition by", g="") + " select round((rs - p * (p + 1) / 2) / (p * n), 6) as roc_auc from a")
def roc_auc(spark, d):
    return evaluation.roc_auc(scored(spark, d)).select(F.round("roc_auc", 6).alias("roc_auc"))


@query("with " + SCORED + ", " + AUC.format(by="lang,", p="partition by lang", p2="partition by lang,", g="group by lang") + " select lang, round(case when p * n > 0 then (rs - p * (p + 1) / 2) / (p * n) end, 6) as roc_auc from a")
def auc_by_group(spark, d):
    return evaluation.roc_auc(scored(spark, d), by=["lang"]).select("lang", F.round("roc_auc", 6).alias("roc_auc"))


@query(f"""
with {SCORED}, c as (select score, sum(y) as p, sum(1 - y) as n from s group by score),
k as (select score, sum(p) over w as tp, sum(n) over w as fp, sum(p) over () as pp from c window w as (order by score desc)),
q as (select score, tp / (tp + fp) as pr, tp / pp as re from k),
z as (select re - coalesce(lag(re) over w, 0) as dr, (pr + coalesce(lag(pr) over w, 1)) / 2 as h from q window w as (order by score desc))
select round(sum(dr * h), 6) as pr_auc from z
""")
def pr_auc(spark, d):
    return evaluation.pr_auc(scored(spark, d)).select(F.round("pr_auc", 6).alias("pr_auc"))


@query(f"""
with {SCORED}, c as (select score, sum(y) as p, sum(1 - y) as n from s group by score)
select score as threshold, round(sum(n) over (order by score desc) / sum(n) over (), 6) as fpr, round(sum(p) over (order by score desc) / sum(p) over (), 6) as tpr from c
""")
def roc_curve(spark, d):
    return evaluation.roc_curve(scored(spark, d)).select("threshold", F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


@query(f"with {SCORED} select round(avg(power(y - score, 2)), 6) as brier from s")
def brier(spark, d):
    return evaluation.brier(scored(spark, d)).select(F.round("brier", 6).alias("brier"))


@query(f"""
with {SCORED}, h as (select y, case when score > 0.5 then 1 else 0 end as z from s),
c as (select sum(y * z) as tp, sum((1 - y) * z) as fp, sum(y * (1 - z)) as fn, sum((1 - y) * (1 - z)) as tn from h)
select round((tp + tn) / (tp + fp + fn + tn), 6) as accuracy, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) as balanced_accuracy, round(tp / (tp + fp), 6) as precision, round(tp / (tp + fn), 6) as recall from c
""")
def threshold_metrics(spark, d):
    out = evaluation.threshold_metrics(scored(spark, d))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(f"""
with {SCORED} select cast(greatest(least(ceil(score * 10) - 1, 9), 0) as int) as bin, round(avg(score), 6) as mean_score, round(avg(y), 6) as share_positive, count(*) as n from s group by 1
""")
def calibration_bins(spark, d):
    return evaluation.calibration(scored(spark, d)).select("bin", F.round("mean_score", 6).alias("mean_score"), F.round("share_positive", 6).alias("share_positive"), "n")


@query("""
with e as (select min(value) as lo, (max(value) - min(value)) / 10 as w from events),
b as (select cast(least(floor((value - lo) / w), 9) as int) as bin, any_value(lo) as lo, any_value(w) as w, count(*) as n from events cross join e group by 1)
select bin, round(lo + bin * w, 6) as left_edge, n, round(n / (sum(n) over () * w), 6) as density from b
""")
def histogram_density(spark, d):
    return evaluation.histogram(events_of(spark, d), "value").select("bin", F.round("left_edge", 6).alias("left_edge"), "n", F.round("density", 6).alias("density"))


@query("select l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) as slope, round(regr_intercept(l_extendedprice, l_quantity), 3) as intercept, round(regr_r2(l_extendedprice, l_quantity), 6) as r2 from lineitem group by l_returnflag")
def ols_simple(spark, d):
    out = evaluation.ols(read_table(spark, d, "lineitem"), "l_extendedprice", "l_quantity", ["l_returnflag"])
    return out.select("l_returnflag", F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("r2", 6).alias("r2"))


@query("""
select a.k as a, b.k as b, round(corr(a.v, b.v), 6) as corr
from (unpivot (select row_number() over () as i, l_quantity, l_discount, l_tax from lineitem) on l_quantity, l_discount, l_tax into name k value v) a
join (unpivot (select row_number() over () as i, l_quantity, l_discount, l_tax from lineitem) on l_quantity, l_discount, l_tax into name k value v) b using (i) group by all
""")
def corr_matrix(spark, d):
    return evaluation.correlations(read_table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"]).select("a", "b", F.round("corr", 6).alias("corr"))


@query("select round(avg(1.0), 6) as share_finite, min(value) as min, round(avg(value), 6) as mean, max(value) as max, round(quantile_cont(value, 0.5), 6) as q50, round(quantile_cont(value, 0.99), 6) as q99 from events")
def value_summary(spark, d):
    out = evaluation.summary(events_of(spark, d), "value", [0.5, 0.99])
    return out.select("share_finite", "min", F.round("mean", 6).alias("mean"), "max", F.round(F.col("quantiles")[0], 6).alias("q50"), F.round(F.col("quantiles")[1], 6).alias("q99"))


@query()
def bootstrap_ci(spark, d):
    rows = timeline.global_index(scored(spark, d), "doc_id", ["doc_id"], "row")
    return evaluation.bootstrap_ci(rows, "row", rows.count(), replicates=50)


@query()
def bootstrap_pvalue(spark, d):
    rows = timeline.global_index(scored(spark, d), "doc_id", ["doc_id"], "row").withColumn("other", F.pmod(F.xxhash64("doc_id"), F.lit(1000)) / 1000.0)
    return evaluation.bootstrap_p(rows, "row", rows.count(), "score", "other", replicates=50)


@query()
def ols_multi(spark, d):
    model = evaluation.fit_linear(read_table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"])
    return spark.createDataFrame([(float(model.intercept), *map(float, model.coefficients), float(model.summary.r2))], "intercept double, quantity double, discount double, tax double, r2 double")


@query()
def logit_fit(spark, d):
    rows = read_table(spark, d, "lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("double"))
    model = evaluation.fit_logit(rows, "y", ["l_quantity", "l_discount"])
    return spark.createDataFrame([(float(model.intercept), *map(float, model.coefficients))], "intercept double, quantity double, discount double")


@query()
def representation_classifier(spark, d):
    rows = read_table(spark, d, "embeddings").withColumn("y", (F.col("label") % 2).cast("int"))
    model = evaluation.fit_classifier(rows, "y", "embedding")
    return model.transform(rows.select("vec_id", "y", "embedding").transform(_as_vector)).select("vec_id", "y", evaluation.probability(F.col("probability")).alias("score"))


def _as_vector(df: DataFrame) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.withColumn("__v", array_to_vector(F.col("embedding").cast("array<double>")))


# ---------------------------------------------------------------- attention


ATTENTION_SQL = """
e as (select label as sid, vec_id, embedding as x, row_number() over (partition by label order by vec_id) - 1 as i from embeddings qualify i < 8),
att as (select a.sid, h as layer, 0 as head, a.i as i, b.i as j, abs(a.x[h + 1]::double * b.x[h + 2]::double) as a from e a join e b using (sid) cross join (select unnest(range(0, 2)) as h) where b.i <= a.i)
"""


def attention_rows(spark, d):
    """Lower-triangular matrices made of products of vector entries: sid, layer, head, i, j, a."""
    w = Window.partitionBy("label").orderBy("vec_id")
    rows = read_table(spark, d, "embeddings").select(F.col("label").alias("sid"), F.col("embedding").cast("array<double>").alias("x"), (F.row_number().over(w) - 1).alias("i")).where("i < 8")
    other = rows.withColumnsRenamed({"x": "y", "i": "j"})
    pairs = rows.join(other, "sid").where("j <= i").withColumn("layer", F.explode(F.array(F.lit(0), F.lit(1))))
    return pairs.select("sid", "layer", F.lit(0).alias("head"), "i", "j", F.abs(F.col("x")[F.col("layer")] * F.col("y")[F.col("layer") + 1]).alias("a"))


@query(f"with {ATTENTION_SQL}, k as (select sid, layer, head, j, sum(a) as s from att where i - j < 4 group by all) select sid, cast(j as int) as j, round(avg(s), 6) as importance from k group by all")
def attention_importance(spark, d):
    return attention.importance(attention_rows(spark, d), window=4).select("sid", "j", F.round("importance", 6).alias("importance"))


def two_heads(rows: DataFrame) -> DataFrame:
    return rows.unionByName(rows.withColumn("head", F.lit(1)).withColumn("a", F.col("a") * F.col("a")))


ROLLOUT_SQL = f"""
{ATTENTION_SQL}, heads as (select * from att union all select sid, layer, 1, i, j, a * a from att), n as (select sid, max(i) + 1 as n from att group by sid),
m as (select g.sid, layer, head, g.i, g.j, (coalesce(a, 0) + (g.i = g.j)::int) / 2 as v
      from (select sid, layer, head, i, j from n, unnest(range(0, 2)) as l(layer), unnest(range(0, 2)) as h(head), unnest(range(0, n)) as x(i), unnest(range(0, n)) as y(j)) g
      left join heads using (sid, layer, head, i, j)),
r as (select late.sid, late.head, late.i, early.j, sum(late.v * early.v) as r from m late join m early
      on late.sid = early.sid and late.head = early.head and late.j = early.i and late.layer = 1 and early.layer = 0 group by all)
"""


@query(f"with {ROLLOUT_SQL} select sid, cast(head as int) as head, i, j, round(r, 6) as r from r")
def attention_rollout(spark, d):
    return attention.rollout(two_heads(attention_rows(spark, d))).withColumn("r", F.round("r", 6))


@query(f"with {ROLLOUT_SQL}, k as (select sid, head, j, sum(r) as s from r group by all) select sid, j, round(avg(s), 6) as importance from k group by all")
def attention_rollout_mean(spark, d):
    return attention.metric(two_heads(attention_rows(spark, d)), "rollout-mean").withColumn("importance", F.round("importance", 6))


@query(f"with {ATTENTION_SQL}, k as (select sid, layer, head, j, sum(a * (i + 1)) as s from att where i - j < 10 group by all) select sid, cast(j as int) as j, round(avg(s), 6) as importance from k group by all")
def attention_window_value_aware(spark, d):
    rows = attention_rows(spark, d).withColumn("v_norm", (F.col("i") + 1).cast("double"))
    return attention.metric(rows, "scissorhands-va-10").select("sid", "j", F.round("importance", 6).alias("importance"))


@query(f"with {ATTENTION_SQL}, k as (select sid, layer, head, j, sum(abs(a) * (i + 2)) as s from att group by all) select sid, cast(j as int) as j, round(avg(s), 6) as importance from k group by all")
def attention_normed(spark, d):
    rows = attention_rows(spark, d).withColumn("f_norm", (F.col("i") + 2).cast("double"))
    return attention.metric(rows, "h2o-normed-mean").select("sid", "j", F.round("importance", 6).alias("importance"))


@query("""
with l as (select event_id, case when user_id % 3 = 0 then null else user_id end as user_id, ts from events where event_type = 'error'),
r as (select case when user_id % 3 = 0 then null else user_id end as user_id, ts, event_id from events where event_type = 'purchase')
select l.event_id, r.ts as p_ts, r.event_id as p_event from l asof left join r on l.user_id = r.user_id and l.ts >= r.ts
""")
def asof_null_keys(spark, d):
    left, right = (x.withColumn("user_id", F.when(F.col("user_id") % 3 != 0, F.col("user_id"))) for x in _kinds(spark, d))
    return joins.asof_join(left, right, "user_id", "ts", "p_ts", ["p_event"]).select("event_id", "p_ts", "p_event")


@query(f"with {ATTENTION_SQL}, k as (select sid, head, j, sum(a) as s from att where layer = 1 group by all) select sid, cast(j as int) as j, round(avg(s), 6) as importance from k group by all")
def attention_last_layer(spark, d):
    return attention.metric(attention_rows(spark, d), "h2o-last-mean").select("sid", "j", F.round("importance", 6).alias("importance"))


@query(f"with {ATTENTION_SQL}, k as (select sid, layer, head, j, sum(a * (i + 1)) as s from att group by all) select sid, cast(j as int) as j, round(avg(s), 6) as importance from k group by all")
def attention_value_aware(spark, d):
    rows = attention_rows(spark, d).withColumn("v_norm", (F.col("i") + 1).cast("double"))
    return attention.metric(rows, "h2o-va-mean").select("sid", "j", F.round("importance", 6).alias("importance"))


@query("""
with l as (select label as sid, arg_max(embedding, vec_id) filter (where vec_id % 5 <> 0) as x from embeddings group by label)
select sid, cast(unnest(range(0, 4)) as int) as i, unnest(x[1:4])::double as x from l where x is not null
""")
def final_hidden_states(spark, d):
    rows = vectors(spark, d).withColumn("token", F.when(F.col("pos") % 5 == 0, FIXED.index("PAD")).otherwise(30))
    last = information.final_states(rows, "x", "token", FIXED.index("PAD"))
    return ravel(last.withColumn("x", F.slice("x", 1, 4)), ["sid"], {"x": "x"}, "i")


@query("""
with v as (select label as sid, vec_id as pos, embedding::double[] as x, lag(embedding::double[]) over (partition by label order by vec_id) as b0 from embeddings),
w as (select sid, pos, x, coalesce(b0, list_transform(x, lambda e : 0.0::double)) as b from v),
s as (select sid, pos, list_transform(range(1, len(x) + 1), lambda i : x[i] - b[i]) as st, list_transform(b, lambda e : 1 - e) as lf, len(x) as n from w)
select sid, pos, round(list_sum(st) / sqrt(n), 5) as proj_abs, round(list_sum(list_transform(range(1, n + 1), lambda i : st[i] * lf[i])) / sqrt(list_sum(list_transform(lf, lambda e : e * e))), 5) as proj_rel from s
""")
def prototype_projections(spark, d):
    ones = F.transform("x", lambda e: e * 0 + 1)
    out = information.prototype_projection(vectors(spark, d), "x", ones)
    return out.select("sid", "pos", F.round("proj_abs", 5).alias("proj_abs"), F.round("proj_rel", 5).alias("proj_rel"))


@query("""
select vec_id, round(-(x[label + 1] - ln(list_sum(list_transform(x, lambda e : exp(e))))) / ln(2), 5) as bits
from (select vec_id, label % 4 as label, embedding::double[] as x from embeddings)
""")
def softmax_information(spark, d):
    x = F.col("embedding").cast("array<double>")
    rows = read_table(spark, d, "embeddings").select("vec_id", columns.bits(arrays.log_softmax_at(x, F.col("label") % 4)).alias("bits"))
    return rows.select("vec_id", F.round("bits", 5).alias("bits"))


@query("""
with c as (select l_returnflag as g, l_quantity as v, count(*) as n from lineitem group by all)
select l_returnflag, round(avg(ln(l_quantity)), 6) as mean_log, round(median(ln(l_quantity)), 6) as median_log,
       (select v from c where g = l_returnflag order by n desc, v limit 1) as mode from lineitem group by l_returnflag
""")
def log_reducers(spark, d):
    out = lookups.log_means(read_table(spark, d, "lineitem"), "l_returnflag", "l_quantity")
    return out.select("l_returnflag", F.round("mean_log", 6).alias("mean_log"), F.round("median_log", 6).alias("median_log"), "mode")


@query("""
select a.event_type, b.weekday, count(e.event_id) as n from (select distinct event_type from events) a cross join (select distinct dayofweek(ts) as weekday from events where value > 60) b
left join (select * from events where value > 60) e on e.event_type = a.event_type and dayofweek(e.ts) = b.weekday where a.event_type in (select event_type from events where value > 60) group by all
""")
def label_grid(spark, d):
    rows = events_of(spark, d).where("value > 60").select("event_type", (F.dayofweek("ts") - 1).cast("long").alias("weekday"))
    return lookups.label_grid(rows, "event_type", "weekday")


@query(f"""
with {PLAIN}, {LISTS}, p as (select user_id, ws[1:60] as w60 from t)
select cast(user_id as varchar) as sid, array_to_string(list_transform(range(60 - len(w60)), lambda x : 'PAD') || w60, ' ') as words from p
""")
def left_padding(spark, d):
    lists = timeline.collect_timelines(event_tokens(spark, d, spaced=False))
    right = arrays.pad_right(F.slice("words", 1, 60), 60, F.lit("PAD"))
    return lists.select("sid", F.array_join(arrays.pad_to_left(right, F.lit("PAD")), " ").alias("words"))


@query("""
select count(*) filter (where user_id in (select user_id from events where event_type = 'signup')) as n_semi, count(*) filter (where greatest(value, 50) > 60 or event_type is null) as n_reduced,
       count(distinct user_id) as n_users, count(*) filter (where event_type like 'p%') as n_prefix, count(*) filter (where value between 10 and 20) as n_between from events
""")
def predicate_counts(spark, d):
    events = events_of(spark, d)
    signed = events.where("event_type = 'signup'").select("user_id").distinct().withColumn("signed", F.lit(True))
    return events.join(signed, "user_id", "left").agg(
        F.count_if("signed").alias("n_semi"), F.count_if((F.greatest("value", F.lit(50.0)) > 60) | F.col("event_type").isNull()).alias("n_reduced"),
        F.countDistinct("user_id").alias("n_users"), F.count_if(F.col("event_type").startswith("p")).alias("n_prefix"), F.count_if(F.col("value").between(10, 20)).alias("n_between"),
    )


# ---------------------------------------------------------------- cohorts, predictions, completions


@query("""
select cast(o_orderkey as varchar) as o_orderkey, cast(o_custkey as varchar) as o_custkey, epoch_ms(o_orderdate) as start_ms from orders
where o_custkey % 90 >= 18 and o_orderdate between timestamp '1994-01-01' and timestamp '1996-12-31'
""")
def eligible_window(spark, d):
    orders = read_table(spark, d, "orders").withColumn("age", F.col("o_custkey") % 90)
    out = cohort.eligible(orders, age="age", start="o_orderdate", ids=["o_orderkey", "o_custkey"], window=("1994-01-01", "1996-12-31"))
    return out.select("o_orderkey", "o_custkey", F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("start_ms"))


@query("""
with f as (select user_id as sid, bool_or(event_type = 'purchase') as a, bool_or(event_type = 'purchase' and ts < timestamp '2024-01-08') as a_24h, bool_or(event_type = 'error') as b, avg(value) as s from events group by user_id),
l as (select sid, 'a' as outcome, not a_24h as qualifies, a as label, s from f union all select sid, 'b', true, b, s from f)
select sid, outcome, qualifies, label, case when qualifies then round(s, 6) end as score from l
""")
def predictions_long(spark, d):
    is_ = lambda k: F.col("event_type") == k
    early = is_("purchase") & (F.col("ts") < F.lit("2024-01-08").cast("timestamp_ntz"))
    flags = events_of(spark, d).groupBy(F.col("user_id").alias("sid")).agg(
        F.bool_or(is_("purchase")).alias("a"), F.bool_or(early).alias("a_24h"), F.bool_or(is_("error")).alias("b"), F.round(F.avg("value"), 6).alias("s")
    )
    scores = flags.select("sid", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("outcome"), F.col("s").alias("score"))
    return cohort.predictions(cohort.qualified(flags, ["a", "b"], always=("b",)), scores)


@query("""
with q as (select quantile_cont(value, 0.95) as lo, quantile_cont(value, 0.99) as hi from events)
select user_id, count(*) filter (where value >= hi) as n_top, count(*) filter (where value >= lo and value < hi) as n_band from events, q group by user_id
""")
def band_counts(spark, d):
    return cohort.band_counts(events_of(spark, d), "user_id", "value")


@query("""
select event_id, user_id from (select event_id, user_id, row_number() over (order by event_id) as r, count(*) over () as n from events) where r <= floor(n * 0.1)
""")
def first_tenth(spark, d):
    return cohort.first_share(events_of(spark, d).select("event_id", "user_id"), 0.1, "event_id")


@query("""
with c as (select user_id as sid, date_trunc('day', ts) as day, list(event_type) as t from events group by all),
v as (select sid, count(*) as n, count(*) filter (where list_contains(t, 'purchase')) as n_ended, round(avg(list_contains(t, 'error')::int), 6) as vote,
      round(avg(list_contains(t, 'error')::int) filter (where list_contains(t, 'purchase')), 6) as vote_ended from c group by sid) select * from v
""")
def completion_votes(spark, d):
    out = cohort.completion_votes(_daily_lists(spark, d), "t", "purchase", "error")
    return out.select("sid", "n", "n_ended", F.round("vote", 6).alias("vote"), F.round("vote_ended", 6).alias("vote_ended"))


def _daily_lists(spark, d):
    return events_of(spark, d).groupBy(F.col("user_id").alias("sid"), F.date_trunc("DAY", "ts").alias("day")).agg(F.collect_list("event_type").alias("t"))


@query("""
with c as (select user_id as sid, date_trunc('day', ts) as day, list(event_type) as t from events group by all),
v as (select sid, bool_and(list_contains(t, 'purchase')) as every from c group by sid)
select round(avg(list_contains(t, 'purchase')::int), 6) as share_ended, sum(len(t))::bigint as n_tokens, round(avg(len(t)), 6) as mean_length, round(stddev_pop(len(t)), 6) as std_length,
       (select round(avg(every::int), 6) from v) as share_all_ended from c
""")
def completion_summary(spark, d):
    out = cohort.completion_summary(_daily_lists(spark, d), "t", "purchase", "error")
    r = lambda c: F.round(c, 6).alias(c)
    return out.select(r("share_ended"), "n_tokens", r("mean_length"), r("std_length"), r("share_all_ended"))


@query("""
with c as (select user_id as sid, date_trunc('day', ts) as day, list(event_type) as t from events group by all)
select count(*) as n_timelines, sum(len(t))::bigint as n_tokens, round(avg(len(t)), 6) as mean_length from c
""")
def token_totals(spark, d):
    return cohort.token_totals(_daily_lists(spark, d), "t").withColumn("mean_length", F.round("mean_length", 6))


@query("""
with i as (select o_custkey, o_orderstatus, count(*) as n from orders group by all) select o_orderstatus, sum(n)::bigint as total, count(*) as n_groups from i group by o_orderstatus
""")
def reaggregated_counts(spark, d):
    return cohort.reaggregate(read_table(spark, d, "orders").withColumn("one", F.lit(1)), ["o_custkey", "o_orderstatus"], ["o_orderstatus"], "one")


@query("""
select user_id, max(ts)::varchar[1:19] as last_ts, max_by(event_id, {'t': ts, 'e': event_id}) as event_id from events group by user_id
""".replace("max(ts)::varchar[1:19]", "strftime(max(ts), '%Y-%m-%d %H:%M:%S')"))
def latest_event(spark, d):
    return cohort.latest(events_of(spark, d), "user_id", "ts", ["event_id"]).select("user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("last_ts"), "event_id")


@query("""
select 'high' as split, event_type, count(*) as n from events where value > 60 group by all union all select 'low', event_type, count(*) from events where value <= 60 group by all
""")
def provenance_union(spark, d):
    events = events_of(spark, d)
    return cohort.with_provenance({"high": events.where("value > 60"), "low": events.where("value <= 60")}).groupBy("split", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("""
select distinct o_custkey as user_id from orders where o_custkey is not null union select user_id from events
""")
def key_union(spark, d):
    orders = read_table(spark, d, "orders").where("o_custkey is not null").select(F.col("o_custkey").alias("user_id"))
    return cohort.all_keys([orders, events_of(spark, d)], "user_id")


@query("""
select o_orderkey, split_part(o_orderpriority, '-', 1) as level, nullif(split_part(o_orderpriority, '-', 3), '') as third, substr(o_orderpriority, 1, 1) as c0,
       strftime(strptime(strftime(o_orderdate, '%d/%m/%Y'), '%d/%m/%Y'), '%Y-%m-%d') as parsed, (epoch_us(o_orderdate) - epoch_us(timestamp '1990-01-01'))::double as since, round_even(o_totalprice, 0) as price from orders
""")
def parsed_fields(spark, d):
    text, p = F.date_format("o_orderdate", "dd/MM/yyyy"), F.col("o_orderpriority")
    return read_table(spark, d, "orders").select(
        "o_orderkey", columns.split_at(p, "-", 0).alias("level"), columns.split_at(p, "-", 2).alias("third"), columns.piece(p, 0, 1).alias("c0"),
        F.date_format(columns.parsed_time(text, "dd/MM/yyyy"), "yyyy-MM-dd").alias("parsed"),
        columns.micros_between(F.lit("1990-01-01").cast("timestamp_ntz"), F.col("o_orderdate")).alias("since"), F.bround("o_totalprice", 0).alias("price"),
    )


@query("""
with r as (select (label % 2 = 0)::int as y, embedding[2]::double - embedding[1]::double as s from embeddings),
c as (select count(*) filter (where s > 0 and y = 1)::double as tp, count(*) filter (where s > 0 and y = 0)::double as fp, count(*) filter (where s <= 0 and y = 1)::double as fn, count(*) as n, sum(y)::double as p from r),
m as (select sum(k) filter (where y = 1) as ranks from (select y, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2.0 as k from r))
select round((n - fp - fn) / n, 6) as accuracy, round(tp / (tp + fp), 6) as precision, round(tp / (tp + fn), 6) as recall, round(2 * tp / (2 * tp + fp + fn), 6) as f1,
       round((ranks - p * (p + 1) / 2) / (p * (n - p)), 6) as roc_auc from c, m
""")
def sequence_classification(spark, d):
    rows = read_table(spark, d, "embeddings").select(F.slice("embedding", 1, 2).alias("logits"), (F.col("label") % 2 == 0).cast("int").alias("y"))
    out = evaluation.classification_metrics(rows, "logits")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])
