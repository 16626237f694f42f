"""Worked examples and edge cases of the timeline engine."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from timeloom.functions import arrays, columns
from timeloom.operators import attention, evaluation, information, islands, joins, lookups, outcomes, quantize, split, timeline, vocab
from timeloom.sources import tables
from timeloom.sources.config import TimelineConfig

FIXED = vocab.fixed_words()
T0 = datetime(2024, 1, 1)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def test_fixed_layout():
    assert [FIXED.index(w) for w in ("Q9", "TL_START", "TL_END", "PAD", "TRUNC", "None", "nan", "ELLIPSIS")] == [9, 10, 11, 12, 13, 14, 15, 16]
    assert len(FIXED) == 30 and vocab.fixed_words(fused=True).index("TL_START") == 0


def test_spacers(spark):
    minutes = [0, 0, 7, 7, 7, 90, 90]
    rows = [("a", at(m), 0, 0, i, f"Q{i}", i, 0) for i, m in enumerate(minutes)]
    df = spark.createDataFrame(rows, "sid string, ts timestamp_ntz, ord int, key long, pos int, word string, token long, first_token long")
    got = timeline.collect_timelines(timeline.with_spacers(df, FIXED)).first()
    assert got["words"] == ["Q0", "Q1", "T_5m-15m", "Q2", "Q3", "Q4", "T_1h-2h", "Q5", "Q6"]
    assert [got["times"][i] for i in (2, 6)] == [at(7), at(90)]


def test_digitize(spark):
    one = spark.range(1)
    nine = F.array(*[F.lit(1.0)] * 9)
    assert one.select(arrays.digitize(F.lit(1.0), nine)).first()[0] == 9
    v = spark.createDataFrame([("g", float(x)) for x in (1, 1, 1, 2, 2, 2, 2)], "designator string, value double")
    binned = quantize.apply_breaks(v, quantize.learn_breaks(v))
    assert sorted({(r["value"], r["bin"]) for r in binned.collect()}) == [(1.0, 3), (2.0, 9)]


def test_breaks_skip_what_is_not_finite(spark):
    v = spark.createDataFrame([("g", x) for x in (1.0, 2.0, 3.0, float("nan"), float("inf"), None)], "designator string, value double")
    edges = quantize.learn_breaks(v).first()["breaks"]
    assert np.allclose(edges, np.quantile([1, 2, 3], np.arange(1, 10) / 10))
    assert quantize.apply_breaks(v, quantize.learn_breaks(v)).where("bin is null").count() == 3


def test_first_ordinal_sets_breaks(spark):
    v = spark.createDataFrame([("g", 1.0, 0), ("g", 2.0, 0), ("g", 99.0, 1)], "designator string, value double, ord int")
    assert max(quantize.learn_breaks(v, ordinal="ord").first()["breaks"]) <= 2.0


def test_token_types(spark):
    words = ["Q3", None, "T_1h-2h", "LAB_x", "PAD"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r[0] for r in df.select(columns.token_type(F.col("w"), vocab.SPECIALS)).collect()] == ["QUANT", "SPECIAL", "T_SPACER", "LAB", "SPECIAL"]


def test_top_quantile_counts(spark):
    lists = [[2, 2, 2, 9], [0, 1], [], [3, 9, 9]]
    rows = [(i, float(x)) for i, xs in enumerate(lists) for x in xs] + [(2, None)]
    got = information.top_quantile_counts(spark.createDataFrame(rows, "k int, v double"), "k", "v", 0.8)
    assert [r["n_top"] for r in got.orderBy("k").collect()] == [1, 0, 0, 2]


def test_event_information(spark):
    info, times = [0, 0, 0, 3, 0, 0, 2, 2, 2, 1], [0, 0, 0, 1, 1, 1, 2, 2, 2, 3]
    df = spark.createDataFrame([("a", i, t, float(x)) for i, (x, t) in enumerate(zip(info, times))], "sid string, pos int, ts int, value double")
    got = information.event_information(df).orderBy("pos").collect()
    assert [r["event_value"] for r in got] == [0, 0, 0, 3, 3, 3, 6, 6, 6, 1]
    kept = information.redact(df, "value", k=1, how="sum").orderBy("pos").collect()
    assert [r["pos"] for r in kept] == [0, 1, 2, 3, 4, 5, 9]
    with pytest.raises(ValueError):
        information.redact(df, "value", k=1, pct=0.5)
    with pytest.raises(ValueError):
        information.event_information(df, how="perplexity")


def test_cut_ellipsis_pad(spark):
    df = spark.createDataFrame([("a", ["x", "y", "z"], [1, 2, 3], [at(0), at(60), at(3000)]), ("b", ["x"], [1], [at(0)])], "sid string, words array<string>, tokens array<long>, times array<timestamp_ntz>")
    cut = {r["sid"]: r for r in timeline.cut_at(df, 86400).collect()}
    assert cut["a"]["words"] == ["x", "y"] and cut["b"]["words"] == ["x"]
    ell = {r["sid"]: r for r in timeline.ellipsis(df, 1, 16).collect()}
    assert ell["a"]["tokens"] == [1, 2, 16] and ell["a"]["times"][-1] == at(3000) and ell["b"]["tokens"] == [1]
    padded = {r["sid"]: r["padded"] for r in timeline.pad(df, 2, FIXED).collect()}
    assert padded == {"a": [1, 13], "b": [1, 12]}
    assert [r["sid"] for r in timeline.day_stays(df).collect()] == ["a"]


def test_packing_keeps_order_and_drops_the_rest(spark):
    df = spark.range(10_000).select(F.col("id").alias("k"), F.col("id").alias("token"))
    got = timeline.pack_tokens(df, 1024, ["k"], "k").orderBy("chunk", "pos").collect()
    assert [r["token"] for r in got] == list(range(9 * 1024))


def test_validated_join(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string")
    right = spark.createDataFrame([(1, "r"), (1, "s")], "k int, x string")
    with pytest.raises(ValueError):
        joins.validated_join(left, right, "k")
    assert joins.validated_join(left, right.limit(1), "k").columns == ["k", "x", "x_right"]


def test_asof_ties_and_nulls(spark):
    left = spark.createDataFrame([("u", 1, at(5)), ("u", 2, at(0)), (None, 3, at(5))], "u string, id int, ts timestamp_ntz")
    right = spark.createDataFrame([("u", at(5), "b"), ("u", at(3), "a")], "u string, t timestamp_ntz, v string")
    back = {r["id"]: r["v"] for r in joins.asof_join(left, right, "u", "ts", "t", ["v"]).collect()}
    ahead = {r["id"]: r["v"] for r in joins.asof_join(left, right, "u", "ts", "t", ["v"], backward=False).collect()}
    assert back == {1: "b", 2: None, 3: None} and ahead == {1: "b", 2: "a", 3: None}


def test_split_shares(spark):
    ref = spark.createDataFrame([(i, at(i % 7)) for i in range(100)], "g int, t timestamp_ntz")
    sizes = {r["split"]: r["count"] for r in split.group_split(ref, "g", "t").groupBy("split").count().collect()}
    assert sizes == {"train": 70, "val": 10, "test": 20}
    parts = split.group_split(ref, "g", "t")
    split.assert_disjoint({s: parts.where(F.col("split") == s) for s in sizes}, "g")
    assert split.dev_sample(ref, "g", "t", 0.05).count() == 5


def test_scalar_functions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert get(columns.normalise_code(F.lit(".Blood Gas."))) == "blood_gas"
    assert get(columns.static_word(F.lit(None).cast("string"), "SEX")) == "SEX_None"
    assert get(columns.short_label(F.lit("a" * 30))) == "a" * 13 + ".." + "a" * 7
    assert get(columns.replace_first(F.lit("a/b-c"), "[-/]", "_")) == "a_b-c"
    assert get(columns.minute_boundaries(F.lit(datetime(2024, 1, 1, 0, 0, 59)), F.lit(datetime(2024, 1, 1, 0, 1, 1)))) == 1
    assert get(arrays.pad_to_left(F.array(*map(F.lit, (1, 2, 9, 9))), F.lit(9))) == [9, 9, 1, 2]
    assert get(columns.recode(F.lit("x"), {"x": "y"})) == "y"
    with pytest.raises(Exception, match="no code"):
        get(columns.recode(F.lit("q"), {"x": "y"}, strict=True))
    masked = get(arrays.until_stop(F.array(*map(F.lit, (1, 2, 12, 3))), F.array(*map(F.lit, (1.0, 2.0, 3.0, 4.0))), [12]))
    assert masked[:3] == [1, 2, 3] and np.isnan(masked[3])
    p = get(arrays.log_softmax_at(F.array(*map(F.lit, (1.0, 2.0, 3.0))), F.lit(2)))
    assert abs(p - (3 - np.log(np.exp([1, 2, 3]).sum()))) < 1e-12


def test_attention(spark):
    rng = np.random.default_rng(0)
    a, v = rng.random((2, 3, 5, 5)), rng.random((2, 3, 5, 4))
    rows = [("s", layer, h, i, j, float(a[layer, h, i, j]), float(np.abs(v[layer, h, i]).sum())) for layer, h, i, j in np.ndindex(a.shape)]
    df = spark.createDataFrame(rows, "sid string, layer int, head int, i int, j int, a double, v_norm double")
    got = [r["importance"] for r in attention.importance(df.drop("v_norm"), window=2).orderBy("j").collect()]
    assert np.allclose(got, attention.importance_of(a, window=2))
    got = [r["importance"] for r in attention.importance(df, how="median").orderBy("j").collect()]
    assert np.allclose(got, attention.importance_of(a, values=v, how="median"))
    roll = attention.rollout(df).toPandas().sort_values(["head", "i", "j"])["r"].to_numpy().reshape(3, 5, 5)
    want = np.stack([(a[1, h] + np.eye(5)) @ (a[0, h] + np.eye(5)) / 4 for h in range(3)])  # heads are rolled out apart
    assert np.allclose(roll, want) and np.allclose(attention.rollout_of(a), want)
    got = [r["importance"] for r in attention.metric(df, "rollout-mean_log").orderBy("j").collect()]
    assert np.allclose(got, np.log(want.sum(axis=1)).mean(axis=0))
    got = [r["importance"] for r in attention.metric(df.withColumn("f_norm", F.lit(2.0)), "h2o-normed-mean").orderBy("j").collect()]
    assert np.allclose(got, attention.importance_of(2 * a))
    stops = spark.createDataFrame([("s", 2)], "sid string, first_stop int")
    masked = attention.until_stop(attention.metric(df, "h2o-mean"), stops).orderBy("j").collect()
    assert [r["importance"] is None for r in masked] == [False, False, False, True, True]


def test_mc_and_projection(spark):
    df = spark.createDataFrame([("s", 0, 0.5, False), ("s", 0, 0.5, True), ("s", 1, 1.0, False)], "sid string, sample int, p double, hit boolean")
    r = information.mc_estimates(df).first()
    assert (r["m0"], r["m1"], r["m2"]) == (0.5, 1.0, 0.875)
    x = spark.createDataFrame([("s", 0, [1.0, 0.0]), ("s", 1, [1.0, 1.0])], "sid string, pos int, x array<double>")
    got = information.prototype_projection(x, "x", F.array(F.lit(0.0), F.lit(2.0))).orderBy("pos").collect()
    assert [round(r["proj_abs"], 6) for r in got] == [0.0, 1.0] and round(got[1]["proj_rel"], 6) == round(2 / 5**0.5, 6)


def test_scores(spark):
    rng = np.random.default_rng(1)
    y, s = rng.integers(0, 2, 200), np.round(rng.random(200), 1)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, score double")
    pairs = [(p > n) + 0.5 * (p == n) for p in s[y == 1] for n in s[y == 0]]
    assert abs(evaluation.roc_auc(df).first()[0] - np.mean(pairs)) < 1e-12
    assert evaluation.roc_auc(df.where("y = 1")).first()[0] is None
    numbered = timeline.global_index(df.withColumn("k", F.monotonically_increasing_id()), "k", ["k"], "row")
    ci = evaluation.bootstrap_ci(numbered, "row", 200, replicates=40).first()
    assert ci["lo"] <= np.mean(pairs) <= ci["hi"]


def test_streaks(spark):
    df = spark.createDataFrame([("u", at(i), s) for i, s in enumerate(["a", "a", None, None, "b"])], "u string, t timestamp_ntz, s string")
    got = islands.streaks(df, "u", "t", F.col("s")).orderBy("streak").collect()
    # a null behind a value is a change; the first row is one unless it is null
    assert [(r["state"], r["n_rows"], r["minutes"]) for r in got] == [("a", 2, 2), (None, 2, 2), ("b", 1, 0)]


def test_outcomes(spark):
    df = spark.createDataFrame([("a", ["X_1"], [at(0), at(10_200)])], "sid string, words array<string>, times array<timestamp_ntz>")
    r = outcomes.flags(outcomes.stay_lengths(df), {"x": "X_1", "other": "never"}).first()
    assert (r["length_of_stay"], r["long_length_of_stay"], r["x"], r["other"]) == (170, True, True, False)


def test_config_and_tokenizer(spark, tmp_path):
    raw = {
        "subject_id": "hid", "group_id": "pid", "options": {"quantizer": "deciles", "max_padded_len": 16},
        "reference": {"table": "hosp", "start_time": "start", "end_time": "end", "age": "age", "augmentation_tables": [{"table": "patient", "key": "pid", "validation": "m:1"}]},
        "prefix": [{"column": "sex", "prefix": "SEX"}], "suffix": [{"column": "dx", "prefix": "DX", "is_list": True}],
        "events": [
            {"table": "labs", "prefix": "LAB", "code": "lab", "numeric_value": "v", "time": "t"},
            {"table": "labs", "prefix": "ORD", "code": ["lab"], "filter_expr": "v > 5", "time": "t"},
        ],
    }
    frames = {
        "hosp": spark.createDataFrame([("h1", "p1", at(0), at(2000), 50.0, ["I10"]), ("h2", "p2", at(0), at(5), 60.0, None)], "hid string, pid string, start timestamp_ntz, end timestamp_ntz, age double, dx array<string>"),
        "patient": spark.createDataFrame([("p1", "F"), ("p2", None)], "pid string, sex string"),
        "labs": spark.createDataFrame([("h1", "Na .", 1.0, at(1)), ("h1", "Na .", 9.0, at(700)), ("h1", "k", None, at(3)), ("h1", "k", 1.0, None)], "hid string, lab string, v double, t timestamp_ntz"),
    }
    config = TimelineConfig.from_dict(raw)
    tok = timeline.TimelineTokenizer(config, spark, "", frames)
    model = tok.fit()
    out = {r["sid"]: r for r in tok.transform(model).collect()}
    assert out["h1"]["words"] == ["TL_START", "SEX_F", "LAB_na_", "Q0", "T_6h-12h", "LAB_na_", "Q9", "ORD_na_", "DX_I10", "TL_END"]
    assert out["h2"]["words"] == ["TL_START", "SEX_None", "TL_END"]
    assert out["h1"]["times"][0] == at(0) and out["h1"]["times"][-1] == at(2000)
    assert len(out["h1"]["padded"]) == 16 and out["h1"]["seq_len"] == 10
    model.save(f"file://{tmp_path}/model")
    again = vocab.Vocabulary.load(spark, f"file://{tmp_path}/model", tok.fixed)
    assert [r["tokens"] for r in tok.transform(again).orderBy("sid").collect()] == [out["h1"]["tokens"], out["h2"]["tokens"]]
    with pytest.raises(ValueError):
        TimelineConfig.from_dict(raw, include_ref_ranges=True)
    with pytest.raises(ValueError):
        vocab.Vocabulary.load(spark, f"file://{tmp_path}/model", ["other", *FIXED[1:]])


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x|y\n1|2\n")
    df = tables.read_csv(spark, f"file://{tmp_path}/a.csv", sep="|")
    assert df.dtypes == [("x", "string"), ("y", "string")]
    tables.write_parquet(df.withColumn("split", F.lit("train")), f"file://{tmp_path}/out", partition_by="split", compression="gzip")
    assert tables.read_parquet(spark, f"file://{tmp_path}/out").count() == 1
    tables.register_views({"named": df})
    assert spark.sql("select x + 1 as z from named").first()["z"] == 2
    assert tables.first_column(df, "w", "y") == "y"
    with pytest.raises(ValueError):
        tables.first_column(df, "w")


def test_streaming(spark, tmp_path):
    from timeloom.streaming.encode import token_stream, windowed_counts

    df = spark.createDataFrame([(1, at(0), "Click", 5.0), (1, at(1), "new", 5.0)], "u long, ts timestamp_ntz, code string, v double")
    df.write.parquet(f"file://{tmp_path}/in")
    words = vocab.train(spark.createDataFrame([("E_click",)], "word string"), FIXED)
    aux = spark.createDataFrame([("E_click", [1.0, 9.0])], "designator string, breaks array<double>")
    model = vocab.Vocabulary(words, aux, FIXED)
    stream = spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/in")
    for name, out in (("toks", token_stream(stream, model, subject="u", ts="ts", code="code", value="v", prefix="E")), ("wins", windowed_counts(stream, ts="ts", code="code"))):
        q = out.writeStream.format("memory").queryName(name).outputMode("append" if name == "toks" else "complete").start()
        q.processAllAvailable()
        q.stop()
    got = {r["word"]: (r["token"], r["bin"]) for r in spark.table("toks").collect()}
    assert got == {"E_click": (len(FIXED), 1), "E_new": (FIXED.index("None"), None)}
    assert spark.table("wins").count() == 2


def test_lookups(spark):
    df = spark.createDataFrame([("u", 1, None), ("u", 2, "x"), ("u", 3, "y")], "u string, t int, v string")
    assert lookups.first_non_null(df, "u", ["v"], ["t"]).first()["v"] == "x"
    ep = lookups.shuffled_epochs(df, 2, ["t"])
    assert ep.count() == 6 and ep.select("epoch").distinct().count() == 2
    assert lookups.sample_keys(df, "u", 1.0).count() == 3 and lookups.sample_keys(df, "u", 0.0).count() == 0


def tiny_tokenizer(spark, tmp_path, **options):
    from timeloom.operators.timeline import TimelineTokenizer
    from timeloom.sources.config import TimelineConfig

    stays = [(i, at(0), at(100000), float(20 + i), "f") for i in range(40)]
    spark.createDataFrame(stays, "stay long, t0 timestamp_ntz, t1 timestamp_ntz, years double, sex string").write.parquet(f"{tmp_path}/stays.parquet")
    labs = [(i % 40, at(60 * (i // 40)), "Na", float(i), 10.0 if i % 5 else 11.0, 50.0) for i in range(200)]
    labs += [(0, at(600), "Na", 199.0, None, None)] * 2
    spark.createDataFrame(labs, "stay long, t timestamp_ntz, lab string, x double, ref_range_lower double, ref_range_upper double").write.parquet(f"{tmp_path}/labs.parquet")
    raw = {
        "subject_id": "stay", "reference": {"table": "stays", "start_time": "t0", "end_time": "t1", "age": "years"}, "options": options,
        "prefix": [{"column": "sex", "prefix": "SEX"}, {"column": "quantized_age", "prefix": "AGE"}], "suffix": [],
        "events": [{"table": "labs", "prefix": "LAB", "code": "lab", "numeric_value": "x", "time": "t"}],
    }
    return TimelineTokenizer(TimelineConfig.from_dict(raw), spark, str(tmp_path))


@pytest.mark.parametrize("fused", [False, True])
def test_age_token_and_repeated_events(spark, tmp_path, fused):
    tokenizer = tiny_tokenizer(spark, tmp_path, fused_category_values=fused, include_time_spacing_tokens=False)
    out = {r["sid"]: r["words"] for r in tokenizer.transform(tokenizer.fit()).collect()}
    for i in (0, 17, 39):
        share = sum(20 + i >= np.quantile(np.arange(20, 60), q / 10) for q in range(1, 10))
        assert out[str(i)][:3] == ["TL_START", "SEX_f", f"AGE_Q{share}" if fused else f"Q{share}"]
    # two equal rows: their tokens do not mix
    assert out["0"][-5:-1] == (["LAB_na_Q9", "LAB_na_Q9"] if not fused else out["0"][-5:-3] + ["LAB_na_Q9"] * 2) or out["0"][-5:-1] == ["LAB_na", "Q9", "LAB_na", "Q9"]


def test_reference_ranges_reach_the_tokenizer(spark, tmp_path):
    tokenizer = tiny_tokenizer(spark, tmp_path, quantizer="ventiles", include_ref_ranges=True)
    edges = {r["designator"]: r["breaks"] for r in tokenizer.fit().aux.collect()}["LAB_na"]
    assert 10.0 in edges and 50.0 in edges and edges == sorted(edges)


def test_null_keys_and_times_match_nothing(spark):
    left = spark.createDataFrame([(None, at(5)), (1, at(5)), (1, None)], "k long, t timestamp_ntz")
    right = spark.createDataFrame([(None, at(3)), (1, None), (None, at(6)), (1, at(4)), (1, at(7))], "k long, t timestamp_ntz")
    for backward, want in ((True, at(4)), (False, at(7))):
        got = joins.asof_join(left, right, "k", "t", "t", [], backward=backward).collect()
        assert sorted((str(r["k"]), str(r["t"]), r["t_right"]) for r in got) == sorted([("None", str(at(5)), None), ("1", str(at(5)), want), ("1", "None", None)], key=str)
    flags = joins.flag_followed(left, right, "k", "t", 200, "f").collect()
    assert sorted((str(r["k"]), str(r["t"]), r["f"]) for r in flags) == sorted([("None", str(at(5)), 0), ("1", str(at(5)), 1), ("1", "None", 0)])


def test_one_class_constant_values_and_the_prototype(spark):
    df = spark.createDataFrame([("a", 1, 0.2), ("a", 0, 0.7), ("b", 0, 0.5), ("b", 0, 0.6)], "g string, y int, score double")
    got = {r["g"]: r["pr_auc"] for r in evaluation.pr_auc(df, by=["g"]).collect()}
    assert got["b"] is None and got["a"] is not None
    assert {r["tpr"] for r in evaluation.roc_curve(df.where("g = 'b'")).collect()} == {None}
    flat = spark.createDataFrame([(3.0,)] * 4, "v double")
    assert [(r["left_edge"], r["n"], r["density"]) for r in evaluation.histogram(flat, "v", 2).collect()] == [(3.0, 4, 2.0)]
    rows = spark.createDataFrame([("s", 0, [1.0, 0.0]), ("s", 1, [1.0, 1.0])], "sid string, pos int, v array<double>")
    out = information.prototype_projection(rows, "v", F.array(F.lit(1.0), F.lit(0.0))).orderBy("pos").collect()
    assert out[0]["proj_abs"] == 1.0 and out[1]["proj_rel"] is None
