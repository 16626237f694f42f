"""Cohorts, loaders and small functions: cases that the driver's tables don't hold."""

import gzip
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from timeloom.functions import arrays, columns
from timeloom.operators import cohort, evaluation
from timeloom.sources import tables


def test_eligible(spark):
    rows = [(1, 17, datetime(2020, 1, 1)), (2, 18, datetime(2020, 1, 1)), (3, 40, datetime(2020, 2, 1)), (4, 40, datetime(2020, 2, 1, 0, 0, 1)), (5, None, datetime(2020, 1, 5)), (6, 40, None)]
    df = spark.createDataFrame(rows, "id long, age int, start timestamp_ntz")
    got = cohort.eligible(df, age="age", start="start", ids=["id"], window=("2020-01-01", "2020-02-01"))
    assert sorted(r["id"] for r in got.collect()) == ["2", "3"]
    assert cohort.eligible(df, age="age", start="start", ids=["id"]).count() == 4


def test_predictions(spark):
    flags = spark.createDataFrame([("a", True, True), ("b", True, False), ("c", False, None)], "sid string, imv boolean, imv_24h boolean")
    scores = spark.createDataFrame([("a", "imv", 0.5), ("b", "imv", 0.7)], "sid string, outcome string, score double")
    got = {r["sid"]: (r["qualifies"], r["label"], r["score"]) for r in cohort.predictions(cohort.qualified(flags, ["imv"]), scores).collect()}
    assert got == {"a": (False, True, None), "b": (True, True, 0.7), "c": (True, False, None)}


def test_bands_completions_and_subsets(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(100)] + [("b", float("nan")), ("b", None)], "k string, x double")
    assert {r["k"]: (r["n_top"], r["n_band"]) for r in cohort.band_counts(df, "k", "x").collect()} == {"a": (1, 4), "b": (0, 0)}
    samples = spark.createDataFrame([("a", [1, 2]), ("a", [3]), ("b", [3])], "sid string, t array<int>")
    got = {r["sid"]: tuple(r)[1:] for r in cohort.completion_votes(samples, "t", 2, 3).collect()}
    assert got == {"a": (2, 1, 0.5, 0.0), "b": (1, 0, 1.0, None)}
    numbers = spark.range(25)
    assert sorted(r["id"] for r in cohort.first_share(numbers, 0.3, "id").collect()) == list(range(7))
    assert cohort.sample_rows(numbers, 5, ["id"]).collect() == cohort.sample_rows(numbers.repartition(7), 5, ["id"]).collect()
    assert [r["id"] for r in cohort.complete_positive(spark.createDataFrame([(1, 1.0), (2, 0.0), (3, None), (4, float("nan"))], "id int, x double"), ["x"], ["x"]).collect()] == [1]


def test_redacted_timelines(spark):
    rows = [("a", 0, 0, 10, 9.0), ("a", 1, 1, 11, 5.0), ("a", 2, 2, 12, 1.0), ("b", 0, 0, 10, 1.0), ("c", 0, 0, 10, 1.0)]
    tokens = spark.createDataFrame(rows, "sid string, pos int, ts int, token long, value double")
    kept = spark.createDataFrame([("a", True), ("b", False)], "sid string, died boolean")
    got = {r["sid"]: (r["died"], r["seq_len"], r["padded"]) for r in cohort.redacted_timelines(tokens, kept, 3, 0, 1, k=1).collect()}
    assert got == {"a": (True, 2, [10, 12, 0]), "b": (False, 1, [10, 0, 0])}


def test_functions(spark):
    df = spark.createDataFrame([("a.b", "x"), ("a", "2020-01-02"), (None, None)], "s string, t string")
    got = df.select(columns.split_at(F.col("s"), ".", 1).alias("p"), columns.parsed_time(F.col("t"), "yyyy-MM-dd").alias("t")).collect()
    assert [r["p"] for r in got] == ["b", None, None] and [r["t"] for r in got] == [None, datetime(2020, 1, 2), None]
    assert columns.float_columns(spark.createDataFrame([(1, 1.0)], "a int, b double")) == ["b"]
    for share, want in ((0.0, [0, 0, 0, 0, 7]), (0.5, [0, 0, 0, 7, 8]), (0.99, [0, 0, 7, 8, 9])):
        assert spark.range(1).select(arrays.cut_to_left(F.array(*map(F.lit, [7, 8, 9, 0, 0])), F.lit(0), F.lit(share))).first()[0] == want
    assert spark.range(1).select(arrays.cut_to_left(F.array(F.lit(0), F.lit(0)), F.lit(0), F.lit(0.5))).first()[0] == [0, 0]


def test_synthetic_predictions(spark):
    df = evaluation.synthetic_predictions(spark, 4000, 3)
    one = df.agg(F.avg("y"), F.max("s2"), F.min("s0"), F.max("s0")).first()
    assert abs(one[0] - 0.8) < 0.04 and one[1] <= 0.975 and 0 <= one[2] <= one[3] <= 1
    assert evaluation.roc_auc(df, "y", "s0").first()[0] > evaluation.roc_auc(df, "y", "s1").first()[0] > 0.7


def test_loaders(spark, tmp_path):
    for folder, name in (("hosp", "a"), ("icu", "b")):
        (tmp_path / folder).mkdir()
        with gzip.open(tmp_path / folder / f"{name}.csv.gz", "wt") as f:
            f.write("id,x\n01,2\n")
    found = tables.read_csv_folder(spark, str(tmp_path))
    assert sorted(found) == ["a", "b"] and found["b"].collect()[0].asDict() == {"id": "01", "x": "2"}
    spark.range(10).withColumn("y", F.col("id") % 3).write.parquet(str(tmp_path / "p"))
    assert sorted(r["id"] for r in tables.read_filtered(spark, str(tmp_path / "p"), ["id"], {"y": [0]}).collect()) == [0, 3, 6, 9]
    assert tables.read_splits(spark, {"train": str(tmp_path / "p")}, {"id": "input_ids"})["train"].columns == ["input_ids"]
    with pytest.raises(ValueError):
        (tmp_path / "hosp" / "b.csv.gz").write_bytes(b"")
        tables.read_csv_folder(spark, str(tmp_path))
