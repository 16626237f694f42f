"""Evaluation of scores: ranking and calibration metrics, histograms, regression, bootstrap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _by_score(df: DataFrame, y: str, score: str, by: list[str], digits: int | None = None) -> DataFrame:
    """Positives and negatives per distinct score: all ranking metrics start from this aggregate, not from rows."""
    s = F.round(score, digits) if digits is not None else F.col(score)
    return df.groupBy(*by, s.alias("s")).agg(F.sum(F.col(y).cast("long")).alias("p"), F.sum(1 - F.col(y).cast("long")).alias("n"))


def roc_auc(df: DataFrame, y: str = "y", score: str = "score", by: list[str] | None = None) -> DataFrame:
    """Mann-Whitney with mid-ranks; null where only one label occurs."""
    by = by or []
    counts = _by_score(df, y, score, by)
    below = F.sum("n").over(Window.partitionBy(*by).orderBy("s")) - F.col("n")
    rows = counts.withColumn("u", F.col("p") * (below.cast("double") + F.col("n") / F.lit(2.0)))
    pairs = F.sum("p").cast("double") * F.sum("n").cast("double")
    return rows.groupBy(*by).agg(F.when(pairs > 0, F.sum("u") / pairs).alias("roc_auc"))


def _curve(df: DataFrame, y: str, score: str, by: list[str], digits: int | None) -> DataFrame:
    down = Window.partitionBy(*by).orderBy(F.col("s").desc())
    whole = Window.partitionBy(*by)
    rows = _by_score(df, y, score, by, digits)
    return rows.select(*by, "s", F.sum("p").over(down).cast("double").alias("tp"), F.sum("n").over(down).cast("double").alias("fp"), F.sum("p").over(whole).cast("double").alias("all_p"), F.sum("n").over(whole).cast("double").alias("all_n"))


def roc_curve(df: DataFrame, y: str = "y", score: str = "score", by: list[str] | None = None) -> DataFrame:
    """threshold, fpr, tpr at each distinct score; null where a label doesn't occur."""
    return _curve(df, y, score, by or [], None).select(*(by or []), F.col("s").alias("threshold"), F.try_divide("fp", "all_n").alias("fpr"), F.try_divide("tp", "all_p").alias("tpr"))


def pr_curve(df: DataFrame, y: str = "y", score: str = "score", by: list[str] | None = None, digits: int | None = 4) -> DataFrame:
    """threshold, precision, recall at each distinct (rounded) score."""
    return _curve(df, y, score, by or [], digits).select(*(by or []), F.col("s").alias("threshold"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), F.try_divide("tp", "all_p").alias("recall"))


def pr_auc(df: DataFrame, y: str = "y", score: str = "score", by: list[str] | None = None, digits: int | None = 4) -> DataFrame:
    """Trapezoids under the precision-recall curve, which starts at recall 0, precision 1; null without positives."""
    by = by or []
    w = Window.partitionBy(*by).orderBy(F.col("threshold").desc())
    rows = pr_curve(df, y, score, by, digits).withColumn("r0", F.coalesce(F.lag("recall").over(w), F.lit(0.0))).withColumn("p0", F.coalesce(F.lag("precision").over(w), F.lit(1.0)))
    return rows.groupBy(*by).agg(F.sum((F.col("recall") - F.col("r0")) * (F.col("precision") + F.col("p0")) / F.lit(2.0)).alias("pr_auc"))


def brier(df: DataFrame, y: str = "y", score: str = "score", by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(F.avg(F.pow(F.col(y).cast("double") - F.col(score), F.lit(2.0))).alias("brier"))


def threshold_metrics(df: DataFrame, y: str = "y", score: str = "score", by: list[str] | None = None) -> DataFrame:
    """Accuracy, balanced accuracy, precision, recall of scores rounded half to even."""
    hat, pos = F.rint(score) == 1, F.col(y).cast("int") == 1
    n = lambda c: F.count_if(c).cast("double")
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn, tn = n(hat & pos), n(hat & ~pos), n(~hat & pos), n(~hat & ~pos)
    return df.groupBy(*(by or [])).agg(
        ((tp + tn) / (tp + fp + fn + tn)).alias("accuracy"), ((ratio(tp, tp + fn) + ratio(tn, tn + fp)) / 2).alias("balanced_accuracy"),
        ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
    )


def calibration(df: DataFrame, y: str = "y", score: str = "score", bins: int = 10) -> DataFrame:
    """Mean score and share of positives in uniform bins; empty bins give no row."""
    b = F.greatest(F.least(F.ceil(F.col(score) * bins) - 1, F.lit(bins - 1)), F.lit(0)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.avg(score).alias("mean_score"), F.avg(F.col(y).cast("double")).alias("share_positive"), F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, value: str, bins: int = 10, by: list[str] | None = None) -> DataFrame:
    """Counts and densities over shared uniform edges; the last bin holds its right edge.  Constant values: edges half a unit around them."""
    by = by or []
    rows = df.where(~F.isnan(value) & (F.abs(value) < float("inf")))
    edges = rows.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))  # one row
    half = F.when(F.col("lo") == F.col("hi"), 0.5).otherwise(0.0)
    edges = edges.select((F.col("lo") - half).alias("lo"), (F.col("hi") + half).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    b = F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(bins - 1)).cast("int")
    counts = rows.crossJoin(F.broadcast(edges)).withColumn("width", width).groupBy(*by, b.alias("bin"), "lo", "width").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by))
    return counts.select(*by, "bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("left_edge"), "n", (F.col("n") / (total * F.col("width"))).alias("density"))


def ols(df: DataFrame, y: str, x: str, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Long correlation matrix from one aggregation."""
    pairs = [(a, b) for a in columns for b in columns]
    one = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("corr")) for a, b in pairs])).alias("x")).select("x.*")


def resampled(df: DataFrame, row: str, n_rows: int, replicates: int, seed: int = 0) -> DataFrame:
    """Draws with replacement: ``replicate`` and how often (``w``) each row is in it.

    ``row`` numbers the rows 0 .. n_rows - 1.  Draw d of replicate r takes a row
    by a hash, so that draws can be made anywhere and made again.
    """
    spark = df.sparkSession
    draws = spark.range(replicates * n_rows).select(F.expr(f"id div {n_rows}").alias("replicate"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n_rows)).alias(row))
    counts = draws.groupBy("replicate", row).agg(F.count(F.lit(1)).alias("w"))
    return counts.join(df, row)


def weighted_auc(df: DataFrame, y: str, score: str, w: str, by: list[str]) -> DataFrame:
    counts = df.groupBy(*by, F.col(score).alias("s")).agg(F.sum(F.col(w) * F.col(y).cast("long")).alias("p"), F.sum(F.col(w) * (1 - F.col(y).cast("long"))).alias("n"))
    below = F.sum("n").over(Window.partitionBy(*by).orderBy("s")) - F.col("n")
    rows = counts.withColumn("u", F.col("p") * (below.cast("double") + F.col("n") / F.lit(2.0)))
    pairs = F.sum("p").cast("double") * F.sum("n").cast("double")
    return rows.groupBy(*by).agg(F.when(pairs > 0, F.sum("u") / pairs).alias("auc"))


def bootstrap_ci(df: DataFrame, row: str, n_rows: int, *, y: str = "y", score: str = "score", replicates: int = 200, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """Percentile interval of the AUC."""
    aucs = weighted_auc(resampled(df, row, n_rows, replicates, seed), y, score, "w", ["replicate"])
    return aucs.agg(F.percentile("auc", F.lit(alpha / 2)).alias("lo"), F.percentile("auc", F.lit(1 - alpha / 2)).alias("hi"), F.count("auc").alias("n_replicates"))


def bootstrap_p(df: DataFrame, row: str, n_rows: int, score_a: str, score_b: str, *, y: str = "y", replicates: int = 200, seed: int = 0) -> DataFrame:
    """p-values of the difference of two AUCs (the second less the first) against resamples of the pooled rows."""
    pooled = df.select(F.col(row), F.col(y), F.col(score_a).alias("s")).unionByName(df.select((F.col(row) + n_rows).alias(row), F.col(y), F.col(score_b).alias("s")))
    auc = lambda s, a: roc_auc(df, y, s).withColumnRenamed("roc_auc", a)
    seen = auc(score_a, "a").crossJoin(auc(score_b, "b")).select((F.col("b") - F.col("a")).alias("seen"))  # one row each
    null = resampled_pool(pooled, row, n_rows, replicates, seed)
    per = weighted_auc(null, y, "s", "w", ["replicate", "model"])
    d = per.groupBy("replicate").agg((F.max(F.when(F.col("model") == 1, F.col("auc"))) - F.max(F.when(F.col("model") == 0, F.col("auc")))).alias("d"))
    return d.crossJoin(F.broadcast(seen)).groupBy("seen").agg(
        F.avg((F.col("d") > F.col("seen")).cast("double")).alias("p_one_sided"), F.avg((F.abs("d") > F.abs("seen")).cast("double")).alias("p_two_sided")
    )


def resampled_pool(pooled: DataFrame, row: str, n_rows: int, replicates: int, seed: int) -> DataFrame:
    """For each replicate and each of two models n_rows draws from the 2 * n_rows pooled rows."""
    spark = pooled.sparkSession
    draws = spark.range(2 * replicates * n_rows).select(
        F.expr(f"id div {2 * n_rows}").alias("replicate"), F.expr(f"id div {n_rows} % 2").alias("model"),
        F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(2 * n_rows)).alias(row),
    )
    return draws.groupBy("replicate", "model", row).agg(F.count(F.lit(1)).alias("w")).join(pooled, row)


def summary(df: DataFrame, value: str, shares: list[float] | None = None) -> DataFrame:
    """Share of finite values, minimum, mean, maximum and quantiles of them."""
    ok = F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    x = F.when(ok, F.col(value))
    shares = shares or [0.5, 0.9, 0.95, 0.99, 0.999, 0.9999]
    return df.agg(F.avg(ok.cast("double")).alias("share_finite"), F.min(x).alias("min"), F.avg(x).alias("mean"), F.max(x).alias("max"), F.percentile(x, F.array(*[F.lit(s) for s in shares])).alias("quantiles"))


def fit_linear(df: DataFrame, y: str, xs: list[str]):
    """Ordinary least squares of several columns, by the normal equations."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    rows = VectorAssembler(inputCols=xs, outputCol="__x", handleInvalid="skip").transform(df)
    return LinearRegression(featuresCol="__x", labelCol=y, solver="normal").fit(rows)


def fit_logit(df: DataFrame, y: str, xs: list[str]):
    """Logistic regression without penalty, with standard errors."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    rows = VectorAssembler(inputCols=xs, outputCol="__x", handleInvalid="skip").transform(df)
    return GeneralizedLinearRegression(featuresCol="__x", labelCol=y, family="binomial", link="logit").fit(rows)


def fit_classifier(df: DataFrame, y: str, vector: str, kind: str = "logistic"):
    """Heads on representations (array<double>): scaled logistic, cross-validated logistic, or boosted trees."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    rows = df.select("*", array_to_vector(F.col(vector).cast("array<double>")).alias("__v"), F.col(y).cast("double").alias("__y"))
    if kind == "trees":
        return Pipeline(stages=[GBTClassifier(featuresCol="__v", labelCol="__y", maxIter=20, seed=0)]).fit(rows)
    scale, logit = StandardScaler(inputCol="__v", outputCol="__s", withMean=True), LogisticRegression(featuresCol="__s", labelCol="__y")
    pipe = Pipeline(stages=[scale, logit])
    if kind == "logistic_cv":
        grid = ParamGridBuilder().addGrid(logit.regParam, [0.001, 0.01, 0.1, 1.0]).build()
        return CrossValidator(estimator=pipe, estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(labelCol="__y"), numFolds=5, seed=0).fit(rows)
    return pipe.fit(rows)


def mean_by(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    return df.groupBy(by).agg(*[F.avg(c).alias(c) for c in columns])


def probability(vector: Column) -> Column:
    """Second entry of a probability vector."""
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(vector)[1]


def classification_metrics(df: DataFrame, logits: str, y: str = "y") -> DataFrame:
    """Accuracy, precision, recall, F1 (0 where undefined) and AUC from two logits; a row is positive where the second is the larger."""
    gap = F.get(F.col(logits), F.lit(1)).cast("double") - F.get(F.col(logits), F.lit(0)).cast("double")
    rows = df.select(F.col(y).cast("int").alias("y"), gap.alias("score"))
    hat, pos = F.col("score") > 0, F.col("y") == 1
    tp, fp, fn = (F.count_if(c).cast("double") for c in (hat & pos, hat & ~pos, ~hat & pos))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    one = rows.agg(
        F.avg((hat == pos).cast("double")).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1")
    )
    return one.crossJoin(F.broadcast(roc_auc(rows)))  # one row each; the softmax orders rows as the gap of its logits does


def synthetic_predictions(spark, n: int, models: int = 1, share_positive: float = 0.8, seed: int = 42) -> DataFrame:
    """id, y, s0, s1, ...: labels cut from a uniform number, scores that number with noise that grows by model, within 0 and 1.

    With more than two models the last one's scores are shrunk by 0.975.
    """
    rows = spark.range(n).withColumn("u", F.rand(seed))
    scores = []
    for i in range(models):
        s = F.greatest(F.least(F.col("u") + F.randn(seed + 1 + i) * ((2 * i + 5) / 27), F.lit(1.0)), F.lit(0.0))
        scores.append((s * 0.975 if models > 2 and i == models - 1 else s).alias(f"s{i}"))
    return rows.select("id", (F.col("u") > 1 - share_positive).cast("int").alias("y"), *scores)
