"""Probability scores, ranking metrics and the cluster bootstrap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callmetrics.functions.hashing import HASH_SPAN, uniform_long
from callmetrics.functions.scoring import LOSS_CLIP, clip, logit
from callmetrics.operators.ordered import prefix_sums, quantiles, ranked, uniform_points
from callmetrics.session import materialize, parallelism, side_by_side

NAN = float("nan")


def squared_error(label: Column, score: Column) -> Column:
    return (label - score) * (label - score)


def log_loss_term(label: Column, score: Column) -> Column:
    p = clip(score, LOSS_CLIP)
    return -(label * F.log(p) + (1 - label) * F.log(1.0 - p))


def skill(error: Column, baseline: Column) -> Column:
    return F.when(baseline == 0, F.lit(NAN)).otherwise(1.0 - error / baseline)


def score_metrics(rows: DataFrame, keys: Sequence[str] = (), score: str = "prediction", prior: str = "curve_prior") -> DataFrame:
    """Brier, its prior baseline and skill, and log loss in one pass."""
    y, p, q = F.col("label"), F.col(score), F.col(prior)
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("positives"),
        F.avg(squared_error(y, p)).alias("brier"), F.avg(squared_error(y, q)).alias("prior_brier"),
        F.avg(log_loss_term(y, p)).alias("log_loss"),
    )
    return out.withColumn("brier_skill", skill(F.col("brier"), F.col("prior_brier")))


def score_histogram(rows: DataFrame, score: str, keys: Sequence[str]) -> DataFrame:
    """Labels per distinct score. What follows reads it three times, so it is
    stored once and the scores are not computed again."""
    counted = rows.groupBy(*keys, F.col(score).alias("score")).agg(
        F.sum("label").cast("bigint").alias("pos"), F.sum(1 - F.col("label")).cast("bigint").alias("neg")
    )
    # The missing score is dropped here: a filter before the grouping would be
    # moved below the projection and compute every score a second time.
    return materialize(counted).where(F.col("score").isNotNull())


def auc(rows: DataFrame, keys: Sequence[str] = (), score: str = "prediction") -> DataFrame:
    """Share of (positive, negative) pairs in the right order, ties one half."""
    return histogram_auc(score_histogram(rows, score, list(keys)), keys)


def histogram_auc(histogram: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The same from ``(keys, score, pos, neg)``. No pair is formed: each
    distinct score meets the count of lower negatives."""
    keys = list(keys)
    running = prefix_sums(histogram, "score", {"below": "neg"}, keys)
    exact = "decimal(38,0)"
    wins = F.col("pos").cast("decimal(18,0)") * (2 * F.col("below") + F.col("neg")).cast("decimal(19,0)")
    sums = running.groupBy(*keys).agg(
        F.sum(wins.cast(exact)).alias("twice_wins"), F.sum("pos").alias("positives"), F.sum("neg").alias("negatives")
    )
    pairs = F.col("positives").cast("double") * F.col("negatives")
    return sums.select(
        *keys, "positives", "negatives",
        F.when(pairs > 0, F.col("twice_wins").cast("double") / 2.0 / pairs).otherwise(F.lit(NAN)).alias("auc"),
        (F.col("twice_wins").cast("double") / 2.0).alias("wins"), pairs.alias("pairs"),
    )


def threshold_curve(rows: DataFrame, score: str = "prediction", keys: Sequence[str] = ()) -> DataFrame:
    """Per distinct threshold, counts at or above it: the base of precision and
    recall, of TPR and FPR."""
    keys = list(keys)
    histogram = score_histogram(rows, score, keys)
    running = prefix_sums(
        histogram, "score", {"pos_below": "pos", "neg_below": "neg"}, keys,
        totals={"positives": "pos", "negatives": "neg"},
    )
    return running.select(
        *keys, F.col("score").alias("threshold"), "positives", "negatives",
        (F.col("positives") - F.col("pos_below")).alias("tp"), (F.col("negatives") - F.col("neg_below")).alias("fp"),
    )


def precision_recall(rows: DataFrame, score: str = "prediction", keys: Sequence[str] = ()) -> DataFrame:
    curve = threshold_curve(rows, score, keys)
    return curve.select(
        *keys, "threshold", "tp", "fp",
        F.round(F.col("tp") / (F.col("tp") + F.col("fp")), 6).alias("precision"),
        F.round(F.col("tp") / F.nullif(F.col("positives"), F.lit(0)), 6).alias("recall"),
    )


def youden_threshold(rows: DataFrame, score: str = "prediction", keys: Sequence[str] = ()) -> DataFrame:
    """Threshold with the largest TPR - FPR, compared as exact cross products;
    the lowest such threshold wins a tie."""
    curve = threshold_curve(rows, score, keys).where((F.col("positives") > 0) & (F.col("negatives") > 0))
    wide = "decimal(19,0)"
    gain = F.col("tp").cast(wide) * F.col("negatives").cast("decimal(18,0)") - F.col("fp").cast(wide) * F.col(
        "positives"
    ).cast("decimal(18,0)")
    best = curve.groupBy(*keys).agg(
        F.max_by(F.struct("threshold", "tp", "fp", "positives", "negatives"), F.struct(gain, -F.col("threshold"))).alias("b")
    )
    tpr, fpr = F.col("b.tp") / F.col("b.positives"), F.col("b.fp") / F.col("b.negatives")
    return best.select(
        *keys, F.col("b.threshold").alias("threshold"), F.round(tpr, 6).alias("tpr"),
        F.round(fpr, 6).alias("fpr"), F.round(tpr - fpr, 6).alias("youden_j"),
    )


def coverage(rows: DataFrame, coverages: Sequence[float], score: str = "prediction", cost: str | None = None) -> DataFrame:
    """Accuracy, mean confidence and cost among the ceil(c * N) most confident
    rows; ties go by call id."""
    columns = ["call_id", "label", score] + ([cost] if cost else [])
    keyed = rows.select(*columns).withColumn("__down", -F.col(score))
    placed = ranked(keyed, "__down", order=["__down", "call_id"], name="rank", size="total", tie="call_id")
    taken = lambda c, value: F.when(F.col("rank") < F.ceil(F.lit(float(c)) * F.col("total")), value)
    measures = {"n": F.lit(1), "accuracy": F.col("label"), "mean_confidence": F.col(score)}
    if cost:
        measures["cost"] = F.col(cost)
    kinds = {"n": F.count, "cost": F.sum}
    # All levels in one pass, then one row per level.
    wide = placed.agg(*[
        kinds.get(name, F.avg)(taken(c, value)).alias(f"{name}_{i}")
        for i, c in enumerate(coverages) for name, value in measures.items()
    ])
    rows = ", ".join(
        ", ".join([f"{float(c)}D", *[f"{name}_{i}" for name in measures]]) for i, c in enumerate(coverages)
    )
    long = wide.selectExpr(f"stack({len(coverages)}, {rows}) AS (coverage, {', '.join(measures)})")
    return long.withColumns({c: F.round(c, 6) for c in ("accuracy", "mean_confidence")})


def cluster_sums(rows: DataFrame, cluster: str, keys: Sequence[str] = ()) -> DataFrame:
    """The skill of a resample depends on its clusters only through these sums."""
    y, p, q = F.col("label"), F.col("prediction"), F.col("curve_prior")
    return rows.groupBy(*keys, cluster).agg(
        F.sum(squared_error(y, p)).alias("error"), F.sum(squared_error(y, q)).alias("baseline"),
        F.count(F.lit(1)).alias("n"),
    )


def indexed_clusters(clusters: DataFrame, cluster: str) -> DataFrame:
    """Dense index 0..K-1 in the order of a hash of the cluster's id."""
    keyed = clusters.withColumn("__h", uniform_long(F.col(cluster)))
    points = uniform_points(0.0, HASH_SPAN, parallelism(clusters.sparkSession))
    return ranked(keyed, "__h", order=["__h", cluster], name="idx", points=points).drop("__h")


def bootstrap_draws(spark, clusters: int, replicates: int, seed: int) -> DataFrame:
    """K picks with replacement per replicate, fixed by the seed."""
    pick = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed).cast("string"), F.col("rep").cast("string"), F.col("draw").cast("string"))), 1, 8), 16, 10)
    return (
        spark.range(replicates * clusters)
        .select(F.expr(f"id div {clusters}").alias("rep"), (F.col("id") % clusters).alias("draw"))
        .select("rep", (pick.cast("bigint") % clusters).alias("idx"))
    )


def replicate_sums(rows: DataFrame, sums: Sequence[str], cluster: str, replicates: int, seed: int) -> tuple[DataFrame, int]:
    """Sums of the resampled clusters per replicate, and the cluster count."""
    clusters = materialize(indexed_clusters(rows, cluster).select("idx", *sums))
    count = clusters.count()
    if count < 2:
        return clusters.sparkSession.createDataFrame([], "rep bigint, " + ", ".join(f"{s} double" for s in sums)), count
    draws = bootstrap_draws(clusters.sparkSession, count, replicates, seed)
    return draws.join(clusters, "idx").groupBy("rep").agg(*[F.sum(s).alias(s) for s in sums]), count


def clustered_interval(rows: DataFrame, cluster: str = "instance_id", replicates: int = 2000, seed: int = 20260712) -> DataFrame:
    """One row: 2.5 and 97.5 percent points of the Brier skill over resampled
    clusters. NaN with fewer than two clusters; replicates without a finite
    skill are left out."""
    sums, count = replicate_sums(cluster_sums(rows, cluster), ["error", "baseline"], cluster, replicates, seed)
    skills = sums.select(skill(F.col("error"), F.col("baseline")).alias("skill")).where(~F.isnan("skill"))
    # At most one row per replicate, so the exact aggregate is bounded.
    points = skills.agg(
        F.percentile("skill", F.lit(0.025)).alias("lo"), F.percentile("skill", F.lit(0.975)).alias("hi"),
        F.count(F.lit(1)).alias("replicates"),
    )
    return points.select(
        F.lit(count).cast("bigint").alias("clusters"), "replicates",
        F.coalesce("lo", F.lit(NAN)).alias("ci_low"), F.coalesce("hi", F.lit(NAN)).alias("ci_high"),
    )


def unpivot_scores(rows: DataFrame, scores: dict[str, str], keep: Sequence[str]) -> DataFrame:
    """One row per call and score column: (…keep, model, prediction)."""
    pairs = ", ".join(f"'{name}', {column}" for name, column in scores.items())
    return rows.selectExpr(*keep, f"stack({len(scores)}, {pairs}) AS (model, prediction)")


def all_metrics(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Brier, skill against the prior, log loss and AUC per key, 6 decimals."""
    left, right = score_metrics(rows, keys), auc(rows, keys).select(*keys, "auc")
    both = left.join(right, list(keys)) if keys else side_by_side(left, right)
    return both.select(
        *keys, "n", *[F.round(c, 6).alias(c) for c in ("brier", "brier_skill", "log_loss", "auc")]
    )


def compare_metrics(calculated: DataFrame, expected: DataFrame, metrics: Sequence[str], tolerance: float = 1e-6) -> DataFrame:
    """Both sides unpivoted to (model, metric, value) and laid side by side."""
    pairs = ", ".join(f"'{m}', {m}" for m in metrics)
    long = lambda df, name: df.selectExpr("model", f"stack({len(metrics)}, {pairs}) AS (metric, {name})")
    joined = long(calculated, "calculated").join(long(expected, "expected"), ["model", "metric"], "full")
    difference = F.abs(F.col("calculated") - F.col("expected"))
    return joined.withColumn("matches", F.coalesce(difference <= tolerance, F.lit(False)))


def reliability_bins(rows: DataFrame, bins: int, score: str = "prediction") -> DataFrame:
    cell = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("bigint")
    return rows.groupBy(cell.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(score), 6).alias("mean_prediction"),
        F.round(F.avg("label"), 6).alias("observed"),
    )


def calibration_line(rows: DataFrame, score: str = "prediction") -> DataFrame:
    """Intercept and slope of the label's logistic regression on logit(score)."""
    prepared = VectorAssembler(inputCols=["x"], outputCol="features").transform(
        rows.select(F.col("label").cast("double").alias("label"), logit(clip(F.col(score), LOSS_CLIP)).alias("x"))
    )
    model = LogisticRegression(regParam=0.0, maxIter=100, tol=1e-10).fit(prepared)
    return rows.sparkSession.range(1).select(
        F.round(F.lit(float(model.intercept)), 4).alias("intercept"),
        F.round(F.lit(float(model.coefficients[0])), 4).alias("slope"),
    )


def feature_summary(rows: DataFrame, features: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Non-null count and mean per feature, one row per (key, feature)."""
    wide = rows.groupBy(*keys).agg(
        *[F.count(f).alias(f"n_{f}") for f in features],
        *[F.round(F.avg(f), 6).alias(f"m_{f}") for f in features],
    )
    pairs = ", ".join(f"'{f}', n_{f}, m_{f}" for f in features)
    return wide.selectExpr(*keys, f"stack({len(features)}, {pairs}) AS (feature, n, mean)")


def feature_medians(rows: DataFrame, features: Sequence[str], keys: Sequence[str]) -> DataFrame:
    pairs = ", ".join(f"'{f}', cast({f} AS double)" for f in features)
    long = rows.selectExpr(*keys, f"stack({len(features)}, {pairs}) AS (feature, value)")
    return quantiles(long, "value", {"median": 0.5}, [*keys, "feature"]).withColumn("median", F.round("median", 6))
