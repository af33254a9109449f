"""Grouped folds, regularised training and held-out predictions.

All folds are trained together. A model is linear in a row's raw columns (each
feature, zero where it is missing, a flag for that, and one): medians, means and
scales of its training rows only change the coefficients. So one pass over the
rows gives the gradient and the curvature of every fold's model at once, and
Newton's method ends after some eight passes, whatever the number of folds.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callmetrics.functions.hashing import HASH_SPAN, uniform_long
from callmetrics.functions.scoring import curve_probability, logit
from callmetrics.operators.curves import fit_curves
from callmetrics.operators.ordered import prefix_sums, ranked, uniform_points
from callmetrics.session import materialize, parallelism, side_by_side

PASSES = 60
FLAT = 1e-9  # gradient at which a fit has ended


def best_class(metrics: DataFrame, silent: DataFrame) -> DataFrame:
    """The score class with the highest skill and its retrospective gate."""
    best = metrics.agg(
        F.min_by(F.struct("model", "brier_skill", "auc"), F.struct(-F.col("brier_skill"), F.col("model"))).alias("b")
    ).select("b.*")
    row = side_by_side(best, silent)
    conditions = {
        "at_least_20_silent_wrong": F.col("silent") >= 20,
        "auc_at_least_0_75": F.col("auc") >= 0.75,
        "brier_skill_at_least_0_10": F.col("brier_skill") >= 0.10,
    }
    passed = F.lit(True)
    for c in conditions.values():
        passed = passed & c
    return row.select("model", "brier_skill", "auc", *[c.alias(n) for n, c in conditions.items()], passed.alias("pass"))


def grouped_folds(instances: DataFrame, folds: int, seed: int) -> DataFrame:
    """Fold per instance, dealt out inside each level in the order of a seeded
    hash, so a level's instances are spread evenly and none is in two folds."""
    keyed = instances.select("instance_id", "level_value").distinct().withColumn(
        "__h", uniform_long(F.lit(seed), F.col("instance_id"))
    )
    points = uniform_points(0.0, HASH_SPAN, parallelism(instances.sparkSession))
    placed = ranked(keyed, "__h", ["level_value"], ["__h", "instance_id"], "place", points)
    return placed.select("instance_id", "level_value", (F.col("place") % folds).alias("fold"))


def fold_medians(rows: DataFrame, features: Sequence[str], folds: int) -> dict[int, dict[str, float]]:
    """Exact median of every feature over the rows outside each fold: folds
    times features numbers. A feature without any value has median zero.

    One histogram of the values counts every fold; what lies below a value
    outside a fold is what lies below it in all less that in the fold."""
    pairs = ", ".join(f"'{f}', cast({f} AS double)" for f in features)
    long = rows.selectExpr("fold", f"stack({len(features)}, {pairs}) AS (feature, value)").where("value IS NOT NULL")
    own = [f"c{h}" for h in range(folds)]
    counted = materialize(long.groupBy("feature", "value").agg(
        F.count(F.lit(1)).alias("c"), *[F.count_if(F.col("fold") == h).alias(c) for h, c in enumerate(own)]
    ))
    placed = prefix_sums(
        counted, "value", {f"b{c}": c for c in ("c", *own)}, ["feature"], totals={f"t{c}": c for c in ("c", *own)}
    )

    def at(held: str, rank: Column) -> Column:
        below, count = F.col("bc") - F.col(f"b{held}"), F.col("c") - F.col(held)
        return F.max(F.when((below <= rank) & (rank < below + count), F.col("value")))

    middles = []
    for h, c in enumerate(own):
        total = F.col("tc") - F.col(f"t{c}")
        low, high = F.floor((total - 1) / 2), F.floor(total / 2)
        middles.append(((at(c, low) + at(c, high)) / 2).alias(f"m{h}"))
    found: dict[int, dict[str, float]] = {h: dict.fromkeys(features, 0.0) for h in range(folds)}
    for r in placed.groupBy("feature").agg(*middles).collect():
        for h in range(folds):
            if r[f"m{h}"] is not None:
                found[h][r["feature"]] = r[f"m{h}"]
    return found


def _scales(rows: DataFrame, features: Sequence[str], medians: dict[int, dict[str, float]]) -> dict[int, np.ndarray]:
    """Per held-out fold the matrix that takes raw columns to standardised ones,
    from one aggregate: sums of all folds less those of the fold."""
    value = [F.col(f).cast("double") for f in features]
    sums = rows.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"), *[F.count(v).alias(f"n{i}") for i, v in enumerate(value)],
        *[F.coalesce(F.sum(v), F.lit(0.0)).alias(f"s{i}") for i, v in enumerate(value)],
        *[F.coalesce(F.sum(v * v), F.lit(0.0)).alias(f"q{i}") for i, v in enumerate(value)],
    ).collect()  # one row per fold
    size = len(features)
    made = {}
    for held, middle in medians.items():
        others = [r for r in sums if r["fold"] != held]
        n, matrix = sum(r["n"] for r in others), np.zeros((2 * size + 1, 2 * size + 1))
        matrix[-1, -1] = 1.0

        def standard(row: int, total: float, squares: float) -> None:
            mean = total / n
            spread = (squares - n * mean * mean) / (n - 1)
            if spread > 1e-12 * max(1.0, squares / n):  # else the column is constant and stays out
                matrix[row, -1] -= mean
                matrix[row] /= np.sqrt(spread)
            else:
                matrix[row] = 0.0

        for i, f in enumerate(features):
            known = sum(r[f"n{i}"] for r in others)
            gaps, m = n - known, middle[f]
            matrix[i, i], matrix[i, size + i], matrix[size + i, size + i] = 1.0, m, 1.0
            if n > 1:
                standard(i, sum(r[f"s{i}"] for r in others) + gaps * m, sum(r[f"q{i}"] for r in others) + gaps * m * m)
                standard(size + i, gaps, gaps)
        made[held] = matrix
    return made


def _raw(features: Sequence[str]) -> list[Column]:
    value = [F.col(f).cast("double") for f in features]
    return [*[F.coalesce(v, F.lit(0.0)) for v in value], *[F.when(v.isNull(), 1.0).otherwise(0.0) for v in value], F.lit(1.0)]


def _slopes(rows: DataFrame, models: dict[int, np.ndarray]) -> dict[int, tuple[int, float, np.ndarray, np.ndarray]]:
    """Per model (held-out fold: coefficients of the raw columns) the count, the
    summed log loss, its gradient and its curvature over the rows of other folds.

    ``rows``: label, fold and the raw columns as the array z. A task gives one
    row of sums per model; Spark adds them up by position."""
    size = len(next(iter(models.values())))
    upper = np.triu_indices(size)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {held: np.zeros(2 + size + len(upper[0])) for held in models}
        for batch in batches:
            label = batch.column(0).to_numpy(zero_copy_only=False).astype(np.float64)
            fold = batch.column(1).fill_null(-1).to_numpy(zero_copy_only=False)
            z = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), size)
            for held, weights in models.items():
                mine = fold != held
                x, y = z[mine], label[mine]
                margin = x @ weights
                chance = 1.0 / (1.0 + np.exp(-np.clip(margin, -500, 500)))
                loss = np.logaddexp(0.0, np.where(y > 0, -margin, margin)).sum()
                curve = (x.T * (chance * (1.0 - chance))) @ x
                totals[held] += np.concatenate([[len(y), loss], x.T @ (chance - y), curve[upper]])
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(totals), pa.int64()), pa.array([t.tolist() for t in totals.values()], pa.list_(pa.float64()))], names=["held", "sums"]
        )

    summed = (
        rows.mapInArrow(work, "held long, sums array<double>").select("held", F.posexplode("sums").alias("at", "value"))
        .groupBy("held", "at").agg(F.sum("value").alias("value"))
    )
    found = {held: np.zeros(2 + size + len(upper[0])) for held in models}
    for r in summed.collect():  # models times positions
        found[r["held"]][r["at"]] = r["value"]
    out = {}
    for held, t in found.items():
        curve = np.zeros((size, size))
        curve[upper] = t[2 + size:]
        out[held] = int(t[0]), t[1], t[2:2 + size], curve + np.triu(curve, 1).T
    return out


def train_models(rows: DataFrame, features: Sequence[str], folds: int, strength: float = 0.01, held_out: Sequence[int] | None = None) -> dict[int, np.ndarray]:
    """Coefficients of the raw columns, per held-out fold, of the logistic model
    that minimises the mean log loss of the other folds' rows plus half the
    strength times the squared weights of the standardised columns.

    ``rows``: label, fold and features; rows without a fold are in every
    training set. A fold that leaves no rows has zero weights."""
    medians = fold_medians(rows, features, folds)
    scales = _scales(rows, features, {h: medians[h] for h in (range(folds) if held_out is None else held_out)})
    narrow = materialize(rows.select("label", F.col("fold").cast("long").alias("fold"), F.array(*_raw(features)).alias("z")))
    size = 2 * len(features) + 1
    penalty = np.append(np.full(size - 1, strength), 0.0)
    weights = {h: np.zeros(size) for h in scales}
    steps: dict[int, np.ndarray] = {}
    losses = dict.fromkeys(scales, np.inf)
    open_ones = set(scales)
    for _ in range(PASSES):
        for held, (n, loss, slope, curve) in _slopes(narrow, {h: scales[h].T @ weights[h] for h in open_ones}).items():
            w, matrix = weights[held], scales[held]
            if not n:
                open_ones.discard(held)
                continue
            value = loss / n + 0.5 * float(penalty @ (w * w))
            if value > losses[held] + 1e-12:  # too far: half of the last step
                steps[held] = steps[held] / 2
                weights[held] = w - steps[held]
                continue
            losses[held] = value
            gradient = matrix @ slope / n + penalty * w
            if np.abs(gradient).max() < FLAT:
                open_ones.discard(held)
                continue
            steps[held] = -np.linalg.solve(matrix @ curve @ matrix.T / n + np.diag(penalty + 1e-12), gradient)
            weights[held] = w + steps[held]
        if not open_ones:
            break
    return {h: scales[h].T @ w for h, w in weights.items()}


def _scored(models: dict[int, np.ndarray], rows: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Every row by the model that has not seen its fold; null without a fold."""
    known = rows.sparkSession.createDataFrame([(h, w.tolist()) for h, w in models.items()], "__held long, __w array<double>")
    margin = F.aggregate(F.zip_with(F.array(*_raw(features)), "__w", lambda z, w: z * w), F.lit(0.0), lambda s, x: s + x)
    joined = rows.join(F.broadcast(known), F.col("fold").cast("long") == F.col("__held"), "left")  # one row per fold
    return joined.select(*keep, (1.0 / (1.0 + F.exp(-margin))).alias("prediction"))


def out_of_fold(rows: DataFrame, features: Sequence[str], folds: int, keep: Sequence[str], strength: float = 0.01) -> DataFrame:
    """``rows`` carry label, fold and features. Every row is scored by the model
    that has not seen its fold."""
    rows = materialize(rows)
    return _scored(train_models(rows, features, folds, strength), rows, features, keep)


def with_held_out_curve(rows: DataFrame, folds: int) -> DataFrame:
    """Adds ``curve_prior`` and ``curve_logit`` of a curve that has not seen the
    row's fold. There is one prior per fold and level; a row without one of them
    has none."""
    prior = held_out_prior(rows, folds)
    return rows.join(prior, ["fold", "level_value"], "left").withColumn("curve_logit", logit(F.col("curve_prior")))


def held_out_prior(rows: DataFrame, folds: int) -> DataFrame:
    """Curve prior per fold and level, fitted without the fold's instances:
    level counts of all folds less those of the fold."""
    counts = rows.groupBy("fold", "level_value").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("k"))
    others = counts.select("level_value", "n", "k", F.col("fold").alias("own")).select(
        "level_value", "n", "k", "own", F.explode(F.expr(f"sequence(0L, {folds - 1}L)")).alias("fold")
    ).where(F.col("fold") != F.col("own"))
    cells = materialize(others.groupBy("fold", "level_value").agg(F.sum("n").alias("n"), F.sum("k").alias("k")))
    fits = fit_curves(cells, ["fold"])
    levels = rows.select("fold", "level_value").distinct()
    return levels.join(fits, "fold").select(
        "fold", "level_value", curve_probability(F.col("level_value"), F.col("b"), F.col("a"), F.col("lapse")).alias("curve_prior")
    )


def forward_holdout(train: DataFrame, test: DataFrame, features: Sequence[str], keep: Sequence[str], strength: float = 0.01) -> DataFrame:
    """Train on one stage, score a later one; the curve is the train stage's."""
    counts = train.groupBy("level_value").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("k")).withColumn("fit", F.lit(0))
    curve = fit_curves(materialize(counts), ["fit"]).first()
    prior = curve_probability(F.col("level_value"), curve["b"], curve["a"], curve["lapse"])
    placed = [df.withColumn("curve_prior", prior).withColumn("curve_logit", logit(F.col("curve_prior"))) for df in (train, test)]
    both = materialize(placed[0].withColumn("fold", F.lit(0).cast("long")).unionByName(placed[1].withColumn("fold", F.lit(1).cast("long"))))
    return _scored(train_models(both, features, 2, strength, [1]), both.where("fold = 1"), features, keep)
