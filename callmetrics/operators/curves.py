"""Difficulty-response curves: fits, thresholds, reliability, dispersion.

Calls are reduced to one row per level (tens of rows) before any parameter grid
is laid over them; grid points are generated per reduced row.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from callmetrics.functions import outcomes as O
from callmetrics.functions.hashing import uniform_long
from callmetrics.functions.scoring import CURVE_CLIP, curve_probability, x50
from callmetrics.operators import metrics as M
from callmetrics.operators import resampling as RS

# Ours: grid resolution. b runs from one below the lowest to one above the
# highest level; a grows geometrically.
B_STEPS, A_STEPS, A_LOW, A_RATIO = 24, 12, 0.1, 1.5
LAPSES = (0.0, 0.02, 0.05, 0.1, 0.2)
FINE = 5
# The finer grid also moves the lapse, by so many steps to both sides. A last
# one halves all steps, so many to both sides.
LAPSE_FINE, LAPSE_STEP = 3, 0.005
LAST = 3


def level_cells(calls: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, level_value, n, k): completed calls and the correct ones."""
    done = calls.where(O.is_completed(F.col("outcome")))
    return done.groupBy(*keys, "level_value").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("outcome") == O.PASS).alias("k")
    )


def _best(points: DataFrame, keys: Sequence[str], index: Sequence[str], keep: Sequence[str]) -> DataFrame:
    p = curve_probability(F.col("level_value"), F.col("b"), F.col("a"), F.col("lapse"))
    term = F.col("k") * F.log(p) + (F.col("n") - F.col("k")) * F.log(1.0 - p)
    sums = points.groupBy(*keys, *index).agg(
        F.round(F.sum(term), 6).alias("ll"), *[F.first(c).alias(c) for c in ("b", "a", "lapse", *keep) if c not in index]
    )
    # The highest likelihood; a tie goes to the smallest parameters.
    place = F.struct(-F.col("ll"), F.col("b"), F.col("a"), F.col("lapse"))
    return sums.groupBy(*keys).agg(F.min_by(F.struct("b", "a", "lapse", "ll", *keep), place).alias("m")).select(*keys, "m.*")


def fit_curves(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Maximum-likelihood (b, a, lapse) per key on a coarse grid, then on two
    finer ones around the best point."""
    keys = list(keys)
    cells = M.materialize(cells)  # read four times
    span = cells.groupBy(*keys).agg(
        (F.min("level_value") - 1.0).alias("lo"), (F.max("level_value") + 1.0).alias("hi")
    )
    framed = cells.join(span, keys)
    every = lambda last: F.explode(F.expr(f"sequence(0, {last})"))
    coarse = (
        framed.select("*", every(B_STEPS).alias("ib")).select("*", every(A_STEPS).alias("ia"))
        .select("*", F.explode(F.array(*[F.lit(v) for v in LAPSES])).alias("lapse"))
        .withColumn("b", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("ib") / F.lit(float(B_STEPS)))
        .withColumn("a", F.lit(A_LOW) * F.pow(F.lit(A_RATIO), F.col("ia").cast("double")))
    )
    start = _best(coarse, keys, ["ib", "ia", "lapse"], ["lo", "hi"]).select(
        *keys, "lo", "hi", F.col("b").alias("b0"), F.col("a").alias("a0"), F.col("lapse").alias("lapse0")
    )
    step = (F.col("hi") - F.col("lo")) / F.lit(float(B_STEPS * FINE))

    def around(found: DataFrame, moves: int, lapse_moves: int, parts: float, keep: Sequence[str]) -> DataFrame:
        """Best point of a grid around (b0, a0, lapse0) with steps of 1 / parts."""
        points = (
            cells.join(found, keys)
            .select("*", every(2 * moves).alias("ib")).select("*", every(2 * moves).alias("ia"))
            .select("*", every(2 * lapse_moves).alias("il"))
            .withColumn("lapse", F.greatest(F.col("lapse0") + (F.col("il") - lapse_moves) * F.lit(LAPSE_STEP / parts), F.lit(0.0)))
            .withColumn("b", F.greatest(F.least(F.col("b0") + step * ((F.col("ib") - moves) / F.lit(parts)), F.col("hi")), F.col("lo")))
            .withColumn("a", F.col("a0") * F.pow(F.lit(A_RATIO), (F.col("ia") - moves) / F.lit(FINE * parts)))
        )
        return _best(points, keys, ["ib", "ia", "il"], keep)

    fine = around(start, FINE, LAPSE_FINE, 1.0, ["lo", "hi"]).select(
        *keys, "lo", "hi", F.col("b").alias("b0"), F.col("a").alias("a0"), F.col("lapse").alias("lapse0")
    )
    best = around(fine, LAST, LAST, 2.0, [])
    return best.withColumn("x50", x50(F.col("b"), F.col("a"), F.col("lapse")))


@lru_cache(maxsize=64)
def _logs(levels: tuple[float, ...], stage: int, start: tuple[float, float, float] | None) -> tuple[np.ndarray, ...]:
    """The points of one of the three grids of ``fit_curves`` and the logarithms
    of both outcomes at every level; points along the last axis. They depend on
    the levels and on where the grid lies, which many replicates share."""
    level = np.array(levels)
    low, high = level.min() - 1.0, level.max() + 1.0
    if start is None:
        grids = (
            (low + (high - low) * np.arange(B_STEPS + 1) / B_STEPS)[:, None, None],
            (A_LOW * np.power(A_RATIO, np.arange(A_STEPS + 1.0)))[None, :, None], np.array(LAPSES)[None, None, :],
        )
    else:
        moves, lapse_moves, parts = ((FINE, LAPSE_FINE, 1.0), (LAST, LAST, 2.0))[stage - 1]
        b0, a0, lapse0 = start
        step, lapse_step = np.arange(-moves, moves + 1), np.arange(-lapse_moves, lapse_moves + 1)
        grids = (
            np.maximum(np.minimum(b0 + (high - low) / (B_STEPS * FINE) * (step / parts), high), low)[:, None, None],
            (a0 * np.power(A_RATIO, step / (FINE * parts)))[None, :, None],
            np.maximum(lapse0 + lapse_step * (LAPSE_STEP / parts), 0.0)[None, None, :],
        )
    b, a, lapse = (x.ravel() for x in np.broadcast_arrays(*grids))
    solve = (1.0 - lapse) / (1.0 + np.exp(-(a * (b - level[:, None]))))
    p = np.maximum(np.minimum(solve, 1.0 - CURVE_CLIP), CURVE_CLIP)
    return b, a, lapse, np.log(p), np.log(1.0 - p)


def _fit_one(level: np.ndarray, n: np.ndarray, k: np.ndarray) -> tuple[float, float, float]:
    """The three grids of ``fit_curves`` for the cells of one key."""
    found, levels = None, tuple(level.tolist())
    for stage in range(3):
        b, a, lapse, hit, miss = _logs(levels, stage, found)
        score = np.round((k[:, None] * hit + (n - k)[:, None] * miss).sum(axis=0), 6)
        top = np.flatnonzero(score == score.max())
        pick = top[np.lexsort((lapse[top], a[top], b[top]))[0]]
        found = float(b[pick]), float(a[pick]), float(lapse[pick])
    return found


_FIT = StructType([StructField(c, DoubleType()) for c in ("b", "a", "lapse")])


@F.arrow_udf(_FIT)
def _fitted(cells: pa.Array) -> pa.Array:
    rows = []
    for group in cells:
        level, n, k = np.array([(c["level_value"], c["n"], c["k"]) for c in group.as_py()], float).T
        rows.append(dict(zip(("b", "a", "lapse"), _fit_one(level, n, k))))
    return pa.array(rows, pa.struct([(c, pa.float64()) for c in ("b", "a", "lapse")]))


def fit_many_curves(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``fit_curves`` for very many keys, such as replicates: a key's levels
    (tens of rows) are one row, and the grids are laid over them in place."""
    grouped = cells.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("level_value", "n", "k"))).alias("cells"))
    fits = grouped.select(*keys, _fitted(F.col("cells")).alias("fit")).select(*keys, "fit.*")
    return fits.withColumn("x50", x50(F.col("b"), F.col("a"), F.col("lapse")))


def rounded(fits: DataFrame, keys: Sequence[str]) -> DataFrame:
    return fits.select(*keys, *[F.round(c, 6).alias(c) for c in ("b", "a", "lapse", "x50")])


def token_curve(calls: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean log completion tokens per level."""
    used = calls.where(F.col("completion_tokens") > 0)
    return used.groupBy(*keys, "level_value").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.log("completion_tokens")), 6).alias("mean_log_tokens")
    )


def peaks(levels: DataFrame, keys: Sequence[str], feature: str, x50_by_key: DataFrame) -> DataFrame:
    """Level with the highest mean feature, its distance from x50, and whether
    it is the top level, where the true peak may lie beyond the data."""
    top = levels.groupBy(*keys).agg(
        F.min_by("level_value", F.struct(-F.col(feature), F.col("level_value"))).alias("peak_level"),
        F.max("level_value").alias("top_level"), F.count(F.lit(1)).alias("n_levels"),
    )
    return top.join(x50_by_key.select(*keys, "x50"), list(keys)).select(
        *keys, "n_levels", "peak_level", F.round(F.col("peak_level") - F.col("x50"), 6).alias("offset_from_x50"),
        (F.col("peak_level") == F.col("top_level")).alias("censored"),
    )


def curve_intervals(calls: DataFrame, replicates: int, seed: int, keys: Sequence[str] = ()) -> DataFrame:
    """95 percent intervals of the curve, token peak and offset per key over
    resampled instances. The resample sums instance counts; no call is copied."""
    keys = list(keys)
    done = calls.where(O.is_completed(F.col("outcome")))
    per_instance = done.groupBy(*keys, "instance_id").agg(
        F.first("level_value").alias("level_value"), F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("outcome") == O.PASS).alias("k"),
        F.sum(F.round(F.log(F.col("completion_tokens") + 1) * 1e6, 0).cast("bigint")).alias("log_tokens"),
    )
    index = M.materialize(M.indexed_clusters(per_instance.select("instance_id").distinct(), "instance_id"))
    count = index.count()
    # The same instances are drawn for every key, as often as there are instances.
    rows = M.materialize(per_instance.join(index, "instance_id").drop("instance_id"))
    cells = M.materialize(RS.drawn_sums(rows, max(count, 1), [*keys, "level_value"], ["n", "k", "log_tokens"], replicates, seed).where("n > 0"))
    groups = ["rep", *keys]
    fits = M.materialize(fit_many_curves(cells.drop("log_tokens"), groups))
    means = cells.select(*groups, "level_value", F.round(F.col("log_tokens") / F.col("n") / 1e6, 6).alias("m"))
    top = peaks(means, groups, "m", fits).select(*groups, F.col("peak_level").alias("peak"), F.col("offset_from_x50").alias("offset"))
    names = ["x50", "a", "b", "lapse", "peak", "offset"]
    pairs = ", ".join(f"'{n}', {n}" for n in names)
    long = fits.join(top, groups).selectExpr(*keys, f"stack({len(names)}, {pairs}) AS (parameter, value)")
    # One row per replicate and parameter.
    return long.groupBy(*keys, "parameter").agg(
        F.count(F.lit(1)).alias("replicates"), F.round(F.percentile("value", F.lit(0.025)), 6).alias("ci_low"),
        F.round(F.percentile("value", F.lit(0.975)), 6).alias("ci_high"),
    )


def split_half(calls: DataFrame, key: str, seed: int) -> DataFrame:
    """x50 of two random halves of the instances, their correlation across
    keys, and the Spearman-Brown corrected reliability."""
    half = uniform_long(F.lit(seed), F.col("instance_id")) % 2
    fits = fit_curves(level_cells(calls.withColumn("half", half), [key, "half"]), [key, "half"])
    wide = fits.groupBy(key).agg(
        F.max(F.when(F.col("half") == 0, F.round("x50", 6))).alias("x_a"),
        F.max(F.when(F.col("half") == 1, F.round("x50", 6))).alias("x_b"),
    ).where(F.col("x_a").isNotNull() & F.col("x_b").isNotNull())
    r = correlated(wide, "x_a", "x_b")
    return r.select("models", F.round("r", 4).alias("pearson_r"), F.round(spearman_brown(F.col("r")), 4).alias("spearman_brown"))


def correlated(rows: DataFrame, x: str, y: str) -> DataFrame:
    """(models, r): number of rows and Pearson's r, NaN where a side does not
    vary; ``corr`` itself divides by zero there."""
    moments = rows.agg(
        F.count(F.lit(1)).alias("models"), F.covar_pop(x, y).alias("both"),
        (F.stddev_pop(x) * F.stddev_pop(y)).alias("spread"),
    )
    r = F.greatest(F.least(F.col("both") / F.nullif(F.col("spread"), F.lit(0.0)), F.lit(1.0)), F.lit(-1.0))
    r = F.when(F.col("spread") == 0, F.lit(M.NAN)).when(F.col("spread").isNotNull(), r)
    return moments.select("models", r.alias("r"))


def spearman_brown(r: Column) -> Column:
    """Minus infinity at r = -1, where the denominator is zero."""
    return F.when(r == -1.0, F.lit(-float("inf"))).otherwise(2.0 * r / (1.0 + r))


def variance_split(calls: DataFrame, keys: Sequence[str], k_min: int) -> DataFrame:
    """Share of outcome variance inside instances with at least k_min calls.
    The between part is the variance of solve rates less its sampling noise."""
    done = calls.where(O.is_completed(F.col("outcome")))
    per = done.groupBy(*keys, "instance_id").agg(
        F.count(F.lit(1)).alias("k"), F.avg(F.when(F.col("outcome") == O.PASS, 1.0).otherwise(0.0)).alias("p")
    ).where(F.col("k") >= max(k_min, 2))
    inside = F.col("k") / (F.col("k") - 1) * F.col("p") * (1 - F.col("p"))
    sums = per.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_instances"), F.avg(inside).alias("within"),
        (F.var_samp("p") - F.avg(inside / F.col("k"))).alias("between_raw"), F.avg("p").alias("pbar"),
    )
    between = F.greatest(F.col("between_raw"), F.lit(0.0))
    share = F.col("within") / F.nullif(F.col("within") + between, F.lit(0.0))
    return sums.select(
        *keys, "n_instances", *[F.round(c, 6).alias(c) for c in ("within", "between_raw")],
        F.round(between, 6).alias("between"), F.round(share, 6).alias("within_share"),
        F.round(1 - share, 6).alias("icc"), F.round("pbar", 6).alias("pbar"),
    )


def goodness_of_fit(cells: DataFrame, fits: DataFrame, keys: Sequence[str]) -> DataFrame:
    joined = cells.join(fits.select(*keys, "b", "a", "lapse"), list(keys))
    p = curve_probability(F.col("level_value"), F.col("b"), F.col("a"), F.col("lapse"))
    term = F.pow(F.col("k") - F.col("n") * p, F.lit(2.0)) / (F.col("n") * p * (1 - p))
    return joined.groupBy(*keys).agg(F.count(F.lit(1)).alias("levels"), F.round(F.sum(term), 4).alias("x2"))


def stage_drift(fits: DataFrame, first: str, second: str, width: float) -> DataFrame:
    """x50 of one model in two stages against an interval width."""
    at = lambda stage, name: fits.where(F.col("stage") == stage).select("model_id", F.col("x50").alias(name))
    drift = F.col("x50_after") - F.col("x50_before")
    return at(first, "x50_before").join(at(second, "x50_after"), "model_id").select(
        "model_id", F.round("x50_before", 6).alias("x50_before"), F.round("x50_after", 6).alias("x50_after"),
        F.round(drift, 6).alias("drift"), (F.abs(drift) <= width).alias("within_width"),
    )


def efficiency(uniform: DataFrame, adaptive: DataFrame) -> DataFrame:
    """Uniform calls that would give the adaptive width, by log-log lines
    between the budgets and clamped to them, over the adaptive calls.
    ``uniform(model, budget, width)`` is a small grid; ``adaptive(model, calls, width)``."""
    ends = uniform.groupBy("model").agg(
        F.array_sort(F.collect_list(F.struct("budget", "width"))).alias("grid")
    )
    row = adaptive.withColumnRenamed("width", "target").join(ends, "model")
    at = lambda x: F.struct(x["budget"].alias("budget"), x["width"].alias("width"))
    size = F.size("grid")
    segments = F.transform(
        F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1))),
        lambda i: F.struct(at(F.element_at("grid", i)).alias("l"), at(F.element_at("grid", F.least(i + 1, size))).alias("r")),
    )
    # The first segment whose far end is at least as narrow as the target.
    hit = F.try_element_at(F.filter(segments, lambda s: s["r"]["width"] <= F.col("target")), F.lit(1))
    first, last = F.element_at("grid", 1), F.element_at("grid", -1)
    share = (F.log("target") - F.log(F.col("hit.l.width"))) / (F.log(F.col("hit.r.width")) - F.log(F.col("hit.l.width")))
    between = F.exp(F.log(F.col("hit.l.budget")) + share * (F.log(F.col("hit.r.budget")) - F.log(F.col("hit.l.budget"))))
    needed = (
        F.when(F.col("target") >= first["width"], first["budget"].cast("double"))
        .when(F.col("hit").isNull(), last["budget"].cast("double")).otherwise(between)
    )
    return row.withColumn("hit", hit).select(
        "model", F.col("calls").alias("adaptive_calls"), F.round("target", 6).alias("adaptive_width"),
        F.round(needed, 4).alias("uniform_calls"), F.round(needed / F.col("calls"), 4).alias("efficiency_ratio"),
    )
