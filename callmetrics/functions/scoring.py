"""Difficulty curve, metadata features and the frozen logistic score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The published frozen model (features, medians, means, scales,
# weights with the intercept last, curve, token cap).
FROZEN = {
    "cohort": {"max_completion_tokens": 65536},
    "curve": {"b": 7.9, "a": 0.7271572291979341, "lapse": 0.015050126812428068, "x50": 7.857969795456387},
    "design": {
        "base_features": [
            "curve_logit", "log_completion_tokens", "log_reasoning_tokens", "cap_fraction", "log_latency_ms",
            "log_effective_billed_tps", "attempt", "finish_stop", "finish_other",
        ],
        "medians": [
            0.892138209768432, 10.506655319476549, 10.29694755351686, 0.5578155517578125, 13.259937434043037,
            4.355597175747401, 1.0, 1.0, 0.0,
        ],
        "means": [
            0.9088137408380376, 10.57610214097138, 10.3668967386139, 0.6310105267693015, 13.179054256763317,
            4.318922305427432, 1.1647058823529413, 1.0, 0.0,
        ],
        "scales": [
            0.17699592208928105, 0.3367761710856913, 0.35508820741688213, 0.20081634743545548, 0.4744400142635148,
            0.3136959131518046, 0.4296937027705804, 1.0, 1.0,
        ],
        "missing_features": [],
    },
    "weights": [
        -0.2715830694642033, -0.4176314315220992, -1.062714816548322, -0.5739972998959251, -0.054592902682733625,
        -0.3537750216354586, -0.21986254699224547, 0.0, 0.0, 1.6620396400034214,
    ],
}
# Probability clips of the curve and of the log loss.
CURVE_CLIP, LOSS_CLIP = 1e-6, 1e-9


def logistic(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def logit(p: Column) -> Column:
    return F.log(p / (1.0 - p))


def clip(x: Column, margin: float) -> Column:
    return F.greatest(F.least(x, F.lit(1.0 - margin)), F.lit(margin))


def finite(value: Column) -> Column:
    """Number or NULL: text that is no number, NaN and infinities are missing."""
    number = value.try_cast("double")
    return F.when(F.isnan(number) | (F.abs(number) == float("inf")), None).otherwise(number)


def curve_probability(level: Column, b: Column | float, a: Column | float, lapse: Column | float) -> Column:
    b, a, lapse = (x if isinstance(x, Column) else F.lit(float(x)) for x in (b, a, lapse))
    return clip((1.0 - lapse) * logistic(a * (b - level)), CURVE_CLIP)


def x50(b: Column, a: Column, lapse: Column) -> Column:
    """Level at which the curve passes one half."""
    half = 0.5 / (1.0 - lapse)
    return b - F.log(half / (1.0 - half)) / a


def metadata_features(frozen: dict) -> dict[str, Column]:
    """Nine features over level_value, completion_tokens, reasoning_tokens,
    latency_ms, attempt and finish_reason; NULL where missing."""
    completion, reasoning, latency = (
        finite(F.col(c)) for c in ("completion_tokens", "reasoning_tokens", "latency_ms")
    )
    attempt = finite(F.col("attempt"))
    stop = F.coalesce(F.col("finish_reason").isin("stop", "completed"), F.lit(False))
    curve = frozen["curve"]
    tps = F.when(latency > 0, completion / (latency / 1000.0))
    return {
        "curve_logit": logit(curve_probability(F.col("level_value"), curve["b"], curve["a"], curve["lapse"])),
        "log_completion_tokens": F.log1p(completion),
        "log_reasoning_tokens": F.log1p(reasoning),
        "cap_fraction": completion / F.lit(float(frozen["cohort"]["max_completion_tokens"])),
        "log_latency_ms": F.log1p(latency),
        "log_effective_billed_tps": F.log1p(tps),
        # Zero counts as missing here.
        "attempt": F.coalesce(F.nullif(attempt, F.lit(0.0)), F.lit(1.0)),
        "finish_stop": stop.cast("double"),
        "finish_other": (~stop).cast("double"),
    }


def frozen_score(frozen: dict) -> Column:
    """Logistic score; a missing feature takes its median, and a feature listed
    as sometimes missing is followed by its indicator."""
    features, design = metadata_features(frozen), frozen["design"]
    columns: list[Column] = []
    for name, median in zip(design["base_features"], design["medians"]):
        columns.append(F.coalesce(features[name], F.lit(float(median))))
        if name in design["missing_features"]:
            columns.append(features[name].isNull().cast("double"))
    *weights, intercept = frozen["weights"]
    total = F.lit(float(intercept))
    for column, mean, scale, weight in zip(columns, design["means"], design["scales"], weights, strict=True):
        total = total + (column - F.lit(float(mean))) / F.lit(float(scale)) * F.lit(float(weight))
    return logistic(total)


def frozen_prior(frozen: dict) -> Column:
    curve = frozen["curve"]
    return curve_probability(F.col("level_value"), curve["b"], curve["a"], curve["lapse"])
