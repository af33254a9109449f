"""The prospective report: scoring, metrics, interval and gate in one row."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callmetrics.functions import outcomes as O
from callmetrics.functions.hashing import content_digest, id_hash
from callmetrics.functions.scoring import frozen_prior, frozen_score
from callmetrics.operators import metrics as M
from callmetrics.operators import status as S
from callmetrics.session import materialize, side_by_side


def prediction_rows(calls: DataFrame, instances: DataFrame, frozen: dict) -> DataFrame:
    """Completed calls with label, frozen score and curve prior."""
    needed = [
        "call_id", "instance_id", "outcome", "completion_tokens", "reasoning_tokens", "latency_ms", "attempt",
        "finish_reason",
    ]
    completed = calls.where(O.is_completed(F.col("outcome"))).select(*needed)
    return completed.join(instances.select("instance_id", "level_value"), "instance_id").select(
        "call_id", "instance_id", id_hash(F.col("instance_id")).alias("instance_hash"),
        F.col("level_value").alias("difficulty"),
        F.when(F.col("outcome") == O.PASS, 1).otherwise(0).cast("bigint").alias("label"),
        frozen_score(frozen).alias("prediction"), frozen_prior(frozen).alias("curve_prior"),
    )


# Gate thresholds of the registered analysis.
GATE = {
    "brier_skill_at_least_0_10": "not isnan(brier_skill) AND brier_skill >= 0.10D",
    "interval_excludes_zero": "not isnan(ci_low) AND ci_low > 0",
    "auc_at_least_0_75": "not isnan(auc) AND auc >= 0.75D",
}


# The two reasons.
NOT_STOPPED = "prospective stopping condition has not been reached"
NOT_READY = "provider continuity or post-sentinel requirement is not satisfied"


def refusal(study: DataFrame) -> str | None:
    """Why a study may not be looked at yet. ``study``: one row with
    ``stop_reason`` and ``ready``."""
    row = study.first()
    if row is None or row["stop_reason"] is None:
        return NOT_STOPPED
    return None if row["ready"] else NOT_READY


def require_final(study: DataFrame) -> None:
    """A report is looked at once, so a study that has not stopped or is not
    ready is refused."""
    if (reason := refusal(study)) is not None:
        raise ValueError(reason)


def guarded_report(calls: DataFrame, instances: DataFrame, frozen: dict, state: DataFrame, replicates: int = 2000, seed: int = 20260712) -> DataFrame:
    """One row: the report of a study that may be looked at, or why it may not."""
    reason = refusal(state)
    columns = ["status", "completed_for_confidence", "brier_skill", "ci_low", "ci_high", "auc", "pass"]
    kinds = ["string", "bigint", "double", "double", "double", "double", "boolean"]
    if reason is None:
        report = prospective_report(calls, instances, frozen, replicates, seed, final=state).select(F.lit(None).cast("string").alias("refused"), *columns)
    else:
        report = calls.sparkSession.range(1).select(
            F.lit(reason).alias("refused"), *[F.lit(None).cast(k).alias(c) for c, k in zip(columns, kinds)]
        )
    return report


def model_sha256(frozen: dict) -> str:
    return hashlib.sha256(json.dumps(frozen, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def prospective_report(
    calls: DataFrame, instances: DataFrame, frozen: dict, replicates: int = 2000, seed: int = 20260712,
    final: DataFrame | None = None,
) -> DataFrame:
    """One row. Fails when only one label occurs, as there is nothing to rank,
    and, given the study's state in ``final``, unless it is stopped and ready.
    Digests of the model and of the scored calls tell what was reported on."""
    if final is not None:
        require_final(final)
    rows = materialize(prediction_rows(calls, instances, frozen))
    base = M.score_metrics(rows).select(
        "*",
        F.when(
            (F.col("positives") == 0) | (F.col("positives") == F.col("n")) | (F.col("n") == 0),
            F.raise_error(F.lit("prospective analysis requires correct and silently wrong completions")),
        ).cast("int").alias("guard"),
    )
    area = M.auc(rows).select("auc")
    interval = M.clustered_interval(rows, replicates=replicates, seed=seed).drop("replicates")
    counts = S.study_status(calls, [])
    scored = rows.agg(content_digest(F.concat_ws("|", "call_id", "label")).alias("input_digest"))
    row = side_by_side(counts, base, area, interval, scored).where(F.col("guard").isNull())
    gated = row.select("*", *[F.coalesce(F.expr(c), F.lit(False)).alias(n) for n, c in GATE.items()])
    passed = F.col("brier_skill_at_least_0_10") & F.col("interval_excludes_zero") & F.col("auc_at_least_0_75")
    six = lambda c: F.round(c, 6).alias(c)
    return gated.select(
        F.when(passed, "Supported").otherwise("Not supported").alias("status"),
        "calls", "correct", "silent_wrong", "loud", "spend_usd", F.col("n").alias("completed_for_confidence"),
        six("brier"), F.round("prior_brier", 6).alias("curve_brier"), six("brier_skill"),
        six("ci_low"), six("ci_high"), six("log_loss"), six("auc"), *GATE, passed.alias("pass"),
        F.lit(replicates).cast("bigint").alias("bootstrap_replicates"), F.lit(model_sha256(frozen)).alias("frozen_model_sha256"), "input_digest",
    )
