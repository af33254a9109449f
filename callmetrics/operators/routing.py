"""Routing analytics: thresholds, policies, self-consistency, random controls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callmetrics.functions import outcomes as O
from callmetrics.functions.hashing import HASH_SPAN, uniform_long
from callmetrics.operators import metrics as M
from callmetrics.operators.ordered import first_k, uniform_points
from callmetrics.session import parallelism, side_by_side


def share(hit: Column, of: Column) -> Column:
    return F.round(F.count_if(hit & of) / F.nullif(F.count_if(of), F.lit(0)), 6)


def threshold_confusion(rows: DataFrame, threshold: float, keys: Sequence[str], score: str) -> DataFrame:
    """``rows.label`` is one for a wrong call; scores at or above the frozen
    threshold are flagged."""
    flagged, wrong = F.col(score) >= threshold, F.col("label") == 1
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), share(flagged, wrong).alias("recall"), share(flagged, ~wrong).alias("fpr"),
        share(flagged, F.lit(True)).alias("escalation_rate"),
    )


def threshold_sweep(rows: DataFrame, thresholds: Sequence[float], score: str, cheap_solve: float, strong_solve: float, cheap_cost: float, strong_cost: float) -> DataFrame:
    """Expected solve rate and cost of escalating at each threshold. All
    thresholds are counted in one pass; the calls are not repeated."""
    wrong = F.col("label") == 1
    counts = rows.agg(
        *[share(F.col(score) >= t, wrong).alias(f"t{i}") for i, t in enumerate(thresholds)],
        *[share(F.col(score) >= t, ~wrong).alias(f"f{i}") for i, t in enumerate(thresholds)],
    )
    triples = ", ".join(f"{t}D, t{i}, f{i}" for i, t in enumerate(thresholds))
    long = counts.selectExpr(f"stack({len(thresholds)}, {triples}) AS (threshold, tpr, fpr)")
    p, s, t, f = F.lit(cheap_solve), F.lit(strong_solve), F.col("tpr"), F.col("fpr")
    escalated = (1 - p) * t + p * f
    return long.select(
        "threshold", "tpr", "fpr",
        F.round(p * (1 - f) + s * (p * f + (1 - p) * t), 6).alias("expected_solve"),
        F.round(F.lit(cheap_cost) + F.lit(strong_cost) * escalated, 6).alias("expected_cost"),
    )


def self_signal(calls: DataFrame) -> DataFrame:
    """Do failing calls of a model use more tokens? One AUC per model."""
    rows = calls.where(O.is_completed(F.col("outcome"))).select(
        "model_id", F.col("completion_tokens").cast("double").alias("tokens"),
        F.when(F.col("outcome") == O.PASS, 0).otherwise(1).cast("bigint").alias("label"),
    )
    out = M.auc(rows, ["model_id"], "tokens")
    return out.select(
        "model_id", F.col("positives").alias("n_fail"), F.col("negatives").alias("n_pass"),
        F.when(F.col("pairs") > 0, F.round("auc", 6)).alias("auc_tokens"),
    )


def solved(prefix: str) -> Column:
    """An instance counts as solved when at least half its calls are right."""
    return F.col(f"{prefix}_solved") * 2 >= F.col(f"{prefix}_calls")


def transfer_signal(shared: DataFrame) -> DataFrame:
    """Do the cheap model's tokens tell where the strong one is needed, and how
    often does the strong one then help?"""
    rows = shared.select(
        F.when(solved("cheap"), 0).otherwise(1).cast("bigint").alias("label"),
        (F.col("cheap_tokens") / F.col("cheap_calls")).alias("tokens"), solved("strong").alias("strong_ok"),
    )
    area = M.auc(rows, score="tokens").select(F.round("auc", 6).alias("auc_cheap_tokens"))
    counts = rows.agg(
        F.count(F.lit(1)).alias("n_shared_instances"), F.sum("label").alias("n_escalation_needed"),
        F.count_if((F.col("label") == 1) & F.col("strong_ok")).alias("rescued"),
    )
    return side_by_side(counts, area).select(
        "n_shared_instances", "n_escalation_needed", "rescued", "auc_cheap_tokens",
        F.round(F.col("rescued") / F.nullif(F.col("n_escalation_needed"), F.lit(0)), 6).alias("rescue_fraction"),
    )


def policy_replay(shared: DataFrame, token_threshold: float) -> DataFrame:
    """Closed-form solve rate and cost of six policies on shared instances."""
    p, q = F.col("cheap_solved") / F.col("cheap_calls"), F.col("strong_solved") / F.col("strong_calls")
    c, s = F.col("cheap_cost") / F.col("cheap_calls"), F.col("strong_cost") / F.col("strong_calls")
    flag = (F.col("cheap_tokens") / F.col("cheap_calls")) >= token_threshold
    miss = 1 - p
    policies = {
        "always_cheap": (p, c),
        "always_strong": (q, s),
        "cheap_retry3": (1 - miss * miss * miss, c * (1 + miss + miss * miss)),
        "cascade_on_verify": (p + miss * q, c + miss * s),
        "cascade_on_token_signal_no_verifier": (F.when(flag, q).otherwise(p), c + F.when(flag, s).otherwise(0.0)),
        "cascade_signal_plus_verifier": (
            F.when(flag, p + miss * q).otherwise(1 - miss * miss), c + miss * F.when(flag, s).otherwise(c),
        ),
    }
    sums = shared.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(solve).alias(f"s_{n}") for n, (solve, _) in policies.items()],
        *[F.avg(cost).alias(f"c_{n}") for n, (_, cost) in policies.items()],
    )
    triples = ", ".join(f"'{n}', s_{n}, c_{n}" for n in policies)
    long = sums.selectExpr("n", f"stack({len(policies)}, {triples}) AS (policy, solve, cost)")
    return long.select(
        "policy", F.col("n").alias("n_shared_instances"), F.round("solve", 6).alias("solve_rate"),
        F.round(F.col("cost") / 1e6, 6).alias("cost_per_instance_usd"),
        F.round(F.col("cost") / F.nullif(F.col("solve"), F.lit(0.0)) / 1e6, 6).alias("cost_per_solved_usd"),
    )


def arm_summary(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows(…keys, solved, escalated, cost_microdollars)``: 0/1 flags."""
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum("solved").cast("bigint").alias("solved"), F.sum("cost_microdollars").alias("micro"),
        F.round(F.avg("escalated"), 6).alias("escalation_rate"),
    ).select(
        *keys, F.concat("solved", F.lit("/"), "n").alias("solved"), F.round(F.col("solved") / F.col("n"), 6).alias("solve_rate"),
        F.round(F.col("micro") / 1e6, 6).alias("cost_usd"),
        F.round(F.col("micro") / F.nullif(F.col("solved"), F.lit(0)) / 1e6, 6).alias("cost_per_solved_usd"),
        "escalation_rate",
    )


def agreement(calls: DataFrame, keys: Sequence[str] = ("model_id", "instance_id")) -> DataFrame:
    """Graded disagreement of each answer with the other samples of its
    instance: one row per (keys, answer) with its right and wrong calls. Calls
    giving one answer share the value, so they are counted, not joined."""
    keys = list(keys)
    answers = calls.where(F.col("parsed_answer").isNotNull()).groupBy(*keys, "parsed_answer").agg(
        F.count(F.lit(1)).alias("same"), F.count_if(F.col("outcome") == O.PASS).alias("right")
    )
    sizes = answers.groupBy(*keys).agg(F.sum("same").alias("samples")).where("samples >= 2")
    return answers.join(sizes, keys).select(
        *keys, "parsed_answer", "samples", F.col("same").alias("calls"), "right", (F.col("same") - F.col("right")).alias("wrong"),
        F.round(1.0 - (F.col("same") - 1) / (F.col("samples") - 1), 6).alias("disagreement"),
    )


def consistency_gate(agreed: DataFrame, keys: Sequence[str] = ("model_id",)) -> DataFrame:
    """Any disagreement flags a call: recall on wrong calls, false alarms on
    right ones, and how far agreement can be trusted."""
    keys = list(keys)
    flagged = F.col("disagreement") > 0
    part = lambda name, cond: F.sum(F.when(cond, F.col(name)).otherwise(0)).alias
    ratio = lambda a, b: F.round(F.col(a) / F.nullif(F.col(b), F.lit(0)), 6)
    sums = agreed.groupBy(*keys).agg(
        F.sum("calls").alias("n"), F.sum("wrong").alias("wrong_all"), F.sum("right").alias("right_all"),
        part("wrong", flagged)("wrong_flagged"), part("right", flagged)("right_flagged"),
        part("calls", flagged)("flagged"), part("right", ~flagged)("right_agree"), part("calls", ~flagged)("agree"),
    )
    histogram = agreed.groupBy(*keys, F.col("disagreement").alias("score")).agg(
        F.sum("wrong").alias("pos"), F.sum("right").alias("neg")
    )
    area = M.histogram_auc(histogram, keys).select(*keys, F.when(F.col("pairs") > 0, F.round("auc", 6)).alias("auc"))
    return sums.join(area, keys).select(
        *keys, F.col("n").alias("n_scored"), "auc", ratio("wrong_flagged", "wrong_all").alias("recall"),
        ratio("right_flagged", "right_all").alias("fpr"), ratio("flagged", "n").alias("escalation_rate"),
        ratio("right_agree", "agree").alias("p_correct_given_agree"),
        ratio("right_flagged", "flagged").alias("p_correct_given_disagree"),
    )


def random_control(rows: DataFrame, strata: Sequence[str], identifier: str, seed: int, rate: float | None = None) -> DataFrame:
    """Rows a random router would escalate: in each stratum as many as are
    flagged (``flagged`` 0/1), or a share of the stratum when a rate is given."""
    keyed = rows.withColumn("__h", uniform_long(F.lit(seed), F.col(identifier)))
    points = uniform_points(0.0, HASH_SPAN, parallelism(rows.sparkSession))
    k = F.col("quota") if rate is None else F.ceil(F.col("size") * F.lit(rate))
    return first_k(keyed, "__h", k, strata, ["__h", identifier], points, quota="flagged").drop("__h")


def routed_arms(shared: DataFrame, token_threshold: float, strata: Sequence[str], seed: int) -> DataFrame:
    """The signal router and its quota-matched random control side by side."""
    base = shared.select(
        "instance_id", *strata, solved("cheap").cast("bigint").alias("cheap_ok"), solved("strong").cast("bigint").alias("strong_ok"),
        (F.col("cheap_cost") / F.col("cheap_calls")).alias("c"), (F.col("strong_cost") / F.col("strong_calls")).alias("s"),
        F.when(F.col("cheap_tokens") / F.col("cheap_calls") >= token_threshold, 1).otherwise(0).cast("bigint").alias("flagged"),
    )
    drawn = random_control(base, strata, "instance_id", seed).select("instance_id", F.lit(1).cast("bigint").alias("drawn"))
    both = base.join(drawn, "instance_id", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    arm = lambda name, flag: F.struct(
        F.lit(name).alias("arm"), F.col(flag).alias("escalated"),
        F.when(F.col(flag) == 1, F.col("strong_ok")).otherwise(F.col("cheap_ok")).alias("solved"),
        F.floor(F.col("c") + F.when(F.col(flag) == 1, F.col("s")).otherwise(0.0)).cast("bigint").alias("cost_microdollars"),
    )
    rows = both.select(F.inline(F.array(arm("signal_router", "flagged"), arm("random_control", "drawn"))))
    return arm_summary(rows, ["arm"])
