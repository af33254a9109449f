"""Threshold, policy, self-consistency and control queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from callmetrics.operators import pairing
from callmetrics.operators import routing as R
from callmetrics.plans.metric_queries import auc_sql
from callmetrics.plans.registry import query
from callmetrics.plans.store_queries import SHARED_SQL
from callmetrics.session import materialize
from callmetrics.sources import tables as T

FLIPPED_SQL = "flipped AS (SELECT lang, 1 - label AS label, round(1.0 - prediction, 6) AS score FROM predictions)"


def flipped(spark, d):
    return T.predictions(spark, d).select(
        "lang", (1 - F.col("label")).alias("label"), F.round(1.0 - F.col("prediction"), 6).alias("score")
    )


@query("tr11_frozen_threshold", ctes=(T.PREDICTIONS_SQL, FLIPPED_SQL), sql="""
SELECT lang, count(*) AS n,
  round(count(*) FILTER (WHERE score >= 0.6 AND label = 1)::DOUBLE / nullif(count(*) FILTER (WHERE label = 1), 0), 6) AS recall,
  round(count(*) FILTER (WHERE score >= 0.6 AND label = 0)::DOUBLE / nullif(count(*) FILTER (WHERE label = 0), 0), 6) AS fpr,
  round(count(*) FILTER (WHERE score >= 0.6)::DOUBLE / count(*), 6) AS escalation_rate FROM flipped GROUP BY lang""")
def _(spark, d):
    return R.threshold_confusion(flipped(spark, d), 0.6, ["lang"], "score")


THRESHOLDS = [0.0, 0.1, 0.3, 0.5, 0.7, 0.9]


@query("tr12_threshold_sweep", ctes=(T.PREDICTIONS_SQL, FLIPPED_SQL), sql=f"""
, s AS (SELECT threshold::DOUBLE AS threshold, round(count(*) FILTER (WHERE score >= threshold AND label = 1)::DOUBLE / count(*) FILTER (WHERE label = 1), 6) AS tpr,
  round(count(*) FILTER (WHERE score >= threshold AND label = 0)::DOUBLE / count(*) FILTER (WHERE label = 0), 6) AS fpr
  FROM flipped, (SELECT unnest([{', '.join(str(t) + '::DOUBLE' for t in THRESHOLDS)}]) AS threshold) GROUP BY 1)
SELECT *, round(0.3::DOUBLE * (1 - fpr) + 1.0::DOUBLE * (0.3::DOUBLE * fpr + (1 - 0.3::DOUBLE) * tpr), 6) AS expected_solve,
  round(0.041::DOUBLE + 0.226::DOUBLE * ((1 - 0.3::DOUBLE) * tpr + 0.3::DOUBLE * fpr), 6) AS expected_cost FROM s""")
def _(spark, d):
    return R.threshold_sweep(flipped(spark, d), THRESHOLDS, "score", 0.3, 1.0, 0.041, 0.226)


@query("tr13_self_signal", ctes=(T.CALLS_SQL, """tok AS (SELECT model_id, completion_tokens::DOUBLE AS tokens, CAST(outcome <> 'pass' AS BIGINT) AS label
  FROM calls WHERE outcome IN ('pass', 'fail_wrong'))"""), sql=f"""
SELECT model_id, positives::BIGINT AS n_fail, negatives::BIGINT AS n_pass, round(auc, 6) AS auc_tokens FROM ({auc_sql('tok', 'model_id', 'tokens')})""")
def _(spark, d):
    return R.self_signal(T.calls(spark, d))


def shared(spark, d):
    return pairing.shared_instances(T.calls(spark, d), "model-0", "model-1")


@query("tr13_transfer_signal", ctes=(SHARED_SQL, """tr AS (SELECT CAST(cheap_solved * 2 < cheap_calls AS BIGINT) AS label,
  cheap_tokens::DOUBLE / cheap_calls AS tokens, strong_solved * 2 >= strong_calls AS ok FROM shared)"""), sql=f"""
, a AS ({auc_sql('tr', '', 'tokens')})
SELECT count(*) AS n_shared_instances, CAST(sum(label) AS BIGINT) AS n_escalation_needed, count(*) FILTER (WHERE label = 1 AND ok) AS rescued,
  round(any_value(auc), 6) AS auc_cheap_tokens, round(count(*) FILTER (WHERE label = 1 AND ok)::DOUBLE / nullif(sum(label), 0)::DOUBLE, 6) AS rescue_fraction FROM tr, a""")
def _(spark, d):
    return R.transfer_signal(materialize(shared(spark, d)))


POLICY_SQL = """pr AS (SELECT cheap_solved::DOUBLE / cheap_calls AS p, strong_solved::DOUBLE / strong_calls AS q,
  cheap_cost::DOUBLE / cheap_calls AS c, strong_cost::DOUBLE / strong_calls AS s, cheap_tokens::DOUBLE / cheap_calls >= 25000 AS flag FROM shared),
pol AS (SELECT 'always_cheap' AS policy, p AS solve, c AS cost FROM pr UNION ALL SELECT 'always_strong', q, s FROM pr
  UNION ALL SELECT 'cheap_retry3', 1 - (1-p)*(1-p)*(1-p), c * (1 + (1-p) + (1-p)*(1-p)) FROM pr
  UNION ALL SELECT 'cascade_on_verify', p + (1-p)*q, c + (1-p)*s FROM pr
  UNION ALL SELECT 'cascade_on_token_signal_no_verifier', CASE WHEN flag THEN q ELSE p END, c + CASE WHEN flag THEN s ELSE 0.0 END FROM pr
  UNION ALL SELECT 'cascade_signal_plus_verifier', CASE WHEN flag THEN p + (1-p)*q ELSE 1 - (1-p)*(1-p) END, c + (1-p) * CASE WHEN flag THEN s ELSE c END FROM pr)"""


@query("tr14_policy_replay", ctes=(SHARED_SQL, POLICY_SQL), sql="""
SELECT policy, count(*) AS n_shared_instances, round(avg(solve), 6) AS solve_rate, round(avg(cost) / 1e6, 6) AS cost_per_instance_usd,
  round(avg(cost) / nullif(avg(solve), 0.0) / 1e6, 6) AS cost_per_solved_usd FROM pol GROUP BY policy""")
def policy_replay(spark, d):
    return R.policy_replay(shared(spark, d), 25_000.0)


def arms_sql(source: str, keys: str) -> str:
    return f"""SELECT {keys}, CAST(sum(solved) AS BIGINT) || '/' || count(*) AS solved, round(sum(solved)::DOUBLE / count(*), 6) AS solve_rate,
  round(sum(cost_microdollars)::DOUBLE / 1e6, 6) AS cost_usd, round(sum(cost_microdollars)::DOUBLE / nullif(sum(solved), 0)::DOUBLE / 1e6, 6) AS cost_per_solved_usd,
  round(avg(escalated), 6) AS escalation_rate FROM {source} GROUP BY {keys}"""


@query("tr15_arm_summary", ctes=(T.CALLS_SQL, """arms AS (SELECT stage AS family, model_id AS arm, CAST(outcome = 'pass' AS BIGINT) AS solved,
  CASE WHEN attempt > 1 THEN 1 ELSE 0 END AS escalated, cost_microdollars FROM calls)"""), sql=arms_sql("arms", "family, arm"))
def _(spark, d):
    rows = T.calls(spark, d).selectExpr(
        "stage AS family", "model_id AS arm", "CASE WHEN outcome = 'pass' THEN 1 ELSE 0 END AS solved",
        "CASE WHEN attempt > 1 THEN 1 ELSE 0 END AS escalated", "cost_microdollars",
    )
    return R.arm_summary(rows, ["family", "arm"])


AGREE_SQL = """ans AS (SELECT model_id, instance_id, parsed_answer, count(*) AS same, count(*) FILTER (WHERE outcome = 'pass') AS right_n
  FROM calls WHERE parsed_answer IS NOT NULL GROUP BY 1, 2, 3),
agr AS (SELECT *, CAST(sum(same) OVER (PARTITION BY model_id, instance_id) AS BIGINT) AS samples FROM ans),
agreed AS (SELECT model_id, instance_id, parsed_answer, samples, same AS calls, right_n, same - right_n AS wrong,
  round(1.0 - (same - 1)::DOUBLE / (samples - 1), 6) AS disagreement FROM agr WHERE samples >= 2)"""


@query("tr16_answer_agreement", ctes=(T.CALLS_SQL, AGREE_SQL), sql="""
SELECT model_id, instance_id, parsed_answer, samples, calls, right_n AS "right", wrong, disagreement FROM agreed""")
def _(spark, d):
    return R.agreement(T.calls(spark, d))


GATE_SQL = f"""au AS ({{auc}}),
sm AS (SELECT model_id, sum(calls) AS n, sum(wrong) AS wa, sum(right_n) AS ra, sum(wrong) FILTER (WHERE disagreement > 0) AS wf,
  sum(right_n) FILTER (WHERE disagreement > 0) AS rf, sum(calls) FILTER (WHERE disagreement > 0) AS fl,
  sum(right_n) FILTER (WHERE NOT disagreement > 0) AS rg, sum(calls) FILTER (WHERE NOT disagreement > 0) AS ag FROM agreed GROUP BY model_id)"""
HIST_AUC = """SELECT model_id, sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)) AS auc FROM (
  SELECT *, coalesce(sum(neg) OVER (PARTITION BY model_id ORDER BY disagreement ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS below
  FROM (SELECT model_id, disagreement, sum(wrong)::DOUBLE AS pos, sum(right_n)::DOUBLE AS neg FROM agreed GROUP BY 1, 2)) GROUP BY model_id"""


@query("tr16_tr17_consistency_gate", ctes=(T.CALLS_SQL, AGREE_SQL, GATE_SQL.replace("{auc}", HIST_AUC)), sql="""
SELECT model_id, CAST(n AS BIGINT) AS n_scored, round(auc, 6) AS auc, round(coalesce(wf, 0)::DOUBLE / wa::DOUBLE, 6) AS recall, round(coalesce(rf, 0)::DOUBLE / ra::DOUBLE, 6) AS fpr,
  round(coalesce(fl, 0)::DOUBLE / n::DOUBLE, 6) AS escalation_rate, round(rg::DOUBLE / ag::DOUBLE, 6) AS p_correct_given_agree,
  round(rf::DOUBLE / fl::DOUBLE, 6) AS p_correct_given_disagree FROM sm JOIN au USING (model_id)""")
def consistency(spark, d):
    return R.consistency_gate(materialize(R.agreement(T.calls(spark, d))))


@query("tr18_random_control", ctes=(SHARED_SQL, T.INSTANCES_SQL, """base AS (SELECT instance_id, level_idx, CAST(cheap_solved * 2 >= cheap_calls AS BIGINT) AS cok,
    CAST(strong_solved * 2 >= strong_calls AS BIGINT) AS sok, cheap_cost::DOUBLE / cheap_calls AS c, strong_cost::DOUBLE / strong_calls AS s,
    CAST(cheap_tokens::DOUBLE / cheap_calls >= 25000 AS BIGINT) AS flagged FROM shared JOIN instances USING (instance_id)),
dr AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY level_idx ORDER BY ('0x' || substr(md5('3|' || instance_id), 1, 15))::BIGINT, instance_id)
    <= sum(flagged) OVER (PARTITION BY level_idx) THEN 1 ELSE 0 END AS drawn FROM base),
arms AS (SELECT 'signal_router' AS arm, flagged AS escalated, CASE WHEN flagged = 1 THEN sok ELSE cok END AS solved,
    CAST(floor(c + CASE WHEN flagged = 1 THEN s ELSE 0.0 END) AS BIGINT) AS cost_microdollars FROM dr
  UNION ALL SELECT 'random_control', drawn, CASE WHEN drawn = 1 THEN sok ELSE cok END, CAST(floor(c + CASE WHEN drawn = 1 THEN s ELSE 0.0 END) AS BIGINT) FROM dr)"""), sql=arms_sql("arms", "arm"))
def _(spark, d):
    both = shared(spark, d).join(T.instances(spark, d).select("instance_id", "level_idx"), "instance_id")
    return R.routed_arms(materialize(both), 25_000.0, ["level_idx"], 3)


@query("tk4_rate_sample", ctes=(T.CALLS_SQL,), sql="""
SELECT stage, call_id FROM (SELECT stage, call_id, count(*) OVER (PARTITION BY stage) AS size,
  row_number() OVER (PARTITION BY stage ORDER BY ('0x' || substr(md5('9|' || call_id), 1, 15))::BIGINT, call_id) AS rn FROM calls) WHERE rn <= ceil(size * 0.05::DOUBLE)""")
def _(spark, d):
    rows = T.calls(spark, d).select("stage", "call_id", F.lit(0).alias("flagged"))
    return R.random_control(rows, ["stage"], "call_id", 9, rate=0.05).select("stage", "call_id")
