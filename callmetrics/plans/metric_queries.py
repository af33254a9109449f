"""Features, scores, calibration metrics and bootstrap queries."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from callmetrics.functions import outcomes as O
from callmetrics.functions import scoring as X
from callmetrics.operators import metrics as M
from callmetrics.operators import resampling as RS
from callmetrics.operators import status as S
from callmetrics.plans import report as R
from callmetrics.plans.registry import query
from callmetrics.plans.status_queries import (
    AFTER, BEFORE, CLASS_SQL, COUNTS_SQL, IN_STUDY, LIMITS, MAIN, MODEL, READY_SQL, STATUS_SQL, STOP_SQL, study,
)
from callmetrics.session import side_by_side, work_path
from callmetrics.sources import tables as T
from callmetrics.sources.files import load_frozen

CURVE = X.FROZEN["curve"]
SEED = 20260712
REPLICATES = 2000


def sql_curve(level: str, b: str, a: str, lapse: str) -> str:
    return (
        f"greatest(least((1.0 - {lapse}::DOUBLE) / (1.0 + exp(-({a}::DOUBLE * ({b}::DOUBLE - {level})))), 1.0 - 1e-6::DOUBLE), 1e-6::DOUBLE)"
    )


PRIOR_SQL = sql_curve("level_value", str(CURVE["b"]), str(CURVE["a"]), str(CURVE["lapse"]))
FEATURE_SQL = f"""feats AS (SELECT call_id, instance_id, outcome, stage, model_id, level_value, {PRIOR_SQL} AS prior,
  ln({PRIOR_SQL} / (1.0 - {PRIOR_SQL})) AS curve_logit,
  ln(1.0 + completion_tokens::DOUBLE) AS log_completion_tokens, ln(1.0 + reasoning_tokens::DOUBLE) AS log_reasoning_tokens,
  completion_tokens::DOUBLE / 65536.0 AS cap_fraction, ln(1.0 + latency_ms) AS log_latency_ms,
  CASE WHEN latency_ms > 0 THEN ln(1.0 + completion_tokens::DOUBLE / (latency_ms / 1000.0)) END AS log_effective_billed_tps,
  CASE WHEN coalesce(attempt, 0) = 0 THEN 1.0::DOUBLE ELSE attempt::DOUBLE END AS attempt,
  CASE WHEN finish_reason IN ('stop', 'completed') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS finish_stop,
  CASE WHEN finish_reason IN ('stop', 'completed') THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS finish_other
  FROM calls JOIN instances USING (instance_id))"""
FEATURES = X.FROZEN["design"]["base_features"]
SCORE_SQL = "1.0 / (1.0 + exp(-(" + repr(X.FROZEN["weights"][-1]) + "::DOUBLE" + "".join(
    f" + (coalesce({n}, {md!r}::DOUBLE) - {mean!r}::DOUBLE) / {scale!r}::DOUBLE * {w!r}::DOUBLE"
    for n, md, mean, scale, w in zip(
        FEATURES, X.FROZEN["design"]["medians"], X.FROZEN["design"]["means"], X.FROZEN["design"]["scales"],
        X.FROZEN["weights"],
    )
) + ")))"
SCORED_SQL = f"""scored AS (SELECT call_id, instance_id, stage, model_id, outcome, level_value AS difficulty,
  CAST((outcome = 'pass') AS BIGINT) AS label, {SCORE_SQL} AS prediction, prior AS curve_prior
  FROM feats WHERE outcome IN ('pass', 'fail_wrong'))"""
CALL_CTES = (T.CALLS_SQL, T.INSTANCES_SQL)


def leveled(spark, d):
    return T.calls(spark, d).join(T.instances(spark, d).select("instance_id", "level_value"), "instance_id")


@query("pr5_metadata_features", ctes=(*CALL_CTES, FEATURE_SQL), sql="SELECT call_id, " + ", ".join(
    f"round({n}, 6) AS {n}" for n in FEATURES) + " FROM feats")
def _(spark, d):
    return leveled(spark, d).select("call_id", *[F.round(c, 6).alias(n) for n, c in X.metadata_features(X.FROZEN).items()])


@query("pr6_finite_or_null", sql="""
SELECT event_id, CASE WHEN event_id % 5 IN (1, 2, 3, 4) THEN NULL ELSE value END AS number FROM events""")
def _(spark, d):
    text = F.expr(
        "CASE event_id % 5 WHEN 0 THEN cast(value AS string) WHEN 1 THEN 'NaN' WHEN 2 THEN 'Infinity' WHEN 3 THEN 'none' END"
    )
    return T.table(spark, d, "events").select("event_id", X.finite(text).alias("number"))


@query("me1_curve_probability", ctes=(T.INSTANCES_SQL,), sql=f"""
SELECT instance_id, round({PRIOR_SQL}, 6) AS curve_probability FROM instances""")
def _(spark, d):
    return T.instances(spark, d).select("instance_id", F.round(X.frozen_prior(X.FROZEN), 6).alias("curve_probability"))


@query("me2_frozen_prediction", ctes=(*CALL_CTES, FEATURE_SQL), sql=f"""
SELECT call_id, round({SCORE_SQL}, 6) AS prediction, round(prior, 6) AS curve_prior FROM feats""")
def _(spark, d):
    return leveled(spark, d).select(
        "call_id", F.round(X.frozen_score(X.FROZEN), 6).alias("prediction"),
        F.round(X.frozen_prior(X.FROZEN), 6).alias("curve_prior"),
    )


@query("sc6_frozen_model_source", ctes=(*CALL_CTES, FEATURE_SQL), sql=f"""
SELECT call_id, round({SCORE_SQL}, 6) AS prediction FROM feats WHERE {IN_STUDY}""")
def _(spark, d):
    path = work_path(spark, "frozen")
    spark.createDataFrame([(json.dumps(X.FROZEN, indent=1),)], "value string").coalesce(1).write.text(path)
    frozen = load_frozen(spark, path)
    return study(leveled(spark, d)).select("call_id", F.round(X.frozen_score(frozen), 6).alias("prediction"))


METRIC_SQL = """count(*) AS n, round(avg((label - prediction) * (label - prediction)), 6) AS brier,
  round(CASE WHEN avg((label - curve_prior) * (label - curve_prior)) = 0 THEN 'nan'::DOUBLE
    ELSE 1.0 - avg((label - prediction) * (label - prediction)) / avg((label - curve_prior) * (label - curve_prior)) END, 6) AS brier_skill,
  round(avg(-(label * ln(greatest(least(prediction, 1.0 - 1e-9::DOUBLE), 1e-9::DOUBLE))
    + (1 - label) * ln(1.0 - greatest(least(prediction, 1.0 - 1e-9::DOUBLE), 1e-9::DOUBLE)))), 6) AS log_loss"""


def auc_sql(source: str, keys: str = "", score: str = "prediction") -> str:
    """Window form of the rank statistic, for the check side only."""
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys} " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""SELECT {k}CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN
  sum(pos * (below + neg / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(neg)::DOUBLE) ELSE 'nan'::DOUBLE END AS auc,
  sum(pos) AS positives, sum(neg) AS negatives, sum(pos * (below + neg / 2.0::DOUBLE)) AS wins, sum(pos)::DOUBLE * sum(neg)::DOUBLE AS pairs
FROM (SELECT *, coalesce(sum(neg) OVER ({part}ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS below
  FROM (SELECT {k}{score} AS score, sum(label)::DOUBLE AS pos, sum(1 - label)::DOUBLE AS neg FROM {source}
        WHERE {score} IS NOT NULL GROUP BY {k}{score})) {group}"""


@query("me3_me5_brier_skill_log_loss", ctes=(T.PREDICTIONS_SQL,), sql=f"SELECT lang, {METRIC_SQL} FROM predictions GROUP BY lang")
def _(spark, d):
    out = M.score_metrics(T.predictions(spark, d), ["lang"])
    return out.select("lang", "n", *[F.round(c, 6).alias(c) for c in ("brier", "brier_skill", "log_loss")])


@query("me4_zero_baseline_skill", ctes=(T.PREDICTIONS_SQL,), sql="""
SELECT label, 'nan'::DOUBLE AS brier_skill FROM predictions GROUP BY label""")
def _(spark, d):
    exact = T.predictions(spark, d).withColumn("curve_prior", F.col("label").cast("double"))
    return M.score_metrics(exact, ["label"]).select("label", "brier_skill")


@query("me6_auc", ctes=(T.PREDICTIONS_SQL,), sql=f"""
SELECT positives::BIGINT AS positives, negatives::BIGINT AS negatives, round(auc, 6) AS auc FROM ({auc_sql('predictions')})""")
def _(spark, d):
    return M.auc(T.predictions(spark, d)).select("positives", "negatives", F.round("auc", 6).alias("auc"))


@query("me6_auc_calls", ctes=(*CALL_CTES, FEATURE_SQL, SCORED_SQL, "s6 AS (SELECT label, stage, model_id, round(prediction, 6) AS p FROM scored)"), sql=f"""
SELECT stage, model_id, round(auc, 6) AS auc FROM ({auc_sql('s6', 'stage, model_id', 'p')})""")
def auc_calls(spark, d):
    scored = leveled(spark, d).where(O.is_completed(F.col("outcome"))).select(
        "stage", "model_id", F.when(F.col("outcome") == O.PASS, 1).otherwise(0).cast("bigint").alias("label"),
        F.round(X.frozen_score(X.FROZEN), 6).alias("prediction"),
    )
    return M.auc(scored, ["stage", "model_id"]).select("stage", "model_id", F.round("auc", 6).alias("auc"))


def boot_sql(source: str, replicates: int, seed: int) -> str:
    return f"""cl AS (SELECT instance_id, sum((label - prediction) * (label - prediction)) AS e,
    sum((label - curve_prior) * (label - curve_prior)) AS e0 FROM {source} GROUP BY instance_id),
ci AS (SELECT *, row_number() OVER (ORDER BY ('0x' || substr(md5(instance_id), 1, 15))::BIGINT, instance_id) - 1 AS idx,
    count(*) OVER () AS k FROM cl),
dr AS (SELECT rep, ('0x' || substr(md5('{seed}|' || rep || '|' || draw), 1, 8))::BIGINT % (SELECT max(k) FROM ci) AS idx
  FROM (SELECT unnest(range({replicates})) AS rep), LATERAL (SELECT unnest(range((SELECT max(k) FROM ci))) AS draw)),
sk AS (SELECT rep, 1.0 - sum(e) / sum(e0) AS skill FROM dr JOIN ci USING (idx) GROUP BY rep),
boot AS (SELECT (SELECT max(k) FROM ci) AS clusters, count(*) AS replicates, quantile_cont(skill, 0.025) AS ci_low,
  quantile_cont(skill, 0.975) AS ci_high FROM sk)"""


@query("me7_cluster_bootstrap", ctes=(T.PREDICTIONS_SQL, boot_sql("predictions", REPLICATES, SEED)), sql="""
SELECT clusters, replicates, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high FROM boot""")
def _(spark, d):
    out = M.clustered_interval(T.predictions(spark, d), replicates=REPLICATES, seed=SEED)
    return out.select("clusters", "replicates", F.round("ci_low", 6).alias("ci_low"), F.round("ci_high", 6).alias("ci_high"))


@query("me7_split_bootstrap")
def _(spark, d):
    """The interval by splitting: no draw is a row. Every replicate draws as many clusters as there are."""
    out = RS.split_interval(T.predictions(spark, d), replicates=REPLICATES, seed=SEED)
    return out.select("clusters", "replicates", *[F.round(c, 6).alias(c) for c in ("ci_low", "ci_high")], "least_draws", "most_draws")


REPORT_CTES = (*CALL_CTES, FEATURE_SQL, SCORED_SQL,
    f"pred AS (SELECT * FROM scored WHERE {IN_STUDY})", boot_sql("pred", REPLICATES, SEED))
REPORT_SQL = f"""
, m AS (SELECT {METRIC_SQL}, round(avg((label - curve_prior) * (label - curve_prior)), 6) AS curve_brier FROM pred),
a AS (SELECT round(auc, 6) AS auc FROM ({auc_sql('pred')})),
c AS (SELECT count(*) AS calls, {COUNTS_SQL}, round(sum(cost_microdollars)::DOUBLE / 1e6, 6) AS spend_usd FROM calls WHERE {IN_STUDY}),
g AS (SELECT *, brier_skill >= 0.1 AS brier_skill_at_least_0_10, ci_low > 0 AS interval_excludes_zero, auc >= 0.75 AS auc_at_least_0_75
  FROM m, a, c, boot)
SELECT CASE WHEN brier_skill_at_least_0_10 AND interval_excludes_zero AND auc_at_least_0_75 THEN 'Supported' ELSE 'Not supported' END AS status,
  calls, correct, silent_wrong, loud, spend_usd, n AS completed_for_confidence, brier, curve_brier, brier_skill,
  round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, log_loss, auc,
  brier_skill_at_least_0_10, interval_excludes_zero, auc_at_least_0_75,
  brier_skill_at_least_0_10 AND interval_excludes_zero AND auc_at_least_0_75 AS pass, CAST({REPLICATES} AS BIGINT) AS bootstrap_replicates,
  '{R.model_sha256(X.FROZEN)}' AS frozen_model_sha256, input_digest FROM g,
  (SELECT {" || ':' || ".join(f"sum(('0x' || substr(sha256(call_id || '|' || label), {at}, 15))::BIGINT)::VARCHAR" for at in (1, 16, 31, 46))} AS input_digest FROM pred)"""


@query("me8_prospective_report", ctes=REPORT_CTES, sql=REPORT_SQL)
def report(spark, d):
    return R.prospective_report(study(T.calls(spark, d)), T.instances(spark, d), X.FROZEN, replicates=REPLICATES, seed=SEED)


def guard_sql(main_ready: str) -> str:
    """The report of the study, if it has stopped and is ready by ``main_ready``."""
    head, tail = REPORT_SQL.rsplit("\nSELECT CASE WHEN", 1)
    return head + f""",
rp AS (SELECT CASE WHEN{tail}),
st AS (SELECT s.*, {STOP_SQL} AS stop_reason FROM ({STATUS_SQL}) s WHERE {IN_STUDY}),
gd AS (SELECT CASE WHEN (SELECT any_value(stop_reason) FROM st) IS NULL THEN '{R.NOT_STOPPED}'
  WHEN NOT {main_ready} THEN '{R.NOT_READY}' END AS refused)
SELECT refused, """ + ", ".join(
        f"CASE WHEN refused IS NULL THEN {c} END AS {c}" for c in ("status", "completed_for_confidence", "brier_skill", "ci_low", "ci_high", "auc", "pass")
    ) + " FROM gd, rp"


def guarded(spark, d, before, calls_each):
    calls = T.calls(spark, d)
    ready = S.protocol_readiness(S.route_status(calls), MAIN, before, AFTER, calls_each).where(F.col("model_id") == MODEL).select("ready")
    state = S.should_stop(S.study_status(study(calls)), LIMITS).select("stop_reason")
    return R.guarded_report(study(calls), T.instances(spark, d), X.FROZEN, side_by_side(state, ready), REPLICATES, SEED)


READY = f"(SELECT any_value(ready) FROM ({READY_SQL}) WHERE model_id = '{MODEL}')"


@query("me8_guarded_report", ctes=REPORT_CTES, sql=guard_sql(READY))
def _(spark, d):
    """The report, unless the study goes on or its route has not held."""
    return guarded(spark, d, BEFORE, 10)


@query("me8_open_report", ctes=REPORT_CTES, sql=guard_sql("(SELECT count(*) >= 0 FROM st)"))
def _(spark, d):
    """The same where only the stopping rule is asked, so that the report is given once it has stopped."""
    calls = T.calls(spark, d)
    state = S.should_stop(S.study_status(study(calls)), LIMITS).select("stop_reason", F.lit(True).alias("ready"))
    return R.guarded_report(study(calls), T.instances(spark, d), X.FROZEN, state, REPLICATES, SEED)



SCORES = {"curve": "curve_prior", "metadata": "prediction", "trace": "trace_score", "combined": "(prediction + trace_score) / 2.0D"}
LONG_SQL = """wide AS (SELECT *, CAST(1 + (n_chars * 31 + call_id * 17) % 89 AS DOUBLE) / 100.0 AS trace_score FROM predictions),
long AS (SELECT call_id, label, curve_prior, 'curve' AS model, curve_prior AS prediction FROM wide
  UNION ALL SELECT call_id, label, curve_prior, 'metadata', prediction FROM wide
  UNION ALL SELECT call_id, label, curve_prior, 'trace', trace_score FROM wide
  UNION ALL SELECT call_id, label, curve_prior, 'combined', (prediction + trace_score) / 2.0::DOUBLE FROM wide)"""
AUDIT_SQL = f"""audit AS (SELECT * FROM (SELECT model, {METRIC_SQL} FROM long GROUP BY model)
  JOIN (SELECT model, round(auc, 6) AS auc FROM ({auc_sql('long', 'model')})) USING (model))"""


def audit(spark, d):
    wide = T.predictions(spark, d).withColumn("trace_score", F.expr("(1 + (n_chars * 31 + call_id * 17) % 89) / 100.0D"))
    return M.all_metrics(M.unpivot_scores(wide, SCORES, ["label", "curve_prior"]), ["model"])


@query("me9_retrospective_audit", ctes=(T.PREDICTIONS_SQL, LONG_SQL, AUDIT_SQL), sql="SELECT model, n, brier, brier_skill, log_loss, auc FROM audit")
def _(spark, d):
    return audit(spark, d)


@query("jn10_metric_comparison", ctes=(T.PREDICTIONS_SQL, LONG_SQL, AUDIT_SQL), sql="""
, l AS (SELECT model, 'brier' AS metric, brier AS calculated FROM audit UNION ALL SELECT model, 'brier_skill', brier_skill FROM audit
  UNION ALL SELECT model, 'log_loss', log_loss FROM audit UNION ALL SELECT model, 'auc', auc FROM audit),
e AS (SELECT model, metric, calculated, CASE WHEN model = 'trace' AND metric = 'auc' THEN round(calculated + 0.01, 6) ELSE calculated END AS expected FROM l)
SELECT model, metric, calculated, expected, abs(calculated - expected) <= 1e-6 AS matches FROM e""")
def _(spark, d):
    calculated = audit(spark, d)
    expected = calculated.withColumn(
        "auc", F.when(F.col("model") == "trace", F.round(F.col("auc") + 0.01, 6)).otherwise(F.col("auc"))
    )
    return M.compare_metrics(calculated, expected, ["brier", "brier_skill", "log_loss", "auc"])


@query("me16_best_class_gate", ctes=(T.PREDICTIONS_SQL, LONG_SQL, AUDIT_SQL), sql="""
, g AS (SELECT *, (SELECT count(*) FROM predictions WHERE label = 0) AS silent FROM audit WHERE model <> 'curve'),
b AS (SELECT * FROM g ORDER BY brier_skill DESC, model LIMIT 1)
SELECT model, brier_skill, auc, silent >= 20 AS at_least_20_silent_wrong, auc >= 0.75 AS auc_at_least_0_75,
  brier_skill >= 0.1 AS brier_skill_at_least_0_10, silent >= 20 AND auc >= 0.75 AND brier_skill >= 0.1 AS pass FROM b""")
def _(spark, d):
    from callmetrics.operators.training import best_class
    silent = T.predictions(spark, d).agg(F.count_if(F.col("label") == 0).alias("silent"))
    return best_class(audit(spark, d).where("model <> 'curve'"), silent)


@query("me17_reliability_bins", ctes=(T.PREDICTIONS_SQL,), sql="""
SELECT CAST(least(floor(prediction * 10), 9) AS BIGINT) AS bin, count(*) AS n, round(avg(prediction), 6) AS mean_prediction,
  round(avg(label), 6) AS observed FROM predictions GROUP BY 1""")
def _(spark, d):
    return M.reliability_bins(T.predictions(spark, d), 10)


# Newton steps on the two parameters.
LINE_SQL = f"""WITH RECURSIVE {T.PREDICTIONS_SQL},
xy AS (SELECT label::DOUBLE AS y, ln(q / (1.0 - q)) AS x FROM (SELECT label, greatest(least(prediction, 1.0 - 1e-9::DOUBLE), 1e-9::DOUBLE) AS q FROM predictions)),
steps AS (
  SELECT 0 AS i, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b
  UNION ALL
  SELECT i + 1, a + (h22 * g1 - h12 * g2) / (h11 * h22 - h12 * h12), b + (h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12)
  FROM (SELECT i, a, b, sum(y - p) AS g1, sum((y - p) * x) AS g2, sum(p * (1 - p)) AS h11, sum(p * (1 - p) * x) AS h12, sum(p * (1 - p) * x * x) AS h22
    FROM (SELECT i, a, b, x, y, 1.0 / (1.0 + exp(-(a + b * x))) AS p FROM steps, xy WHERE i < 25) GROUP BY i, a, b))
SELECT round(a, 4) AS intercept, round(b, 4) AS slope FROM steps WHERE i = 25"""


@query("me17_calibration_line", sql=LINE_SQL)
def _(spark, d):
    return M.calibration_line(T.predictions(spark, d))


TC_SQL = """tc AS (SELECT score AS threshold, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS positives, sum(neg) OVER () AS negatives
  FROM (SELECT prediction AS score, sum(label) AS pos, sum(1 - label) AS neg FROM predictions GROUP BY 1)
  WINDOW w AS (ORDER BY score DESC))"""


@query("me18_precision_recall", ctes=(T.PREDICTIONS_SQL, TC_SQL), sql="""
SELECT threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, round(tp::DOUBLE / (tp + fp), 6) AS precision, round(tp::DOUBLE / positives, 6) AS recall FROM tc""")
def _(spark, d):
    return M.precision_recall(T.predictions(spark, d))


@query("tr10_youden_threshold", ctes=(T.PREDICTIONS_SQL, TC_SQL), sql="""
SELECT threshold, round(tp::DOUBLE / positives, 6) AS tpr, round(fp::DOUBLE / negatives, 6) AS fpr,
  round(tp::DOUBLE / positives - fp::DOUBLE / negatives, 6) AS youden_j FROM tc
ORDER BY tp * negatives - fp * positives DESC, threshold LIMIT 1""")
def _(spark, d):
    return M.youden_threshold(T.predictions(spark, d))


COVER_SQL = """, r AS (SELECT *, row_number() OVER (ORDER BY prediction DESC, call_id) AS rn, count(*) OVER () AS total FROM predictions)
SELECT coverage::DOUBLE AS coverage, count(*) AS n, round(avg(label), 6) AS accuracy, round(avg(prediction), 6) AS mean_confidence{cost}
FROM r, (VALUES (0.25), (0.5), (0.75), (1.0)) v(coverage) WHERE rn <= ceil(coverage * total) GROUP BY 1"""
COVERAGES = [0.25, 0.5, 0.75, 1.0]


@query("tk2_risk_coverage", ctes=(T.PREDICTIONS_SQL,), sql=COVER_SQL.format(cost=""))
def _(spark, d):
    return M.coverage(T.predictions(spark, d), COVERAGES)


@query("me19_cost_coverage", ctes=(T.PREDICTIONS_SQL,), sql=COVER_SQL.format(cost=", CAST(sum(n_chars) AS BIGINT) AS cost"))
def _(spark, d):
    return M.coverage(T.predictions(spark, d).withColumnRenamed("n_chars", "cost"), COVERAGES, cost="cost")


AUDIT_FEATURES = ["completion_tokens", "reasoning_tokens", "latency_ms", "effective_billed_tps"]
BILLED_SQL = f"""billed AS (SELECT {CLASS_SQL} AS class, completion_tokens, reasoning_tokens, latency_ms,
  CASE WHEN latency_ms <> 0 THEN completion_tokens::DOUBLE / (latency_ms / 1000.0) END AS effective_billed_tps
  FROM calls WHERE outcome IN ('pass', 'fail_wrong'))"""


def billed(spark, d):
    """The audit form of billed rate: only a NULL or zero latency is left out."""
    return T.calls(spark, d).where(O.is_completed(F.col("outcome"))).select(
        O.outcome_class(F.col("outcome")).alias("class"), "completion_tokens", "reasoning_tokens", "latency_ms",
        F.when(F.col("latency_ms") != 0, F.col("completion_tokens") / (F.col("latency_ms") / 1000.0)).alias("effective_billed_tps"),
    )


@query("ag5_features_by_outcome", ctes=(T.CALLS_SQL, BILLED_SQL), sql=" UNION ALL ".join(
    f"SELECT class, '{f}' AS feature, count({f}) AS n, round(avg({f}), 6) AS mean FROM billed GROUP BY class" for f in AUDIT_FEATURES))
def _(spark, d):
    return M.feature_summary(billed(spark, d), AUDIT_FEATURES, ["class"])


@query("ag11_feature_medians", ctes=(T.CALLS_SQL, BILLED_SQL), sql=" UNION ALL ".join(
    f"SELECT class, '{f}' AS feature, count({f}) AS n, round(quantile_cont({f}::DOUBLE, 0.5), 6) AS median FROM billed GROUP BY class" for f in AUDIT_FEATURES))
def _(spark, d):
    return M.feature_medians(billed(spark, d), AUDIT_FEATURES, ["class"])


# A class whose feature is never known keeps its row.
BLANKED_SQL = "blanked AS (SELECT class, CASE WHEN class = 'correct_completed' THEN NULL ELSE completion_tokens END AS completion_tokens FROM billed)"


@query("ag11_empty_group", ctes=(T.CALLS_SQL, BILLED_SQL, BLANKED_SQL), sql="""
SELECT class, 'completion_tokens' AS feature, count(completion_tokens) AS n, round(quantile_cont(completion_tokens::DOUBLE, 0.5), 6) AS median
FROM blanked GROUP BY class""")
def _(spark, d):
    blanked = billed(spark, d).withColumn("completion_tokens", F.when(F.col("class") != "correct_completed", F.col("completion_tokens")))
    return M.feature_medians(blanked, ["completion_tokens"], ["class"])
