"""Folds, out-of-fold training and forward holdout queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from callmetrics.functions import outcomes as O
from callmetrics.functions.scoring import FROZEN, metadata_features
from callmetrics.operators import metrics as M
from callmetrics.operators import training as TN
from callmetrics.plans.curve_queries import P_SQL, fit_sql
from callmetrics.plans.metric_queries import CALL_CTES, FEATURE_SQL, leveled
from callmetrics.plans.registry import query
from callmetrics.plans.status_queries import AFTER, MAIN
from callmetrics.plans.trace_queries import FEATURES_SQL, MARKERS, WORDS_SQL
from callmetrics.operators import traces as TR
from callmetrics.session import materialize, side_by_side
from callmetrics.sources import tables as T

FOLDS, SEED = 5, 20260712
METADATA = FROZEN["design"]["base_features"]


@query("me13_grouped_folds", ctes=(T.INSTANCES_SQL,), sql=f"""
SELECT instance_id, level_value, (row_number() OVER (PARTITION BY level_value ORDER BY ('0x' || substr(md5('{SEED}|' || instance_id), 1, 15))::BIGINT, instance_id) - 1) % {FOLDS} AS fold
FROM instances""")
def _(spark, d):
    return TN.grouped_folds(T.instances(spark, d), FOLDS, SEED)


def labelled(spark, d):
    done = leveled(spark, d).where(O.is_completed(F.col("outcome")))
    return done.select(
        "call_id", "instance_id", "stage", "level_value",
        F.when(F.col("outcome") == O.PASS, 1).otherwise(0).cast("bigint").alias("label"),
        *[c.cast("double").alias(n) for n, c in metadata_features(FROZEN).items()],
    )


def metrics_row(rows):
    return M.all_metrics(rows, []).select("n", *[F.round(c, 3).alias(c) for c in ("brier", "brier_skill", "log_loss", "auc")])


TRACE_FEATURES = list(TR.K.FEATURES)
CLASSES = {
    "metadata": METADATA, "traces": ["curve_logit", *TRACE_FEATURES], "combined": [*METADATA, *TRACE_FEATURES],
}
KEPT = ["call_id", "instance_id", "outcome", "level_value", "completion_tokens", "reasoning_tokens", "latency_ms", "attempt", "finish_reason"]


def trace_rows(spark, d):
    """Completed traces with label, fold, all features and the held-out curve."""
    made = TR.trace_features(T.traces(spark, d), MARKERS, KEPT).where(O.is_completed(F.col("outcome")))
    metadata = {n: c.cast("double") for n, c in metadata_features(FROZEN).items() if n != "curve_logit"}
    rows = made.select(
        "call_id", "instance_id", "level_value", F.when(F.col("outcome") == O.PASS, 1).otherwise(0).cast("bigint").alias("label"),
        *[c.alias(n) for n, c in metadata.items()], *TRACE_FEATURES,
    )
    folds = TN.grouped_folds(T.traces(spark, d), FOLDS, SEED).drop("level_value")
    return materialize(TN.with_held_out_curve(materialize(rows.join(folds, "instance_id")), FOLDS))


def trained(name):
    def run(spark, d):
        keep = ["call_id", "label", "curve_prior"]
        return metrics_row(materialize(TN.out_of_fold(trace_rows(spark, d), CLASSES[name], FOLDS, keep)))

    return run


FOLD_SQL = f"""tf AS (SELECT instance_id, (row_number() OVER (PARTITION BY level_value ORDER BY ('0x' || substr(md5('{SEED}|' || instance_id), 1, 15))::BIGINT, instance_id) - 1) % {FOLDS} AS fold
  FROM (SELECT DISTINCT instance_id, level_value FROM traces)),
tl AS (SELECT call_id, level_value, fold, CAST(outcome = 'pass' AS BIGINT) AS label FROM traces JOIN tf USING (instance_id) WHERE outcome IN ('pass', 'fail_wrong')),
oc AS (SELECT held AS fold, level_value, count(*) AS n, CAST(sum(label) AS BIGINT) AS k FROM tl, (SELECT unnest(range({FOLDS})) AS held) WHERE fold <> held GROUP BY 1, 2)"""


@query("me14_out_of_fold_curve", ctes=(T.TRACES_SQL, FOLD_SQL, fit_sql("o", "SELECT fold, level_value, n, k FROM oc", "fold")), sql=f"""
, sc AS (SELECT label, {P_SQL} AS p FROM tl JOIN fit_o USING (fold)),
hs AS (SELECT p, sum(label)::DOUBLE AS pos, sum(1 - label)::DOUBLE AS neg FROM sc GROUP BY p),
pr AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM hs),
au AS (SELECT sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)) AS auc FROM pr)
SELECT count(*) AS n, round(avg((label - p) * (label - p)), 3) AS brier, 0.0::DOUBLE AS brier_skill,
  round(avg(-(label * ln(p) + (1 - label) * ln(1.0 - p))), 3) AS log_loss, round(max(auc), 3) AS auc FROM sc, au""")
def _(spark, d):
    folds = TN.grouped_folds(T.traces(spark, d), FOLDS, SEED).drop("level_value")
    rows = T.traces(spark, d).where(O.is_completed(F.col("outcome"))).select(
        "call_id", "instance_id", "level_value", F.when(F.col("outcome") == O.PASS, 1).otherwise(0).cast("bigint").alias("label")
    ).join(folds, "instance_id")
    scored = TN.with_held_out_curve(materialize(rows), FOLDS).withColumn("prediction", F.col("curve_prior"))
    return metrics_row(materialize(scored))


STRENGTH, STEPS = 0.01, 500


def train_sql(features: list[str], held: str) -> str:
    """Predictions of the rows in ``tr`` (call_id, label, fold, curve_prior and
    features) by the models of the folds in ``held``: medians, flags and scales
    of the other folds' rows, then accelerated gradient steps on the same loss."""
    size = 2 * len(features) + 1
    steep = 0.25 * size + STRENGTH  # no direction is steeper
    slow = (1 - (STRENGTH / steep) ** 0.5) / (1 + (STRENGTH / steep) ** 0.5)
    columns = [*[f"x{i}" for i in range(len(features))], *[f"g{i}" for i in range(len(features))]]
    scaled = ", ".join(f"CASE WHEN d{c} > 1e-9 THEN ({c} - m{c}) / d{c} ELSE 0.0::DOUBLE END" for c in columns)
    moved = ", ".join(
        f"any_value(v)[{k}] - {1 / steep!r}::DOUBLE * (sum(r * x[{k}]) / count(*)" + (f" + {STRENGTH}::DOUBLE * any_value(v)[{k}])" if k < size else ")")
        for k in range(1, size + 1)
    )
    zeros = "[" + ", ".join(["0.0::DOUBLE"] * size) + "]"
    return f"""hd AS ({held}),
md AS MATERIALIZED (SELECT held, {', '.join(f'coalesce(quantile_cont({f}, 0.5), 0.0::DOUBLE) AS md{i}' for i, f in enumerate(features))} FROM tr, hd WHERE fold <> held GROUP BY held),
fl AS MATERIALIZED (SELECT call_id, label, fold, held, {', '.join(f'coalesce({f}, md{i}) AS x{i}, CAST({f} IS NULL AS INT)::DOUBLE AS g{i}' for i, f in enumerate(features))} FROM tr, md),
sd AS MATERIALIZED (SELECT held, {', '.join(f'avg({c}) AS m{c}, stddev_samp({c}) AS d{c}' for c in columns)} FROM fl WHERE fold <> held GROUP BY held),
xs AS MATERIALIZED (SELECT call_id, label, fold, held, [{scaled}, 1.0::DOUBLE] AS x FROM fl JOIN sd USING (held)),
it AS (SELECT 0 AS i, held, {zeros} AS w, {zeros} AS v FROM md UNION ALL
  SELECT i + 1, held, nw, list_transform(range(1, {size + 1}), lambda k: nw[k] + {slow!r}::DOUBLE * (nw[k] - w[k])) FROM (
    SELECT i, held, any_value(w) AS w, [{moved}] AS nw FROM (
      SELECT it.i, it.held, w, v, x, 1.0 / (1.0 + exp(-list_dot_product(x, v))) - label AS r FROM it JOIN xs ON xs.held = it.held AND xs.fold <> it.held WHERE it.i < {STEPS})
    GROUP BY i, held)),
sc AS (SELECT label, curve_prior, 1.0 / (1.0 + exp(-list_dot_product(x, w))) AS p FROM xs JOIN it USING (held)
  JOIN (SELECT call_id, curve_prior FROM tr) USING (call_id) WHERE xs.fold = xs.held AND it.i = {STEPS})"""


METRICS_SQL = """, hs AS (SELECT round(p, 9) AS p, sum(label)::DOUBLE AS pos, sum(1 - label)::DOUBLE AS neg FROM sc GROUP BY 1),
pr AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM hs),
au AS (SELECT sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)) AS auc FROM pr),
mt AS (SELECT count(*) AS n, round(avg((label - p) * (label - p)), 3) AS brier,
  round(1.0 - sum((label - p) * (label - p)) / sum((label - curve_prior) * (label - curve_prior)), 3) AS brier_skill,
  round(avg(-(label * ln(p) + (1 - label) * ln(1.0 - p))), 3) AS log_loss, round(max(auc), 3) AS auc FROM sc, au)
"""
# The traces' fields that only these queries read, from the documents they are made of.
TRACE_ROWS_SQL = f"""tr AS MATERIALIZED (SELECT tl.call_id, tl.label, tl.fold, {P_SQL} AS curve_prior, ln({P_SQL} / (1.0 - {P_SQL})) AS curve_logit,
  features.* EXCLUDE (call_id),
  ln(1.0 + traces.completion_tokens::DOUBLE) AS log_completion_tokens,
  CASE WHEN tl.call_id % 7 <> 0 THEN ln(1.0 + floor(n_chars / 4.0::DOUBLE)) END AS log_reasoning_tokens,
  traces.completion_tokens::DOUBLE / 65536.0 AS cap_fraction, ln(1.0 + latency_ms) AS log_latency_ms,
  CASE WHEN latency_ms > 0 THEN ln(1.0 + traces.completion_tokens::DOUBLE / (latency_ms / 1000.0)) END AS log_effective_billed_tps,
  (1 + tl.call_id % 3)::DOUBLE AS attempt, CASE WHEN tl.call_id % 11 = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS finish_stop,
  CASE WHEN tl.call_id % 11 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS finish_other
  FROM tl JOIN fit_o USING (fold) JOIN (SELECT * EXCLUDE (model_id, route, instance_id, outcome, level_value, completion_tokens) FROM features) features USING (call_id)
    JOIN (SELECT call_id, n_chars, latency_ms, completion_tokens FROM traces) traces USING (call_id))"""
FOLD_CTES = ("RECURSIVE " + T.TRACES_SQL, FOLD_SQL, fit_sql("o", "SELECT fold, level_value, n, k FROM oc", "fold"), WORDS_SQL, FEATURES_SQL)

for _name, _features in CLASSES.items():
    query(
        f"me14_out_of_fold_{_name}", ctes=(*FOLD_CTES, TRACE_ROWS_SQL, train_sql(_features, f"SELECT unnest(range({FOLDS})) AS held")),
        sql=METRICS_SQL + "SELECT * FROM mt",
    )(trained(_name))


HOLDOUT = [f for f in METADATA if f != "curve_logit"]
HOLDOUT_SQL = f"""lb AS (SELECT call_id, level_value, stage, CAST(outcome = 'pass' AS BIGINT) AS label, {', '.join(HOLDOUT)}
  FROM feats WHERE outcome IN ('pass', 'fail_wrong') AND stage IN ('{MAIN}', '{AFTER}'))"""
HOLDOUT_ROWS_SQL = f"""tr AS MATERIALIZED (SELECT call_id, label, CASE WHEN stage = '{MAIN}' THEN 0 ELSE 1 END AS fold, {P_SQL} AS curve_prior,
  ln({P_SQL} / (1.0 - {P_SQL})) AS curve_logit, {', '.join(HOLDOUT)} FROM lb, fit_w)"""


@query("me15_forward_stage_holdout", ctes=("RECURSIVE " + T.CALLS_SQL, *CALL_CTES[1:], FEATURE_SQL, HOLDOUT_SQL,
    fit_sql("w", f"SELECT 0 AS fit, level_value, count(*) AS n, CAST(sum(label) AS BIGINT) AS k FROM lb WHERE stage = '{MAIN}' GROUP BY level_value", "fit"),
    HOLDOUT_ROWS_SQL, train_sql(METADATA, "SELECT 1 AS held")), sql=METRICS_SQL + f"""
SELECT (SELECT count(*) FROM lb WHERE stage = '{MAIN}') AS n_train, (SELECT count(*) FROM lb WHERE stage = '{AFTER}') AS n_test,
  (SELECT count(*) FROM lb WHERE stage = '{AFTER}' AND label = 0) AS n_test_silent_wrong, * EXCLUDE (n) FROM mt""")
def _(spark, d):
    rows = materialize(labelled(spark, d).where(F.col("stage").isin(MAIN, AFTER)).drop("curve_logit"))
    train, test = (rows.where(F.col("stage") == s) for s in (MAIN, AFTER))
    scored = materialize(TN.forward_holdout(train, test, METADATA, ["call_id", "label", "curve_prior"]))
    counts = rows.agg(
        F.count_if(F.col("stage") == MAIN).alias("n_train"), F.count_if(F.col("stage") == AFTER).alias("n_test"),
        F.count_if((F.col("stage") == AFTER) & (F.col("label") == 0)).alias("n_test_silent_wrong"),
    )
    return side_by_side(counts, metrics_row(scored).drop("n"))
