"""Curve fits, thresholds, reliability, dispersion and efficiency queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from callmetrics.functions import scoring as X
from callmetrics.operators import curves as C
from callmetrics.operators.ordered import first_k
from callmetrics.functions.hashing import HASH_SPAN, uniform_long
from callmetrics.operators.ordered import uniform_points
from callmetrics.plans.metric_queries import CALL_CTES, leveled, sql_curve
from callmetrics.plans.registry import query
from callmetrics.plans.status_queries import AFTER, MAIN, MODEL
from callmetrics.session import materialize, parallelism
from callmetrics.sources import tables as T

LEVELED_SQL = "leveled AS (SELECT * FROM calls JOIN instances USING (instance_id))"


def cells_sql(keys: str, source: str = "leveled") -> str:
    return f"""SELECT {keys}, level_value, count(*) AS n, count(*) FILTER (WHERE outcome = 'pass') AS k
  FROM {source} WHERE outcome IN ('pass', 'fail_wrong') GROUP BY {keys}, level_value"""


P_SQL = "greatest(least((1.0 - lapse) / (1.0 + exp(-(a * (b - level_value)))), 1.0 - 1e-6::DOUBLE), 1e-6::DOUBLE)"
LL_SQL = f"round(sum(k * ln({P_SQL}) + (n - k) * ln(1.0 - {P_SQL})), 6)"


def around_sql(tag: str, keys: str, name: str, found: str, moves: int, lapse_moves: int, parts: float) -> str:
    """The best point of a grid around (b0, a0, lapse), as fx_<name>_<tag>."""
    return f"""fg_{name}_{tag} AS (SELECT {keys}, lo, hi, ib, ia, il, greatest(lapse + (il - {lapse_moves}) * {C.LAPSE_STEP / parts}::DOUBLE, 0.0::DOUBLE) AS lapse,
    greatest(least(b0 + (hi - lo) / {float(C.B_STEPS * C.FINE)}::DOUBLE * ((ib - {moves}) / {parts}::DOUBLE), hi), lo) AS b,
    a0 * pow({C.A_RATIO}::DOUBLE, (ia - {moves}) / {C.FINE * parts}::DOUBLE) AS a
  FROM {found}, (SELECT unnest(range({2 * moves + 1})) AS ib), (SELECT unnest(range({2 * moves + 1})) AS ia),
    (SELECT unnest(range({2 * lapse_moves + 1})) AS il)),
fl_{name}_{tag} AS (SELECT {keys}, ib, ia, il, any_value(lapse) AS lapse, any_value(b) AS b, any_value(a) AS a, any_value(lo) AS lo, any_value(hi) AS hi, {LL_SQL} AS ll
  FROM fg_{name}_{tag} JOIN fc_{tag} USING ({keys}) GROUP BY {keys}, ib, ia, il),
fx_{name}_{tag} AS (SELECT {keys}, lo, hi, b AS b0, a AS a0, lapse FROM (
  SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY ll DESC, b, a, lapse) AS rn FROM fl_{name}_{tag}) WHERE rn = 1)"""


def fit_sql(tag: str, cells: str, keys: str) -> str:
    """The same three grids as common table expressions ending in fit_<tag>."""
    return f"""fc_{tag} AS ({cells}),
fs_{tag} AS (SELECT {keys}, min(level_value) - 1.0 AS lo, max(level_value) + 1.0 AS hi FROM fc_{tag} GROUP BY {keys}),
fg_{tag} AS (SELECT *, lo + (hi - lo) * ib / {float(C.B_STEPS)}::DOUBLE AS b, {C.A_LOW}::DOUBLE * pow({C.A_RATIO}::DOUBLE, ia::DOUBLE) AS a
  FROM fs_{tag}, (SELECT unnest(range({C.B_STEPS + 1})) AS ib), (SELECT unnest(range({C.A_STEPS + 1})) AS ia),
       (SELECT unnest([{', '.join(f'{v}::DOUBLE' for v in C.LAPSES)}]) AS lapse)),
fl_{tag} AS (SELECT {keys}, ib, ia, lapse, any_value(b) AS b, any_value(a) AS a, any_value(lo) AS lo, any_value(hi) AS hi, {LL_SQL} AS ll
  FROM fg_{tag} JOIN fc_{tag} USING ({keys}) GROUP BY {keys}, ib, ia, lapse),
f0_{tag} AS (SELECT {keys}, lo, hi, b AS b0, a AS a0, lapse FROM (
  SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY ll DESC, b, a, lapse) AS rn FROM fl_{tag}) WHERE rn = 1),
{around_sql(tag, keys, "h", f"f0_{tag}", C.FINE, C.LAPSE_FINE, 1.0)},
{around_sql(tag, keys, "k", f"fx_h_{tag}", C.LAST, C.LAST, 2.0)},
fit_{tag} AS (SELECT {keys}, b0 AS b, a0 AS a, lapse, b0 - ln((0.5 / (1.0 - lapse)) / (1.0 - 0.5 / (1.0 - lapse))) / a0 AS x50 FROM fx_k_{tag})"""


MODEL_FIT = fit_sql("m", cells_sql("model_id"), "model_id")
STAGE_FIT = fit_sql("s", cells_sql("model_id, stage"), "model_id, stage")
SIX = ", ".join(f"round({c}, 6) AS {c}" for c in ("b", "a", "lapse", "x50"))
BASE = (*CALL_CTES, LEVELED_SQL)


def model_fits(spark, d, keys=("model_id",)):
    return C.fit_curves(C.level_cells(leveled(spark, d), list(keys)), list(keys))


@query("me10_curve_fit", ctes=(*BASE, MODEL_FIT), sql=f"SELECT model_id, {SIX} FROM fit_m")
def curve_fit(spark, d):
    return C.rounded(model_fits(spark, d), ["model_id"])


@query("me11_x50", ctes=(T.INSTANCES_SQL,), sql="""
SELECT level_value, round(level_value - ln((0.5 / (1.0 - lapse)) / (1.0 - 0.5 / (1.0 - lapse))) / a, 6) AS x50
FROM (SELECT DISTINCT level_value, level_value / 4.0 AS a, level_value / 100.0 AS lapse FROM instances)""")
def _(spark, d):
    levels = T.instances(spark, d).select("level_value").distinct()
    level = F.col("level_value")
    return levels.select("level_value", F.round(X.x50(level, level / 4.0, level / 100.0), 6).alias("x50"))


@query("ag12_token_curve", ctes=BASE, sql="""
SELECT model_id, level_value, count(*) AS n, round(avg(ln(completion_tokens)), 6) AS mean_log_tokens
FROM leveled WHERE completion_tokens > 0 GROUP BY 1, 2""")
def _(spark, d):
    return C.token_curve(leveled(spark, d), ["model_id"])


PEAK_SQL = """, tc AS (SELECT model_id, level_value, round(avg(ln(completion_tokens)), 6) AS m FROM leveled WHERE completion_tokens > 0 GROUP BY 1, 2),
pk AS (SELECT model_id, count(*) AS n_levels, max(level_value) AS top_level, arg_min(level_value, (-m, level_value)) AS peak_level FROM tc GROUP BY 1)
SELECT model_id, n_levels, peak_level, round(peak_level - x50, 6) AS offset_from_x50, peak_level = top_level AS censored
FROM pk JOIN fit_m USING (model_id)"""


@query("tk3_effort_peak", ctes=(*BASE, MODEL_FIT), sql=PEAK_SQL)
def _(spark, d):
    levels = C.token_curve(leveled(spark, d), ["model_id"])
    return C.peaks(levels, ["model_id"], "mean_log_tokens", model_fits(spark, d))


# As many as the reference draws by default.
REPLICATES = 2000
INTERVAL_SQL = f"""pi AS (SELECT model_id, instance_id, any_value(level_value) AS level_value, count(*) AS n,
    count(*) FILTER (WHERE outcome = 'pass') AS k, sum(CAST(round(ln(completion_tokens + 1) * 1e6, 0) AS BIGINT)) AS lt
  FROM leveled WHERE outcome IN ('pass', 'fail_wrong') GROUP BY model_id, instance_id),
px AS (SELECT *, row_number() OVER (ORDER BY ('0x' || substr(md5(instance_id), 1, 15))::BIGINT, instance_id) - 1 AS idx, count(*) OVER () AS cnt
  FROM (SELECT DISTINCT instance_id FROM pi)),
pd AS (SELECT rep, ('0x' || substr(md5('7|' || rep || '|' || draw), 1, 8))::BIGINT % (SELECT max(cnt) FROM px) AS idx
  FROM (SELECT unnest(range({REPLICATES})) AS rep), LATERAL (SELECT unnest(range((SELECT max(cnt) FROM px))) AS draw)),
pw AS (SELECT rep, idx, count(*) AS times FROM pd GROUP BY 1, 2),
pc AS (SELECT rep, model_id, level_value, sum(n * times) AS n, sum(k * times) AS k, sum(lt * times) AS lt
  FROM pw JOIN px USING (idx) JOIN pi USING (instance_id) GROUP BY 1, 2, 3)"""


@query("me12_curve_intervals", ctes=(*BASE, INTERVAL_SQL, fit_sql("r", "SELECT rep, model_id, level_value, n::BIGINT AS n, k::BIGINT AS k FROM pc", "rep, model_id")), sql="""
, pm AS (SELECT rep, model_id, level_value, round(lt::DOUBLE / n::DOUBLE / 1e6, 6) AS m FROM pc),
pp AS (SELECT rep, model_id, arg_min(level_value, (-m, level_value)) AS peak FROM pm GROUP BY rep, model_id),
al AS (SELECT *, round(peak - x50, 6) AS off FROM fit_r JOIN pp USING (rep, model_id)),
lg AS (SELECT model_id, 'x50' AS parameter, x50 AS value FROM al UNION ALL SELECT model_id, 'a', a FROM al UNION ALL SELECT model_id, 'b', b FROM al
  UNION ALL SELECT model_id, 'lapse', lapse FROM al UNION ALL SELECT model_id, 'peak', peak FROM al UNION ALL SELECT model_id, 'offset', off FROM al)
SELECT model_id, parameter, count(*) AS replicates, round(quantile_cont(value, 0.025), 6) AS ci_low, round(quantile_cont(value, 0.975), 6) AS ci_high
FROM lg GROUP BY model_id, parameter""")
def _(spark, d):
    return C.curve_intervals(leveled(spark, d), REPLICATES, 7, ["model_id"])


HALF_FIT = fit_sql("h", cells_sql("ms, half", "halved"), "ms, half")
HALVED_SQL = "halved AS (SELECT *, model_id || stage AS ms, ('0x' || substr(md5('11|' || instance_id), 1, 15))::BIGINT % 2 AS half FROM leveled)"


@query("me20_split_half", ctes=(*BASE, HALVED_SQL, HALF_FIT), sql="""
, w AS (SELECT ms, max(round(x50, 6)) FILTER (WHERE half = 0) AS xa, max(round(x50, 6)) FILTER (WHERE half = 1) AS xb FROM fit_h GROUP BY ms),
c AS (SELECT count(*) AS models, corr(xa, xb) AS r FROM w WHERE xa IS NOT NULL AND xb IS NOT NULL)
SELECT models, round(r, 4) AS pearson_r, round(2.0 * r / (1.0 + r), 4) AS spearman_brown FROM c""")
def _(spark, d):
    return C.split_half(leveled(spark, d).withColumn("ms", F.concat("model_id", "stage")), "ms", 11)


@query("me21_variance_split", ctes=(T.CALLS_SQL,), sql="""
, per AS (SELECT model_id, instance_id, count(*) AS k, avg((outcome = 'pass')::INT::DOUBLE) AS p FROM calls
  WHERE outcome IN ('pass', 'fail_wrong') GROUP BY 1, 2 HAVING count(*) >= 2),
s AS (SELECT model_id, count(*) AS n_instances, avg(k::DOUBLE / (k - 1) * p * (1 - p)) AS within,
  var_samp(p) - avg(k::DOUBLE / (k - 1) * p * (1 - p) / k) AS between_raw, avg(p) AS pbar FROM per GROUP BY 1),
b AS (SELECT *, greatest(between_raw, 0.0) AS between, within / (within + greatest(between_raw, 0.0)) AS share FROM s)
SELECT model_id, n_instances, round(within, 6) AS within, round(between_raw, 6) AS between_raw, round(between, 6) AS between,
  round(share, 6) AS within_share, round(1 - share, 6) AS icc, round(pbar, 6) AS pbar FROM b""")
def _(spark, d):
    return C.variance_split(T.calls(spark, d), ["model_id"], 2)


@query("me22_goodness_of_fit", ctes=(*BASE, MODEL_FIT), sql=f"""
SELECT model_id, count(*) AS levels, round(sum(pow(k - n * {P_SQL}, 2.0) / (n * {P_SQL} * (1.0 - {P_SQL}))), 4) AS x2
FROM fc_m JOIN fit_m USING (model_id) GROUP BY model_id""")
def _(spark, d):
    cells = C.level_cells(leveled(spark, d), ["model_id"])
    return C.goodness_of_fit(cells, C.fit_curves(cells, ["model_id"]), ["model_id"])


@query("me23_stage_drift", ctes=(*BASE, STAGE_FIT), sql=f"""
SELECT a.model_id, round(a.x50, 6) AS x50_before, round(b.x50, 6) AS x50_after, round(b.x50 - a.x50, 6) AS drift,
  abs(b.x50 - a.x50) <= 1.5 AS within_width FROM fit_s a JOIN fit_s b ON a.model_id = b.model_id
WHERE a.stage = '{MAIN}' AND b.stage = '{AFTER}'""")
def _(spark, d):
    two = leveled(spark, d).where(F.col("stage").isin(MAIN, AFTER))
    keys = ["model_id", "stage"]
    return C.stage_drift(C.fit_curves(C.level_cells(two, keys), keys), MAIN, AFTER, 1.5)


@query("me25_budget_elasticity", ctes=(*BASE, fit_sql("c", cells_sql("model_id, max_tokens"), "model_id, max_tokens")), sql=f"""
SELECT model_id, max_tokens, {SIX} FROM fit_c""")
def _(spark, d):
    keys = ["model_id", "max_tokens"]
    return C.rounded(C.fit_curves(C.level_cells(leveled(spark, d), keys), keys), keys)


WIDTH_SQL = """un AS (SELECT model_id AS model, y, sum(n) OVER (PARTITION BY model_id ORDER BY y)::BIGINT AS budget,
    sum(k) OVER (PARTITION BY model_id ORDER BY y)::BIGINT AS k FROM (
    SELECT model_id, stage AS y, count(*) AS n, count(*) FILTER (WHERE outcome = 'pass') AS k FROM calls GROUP BY 1, 2)),
uw AS (SELECT model, budget, 3.92::DOUBLE * sqrt((k::DOUBLE / budget) * (1.0 - k::DOUBLE / budget) / budget) AS width FROM un),
ad AS (SELECT model_id AS model, count(*) AS calls, 3.92::DOUBLE * sqrt(avg((outcome = 'pass')::INT) * (1.0 - avg((outcome = 'pass')::INT)) / (3 * count(*))) AS target
  FROM calls WHERE stage = 'stage-1996' GROUP BY 1)"""


@query("me24_efficiency_ratio", ctes=(T.CALLS_SQL, WIDTH_SQL), sql="""
, seg AS (SELECT model, budget AS lb, width AS lw, lead(budget) OVER w AS rb, lead(width) OVER w AS rw, row_number() OVER w AS rn FROM uw WINDOW w AS (PARTITION BY model ORDER BY budget)),
hit AS (SELECT ad.model, calls, target, arg_min(struct_pack(lb, lw, rb, rw), rn) AS h FROM ad LEFT JOIN seg ON seg.model = ad.model AND rw <= target GROUP BY 1, 2, 3),
e AS (SELECT model, min(budget) AS fb, max(budget) AS eb, arg_min(width, budget) AS fw FROM uw GROUP BY 1),
nd AS (SELECT hit.model, calls, target, CASE WHEN target >= fw THEN fb::DOUBLE WHEN h IS NULL THEN eb::DOUBLE
  ELSE exp(ln(h.lb) + (ln(target) - ln(h.lw)) / (ln(h.rw) - ln(h.lw)) * (ln(h.rb) - ln(h.lb))) END AS needed FROM hit JOIN e USING (model))
SELECT model, calls AS adaptive_calls, round(target, 6) AS adaptive_width, round(needed, 4) AS uniform_calls, round(needed / calls, 4) AS efficiency_ratio FROM nd""")
def _(spark, d):
    calls = T.calls(spark, d)
    by_stage = calls.groupBy("model_id", "stage").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("outcome") == "pass").alias("k")
    )
    # Stages are tens of rows per model.
    from pyspark.sql import Window
    upto = Window.partitionBy("model_id").orderBy("stage")
    p = F.col("k") / F.col("budget")
    uniform = by_stage.select(
        F.col("model_id").alias("model"), F.sum("n").over(upto).alias("budget"), F.sum("k").over(upto).alias("k")
    ).select("model", "budget", (F.lit(3.92) * F.sqrt(p * (1 - p) / F.col("budget"))).alias("width"))
    q = F.col("k") / F.col("n")
    adaptive = by_stage.where(F.col("stage") == MAIN).select(
        F.col("model_id").alias("model"), F.col("n").alias("calls"),
        (F.lit(3.92) * F.sqrt(q * (1 - q) / (3 * F.col("n")))).alias("width"),
    )
    return C.efficiency(uniform, adaptive)


@query("tk4_quota_sample", ctes=(T.CALLS_SQL,), sql="""
SELECT stage, model_id, call_id, rank, size FROM (SELECT stage, model_id, call_id,
  row_number() OVER (PARTITION BY stage, model_id ORDER BY ('0x' || substr(md5('5|' || call_id), 1, 15))::BIGINT, call_id) - 1 AS rank,
  count(*) OVER (PARTITION BY stage, model_id) AS size FROM calls) WHERE rank < 25""")
def _(spark, d):
    keyed = T.calls(spark, d).select("stage", "model_id", "call_id", uniform_long(F.lit(5), F.col("call_id")).alias("h"))
    points = uniform_points(0.0, HASH_SPAN, parallelism(spark))
    return first_k(keyed, "h", F.lit(25), ["stage", "model_id"], ["h", "call_id"], points).select(
        "stage", "model_id", "call_id", "rank", "size"
    )
