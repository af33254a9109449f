"""Trace-text queries. The given prose is invented, so the markers are words
that occur in it; the features do not depend on which words are meant."""

from __future__ import annotations

from pyspark.sql import functions as F

from callmetrics.functions import texts as X
from callmetrics.operators import curves as C
from callmetrics.operators import resampling as RS
from callmetrics.operators import status as S
from callmetrics.operators import traces as TR
from callmetrics.plans.curve_queries import cells_sql, fit_sql
from callmetrics.plans.registry import query
from callmetrics.session import materialize
from callmetrics.sources import tables as T

MARKERS = {
    "backtrack": ("of", "la", "die", "von"), "wait": ("and", "et", "und", "y"), "hedge": ("is", "le", "den", "el"),
    "giveup": ("that", "des", "mit"), "flip": ("it", "un", "que"), "negative": ("to", "les", "zu", "del"),
}
WORDS = """list_filter(string_split_regex(replace(translate(lower({0}), '.,;:!()|"', '         '), '?', ' ? '), '[ \\t\\n\\r\\f]+'), lambda x: x <> '')"""
WORDS_SQL = f"""w0 AS (SELECT * EXCLUDE (reasoning_text, response_text), {WORDS.format('reasoning_text')} AS w, {WORDS.format('response_text')} AS answer,
    length(reasoning_text) + length(response_text) AS chars FROM traces),
worded AS (SELECT *, len(w) AS n, w[CAST(floor(len(w) * 0.7::DOUBLE) AS BIGINT) + 1:] AS tail,
    list_concat(w[CAST(floor(len(w) * 0.85::DOUBLE) AS BIGINT) + 1:], answer) AS hedge_region,
    w[CAST(floor(len(w) * 0.9::DOUBLE) AS BIGINT) + 1:] AS last10 FROM w0)"""


def listed(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def dens(window: str, words) -> str:
    return f"round(CASE WHEN len({window}) = 0 THEN 0.0::DOUBLE ELSE len(list_filter({window}, lambda x: x IN {listed(words)})) * 1000.0::DOUBLE / len({window}) END, 6)"


def rep(window: str, k: int) -> str:
    made = f"[array_to_string({window}[i:i + {k - 1}], ' ') for i in range(1, len({window}) - {k - 2})]"
    return f"round(CASE WHEN len({window}) < {k} THEN 0.0::DOUBLE ELSE (len({window}) - {k - 1} - len(list_distinct({made})))::DOUBLE / (len({window}) - {k - 1}) END, 6)"


M = MARKERS
FEATURES_SQL = f"""features AS (SELECT call_id, model_id, route, instance_id, outcome, level_value, completion_tokens,
  {rep('tail', 6)} AS rep_tail, {dens('tail', M['backtrack'])} AS bt_tail, {dens('hedge_region', M['hedge'])} AS hedge_tail,
  {rep('w', 6)} AS rep_full, {dens('w', M['backtrack'])} AS bt_full, {dens('tail', M['wait'])} AS wait_tail,
  {dens('answer', M['hedge'])} AS hedge_ans, {dens('w', M['giveup'])} AS giveup_full, {dens('w', M['flip'])} AS flip,
  {dens('tail', ('?',))} AS qmark_tail, {rep('tail', 4)} AS rep_tail_k4, {dens('w', M['wait'])} AS wait_full,
  {dens('last10', M['backtrack'])} AS bt_last10, {dens('tail', M['negative'])} AS neg_tail,
  round(CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE len(answer)::DOUBLE / n END, 6) AS len_ratio,
  CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS trace_visible FROM worded)"""
CTES = (T.TRACES_SQL, WORDS_SQL, FEATURES_SQL)
KEEP = ["call_id", "model_id", "route", "instance_id", "outcome", "level_value", "completion_tokens"]


def features(spark, d):
    return TR.trace_features(T.traces(spark, d), MARKERS, KEEP)


@query("tr1_trace_features", ctes=CTES, sql="SELECT * EXCLUDE (model_id, route, instance_id, outcome, level_value, completion_tokens) FROM features")
def trace_features(spark, d):
    return features(spark, d).drop("model_id", "route", "instance_id", "outcome", "level_value", "completion_tokens")


@query("tr2_repetition", ctes=(T.TRACES_SQL, WORDS_SQL), sql=f"""
SELECT call_id, {rep('w', 4)} AS repetition FROM worded""")
def _(spark, d):
    return TR.trace_repetition(T.traces(spark, d), ["call_id"])


@query("ag13_trace_availability", ctes=(T.TRACES_SQL, WORDS_SQL), sql="""
SELECT model_id, route, count(*) AS n, CAST(round(avg(completion_tokens), 0) AS BIGINT) AS avg_billed_tokens,
  round(avg(chars / 3.7::DOUBLE / completion_tokens), 3) AS delivered_share FROM worded GROUP BY 1, 2""")
def _(spark, d):
    return TR.trace_availability(T.traces(spark, d))


# Right and silently wrong traces only; the wrong ones are the positives.
RANKED_SQL = "ranked AS (SELECT *, CAST(outcome = 'fail_wrong' AS BIGINT) AS label FROM features WHERE outcome IN ('pass', 'fail_wrong'))"


def strat_sql(keys: str, strata: str, score: str) -> str:
    return f"""hist AS (SELECT {keys}, {strata}, {score} AS score, sum(label)::DOUBLE AS pos, sum(1 - label)::DOUBLE AS neg FROM ranked GROUP BY ALL),
pre AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY {keys}, {strata} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM hist),
per AS (SELECT {keys}, {strata}, sum(pos * (below + neg / 2.0)) AS wins, sum(pos) * sum(neg) AS pairs FROM pre GROUP BY {keys}, {strata})"""


def ranking_rows(spark, d):
    # Only a few numbers per trace are kept, so the text is read once.
    rows = features(spark, d).where(F.col("outcome").isin("pass", "fail_wrong")).select(
        "model_id", "route", "instance_id", "level_value", "bt_tail", "hedge_tail",
        F.when(F.col("outcome") == "fail_wrong", 1).otherwise(0).cast("bigint").alias("label"),
    )
    return materialize(rows.withColumn("stratum", F.lit("all")))


STRAT_RESULT = """SELECT model_id, count(*) FILTER (WHERE pairs > 0) AS strata, CAST(sum(pairs) AS BIGINT) AS n_pairs,
  CASE WHEN sum(pairs) > 0 THEN round(sum(wins) / sum(pairs), 6) END AS auc FROM per GROUP BY model_id"""
LEVELS_SQL = "ranked AS (SELECT *, CAST(outcome = 'fail_wrong' AS BIGINT) AS label FROM features WHERE outcome IN ('pass', 'fail_wrong'))"


@query("tr3_stratified_auc", ctes=(*CTES, RANKED_SQL, strat_sql("model_id", "level_value, route", "bt_tail")), sql=STRAT_RESULT)
def _(spark, d):
    return TR.stratified_auc(ranking_rows(spark, d), ["model_id"], ["level_value", "route"], "bt_tail")


REPLICATES = 2000
RESAMPLED_SQL = f"""cl AS (SELECT instance_id, row_number() OVER (ORDER BY ('0x' || substr(md5(instance_id), 1, 15))::BIGINT, instance_id) - 1 AS idx, count(*) OVER () AS k
  FROM (SELECT DISTINCT instance_id FROM ranked)),
dr AS (SELECT rep, ('0x' || substr(md5('20260712|' || rep || '|' || draw), 1, 8))::BIGINT % (SELECT max(k) FROM cl) AS idx
  FROM (SELECT unnest(range({REPLICATES})) AS rep), LATERAL (SELECT unnest(range((SELECT max(k) FROM cl))) AS draw)),
wt AS (SELECT rep, idx, count(*) AS times FROM dr GROUP BY 1, 2),
wh AS (SELECT rep, model_id, level_value, route, bt_tail AS score, sum(label * times)::DOUBLE AS pos, sum((1 - label) * times)::DOUBLE AS neg
  FROM wt JOIN cl USING (idx) JOIN ranked USING (instance_id) GROUP BY ALL),
pr AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY rep, model_id, level_value, route ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM wh),
pg AS (SELECT rep, model_id, level_value, route, sum(pos * (below + neg / 2.0)) AS wins, sum(pos) * sum(neg) AS pairs FROM pr GROUP BY rep, model_id, level_value, route),
ar AS (SELECT rep, model_id, sum(wins) / nullif(sum(pairs), 0) AS auc FROM pg GROUP BY rep, model_id)"""


@query("tr3_stratified_auc_interval", ctes=(*CTES, RANKED_SQL, RESAMPLED_SQL), sql="""
SELECT model_id, count(auc) AS replicates, round(quantile_cont(auc, 0.025), 6) AS ci_low, round(quantile_cont(auc, 0.975), 6) AS ci_high FROM ar GROUP BY model_id""")
def _(spark, d):
    return TR.stratified_auc_interval(ranking_rows(spark, d), ["level_value", "route"], "bt_tail", "instance_id", REPLICATES, 20260712, ["model_id"])


@query("tr3_split_interval")
def _(spark, d):
    """The interval by splitting, for numbers of instances that can't be drawn one by one."""
    return TR.stratified_auc_interval(
        ranking_rows(spark, d), ["level_value", "route"], "bt_tail", "instance_id", REPLICATES, 20260712, ["model_id"], RS.split_lists
    )


@query("tr4_within_instance_auc", ctes=(*CTES, RANKED_SQL, strat_sql("model_id", "instance_id", "hedge_tail")), sql=STRAT_RESULT)
def _(spark, d):
    return TR.stratified_auc(ranking_rows(spark, d), ["model_id"], ["instance_id"], "hedge_tail")


TEXTURES = ["completion_tokens", "bt_full", "rep_full"]
FIT_T = fit_sql("t", cells_sql("model_id", "traces"), "model_id")


@query("tr5_texture_peaks", ctes=(*CTES, FIT_T), sql=" UNION ALL ".join(
    f"""SELECT model_id, '{name}' AS texture, count(*) AS n_levels, arg_min(level_value, (-m, level_value)) AS peak_level,
  round(arg_min(level_value, (-m, level_value)) - any_value(x50), 6) AS offset_from_x50,
  arg_min(level_value, (-m, level_value)) = max(level_value) AS censored
FROM (SELECT model_id, level_value, round(avg({name}), 6) AS m FROM features GROUP BY 1, 2) JOIN fit_t USING (model_id) GROUP BY model_id"""
    for name in TEXTURES))
def _(spark, d):
    levels = materialize(TR.texture_levels(features(spark, d), ["model_id"], TEXTURES))
    fits = materialize(C.fit_curves(C.level_cells(T.traces(spark, d), ["model_id"]), ["model_id"]))
    out = None
    for name in TEXTURES:
        one = C.peaks(levels, ["model_id"], name, fits).withColumn("texture", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


POINT = " + ".join(
    f"len(list_filter(part, lambda x: x IN {listed(M[f])})) * {p}" for f, p in X.POINTS.items())


def risk_sql(tag: str, chunk: int) -> str:
    span = X.WINDOW_WORDS // chunk
    return f"""ck_{tag} AS (SELECT call_id, unnest(range(n // {chunk})) AS chunk, w FROM worded),
cp_{tag} AS (SELECT *, w[chunk * {chunk} + 1:(chunk + 1) * {chunk}] AS part, w[greatest(chunk - {span - 1}, 0) * {chunk} + 1:(chunk + 1) * {chunk}] AS win FROM ck_{tag}),
cs_{tag} AS (SELECT call_id, chunk, {POINT} AS pts, len(win) - 3 - len(list_distinct([array_to_string(win[i:i + 3], ' ') for i in range(1, len(win) - 2)])) AS reps FROM cp_{tag}),
risk_{tag} AS (SELECT call_id, chunk, (chunk + 1) * {chunk} AS words_seen,
  CAST(sum(pts) OVER (PARTITION BY call_id ORDER BY chunk ROWS BETWEEN {span - 1} PRECEDING AND CURRENT ROW) AS BIGINT) + reps AS score FROM cs_{tag}),
fire_{tag} AS (SELECT call_id, min(chunk) AS trigger_chunk FROM (SELECT *, lag(score) OVER (PARTITION BY call_id ORDER BY chunk) AS prev FROM risk_{tag}
  WHERE words_seen >= {X.MIN_WORDS}) WHERE score > 4.0 AND prev > 4.0 GROUP BY call_id),
rp_{tag} AS (SELECT call_id, outcome, latency_ms, CAST(n AS BIGINT) AS total_words, CAST({chunk} AS BIGINT) AS chunk_words, trigger_chunk, trigger_chunk IS NOT NULL AS fired,
  (trigger_chunk + 1) * {chunk}::DOUBLE / n AS fraction FROM worded LEFT JOIN fire_{tag} USING (call_id) WHERE n >= {X.MIN_WORDS})"""


R40 = risk_sql("a", 40)


@query("wn7_rolling_risk", ctes=(T.TRACES_SQL, WORDS_SQL, R40), sql="SELECT call_id, chunk, words_seen, score FROM risk_a")
def rolling_risk(spark, d):
    return TR.risk_scores(T.traces(spark, d), MARKERS)


@query("wn8_first_trigger", ctes=(T.TRACES_SQL, WORDS_SQL, R40), sql="SELECT call_id, trigger_chunk FROM fire_a")
def _(spark, d):
    return TR.replay(T.traces(spark, d), MARKERS).where("fired").select("call_id", "trigger_chunk")


@query("tr6_trigger_replay", ctes=(T.TRACES_SQL, WORDS_SQL, R40), sql="""
SELECT call_id, outcome, latency_ms, total_words, chunk_words, trigger_chunk, fired, round(fraction, 6) AS trigger_fraction,
  round(latency_ms * (1.0 - fraction), 3) AS proxy_warning_ms FROM rp_a""")
def trigger_replay(spark, d):
    return TR.replay(T.traces(spark, d), MARKERS)


@query("tr6_trigger_medians", ctes=(T.TRACES_SQL, WORDS_SQL, R40), sql="""
SELECT chunk_words, round(quantile_cont(round(fraction, 6), 0.5), 6) AS median_trigger_fraction,
  round(quantile_cont(round(latency_ms * (1.0 - fraction), 3), 0.5), 3) AS median_proxy_warning_ms FROM rp_a WHERE fired GROUP BY 1""")
def _(spark, d):
    return TR.trigger_medians(materialize(TR.replay(T.traces(spark, d), MARKERS)))


SIZES = {"b": 20, "a": 40, "c": 80, "d": 160}


def rate_sql(cond: str) -> str:
    return f"round(count(*) FILTER (WHERE fired AND {cond})::DOUBLE / nullif(count(*) FILTER (WHERE {cond}), 0), 6)"


RATES_SQL = f"""rates AS (SELECT chunk_words, count(*) AS eligible, count(*) FILTER (WHERE outcome = 'pass') AS correct, count(*) FILTER (WHERE outcome <> 'pass') AS failures,
  count(*) FILTER (WHERE fired) AS triggered, {rate_sql('true')} AS launch_rate, {rate_sql("outcome <> 'pass'")} AS failure_recall,
  {rate_sql("outcome = 'fail_wrong'")} AS silent_wrong_recall, {rate_sql("outcome NOT IN ('pass', 'fail_wrong')")} AS loud_failure_recall,
  {rate_sql("outcome = 'pass'")} AS correct_false_hedge_rate FROM (SELECT * FROM {{0}}) GROUP BY chunk_words)"""


@query("tr7_chunk_sensitivity", ctes=(T.TRACES_SQL, WORDS_SQL, *[risk_sql(t, c) for t, c in SIZES.items()],
    RATES_SQL.format(" UNION ALL SELECT * FROM ".join(f"rp_{t}" for t in SIZES))), sql="SELECT * FROM rates")
def _(spark, d):
    return TR.replay_rates(TR.replay(T.traces(spark, d), MARKERS, list(SIZES.values())))


@query("tr8_matched_delay", ctes=(T.TRACES_SQL, WORDS_SQL, R40), sql="""
, q AS (SELECT (1.0 - avg(fired::INT::DOUBLE)) * (count(*) - 1) AS pos FROM rp_a),
o AS (SELECT latency_ms, row_number() OVER (ORDER BY latency_ms) - 1 AS i FROM rp_a),
dl AS (SELECT max(latency_ms) FILTER (WHERE i = floor(pos)) + (max(latency_ms) FILTER (WHERE i = ceil(pos)) - max(latency_ms) FILTER (WHERE i = floor(pos))) * (max(pos) - floor(max(pos))) AS delay FROM o, q)
SELECT round(max(delay), 3) AS delay_ms, round(avg((latency_ms >= delay)::INT::DOUBLE), 6) AS launch_rate,
  round(count(*) FILTER (WHERE outcome <> 'pass' AND latency_ms >= delay)::DOUBLE / count(*) FILTER (WHERE outcome <> 'pass'), 6) AS failure_recall FROM rp_a, dl""")
def _(spark, d):
    return TR.matched_delay(materialize(TR.replay(T.traces(spark, d), MARKERS)))


@query("tr9_replay_gate", ctes=(T.TRACES_SQL, WORDS_SQL, R40, RATES_SQL.format("rp_a")), sql="""
SELECT chunk_words, eligible >= 30 AS at_least_30_eligible, failures >= 10 AS at_least_10_failures,
  failure_recall >= 0.6 AS failure_trigger_recall_at_least_0_60, correct_false_hedge_rate <= 0.4 AS correct_false_hedge_at_most_0_40,
  eligible >= 30 AND failures >= 10 AND failure_recall >= 0.6 AND correct_false_hedge_rate <= 0.4 AS pass FROM rates""")
def _(spark, d):
    rates = TR.replay_rates(TR.replay(T.traces(spark, d), MARKERS))
    return S.gate(rates, TR.REPLAY_GATE, ["chunk_words"])
