"""Trace features, texture, risk-trigger replay and stratified ranking."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callmetrics.functions import outcomes as O
from callmetrics.functions import texts as X
from callmetrics.functions import trace_kernels as K
from callmetrics.operators import metrics as M
from callmetrics.operators import resampling as RS
from callmetrics.operators.ordered import quantiles
from callmetrics.session import materialize

# Fixed value: characters per billed token in the delivered-share estimate.
CHARS_PER_TOKEN = 3.7


def trace_features(traces: DataFrame, lexicon: Mapping[str, Sequence[str]], keep: Sequence[str]) -> DataFrame:
    made = traces.select(*keep, K.trace_features_udf(lexicon)(F.col("reasoning_text"), F.col("response_text")).alias("f"))
    return made.select(*keep, *[F.round(f"f.{n}", 6).alias(n) for n in K.FEATURES])


def trace_repetition(traces: DataFrame, keep: Sequence[str], k: int = X.SHINGLE) -> DataFrame:
    return traces.select(*keep, F.round(K.repetition_udf(k)(F.col("reasoning_text")), 6).alias("repetition"))


def trace_availability(traces: DataFrame, keys: Sequence[str] = ("model_id", "route")) -> DataFrame:
    """How much of what was billed came back as text, call by call."""
    chars = F.char_length(F.coalesce("reasoning_text", F.lit(""))) + F.char_length(F.coalesce("response_text", F.lit("")))
    share = chars / F.lit(CHARS_PER_TOKEN) / F.col("completion_tokens")
    return traces.where(F.col("completion_tokens") > 0).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("completion_tokens"), 0).cast("bigint").alias("avg_billed_tokens"),
        F.round(F.avg(share), 3).alias("delivered_share"),
    )


def texture_levels(features: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    return features.groupBy(*keys, "level_value").agg(*[F.round(F.avg(n), 6).alias(n) for n in names])


def risk_scores(traces: DataFrame, lexicon: Mapping[str, Sequence[str]], chunk_words: int = X.CHUNK_WORDS) -> DataFrame:
    score = K.rolling_scores_udf(lexicon, [chunk_words])
    scored = traces.select("call_id", score(F.col("reasoning_text")).alias("r")).select("call_id", F.col(f"r.s{chunk_words}").alias("scores"))
    # The outer form infers no filter on the array, which would score twice.
    return scored.select("call_id", F.posexplode_outer("scores").alias("chunk", "score")).where(
        F.col("chunk").isNotNull()
    ).select(
        "call_id", F.col("chunk").cast("bigint").alias("chunk"),
        ((F.col("chunk") + 1) * chunk_words).cast("bigint").alias("words_seen"), "score",
    )


def replay(traces: DataFrame, lexicon: Mapping[str, Sequence[str]], chunk_sizes: Sequence[int] = (X.CHUNK_WORDS,)) -> DataFrame:
    """One narrow row per call and chunk size: when the trigger would have
    fired and how much of the trace and of the latency was left."""
    score = K.rolling_scores_udf(lexicon, chunk_sizes)
    scored = traces.select("call_id", "outcome", "latency_ms", score(F.col("reasoning_text")).alias("r")).select(
        "call_id", "outcome", "latency_ms", "r.*"
    ).where(F.col("total_words") >= X.MIN_WORDS)
    fired = scored.select(
        "call_id", "outcome", "latency_ms", "total_words",
        *[X.trigger_chunk(F.col(f"s{c}"), c).alias(f"t{c}") for c in chunk_sizes],
    )
    pairs = ", ".join(f"{c}L, t{c}" for c in chunk_sizes)
    long = fired.selectExpr(
        "call_id", "outcome", "latency_ms", "total_words",
        f"stack({len(chunk_sizes)}, {pairs}) AS (chunk_words, trigger_chunk)",
    )
    fraction = (F.col("trigger_chunk") + 1) * F.col("chunk_words") / F.col("total_words")
    return long.select(
        "*", F.col("trigger_chunk").isNotNull().alias("fired"), F.round(fraction, 6).alias("trigger_fraction"),
        F.round(F.col("latency_ms") * (1.0 - fraction), 3).alias("proxy_warning_ms"),
    )


def replay_rates(replayed: DataFrame) -> DataFrame:
    rate = lambda cond: F.round(
        F.count_if(cond & F.col("fired")) / F.nullif(F.count_if(cond), F.lit(0)), 6
    )
    outcome = F.col("outcome")
    return replayed.groupBy("chunk_words").agg(
        F.count(F.lit(1)).alias("eligible"), F.count_if(outcome == O.PASS).alias("correct"),
        F.count_if(outcome != O.PASS).alias("failures"), F.count_if("fired").alias("triggered"),
        rate(F.lit(True)).alias("launch_rate"), rate(outcome != O.PASS).alias("failure_recall"),
        rate(outcome == O.WRONG).alias("silent_wrong_recall"), rate(O.is_loud(outcome)).alias("loud_failure_recall"),
        rate(outcome == O.PASS).alias("correct_false_hedge_rate"),
    )


# The non-timing conditions of the replay gate.
REPLAY_GATE = {
    "at_least_30_eligible": "eligible >= 30",
    "at_least_10_failures": "failures >= 10",
    "failure_trigger_recall_at_least_0_60": "failure_recall >= 0.60D",
    "correct_false_hedge_at_most_0_40": "correct_false_hedge_rate <= 0.40D",
}


def trigger_medians(replayed: DataFrame) -> DataFrame:
    fired = replayed.where("fired")
    one = quantiles(fired, "trigger_fraction", {"median_trigger_fraction": 0.5}, ["chunk_words"])
    two = quantiles(fired, "proxy_warning_ms", {"median_proxy_warning_ms": 0.5}, ["chunk_words"])
    return one.drop("n").join(two.drop("n"), "chunk_words").select(
        "chunk_words", F.round("median_trigger_fraction", 6).alias("median_trigger_fraction"),
        F.round("median_proxy_warning_ms", 3).alias("median_proxy_warning_ms"),
    )


def matched_delay(replayed: DataFrame) -> DataFrame:
    """The fixed delay that launches as often as the trigger, and its recall.
    ``replayed`` holds one chunk size; its launch rate is a single number."""
    rate = replayed.agg(F.avg(F.col("fired").cast("double"))).first()[0]
    if rate is None:
        return replayed.sparkSession.createDataFrame([], "delay_ms double, launch_rate double, failure_recall double")
    delay = quantiles(replayed, "latency_ms", {"delay_ms": 1.0 - rate}).first()["delay_ms"]
    late = F.col("latency_ms") >= delay
    failed = F.col("outcome") != O.PASS
    return replayed.agg(
        F.round(F.lit(delay), 3).alias("delay_ms"), F.round(F.avg(late.cast("double")), 6).alias("launch_rate"),
        F.round(F.count_if(failed & late) / F.nullif(F.count_if(failed), F.lit(0)), 6).alias("failure_recall"),
    )


def stratified_auc(rows: DataFrame, keys: Sequence[str], strata: Sequence[str], score: str) -> DataFrame:
    """Wrong against right inside each stratum; strata add up by their pairs."""
    inside = M.auc(rows, [*keys, *strata], score)
    sums = inside.groupBy(*keys).agg(
        F.sum("wins").alias("wins"), F.sum("pairs").alias("pairs"), F.count_if(F.col("pairs") > 0).alias("strata")
    )
    area = F.when(F.col("pairs") > 0, F.round(F.col("wins") / F.col("pairs"), 6))
    return sums.select(*keys, "strata", F.col("pairs").cast("bigint").alias("n_pairs"), area.alias("auc"))


def stratified_auc_interval(
    rows: DataFrame, strata: Sequence[str], score: str, cluster: str, replicates: int, seed: int, keys: Sequence[str] = (),
    lists=RS.drawn_lists,
) -> DataFrame:
    """Resampled instances, per key. The score histogram is scanned once, its
    rows carrying how often their instance was drawn in each replicate; ``lists``
    says by which draws."""
    keys = list(keys)
    histogram = rows.where(F.col(score).isNotNull()).groupBy(cluster, *keys, *strata, F.col(score).alias("score")).agg(
        F.sum("label").cast("bigint").alias("pos"), F.sum(1 - F.col("label")).cast("bigint").alias("neg")
    )
    clusters = M.indexed_clusters(rows.select(cluster).distinct(), cluster)
    indexed = materialize(histogram.join(clusters, cluster).drop(cluster))
    index = materialize(clusters.select("idx"))
    drawn = lists(index, index.count(), replicates, seed)
    areas = RS.resampled_areas(indexed, drawn, keys, strata, replicates)
    # One row per replicate.
    return areas.groupBy(*keys).agg(
        F.count("auc").alias("replicates"), F.round(F.percentile("auc", F.lit(0.025)), 6).alias("ci_low"),
        F.round(F.percentile("auc", F.lit(0.975)), 6).alias("ci_high"),
    )
