"""Known values and invariants on small tables."""

import math

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from callmetrics.functions import answers as A
from callmetrics.functions import envelope as E
from callmetrics.functions import outcomes as O
from callmetrics.functions import scoring as X
from callmetrics.functions import texts as TX
from callmetrics.functions import trace_kernels as TK
from callmetrics.operators import traces as TR
from callmetrics.operators import curves as CU
from callmetrics.operators import status as ST
from callmetrics.operators import curves as C
from callmetrics.operators import ledger, release, rescore
from callmetrics.operators import metrics as M
from callmetrics.operators import status as S
from callmetrics.operators import telemetry as TM
from callmetrics.operators import training as TN
from callmetrics.operators import upsert as U
from callmetrics.plans.report import prospective_report
from callmetrics.sources import files


def one(spark, **columns):
    return spark.range(1).select(*[v.alias(k) for k, v in columns.items()]).first()


def test_taxonomy_is_exclusive_and_total(spark):
    rows = spark.createDataFrame([(c,) for c in ("pass", "fail_wrong", "fail_parse", "fail_truncated", "error_api", "provider_mismatch", None)], "o string")
    got = [r[0] for r in rows.select(O.outcome_class(F.col("o"))).collect()]
    assert got == [O.CORRECT, O.SILENT] + [O.LOUD] * 5


def test_frozen_model_golden(spark):
    row = spark.createDataFrame([(6.6, 40000, 30000, 500000.0, 1, "stop")], "level_value double, completion_tokens bigint, reasoning_tokens bigint, latency_ms double, attempt bigint, finish_reason string")
    p, q = row.select(X.frozen_score(X.FROZEN), X.frozen_prior(X.FROZEN)).first()
    assert p == pytest.approx(0.8699053, abs=1e-7) and q == pytest.approx(0.7093312, abs=1e-7)


def test_missing_indicator_follows_its_feature(spark):
    frozen = {
        "cohort": {"max_completion_tokens": 100}, "curve": X.FROZEN["curve"],
        "design": {"base_features": ["log_latency_ms", "attempt"], "medians": [2.0, 1.0], "means": [0.0, 0.0, 0.0],
                   "scales": [1.0, 1.0, 1.0], "missing_features": ["log_latency_ms"]},
        "weights": [0.5, 3.0, 0.25, -1.0],
    }
    schema = "level_value double, completion_tokens bigint, reasoning_tokens bigint, latency_ms double, attempt bigint, finish_reason string"
    row = spark.createDataFrame([(6.0, 1, 1, None, 0, None)], schema)
    want = 1 / (1 + math.exp(-(0.5 * 2 + 3.0 + 0.25 - 1)))
    assert row.select(X.frozen_score(frozen)).first()[0] == pytest.approx(want)


def test_curve_falls_and_x50(spark):
    b, a, lapse = (X.FROZEN["curve"][k] for k in ("b", "a", "lapse"))
    row = one(spark, low=X.curve_probability(F.lit(6.3), b, a, lapse), high=X.curve_probability(F.lit(6.9), b, a, lapse),
              x=X.x50(F.lit(b), F.lit(a), F.lit(lapse)))
    assert row["low"] > row["high"] and row["x"] == pytest.approx(X.FROZEN["curve"]["x50"])


def test_metrics_on_known_values(spark):
    rows = spark.createDataFrame([(0, 0.0, 0.5), (0, 0.1, 0.5), (1, 0.9, 0.5), (1, 1.0, 0.5)], "label bigint, prediction double, curve_prior double")
    m = M.score_metrics(rows).first()
    assert m["brier"] < 0.01 and m["brier_skill"] > 0.95 and m["log_loss"] < 0.06
    assert M.auc(rows).first()["auc"] == 1.0
    back = rows.withColumn("prediction", -F.col("prediction"))
    assert M.auc(back).first()["auc"] == 0.0
    assert math.isnan(M.auc(rows.where("label = 1")).first()["auc"])


def test_auc_against_pairs(spark):
    rng = np.random.default_rng(5)
    y, s = rng.integers(0, 2, 400), rng.integers(0, 15, 400) / 10.0
    s[:150] = 0.7
    rows = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "label bigint, prediction double")
    pos, neg = s[y == 1], s[y == 0]
    want = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert M.auc(rows).first()["auc"] == pytest.approx(want)


def test_interval_is_deterministic_and_needs_two_clusters(spark):
    data = [("a", 1, 0.9, 0.6), ("a", 1, 0.8, 0.6), ("b", 0, 0.2, 0.6), ("b", 0, 0.1, 0.6)]
    rows = spark.createDataFrame(data, "instance_id string, label bigint, prediction double, curve_prior double")
    first, again = (M.clustered_interval(rows, replicates=100, seed=7).first() for _ in range(2))
    assert first == again and math.isfinite(first["ci_low"]) and math.isfinite(first["ci_high"])
    lone = M.clustered_interval(rows.where("instance_id = 'a'"), replicates=10).first()
    assert math.isnan(lone["ci_low"]) and math.isnan(lone["ci_high"])


def test_route_match_and_cost(spark):
    match = lambda seen: one(spark, m=O.provider_matches(F.lit(seen), "Parasail"))["m"]
    assert match("gateway/Parasail") and match(" PARASAIL ") and not match("Other") and not match("")
    assert one(spark, c=O.estimated_microdollars(F.lit(1_000_000), F.lit(0), 0.3, 1.2))["c"] == 330_000
    assert one(spark, c=O.estimated_microdollars(F.lit(8_000), F.lit(65_536), 0.3, 1.2))["c"] == 89_148


def test_stop_precedence(spark):
    limits = {"correct": 1, "silent_wrong": 1, "max_calls": 2, "max_spend_microdollars": 1_000_000}
    reason = lambda *v, lim=limits: one(spark, r=S.stop_reason(*[F.lit(x) for x in v], lim))["r"]
    assert reason(1, 1, 2, 2_000_000) == "label target reached"
    assert reason(0, 0, 2, 2_000_000) == "call cap reached"
    assert reason(0, 0, 0, 1_000_000) == "spend cap reached"
    assert reason(0, 0, 1, 10**12, lim={**limits, "max_spend_microdollars": None}) is None


def test_status_of_no_calls_is_zero(spark):
    empty = spark.createDataFrame([], "stage string, model_id string, outcome string, cost_microdollars bigint")
    assert S.study_status(empty, []).first().asDict() == {
        "calls": 0, "correct": 0, "silent_wrong": 0, "loud": 0, "spend_microdollars": 0, "spend_usd": 0.0,
    }
    audit = spark.createDataFrame([("m", 1)], "model_id string, calls bigint")
    assert S.require_model(audit, "m").count() == 1
    with pytest.raises(ValueError, match="no calls found for x"):
        S.require_model(audit, "x")


@pytest.mark.parametrize("text, bits", [
    ("work\nFINAL: 1 0 1", [True, False, True]), ("work\nFINAL: 101", [True, False, True]), ("FINAL: 1 0", None),
    ("1 0 1", None), ("final : 1,0,1\nmore", [True, False, True]), ("FINAL: 000\nFINAL: 111", [True] * 3), (None, None),
])
def test_final_answer(spark, text, bits):
    assert one(spark, b=A.final_bits(F.lit(text).cast("string"), 3))["b"] == bits


def test_certificate(spark):
    clauses = F.array(F.array(F.lit(1), F.lit(2), F.lit(3)))
    check = lambda *v: one(spark, ok=A.satisfies(clauses, F.array(*[F.lit(x) for x in v])))["ok"]
    assert not check(False, False, False) and check(False, True, False)


def test_rescoring_twice_changes_nothing(spark):
    schema = "call_id bigint, clauses array<array<int>>, response_text string, finish_reason string, provider_mismatch int, outcome string, parsed_answer string, pass int"
    rows = spark.createDataFrame([
        (1, [[1, 2, 3]], "FINAL: 110", "stop", 0, "fail_parse", None, 0),
        (2, [[1, 2, 3]], "FINAL: 110", "length", 0, "fail_truncated", None, 0),
        (3, [[-1, -2, -3]], "FINAL: 111", "stop", 0, "pass", None, 1),
        (4, [[1, 2, 3]], "FINAL: 110", "stop", 1, "provider_mismatch", None, 0),
    ], schema)
    done = rescore.apply_rescoring(rows, 3)
    got = {r["call_id"]: (r["outcome"], r["pass"], r["parsed_answer"]) for r in done.collect()}
    assert got[1] == ("pass", 1, "[true, true, false]") and got[3][0] == "fail_wrong"
    assert got[2][0] == "fail_truncated" and got[4][0] == "provider_mismatch"
    assert rescore.changes(done, 3).count() == 0


def test_event_lines(spark):
    lines = [": note", 'data: {"part":', "data: 1}", "", "", "event: x", "data: [DONE]"]
    df = spark.createDataFrame([("s", i, float(i), line) for i, line in enumerate(lines)], "stream_id string, line_no bigint, elapsed_ms double, line string")
    assert [r["data"] for r in TM.reassemble(df).orderBy("line_no").collect()] == ['{"part":\n1}', "[DONE]"]


def test_envelope_and_errors(spark):
    body = F.lit('{"choices":[{"message":{"content":[{"text":"a"},"b",{}],"reasoning":"","reasoning_content":"r"}}],"usage":{"cost":0.0000025}}')
    row = one(spark, **E.envelope_columns(E.parsed(body)))
    assert (row["response_text"], row["reasoning_text"], row["cost_microdollars"]) == ("ab", "r", 2)
    error = lambda text: one(spark, e=E.stream_error(E.parsed(F.lit(text))))["e"]
    assert error('{"error":{"code":429,"message":"slow"}}') == "stream error 429: slow"
    assert error('{"error":"gone"}') == "stream error: gone" and error('{"error":{}}') is None and error('{"x":1}') is None
    assert one(spark, p=E.parsed(F.lit("{bad")).isNull())["p"]


def test_upsert_replaces_and_ignores(spark):
    key = "model_id string, instance_id string, sample_idx bigint, prompt_version bigint, stage string"
    table = lambda *rows: spark.createDataFrame(rows, f"{key}, call_id bigint, outcome string")
    out = U.record_calls(table(("m", "i", 0, 1, "s", 1, "error_api")), table(("m", "i", 0, 1, "s", 2, "pass"), ("m", "i", 1, 1, "s", 3, "pass"))).collect()
    assert sorted((r["call_id"], r["outcome"]) for r in out) == [(2, "pass"), (3, "pass")]
    known = spark.createDataFrame([("a", 1)], "instance_id string, seed bigint")
    new = spark.createDataFrame([("a", 9), ("b", 5), ("b", 4)], "instance_id string, seed bigint")
    assert sorted(map(tuple, U.add_instances(known, new, ["seed"]).collect())) == [("a", 1), ("b", 4)]


def test_exports_share_only_ids_and_reload_to_the_same_digest(spark, tmp_path):
    assert set(release.COMPACT) & set(release.TRACE) == {"call_id", "instance_hash"}
    rows = spark.range(500).selectExpr("id AS call_id", "cast(id AS string) AS instance_hash", "'x' AS response_text", "'' AS reasoning_text")
    path = str(tmp_path / "traces")
    release.write_json_lines(rows, path, ["call_id"])
    back = release.read_release(spark, path, "", rows.schema)
    assert release.digest(rows, "t").first() == release.digest(back.repartition(3), "t").first()
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        files.write_once(rows, path)


def test_logs(spark, tmp_path):
    (tmp_path / "a.log").write_text(
        "stage x: 4 calls to run\n[23:59:00] 1/4 done, $1.50 spent ($0.25 reserved)\n[00:01:00] 3/4 done, $2.00 spent ($0.00 reserved)\n"
        "[adaptive] batch at level 14: b=6.600 se=0.171 calls=20\n  [router] 5/25 alpha=3.0 PASS (spend $0.10)\n"
    )
    parsed = ledger.parse_log_lines(files.read_logs(spark, str(tmp_path)))
    assert sorted(r["kind"] for r in parsed.collect()) == ["arm", "batch", "progress", "progress"]
    rate = ledger.progress_rate(parsed).where("calls_per_hour IS NOT NULL").first()
    assert (rate["gap_seconds"], rate["calls_per_hour"]) == (120, 60.0)


def test_published_derivations(spark):
    assert one(spark, r=C.spearman_brown(F.lit(0.9802)))["r"] == pytest.approx(0.99, abs=1e-4)
    uniform = {
        "a": {240: 0.617, 480: 0.475, 960: 0.384, 1440: 0.346, 1920: 0.333},
        "b": {240: 0.58, 1440: 0.217, 1920: 0.208},
    }
    grid = spark.createDataFrame([(m, b, w) for m, g in uniform.items() for b, w in g.items()], "model string, budget bigint, width double")
    adaptive = spark.createDataFrame([("a", 168, 0.425), ("b", 96, 0.398)], "model string, calls bigint, width double")
    got = {r["model"]: r["efficiency_ratio"] for r in C.efficiency(grid, adaptive).collect()}
    assert got["a"] == pytest.approx(4.1, abs=0.05)


def test_curve_fit_finds_its_parameters(spark):
    levels = [2.0 + 0.5 * i for i in range(12)]
    p = lambda x: 0.98 / (1 + math.exp(-1.3 * (5.0 - x)))
    cells = spark.createDataFrame([("m", x, 4000, round(4000 * p(x))) for x in levels], "model_id string, level_value double, n bigint, k bigint")
    fit = C.fit_curves(cells, ["model_id"]).first()
    assert fit["b"] == pytest.approx(5.0, abs=0.1) and fit["a"] == pytest.approx(1.3, abs=0.1) and fit["lapse"] == pytest.approx(0.02, abs=0.004)


def test_calibration_line_against_newton(spark):
    rng = np.random.default_rng(2)
    p = rng.uniform(0.05, 0.95, 1500)
    x = np.log(p / (1 - p))
    y = (rng.random(1500) < 1 / (1 + np.exp(-(0.3 + 0.7 * x)))).astype(int)
    w, design = np.zeros(2), np.stack([np.ones_like(x), x], 1)
    for _ in range(30):
        m = 1 / (1 + np.exp(-design @ w))
        w += np.linalg.solve((design * (m * (1 - m))[:, None]).T @ design, design.T @ (y - m))
    rows = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "label bigint, prediction double")
    got = M.calibration_line(rows).first()
    assert (got["intercept"], got["slope"]) == pytest.approx(tuple(w), abs=2e-3)


def test_out_of_fold_never_sees_its_fold(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=600)
    rows = [(i, int(v + 0.5 * rng.normal() > 0), i % 3, float(v) if i % 7 else None) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "call_id bigint, label bigint, fold int, x double")
    scored = TN.out_of_fold(df, ["x"], 3, ["call_id", "label", "fold"])
    assert scored.count() == 600 and M.auc(scored).first()["auc"] > 0.8
    noise = df.withColumn("x", F.rand(4))
    assert M.auc(TN.out_of_fold(noise, ["x"], 3, ["call_id", "label"])).first()["auc"] < 0.6


def test_folds_keep_instances_whole(spark):
    inst = spark.range(300).selectExpr("cast(id AS string) AS instance_id", "CASE WHEN id < 200 THEN 1.0D ELSE 2.0D END AS level_value")
    folds = TN.grouped_folds(inst, 5, 3)
    assert {r["count"] for r in folds.groupBy("level_value", "fold").count().collect()} == {40, 20}


def test_rolling_scores_against_plain_python(spark):
    rng = np.random.default_rng(8)
    lexicon = {"backtrack": ("undo",), "hedge": ("maybe",), "giveup": ("stuck",)}
    text = " ".join(rng.choice(["undo", "maybe", "stuck", "so", "then", "we", "set", "it"], 950, p=[.01, .01, .005, .4, .2, .175, .1, .1]))
    words = text.split()
    worth = {"undo": 1, "maybe": 1, "stuck": 2}
    want = []
    for j in range(len(words) // 40):
        window = words[max(0, 40 * (j - 7)):40 * (j + 1)]
        runs = [tuple(window[i:i + 4]) for i in range(len(window) - 3)]
        want.append(sum(worth.get(w, 0) for w in window) + len(runs) - len(set(runs)))
    score = TK.rolling_scores_udf(lexicon)
    scored = spark.createDataFrame([(text,), ("too short",), (None,), ("",), (text + " " + "é? " * 60,)], "text string").coalesce(1).select(
        score(F.col("text")).alias("r")).select(F.col("r.s40").alias("s")).select("s", TX.trigger_chunk(F.col("s")).alias("t")).collect()
    row = scored[0]
    assert row["s"] == want
    fired = [j for j in range(2, len(want)) if want[j] > 4 and want[j - 1] > 4]
    assert row["t"] == (fired[0] if fired else None)
    assert [r["s"] for r in scored[1:4]] == [[], [], []] and scored[4]["s"][:len(want)] == want


def test_trace_features_against_plain_python(spark):
    rng = np.random.default_rng(4)
    lexicon = {f: (f[:3], f) for f in ("backtrack", "wait", "hedge", "giveup", "flip", "negative")}
    pool = ["bac", "wait", "hed", "giveup", "fli", "neg", "so", "we?", "(it)", "Ü"]
    rows = [(i, " ".join(rng.choice(pool, n)) if n else t, a) for i, (n, t, a) in enumerate(
        [(200, "", "hed so"), (0, None, None), (0, "", "hed"), (1, "", ""), (5, "", "so? hed"), (67, "", "x")])]
    words = lambda t: re.findall(r"\?|[^?.,;:!()|\" \t\n\r\f]+", (t or "").lower())
    got = TR.trace_features(spark.createDataFrame(rows, "id long, reasoning_text string, response_text string"), lexicon, ["id"]).collect()
    for row, (_, text, answer) in zip(sorted(got), rows):
        w, a = words(text), words(answer)
        part = lambda share: w[int(np.floor(len(w) * (1.0 - share))):]
        dense = lambda x, ms: sum(v in ms for v in x) * 1000 / len(x) if x else 0.0
        runs = lambda x, k: [tuple(x[i:i + k]) for i in range(len(x) - k + 1)]
        rep = lambda x, k: (len(runs(x, k)) - len(set(runs(x, k)))) / len(runs(x, k)) if len(x) >= k else 0.0
        want = {
            "rep_tail": rep(part(0.3), 6), "rep_full": rep(w, 6), "rep_tail_k4": rep(part(0.3), 4),
            "bt_tail": dense(part(0.3), lexicon["backtrack"]), "hedge_tail": dense(part(0.15) + a, lexicon["hedge"]),
            "hedge_ans": dense(a, lexicon["hedge"]), "qmark_tail": dense(part(0.3), ("?",)), "flip": dense(w, lexicon["flip"]),
            "bt_last10": dense(part(0.1), lexicon["backtrack"]), "len_ratio": len(a) / len(w) if w else 0.0, "trace_visible": float(bool(w)),
        }
        assert {n: row[n] for n in want} == pytest.approx(want, abs=1e-6)


def test_fit_finds_a_small_lapse(spark):
    level = np.arange(1.0, 9.0, 0.25)
    solve = 0.985 / (1 + np.exp(-2.0 * (5.0 - level)))
    cells = spark.createDataFrame([("m", float(x), 4000, int(round(4000 * p))) for x, p in zip(level, solve)], "model string, level_value double, n bigint, k bigint")
    fit = CU.fit_curves(cells, ["model"]).first()
    assert fit["lapse"] == pytest.approx(0.015, abs=0.005) and fit["b"] == pytest.approx(5.0, abs=0.1)


def test_cohort_audit_reads_calls_once(spark):
    calls = spark.createDataFrame([(1, "m", "i", "pass", None, 1), (2, "m", "j", "fail_wrong", "p", None), (3, "n", "x", "pass", "p", 1)],
                                  "call_id bigint, model_id string, instance_id string, outcome string, provider_endpoint string, provider_pinned int")
    instances = spark.createDataFrame([("i", 1.0), ("j", 1.0)], "instance_id string, level_value double")
    row = ST.cohort_audit(calls, instances).collect()
    assert [(r["model_id"], r["calls"], r["instances"], r["providers"], r["mixed_levels"], r["all_calls_provider_pinned"]) for r in row] == [("m", 2, 2, 2, 1, False)]


def test_report_needs_both_labels(spark):
    calls = spark.createDataFrame([(1, "i", "pass", 10, 5, 9.0, 1, "stop", 3)], "call_id bigint, instance_id string, outcome string, completion_tokens bigint, reasoning_tokens bigint, latency_ms double, attempt bigint, finish_reason string, cost_microdollars bigint")
    instances = spark.createDataFrame([("i", 3.0)], "instance_id string, level_value double")
    with pytest.raises(Exception, match="requires correct and silently wrong"):
        prospective_report(calls, instances, X.FROZEN, replicates=5).collect()


def test_report_refuses_an_open_study(spark):
    calls = spark.createDataFrame([], "call_id bigint, instance_id string, outcome string, completion_tokens bigint, reasoning_tokens bigint, latency_ms double, attempt bigint, finish_reason string, cost_microdollars bigint")
    instances = spark.createDataFrame([("i", 3.0)], "instance_id string, level_value double")
    for state, message in (((None, True), "stopping condition"), (("call cap reached", False), "continuity")):
        final = spark.createDataFrame([state], "stop_reason string, ready boolean")
        with pytest.raises(ValueError, match=message):
            prospective_report(calls, instances, X.FROZEN, replicates=5, final=final)


def test_split_half_without_variance(spark):
    """Halves that are alike in every model: no correlation, and no division by zero."""
    rows = [(m, str(i), 2.0 + i % 5, O.PASS if i % 5 < 2 else O.WRONG) for m in ("a", "b") for i in range(60)]
    calls = spark.createDataFrame(rows, "model string, instance_id string, level_value double, outcome string")
    found = C.split_half(calls, "model", 11).first()
    assert found["models"] == 2 and math.isnan(found["pearson_r"]) and math.isnan(found["spearman_brown"])
    opposed = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0)], "x double, y double")
    row = C.correlated(opposed, "x", "y").select("r", C.spearman_brown(F.col("r")).alias("sb")).first()
    assert row["r"] == -1.0 and row["sb"] == -math.inf
    assert C.correlated(opposed.where("x > 5"), "x", "y").first()["r"] is None
    mixed = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (3.0, 4.0), (4.0, 4.5)], "x double, y double")
    assert C.correlated(mixed, "x", "y").first()["r"] == pytest.approx(mixed.agg(F.corr("x", "y")).first()[0], abs=1e-12)
