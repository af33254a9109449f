"""Joint training of all folds against a plain solver."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from callmetrics.operators import training as TN

FEATURES = ["x", "y", "const", "gone"]


def rows_of(seed, n=400):
    rng = np.random.default_rng(seed)
    x, y = rng.normal(size=n), rng.exponential(size=n) * 50
    label = (x + 0.02 * y + rng.normal(size=n) > 1).astype(int)
    return [
        (i, int(label[i]), i % 3 if i % 50 else None, float(x[i]) if i % 7 else None, float(y[i]) if i % 5 else None, 4.5, None)
        for i in range(n)
    ]


def frame(spark, rows):
    return spark.createDataFrame(rows, "call_id bigint, label bigint, fold bigint, x double, y double, const double, gone double")


def plain_design(rows, held):
    """Standardised columns of all rows, with medians and scales of the other folds."""
    value = np.array([[np.nan if v is None else v for v in r[3:]] for r in rows], float)
    mine = np.array([r[2] != held for r in rows])
    columns = []
    flags = []
    for c in value.T:
        known = c[mine & ~np.isnan(c)]
        columns.append(np.where(np.isnan(c), np.median(known) if len(known) else 0.0, c))
        flags.append(np.isnan(c).astype(float))
    out = []
    for c in columns + flags:
        spread = c[mine].std(ddof=1)
        out.append((c - c[mine].mean()) / spread if spread > 1e-9 else np.zeros(len(c)))
    return np.stack([*out, np.ones(len(rows))], axis=1), mine


def plain_weights(x, y, strength):
    w = np.zeros(x.shape[1])
    penalty = np.append(np.full(x.shape[1] - 1, strength), 0.0)
    for _ in range(40):
        p = 1 / (1 + np.exp(-x @ w))
        slope = x.T @ (p - y) / len(y) + penalty * w
        curve = (x.T * (p * (1 - p))) @ x / len(y) + np.diag(penalty + 1e-12)
        w -= np.linalg.solve(curve, slope)
    assert np.abs(slope).max() < 1e-10
    return w


@pytest.mark.parametrize("strength", [0.01, 0.5])
def test_out_of_fold_against_plain_newton(spark, strength):
    rows = rows_of(3)
    got = {r.call_id: r.prediction for r in TN.out_of_fold(frame(spark, rows), FEATURES, 3, ["call_id"], strength).collect()}
    assert len(got) == len(rows)
    for held in range(3):
        x, mine = plain_design(rows, held)
        w = plain_weights(x[mine], np.array([r[1] for r in rows])[mine], strength)
        for row, margin in zip(rows, x @ w):
            if row[2] == held:
                assert got[row[0]] == pytest.approx(1 / (1 + np.exp(-margin)), abs=1e-7)
    assert all(got[r[0]] is None for r in rows if r[2] is None)  # in every training set, held out of none


def test_medians_from_one_histogram(spark):
    rows = [(i, 0, i % 4 if i % 9 else None, float(i * i % 37), None if i % 3 else float(i), 1.0, None) for i in range(211)]
    got = TN.fold_medians(frame(spark, rows), FEATURES, 4)
    for held in range(4):
        for at, f in enumerate(FEATURES):
            known = [r[3 + at] for r in rows if r[2] != held and r[3 + at] is not None]
            assert got[held][f] == (np.median(known) if known else 0.0)


def test_passes_do_not_grow_with_folds(spark, monkeypatch):
    passes = []
    slopes = TN._slopes
    monkeypatch.setattr(TN, "_slopes", lambda rows, models: passes.append(len(models)) or slopes(rows, models))
    TN.train_models(frame(spark, rows_of(5)), FEATURES[:2], 3)
    assert len(passes) <= 12 and passes[0] == 3


def test_one_class_and_empty_training_sets(spark):
    one = [(i, 1, i % 2, float(i), 1.0, 1.0, None) for i in range(20)]
    scored = TN.out_of_fold(frame(spark, one), FEATURES, 2, ["call_id", "label"]).collect()
    assert all(r.prediction > 0.99 for r in scored)
    alone = [(i, i % 2, 0, float(i), 1.0, 1.0, None) for i in range(20)]  # nothing outside fold 0
    assert {r.prediction for r in TN.out_of_fold(frame(spark, alone), FEATURES, 1, ["call_id"]).collect()} == {0.5}
    assert TN.out_of_fold(frame(spark, []), FEATURES, 2, ["call_id"]).count() == 0


def test_rows_without_level_or_fold_stay(spark):
    df = spark.createDataFrame(
        [(i, i % 2, i % 3 if i else None, 1.0 + i % 4 if i != 1 else None) for i in range(60)], "call_id bigint, label bigint, fold bigint, level_value double"
    )
    placed = TN.with_held_out_curve(df, 3)
    assert placed.count() == 60
    assert {r.call_id for r in placed.where(F.col("curve_prior").isNull()).collect()} == {0, 1}


def test_forward_holdout_trains_on_the_first_stage_only(spark):
    rng = np.random.default_rng(9)
    make = lambda n, turn: spark.createDataFrame(
        [(i, int(rng.random() < 0.5 + 0.3 * turn * (i % 3 - 1)), float(2 + i % 4), float(i % 3)) for i in range(n)],
        "call_id bigint, label bigint, level_value double, x double",
    )
    train, test = make(300, 1), make(90, -1)
    scored = TN.forward_holdout(train, test, ["x"], ["call_id", "label", "curve_prior"])
    by_x = {r.x: r.p for r in scored.join(test.select("call_id", "x"), "call_id").groupBy("x").agg(F.avg("prediction").alias("p")).collect()}
    assert by_x[0.0] < by_x[1.0] < by_x[2.0]  # as in the train stage, against the test stage
