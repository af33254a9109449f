"""Resampling by splitting and by carried draws, against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from callmetrics.operators import metrics as M
from callmetrics.operators import resampling as RS
from callmetrics.operators import traces as TR
from callmetrics.plans.catalog import QUERIES


def all_weights(clusters, replicates, seed):
    """replicates x clusters, leaf by leaf."""
    leaves = list(range(-(-clusters // RS.LEAF)))
    parts = {leaf: RS.leaf_weights(leaf, draws, clusters, seed) for leaf, draws in RS.leaf_draws(leaves, clusters, replicates, seed)}
    return np.concatenate([parts[leaf] for leaf in leaves], axis=1)


@pytest.mark.parametrize("clusters", [2, 63, 64, 65, 1000])
def test_every_replicate_draws_as_many_as_there_are(clusters):
    weights = all_weights(clusters, 300, 5)
    assert weights.shape == (300, clusters) and (weights.sum(axis=1) == clusters).all() and weights.min() >= 0
    assert np.array_equal(weights, all_weights(clusters, 300, 5)) and not np.array_equal(weights, all_weights(clusters, 300, 6))
    assert abs(weights.mean(axis=0) - 1).max() < 0.3  # no cluster is favoured
    assert abs(weights.var() - (1 - 1 / clusters)) < 0.1


def test_a_task_needs_only_its_own_leaves():
    whole = dict(RS.leaf_draws(range(40), 2500, 50, 9))
    for wanted in ([0], [39], [3, 4, 17], [38, 39]):
        some = dict(RS.leaf_draws(wanted, 2500, 50, 9))
        assert list(some) == wanted and all(np.array_equal(some[w], whole[w]) for w in wanted)


def test_split_sums_against_plain_weights(spark):
    rng = np.random.default_rng(1)
    values = rng.normal(size=(333, 2))
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(values)], "idx long, a double, b double").repartition(5)
    got = {r.rep: (r.a, r.b) for r in RS.split_sums(df, ["a", "b"], 333, 40, 3).collect()}
    want = all_weights(333, 40, 3) @ values
    assert len(got) == 40 and all(got[i] == pytest.approx(tuple(want[i])) for i in range(40))


def test_split_interval_is_near_the_drawn_one(spark):
    rng = np.random.default_rng(2)
    rows = [(f"i{i % 500}", int(rng.random() < 0.6), float(rng.uniform(0.2, 0.9))) for i in range(2000)]
    df = spark.createDataFrame(rows, "instance_id string, label bigint, prediction double").withColumn("curve_prior", F.lit(0.6))
    drawn, split = M.clustered_interval(df).first(), RS.split_interval(df).first()
    assert split.clusters == drawn.clusters == split.least_draws == split.most_draws == 500 and split.replicates == 2000
    assert abs(split.ci_low - drawn.ci_low) < 0.01 and abs(split.ci_high - drawn.ci_high) < 0.01
    assert RS.split_interval(df).first() == split
    one = RS.split_interval(df.where("instance_id = 'i1'")).first()
    assert one.clusters == 1 and one.replicates == 0 and np.isnan(one.ci_low)
    assert RS.split_interval(df.limit(0)).first().clusters == 0


def plain_areas(rows, weights):
    """rows: (idx, key, stratum, score, pos, neg)."""
    out = {}
    for rep in range(len(weights)):
        wins, pairs = {}, {}
        for _, key, stratum, *_ in rows:
            wins.setdefault(key, 0.0), pairs.setdefault(key, 0.0)
        for i, key, stratum, s, p, _ in rows:
            for j, other, second, t, _, n in rows:
                if key == other and stratum == second:
                    pair = p * weights[rep, i] * n * weights[rep, j]
                    pairs[key] += pair
                    wins[key] += pair * ((s > t) + 0.5 * (s == t))
        for key in wins:
            out[rep, key] = wins[key] / pairs[key] if pairs[key] else None
    return out


@pytest.mark.parametrize("lists", [RS.drawn_lists, RS.split_lists])
def test_areas_against_pairs(spark, monkeypatch, lists):
    monkeypatch.setattr(RS, "BLOCK", 7)
    rng = np.random.default_rng(4)
    rows = [
        (int(rng.integers(20)), ["a", "b", None][int(rng.integers(3))], [1.0, 2.0, None][int(rng.integers(3))], float(rng.integers(9)), int(rng.integers(3)), int(rng.integers(3)))
        for _ in range(90)
    ]
    df = spark.createDataFrame(rows, "idx long, key string, stratum double, score double, pos long, neg long")
    index = spark.range(20).withColumnRenamed("id", "idx")
    drawn = lists(index, 20, 20, 3)
    weights = np.zeros((20, 20), int)
    for r in drawn.collect():
        for at in r.drawn:
            weights[r.block * 7 + at, r.idx] += 1
    assert (weights.sum(axis=1) == 20).all()
    got = {(r.rep, r.key): r.auc for r in RS.resampled_areas(df, drawn, ["key"], ["stratum"], 20).collect()}
    want = plain_areas(rows, weights)
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(v) if v is not None else got[k] is None for k, v in want.items())
    sums = {(r.rep, r.key): (r.pos, r.neg) for r in RS.weighted_sums(df, drawn, ["key"], ["pos", "neg"], 20).collect()}
    for (rep, key), (pos, neg) in sums.items():
        mine = [(weights[rep, r[0]] * r[4], weights[rep, r[0]] * r[5]) for r in rows if r[1] == key]
        assert (pos, neg) == tuple(map(sum, zip(*mine)))


def test_equal_scores_over_the_end_of_a_batch(spark):
    rows = [(i % 5, float(i // 40), 1 - i % 2, i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "idx long, score double, pos long, neg long")
    index = spark.range(5).withColumnRenamed("id", "idx")
    lists = RS.split_lists(index, 5, 10, 1)
    want = [r.auc for r in RS.resampled_areas(df, lists, [], [], 10).orderBy("rep").collect()]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert [r.auc for r in RS.resampled_areas(df, lists, [], [], 10).orderBy("rep").collect()] == pytest.approx(want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_split_queries_agree_with_the_drawn_ones(spark):
    folder = "/root/testdata/sf0.01"
    split, drawn = QUERIES["me7_split_bootstrap"](spark, folder).first(), QUERIES["me7_cluster_bootstrap"](spark, folder).first()
    wide = drawn.ci_high - drawn.ci_low  # 20 clusters: the ends themselves vary with the draws
    assert abs(split.ci_low - drawn.ci_low) < 0.06 * wide and abs(split.ci_high - drawn.ci_high) < 0.06 * wide
    assert split.least_draws == split.most_draws == split.clusters == drawn.clusters


def test_stored_tables_are_no_larger_than_the_histogram(spark, monkeypatch):
    sizes = []
    store = TR.materialize
    monkeypatch.setattr(TR, "materialize", lambda df: (lambda t: sizes.append(t.count()) or t)(store(df)))
    rows = spark.range(300).selectExpr("concat('i', id % 30) AS c", "id % 4 AS s", "cast(id * 7 % 11 AS double) AS x", "id % 2 AS label")
    TR.stratified_auc_interval(rows, ["s"], "x", "c", 200, 1).collect()
    assert sizes and max(sizes) <= 300


def test_md5_heads_are_those_of_hashlib():
    import hashlib

    from callmetrics.functions.hashing import md5_heads

    for prefix, low, high in (("7|0|", 0, 1200), ("20260712|1999|", 99_990, 100_020), ("7|3|", 16_380, 16_390)):
        want = [int(hashlib.md5(f"{prefix}{i}".encode()).hexdigest()[:8], 16) for i in range(low, high)]
        assert md5_heads(prefix, low, high).tolist() == want


def test_drawn_sums_by_ranges(spark, monkeypatch):
    """Several ranges, blocks and pieces against lists of draws per cluster, whole numbers above 2**53 too."""
    rows = spark.createDataFrame(
        [(i, f"g{i % 3}" if i % 5 else None, i + 1, (i % 7) * 2**50) for i in range(60)] + [(7, "g9", 4, 1)], "idx long, g string, n long, big long"
    )
    lists = RS.drawn_lists(rows.select("idx"), 60, 300, 5)
    want = sorted(map(tuple, RS.weighted_sums(rows, lists, ["g"], ["n", "big"], 300).where("n > 0").collect()), key=str)
    monkeypatch.setattr(RS, "RANGE", 8)
    monkeypatch.setattr(RS, "PIECE", 25)
    got = RS.drawn_sums(rows, 60, ["g"], ["n", "big"], 300, 5).where("n > 0").collect()
    assert sorted(map(tuple, got), key=str) == want


def test_curve_intervals_keep_no_list_of_draws(spark, monkeypatch):
    from callmetrics.operators import curves as C

    def refused(*_):
        raise AssertionError("a list of draws per cluster")

    monkeypatch.setattr(RS, "drawn_lists", refused)
    calls = spark.createDataFrame(
        [("m", str(i), 2.0 + i % 4, "pass" if i % 4 < 2 else "fail_wrong", 100 + i) for i in range(40)],
        "model string, instance_id string, level_value double, outcome string, completion_tokens long",
    )
    assert C.curve_intervals(calls, 20, 3, ["model"]).where("replicates = 20").count() == 6


def test_scan_holds_few_rows_of_a_batch():
    """A full Arrow batch of 10,000 rows: memory follows the rows scanned at once, and sums don't change."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(1)
    rows = 10_000
    drawn = pa.array([rng.integers(0, RS.BLOCK, 20).astype(np.int32) for _ in range(rows)], pa.list_(pa.int32()))
    zero = np.zeros(rows, np.int64)
    columns = [zero, zero, zero, np.sort(rng.integers(0, 900, rows)) / 10, rng.integers(0, 2, rows), rng.integers(0, 2, rows)]
    batch = pa.RecordBatch.from_arrays([*map(pa.array, columns), drawn], names=["__gid", "cell", "block", "score", "pos", "neg", "drawn"])
    tracemalloc.start()
    (found,) = RS._scan(iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30_000_000
    weights = RS._weights(batch)
    pos, neg = columns[4][:, None] * weights, columns[5][:, None] * weights
    score = columns[3]
    first = np.searchsorted(score, score, "left")
    last = np.searchsorted(score, score, "right")
    upto = np.concatenate([np.zeros((1, RS.BLOCK), np.int64), np.cumsum(neg, axis=0)])
    assert found["pos"][0].as_py() == pos.sum(axis=0).tolist() and found["neg"][0].as_py() == neg.sum(axis=0).tolist()
    assert found["twice"][0].as_py() == (pos * (upto[first] + upto[last])).sum(axis=0).tolist()
