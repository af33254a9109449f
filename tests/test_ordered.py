"""Ordered core against brute force, with hot groups and hot keys."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from callmetrics.operators import ordered as R


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    n = 4000
    frame = pd.DataFrame({
        "g": np.where(rng.random(n) < 0.4, "hot", rng.integers(0, 30, n).astype(str)),
        "k": np.where(rng.random(n) < 0.35, 7, rng.integers(0, 500, n)),
        "id": rng.permutation(n), "v": rng.integers(-5, 20, n),
    })
    return spark.createDataFrame(frame).repartition(7), frame.sort_values(["g", "k", "id"])


def test_prefix_sums_and_rank(skewed):
    df, frame = skewed
    out = R.prefix_sums(df, "k", {"before": "v"}, ["g"], ["k", "id"], totals={"all": "v"}, tie="id", minima={"low": "v"}).toPandas()
    grouped = frame.groupby("g")["v"]
    want = frame.assign(before=grouped.cumsum() - frame["v"], all=grouped.transform("sum"), low=grouped.transform("min"))
    merged = out.merge(want, on="id", suffixes=("", "_w"))
    assert len(merged) == len(frame)
    for c in ("before", "all", "low"):
        assert (merged[c] == merged[f"{c}_w"]).all()
    rank = R.ranked(df, "k", order=["k", "id"], tie="id", size="n").toPandas().sort_values("rank")
    assert list(rank["rank"]) == list(range(len(frame))) and set(rank["n"]) == {len(frame)}
    assert list(rank["id"]) == list(frame.sort_values(["k", "id"])["id"])


def test_hot_key_is_split(skewed):
    df, _ = skewed
    cells = R.with_cell(df, "k", tie="id").where("k = 7").select(R.CELL).distinct().count()
    assert cells > 1
    assert R.with_cell(df, "k").where("k = 7").select(R.CELL).distinct().count() == 1


def test_lagged(skewed):
    df, frame = skewed
    out = R.lagged(df, "k", {"prev": "v"}, ["g"], ["k", "id"], tie="id").toPandas()
    want = frame.assign(prev=frame.groupby("g")["v"].shift())
    merged = out.merge(want, on="id", suffixes=("", "_w"))
    assert ((merged["prev"] == merged["prev_w"]) | (merged["prev"].isna() & merged["prev_w"].isna())).all()


def test_quantiles_match_numpy(skewed):
    df, frame = skewed
    out = R.quantiles(df, "v", {"a": 0.025, "m": 0.5, "z": 0.975}, ["g"]).toPandas().set_index("g")
    for g, part in frame.groupby("g"):
        assert np.allclose(out.loc[g, ["a", "m", "z"]].astype(float), np.quantile(part["v"], [0.025, 0.5, 0.975]))
    one = R.quantiles(df, "v", {"m": 0.3}).first()
    assert one["m"] == pytest.approx(np.quantile(frame["v"], 0.3))


def test_first_k_drops_nothing_inside_k(skewed):
    df, frame = skewed
    out = R.first_k(df, "k", F.ceil(F.col("size") * 0.1), ["g"], ["k", "id"]).toPandas()
    for g, part in frame.groupby("g"):
        want = part.head(int(np.ceil(len(part) * 0.1)))
        assert set(out.loc[out["g"] == g, "id"]) == set(want["id"])


def test_empty_input(spark):
    empty = spark.createDataFrame([], "g string, k bigint, v bigint")
    assert R.prefix_sums(empty, "k", {"b": "v"}, ["g"]).count() == 0
    assert R.quantiles(empty, "v", {"m": 0.5}, ["g"]).count() == 0


NULLED = [(None, 3, 1, 5), (None, None, 2, 7), ("a", None, 3, 1), ("a", None, 4, None), ("a", 1, 5, 2), ("a", 1, 6, 3), ("b", None, 7, 4), (None, 3, 8, 6)]


def nulled(spark):
    return spark.createDataFrame(NULLED * 1, "g string, k bigint, id bigint, v bigint").repartition(3)


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2]))


@pytest.mark.parametrize("tie", [None, "id"])
def test_null_groups_and_keys_are_kept(spark, tie):
    out = {r["id"]: r for r in R.ranked(nulled(spark), "k", ["g"], ["k", "id"], size="n", tie=tie).collect()}
    back = {r["id"]: r for r in R.lagged(nulled(spark), "k", {"prev": "id"}, ["g"], ["k", "id"], tie=tie).collect()}
    first = {r["id"] for r in R.first_k(nulled(spark), "k", F.lit(1), ["g"], ["k", "id"]).collect()}
    assert len(out) == len(back) == len(NULLED)
    heads = set()
    for g in (None, "a", "b"):
        rows = in_order([r for r in NULLED if r[0] == g])
        heads.add(rows[0][2])
        for i, row in enumerate(rows):
            assert (out[row[2]]["rank"], out[row[2]]["n"]) == (i, len(rows))
            assert back[row[2]]["prev"] == (rows[i - 1][2] if i else None)
    assert first == heads


def test_null_keys_are_cut_by_the_tie(spark):
    df = spark.range(400).selectExpr("'g' AS g", "cast(null AS bigint) AS k", "id")
    assert R.with_cell(df, "k", tie="id").select(R.CELL).distinct().count() > 1
    ranks = R.ranked(df, "k", ["g"], ["k", "id"], tie="id").collect()
    assert all(r["rank"] == r["id"] for r in ranks)


def test_groups_without_a_value_stay(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", 2), ("b", None), (None, 4)], "g string, v bigint")
    got = {r["g"]: (r["n"], r["m"]) for r in R.quantiles(df, "v", {"m": 0.5}, ["g"]).collect()}
    assert got == {"a": (0, None), "b": (1, 2.0), None: (1, 4.0)}


def test_correlated_tie(spark):
    """A heavy key whose tie values lie in a narrow range of all ties."""
    df = spark.range(3000).selectExpr("'g' AS g", "CASE WHEN id < 1500 THEN 5 ELSE id END AS k", "id")
    out = R.ranked(df, "k", ["g"], ["k", "id"], tie="id").collect()
    assert all(r["rank"] == r["id"] for r in out)
    assert R.with_cell(df, "k", tie="id").where("k = 5").select(R.CELL).distinct().count() > 2
