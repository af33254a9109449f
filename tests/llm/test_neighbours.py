"""Nearest neighbours against brute force."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from callmetrics.llm import neighbours as N


def brute(rows, asked, k=10):
    """Per query row (id, vector): its k nearest other rows, repeated rows once."""
    rows = sorted({(i, tuple(float(x) for x in v)) for i, v in rows})
    ids, vectors = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    out = set()
    for at, (i, v) in enumerate(rows):
        if asked(i):
            apart = np.sqrt(((vectors - np.array(v)) ** 2).sum(axis=1))
            order = [j for j in np.lexsort((ids, apart)) if j != at][:k]
            out |= {(i, rank, int(ids[j]), round(float(apart[j]), 9)) for rank, j in enumerate(order, 1)}
    return out


def found(frame):
    rows = [(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in frame.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def frame(spark, rows, extra=""):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", *([extra] if extra else []))


def asked(i):
    return i % 100 == 0


def queries():
    return F.col("vec_id") % 100 == 0


def rounded(vectors):
    return np.asarray(vectors, np.float32).astype(float).tolist()


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = list(enumerate(rounded(rng.normal(size=(300, 8)))))
    rows += [(1000 + i, rows[5][1]) for i in range(40)] + [(1100, rows[5][1]), (1200, rows[6][1])]  # copies, also of queries
    rows += [(7, rows[7][1])] * 3 + [(7, rows[8][1])] + [(0, rows[1][1])]  # repeated rows, ids with several vectors
    odd = [(2000, None), (2100, []), (2200, [0.0] * 8), (2300, [float("nan")] + [1.0] * 7), (2400, [float("inf")] + [1.0] * 7), (None, rows[0][1]),
           (2500, [None] + [1.0] * 7), (2600, [1.0] * 5)]
    got = found(N.nearest(frame(spark, rows + odd, "'x' as score"), queries()))
    assert got == brute(rows, asked)


def test_fewer_than_ten(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, -1.0]), (100, [1.0, 0.0])]
    assert found(N.nearest(frame(spark, rows), queries())) == brute(rows, asked)
    assert N.nearest(frame(spark, [(0, [1.0])]), queries()).count() == 0
    assert N.nearest(frame(spark, []), queries()).count() == 0
    assert N.nearest(frame(spark, rows[1:3]), queries()).count() == 0


@pytest.mark.parametrize("kind", ["clusters", "sphere", "outliers"])
def test_recall_of_the_index(spark, monkeypatch, kind):
    for name, value in (("CELL_ROWS", 32), ("BLOCK_ROWS", 100), ("SHARD_ROWS", 500), ("SAMPLE", 512), ("HELD", 500)):
        monkeypatch.setattr(N, name, value)
    rng = np.random.default_rng(2)
    if kind == "sphere":
        vectors = rng.normal(size=(4000, 24))
        vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    else:
        vectors = rng.normal(size=(40, 24))[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 24)) * 0.05
        vectors[:1300] = vectors[0]  # a third of all are copies
        vectors[1300:2600] = vectors[0] + rng.normal(size=(1300, 24)) * 1e-3  # and a third a crowd
    if kind == "outliers":
        vectors[[200, 3900]] *= 1e4
    rows = [(int(i), v) for i, v in zip(rng.permutation(4000), rounded(vectors))]
    got, want = found(N.nearest(frame(spark, rows), queries())), brute(rows, asked)
    assert len(got) == len(want) == 400
    near = {(q, i) for q, _, i, _ in want}
    assert sum((q, i) in near for q, _, i, _ in got) >= 0.9 * len(want)
    scores = {(q, i): s for q, _, i, s in want}
    assert all(abs(s - scores[q, i]) < 1e-6 for q, _, i, s in got if (q, i) in scores)


def test_likeliest_buckets_come_first():
    rng = np.random.default_rng(3)
    index = N.Index(rng.normal(size=(6, 4)), rng.random(4), 4, 2.0, 1.0)
    at = index.places(rng.normal(size=(5, 6))).reshape(5, 4)
    first = index._first(5).reshape(-1)
    keys, chance = index._likeliest(at, first, 50)
    every_keys, every = index._likeliest(at, first, 10**6)
    assert every.shape[1] == 5**4 and (np.diff(every, axis=1) <= 0).all()
    assert np.allclose(chance, every[:, :50]) and np.all(every.sum(axis=1) > 0.97)
    own = index.buckets(np.linalg.lstsq(index.directions.T, ((at - index.shifts) * 2.0).T, rcond=None)[0].T)[:, 0]
    assert all(k in row for k, row in zip(own.tolist(), every_keys.tolist()))


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_given_vectors(spark, sf):
    sf_dir = f"/root/testdata/{sf}"
    given = pq.read_table(f"{sf_dir}/embeddings.parquet", columns=["vec_id", "embedding"])
    want = brute(list(zip(given["vec_id"].to_pylist(), given["embedding"].to_pylist())), asked)
    got = found(N.op12_nearest_neighbours(spark, sf_dir))
    near = {(q, i) for q, _, i, _ in want}
    assert len(got) == len(want) and sum((q, i) in near for q, _, i, _ in got) >= 0.9 * len(want)


def test_query_reads_any_column(spark, tmp_path):
    rows = [(i, [float(i), 1.0]) for i in range(0, 300, 50)]
    pq.write_table(pa.table({
        "vec_id": pa.array([r[0] for r in rows]), "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float64())), "label": pa.array([1] * len(rows)),
    }), f"{tmp_path}/embeddings.parquet")
    assert found(N.op12_nearest_neighbours(spark, str(tmp_path))) == brute(rows, asked)
