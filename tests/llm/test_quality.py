"""Held-out quality, pooling against a plain version, odd rows."""

import numpy as np
import pyarrow as pa
import pytest

from callmetrics.llm import quality as Q
from callmetrics.llm.kernels import text_buffer
from tests.llm.helpers import ODD_ROWS, docs_frame, write_documents, write_table

SF = "/root/testdata/sf0.01"


def test_context_sums_against_a_plain_loop(spark):
    texts = ["a b c d a", "", None, "b b", "c"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    table = Q.word_vectors(docs)
    places, signs = Q.index_vectors()
    index = np.zeros((Q.WORDS, Q.DIMENSIONS))
    for k in range(Q.NONZERO):
        index[np.arange(Q.WORDS), places[:, k]] += signs[:, k]
    number = {w: int(Q.words_of(*text_buffer(pa.array([w])))[0][0]) for w in "abcd"}
    sums, seen = np.zeros((Q.WORDS, Q.DIMENSIONS)), np.zeros(Q.WORDS)
    for text in texts:
        words = [number[w] for w in (text or "").split()]
        for i, w in enumerate(words):
            seen[w] += 1
            for j in range(max(0, i - Q.WINDOW), min(len(words), i + Q.WINDOW + 1)):
                if i != j:
                    sums[w] += index[words[j]]
    mean = sums.sum(axis=0) / np.abs(sums).sum()
    want = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9) - mean
    assert np.allclose(table.table[:, :Q.DIMENSIONS], want, atol=1e-5)
    assert np.allclose(table.weight, 1e-3 / (1e-3 + seen / seen.sum()))


def test_pooling_does_not_depend_on_neighbours():
    rng = np.random.default_rng(1)
    vectors = Q.Vectors(rng.normal(size=(Q.WORDS, 2 * Q.DIMENSIONS)).astype(np.float32), rng.random(Q.WORDS).astype(np.float32))
    texts = ["one two three", "", "one", None, "two two two one " * 50]
    whole = Q.pooled(vectors, *text_buffer(pa.array(texts)))
    single = np.vstack([Q.pooled(vectors, *text_buffer(pa.array([t], pa.string()))) for t in texts])
    assert np.allclose(whole, single, atol=1e-4)
    assert not whole[[1, 3]].any() and np.isfinite(whole).all()


def area(score, label):
    rank = score.rank()
    ones, zeros = (label == 1).sum(), (label == 0).sum()
    return (rank[label == 1].sum() - ones * (ones + 1) / 2) / (ones * zeros)


def test_held_out_quality(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    got = Q.op3_quality(spark, SF).toPandas()
    assert len(got) == 1000 and got["score"].between(0, 1).all()
    assert (got["predicted"] == (got["score"] >= 0.3)).all()
    held = got[got["held_out"]].merge(labels, on="doc_id")
    assert area(held["score"], held["quality"]) > 0.9
    assert held.loc[held["quality"] == 1, "predicted"].mean() > 0.95


def test_calibration_and_one_label():
    rng = np.random.default_rng(2)
    rows = rng.normal(size=(4000, 5)).astype(np.float32)
    labels = (rng.random(4000) < 1 / (1 + np.exp(-2 * rows[:, 0]))).astype(np.int64)
    held = np.arange(4000) % 5 == 0
    scores = Q.train(rows, labels, held).scores(rows)
    for low in np.arange(0, 1, 0.2):
        inside = held & (scores >= low) & (scores < low + 0.2)
        assert abs(scores[inside].mean() - labels[inside].mean()) < 0.12
    assert Q.train(rows, np.ones(4000, np.int64), held).scores(rows[:3]).tolist() == [1.0] * 3
    assert Q.train(rows[:0], labels[:0], held[:0]).scores(rows[:2]).tolist() == [0.5] * 2


@pytest.mark.parametrize("labelled", [[], [(4, 1), (6, 0), (6, None), (None, 1), (8, 0), (8, 0), (9, 1), (10, 1), (5, 1)]])
def test_odd_rows(spark, tmp_path, labelled):
    write_documents(tmp_path, ODD_ROWS)
    write_table(tmp_path, "labels", {"doc_id": [a for a, _ in labelled], "quality": [b for _, b in labelled]}, [("doc_id", pa.int64()), ("quality", pa.int32())])
    got = Q.op3_quality(spark, str(tmp_path)).collect()
    assert len(got) == len(ODD_ROWS) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out in (True, False) and r.predicted == int(r.score >= 0.3) for r in got)


def test_empty_table_and_extra_columns(spark):
    vectors = Q.word_vectors(docs_frame(spark, []).select("text"))
    docs = docs_frame(spark, [(1, "a b", "en", "a")])
    network = Q.fit(docs, spark.createDataFrame([], "doc_id long, quality int"), vectors)
    assert Q.with_quality(docs, vectors, network).first().score == 0.5
    assert Q.with_quality(docs.limit(0), vectors, network).count() == 0
