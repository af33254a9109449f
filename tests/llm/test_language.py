"""Held-out accuracy, exactness of the folded scores, odd rows."""

import math

import numpy as np
import pyarrow as pa
import pytest

from callmetrics.llm import language as L
from callmetrics.llm.kernels import text_buffer
from tests.llm.helpers import ODD_ROWS, docs_frame, write_documents

SF = "/root/testdata/sf0.01"


def grams(text):
    """Places of the n-grams of one text, one by one."""
    data, out = (text or "").lower().encode(), set()
    for size in range(1, L.MAX_GRAM + 1):
        for i in range(len(data) - size + 1):
            packed = int.from_bytes(data[i:i + size], "big")
            mixed = ((packed + size) * 0x9E3779B1 & 0xFFFFFFFF) ^ (packed >> 15)
            out.add((mixed * 0x85EBCA6B & 0xFFFFFFFF) >> 16)
    return out


def test_presence_is_the_set_of_ngrams():
    texts = ["", "a", "abcabc", "é ü", None, "the end"]
    data, edges = text_buffer(pa.array([None if t is None else t.lower() for t in texts]))
    marks = np.zeros((len(texts), L.FEATURES), np.uint8)
    L.presence(data, edges, marks)
    assert [set(np.flatnonzero(row).tolist()) for row in marks] == [grams(t) for t in texts]


def test_scores_are_kernel_ridge_regression(spark):
    """The folded matrix gives what kernels against all landmarks give."""
    rows = [(i, t, lang, "a") for i, (t, lang) in enumerate(
        [("the cat and the dog", "en"), ("der hund und die katze", "de"), ("le chien et le chat", "fr")] * 4)]
    model = L.fit(docs_frame(spark, rows), landmarks=64, folds=None)
    texts = [r[1] for r in sorted(rows)]
    sets = [grams(t) for t in texts]
    kernel = np.array([[len(a & b) / math.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    target = np.array([[float(r[2] == lang) for lang in model.languages] for r in rows])
    data, edges = text_buffer(pa.array(texts))
    got = L.scores(model, data, edges)
    # With every text a landmark, Nystroem is exact: ridge in the kernel's own space.
    centre = np.eye(len(sets)) - 1 / len(sets)
    solved = np.linalg.pinv(centre @ kernel @ centre + L.RIDGE * len(sets) * np.eye(len(sets))) @ (centre @ target)
    want = target.mean(axis=0) + centre @ kernel @ centre @ solved
    assert np.allclose(got, want, atol=1e-3)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas().set_index("doc_id")
    got = L.op5_language_id(spark, SF).toPandas().set_index("doc_id")
    assert len(got) == len(docs) and got["score"].between(0, 1).all()
    held = got[got["held_out"]]
    assert 0.2 < len(held) / len(got) < 0.5
    assert (held["lang_pred"] == docs.loc[held.index, "lang"]).mean() > 0.98


def test_odd_rows(spark, tmp_path):
    write_documents(tmp_path, ODD_ROWS)
    got = L.op5_language_id(spark, str(tmp_path)).collect()
    assert len(got) == len(ODD_ROWS)
    assert all((r.lang_pred, r.score) == (L.UNDETERMINED, 0.0) for r in got if r.doc_id in (1, 2, 3, 7))
    assert all(r.lang_pred in ("en", "de", "fr") for r in got if r.doc_id not in (1, 2, 3, 7))


def test_nothing_to_learn(spark):
    docs = docs_frame(spark, [(1, "some words", None, "a"), (2, "123", None, "a")], extra=True)
    model = L.fit(docs)
    assert model.languages == []
    assert {r.lang_pred for r in L.with_language(docs, model).collect()} == {L.UNDETERMINED}
    assert [r.doc_id for r in L.in_known_language(docs, model).collect()] == [1]
    assert L.fit(docs.limit(0)).languages == []


def test_stage_keeps_columns_and_clean_rows(spark):
    rows = [(i, "the cat and the dog are here", "en", "a") for i in range(6)] + [(9, "der hund und die katze", "de", "a"), (10, "the dog", None, "a")]
    docs = docs_frame(spark, rows + [(20, "?? 11", "en", "a"), (21, None, "en", "a")], extra=True)
    kept = L.in_known_language(docs, L.fit(docs, folds=None))
    assert kept.columns == docs.columns
    found = {r.doc_id: r for r in kept.collect()}
    assert sorted(found) == [0, 1, 2, 3, 4, 5, 9, 10]
    assert found[10].lang == "en" and found[9].lang == "de" and {r.score for r in found.values()} == {"kept"}
