"""Importance resampling against a plain version, feature by feature."""

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from callmetrics.llm import importance as I
from tests.llm.helpers import ODD_ROWS, docs_frame, sentence, write_documents, write_table


def plain_features(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def bucket(feature, buckets=10_000):
    return zlib.crc32(feature.encode()) % buckets


def plain_rows(docs, target):
    """(doc_id, n_features, weight, score, n_words) per document."""
    s, t = np.zeros(10_000), np.zeros(10_000)
    for counts, texts in ((s, [d[1] for d in docs]), (t, target)):
        for text in texts:
            for f in plain_features(text)[1]:
                counts[bucket(f)] += 1
    S, T = s.sum(), t.sum()
    out = []
    for doc_id, text in docs:
        words, features = plain_features(text)
        total = sum(math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000)))) for b in map(bucket, features))
        weight = total // len(features) if features else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((doc_id, len(features), weight, score, len(words)))
    return out


TEXTS = [
    None, "", " ", "!?", "One", "a b", "É é ÉA z9 9z", "x" * 300_000, "tab\tnew\nline\x00nul\x7fdel", "da-da_da da da",
    "日本 語 \U0001f600", "word " * 5000,
]


@pytest.mark.parametrize("piece_bytes", [1, 40, 1 << 21])
def test_buckets_of_words_and_pairs(monkeypatch, piece_bytes):
    monkeypatch.setattr(I, "PIECE_BYTES", piece_bytes)
    want, got = np.zeros(997, np.int64), np.zeros(997, np.int64)
    for text in TEXTS:
        for f in plain_features(text)[1]:
            want[bucket(f, 997)] += 1
    for piece in I._pieces(pa.array([None, *TEXTS]).slice(1)):
        got += I.Features(piece, 997).counts(997)
    assert np.array_equal(got, want)
    gains = np.arange(997) - 400
    weights = [w for piece in I._pieces(pa.array(TEXTS)) for w in I.Features(piece, 997).weights(gains)[2]]
    for text, weight in zip(TEXTS, weights):
        features = plain_features(text)[1]
        assert weight == (sum(bucket(f, 997) - 400 for f in features) // len(features) if features else 0)


@pytest.mark.parametrize("length", [0, 1, 2, 7, 255, 70_000])
def test_crc_of_joined_texts(length):
    rng = np.random.default_rng(length)
    heads = [rng.bytes(n) for n in (0, 1, 9, 100)]
    tail = rng.bytes(length)
    got = I.appended(
        np.array([zlib.crc32(h) for h in heads], np.uint32), np.full(4, length), np.full(4, zlib.crc32(tail), np.uint32)
    )
    assert got.tolist() == [zlib.crc32(h + tail) for h in heads]


def test_query_against_plain_version(spark, tmp_path):
    rows = [(i, sentence(i, i % 60), "en", "a") for i in range(100, 300)]
    rows += [(1000 + i, sentence(3, 30), "en", "a") for i in range(80)]  # copies
    rows += [(2000, sentence(4, 40), "en", "a")] * 3 + ODD_ROWS
    target = [None, "", sentence(4, 40), sentence(5, 50)]
    write_documents(tmp_path, rows)
    write_table(tmp_path, "benchmark", {"item_id": list(range(len(target))), "text": target}, [("item_id", pa.int64()), ("text", pa.string())])
    got = I.op11_importance_resampling(spark, str(tmp_path)).collect()
    want = plain_rows([r[:2] for r in rows], target)
    key = lambda r: tuple(-10**9 if x is None else x for x in r)
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score) for r in got), key=key) == sorted((w[:4] for w in want), key=key)
    enough = sorted(((-w[3], w[0] is None, w[0] or 0) for w in want if w[4] >= 20))
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, 25 * len(enough) // 100 + 1))
    assert [(-r.score, r.doc_id is None, r.doc_id or 0) for r in ranked] == enough[:len(ranked)]


def test_drawn_rows_keep_their_columns(spark):
    rows = [(i, sentence(i, 30), "en", "a") for i in range(200)] + [r for r in ODD_ROWS if r[0] is not None]
    docs = docs_frame(spark, rows, extra=True)
    target = spark.createDataFrame([(1, sentence(3, 300))], "item_id long, text string")
    kept = I.resampled(docs, target)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.collect())
    scored = I.importance(docs, target)
    ranked = sorted(r.doc_id for r in I.drawn(scored).where("rank IS NOT NULL").collect())
    assert ids == ranked and len(ids) == 25 * scored.where("n_words >= 20").count() // 100
    assert {r.score for r in kept.collect()} == {"kept"}


def test_targets_pull_their_own_kind(spark):
    rows = [(i, sentence(i, 60), "en", "a") for i in range(200)] + [(500 + i, "rare " * 30, "en", "a") for i in range(100)]
    target = spark.createDataFrame([(1, "rare " * 40_000)], "item_id long, text string")
    ids = [r.doc_id for r in I.resampled(docs_frame(spark, rows), target).collect()]
    assert sum(i >= 500 for i in ids) > 2 * len(ids) / 3


def test_empty_tables(spark):
    docs, target = docs_frame(spark, []), spark.createDataFrame([], "item_id long, text string")
    assert I.drawn(I.importance(docs, target)).count() == 0
    assert I.resampled(docs, target).count() == 0
    some = docs_frame(spark, [(1, "one", "en", "a")])
    assert [r["rank"] for r in I.drawn(I.importance(some, target)).collect()] == [None]
    assert I.resampled(some, target).count() == 0
