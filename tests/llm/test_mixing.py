"""Targets, balance and reruns of the mix."""

import re
from collections import defaultdict

import numpy as np
import pytest

from callmetrics.llm import mixing as M
from tests.llm.helpers import ODD_ROWS, docs_frame, sentence, write_documents


@pytest.mark.parametrize("seed", range(30))
def test_targets(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(0, 10 ** rng.integers(1, 6), rng.integers(1, 30)).tolist()
    found = M.targets(sizes)
    assert sum(found) == pytest.approx(1.5 * sum(sizes))
    level = {round(t / w, 6) for t, s, w in zip(found, sizes, [3, 1, 2] * 10) if t < 2 * s - 1e-6}
    assert len(level) <= 1  # all that are not full have the same share by weight
    assert all(t <= 2 * s + 1e-6 for t, s in zip(found, sizes))
    for t, s, w in zip(found, sizes, [3, 1, 2] * 10):
        if level and t >= 2 * s - 1e-6:
            assert 2 * s <= max(level) * w + 1e-3


@pytest.mark.parametrize("seed", range(20))
def test_flight_keeps_both_totals(seed):
    rng = np.random.default_rng(seed)
    size = rng.integers(0, 50, 300).astype(float)
    chance = rng.random(300)
    after = M.flight(chance, size, rng)
    assert ((after == 0) | (after == 1)).sum() >= 298 and ((after >= 0) & (after <= 1)).all()
    assert after.sum() == pytest.approx(chance.sum(), abs=1e-6)
    assert (after * size).sum() == pytest.approx((chance * size).sum(), abs=1e-4)


def test_flight_is_unbiased():
    size, chance = np.array([5.0, 1, 9, 4, 4, 7]), np.full(6, 0.4)
    mean = np.mean([M.flight(chance, size, np.random.default_rng(s)) for s in range(3000)], axis=0)
    assert np.allclose(mean, chance, atol=0.03)


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.mark.parametrize("block_rows", [8, 4096])
def test_query(spark, tmp_path, block_rows):
    rows = [(i, sentence(i, 1 + i * 7 % 90), "en", f"s{min(i % 9, 3)}") for i in range(400)]
    rows += [(1000 + i, sentence(i, 10), "en", None) for i in range(30)] + ODD_ROWS
    write_documents(tmp_path, rows)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = M.mix_sources(docs, block_rows=block_rows).collect()
    again = M.mix_sources(docs.repartition(5), block_rows=block_rows).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert sorted(str((r.doc_id, r.source, r.size)) for r in got) == sorted(str((i, s, words(t))) for i, t, _, s in rows)
    total = defaultdict(int)
    for i, t, _, s in rows:
        total[s] += words(t)
    order = sorted(total, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, M.targets([total[s] for s in order])))
    taken, count = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == total[r.source]
        assert 0 <= r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[r.source] += r.taken
        count[r.source] += 1
    for s in order:
        largest = max((words(t) for _, t, _, source in rows if source == s), default=0)
        # A source of one hot document can only be taken whole.
        assert abs(taken[s] - want[s]) <= (max(3, 0.002 * want[s]) if count[s] > 20 and largest < 1000 else largest)


def test_empty(spark):
    assert M.mix_sources(docs_frame(spark, [])).count() == 0
    got = M.mix_sources(docs_frame(spark, [(1, "", "en", "a"), (2, None, "en", "b")], extra=True)).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2
