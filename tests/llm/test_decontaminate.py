"""Greedy string tiling against a quadratic version, and planted leaks."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from callmetrics.llm import decontaminate as D
from tests.llm.helpers import ODD_ROWS, docs_frame, sentence


def plain_tiling(item, doc, least):
    """Marks the longest match of free tokens again and again."""
    free_item, free_doc, total = [True] * len(item), [True] * len(doc), 0
    while True:
        best = 0
        for p in range(len(item)):
            for q in range(len(doc)):
                n = 0
                while p + n < len(item) and q + n < len(doc) and item[p + n] == doc[q + n] and free_item[p + n] and free_doc[q + n]:
                    n += 1
                if n > best:
                    best, at = n, (p, q)
        if best < least:
            return total
        for k in range(best):
            free_item[at[0] + k] = free_doc[at[1] + k] = False
        total += best


@pytest.mark.parametrize("seed", range(60))
def test_tiling_covers_as_much_as_the_quadratic_version(seed):
    rng = random.Random(seed)
    item = np.array([rng.randrange(4 + seed) for _ in range(rng.randrange(1, 40))], np.uint64)
    doc = list(rng.randrange(4 + seed) for _ in range(rng.randrange(1, 80)))
    cut = rng.randrange(len(item))
    doc = np.array(doc[:20] + item[cut:].tolist() + doc[20:] + item[:cut].tolist(), np.uint64)
    tiles = D.tiling(item, doc, 3)
    used_item, used_doc = set(), set()
    for p, q, n in tiles:
        assert n >= 3 and (item[p:p + n] == doc[q:q + n]).all()
        assert not used_item & set(range(p, p + n)) and not used_doc & set(range(q, q + n))
        used_item |= set(range(p, p + n))
        used_doc |= set(range(q, q + n))
    # Which of several longest matches is marked first may differ, the longest may not.
    assert max((t[2] for t in tiles), default=0) == max((n for n in [longest(item, doc)] if n >= 3), default=0)
    if seed > 20:  # few repeated tokens: one way to tile
        assert len(used_item) == plain_tiling(item.tolist(), doc.tolist(), 3)


def longest(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else 0)
        best, row = max(best, max(new)), new
    return best


def tokens(text):
    return re.findall(r"[^\W_]+", text.lower())


def test_leaks_are_found_and_clean_documents_are_left(spark):
    items = [(n, sentence(n, 20 + n)) for n in range(12)] + [(50, "too short"), (51, None), (52, ""), (53, "...")]
    whole = sentence(3, 23)
    words = whole.split()
    turned = " ".join(words[12:] + ["between"] + words[:12])
    rows = [
        (1, f"{sentence(100, 30)} {whole} {sentence(101, 30)}", "en", "a"),
        (2, f"Prefix: {turned.upper()}!", "en", "a"),
        (3, sentence(200, 400), "en", "a"),
        (4, " ".join(words[:6]) + " " + sentence(201, 50), "en", "a"),
        (5, ", ".join(words[:18]), "en", "a"),
        (6, "Too,  short.", "en", "a"),
        (7, "this is too short", "en", "a"),
        (None, whole, "en", "a"), (8, whole, "en", "a"), (8, whole, "en", "a"),
    ]
    docs = docs_frame(spark, rows + [(i and i + 100, *r) for i, *r in ODD_ROWS], extra=True)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for block_bytes in (D.BLOCK_BYTES, 200):
        found = D.leaks(docs, benchmark, block_bytes=block_bytes).collect()
        assert sorted((str(r.doc_id), r.item_id) for r in found) == sorted(
            [("1", 3), ("2", 3), ("5", 3), ("6", 50), ("7", 50), ("None", 3), ("8", 3), ("8", 3)]
        )
        by_doc = {r.doc_id: r for r in found}
        assert by_doc[2].n_tiles == 2 and by_doc[2].coverage == 1 and by_doc[5].coverage == pytest.approx(18 / 23)
        kept = D.without_leaks(docs, benchmark, block_bytes=block_bytes)
        assert kept.columns == docs.columns
        assert sorted(str(r.doc_id) for r in kept.select("doc_id").collect()) == sorted(
            ["3", "4", *(str(i and i + 100) for i, *_ in ODD_ROWS)]
        )


def test_empty_tables(spark):
    docs = docs_frame(spark, [])
    benchmark = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    assert D.leaks(docs, benchmark).count() == 0
    assert D.leaks(docs_frame(spark, ODD_ROWS), benchmark.limit(0)).count() == 0
    assert D.without_leaks(docs_frame(spark, ODD_ROWS), benchmark.limit(0)).count() == len(ODD_ROWS)


def test_tokens_do_not_cross_rows_or_punctuation():
    from callmetrics.llm.kernels import text_buffer
    import pyarrow as pa

    texts = ["ab cd", "", "ef—gh «ij»", "ab", None, "cdé ef"]
    hashes, owner = D.tokens_of(*text_buffer(pa.array(texts)))
    want = [(row, t) for row, text in enumerate(texts) for t in tokens(text or "")]
    assert owner.tolist() == [r for r, _ in want]
    names = {}
    for h, (_, t) in zip(hashes.tolist(), want):
        assert names.setdefault(h, t) == t
    assert len(names) == len({t for _, t in want})


@pytest.mark.parametrize("period", [1, 2, 7])
def test_repetitive_texts_stay_cheap(period):
    import time
    import tracemalloc

    item = np.resize(np.arange(1, period + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), 1000)
    doc = np.resize(item[:period], 20_000)
    tracemalloc.start()
    start = time.process_time()
    assert D.tiling(item, doc) == [(0, 0, 1000)]
    assert time.process_time() - start < 5
    words = ["w" + "x" * i for i in range(period)]
    index = D.BlockIndex.build([(1, " ".join(words[i % period] for i in range(1000)))], D.MIN_TILE)
    data, edges = D.text_buffer(pa.array([" ".join(words[i % period] for i in range(20_000)), "w q"]))
    found = index.leaks(*D.tokens_of(data, edges), 2, D.MIN_TILE, D.COVERAGE)
    assert list(found) == [0] and found[0][0]["coverage"] == 1
    assert time.process_time() - start < 10 and tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()


def test_short_items_are_found_as_one_run(spark):
    docs = docs_frame(spark, [(1, "we saw Red, green  cars go", "en", "a"), (2, "red cars are green", "en", "a"), (3, "red green cars", "en", "a"), (4, "green cars", "en", "a")])
    items = spark.createDataFrame([(1, "red green cars"), (2, "cars"), (3, "...")], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.tiles) for r in D.leaks(docs, items).collect()}
    assert got == {(1, 1, "0:2:3"), (3, 1, "0:0:3"), (1, 2, "0:4:1"), (2, 2, "0:1:1"), (3, 2, "0:2:1"), (4, 2, "0:1:1")}
