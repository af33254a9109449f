"""Fingerprints against a plain version; successors across ranges."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from callmetrics.llm import syncmers as S
from callmetrics.llm.kernels import mix, text_buffer
from tests.llm.helpers import ODD_ROWS, docs_frame, sentence, write_documents


def inner_hash(data, at):
    return int(mix(np.array([int.from_bytes(data[at:at + S.S], "little")], np.uint64))[0])


def plain_starts(text):
    data = (text or "").encode()
    found = []
    for start in range(len(data) - S.K + 1):
        hashes = [inner_hash(data, start + i) for i in range(S.W)]
        if min(hashes) in (hashes[0], hashes[-1]):
            found.append(start)
    return found or ([0] if data else [])


def test_anchors_are_closed_syncmers(spark):
    texts = {i: t for i, t in enumerate(["", None, "short", "é" * 40, sentence(1, 60), "a" * 300, sentence(2, 4)])}
    docs = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    got = S.anchors(docs).collect()
    for i, text in texts.items():
        assert sorted(r.start for r in got if r.doc_id == i) == plain_starts(text)


def test_anchors_are_context_free():
    passage = sentence(3, 40)
    data, edges = text_buffer(pa.array([passage, sentence(4, 20) + " " + passage + sentence(5, 9)]))
    rows, starts, hashes = S.syncmers(data, edges)
    first, second = (dict(zip((starts[rows == r] - edges[r]).tolist(), hashes[rows == r].tolist())) for r in (0, 1))
    shift = len(sentence(4, 20)) + 1
    assert first and all(second[s + shift] == h for s, h in first.items())


def prints(*texts):
    data, edges = text_buffer(pa.array(texts))
    return [S._hex(s) for s in S.sketches(data, edges)]


def plain_likeness(a, b):
    """Longest common chain by quadratic dynamic programming over numbered anchors."""
    def anchors(text):
        seen, out = {}, []
        data = (text or "").encode()
        for start in plain_starts(text):
            window = data[start:start + S.K] if len(data) >= S.K else data
            seen[window] = seen.get(window, 0) + 1
            out.append((window, seen[window]))
        return out

    left, right = anchors(a), anchors(b)
    best = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    for i, x in enumerate(left):
        for j, y in enumerate(right):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_likeness():
    assert S.likeness("", "") == 1 and S.likeness("", "0000000001") == 0 and S.likeness(None, None) == 1
    one, two, three = ("00000000aa", "10000000bb", "10000000cc")
    assert S.likeness(one + two, one + three) == pytest.approx(S.K / (2 * (S.K + 16) - S.K))
    assert S.likeness(one + two, one + two + three) == pytest.approx((S.K + 16) / (2 * S.K + 48 - S.K - 16))


@pytest.mark.parametrize("seed", range(6))
def test_alignment_is_the_longest_common_chain(seed):
    rng = random.Random(seed)
    blocks = [sentence(100 * seed + i, 12) for i in range(8)] + ["ab" * 60]
    a, b = (" ".join(rng.choices(blocks, k=6)) for _ in range(2))
    data, edges = text_buffer(pa.array([a, b]))
    left, right = S.sketches(data, edges)
    at, to = S.aligned(left, right)
    assert (np.diff(at) > 0).all() and (np.diff(to) > 0).all()
    assert all(a.encode()[i:i + S.K] == b.encode()[j:j + S.K] for i, j in zip(at.tolist(), to.tolist()))
    assert len(at) == plain_likeness(a, b)


def test_no_edit_goes_unseen_and_moves_count_less():
    import pyarrow.parquet as pq

    given = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"])["text"].to_pylist()
    long = [t for t in given if len(t) > 20_000]
    assert len(long) > 40
    for number, text in enumerate(long):
        rng = random.Random(number)
        at = rng.randrange(100, len(text) - 5000)
        edited = text[:at] + "".join("~" if c != "~" else "-" for c in text[at:at + 20]) + text[at + 20:]
        single = text[:at] + ("~" if text[at] != "~" else "-") + text[at + 1:]
        moved = text[:at] + text[at + 2000:at + 4000] + text[at:at + 2000] + text[at + 4000:]
        own, *others = prints(text, edited, single, moved)
        same, edit, letter, move = (S.likeness(own, x) for x in (own, *others))
        if text[at:at + 2000] != text[at + 2000:at + 4000]:
            assert same == 1 > max(letter, edit) >= min(letter, edit) > move > 0.4, (number, letter, edit, move)
            # Of anchors that occur once, only those whose windows touch the edit are others.
            data, edges = text_buffer(pa.array([text, edited]))
            low, high = len(text[:at].encode()), len(text[:at + 20].encode())
            left, right = S.sketches(data, edges)
            kept, _ = S.aligned(left, right)
            _, which, count = np.unique(left["hash"], return_inverse=True, return_counts=True)
            starts = np.cumsum(left["gap"], dtype=np.int64)
            assert len(kept) < len(starts)
            lost = np.setdiff1d(starts[count[which] == 1], kept)
            assert (lost > low - S.K).all() and (lost < high).all()


def test_likeness_of_long_repetitive_texts():
    a, b, c = prints("ab" * 100_000, "ab" * 100_000 + "c", "ba" * 50_000)
    assert S.likeness(a, b) > 0.99 and 0.45 < S.likeness(a, c) < 0.55


def check(rows, got):
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] or "")
    ordered = sorted(rows, key=key)
    texts = [r[1] or "" for r in ordered]
    want = []
    for i, (row, text) in enumerate(zip(ordered, texts)):
        half = len(text) // 2
        edited = text[:len(text) - half] + texts[(i + 1) % len(texts)][:half]
        want.append((str(row[0]), len(text), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    prints = {}
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert r.near_edited == S.likeness(r.fingerprint, r.edited_fingerprint)
        prints[str(r.doc_id), r.n_chars] = r.fingerprint
    follow = {(str(row[0]), len(t)): prints[str(ordered[(i + 1) % len(texts)][0]), len(texts[(i + 1) % len(texts)])]
              for i, (row, t) in enumerate(zip(ordered, texts))}
    for r in got:
        if sum(str(r.doc_id) == str(row[0]) for row in rows) == 1:
            assert r.near_next == S.likeness(r.fingerprint, follow[str(r.doc_id), r.n_chars])


@pytest.mark.parametrize("rows", [
    [(3, "only one document here, alone", "en", "a")],
    [(3, None, "en", "a")],
    [(i * 7 % 101, sentence(i, 1 + i % 30), "en", "a") for i in range(100)],
    [(2**62 + i, sentence(i, 9), "en", "a") for i in range(60)],
    [(-i, sentence(i, 9), "en", "a") for i in range(20)] + ODD_ROWS,
])
def test_query(spark, tmp_path, rows):
    write_documents(tmp_path, random.Random(1).sample(rows, len(rows)))
    check(rows, S.op2_fingerprints(spark, str(tmp_path)).collect())


def test_equal_texts_and_empty_table(spark, tmp_path):
    text = sentence(8, 80)
    docs = docs_frame(spark, [(1, text, "en", "a"), (2, text, "de", "b")], extra=True)
    assert S.with_fingerprint(docs).select("fingerprint").distinct().count() == 1
    write_documents(tmp_path, [])
    assert S.op2_fingerprints(spark, str(tmp_path)).count() == 0
    assert S.anchors(docs.limit(0)).count() == 0


def test_likeness_falls_with_the_share_of_common_text():
    rng = random.Random(4)
    base = sentence(9, 400)
    data, edges = text_buffer(pa.array([base, base[:1500] + sentence(rng.randrange(99), 150), sentence(77, 400)]))
    a, b, c = map(S._hex, S.sketches(data, edges))
    assert S.likeness(a, b) > 0.3 > 0.1 > S.likeness(a, c)
