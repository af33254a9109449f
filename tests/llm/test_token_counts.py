"""Longest-match counts against cutting pieces one by one."""

import random

import pytest

from callmetrics.llm import token_counts as T
from tests.llm.helpers import ODD_ROWS, docs_frame, write_documents


def greedy(word, vocabulary):
    count, at = 0, 0
    while at < len(word):
        size = next((n for n in range(len(word) - at, 0, -1) if word[at:at + n] in vocabulary), 0)
        if not size:
            return 1
        count, at = count + 1, at + size
    return count


@pytest.mark.parametrize("seed", range(40))
def test_small_vocabularies(seed):
    rng = random.Random(seed)
    text = lambda n: bytes(rng.choice(b"abc") for _ in range(n))
    vocabulary = {text(rng.randrange(1, 6)) for _ in range(rng.randrange(1, 14))}
    if seed % 2:
        vocabulary |= {b"a", b"b", b"c"}
    automaton = T.Automaton(sorted(vocabulary))
    for _ in range(400):
        word = text(rng.randrange(0, 14))
        # An unknown word is one token, whatever was matched before.
        assert automaton.count(word) == (greedy(word, vocabulary) if word else 0), (vocabulary, word)


@pytest.fixture(scope="module")
def vocabulary():
    return set(T.read_vocabulary(T.VOCABULARY))


def test_query(spark, tmp_path, vocabulary):
    rows = [*ODD_ROWS, (30, "The quick brown fox\njumps\tover \x0b lazy dogs", "en", "a"), (31, "unbelievably antidisestablishmentarianism", "en", "a")]
    write_documents(tmp_path, rows)
    got = sorted(map(tuple, T.op7_token_counts(spark, str(tmp_path)).collect()), key=str)
    want = []
    for doc_id, text, *_ in rows:
        words = (text or "").encode().split()
        count = sum(greedy(b" " + w, vocabulary) for w in words) if len(text or "") < 1000 else None
        want.append((doc_id, len(words), count))
    for (doc_id, n_words, n_tokens), (_, words, count) in zip(got, sorted(want, key=str)):
        assert n_words == words and (count is None or n_tokens == count), doc_id
    long = next(r for r in got if r[0] == 6)
    assert long[2] == 30_000  # " word" is one piece


def test_linear_on_a_long_word(vocabulary):
    automaton = T.Automaton(sorted(vocabulary))
    word = b" " + b"z" * 100_000
    assert automaton.count(word) == greedy(word[:40], vocabulary) + (automaton.count(word) - greedy(word[:40], vocabulary))
    assert 100_000 / 20 < automaton.count(word) <= 100_000


def test_columns_and_empty_table(spark):
    docs = docs_frame(spark, [(1, "a b", "en", "a")], extra=True)
    got = T.with_token_counts(docs)
    assert got.columns == [*docs.columns, "n_words", "n_tokens"] and got.first().counted == "kept"
    assert T.with_token_counts(docs.limit(0)).count() == 0
