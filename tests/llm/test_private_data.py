"""Personal data against the plain patterns."""

import hashlib
import random
import re
import time

import pytest

from callmetrics.llm import private_data as P
from tests.llm.helpers import ODD_ROWS, docs_frame, write_documents


def plain(text):
    found = []
    for kind, pattern in P.BASE_PATTERNS.items():
        for match in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", match.group())
            if kind == "ip" and any(int(part) > 255 for part in match.group().split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and P.luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            found.append((kind, match.start(), match.end()))
    return found


@pytest.mark.parametrize("alphabet", ["0123456789..@@+  --()ab%:/é", "0123 -", "a@b.c-", "+1 (0).-", "12.345", "token= iban:DE0123456789"])
def test_base_spans_are_the_patterns_matches(alphabet):
    rng = random.Random(alphabet)
    for _ in range(6000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(45)))
        assert [s for s in P.spans_of(text) if s[0] in P.BASE_KINDS] == plain(text), text


def test_added_kinds():
    found = lambda text: [(k, text[a:b]) for k, a, b in P.spans_of(text)]
    assert found("IBAN: DE89370400440532013000.") == [("account", "DE89370400440532013000")]
    assert found("iban DE89 3704 0044 0532 0130 00 today") == [("account", "DE89 3704 0044 0532 0130 00")]
    assert found("iban DE88370400440532013000") == []
    assert found('token = "24be64439e3e"') == [("account", "24be64439e3e")]
    assert found("subtoken 24be64439e3e, account number") == []
    assert ("url", "https://joe:pw@host.example/x") in found("see https://joe:pw@host.example/x.")
    assert found("see https://host.example/x") == []


def test_masking():
    text = "Mail a.b@c.de or +1 (017) 555-7713, card 4111 1111 1111 1111, from 10.0.0.1"
    assert P.masked(text) == "Mail [EMAIL] or [PHONE], card [CARD], from [IP]"
    assert P.masked(None) is None and P.masked("") == "" and P.masked("plain") == "plain"
    assert plain(P.masked(text)) == []


def test_query(spark, tmp_path):
    rows = [*ODD_ROWS, (20, "é a@b.cd 1.2.3.4 1.2.3.400", "en", "a"), (21, "9" * 20_000 + " a@b.c" * 5000, "en", "a")]
    write_documents(tmp_path, rows)
    got = {(r.doc_id, r.base_sha256): r for r in P.op9_private_data(spark, str(tmp_path)).collect()}
    for doc_id, text, *_ in rows:
        base = plain(text)
        row = got[doc_id, hashlib.sha256(P.joined(base).encode()).hexdigest()]
        for kind in P.BASE_KINDS:
            assert row[f"n_{kind}"] == sum(s[0] == kind for s in base)
        assert row.spans == P.joined(P.spans_of(text))


def test_columns_and_empty_table(spark):
    docs = docs_frame(spark, [(1, "x a@b.cd", "en", "a"), (2, None, None, None)], extra=True)
    masked = P.mask_private(docs)
    assert masked.columns == docs.columns
    assert [(r.text, r.n_chars, r.score) for r in masked.orderBy("doc_id").collect()] == [("x [EMAIL]", 9, "kept"), (None, None, "kept")]
    assert P.mask_private(docs.limit(0)).count() == 0


def plain_urls(text):
    """Addresses with a user, mark by mark."""
    found, floor = [], 0
    for mark in (m.start() for m in re.finditer("://", text)):
        if mark < floor:
            continue
        begin = mark
        while begin > floor and re.match(r"[A-Za-z0-9+.-]", text[begin - 1]):
            begin -= 1
        begin += len(re.match(r"[^A-Za-z]*", text[begin:mark]).group())
        token = re.match("[^ \t\n\r\v\f\"'<>|\\\\^`{}]*", text[mark + 3:]).group()
        user, at, rest = token.partition("@")
        if begin < mark and at and user and "/" not in user and re.match("[A-Za-z0-9]", rest):
            end = mark + 3 + len(token)
            while end > mark + 4 and text[end - 1] in ".,;:!?)":
                end -= 1
            found.append(("url", begin, end))
            floor = end
    return found


@pytest.mark.parametrize("alphabet", ["a:/@ ", "ab://@.1", "a:/@'x!", "://@a "])
def test_addresses_token_by_token(alphabet):
    rng = random.Random(alphabet)
    for _ in range(6000):
        text = "".join(rng.choice([*alphabet, "://", "a://b@c"]) for _ in range(rng.randrange(25)))
        assert [s for s in P.spans_of(text) if s[0] == "url"] == plain_urls(text), text


def test_long_runs_of_one_kind():
    zeros = "0" * 5000
    assert P.spans_of(f"{zeros}1.2.{zeros}3.255")[0] == ("ip", 0, 10009)
    assert not [s for s in P.spans_of(f"{zeros}1.2.3.256 1.2.3.{zeros}9999") if s[0] == "ip"]
    assert P.spans_of("iban DE12" + "A" * 10_000) == [] and P.spans_of("iban DE12" + "5" * 10_000) == []
    assert P.spans_of("token " + "a1" * 5000) == []
    junk = {
        "marks": "a://" * 250_000, "signs": "a@" * 400_000, "cues": "iban: " * 150_000, "cue run": "token" * 200_000, "plus": "+1" * 400_000,
        "digits": "1 " * 400_000, "dots": "1." * 400_000, "scheme": "a" * 800_000 + "://", "users": "a://b@" * 150_000, "zeros": "0" * 10**6,
        "labels": "a@" + "b." * 400_000, "letters": "iban DE12" + "A" * 10**6, "brackets": "+1" + "(" * 10**6, "quoted": "password='" * 80_000,
    }
    for name, text in junk.items():
        start = time.process_time()
        P.spans_of(text)
        assert time.process_time() - start < 4, name
