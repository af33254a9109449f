"""Personal data by anchor expansion (operator 9).

An Aho-Corasick automaton walks each whole text once and reports the anchors:
at-signs, plus signs, digits, scheme marks and cue words. Small deterministic
parsers expand an anchor to both sides and validate what they find:

* ``email``, ``ip``, ``card`` and ``phone`` give exactly the leftmost
  non-overlapping matches of ``BASE_PATTERNS``, of which failing ones (an ip
  part over 255, a card of a wrong length or checksum, a phone of a wrong
  length) are dropped without a second try;
* ``url``: an address with a user in it, around ``://``;
* ``account``: an identifier of 6 to 64 letters and digits, at least one a
  digit, behind a cue such as ``iban`` or ``account``; an IBAN's check digits
  must be right.

Spans are code points, end exclusive. Spans of one kind never overlap; spans
of different kinds may. A null or empty text has none. Repeated rows are
treated alike; columns of other names are left alone. Time follows the length of
a text: every run of characters is read a bounded number of times, whatever
stands in it (digits with thousands of leading zeros, a cue before thousands of
letters, thousands of scheme marks in one token).
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from callmetrics.llm.common import small_batches, table

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account")

BASE_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

CUES = ("iban", "account", "acct", "konto", "compte", "cuenta", "token", "api_key", "apikey", "secret", "password")

IBAN_LENGTH = 34

_DIGITS = frozenset("0123456789")
_ALNUM = _DIGITS | frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LOCAL = _ALNUM | frozenset("._%+-")
_LABEL = _ALNUM | frozenset("-")
_PHONE = _DIGITS | frozenset(" ().-")
_SCHEME = _ALNUM | frozenset("+.-")
_URL_END = frozenset(" \t\n\r\v\f\"'<>|\\^`{}")

Span = tuple[str, int, int]


@lru_cache(maxsize=1)
def _anchors() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for sign in "@+0123456789":
        automaton.add_word(sign, sign)
    automaton.add_word("://", "://")
    for cue in CUES:
        for form in {cue, cue.capitalize(), cue.upper()}:
            automaton.add_word(form, cue)
    automaton.make_automaton()
    return automaton


def _run(text: str, at: int, allowed: frozenset) -> int:
    """End of the run of allowed characters that begins at ``at``."""
    end = len(text)
    while at < end and text[at] in allowed:
        at += 1
    return at


def _email(text: str, sign: int, floor: int) -> tuple[int, int] | None:
    """Expand an at-sign; nothing before ``floor`` may be used again."""
    begin = sign
    while begin > floor and text[begin - 1] in _LOCAL:
        begin -= 1
    end = _run(text, sign + 1, _LABEL)
    if begin == sign or end == sign + 1:
        return None
    labels = 1
    while end < len(text) and text[end] == ".":
        following = _run(text, end + 1, _LABEL)
        if following == end + 1:
            break
        end, labels = following, labels + 1
    return (begin, end) if labels > 1 else None


def _ip(text: str, begin: int) -> tuple[int, int] | None:
    """Four dotted runs of digits that begin at a run's first digit."""
    end = _run(text, begin, _DIGITS)
    for _ in range(3):
        if end >= len(text) or text[end] != ".":
            return None
        following = _run(text, end + 1, _DIGITS)
        if following == end + 1:
            return None
        end = following
    return begin, end


def _octet(digits: str) -> bool:
    """Digits without leading zeros, of any number."""
    return len(digits) < 3 or len(digits) == 3 and digits <= "255"


def _card(text: str, begin: int) -> int:
    """End of the digits joined by single spaces or hyphens."""
    end, size = begin + 1, len(text)
    while end < size:
        if text[end] in _DIGITS:
            end += 1
        elif text[end] in " -" and end + 1 < size and text[end + 1] in _DIGITS:
            end += 2
        else:
            break
    return end


def _phone(text: str, plus: int) -> tuple[int, int] | None:
    if plus + 1 >= len(text) or text[plus + 1] not in _DIGITS:
        return None
    end = _run(text, plus + 2, _PHONE)
    while end > plus + 3 and text[end - 1] not in _DIGITS:
        end -= 1
    return (plus, end) if end > plus + 3 and text[end - 1] in _DIGITS else None


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (2 if place % 2 else 1)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def _iban(identifier: str) -> bool:
    turned = (identifier[4:] + identifier[:4]).upper()
    return 15 <= len(identifier) <= IBAN_LENGTH and int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


class _Token:
    """End and at-signs of the token an address may be in. A token is read once
    for all the marks in it, so marks without an address cost no second look."""

    def __init__(self, text: str):
        self.text, self.end, self.at = text, 0, 0

    def bounds(self, begin: int) -> tuple[int, int]:
        """End of the token and its first at-sign from ``begin`` on (the end, if none)."""
        if begin > self.end or self.end == 0:
            self.end = self.at = begin
            while self.end < len(self.text) and self.text[self.end] not in _URL_END:
                self.end += 1
        if self.at < begin or self.text[self.at:self.at + 1] != "@":
            if self.at < self.end:
                found = self.text.find("@", max(begin, self.at), self.end)
                self.at = self.end if found < 0 else found
        return self.end, self.at


def _url(text: str, mark: int, floor: int, token: _Token) -> tuple[int, int] | None:
    begin = mark
    while begin > floor and text[begin - 1] in _SCHEME:
        begin -= 1
    while begin < mark and not (text[begin].isascii() and text[begin].isalpha()):
        begin += 1
    user = mark + 3
    end, at = token.bounds(user)
    if begin == mark or at in (user, end) or text.find("/", user, at) >= 0 or text[at + 1:at + 2] not in _ALNUM or at + 1 >= end:
        return None
    while end > mark + 4 and text[end - 1] in ".,;:!?)":
        end -= 1
    return begin, end


def _account(text: str, cue_end: int, cue: str) -> tuple[int, int] | None:
    begin = cue_end
    while begin < len(text) and begin - cue_end < 8 and text[begin] in " :=#\"'.":
        begin += 1
    if begin == cue_end:
        return None
    end = _run(text, begin, _ALNUM)
    identifier = text[begin:end]
    if cue == "iban":
        while end < len(text) and text[end] == " " and _run(text, end + 1, _ALNUM) - end - 1 in range(1, 5) and len(identifier) < IBAN_LENGTH:
            following = _run(text, end + 1, _ALNUM)
            if not _iban_like(identifier + text[end + 1:following]):
                break
            identifier, end = identifier + text[end + 1:following], following
        return (begin, end) if identifier[:2].isalpha() and identifier[2:4].isdigit() and _iban(identifier) else None
    return (begin, end) if 6 <= len(identifier) <= 64 and any(c in _DIGITS for c in identifier) else None


def _iban_like(identifier: str) -> bool:
    return len(identifier) <= IBAN_LENGTH and any(c in _DIGITS or c.isupper() for c in identifier[-4:])


def spans_of(text: str | None) -> list[Span]:
    """All spans of one text, by kind as listed and then by start."""
    if not text:
        return []
    found: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    used = dict.fromkeys(KINDS, 0)  # end of the last match of each kind, dropped ones too
    token = _Token(text)
    run_end = 0  # digits below it belong to a run that has been looked at
    for last, anchor in _anchors().iter(text):
        if anchor in _DIGITS:
            if last >= run_end:
                run_end = last + 1
                if last >= used["card"]:
                    used["card"] = end = _card(text, last)
                    if end - last >= 16:
                        digits = "".join(c for c in text[last:end] if c in _DIGITS)
                        if 16 <= len(digits) <= 19 and luhn(digits):
                            found["card"].append((last, end))
                if last >= used["ip"] and (hit := _ip(text, last)):
                    used["ip"] = hit[1]
                    if all(_octet(part.lstrip("0")) for part in text[hit[0]:hit[1]].split(".")):
                        found["ip"].append(hit)
                run_end = _run(text, last, _DIGITS)
        elif anchor == "@":
            if hit := _email(text, last, used["email"]):
                used["email"] = hit[1]
                found["email"].append(hit)
        elif anchor == "+":
            if hit := _phone(text, last):
                if 8 <= sum(c in _DIGITS for c in text[hit[0]:hit[1]]) <= 15:
                    found["phone"].append(hit)
        elif anchor == "://":
            if last - 2 >= used["url"] and (hit := _url(text, last - 2, used["url"], token)):
                used["url"] = hit[1]
                found["url"].append(hit)
        elif last >= used["account"] and (hit := _account(text, last + 1, anchor)):
            begins = last + 1 - len(anchor)
            if begins == 0 or text[begins - 1] not in _ALNUM:
                used["account"] = hit[1]
                found["account"].append(hit)
    return [(kind, begin, end) for kind in KINDS for begin, end in found[kind]]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{begin}:{end}" for kind, begin, end in spans)


def masked(text: str | None) -> str | None:
    """The text with each span replaced by its kind in brackets; where spans of
    several kinds overlap, the whole stretch gets the name of the first."""
    spans = sorted(spans_of(text), key=lambda s: (s[1], -s[2]))
    if not spans:
        return text
    parts, at, kind, begin, end = [], 0, *spans[0]
    for name, low, high in spans[1:]:
        if low < end:
            end = max(end, high)
            continue
        parts += [text[at:begin], f"[{kind.upper()}]"]
        at, kind, begin, end = end, name, low, high
    return "".join([*parts, text[at:begin], f"[{kind.upper()}]", text[end:]])


_COUNTS = [f"n_{kind}" for kind in BASE_KINDS]
_SPANS = StructType([
    *[StructField(name, LongType()) for name in _COUNTS],
    StructField("base_sha256", StringType()), StructField("spans", StringType()),
])


@F.arrow_udf(_SPANS)
def _digest(text: pa.Array) -> pa.Array:
    rows = []
    for value in text:
        spans = spans_of(value.as_py())
        base = [s for s in spans if s[0] in BASE_KINDS]
        counts = {f"n_{kind}": sum(s[0] == kind for s in base) for kind in BASE_KINDS}
        rows.append({
            **counts, "base_sha256": hashlib.sha256(joined(base).encode()).hexdigest(), "spans": joined(spans),
        })
    fields = [(name, pa.int64()) for name in _COUNTS]
    return pa.array(rows, pa.struct([*fields, ("base_sha256", pa.string()), ("spans", pa.string())]))


@F.arrow_udf(StringType())
def _masked(text: pa.Array) -> pa.Array:
    return pa.array([masked(value.as_py()) for value in text], pa.string())


def find_private(docs: DataFrame) -> DataFrame:
    """``docs`` with the struct ``private``: counts, digest and spans."""
    return small_batches(docs).withColumn("private", _digest(F.col("text")))


def mask_private(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced, ``n_chars`` counted anew."""
    found = small_batches(docs).withColumn("text", _masked(F.col("text")))
    return found.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else found


def op9_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document; see the module for the method."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_private(docs).select("doc_id", "private.*")
