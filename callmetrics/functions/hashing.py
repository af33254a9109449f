"""Portable hashes: the same value in any engine with md5 and sha-256."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_SPAN = 2.0**60


def id_hash(value: Column, length: int = 16) -> Column:
    return F.substring(F.sha2(value.cast("string"), 256), 1, length)


def uniform_long(*parts: Column) -> Column:
    """Evenly spread whole number below 2**60, fixed by its parts."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def fingerprint(columns: Sequence[str]) -> Column:
    """JSON of the named columns in alphabetical order, NULLs kept."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def content_digest(line: Column) -> Column:
    """Aggregate: a digest of all lines that does not depend on their order.
    Four 60-bit pieces of each line's SHA-256 are summed exactly."""
    piece = lambda at: F.conv(F.substring(F.sha2(line, 256), at, 15), 16, 10).cast("decimal(38,0)")
    sums = [F.coalesce(F.sum(piece(at)), F.lit(0)).cast("decimal(38,0)").cast("string") for at in (1, 16, 31, 46)]
    return F.concat_ws(":", *sums)


_TURNS = np.repeat([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], 4, axis=0).ravel().tolist()
_ADDED = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_STARTS = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_AT_ONCE = 1 << 14


def _md5_heads(prefix: bytes, numbers: np.ndarray, digits: int) -> np.ndarray:
    """The first 8 hex digits of the md5 of prefix and number, as numbers; all
    numbers have so many digits, and the text fits a block (55 bytes)."""
    block = bytearray(prefix + bytes(digits) + b"\x80").ljust(56, b"\0") + ((len(prefix) + digits) * 8).to_bytes(8, "little")
    words: list = np.frombuffer(bytes(block), "<u4").astype(np.uint32).tolist()
    for at in range(digits):
        place, digit = len(prefix) + at, numbers // 10 ** (digits - 1 - at) % 10 + 48
        words[place // 4] = np.uint32(words[place // 4]) | digit.astype(np.uint32) << np.uint32(8 * (place % 4))
    a, b, c, d = (np.full(len(numbers), x, np.uint32) for x in _STARTS)
    mixed, turned = np.empty_like(a), np.empty_like(a)
    for step in range(61):  # the last three do not reach the first word
        quarter = step // 16
        if quarter == 0:
            np.bitwise_xor(c, d, out=mixed)
            mixed &= b
            mixed ^= d
            word = words[step]
        elif quarter == 1:
            np.bitwise_xor(b, c, out=mixed)
            mixed &= d
            mixed ^= c
            word = words[(5 * step + 1) % 16]
        elif quarter == 2:
            np.bitwise_xor(b, c, out=mixed)
            mixed ^= d
            word = words[(3 * step + 5) % 16]
        else:
            np.invert(d, out=mixed)
            mixed |= b
            mixed ^= c
            word = words[7 * step % 16]
        mixed += a
        if isinstance(word, int):
            mixed += np.uint32((word + _ADDED[step]) % 2**32)
        else:
            mixed += word
            mixed += np.uint32(_ADDED[step])
        np.right_shift(mixed, np.uint32(32 - _TURNS[step]), out=turned)
        mixed <<= np.uint32(_TURNS[step])
        mixed |= turned
        mixed += b
        a, b, c, d, mixed = d, mixed, b, c, a
    return (b + np.uint32(_STARTS[0])).byteswap()


def md5_heads(prefix: str, low: int, high: int) -> np.ndarray:
    """For the numbers low..high-1 the first 8 hex digits of md5(prefix and
    number), as numbers: what SQL's ``substr(md5(...), 1, 8)`` gives, many at once."""
    found = [np.zeros(0, np.uint32)]
    while low < high:
        digits = len(str(low))
        end = min(high, 10**digits, low + _AT_ONCE)
        found.append(_md5_heads(prefix.encode(), np.arange(low, end), digits))
        low = end
    return np.concatenate(found)
