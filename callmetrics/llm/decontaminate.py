"""Benchmark decontamination by greedy string tiling (operator 1).

Tokens are runs of letters and digits in lower case, so case, punctuation and
spacing do not matter. In scripts that are written without spaces (Chinese,
Japanese, Thai, Lao, Burmese, Khmer) every code point is a token. A document leaks an item if tiles -- matching runs of at
least ``MIN_TILE`` tokens, none of which overlap in either text -- cover at
least ``COVERAGE`` of the item's tokens. Tiles may stand in any order, which
catches reordered passages.

1. Seeds: an item and a document become a candidate only if they share runs of
   ``MIN_TILE`` tokens, and only if the item's tokens below such runs reach the
   coverage (tiles cannot cover more, so nothing is lost).
2. Tiling: running Karp-Rabin with a search length that begins long and is
   halved. In each pass the longest matches are marked first; a match that a
   longer one has cut is tried again with what is left of it. Only the begins of
   matches are laid out, so texts that repeat themselves cost a pair for each
   diagonal they share and not for each pair of equal tokens.

The benchmark is the query set. It is read in blocks of at most
``BLOCK_BYTES`` of text, each a broadcast index of bounded size, and all
documents pass every block; their texts are never shuffled.

An item with fewer tokens than a tile has to be found whole, as one run anywhere
in the document. An item without a token never leaks. Null texts count as empty. A
repeated item or document row gives repeated result rows. A single item longer
than a block is a block of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from callmetrics.llm.common import small_batches, stored, table
from callmetrics.llm.kernels import WORD, mix, pieces, rolling_sums, span_hashes, text_buffer, word_spans

MIN_TILE = 5
COVERAGE = 0.5
BLOCK_BYTES = 8 << 20
START_LENGTH = 64

Tile = tuple[int, int, int]  # item position, document position, length


def tokens_of(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of lower-case texts, and the row of each."""
    starts, ends, rows = _token_spans(data, edges)
    return span_hashes(data, starts, ends), rows


# Code points of three bytes, first and last. Letters of scripts without spaces,
# and the ideographic and full-width punctuation.
SPACELESS = [
    (0x0E01, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17D3), (0x17D7, 0x17FF), (0x3005, 0x3007), (0x3021, 0x3029), (0x3031, 0x3035),
    (0x303B, 0x303C), (0x3041, 0x309F), (0x30A1, 0x30FA), (0x30FC, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF),
    (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F),
]
SIGNS = [
    (0x3000, 0x3004), (0x3008, 0x3020), (0x302A, 0x3030), (0x3036, 0x303A), (0x303D, 0x303F), (0x30A0, 0x30A0), (0x30FB, 0x30FB),
    (0xFF01, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65), (0xFFE0, 0xFFEE),
]


def _in_ranges(values: np.ndarray, ranges: list[tuple[int, int]]) -> np.ndarray:
    low, high = np.array(ranges).T
    at = np.searchsorted(low, values, "right") - 1
    return (at >= 0) & (values <= high[at])


def _token_spans(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every token."""
    inside = WORD[data]
    alone = ends_alone = np.zeros(0, np.int64)
    if len(data) > 2:
        # Punctuation of two and three bytes: Latin-1 signs and the general block.
        two = np.flatnonzero((data[:-1] == 0xC2) & (data[1:] < 0xC0))
        inside[two] = inside[two + 1] = False
        three = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] <= 0x81))
        inside[three] = inside[three + 1] = inside[three + 2] = False
        long = np.flatnonzero((data[:-2] >= 0xE0) & (data[:-2] < 0xF0))
        a, b, c = (data[long + i].astype(np.int64) for i in range(3))
        points = (a & 0x0F) << 12 | (b & 0x3F) << 6 | c & 0x3F
        signs = long[_in_ranges(points, SIGNS)]
        inside[signs] = inside[signs + 1] = inside[signs + 2] = False
        alone = long[_in_ranges(points, SPACELESS)]
        # Ideographs of four bytes: planes 2 and 3.
        four = np.flatnonzero((data[:-1] == 0xF0) & (data[1:] >= 0xA0))
        ends_alone = np.concatenate([alone + 3, four + 4])
        alone = np.concatenate([alone, four])
    starts, ends, rows = word_spans(data, edges, inside)
    if len(alone):  # cut the runs before and after
        starts, ends = (
            np.unique(np.concatenate([starts, alone, np.setdiff1d(ends_alone, ends)])),
            np.unique(np.concatenate([ends, ends_alone, np.setdiff1d(alone, starts)])),
        )
        rows = np.searchsorted(edges, starts, "right") - 1
    return starts, ends, rows


def _windows(free: np.ndarray, length: int) -> np.ndarray:
    """Starts of windows in which every token is free."""
    if len(free) < length:
        return np.zeros(0, np.int64)
    sums = np.concatenate([[0], np.cumsum(free)])
    return np.flatnonzero(sums[length:] - sums[:-length] == length)


def _free_run(free: np.ndarray) -> np.ndarray:
    """How many tokens from each one on are free."""
    taken = np.flatnonzero(~free)
    ends = np.append(taken, len(free))
    return ends[np.searchsorted(taken, np.arange(len(free)))] - np.arange(len(free))


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges [low, high), and the range each comes from."""
    size = high - low
    which = np.repeat(np.arange(len(low)), size)
    return np.arange(len(which)) + np.repeat(low - np.concatenate([[0], np.cumsum(size)[:-1]]), size) if len(which) else which, which


def _starts(item, doc, free_item, free_doc, at_item, at_doc, code_item, code_doc) -> tuple[np.ndarray, np.ndarray]:
    """Positions (item, document) at which a match begins: windows of equal hash
    that no pair of equal free tokens precedes. Item windows of one hash lie by
    the token before them, so a document window takes all but one range of them;
    pairs further along a match are never laid out, however repetitive the texts."""
    known, rank = np.unique(code_item, return_inverse=True)
    before, place = np.unique(item[np.maximum(at_item - 1, 0)], return_inverse=True)
    open_item = (at_item > 0) & free_item[np.maximum(at_item - 1, 0)]
    width = len(before) + 1
    key = rank * width + np.where(open_item, place, len(before))  # last: nothing before it to match
    order = np.argsort(key, kind="stable")
    key = key[order]
    own = np.minimum(np.searchsorted(known, code_doc), len(known) - 1)
    hit = np.flatnonzero(known[own] == code_doc)
    own, at = own[hit], at_doc[hit]
    token = doc[np.maximum(at - 1, 0)]
    near = np.minimum(np.searchsorted(before, token), len(before) - 1)
    same = (at > 0) & free_doc[np.maximum(at - 1, 0)] & (before[near] == token)
    low, high = np.searchsorted(key, own * width), np.searchsorted(key, (own + 1) * width)
    left = np.where(same, np.searchsorted(key, own * width + near), low)
    right = np.where(same, np.searchsorted(key, own * width + near, "right"), low)
    first, of_first = _spread(low, left)
    second, of_second = _spread(right, high)
    p = at_item[order[np.concatenate([first, second])]]
    return p, at[np.concatenate([of_first, of_second])]


def _scan(item, doc, free_item, free_doc, length) -> tuple[int, np.ndarray]:
    """Maximal matches (item position, document position, size) of at least
    ``length`` free tokens. None are given when one is more than twice as long:
    the search goes on from that length."""
    none = np.zeros((0, 3), np.int64)
    at_item, at_doc = _windows(free_item, length), _windows(free_doc, length)
    if not len(at_item) or not len(at_doc):
        return 0, none
    (sums_item, factors_item), (sums_doc, factors_doc) = rolling_sums(item), rolling_sums(doc)

    def code_item(at, size):
        return (sums_item[at + size] - sums_item[at]) * factors_item[at]

    def code_doc(at, size):
        return (sums_doc[at + size] - sums_doc[at]) * factors_doc[at]

    p, q = _starts(item, doc, free_item, free_doc, at_item, at_doc, code_item(at_item, length), code_doc(at_doc, length))
    if not len(p):
        return 0, none
    # The end of each match by bisection over running hashes.
    most = np.minimum(_free_run(free_item)[p], _free_run(free_doc)[q])
    low, high = np.full(len(p), length), most
    while np.any(low < high):
        middle = (low + high + 1) // 2
        same = code_item(p, middle) == code_doc(q, middle)
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    longest = int(low.max())
    return (longest, none) if longest > 2 * length else (longest, np.stack([p, q, low], axis=1))


def _taken(free: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(~free)])


def tiling(item: np.ndarray, doc: np.ndarray, min_tile: int = MIN_TILE) -> list[Tile]:
    """Greedy string tiling of two token sequences."""
    free_item, free_doc = np.ones(len(item), bool), np.ones(len(doc), bool)
    tiles: list[Tile] = []
    length = max(min_tile, min(START_LENGTH, len(item), len(doc)))
    while True:
        longest, found = _scan(item, doc, free_item, free_doc, length)
        if longest > 2 * length:
            length = longest
            continue
        _mark(item, doc, free_item, free_doc, length, found, tiles)
        if length > 2 * min_tile:
            length //= 2
        elif length > min_tile:
            length = min_tile
        else:
            return sorted(tiles)


def _mark(item, doc, free_item, free_doc, length, found, tiles: list[Tile]) -> None:
    """Take the found matches as tiles, the longest first, or what is free of them."""
    queue: dict[int, list] = {}
    for size in np.unique(found[:, 2]).tolist():
        queue[size] = [found[found[:, 2] == size, :2]]
    while queue:
        size = max(queue)
        p, q = np.unique(np.concatenate(queue.pop(size)), axis=0).T
        counts = [_taken(free)[at + size] - _taken(free)[at] for free, at in ((free_item, p), (free_doc, q))]
        some = np.maximum(*counts) < size  # the others have nothing free
        for p, q in zip(p[some].tolist(), q[some].tolist()):
            taken = ~(free_item[p:p + size] & free_doc[q:q + size])
            if not taken.any():
                same = item[p:p + size] == doc[q:q + size]
                if not same.all():  # equal hashes of different windows
                    taken = ~same
                else:
                    free_item[p:p + size] = free_doc[q:q + size] = False
                    tiles.append((p, q, size))
                    continue
            # The free stretches of a cut match are tried at their length.
            bounds = np.flatnonzero(np.diff(np.concatenate([[1], taken.astype(np.int8), [1]])))
            for a, b in bounds.reshape(-1, 2).tolist():
                if b - a >= length:
                    queue.setdefault(b - a, []).append(np.array([[p + a, q + a]]))


@dataclass
class BlockIndex:
    """Items of one block: their tokens, and their seeds sorted by hash."""

    item_ids: list
    tokens: list[np.ndarray]
    vocabulary: np.ndarray
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # length: hashes, items, positions

    @classmethod
    def build(cls, rows: list[tuple], min_tile: int) -> BlockIndex:
        data, edges = text_buffer(pa.array([text for _, text in rows], pa.string()))
        hashes, owner = tokens_of(data, edges)
        tokens = np.split(hashes, np.searchsorted(owner, np.arange(1, len(rows))))
        seeds: dict[int, list] = {}
        for number, values in enumerate(tokens):
            length = min(min_tile, len(values))
            if length:
                sums, factors = rolling_sums(values)
                at = np.arange(len(values) - length + 1)
                seeds.setdefault(length, []).append(
                    (mix((sums[at + length] - sums[at]) * factors[at]), np.full(len(at), number), at))
        ready = {}
        for length, parts in seeds.items():
            joined = [np.concatenate(column) for column in zip(*parts)]
            order = np.argsort(joined[0], kind="stable")
            ready[length] = tuple(column[order] for column in joined)
        return cls([item_id for item_id, _ in rows], tokens, np.unique(hashes), ready)

    def leaks(self, hashes: np.ndarray, owner: np.ndarray, rows: int, min_tile: int, coverage: float) -> dict[int, list[dict]]:
        """Per row of a piece: the items that leak into it, with their tiles."""
        edges = np.searchsorted(owner, np.arange(rows + 1))
        found: dict[int, list[dict]] = {}
        if not len(self.vocabulary) or not len(hashes):
            return found
        known = self.vocabulary[np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)] == hashes
        sums, factors = rolling_sums(hashes)
        for length, (seeds, items, positions) in self.seeds.items():
            at = _windows(known, length)
            at = at[owner[at] == owner[at + length - 1]]
            code = mix((sums[at + length] - sums[at]) * factors[at])
            low = np.searchsorted(seeds, code, "left")
            hit = seeds[np.minimum(low, len(seeds) - 1)] == code
            # Each seed of a row once, before the items' positions are laid out.
            row, low = np.unique(np.stack([owner[at[hit]], low[hit]]), axis=1)
            if not len(row):
                continue
            which, of = _spread(low, np.searchsorted(seeds, seeds[low], "right"))
            # One entry per row, item and position in the item.
            triple = np.stack([row[of], items[which], positions[which]])
            triple = triple[:, np.lexsort(triple[::-1])]
            pair_of = np.concatenate([[True], np.any(triple[:2, 1:] != triple[:2, :-1], axis=0)])
            step = np.minimum(np.diff(triple[2], append=0), length)
            step[np.append(pair_of[1:], True)] = length
            begin = np.flatnonzero(pair_of)
            below = np.add.reduceat(step, begin)
            for row, item, most in zip(triple[0, begin].tolist(), triple[1, begin].tolist(), below.tolist()):
                size = len(self.tokens[item])
                if most < coverage * size:
                    continue
                tiles = tiling(self.tokens[item], hashes[edges[row]:edges[row + 1]], length)
                covered = sum(t[2] for t in tiles)
                if covered >= coverage * size:
                    found.setdefault(row, []).append({
                        "item_id": self.item_ids[item], "item_tokens": size, "matched_tokens": covered,
                        "coverage": covered / size, "n_tiles": len(tiles), "longest_tile": max(t[2] for t in tiles),
                        "tiles": ",".join(f"{p}:{q}:{n}" for p, q, n in tiles),
                    })
        return found


_LEAK_FIELDS = [
    ("item_id", LongType(), pa.int64()), ("item_tokens", LongType(), pa.int64()),
    ("matched_tokens", LongType(), pa.int64()), ("coverage", DoubleType(), pa.float64()),
    ("n_tiles", LongType(), pa.int64()), ("longest_tile", LongType(), pa.int64()),
    ("tiles", StringType(), pa.string()),
]
_LEAKS = ArrayType(StructType([StructField(n, t) for n, t, _ in _LEAK_FIELDS]))
_ARROW_LEAKS = pa.list_(pa.struct([(n, t) for n, _, t in _LEAK_FIELDS]))


def _leaks_udf(spark: SparkSession, index: BlockIndex, min_tile: int, coverage: float):
    shared = spark.sparkContext.broadcast(index)

    @F.arrow_udf(_LEAKS)
    def leaks(text: pa.Array) -> pa.Array:
        data, edges = text_buffer(text)
        out: list[list[dict]] = []
        for first, stop, part, bounds in pieces(data, edges):
            hashes, owner = tokens_of(part, bounds)
            found = shared.value.leaks(hashes, owner, stop - first, min_tile, coverage)
            out += [found.get(row, []) for row in range(stop - first)]
        return pa.array(out, _ARROW_LEAKS)

    return lambda text: leaks(F.lower(text))


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> list[DataFrame]:
    """The query set (item_id, text) in parts that each fit a broadcast; an
    item longer than a block can only make its own part larger."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.lower("text").alias("text"))
    size = items.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 8)).first()[0] or 0
    count = max(1, -(-size // block_bytes))
    if count == 1:
        return [items]
    items = stored(items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(count))), "items")
    return [items.where(F.col("block") == b).select("item_id", "text") for b in range(count)]


def _index(block: DataFrame, min_tile: int) -> BlockIndex:
    return BlockIndex.build([tuple(r) for r in block.orderBy("item_id", "text").collect()], min_tile)


def leaks(
    docs: DataFrame, benchmark: DataFrame, min_tile: int = MIN_TILE, coverage: float = COVERAGE,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(doc_id, item_id, item_tokens, matched_tokens, coverage, n_tiles,
    longest_tile, tiles) per leaked item; tiles are item:document:length."""
    spark = small_batches(docs).sparkSession
    whole = None
    queue = blocks(benchmark, block_bytes)
    for block in queue:
        find = _leaks_udf(spark, _index(block, min_tile), min_tile, coverage)
        hits = docs.select("doc_id", F.explode(find(F.col("text"))).alias("leak")).select("doc_id", "leak.*")
        if len(queue) > 1:
            hits = stored(hits, "leaks")  # one block's index in use at a time
        whole = hits if whole is None else whole.unionByName(hits)
    return whole


def without_leaks(docs: DataFrame, benchmark: DataFrame, min_tile: int = MIN_TILE, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents into which no item leaks. Decided per row, so a row without an
    id, or with an id that others have too, stands for itself."""
    spark = small_batches(docs).sparkSession
    queue = blocks(benchmark, block_bytes)
    for block in queue:
        find = _leaks_udf(spark, _index(block, min_tile), min_tile, coverage)
        docs = docs.where(F.size(find(F.col("text"))) == 0)
        if len(queue) > 1:
            docs = stored(docs, "clean")
    return docs


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, item) leak with its coverage; see the module for the method."""
    return leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
