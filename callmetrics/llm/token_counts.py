"""Token counts by a linear longest-match automaton (operator 7).

The vocabulary is a byte-level one, ranks beside base64 strings, given by its
path. A word (a run without ASCII white space) is matched with one space before
it, the longest known piece first, then again from where that ended. The trie
carries, for every node, a failure link and the number of pieces that are
popped on the way there, both computed once. So a word costs one step per byte
and no piece is ever cut out.

A word that cannot be spelled (possible only if the vocabulary lacks a byte)
counts as one unknown token. Null and empty texts have none. Repeated rows and
extra columns are treated alike and left alone.
"""

from __future__ import annotations

import base64
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from callmetrics.llm.common import fresh, small_batches, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CACHED_WORDS = 1 << 18
CACHED_BYTES = 48


def read_vocabulary(path: str) -> list[bytes]:
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


class Automaton:
    """Trie with failure links and popped-piece counts."""

    def __init__(self, pieces: list[bytes]):
        self.steps: dict[int, int] = {}  # node * 256 + byte: node
        ends = {0: False}
        children: list[list[tuple[int, int]]] = [[]]
        for piece in pieces:
            node = 0
            for byte in piece:
                key = node << 8 | byte
                if key not in self.steps:
                    self.steps[key] = len(children)
                    children[node].append((byte, len(children)))
                    children.append([])
                node = self.steps[key]
            if node:
                ends[node] = True
        self.fail, self.pops = [-1] * len(children), [0] * len(children)
        queue = deque((0, byte, node) for byte, node in children[0])
        while queue:
            parent, byte, node = queue.popleft()
            queue.extend((node, b, n) for b, n in children[node])
            if ends.get(node):
                self.fail[node], self.pops[node] = 0, 1
                continue
            # Pop what the parent would pop, until the byte can follow.
            popped, link = self.pops[parent], self.fail[parent]
            while link >= 0 and (link << 8 | byte) not in self.steps:
                popped += self.pops[link]
                link = self.fail[link]
            if link >= 0:
                self.fail[node], self.pops[node] = self.steps[link << 8 | byte], popped

    def count(self, word: bytes) -> int:
        """Number of greedy longest-match pieces."""
        node, popped, steps, fail, pops = 0, 0, self.steps, self.fail, self.pops
        for byte in word:
            following = steps.get(node << 8 | byte)
            while following is None:
                if fail[node] < 0:
                    return 1
                popped += pops[node]
                node = fail[node]
                following = steps.get(node << 8 | byte)
            node = following
        while node:
            if fail[node] < 0:
                return 1
            popped += pops[node]
            node = fail[node]
        return popped


class WordCounts(dict):
    """Counts of short words seen before, up to a fixed number of them."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        found = self.automaton.count(b" " + word)
        if len(word) <= CACHED_BYTES:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = found
        return found


_COUNTS = StructType([StructField("n_words", LongType()), StructField("n_tokens", LongType())])


def with_token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` with ``n_words`` and ``n_tokens``."""
    # Read on the driver; its size is that of the vocabulary file.
    shared = small_batches(docs).sparkSession.sparkContext.broadcast(Automaton(read_vocabulary(vocabulary)))

    @F.arrow_udf(_COUNTS)
    def count(text: pa.Array) -> pa.Array:
        known = shared.value.__dict__.setdefault("known", WordCounts(shared.value))
        words, tokens = [], []
        for value in text:
            found = (value.as_py() or "").encode().split()
            words.append(len(found))
            tokens.append(sum(map(known.__getitem__, found)))
        return pa.StructArray.from_arrays([pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["n_words", "n_tokens"])

    columns = [c for c in docs.columns if c not in ("n_words", "n_tokens")]
    name = fresh(docs, "counted")
    return docs.withColumn(name, count(F.col("text"))).select(*columns, f"{name}.n_words", f"{name}.n_tokens")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy piece counts of every document; see the module for the method."""
    return with_token_counts(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
