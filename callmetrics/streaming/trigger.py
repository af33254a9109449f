"""Live risk trigger: the batch replay's rule as a stateful operator.

The stream carries one row per full chunk of a call: its number, its words as
hashes and its marker points. The state of a call is its last chunks, which
with the next one make a window, so it does not grow with the trace. Chunks of
a call arrive in order from one micro-batch to the next.

A visit to the state costs far more than scoring a call. So texts are hashed
many at a time before they are shuffled, and the states of a block of 64 calls
with neighbouring ids, which run at about the same time, are kept, read and
written together; their windows are scored together, too. A block has at most
64 calls however many there are, and ids far apart only make smaller blocks.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from callmetrics.functions import texts as X
from callmetrics.functions import trace_kernels as K

# Calls whose ids agree up to these bits have their states kept together.
BLOCK_BITS = 6
STATE = "calls array<bigint>, over array<boolean>, fired array<boolean>, points array<binary>, words array<binary>"
OUTPUT = "call_id bigint, trigger_chunk bigint, score bigint"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def chunk_stream(traces: DataFrame, lexicon: Mapping[str, Sequence[str]], chunk_words: int = X.CHUNK_WORDS) -> DataFrame:
    """(call_id, chunk, words, points) for every full chunk of the calls that
    have an id; ``words`` is the words' 64-bit hashes one after the other."""
    texts = traces.where(F.col("call_id").isNotNull()).select(F.col("call_id").cast("bigint").alias("call_id"), F.lower("reasoning_text"))
    return texts.mapInArrow(K.chunker(lexicon, chunk_words), K.CHUNKS)


class RiskTrigger(StatefulProcessor):
    """Emits a call's first chunk at which two looks in a row exceed the
    threshold. A key is a block of calls; each call has a state of its own."""

    def __init__(self, chunk_words: int = X.CHUNK_WORDS, threshold: float = X.THRESHOLD):
        self.chunk_words = chunk_words
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("windows", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get()
        states = {call: state for call, *state in zip(*held)} if held else {}
        arrived = self.waiting(pd.concat(list(rows)), states)
        found = []
        if arrived:
            points = [np.append(np.frombuffer(states[call][2], np.int64), worth) for call, (_, worth, _) in arrived.items()]
            hashes = [np.frombuffer(b"".join([states[call][3], *words]), np.uint64) for call, (_, _, words) in arrived.items()]
            scores = K.chunk_scores(hashes, points, self.chunk_words)
            for (call, (chunks, _, _)), worth, words, score in zip(arrived.items(), points, hashes, scores):
                hit, states[call] = self.look(states[call][0], chunks, worth, words, score[-len(chunks):])
                found += [(call, *h) for h in hit]
            self.state.update(tuple(zip(*[(call, *state) for call, state in states.items()])))
        if found:
            yield pd.DataFrame(found, columns=["call_id", "trigger_chunk", "score"])

    @staticmethod
    def waiting(rows: pd.DataFrame, states: dict) -> dict:
        """Chunks, points and words of each call that has not fired, in order
        of its chunks; a call seen for the first time gets its state."""
        arrived: dict = {}
        rows = rows.sort_values("chunk", kind="stable")
        for call, chunk, worth, words in zip(*[rows[c].tolist() for c in ("call_id", "chunk", "points", "words")]):
            if not states.setdefault(call, (False, False, b"", b""))[1]:
                for column, value in zip(arrived.setdefault(call, ([], [], [])), (chunk, worth, words)):
                    column.append(value)
        return arrived

    def look(self, over: bool, chunks: list, points: np.ndarray, hashes: np.ndarray, scores: np.ndarray) -> tuple[list, tuple]:
        """Where a call fires, if it does, and its next state; points and words
        are those held and those of the chunks."""
        for chunk, score in zip(chunks, scores.tolist()):
            if (chunk + 1) * self.chunk_words < X.MIN_WORDS:
                continue
            now = score > self.threshold
            if now and over:
                return [(chunk, score)], (True, True, b"", b"")
            over = now
        kept = max(0, len(points) - (X.WINDOW_WORDS // self.chunk_words - 1))  # the next chunk completes the window
        return [], (over, False, points[kept:].tobytes(), hashes[kept * self.chunk_words:].tobytes())

    def close(self) -> None:
        pass


def live_triggers(chunks: DataFrame, chunk_words: int = X.CHUNK_WORDS) -> DataFrame:
    """Needs the RocksDB state store, which the session names in
    ``spark.sql.streaming.stateStore.providerClass``."""
    chunks.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return chunks.withColumn("block", F.shiftright("call_id", BLOCK_BITS)).groupBy("block").transformWithStateInPandas(
        statefulProcessor=RiskTrigger(chunk_words), outputStructType=OUTPUT, outputMode="Append", timeMode="None"
    )
