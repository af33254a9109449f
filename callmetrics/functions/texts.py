"""Trace words and the frozen risk policy.

Traces are cut into words, and scored, in ``trace_kernels``; the column here
reads the trigger off a trace's scores.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ours: markers per family. The published reports name the families, not the
# words; pass another mapping to use other words or another language.
LEXICON: dict[str, tuple[str, ...]] = {
    "backtrack": ("actually", "instead", "scratch", "undo", "revert", "backtrack", "restart"),
    "wait": ("wait", "hmm", "hold"),
    "hedge": ("maybe", "perhaps", "possibly", "unsure", "unclear", "guess", "probably"),
    "giveup": ("stuck", "impossible", "abandon", "cannot", "unable"),
    "flip": ("no", "contrary", "reverse"),
    "negative": ("wrong", "mistake", "error", "incorrect", "fails"),
}
PUNCTUATION = ".,;:!()|\""
TAIL, HEDGE_TAIL, LAST = 0.3, 0.15, 0.1
# Ours: shingle lengths of the repetition features; four is the published one.
LONG_SHINGLE, SHINGLE = 6, 4

# The frozen live-risk policy.
WINDOW_WORDS, CHUNK_WORDS, MIN_WORDS, THRESHOLD = 320, 40, 80, 4.0
# Ours: points per marker and per repeated four-word shingle.
POINTS = {"backtrack": 1, "hedge": 1, "giveup": 2}
REPEAT_POINTS = 1


def trigger_chunk(scores: Column, chunk_words: int = CHUNK_WORDS, threshold: float = THRESHOLD) -> Column:
    """First chunk whose score and the one before it both exceed the threshold,
    both taken after the least number of words; NULL when never."""
    first = -(-MIN_WORDS // chunk_words)  # chunks needed before the first look
    over = lambda j: F.element_at(scores, j) > threshold
    n = F.size(scores)
    candidates = F.when(n > first, F.sequence(F.lit(first + 1), F.greatest(n, F.lit(first + 1)))).otherwise(
        F.array().cast("array<int>")
    )
    hit = F.filter(candidates, lambda j: over(j) & over(j - 1))
    return (F.try_element_at(hit, F.lit(1)) - 1).cast("bigint")
