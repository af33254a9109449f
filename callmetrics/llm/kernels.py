"""The byte-level kernels, which are general helpers of the library."""

from callmetrics.functions.kernels import (  # noqa: F401
    SPACE, WORD, mix, pieces, rolling_sums, span_hashes, text_buffer, word_spans,
)
