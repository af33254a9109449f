"""Registered queries of the operators, and check SQL where SQL can say it."""

from __future__ import annotations

import corpus_pipeline
from callmetrics.llm.chat_format import op10_chat_perspectives
from callmetrics.llm.common import Query
from callmetrics.llm.decontaminate import op1_benchmark_decontamination
from callmetrics.llm.importance import op11_importance_resampling
from callmetrics.llm.language import op5_language_id
from callmetrics.llm.mixing import op6_source_mixing
from callmetrics.llm.near_dedup import op8_simhash_near_dedup
from callmetrics.llm.neighbours import op12_nearest_neighbours
from callmetrics.llm.prefix_trie import op13_prefix_trie
from callmetrics.llm.private_data import op9_private_data
from callmetrics.llm.quality import op3_quality
from callmetrics.llm.syncmers import op2_fingerprints
from callmetrics.llm.token_counts import op7_token_counts
from callmetrics.llm.warc import op4_warc_round_trip

QUERIES: dict[str, Query] = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_fingerprints": op2_fingerprints,
    "op3_quality": op3_quality,
    "op4_warc_round_trip": op4_warc_round_trip,
    "op5_language_id": op5_language_id,
    "op6_source_mixing": op6_source_mixing,
    "op7_token_counts": op7_token_counts,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_private_data": op9_private_data,
    "op10_chat_perspectives": op10_chat_perspectives,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_nearest_neighbours": op12_nearest_neighbours,
    "op13_prefix_trie": op13_prefix_trie,
    "pipeline": corpus_pipeline.run,
}

# Base32 digits are read from the hex digest five bits at a time.
_OP4 = """
WITH p AS (
    SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS hex FROM pages
), leaders AS (
    SELECT hex, max(page_id) AS leader FROM p GROUP BY hex
)
SELECT page_id, octet_length(payload) AS payload_bytes,
    list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        ((('0x' || substr(hex || '0', (5 * i // 4 + 1)::int, 2))::int >> (3 - 5 * i % 4)::int) & 31) + 1, 1)),
        'string_agg', '') AS payload_digest,
    CASE WHEN page_id = leader THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> leader THEN leader END AS refers_to
FROM p JOIN leaders USING (hex)
"""

# Parts of 512 turns, each for everyone in the dialogue; the speaker's turns
# carry the loss. Nulls first, as in the operator.
_OP10 = """
WITH turns AS (
    SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(text, ''), coalesce(role, 'unknown')) - 1 AS position
    FROM conversations
), seats AS (
    SELECT DISTINCT conv_id, role AS speaker FROM turns WHERE role <> 'system'
), opened AS (
    SELECT *, min(position) FILTER (WHERE role <> 'system') OVER (PARTITION BY conv_id) AS first FROM turns
), openings AS (
    SELECT conv_id, string_agg('<|im_start|>system' || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY position) AS opening
    FROM opened WHERE position < first AND position < 512 GROUP BY conv_id
), lines AS (
    SELECT t.conv_id, t.position // 512 AS part, s.speaker, t.position, t.role = s.speaker AS own,
        CASE WHEN t.role = 'system' THEN '<|im_start|>system' WHEN t.role = s.speaker THEN '<|im_start|>assistant'
            ELSE '<|im_start|>user name=' || regexp_replace(t.role, '[^A-Za-z0-9_.-]', '_', 'g') END || chr(10) AS head,
        t.text || '<|im_end|>' || chr(10) AS body
    FROM turns t JOIN seats s ON t.conv_id IS NOT DISTINCT FROM s.conv_id
), placed AS (
    SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, part, speaker ORDER BY position) AS ends FROM lines
), rendered AS (
    SELECT conv_id, part, speaker, count(*) AS n_turns, count(*) FILTER (WHERE own) AS n_loss_turns,
        string_agg(head || body, '' ORDER BY position) AS rendered,
        coalesce(string_agg((ends - length(body))::bigint || ':' || ends::bigint, ',' ORDER BY position) FILTER (WHERE own), '') AS loss_spans
    FROM placed GROUP BY conv_id, part, speaker
)
SELECT r.*, CASE WHEN part > 0 THEN coalesce(opening, '') ELSE '' END AS context
FROM rendered r LEFT JOIN openings o ON r.conv_id IS NOT DISTINCT FROM o.conv_id
"""

# CRC-32 of a text, byte by byte through the polynomial's table (``steps``, a column of crc_table).
_CRC_TABLE = """crc_table AS (
    SELECT list(v ORDER BY n) AS steps FROM (
        SELECT n, list_reduce([n] || [0, 0, 0, 0, 0, 0, 0, 0],
            lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v
        FROM (SELECT range::bigint AS n FROM range(256))
    )
)"""


def _crc(text: str) -> str:
    digits = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), (2 * i + 1)::int, 2))::bigint)"
    step = "lambda c, b: xor(steps[(xor(c, b) & 255) + 1], c >> 8)"
    return f"xor(4294967295, list_reduce([4294967295::bigint] || {digits}, {step}))"


_OP11 = f"""
WITH {_CRC_TABLE}, texts AS (
    SELECT 'd' AS side, doc_id, row_number() OVER () AS row_id, text FROM documents
    UNION ALL SELECT 't', NULL, -row_number() OVER (), text FROM benchmark
), words AS (
    SELECT side, doc_id, row_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM texts
), features AS (
    SELECT side, row_id, unnest(w || list_transform(range(len(w) - 1), lambda i: w[i + 1] || ' ' || w[i + 2])) AS f FROM words
), counted AS (
    SELECT side, row_id, f, count(*) AS n FROM features GROUP BY ALL
), hashed AS (
    SELECT f, {_crc('f')} % 10000 AS bucket FROM (SELECT DISTINCT f FROM counted), crc_table
), buckets AS (
    SELECT bucket, coalesce(sum(n) FILTER (WHERE side = 'd'), 0)::double AS s, coalesce(sum(n) FILTER (WHERE side = 't'), 0)::double AS t
    FROM counted JOIN hashed USING (f) GROUP BY bucket
), gains AS (
    SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM buckets) + 10000)
        / ((s + 1) * ((SELECT sum(t) FROM buckets) + 10000))))::bigint AS gain FROM buckets
), sums AS (
    SELECT row_id, sum(n)::bigint AS n_features, sum(n * gain)::bigint AS total
    FROM counted JOIN hashed USING (f) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY row_id
), weighed AS (
    SELECT doc_id, row_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features,
        coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0) AS weight,
        ('0x' || substr(sha256('7:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint AS h
    FROM words LEFT JOIN sums USING (row_id) WHERE side = 'd'
), scored AS (
    SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double)))::bigint AS score FROM weighed
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place FROM scored
)
SELECT doc_id, n_features::bigint AS n_features, weight::bigint AS weight, score::bigint AS score,
    CASE WHEN n_words >= 20 AND place <= 25 * (SELECT count(*) FROM scored WHERE n_words >= 20) // 100 THEN place END AS rank
FROM placed
"""

_OP13 = f"""
WITH {_CRC_TABLE}, turns AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL
), lists AS (
    SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role, text) AS own FROM turns GROUP BY conv_id
), shared AS (
    SELECT conv_id, own, conv_id - conv_id % 100 AS base, {_crc('conv_id::varchar')} % 6 AS h FROM lists, crc_table
), rebuilt AS (
    SELECT s.conv_id, coalesce(b.own[1:s.h], []) || s.own[s.h + 1:] AS t FROM shared s LEFT JOIN lists b ON b.conv_id = s.base
), paths AS (
    SELECT conv_id, t, unnest(range(len(t) + 1)) AS depth FROM rebuilt
), member AS (
    SELECT conv_id, depth, len(t) = depth AS last, coalesce(length(t[depth].text), 0) AS size,
        min(conv_id) OVER (PARTITION BY depth, t[1:depth]) AS node FROM paths
), nodes AS (
    SELECT node AS conv_id, depth, count(*) AS n_convs, any_value(size) AS size,
        sha256(coalesce(string_agg(conv_id::varchar, ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256
    FROM member GROUP BY node, depth
), parents AS (
    SELECT n.*, m.node AS parent_conv_id FROM nodes n LEFT JOIN member m ON m.conv_id = n.conv_id AND m.depth = n.depth - 1
), children AS (
    SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM parents WHERE depth > 0 GROUP BY ALL
), counted AS (
    SELECT p.*, coalesce(n_children, 0) AS n_children FROM parents p LEFT JOIN children USING (conv_id, depth)
), sums AS (
    SELECT m.node AS conv_id, m.depth, count(*) FILTER (WHERE c.n_children = 0) AS n_leaves, sum((c.n_convs - 1) * c.size) AS saved_tokens
    FROM counted c JOIN member m ON m.conv_id = c.conv_id AND m.depth <= c.depth GROUP BY ALL
)
SELECT conv_id, depth::bigint AS depth, parent_conv_id, n_convs::bigint AS n_convs, n_children::bigint AS n_children,
    n_leaves::bigint AS n_leaves, saved_tokens::bigint AS saved_tokens, ends_sha256
FROM counted JOIN sums USING (conv_id, depth)
"""

CHECKS: dict[str, str] = {"op13_prefix_trie": _OP13, "op11_importance_resampling": _OP11, "op4_warc_round_trip": _OP4, "op10_chat_perspectives": _OP10}
if corpus_pipeline.ORACLE_SQL is not None:
    CHECKS["pipeline"] = corpus_pipeline.ORACLE_SQL
