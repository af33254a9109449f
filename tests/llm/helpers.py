"""Small fixtures and brute-force versions."""

from __future__ import annotations

import random

import pyarrow as pa
import pyarrow.parquet as pq

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau ypsilon".split()


def sentence(seed: int, words: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "er", "ing"]) for _ in range(words))


def docs_frame(spark, rows, extra: bool = False):
    """(doc_id, text, lang, source) rows; n_chars and on request columns with clashing names."""
    full = [(i, t, lang, source, None if t is None else len(t)) for i, t, lang, source in rows]
    df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        for name in ("score", "simhash", "cell", "key", "predicted", "private", "counted", "size", "place", "root", "guest"):
            df = df.selectExpr("*", f"'kept' as {name}")
    return df


def write_table(folder, name: str, columns: dict, schema: list[tuple[str, pa.DataType]]) -> None:
    table = pa.table([pa.array(columns[c], t) for c, t in schema], names=[c for c, _ in schema])
    pq.write_table(table, f"{folder}/{name}.parquet")


def write_documents(folder, rows) -> None:
    columns = dict(zip(("doc_id", "text", "lang", "source"), map(list, zip(*rows)))) if rows else dict.fromkeys(("doc_id", "text", "lang", "source"), [])
    columns["n_chars"] = [None if t is None else len(t) for t in columns["text"]]
    write_table(folder, "documents", columns, [
        ("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64()),
    ])


ODD_ROWS = [
    (1, None, None, None), (2, "", "en", "a"), (3, " \t\n", "en", None), (4, "x", "de", "b"), (4, "x", "de", "b"),
    (None, "a text without an id but with words", "en", "a"), (5, "é" * 10, "fr", ""), (6, "word " * 30_000, "en", "a"),
    (7, "12345 !!! 999", "en", "b"), (8, "z" * 200_000, "en", "b"), (9, "one two", None, "c"), (10, "  \U0001f600 ok", "en", "c"),
]
