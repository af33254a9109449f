"""The trie of conversations against one of nested dictionaries."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from callmetrics.llm import prefix_trie as T
from tests.llm.helpers import write_table

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def plain_trie(rows):
    """Rows of (conv_id, turn, role, text)."""
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            turns.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    lists = {c: [t[2:] for t in sorted(own)] for c, own in turns.items()}
    built = {}
    for c, own in lists.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = lists.get(c - c % 100, [])[:h] + own[h:]
    members = {}
    for c, own in built.items():
        for d in range(len(own) + 1):
            members.setdefault(tuple(own[:d]), []).append(c)
    out = set()
    for node, convs in members.items():
        below = [n for n in members if n[:len(node)] == node]
        children = [n for n in below if len(n) == len(node) + 1]
        ends = sorted(c for c in convs if len(built[c]) == len(node))
        out.add((
            min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children),
            sum(all(m[:len(n)] != n or m == n for m in below) for n in below),
            sum((len(members[n]) - 1) * (len(n[-1][1]) if n else 0) for n in below),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return out


def found(frame):
    rows = [tuple(r[c] for c in COLUMNS) for r in frame.collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


def dialogues(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 40), *range(100, 140), *range(250, 270)]:
        for t in range(rng.randrange(1, 12)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "é b", "c" * 9]) if t < 4 else f"{c} {t}"))
    rows += [(c, t, "user", f"same {t}") for c in range(300, 340) for t in range(6)]  # copies
    rows += [(400, t, "user", f"long {t % 7}") for t in range(60)]
    rows += [(500, None, None, None), (500, 1, "user", ""), (500, 1, "user", ""), (None, 1, "user", "lost"), (600, 9, "x", "\U0001f600\x00")]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


@pytest.mark.parametrize("segment, table_rows", [(T.SEGMENT, T.TABLE_ROWS), (3, 10), (1, 1)])
def test_trie_against_plain_version(spark, segment, table_rows):
    rows = dialogues(segment)
    paths = T.paths_of(T.rebuilt(frame(spark, rows).selectExpr("*", "'x' as size", "1 as depth", "2 as place")), segment)
    assert found(T.trie(paths, segment, table_rows)) == plain_trie(rows)


def test_query(spark, tmp_path):
    rows = dialogues(77)
    columns = dict(zip(("conv_id", "turn", "role", "text"), map(list, zip(*rows))))
    schema = [("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]
    write_table(tmp_path, "conversations", columns, schema)
    assert found(T.op13_prefix_trie(spark, str(tmp_path))) == plain_trie(rows)


def test_conversations_without_turns_of_their_own(spark):
    rows = [(c, 0, "user", "only") for c in range(1, 12)]  # no conversation 0 to take turns from
    got = found(T.trie(T.paths_of(T.rebuilt(frame(spark, rows)))))
    assert got == plain_trie(rows) and any(g[1] == 0 and g[7] != hashlib.sha256(b"").hexdigest() for g in got)


def test_empty(spark):
    assert T.trie(T.paths_of(T.rebuilt(frame(spark, [])))).count() == 0
    assert T.trie(T.paths_of(T.rebuilt(frame(spark, [(None, 1, "user", "x")])))).count() == 0


def test_members_of_one_node_in_many_pieces(spark, monkeypatch):
    monkeypatch.setattr(T, "IDS_A_ROW", 7)
    rows = [(c, 0, "user", "hello") for c in range(0, 400)]
    assert found(T.trie(T.paths_of(T.rebuilt(frame(spark, rows))))) == plain_trie(rows)


def test_colliding_prefixes_are_noticed(spark):
    paths = spark.createDataFrame(
        [(1, 0, 0, 0, 0, 0, 0, 0, False), (1, 1, 0, 5, 5, 0, 0, 3, True), (2, 1, 0, 5, 5, 0, 0, 4, True)],
        "conv_id long, depth long, segment long, s1 long, s2 long, p1 long, p2 long, size long, last boolean",
    )
    with pytest.raises(Exception, match="two prefixes share a digest"):
        T.trie(paths).collect()


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_node_table_is_minimal_and_perfect(n):
    rng = np.random.default_rng(n)
    a, b = rng.integers(0, 2**64, n, dtype=np.uint64), rng.integers(0, 2**64, n, dtype=np.uint64)
    a[:n // 2] = np.uint64(7)  # keys that differ in one word only
    nodes = T.NodeTable(a, b)
    assert sorted(nodes.find(a, b).tolist()) == list(range(n))
    other = rng.integers(0, 2**64, 100, dtype=np.uint64)
    assert (nodes.find(other, other) == -1).all()
    assert (nodes.find(a, b ^ np.uint64(1)) == -1).all()
