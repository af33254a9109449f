"""Perspectives against a plain rendering, with long and odd dialogues."""

import itertools
import random
from collections import defaultdict

import pytest

from callmetrics.llm import chat_format as C


def plain(rows, part_turns):
    talks = defaultdict(list)
    for conv_id, turn, role, text in rows:
        talks[conv_id].append((turn is not None, turn or 0, text or "", role or "unknown"))
    out = []
    for conv_id, turns in talks.items():
        turns = [(role, text) for _, _, text, role in sorted(turns, key=lambda t: (t[0], t[1], t[2].encode(), t[3].encode()))]
        opening = "".join(f"<|im_start|>system\n{t}<|im_end|>\n" for _, t in itertools.takewhile(lambda t: t[0] == "system", turns[:part_turns]))
        for speaker in {r for r, _ in turns} - {"system"}:
            for at in range(0, len(turns), part_turns):
                part = turns[at:at + part_turns]
                text, spans = C.render(part, speaker)
                out.append(str((conv_id, at // part_turns, speaker, len(part), len(spans), opening if at else "", text, spans)))
    return sorted(out)


def got(spark, rows, part_turns=C.PART_TURNS):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    return sorted(
        str((r.conv_id, r.part, r.speaker, r.n_turns, r.n_loss_turns, r.context, r.rendered, [(s.begin, s.end) for s in r.loss_spans]))
        for r in C.perspectives(df, part_turns).collect()
    )


def test_render():
    turns = [("system", "Be kind."), ("ann", "Hi é"), ("bob b", ""), ("ann", "Bye")]
    text, spans = C.render(turns, "ann")
    assert text == (
        "<|im_start|>system\nBe kind.<|im_end|>\n<|im_start|>assistant\nHi é<|im_end|>\n"
        "<|im_start|>user name=bob_b\n<|im_end|>\n<|im_start|>assistant\nBye<|im_end|>\n"
    )
    assert [text[a:b] for a, b in spans] == ["Hi é<|im_end|>\n", "Bye<|im_end|>\n"]


ROWS = [
    (1, 0, "system", "s"), (1, 1, "ann", "a"), (1, 2, "bob", "b"), (1, 3, "cid", "c"),
    (2, 0, "user", None), (2, 1, None, "x"), (2, None, "user", "first"), (2, 1, "assistant", "x"), (2, 1, "assistant", "x"),
    (None, 0, "user", "lost"), (None, None, None, None), (3, 0, "system", "only"), (4, 5, "user", "é" * 5), (4, 5, "user", "ab\0c"), (4, 5, "user", "ab"),
]


@pytest.mark.parametrize("part_turns", [2, 512])
def test_odd_dialogues(spark, part_turns):
    assert got(spark, ROWS, part_turns) == plain(ROWS, part_turns)


@pytest.mark.parametrize("turns", [512, 513, 1500])
def test_all_parts_for_a_participant_who_is_silent_in_some(spark, turns):
    rows = [(1, 0, "system", "be kind"), (1, 1, "system", "be short")] + [(1, i, "ann" if i < 512 else "bob", f"t{i}") for i in range(2, turns)]
    rows += [(2, 0, "system", "s"), (2, 1, "cid", "x"), (None, 5, "dan", "y"), (3, 0, "system", "only")]
    assert got(spark, rows) == plain(rows, 512)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    views = defaultdict(list)
    for r in C.perspectives(df).where("conv_id = 1").orderBy("part").collect():
        views[r.speaker].append(r)
    assert set(views) == ({"ann", "bob"} if turns > 512 else {"ann"})
    for speaker, seen in views.items():
        whole, spans = C.render([(r[2], r[3]) for r in rows if r[0] == 1], speaker)
        assert "".join(r.rendered for r in seen) == whole and sum(len(r.loss_spans) for r in seen) == len(spans)
        assert [r.context for r in seen] == [""] + ["<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>system\nbe short<|im_end|>\n"] * (len(seen) - 1)


def test_check_sql_gives_every_part(spark, tmp_path):
    import duckdb
    import pyarrow as pa

    from callmetrics.llm.queries import CHECKS
    from tests.llm.helpers import write_table
    from tools.check import compare

    rows = [(1, 0, "system", "s")] + [(1, i, "ann" if i < 600 else "bob", f"t{i}") for i in range(1, 1100)] + [(2, 0, "cid", "x"), (None, 0, "dan", None)]
    schema = [("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]
    write_table(tmp_path, "conversations", dict(zip([n for n, _ in schema], map(list, zip(*rows)))), schema)
    with duckdb.connect() as duck:
        duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet'")
        assert compare(C.op10_chat_perspectives(spark, str(tmp_path)), duck.execute(CHECKS["op10_chat_perspectives"])) is None


def test_hot_dialogue_with_ties_and_copies(spark):
    rng = random.Random(3)
    rows = [(7, rng.choice([None, 1, 1, 1, rng.randrange(90)]), rng.choice("abc"), rng.choice(["same", f"t{rng.randrange(300)}"])) for _ in range(1500)]
    rows += [(100 + i, i % 4, "user", "hello") for i in range(200)]
    assert got(spark, rows, 40) == plain(rows, 40)


def test_empty(spark):
    assert C.perspectives(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    extra = spark.createDataFrame([(1, 0, "u", "t", "x", "y")], "conv_id long, turn long, role string, text string, part string, speaker string")
    assert C.perspectives(extra).count() == 1
