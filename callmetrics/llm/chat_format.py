"""Chat formatting by perspective rotation (operator 10).

For every participant of a dialogue the whole dialogue is rendered with that
speaker as the assistant, all others as named users and system turns as they
are; the loss mask covers the speaker's own turns, end marker included.

Turns stand in the order turn, text, role (nulls first). A dialogue is given in
parts of ``PART_TURNS`` turns, every part to every participant of the whole
dialogue, also where they are silent: the parts of a speaker, joined in order,
are the whole dialogue. From the second part on, ``context`` repeats the system
turns that open the dialogue (those in its first part), to be put before the
part when it is used alone. Copies of a turn are counted before they are dealt
out, the position of a turn comes from range totals, and a part is all that one
row ever holds, so a dialogue with a third of all turns is spread over many
tasks; participants are distinct roles, pre-aggregated.

A null conversation is a dialogue of its own, a null text an empty turn, a null
role the speaker ``unknown``. A name keeps letters, digits and ``_.-``; other
characters become ``_``. Repeated rows are repeated turns. A dialogue in which
only the system speaks, and an empty table, give no rows.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from callmetrics.llm.common import small_batches, stored, table
from callmetrics.operators.ordered import prefix_sums

PART_TURNS = 512
SYSTEM = "system"
UNKNOWN = "unknown"
END = "<|im_end|>\n"


def heading(role: str, speaker: str) -> str:
    if role == SYSTEM:
        return "<|im_start|>system\n"
    if role == speaker:
        return "<|im_start|>assistant\n"
    return f"<|im_start|>user name={re.sub(r'[^A-Za-z0-9_.-]', '_', role)}\n"


def render(turns: list[tuple[str, str]], speaker: str) -> tuple[str, list[tuple[int, int]]]:
    """Text of (role, text) turns as seen by the speaker, and the spans of code
    points that count for the loss, end exclusive."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head = heading(role, speaker)
        begin = at + len(head)
        at = begin + len(text) + len(END)
        parts += [head, text, END]
        if role == speaker:
            spans.append((begin, at))
    return "".join(parts), spans


_SPAN = StructType([StructField("begin", LongType()), StructField("end", LongType())])
_VIEW = StructType([StructField("rendered", StringType()), StructField("loss_spans", ArrayType(_SPAN))])
_ARROW_VIEW = pa.struct([
    ("rendered", pa.string()), ("loss_spans", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
])


@F.arrow_udf(_VIEW)
def _view(turns: pa.Array, speaker: pa.Array) -> pa.Array:
    rows = []
    for part, name in zip(turns, speaker.to_pylist()):
        text, spans = render([(t["role"], t["text"]) for t in part.as_py()], name)
        rows.append({"rendered": text, "loss_spans": [{"begin": a, "end": b} for a, b in spans]})
    return pa.array(rows, _ARROW_VIEW)


def parts(conversations: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """(conv_id, part, turns): turns are (position, role, text) in order."""
    turns = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit(UNKNOWN)).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    counted = turns.groupBy("conv_id", "turn", "text", "role").agg(F.count(F.lit(1)).alias("copies"))
    # The first bytes as a number order texts as their bytes do.
    opening = F.conv(F.hex(F.rpad(F.substring(F.encode("text", "UTF-8"), 1, 6), 6, b"\0")), 16, 10).cast("double")
    placed = prefix_sums(
        counted.withColumn("opening", opening), "turn", {"before": "copies"}, ["conv_id"],
        [F.col("turn"), F.col("opening"), F.col("text"), F.col("role")], tie="opening",
    )
    spread = placed.withColumn("position", F.explode(F.sequence(F.col("before"), F.col("before") + F.col("copies") - 1)))
    return (
        spread.groupBy("conv_id", F.floor(F.col("position") / part_turns).alias("part"))
        .agg(F.sort_array(F.collect_list(F.struct("position", "role", "text"))).alias("turns"))
    )


def _opening(turns: str) -> F.Column:
    """The rendered system turns before the first other one."""
    others = F.transform(turns, lambda t: t["role"] != SYSTEM)
    first = F.array_position(others, True)
    lead = F.when(first > 0, F.slice(turns, F.lit(1), F.greatest(first.cast("int") - 1, F.lit(0)))).otherwise(F.col(turns))
    return F.array_join(F.transform(lead, lambda t: F.concat(F.lit(heading(SYSTEM, "")), t["text"], F.lit(END))), "")


def perspectives(conversations: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """(conv_id, part, speaker, n_turns, n_loss_turns, context, rendered, loss_spans)."""
    cut = parts(small_batches(conversations), part_turns)
    roles = F.array_distinct(F.filter(F.transform("turns", lambda t: t["role"]), lambda r: r != SYSTEM))
    turns = conversations.select("conv_id", F.coalesce("role", F.lit(UNKNOWN)).alias("role"))
    long = stored(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > part_turns).select("conv_id"), "long")
    if long.isEmpty():  # every dialogue is one part, with all who speak in it
        seats = cut.withColumn("speaker", F.explode(roles)).withColumn("context", F.lit(""))
    else:
        cut = stored(cut, "parts")

        def of(other: DataFrame, name: str) -> F.Column:
            return cut["conv_id"].eqNullSafe(other[name])

        ids = long.select(F.col("conv_id").alias("long_id"))
        speakers = turns.where(F.col("role") != SYSTEM).distinct().withColumnsRenamed({"conv_id": "seat_id", "role": "speaker"})
        speakers = speakers.join(ids, F.col("seat_id").eqNullSafe(F.col("long_id")), "left_semi")
        openings = cut.where("part = 0").join(ids, of(ids, "long_id"), "left_semi").select(F.col("conv_id").alias("opening_id"), _opening("turns").alias("opening"))
        short = cut.join(ids, of(ids, "long_id"), "left_anti").withColumn("speaker", F.explode(roles)).withColumn("context", F.lit(""))
        seats = short.unionByName(
            cut.join(speakers, of(speakers, "seat_id")).join(openings, of(openings, "opening_id"))
            .withColumn("context", F.when(F.col("part") > 0, F.col("opening")).otherwise("")).select(*short.columns)
        )
    return (
        seats.withColumn("view", _view(F.col("turns"), F.col("speaker")))
        .select(
            "conv_id", "part", "speaker", F.size("turns").cast("long").alias("n_turns"),
            F.size("view.loss_spans").cast("long").alias("n_loss_turns"), "context", "view.rendered", "view.loss_spans",
        )
    )


def op10_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as seen by each of its speakers; see the module for the method."""
    spans = F.array_join(F.transform("loss_spans", lambda s: F.concat_ws(":", s["begin"], s["end"])), ",")
    return perspectives(table(spark, sf_dir, "conversations")).withColumn("loss_spans", spans)
