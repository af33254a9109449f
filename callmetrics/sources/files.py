"""File sources and sinks: JSON lines, frozen models, logs, write-once reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PREDICTION_LINES = "label bigint, pred_curve double, pred_metadata double, pred_trace double, pred_combined double"


def read_json_lines(spark: SparkSession, path: str, schema: str = PREDICTION_LINES) -> DataFrame:
    """Blank lines are skipped; a malformed line is an error. Compressed files
    are recognised by their suffix."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def load_frozen(spark: SparkSession, path: str) -> dict:
    """One small model document, wherever Spark can read it. A path that holds
    none or several is refused: which one was meant can't be told."""
    found = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"one model document is wanted, {'several are' if found else 'none is'} at {path}")
    return json.loads(found[0][0])


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Log lines with their file and a number that orders the lines of a file:
    the byte at which the block they were read from begins, and their place in
    the task. A file's blocks are as long as a task reads, but for the last, and
    a line has a byte at least, so no number reaches the next block."""
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("log"), (F.col("_metadata.file_block_start") + place).alias("line_no"), "value"
    )


def write_once(df: DataFrame, path: str) -> None:
    """A result is published a single time: writing over one is refused."""
    df.write.mode("errorifexists").json(path)
