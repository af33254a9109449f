"""Spend ledger and collection progress logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callmetrics.operators.ordered import lagged


def spend_ledger(calls: DataFrame, uncapped_prefix: str) -> DataFrame:
    """One row per (stage, model) and one total row. ``capped_usd`` leaves out
    models whose id begins with ``uncapped_prefix``."""
    count = lambda code: F.count_if(F.col("outcome") == code).cast("bigint")
    rows = calls.groupBy("stage", "model_id").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("cost_microdollars").alias("micro"),
        F.sum("completion_tokens").alias("out_sum"), F.count("completion_tokens").alias("out_n"),
        count("pass").alias("pass"), count("fail_parse").alias("parse"),
        count("fail_truncated").alias("trunc"), count("error_api").alias("err"),
        F.sum(F.when(~F.col("model_id").startswith(uncapped_prefix), F.col("cost_microdollars")).otherwise(0)).alias("capped"),
    )
    # Rolling up the reduced rows, not the calls, keeps the expansion small.
    rolled = rows.rollup("stage", "model_id").agg(
        F.grouping_id().alias("g"),
        *[F.sum(c).alias(c) for c in ("calls", "micro", "out_sum", "out_n", "pass", "parse", "trunc", "err", "capped")],
    )
    return rolled.where(F.col("g").isin(0, 3)).select(
        F.coalesce("stage", F.lit("TOTAL")).alias("stage"), F.coalesce("model_id", F.lit("TOTAL")).alias("model_id"),
        "calls", F.round(F.col("micro") / F.lit(1e6), 2).alias("usd"),
        F.round(F.col("out_sum") / F.col("out_n"), 0).cast("bigint").alias("avg_out"),
        "pass", "parse", "trunc", "err", F.round(F.col("capped") / F.lit(1e6), 2).alias("capped_usd"),
    )


# Line formats of the collection logs.
PROGRESS = r"^\[(\d\d):(\d\d):(\d\d)\] (\d+)/(\d+) done, \$([0-9.]+) spent \(\$([0-9.]+) reserved\)"
ADAPTIVE = r"^\[adaptive\] batch at level (\d+): b=([0-9.]+) se=([0-9.]+) calls=(\d+)"
ARM = r"^\s*\[(\w+)\] (\d+)/(\d+) alpha=([0-9.]+) (PASS|fail) \(spend \$([0-9.]+)\)"


def parse_log_lines(lines: DataFrame) -> DataFrame:
    """``lines(log, line_no, value)`` to typed rows; other lines are dropped."""
    part = lambda pattern, i: F.regexp_extract("value", pattern, i)
    is_progress, is_batch, is_arm = (F.col("value").rlike(p) for p in (PROGRESS, ADAPTIVE, ARM))
    seconds = part(PROGRESS, 1).cast("int") * 3600 + part(PROGRESS, 2).cast("int") * 60 + part(PROGRESS, 3).cast("int")
    kind = F.when(is_progress, "progress").when(is_batch, "batch").when(is_arm, "arm")
    pick = lambda *cases: F.coalesce(*[F.when(cond, value) for cond, value in cases])
    return lines.select("log", "line_no", "value", kind.alias("kind")).where(F.col("kind").isNotNull()).select(
        "log", "line_no", "kind",
        F.when(is_progress, seconds).cast("bigint").alias("second_of_day"),
        pick((is_progress, part(PROGRESS, 4)), (is_arm, part(ARM, 2)), (is_batch, part(ADAPTIVE, 4))).cast("bigint").alias("done"),
        pick((is_progress, part(PROGRESS, 5)), (is_arm, part(ARM, 3))).cast("bigint").alias("total"),
        pick((is_progress, part(PROGRESS, 6)), (is_arm, part(ARM, 6))).cast("double").alias("spent_usd"),
        F.when(is_progress, part(PROGRESS, 7)).cast("double").alias("reserved_usd"),
        F.when(is_arm, part(ARM, 1)).alias("arm"),
        F.when(is_arm, part(ARM, 5) == "PASS").alias("passed"),
        F.when(is_batch, part(ADAPTIVE, 2)).cast("double").alias("b"),
    )


def progress_rate(progress: DataFrame) -> DataFrame:
    """Calls per hour between neighbouring progress lines of a log; a clock
    that went backwards has passed midnight."""
    lines = progress.where(F.col("kind") == "progress").select("log", "line_no", "second_of_day", "done", "spent_usd")
    steps = lagged(lines, "line_no", {"prev_second": "second_of_day", "prev_done": "done"}, ["log"])
    gap = F.pmod(F.col("second_of_day") - F.col("prev_second"), F.lit(86_400))
    rate = F.when(gap > 0, F.round((F.col("done") - F.col("prev_done")) * 3600.0 / gap, 6))
    return steps.select("log", "line_no", "done", "spent_usd", gap.cast("bigint").alias("gap_seconds"), rate.alias("calls_per_hour"))
