"""Bulk rescoring: reapply parser and certificate check to stored answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callmetrics.functions import answers as A
from callmetrics.functions import outcomes as O


def _scored(rows: DataFrame, variables: int) -> DataFrame:
    """Adds ``__new`` to every row: the struct of outcome and parsed answer that
    its stored response now gives; null for calls that are not rescored."""
    eligible = (F.coalesce(F.col("provider_mismatch"), F.lit(0)) == 0) & O.finished(F.col("finish_reason"))
    bits = rows.withColumn("__bits", F.when(eligible, A.final_bits(F.col("response_text"), variables)))
    outcome = (
        F.when(F.col("__bits").isNull(), "fail_parse")
        .when(A.satisfies(F.col("clauses"), F.col("__bits")), O.PASS)
        .otherwise(O.WRONG)
    )
    new = F.struct(outcome.alias("outcome"), A.assignment_json(F.col("__bits")).alias("parsed_answer"))
    return bits.withColumn("__new", F.when(eligible, new)).drop("__bits")


def changes(rows: DataFrame, variables: int) -> DataFrame:
    """``rows(call_id, clauses, response_text, finish_reason, provider_mismatch,
    outcome, parsed_answer)`` to the new score of every finished, matching call
    whose score differs from the stored one."""
    new = _scored(rows, variables).where(F.col("__new").isNotNull()).select(
        "call_id", F.col("outcome").alias("before"), F.col("parsed_answer").alias("parsed_before"), "__new.*"
    )
    same = new["outcome"].eqNullSafe(new["before"]) & new["parsed_answer"].eqNullSafe(new["parsed_before"])
    return new.where(~same)


def apply_rescoring(rows: DataFrame, variables: int) -> DataFrame:
    """The table with its new scores. Every change comes from its own row, so
    this is one pass without a join."""
    hit = F.col("__new").isNotNull()
    outcome = F.when(hit, F.col("__new.outcome")).otherwise(F.col("outcome"))
    changed = {
        "outcome": outcome, "parsed_answer": F.when(hit, F.col("__new.parsed_answer")).otherwise(F.col("parsed_answer")),
        "pass": F.when(outcome == O.PASS, 1).otherwise(0),
    }
    return _scored(rows, variables).select(*[changed.get(c, F.col(c)).alias(c) for c in rows.columns])
