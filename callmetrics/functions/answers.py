"""Final answers and their certificates, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the accepted final line. The character class takes the digits
# and separators in one step, so a very long answer needs no backtracking.
FINAL_LINE = r"(?imd)^\s*FINAL\s*:\s*([01][01\s,]*)\s*$"


def final_bits(text: Column, variables: int) -> Column:
    """Booleans of the last final line; NULL unless there are exactly as many
    digits as variables."""
    lines = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(FINAL_LINE), 1)
    digits = F.regexp_extract_all(F.try_element_at(lines, F.lit(-1)), F.lit("([01])"), 1)
    return F.when(F.size(digits) == variables, F.transform(digits, lambda b: b == "1"))


def satisfies(clauses: Column, assignment: Column) -> Column:
    """Every clause holds a literal whose variable has the literal's sign."""
    return F.forall(
        clauses,
        lambda clause: F.exists(
            clause, lambda literal: F.element_at(assignment, F.abs(literal).cast("int")) == (literal > 0)
        ),
    )


def assignment_json(assignment: Column) -> Column:
    """``[true, false]`` with a space after each comma."""
    words = F.transform(assignment, lambda b: F.when(b, "true").otherwise("false"))
    return F.when(assignment.isNotNull(), F.concat(F.lit("["), F.array_join(words, ", "), F.lit("]")))
