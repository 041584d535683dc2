"""Identities of paths, scenarios, branches, conditions and unexplained runs, as hash columns.

The prefixes, separators and lengths are fixed: results have to equal those of earlier runs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT = "\x1f"


def _short(text: Column, n: int) -> Column:
    return F.substring(F.sha2(text, 256), 1, n)


def path_key(steps: Column, end: Column) -> Column:
    return F.concat(F.array_join(steps, " "), F.lit("|"), end)


def path_id(steps: Column, end: Column) -> Column:
    return _short(path_key(steps, end), 10)


def stable_id(words: Column, end: Column) -> Column:
    """words: the decision and the outcome of each step, joined by UNIT."""
    return F.concat(F.lit("s1:"), _short(F.concat(F.lit("s1\n"), F.array_join(words, "\n"), F.lit("|"), end), 12))


def scenario_id(steps: Column) -> Column:
    return F.concat(F.lit("sc:"), _short(F.array_join(steps, UNIT), 10))


def branch_id(file: Column, function: Column, decision: Column, outcome: Column, occurrence: Column) -> Column:
    return F.concat(F.lit("b:"), _short(F.concat_ws("\n", F.lit("b1"), file, function, decision, outcome, occurrence.cast("string")), 12))


def unexplained_id(steps: Column) -> Column:
    return F.concat(F.lit("t1:"), _short(F.array_join(steps, "\n"), 12))
