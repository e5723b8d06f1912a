"""Filters as classifiers: every row gets its first matching reason, and the counts close."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ADMITTED = "admitted"


def first_reason(rules: Sequence[tuple[Column, str]], otherwise: str = ADMITTED) -> Column:
    """The name of the first rule that holds; a rule that is null doesn't hold."""
    out = None
    for holds, reason in rules:
        out = F.when(holds, reason) if out is None else out.when(holds, reason)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


def all_reasons(rules: Sequence[tuple[Column, str]]) -> Column:
    """An array of the names of all rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(holds, F.lit(reason)) for holds, reason in rules]))


def not_false(flag: Column) -> Column:
    """Three-valued gate: only an explicit false refuses, null passes."""
    return ~flag.eqNullSafe(F.lit(False))


def tally(classified: DataFrame, reason: str = "reason") -> DataFrame:
    return classified.groupBy(reason).agg(F.count(F.lit(1)).alias("n"))


def conservation(source: DataFrame, classified: DataFrame, reason: str = "reason") -> DataFrame:
    """One row: rows counted at the source, rows with a reason, and whether the two agree.

    The left side is a scan of its own, so a row that a classifier lost shows.
    """
    left = source.agg(F.count(F.lit(1)).alias("n_input"))
    right = classified.agg(F.count(reason).alias("n_classified"))
    return left.join(F.broadcast(right)).withColumn("closed", F.col("n_input") == F.col("n_classified"))
