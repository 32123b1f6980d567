"""Named filter steps and the attrition ledger."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.functions.values import all_of


@dataclass(frozen=True)
class Step:
    """A filter with the text that describes it in the ledger."""

    label: str
    keep: Column


def complete_cases(required: Sequence[str], unknown: dict[str, str] | None = None) -> Column:
    """All required columns known, and none equal to its "unknown" label."""
    tests = [F.col(c).isNotNull() for c in required]
    tests += [F.col(c) != value for c, value in (unknown or {}).items()]
    return all_of(tests)


def apply_steps(df: DataFrame, steps: Sequence[Step]) -> DataFrame:
    for step in steps:
        df = df.where(step.keep)
    return df


def attrition_ledger(df: DataFrame, steps: Sequence[Step], start_label: str = "All records") -> DataFrame:
    """Rows left after every step and rows lost by it, from one pass over the table."""
    sums = [F.count(F.lit(1)).alias("s0")]
    so_far = F.lit(True)
    for i, step in enumerate(steps, start=1):
        so_far = so_far & F.coalesce(step.keep, F.lit(False))
        sums.append(F.count(F.when(so_far, 1)).alias(f"s{i}"))
    counts = df.agg(*sums)
    labels = [start_label, *[s.label for s in steps]]
    lines = [
        F.struct(
            F.lit(i).alias("step"),
            F.lit(label).alias("label"),
            F.col(f"s{i}").alias("n"),
            (F.col(f"s{max(i - 1, 0)}") - F.col(f"s{i}")).alias("dropped"),
        )
        for i, label in enumerate(labels)
    ]
    return counts.select(F.inline(F.array(*lines)))
