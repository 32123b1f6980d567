"""Test-result calls and their reduction to one call per person."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.functions.dates import col
from cohortline.functions.values import all_of, exactly_one, flag


def detected(c, limit: float) -> Column:
    """A cycle value strictly between zero and the limit."""
    return (col(c) > 0) & (col(c) < limit)


def threshold_call(
    df: DataFrame, target: str, controls: Sequence[str], limit: float = 30.0, negative: str = "sneg", positive: str = "spos"
) -> DataFrame:
    """Target-negative and target-positive calls, made only when all controls are detected."""
    controls_ok = all_of([detected(c, limit) for c in controls])
    return df.withColumns(
        {
            negative: flag((F.col(target) == 0) & controls_ok),
            positive: flag(detected(target, limit) & controls_ok),
        }
    )


def resolve_conflicts(
    df: DataFrame,
    key: str,
    date: str,
    look_back: int,
    negative: str = "sneg",
    positive: str = "spos",
    first: str = "first_date",
    last: str = "last_date",
) -> DataFrame:
    """One definitive call per person, or none when recent tests disagree.

    Tests reduce first to one row per person and day, with map-side combining; a
    person then holds at most one row per calendar day however many tests there are.
    All tests set the last test date; only definitive ones within ``look_back`` days
    of it count.
    """
    definitive = exactly_one(negative, positive)
    daily = df.groupBy(key, date).agg(
        F.max(F.when(definitive, F.col(positive)).otherwise(0)).alias("_pos"),
        F.max(F.when(definitive, F.col(negative)).otherwise(0)).alias("_neg"),
    )
    day = F.struct(F.col(date).alias("d"), F.col("_pos").alias("p"), F.col("_neg").alias("n"))
    persons = daily.groupBy(key).agg(F.max(date).alias("_last_test"), F.collect_list(day).alias("_days"))
    usable = F.filter(
        "_days",
        lambda x: ((x["p"] + x["n"]) > 0) & (F.datediff(F.col("_last_test"), x["d"]) <= look_back),
    )
    summary = persons.withColumn("_use", usable).where(F.size("_use") > 0)
    return summary.select(
        key,
        F.array_max(F.transform("_use", lambda x: x["p"])).alias(positive),
        F.array_max(F.transform("_use", lambda x: x["n"])).alias(negative),
        F.array_min(F.transform("_use", lambda x: x["d"])).alias(first),
        F.array_max(F.transform("_use", lambda x: x["d"])).alias(last),
    ).where(exactly_one(negative, positive))
