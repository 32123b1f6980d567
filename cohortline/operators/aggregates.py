"""Per-entity aggregates. All of them combine on the map side before they shuffle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_and_latest(df: DataFrame, key: str, date: str, n: str = "n", latest: str = "latest") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(n), F.max(date).alias(latest))


def latest_event(df: DataFrame, key: str, date: str, name: str) -> DataFrame:
    return df.groupBy(key).agg(F.max(date).alias(name))


def latest_record(
    df: DataFrame, key: str, date: str, columns: Mapping[str, str], tie_break: Sequence[str] = (), n: str = "n"
) -> DataFrame:
    """Count the records of each key and return ``columns`` of the latest one.

    A record without a date is counted but only returned when no record has one
    (NULL ranks lowest inside a struct). Ties go to the largest ``tie_break``.
    """
    order = [date, *tie_break]
    carried = [c for c in dict.fromkeys(columns.values()) if c not in order]
    newest = df.groupBy(key).agg(
        F.count(F.lit(1)).alias(n), F.max(F.struct(*order, *carried)).alias("_last")
    )
    return newest.select(key, n, *[F.col(f"_last.{src}").alias(out) for out, src in columns.items()])


def roll_up_outcomes(
    df: DataFrame,
    key: str | Sequence[str],
    outcomes: Sequence[str],
    start: str,
    end: str,
    counted_only: Sequence[str] = (),
    weight: str = "n_stays",
    rank_sum: str = "rank_sum",
    rank_missing: str = "rank_missing",
    rank_name: str = "hosp_rank",
) -> DataFrame:
    """Wide roll-up of flagged events to one row per entity.

    Per outcome: number of events, earliest start and earliest end among the events
    that meet it; over the events that meet any the mean rank (NULL when one of those
    ranks is missing). Only entities with such an event are returned.
    """
    names = [*outcomes, *counted_only]
    kept = " OR ".join(f"`{o}` = 1" for o in names)
    aggs = [F.expr(f"sum(`{o}` * `{weight}`)").alias(o) for o in names]
    for o in outcomes:
        aggs.append(F.expr(f"min(IF(`{o}` = 1, `{start}`, NULL))").alias(f"{o}_date"))
        aggs.append(F.expr(f"min(IF(`{o}` = 1, `{end}`, NULL))").alias(f"{o}_out_date"))
    known = f"sum(IF({kept}, `{rank_missing}`, 0)) = 0"
    mean = f"sum(IF({kept}, `{rank_sum}`, 0)) / nullif(sum(IF({kept}, `{weight}`, 0)), 0)"
    aggs.append(F.expr(f"IF({known}, {mean}, NULL)").alias(rank_name))
    return df.where(kept).groupBy(*([key] if isinstance(key, str) else key)).agg(*aggs)


def collapse_records(df: DataFrame, keys: Sequence[str], rank: str) -> DataFrame:
    """Identical records become one with a weight.

    Grouping on the full key spreads one entity's records over many tasks, so an
    entity with very many records reaches later per-entity steps in reduced form.
    """
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_stays"),
        F.coalesce(F.sum(rank), F.lit(0.0)).alias("rank_sum"),
        F.sum(F.col(rank).isNull().cast("int")).alias("rank_missing"),
    )


def widen(
    df: DataFrame, key: str, number: str, numbers: Sequence[int], order: str, values: Sequence[str]
) -> DataFrame:
    """Long to wide: per sequence number the record with the earliest ``order``.

    Duplicates of (key, number) resolve to the earliest known ``order`` and then to
    the smallest values. Columns are named ``<value>_<number>``. Other numbers have no
    column; an entity that has only those keeps a row without values.
    """
    aggs = []
    for k in numbers:
        packed = F.struct(F.col(order).isNull().alias("_missing"), F.col(order), *values)
        aggs.append(F.min(F.when(F.col(number) == k, packed)).alias(f"_r{k}"))
    wide = df.groupBy(key).agg(*aggs)
    out = [F.col(f"_r{k}.{v}").alias(f"{v}_{k}") for v in values for k in numbers]
    out += [F.col(f"_r{k}.{order}").alias(f"{order}_{k}") for k in numbers]
    return wide.select(key, *out)


def mean_se(value: str) -> list[Column]:
    """Mean, sd / sqrt(n - 1) and n of a column within its group."""
    n = F.count(F.lit(1))
    return [
        F.avg(value).alias("av"),
        (F.stddev_samp(value) / F.sqrt(F.nullif(n - 1, F.lit(0)))).alias("se"),
        n.alias("n"),
    ]
