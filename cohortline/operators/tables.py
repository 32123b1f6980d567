"""Descriptive tables: counts, matrices, delays, retained shares."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortline.functions.values import flag
from cohortline.operators.aggregates import mean_se
from cohortline.sources.storage import cut_lineage

# Up to this many levels are ordered by one window per variable; more are ordered by range.
WINDOW_LEVELS = 100_000


def stacked_levels(df: DataFrame, variables: Mapping[str, Column], keep: Sequence[str]) -> DataFrame:
    """One row per (record, variable) with its level; records without a level drop out."""
    pairs = [F.struct(F.lit(v).alias("variable"), c.cast("string").alias("level")) for v, c in variables.items()]
    return df.select(*keep, F.inline(F.array(*pairs))).where(F.col("level").isNotNull())


def ranked(rows: DataFrame, group: str, order: Sequence[Column], name: str, window_rows: int = WINDOW_LEVELS) -> DataFrame:
    """Number stored rows 1, 2, ... within each group in a total order.

    A table counted small is numbered by a window. A larger one is cut into ranges of
    (group, order), stored with the range's number, numbered within each range, and shifted by
    the sizes of the group's ranges before; the sizes, one per group and range that meet, are
    what passes through one task of a group. Both ways give the same numbers.
    """
    if rows.limit(window_rows + 1).count() <= window_rows:
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    cut = cut_lineage(rows.repartitionByRange(F.col(group), *order).withColumn("_range", F.spark_partition_id()))
    sizes = cut.groupBy(group, "_range").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(group, "_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    within = F.row_number().over(Window.partitionBy(group, "_range").orderBy(*order))
    joined = cut.withColumn("_within", within).join(offsets, [group, "_range"])
    return joined.select(*rows.columns, (F.col("_within") + F.col("_offset")).cast("int").alias(name))


def level_dimension(
    df: DataFrame, variables: Mapping[str, Column], declared: Mapping[str, Sequence[str]] | None = None,
    reference: Mapping[str, str] | None = None, window_levels: int = WINDOW_LEVELS,
) -> DataFrame:
    """Level list of categorical variables: (variable, level, ordinal, is_reference).

    Declared lists are returned in full; the other variables list the levels observed,
    in numeric order where they are numbers, else alphabetically. A reference level
    comes first.
    """
    spark = df.sparkSession
    declared, reference = declared or {}, reference or {}
    observed_vars = {v: c for v, c in variables.items() if v not in declared}
    parts = []
    if observed_vars:
        seen = stacked_levels(df, observed_vars, []).distinct()
        ref = F.lit(False)
        for v, level in reference.items():
            ref = ref | ((F.col("variable") == v) & (F.col("level") == level))
        order = [F.col("is_reference").desc(), F.expr("try_cast(level AS double)").asc_nulls_last(), F.col("level")]
        known = cut_lineage(seen.withColumn("is_reference", ref))
        parts.append(ranked(known, "variable", order, "ordinal", window_levels).select("variable", "level", "ordinal", "is_reference"))
    rows = [
        (v, level, i, level == reference.get(v))
        for v, levels in declared.items()
        if v in variables
        for i, level in enumerate(levels, start=1)
    ]
    if rows:
        parts.append(spark.createDataFrame(rows, "variable string, level string, ordinal int, is_reference boolean"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def count_table(
    df: DataFrame,
    variables: Mapping[str, Column],
    exposure: str,
    exposure_names: Mapping[int, str],
    endpoints: Mapping[str, Column],
    declared: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Counts by level of each variable, per endpoint subset and exposure.

    One pass: records are stacked over the variables and combined on the map side, so
    what is shuffled is one row per level and task. Levels without records count 0.
    """
    columns = {
        f"{e}_{label}": flag(cond & (F.col(exposure) == value))
        for e, cond in endpoints.items()
        for value, label in exposure_names.items()
    }
    base = df.select(*[c.alias(k) for k, c in columns.items()], *[c.cast("string").alias(f"v_{v}") for v, c in variables.items()])
    stacked = stacked_levels(base, {v: F.col(f"v_{v}") for v in variables}, list(columns))
    counts = stacked.groupBy("variable", "level").agg(*[F.sum(c).alias(c) for c in columns])
    if not declared:
        return counts
    spark = df.sparkSession
    rows = [(v, level) for v, levels in declared.items() if v in variables for level in levels]
    zeros = spark.createDataFrame(rows, "variable string, level string").select(
        "variable", "level", *[F.lit(0).cast("long").alias(c) for c in columns]
    )
    return counts.unionByName(zeros).groupBy("variable", "level").agg(*[F.sum(c).alias(c) for c in columns])


def count_matrix_by_date(
    df: DataFrame, date: str, band: str, bands: Mapping[str, str], groups: Mapping[tuple[str, str], Column]
) -> DataFrame:
    """Date × band counts for several record groups, bands across.

    ``bands`` maps output column to band label, ``groups`` maps (variant, type) to a
    condition. Records collapse to (date, band) cells once for all groups.
    """
    cells = df.groupBy(date, band).agg(
        *[F.count(F.when(cond, 1)).alias(f"g{i}") for i, cond in enumerate(groups.values())]
    )
    lines = [
        F.struct(F.lit(voc).alias("voc"), F.lit(kind).alias("type"), F.col(f"g{i}").alias("n"))
        for i, (voc, kind) in enumerate(groups)
    ]
    long = cells.select(F.col(date).alias("date"), F.col(band).alias("band"), F.inline(F.array(*lines)))
    aggs = [F.sum(F.when(F.col("band") == label, F.col("n")).otherwise(0)).alias(c) for c, label in bands.items()]
    present = F.sum(F.when(F.col("band").isNotNull(), F.col("n")).otherwise(0))
    wide = long.groupBy("voc", "type", "date").agg(*aggs, present.alias("_present"))
    return wide.where("_present > 0").drop("_present")


def delay_table(
    df: DataFrame, delay: Column, keep: Column, band: str, across: Mapping[str, Column], endpoint: str
) -> DataFrame:
    """Mean, standard error and count of a delay by band, groups across.

    ``across`` maps a column suffix to the condition of that group.
    """
    kept = df.select(F.col(band), delay.alias("delay"), *[c.alias(f"is_{k}") for k, c in across.items()], keep.alias("_keep"))
    kept = kept.where(F.col("_keep"))
    code = None
    for k in across:
        code = F.when(F.col(f"is_{k}"), k) if code is None else code.when(F.col(f"is_{k}"), k)
    stats = kept.withColumn("grp", code).groupBy(band, "grp").agg(*mean_se("delay"))
    aggs = [
        F.max(F.when(F.col("grp") == k, F.col(s))).alias(f"{s}_{k}") for s in ("av", "se", "n") for k in across
    ]
    return stats.groupBy(band).agg(*aggs).withColumn("endpoint", F.lit(endpoint))


def retained_share(
    df: DataFrame, stratifications: Mapping[str, str], exposed: str, unexposed: str, outcome: str
) -> DataFrame:
    """Share of the records that lie in informative strata (both exposures present).

    Per stratification: share of exposed and unexposed records, and of those with the
    outcome. All stratifications are computed in one pass over the records.
    """
    keys = [
        F.struct(F.lit(name).alias("stratification"), F.col(c).cast("string").alias("stratum"))
        for name, c in stratifications.items()
    ]
    base = df.select(
        F.col(exposed).alias("om"),
        F.col(unexposed).alias("dlt"),
        (F.col(outcome) * F.col(exposed)).alias("hosp_om"),
        (F.col(outcome) * F.col(unexposed)).alias("hosp_dlt"),
        F.inline(F.array(*keys)),
    )
    measures = ["om", "dlt", "hosp_om", "hosp_dlt"]
    strata = base.groupBy("stratification", "stratum").agg(*[F.sum(m).alias(m) for m in measures])
    informative = (F.col("om") > 0) & (F.col("dlt") > 0)
    return strata.groupBy("stratification").agg(
        *[
            F.try_divide(F.sum(F.when(informative, F.col(m)).otherwise(0)), F.sum(m)).alias(f"share_{m}")
            for m in measures
        ]
    )


def informative_strata(df: DataFrame, keys: Sequence[str], sums: Sequence[str], both: tuple[str, str]) -> DataFrame:
    """Group sums, kept where both exposures occur."""
    a, b = both
    return df.groupBy(*keys).agg(*[F.sum(s).alias(s) for s in sums]).where((F.col(a) > 0) & (F.col(b) > 0))


def crosstab(df: DataFrame, row: str, column: str) -> DataFrame:
    """Long two-way count table; rows with a missing category drop out."""
    known = df.where(F.col(row).isNotNull() & F.col(column).isNotNull())
    return known.groupBy(row, column).agg(F.count(F.lit(1)).alias("n"))
