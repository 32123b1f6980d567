"""Order of levels, by window and by range."""

from pyspark.sql import functions as F

from cohortline.operators import tables
from tests.helpers import rows


def test_levels_are_numbered_alike_by_window_and_by_range(spark):
    values = ["10", "9", "9.5", "b", "a", "-3", None, "é", "", "9"] * 3
    df = spark.createDataFrame([(v, str(k % 7)) for k, v in enumerate(values)], "v string, w string").repartition(3)
    variables, reference = {"v": F.col("v"), "w": F.col("w"), "z": F.lit("x")}, {"v": "b", "w": "4"}
    got = {n: rows(tables.level_dimension(df, variables, {"z": ["y", "x"]}, reference, window_levels=n)) for n in (1000, 0)}
    assert got[0] == got[1000]
    ordered = sorted((r for r in got[0] if r[0] == "v"), key=lambda r: r[2])
    assert [r[1] for r in ordered] == ["b", "-3", "9", "9.5", "10", "", "a", "é"] and [r[2] for r in ordered] == list(range(1, 9))
    assert [r[1] for r in sorted((r for r in got[0] if r[0] == "z"), key=lambda r: r[2])] == ["y", "x"]
    assert tables.level_dimension(df.limit(0), variables, window_levels=0).count() == 0


def test_a_million_levels_are_ordered_without_a_window_over_all(spark):
    df = spark.range(1_000_000).select(F.pmod(F.col("id") * 7919, F.lit(1_000_000)).alias("v"))
    dim = tables.level_dimension(df, {"v": F.col("v")})
    bad = dim.where(F.col("ordinal") != F.col("level").cast("long") + 1)
    assert dim.count() == 1_000_000 and bad.count() == 0
    plan = dim._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [row_number" in line]
    assert windows and all("_range" in line for line in windows)
