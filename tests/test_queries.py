"""Every registered query against its SQL twin, on the smallest tables."""

import datetime
import decimal
import math
import re

import duckdb
import pytest

import __spark_entry__ as registered
from tests.helpers import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = registered.QUERIES, registered.ORACLES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(v):
    if v is None:
        return "NULL"
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return repr(v)


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(canonical(r[c]) for c in columns) for r in df.collect())
    cur = duck.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(tuple(canonical(r[i]) for i in at) for r in cur.fetchall())


def test_queries_without_sql_are_the_iterative_ones():
    assert set(QUERIES) - set(ORACLES) == {"cox_estimates", "cox_report", "bootstrap_hazards"}


PLAIN = [
    "linked_cohort", "resolve_conflicts", "outcome_rollup", "count_table", "retained_share", "attrition_ledger",
    "stratified_impute", "group_stat_to_rows", "link_fanout_guard", "exposure_interactions", "count_matrix_by_date",
]


@pytest.mark.parametrize("name", PLAIN)
def test_plans_stay_in_the_jvm_and_partitioned(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan and "CartesianProduct" not in plan
    assert not re.search(r"Window \[[^\n]*\n[^\n]*Sort[^\n]*\n[^\n]*Exchange SinglePartition", plan)


def test_scans_read_only_needed_columns(spark):
    plan = QUERIES["agg_latest"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {"o_custkey", "o_orderdate", "o_orderpriority"}
    pushed = QUERIES["scan_parquet"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,P)" in pushed


def test_flagship_entry(spark):
    df = registered.entry(spark)
    assert df.columns == ["ageband", "omicron", "n_cases", "n_hosp", "n_admitted", "first_stay"] and df.count() > 0
