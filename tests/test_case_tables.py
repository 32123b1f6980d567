"""Order-level tables: the records that one task joins are bounded."""

from datetime import datetime

import pytest

from catalog import proxies

DAY = datetime(1999, 3, 1)
ORDERS = [(k, k % 3 + 1, "P" if k % 2 else "F", 1.0, DAY, "1-URGENT") for k in range(40)]
ORDERS += [(1, 2, "F", 1.0, datetime(1998, 1, 1), "3-MEDIUM"), (None, 1, "F", 1.0, DAY, "2-HIGH"), (41, None, "F", 1.0, DAY, "2-HIGH")]
LINES = [(k, 1, 1, 1, 30.0, 1.0, 0.0, 0.0, "R", "F", datetime(1999, 3, 11)) for k in range(0, 40, 2)]
LINES += [(1, 1, 1, 2, 5.0, 1.0, 0.0, 0.0, "A", "O", datetime(1998, 2, 1)), (None, 1, 1, 1, 5.0, 1.0, 0.0, 0.0, "A", "O", DAY)]


@pytest.fixture
def tables(spark, tmp_path):
    rows = {
        "orders": (ORDERS, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"),
        "lineitem": (LINES, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                     "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"),
        "customer": ([(c, f"c{c}", 1, 100.0 * c, "BUILDING") for c in (1, 2, 3)],
                     "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
        "nation": ([(1, "A", 1)], "n_nationkey int, n_name string, n_regionkey int"),
        "region": ([(1, "EUROPE")], "r_regionkey int, r_name string"),
    }
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield str(tmp_path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_tasks_that_join_lines_to_orders_follow_the_records(spark, tables, monkeypatch):
    at_least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for name in ("cases", "survival"):
        assert getattr(proxies.Proxies(spark, tables), name).rdd.getNumPartitions() == at_least
    monkeypatch.setattr(proxies, "TASK_RECORDS", 10, raising=False)
    parts = -(-(len(ORDERS) + len(LINES)) // 10)
    assert parts > at_least
    for name in ("cases", "survival"):
        assert getattr(proxies.Proxies(spark, tables), name).rdd.getNumPartitions() == parts


def test_cases_with_repeated_and_missing_order_keys(spark, tables):
    rows = proxies.Proxies(spark, tables).cases.select("case_id", "finalid", "hosp", "hosp_date", "dod", "age", "NHSER_name").collect()
    # orders without an owner drop out, one without a key stays, without events
    assert len(rows) == 42
    by = {}
    for r in rows:
        by.setdefault(r["case_id"], []).append(r)
    assert [(r["hosp"], r["hosp_date"], r["dod"]) for r in by[None]] == [(0, None, None)]
    # both orders of a repeated key have the events of the key
    assert [(r["finalid"], r["hosp"], str(r["hosp_date"])) for r in by[1]] == [(2, 1, "1998-02-01")] * 2
    assert (by[2][0]["hosp"], str(by[2][0]["dod"]), by[2][0]["age"], by[2][0]["NHSER_name"]) == (1, "1999-03-11", 11.0, "EUROPE")
    assert by[3][0]["hosp"] == 0
