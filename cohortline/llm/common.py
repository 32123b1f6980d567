"""Helpers shared by the text operators."""

from __future__ import annotations

import sys
from collections.abc import Callable, Hashable
from functools import reduce
from operator import and_
from types import ModuleType

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortline.sources.storage import staging_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = " \t\n\x0b\x0c\r"
# A table is sent to every task only after it was counted and has no more rows.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write a table once to the shared folder and read it back.

    Cuts the lineage: several jobs read the same rows, and the files outlive lost executors.
    """
    spark = df.sparkSession
    path = staging_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def without_spaces(text: Column) -> Column:
    """Delete every character of ``[\\x20\\x09-\\x0D]``."""
    return reduce(lambda out, ch: F.replace(out, F.lit(ch), F.lit("")), SPACES, text)


def same(left: str, right: str, *keys: str) -> Column:
    """Equality of key columns in which NULL equals NULL."""
    return reduce(and_, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True when a (stored) table has at most ``rows`` rows; reads no more than that."""
    return df.limit(rows + 1).count() <= rows


def shuffled(df: DataFrame) -> DataFrame:
    """Mark a table of unbounded size for a sort-merge join.

    Spark judges a stored table by its compressed file, and one made of it by ``explode`` as no
    larger, so a table of many times its limit might be gathered in the driver to be broadcast.
    """
    return df.hint("merge")


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a stored table for broadcast if its counted size allows it; else it is shuffled."""
    return F.broadcast(df) if small(df, rows) else shuffled(df)


def numbered(docs: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """The stored rows with a number each, and the name of that new column.

    The numbers are part of the written table, so every later scan and every retry sees the
    same ones; a row can then be told from others with its doc_id and text.
    """
    name = "_row"
    while name in docs.columns:
        name += "_"
    return stored(docs.withColumn(name, F.monotonically_increasing_id()), tag), name


def without(docs: DataFrame, dropped: DataFrame, key: str) -> DataFrame:
    """Rows of ``docs`` whose ``key`` is not among the (stored, narrow) ones to drop; NULL keys stay.

    A list that was counted small is broadcast, so the texts are not shuffled.
    """
    return docs.join(sized(dropped), key, "left_anti").select(*docs.columns)


def kept_by_worker(key: Hashable, make: Callable):
    """The object of ``key`` in this Python process, made when another key or none was asked for last.

    Functions that travel with tasks are unpickled for each task, their globals too; a module
    of its own outlives that, so an encoder's memory serves all tasks of a worker. One object
    is kept at a time, which bounds what a worker holds.
    """
    home = sys.modules.setdefault("_text_worker", ModuleType("_text_worker")).__dict__
    if home.get("key") != key:
        home.clear()
        home.update(key=key, value=make())
    return home["value"]


def travels(module_name: str) -> None:
    """Send a module's functions with the tasks, so that executors need not have the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])
