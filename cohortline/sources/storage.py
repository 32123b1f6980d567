"""Snapshots, staged tables and result sinks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortline.config import StudyConfig


def one_machine(master: str) -> bool:
    """True for masters whose driver is the only process."""
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the session.

    Only a session on one machine that names none (tests) gets a temporary folder; on a
    cluster that would be a folder other machines cannot see, so it is an error.
    """
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if not one_machine(spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        known = tempfile.mkdtemp(prefix="cohortline-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(known)
    return known


def staging_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/cohortline/{tag}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise a table that several jobs reuse; the copy outlives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def is_complete(spark: SparkSession, path: str) -> bool:
    """TRUE when a finished write lies at ``path`` (a killed job leaves no marker)."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def snapshot_path(base: str, name: str, cfg: StudyConfig) -> str:
    """Path that carries the cut date, the link variant and a digest of all parameters."""
    return f"{base.rstrip('/')}/{name}_{cfg.date_name}{cfg.link_variant}_{cfg.link_tag()}.parquet"


def write_snapshot(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def snapshot(
    spark: SparkSession,
    base: str,
    name: str,
    cfg: StudyConfig,
    build: Callable[[], DataFrame],
    reuse: bool = True,
    save: bool = True,
) -> DataFrame:
    """Read a finished snapshot if there is one, else build it and (optionally) save it."""
    path = snapshot_path(base, name, cfg)
    if reuse and is_complete(spark, path):
        return spark.read.parquet(path)
    df = build()
    if not save:
        return df
    write_snapshot(df, path)
    return spark.read.parquet(path)


def label_results(df: DataFrame, datacut: str, date_name: str, model: str, agedesc: str = "allage") -> DataFrame:
    """Add the run labels that tell result tables apart."""
    return df.select(
        F.lit(datacut).alias("datacut"),
        F.lit(date_name).alias("date_name"),
        F.lit(agedesc).alias("agedesc"),
        F.lit(model).alias("model"),
        "*",
    )


# The columns that name a result; each has its own folder.
RESULT_LABELS = ("datacut", "date_name", "agedesc", "model")


def write_results(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    partition_by: Sequence[str] = RESULT_LABELS,
) -> None:
    """Result tables, one folder per data cut, run date, age set and model; reruns replace their own folders."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.partitionBy(*[c for c in partition_by if c in df.columns]).format(fmt).save(path)


def read_results(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Results with their labels as text (folder names that look like dates are read as dates)."""
    df = spark.read.format(fmt).option("header", True).load(path)
    return df.withColumns({c: F.col(c).cast("string") for c in RESULT_LABELS if c in df.columns})
