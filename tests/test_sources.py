from datetime import date

import pytest
from pyspark.sql import functions as F

from cohortline.config import StudyConfig
from cohortline.sources import storage
from cohortline.sources.records import SOURCES, read_source, typed_records
from tests.helpers import rows


@pytest.mark.parametrize("codec", ["none", "gzip", "bzip2", "zstd"])
def test_read_delimited_records(spark, tmp_path, codec):
    raw = spark.createDataFrame(
        [("p1", "24JAN2022", "AZ", "1"), ("p2", "bad", "PF", "2"), (None, "24JAN2022", "MD", "1")],
        "finalid string, vaccination_date string, product_display_type string, dose_number string",
    )
    path = str(tmp_path / codec)
    try:
        raw.write.option("header", True).option("compression", codec).csv(path)
    except Exception as e:
        if not any(known in str(e) for known in ("native", "codec", "Codec")):
            raise
        pytest.skip(f"no {codec} library on this machine")
    out = read_source(spark, SOURCES["doses"], path)
    assert rows(out, "finalid", "date_dose", "vacc_dose", "dose_number") == [("p1", date(2022, 1, 24), "AZ", 1), ("p2", None, "PF", 2)]


def test_every_source_has_its_key_and_dates():
    for s in SOURCES.values():
        assert s.key in s.columns and set(s.dates) <= set(s.columns) and set(s.rename) <= set(s.columns)
    assert len(SOURCES) == 8


def test_typed_dates_are_left_alone(spark):
    df = spark.createDataFrame([("p", "Yes", date(2022, 1, 1))], "finalid string, overall_travel string, specimen_date_sk date")
    assert rows(typed_records(df, SOURCES["travel"]), "travel_specimen_date") == [(date(2022, 1, 1),)]


def test_snapshot_is_reused_only_when_finished(spark, tmp_path):
    cfg, built = StudyConfig(link_variant="_x"), []

    def build():
        built.append(1)
        return spark.range(3)

    base = str(tmp_path)
    for _ in range(2):
        assert storage.snapshot(spark, base, "linked", cfg, build).count() == 3
    assert len(built) == 1
    assert storage.snapshot_path(base, "linked", cfg).count("_x_") == 1
    storage.snapshot(spark, base, "linked", cfg.variant(min_days_to_stay=1), build)
    assert len(built) == 2
    # an unfinished write carries no marker
    import os

    os.remove(os.path.join(storage.snapshot_path(base, "linked", cfg), "_SUCCESS"))
    storage.snapshot(spark, base, "linked", cfg, build, save=False)
    assert len(built) == 3


def test_results_replace_their_own_partition_only(spark, tmp_path):
    path = str(tmp_path / "res")
    for model, n in (("a", 1), ("b", 2), ("a", 3)):
        df = spark.range(n).select(F.col("id").alias("v"))
        storage.write_results(storage.label_results(df, "cut", "d", model), path)
    got = spark.read.parquet(path).groupBy("model").count()
    assert rows(got) == [("a", 3), ("b", 2)]


def test_shared_folder_comes_from_the_session(spark):
    assert storage.staging_path(spark, "x").startswith(storage.shared_dir(spark).rstrip("/"))
    assert spark.sparkContext.getCheckpointDir() is not None
