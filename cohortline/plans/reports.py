"""Descriptive reports of the study: counts by date and delay tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.functions.dates import days_between, in_lag
from cohortline.operators.tables import count_matrix_by_date, delay_table

INDEX = "last_specimen_date"
# Accepted delays in days, and the two outcomes reported.
ONSET_WINDOW = (0, 14)
STAY_LENGTH_WINDOW = (0, 7)
OUTCOMES = ("hosp", "hospA")


def counts_by_date(df: DataFrame, bands: Mapping[str, str], analysed: DataFrame | None = None) -> DataFrame:
    """Cases and stays per day and age band: all, exposed and unexposed.

    ``df`` is the data cut. Exposed and unexposed counts come from ``analysed``, the records
    that are analysed, where these are not the whole cut (imputed exposure, a subset).
    """
    if analysed is not None:
        every = counts_by_date(df, bands).where("voc = 'all'")
        return every.unionByName(counts_by_date(analysed, bands).where("voc <> 'all'"))
    omicron, delta, hosp = F.col("omicron") == 1, F.col("delta") == 1, F.col("hosp") == 1
    every = F.lit(True)
    groups = {
        (voc, kind): cond & sub
        for voc, cond in (("all", every), ("omicron", omicron), ("delta", delta))
        for kind, sub in (("case", every), ("hosp", hosp))
    }
    return count_matrix_by_date(df, INDEX, "ageband", bands, groups)


def _by_exposure() -> dict[str, Column]:
    return {"Delta": F.col("omicron") == 0, "Omicron": F.col("omicron") == 1}


def _both(build) -> DataFrame:
    first, second = (build(e) for e in OUTCOMES)
    return first.unionByName(second, allowMissingColumns=True)


def _onset_ok() -> Column:
    return in_lag(days_between(INDEX, "Onsetdate"), *ONSET_WINDOW) & (F.col("reinfection_flag") == 0)


def onset_to_test(df: DataFrame) -> DataFrame:
    """Onset to test, by band, exposure and outcome; first infections, 0 to 14 days."""

    def build(e):
        across = {f"{k}_{v}": c & (F.col(e) == v) for k, c in _by_exposure().items() for v in (0, 1)}
        return delay_table(df, days_between(INDEX, "Onsetdate"), _onset_ok(), "ageband1", across, e)

    return _both(build)


def onset_to_outcome(df: DataFrame) -> DataFrame:
    def build(e):
        delay = days_between(f"{e}_date", "Onsetdate")
        keep = (F.col(e) == 1) & delay.isNotNull() & _onset_ok()
        return delay_table(df, delay, keep, "ageband1", _by_exposure(), e)

    return _both(build)


def length_of_stay(df: DataFrame) -> DataFrame:
    def build(e):
        delay = days_between(f"{e}_out_date", f"{e}_date")
        return delay_table(df, delay, (F.col(e) == 1) & in_lag(delay, *STAY_LENGTH_WINDOW), "ageband1", _by_exposure(), e)

    return _both(build)


def test_to_outcome(df: DataFrame) -> DataFrame:
    def build(e):
        delay = days_between(f"{e}_date", INDEX)
        return delay_table(df, delay, (F.col(e) == 1) & delay.isNotNull(), "ageband1", _by_exposure(), e)

    return _both(build)
