"""Cohort analysis on Spark DataFrames.

Link record-level tables into one row per person, derive exposures, outcomes and
strata, tabulate, resample, impute and fit stratified hazard models.
"""

from cohortline.config import StudyConfig

__all__ = ["StudyConfig"]
