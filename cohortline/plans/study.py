"""The study from record tables to result tables.

Stages meet at tables in shared storage: the linked snapshot and the staged cohort.
Each later job reads those instead of repeating the stages before.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortline.config import StudyConfig
from cohortline.functions.levels import band_labels
from cohortline.operators.selection import attrition_ledger
from cohortline.operators.tables import retained_share
from cohortline.plans import ascertainment, derivation, fixed, models, reports
from cohortline.plans.linkage import linked_cohort
from cohortline.sources.records import SOURCES, read_source
from cohortline.sources.storage import label_results, snapshot, staging_path, write_results, write_snapshot

KEY = ["finalid"]


@dataclass(frozen=True)
class Analysis:
    """One analysis: run parameters, models to fit and tables to write."""

    name: str
    cfg: StudyConfig
    model_set: tuple[int, ...] = ()
    counts: bool = False
    delays: bool = False
    shares: bool = False
    bootstrap: bool = False
    age_sets: tuple[str, ...] = ("allage",)


def analyses(base: StudyConfig) -> list[Analysis]:
    """The study's analyses in run order."""
    sets = {k: tuple(v) for k, v in models.MODEL_SETS.items()}
    return [
        Analysis("main", base, sets["main"], counts=True),
        Analysis("sensitivity", base, sets["sensitivity"]),
        Analysis("unvaccinated", base.variant(unvaccinated_only=True), sets["unvaccinated"], counts=True),
        Analysis("any_identifier", base.variant(valid_id_only=False), sets["primary"], counts=True),
        Analysis("under_ascertainment", base.variant(standard_errors=False), sets["under_ascertainment"], bootstrap=True),
        Analysis("from_day_1", base.variant(min_days_to_stay=1, link_variant="_sp1"), sets["primary"], counts=True),
        Analysis("genotype_only", base.variant(genotype_only=True, link_variant="_vam"), sets["genotype_only"], counts=True),
        Analysis("pillar_2", base.variant(pillar2_only=True, link_variant="_p2"), sets["primary"], counts=True),
    ]


def read_tables(spark: SparkSession, paths: dict[str, str], fmt: str = "csv") -> dict[str, DataFrame]:
    """The record tables by name, typed."""
    return {name: read_source(spark, SOURCES[name], path, fmt) for name, path in paths.items()}


def link_config(cfg: StudyConfig) -> StudyConfig:
    """The parameters linkage depends on; analyses that differ elsewhere share its snapshot."""
    defaults = StudyConfig()
    return cfg.variant(
        valid_id_only=defaults.valid_id_only, unvaccinated_only=False, resample=False, impute_exposure=False,
        model_imputation=False, standard_errors=True, seed=defaults.seed, bootstrap_iterations=defaults.bootstrap_iterations,
        endpoints=defaults.endpoints,
    )


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write a table to the shared folder and read it back."""
    path = staging_path(df.sparkSession, tag)
    write_snapshot(df, path)
    return df.sparkSession.read.parquet(path)


def run_analysis(
    spark: SparkSession, tables: dict[str, DataFrame], analysis: Analysis, base: str, tie_break: Sequence[str] = (),
    replicates: int | None = None, specs: Sequence[models.ModelSpec] | None = None, reuse: bool = True,
) -> dict[str, DataFrame]:
    """Link, filter, derive, tabulate and fit one analysis; returns its result tables.

    Results are written below ``<base>/results/<kind>``, one folder per data cut and model.
    """
    cfg = analysis.cfg
    linked = snapshot(spark, f"{base}/snapshots", "linked", link_config(cfg), lambda: linked_cohort(tables, cfg, tie_break), reuse)
    cut = staged(derivation.analysis_table(linked, cfg), "cut")
    specs = list(specs) if specs is not None else [models.MODELS[j] for j in analysis.model_set]
    out: dict[str, tuple[str, DataFrame]] = {
        "attrition": ("attrition", attrition_ledger(derivation.with_index_date(linked), derivation.ledger_steps(cfg)))
    }
    if analysis.bootstrap:
        for spec in specs:
            fits = ascertainment.bootstrap_under_ascertainment(cut, cfg, KEY, replicates, spec=spec)
            out["boot_res"] = (spec.name, fits)
            out["boot_res_sum"] = (spec.name, ascertainment.bootstrap_report(fits, cfg.endpoints))
        return _write(out, cfg, base)
    cohort = staged(ascertainment.cohort(cut, cfg, KEY), "cohort")
    if analysis.delays:
        out["onset_to_test"] = ("delays", reports.onset_to_test(cohort))
        out["onset_to_outcome"] = ("delays", reports.onset_to_outcome(cohort))
        out["length_of_stay"] = ("delays", reports.length_of_stay(cohort))
        out["test_to_outcome"] = ("delays", reports.test_to_outcome(cohort))
    if analysis.shares:
        for name, rows in (("retained", cohort), ("retained_lt10", cohort.where("ageband1 = 0"))):
            out[name] = ("shares", retained_share(rows, fixed.STRATIFICATION_NAMES, "omicron", "delta", "hosp"))
    if analysis.counts:
        bands = {f"age_{i}": b for i, b in enumerate(band_labels(fixed.AGE_BREAKS))}
        out["num_age_date"] = ("counts", reports.counts_by_date(cut, bands, cohort))
        declared = {"ageband": band_labels(fixed.AGE_BREAKS)}
        table = models.table_with_hazards(cohort, cfg, declared=declared).withColumn("row_label", models.row_label())
        out["num_tab"] = ("counts", models.in_report_order(table))
    if specs:
        fits = [models.fit_model(cohort, s, cfg, age_set=a) for s in specs for a in analysis.age_sets]
        every = reduce(lambda a, b: a.unionByName(b), fits)
        out["res_cox"] = ("", every)
        out["res_cox_report"] = ("", models.report_model(every, cfg.endpoints))
    return _write(out, cfg, base)


def _write(tables: dict[str, tuple[str, DataFrame]], cfg: StudyConfig, base: str) -> dict[str, DataFrame]:
    out = {}
    for kind, (model, df) in tables.items():
        if "model" in df.columns:
            labelled = df.select(F.lit(cfg.data_cut()).alias("datacut"), F.lit(cfg.date_name).alias("date_name"), "*")
        else:
            labelled = label_results(df, cfg.data_cut(), cfg.date_name, model)
        write_results(labelled, f"{base}/results/{kind}")
        out[kind] = labelled
    return out


def run_study(
    spark: SparkSession, tables: dict[str, DataFrame], base: str, cfg: StudyConfig | None = None, tie_break: Sequence[str] = (),
    replicates: int | None = None,
) -> dict[str, dict[str, DataFrame]]:
    """All analyses of the study, one after another."""
    return {
        a.name: run_analysis(spark, tables, a, base, tie_break, replicates) for a in analyses(cfg or StudyConfig())
    }
