"""Catalogue of hazard models as data, and the jobs that fit them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.config import StudyConfig
from cohortline.functions.levels import band_labels, collapse, interaction, strip_labels
from cohortline.operators.design import Term, factor, number, term_columns, within
from cohortline.operators.hazard import (
    EPS,
    Patterns,
    collapse_patterns,
    fit_hazards,
    fitted_totals,
    hazard_table,
    side_by_side,
    stacked,
    unstacked,
)
from cohortline.operators.replicates import cells_of, replicate_patterns
from cohortline.operators.tables import count_table, stacked_levels
from cohortline.plans import fixed
from cohortline.plans.derivation import (
    age_within_band,
    exposure_interactions,
    follow_up_days,
    phase_shifted_date,
    survival_columns,
)
from cohortline.sources.storage import cut_lineage

INDEX = "last_specimen_date"
STATUS = within("vaccinated", "reinfection_flag")
DEPRIVATION, SEX, AGE_TREND = factor("imd_decile"), factor("sex"), within("agebf", "age_ib")


@dataclass(frozen=True)
class ModelSpec:
    """One model: exposure, strata and covariates.

    ``fine`` switches age bands and exposure-by-age to the narrow bands, ``rows``
    restricts the records, ``definition`` replaces the working exposure, ``shift``
    moves the index date of event cases when stratifying. ``by_endpoint`` lists
    (model column, pattern) pairs for columns that differ between endpoints.
    """

    name: str
    strata: tuple[str, ...]
    exposure: str = "om_age"
    status: Term = STATUS
    extra: tuple[Term, ...] = ()
    without: tuple[Term, ...] = ()
    fine: bool = False
    rows: str | None = None
    definition: tuple[str, str] | None = None
    shift: int = 0
    by_endpoint: tuple[tuple[str, str], ...] = ()

    def terms(self) -> list[Term]:
        exposure = number("omicron") if self.exposure == "omicron" else factor(self.exposure)
        body = [exposure, self.status, DEPRIVATION, SEX, *self.extra, AGE_TREND]
        # single variables come before products, as the column order decides which of two
        # dependent columns is the redundant one
        return sorted((t for t in body if t not in self.without), key=lambda t: len(t.columns()))


IMPUTED_STATUS = (("reinf_rand_var", "{endpoint}_reinf_rand"),)


def _model_list() -> list[ModelSpec]:
    day, vacc = "Tg", "dose_vacc"
    age, region, group = "ageband1", "NHSER_name", "ethnicity_group2"
    base, with_vacc = tuple(fixed.STRATIFICATIONS["id9"]), tuple(fixed.STRATIFICATIONS["id11"])
    fine, fine_vacc = tuple(fixed.STRATIFICATIONS["id10"]), tuple(fixed.STRATIFICATIONS["id12"])
    dose, dose_group = factor("om_dose"), factor(vacc)
    area, band, ethnic = factor(region), factor("agebf"), factor(group)
    by_dose = within("num_doses", "reinfection_flag")
    plain = number("reinfection_flag")
    return [
        ModelSpec("sev_vacc_noage", base, "omicron", extra=(dose,)),
        ModelSpec("sev_noage", with_vacc, "omicron"),
        ModelSpec("sev_vacc", base, extra=(dose,)),
        ModelSpec("sev_vacc_fs", fine, extra=(dose,), fine=True),
        ModelSpec("sev", with_vacc),
        ModelSpec("sev_fs", fine_vacc, fine=True),
        ModelSpec("sev_utla", tuple(fixed.STRATIFICATIONS["id13"])),
        ModelSpec("sev_ms", (day,), extra=(band, area, dose_group)),
        ModelSpec("sev_area", (age, group, day, vacc), extra=(area,)),
        ModelSpec("sev_age", (region, group, day, vacc), extra=(band,)),
        ModelSpec("sev_eth", (region, age, day, vacc), extra=(ethnic,)),
        ModelSpec("sev_vc", (age, region, group, day), extra=(dose_group,)),
        ModelSpec("sev_sex", (*with_vacc, "sex"), extra=(dose_group,), without=(SEX,)),
        ModelSpec("sev_imd", (*with_vacc, "imd_decile"), extra=(dose_group,), without=(DEPRIVATION,)),
        ModelSpec("sev_reinf_voc", with_vacc, status=factor("reinf_var")),
        ModelSpec("sev_epb1", with_vacc, shift=1),
        ModelSpec("sev_epb2", with_vacc, shift=2),
        ModelSpec("sev_vam", with_vacc, definition=("omicron3", "delta3")),
        ModelSpec("sev_seq", with_vacc, definition=("B11529_conf", "B16172_conf")),
        ModelSpec(
            "sev_vacc_reinf_npR", base, status=within("vaccinated", "reinf_rand_var"), extra=(dose,), by_endpoint=IMPUTED_STATUS
        ),
        ModelSpec("sev_vacc2", base, status=by_dose, extra=(factor("om_dose2"),)),
        ModelSpec("sev_vacc_dose_reinf", base, status=by_dose, extra=(dose,)),
        ModelSpec("sev_unvacc_noage", base, "omicron", status=plain, rows="num_doses = 0"),
        ModelSpec("sev_unvacc", base, status=plain, rows="num_doses = 0"),
        ModelSpec("sev_unvacc_fs", fine, status=plain, rows="num_doses = 0", fine=True),
        ModelSpec("sev_reinfdose", with_vacc, status=by_dose),
        ModelSpec("sev_vacc_reinf_order", base, status=factor("reinf_vacc_order"), extra=(dose,)),
        ModelSpec("sev_vacc_reinfR", base, status=factor("vacc_reinf"), extra=(dose,)),
        ModelSpec("sev_vacc_reinfP", base, status=within("vaccinated", "reinf_pred"), extra=(dose,)),
    ]


MODELS: dict[int, ModelSpec] = dict(enumerate(_model_list(), start=1))
BY_NAME: dict[str, ModelSpec] = {m.name: m for m in MODELS.values()}

# Model sets of the analyses.
MODEL_SETS = {
    "main": [1, 2, 3, 5],
    "sensitivity": [*range(6, 18), 22, 27],
    "unvaccinated": [23, 24],
    "primary": [5],
    "under_ascertainment": [20],
    "genotype_only": [18, 19],
}
AGE_SETS = {"allage": None, "lt10": "age < 10"}


def model_frame(df: DataFrame, spec: ModelSpec, age_set: str = "allage") -> DataFrame:
    """Rows and model variables of one specification."""
    if AGE_SETS[age_set]:
        df = df.where(AGE_SETS[age_set])
    if spec.rows:
        df = df.where(spec.rows)
    if spec.definition:
        om, dlt = spec.definition
        df = df.withColumns({"omicron": F.col(om), "delta": F.col(dlt)})
        df = df.where((F.col("omicron") == 1) | (F.col("delta") == 1))
        df = exposure_interactions(df)
    df = df.withColumn("om_age", F.col("om_age3") if spec.fine else F.col("om_age1"))
    df = age_within_band(df, "ageband3" if spec.fine else "ageband1")
    past = {"No past infection": ["0.0", "0.1"], "Past infection:Delta": ["1.0"], "Past infection:Omicron": ["1.1"]}
    return df.withColumn("reinf_var", collapse(interaction("reinfection_flag", "omicron"), past))


def _stratum(spec: ModelSpec, event: Column) -> Column:
    if not spec.shift:
        return interaction(*spec.strata)
    shifted = phase_shifted_date(INDEX, event, spec.shift)
    return interaction(*[shifted if part == "Tg" else part for part in spec.strata])


def stack_endpoints(
    df: DataFrame, endpoints: Sequence[str], cfg: StudyConfig, keep: Sequence[str | Column], spec: ModelSpec | None = None
) -> DataFrame:
    """One row per record and endpoint with time, event and stratum."""
    lines = []
    for e in endpoints:
        time, event = survival_columns(F.col(e), F.col(f"{e}_date"), F.col(INDEX), follow_up_days(e, cfg), cfg.censor_date)
        stratum = _stratum(spec, F.col(e)) if spec else F.lit("all")
        own = [F.col(pattern.format(endpoint=e)).alias(name) for name, pattern in (spec.by_endpoint if spec else ())]
        lines.append(
            F.struct(F.lit(e).alias("endpoint"), stratum.alias("idc"), time.alias("surv_time"), event.alias("surv_status"), *own)
        )
    return df.select(*keep, F.inline(F.array(*lines)))


def model_patterns(
    df: DataFrame,
    spec: ModelSpec,
    cfg: StudyConfig,
    endpoints: Sequence[str],
    replicate: str | None = None,
    weight: str | None = None,
    age_set: str = "allage",
    **layout,
) -> Patterns:
    """Collapsed patterns of one specification for several endpoints (and replicates)."""
    terms = spec.terms()
    own = [name for name, _ in spec.by_endpoint]
    keep = list(dict.fromkeys([*(c for c in term_columns(terms) if c not in own), *(c for c in (replicate, weight) if c)]))
    stacked = stack_endpoints(model_frame(df, spec, age_set), endpoints, cfg, keep, spec)
    fit = interaction("endpoint", replicate, sep="|") if replicate else F.col("endpoint")
    return collapse_patterns(
        stacked, terms, fit, F.col("idc"), F.col("surv_time"), F.col("surv_status"),
        F.col(weight) if weight else None, fixed.REFERENCE_LEVELS, **layout,
    )


def clean_labels(fits: DataFrame) -> DataFrame:
    """Row labels as reported: exposure prefixes removed."""
    return fits.withColumn("var", strip_labels("term", ["om_dose", "om_age1."]))


def fit_model(
    df: DataFrame, spec: ModelSpec, cfg: StudyConfig, endpoints: Sequence[str] | None = None, age_set: str = "allage", **layout
) -> DataFrame:
    """Coefficient table of one model: (model, endpoint, term, estimate, se, ...)."""
    endpoints = list(endpoints or cfg.endpoints)
    fits = fit_hazards(model_patterns(df, spec, cfg, endpoints, age_set=age_set, **layout), cfg.standard_errors)
    named = clean_labels(fits.withColumnRenamed("fit", "endpoint"))
    return named.select(F.lit(spec.name).alias("model"), F.lit(age_set).alias("agedesc"), "*")


def model_variables(specs: Sequence[ModelSpec], endpoints: Sequence[str]) -> list[str]:
    """Columns of the cohort that any of the models reads."""
    own = {"om_age", "agebf", "age_ib", "reinf_var"}  # made by model_frame
    used = {"age", "ageband", "ageband1", "ageband2", "ageband3", "omicron", "delta", "reinfection_flag", INDEX, *endpoints, *[f"{e}_date" for e in endpoints]}
    for s in specs:
        used |= {*s.strata, *(s.definition or ()), *(["num_doses"] if s.rows else []), *[c for t in s.terms() for c in t.columns()]} - own
    return sorted(used | {"om_age1", "om_age3", "dose_type", "dose_vacc", "lv2s"})


def catalogue_patterns(df: DataFrame, specs: Sequence[ModelSpec], cfg: StudyConfig, endpoints: Sequence[str]) -> dict[str, Patterns]:
    """Patterns of several models, all projected from one table of cells.

    Records equal in every variable that any model reads are one weighted cell, stored once.
    """
    cells = cut_lineage(df.groupBy(*model_variables(specs, endpoints)).agg(F.count(F.lit(1)).alias("_records")))
    return {s.name: model_patterns(cells, s, cfg, endpoints, weight="_records") for s in specs}


def fit_catalogue(df: DataFrame, specs: Sequence[ModelSpec], cfg: StudyConfig, endpoints: Sequence[str] | None = None) -> DataFrame:
    """Fit several models in the same jobs: (model, endpoint, term, estimate, ...)."""
    patterns = catalogue_patterns(df, specs, cfg, list(endpoints or cfg.endpoints))
    fits = unstacked(fit_hazards(stacked(patterns), cfg.standard_errors), patterns)
    return fits.withColumnRenamed("fit", "endpoint")


def event_totals(df: DataFrame, specs: Sequence[ModelSpec], cfg: StudyConfig, endpoints: Sequence[str] | None = None) -> DataFrame:
    """(model, endpoint, term, n_event, expected): what the fitted models expect of each term among the events.

    A fit is right where these equal the sums that the events have (its score equations).
    """
    patterns = catalogue_patterns(df, specs, cfg, list(endpoints or cfg.endpoints))
    every = stacked(patterns)
    totals = unstacked(fitted_totals(every, fit_hazards(every, standard_errors=False)), patterns)
    return totals.withColumnRenamed("fit", "endpoint").select("model", "endpoint", "term", "n_event", "expected")


def report_model(fits: DataFrame, endpoints: Sequence[str]) -> DataFrame:
    """Hazard ratios of all endpoints side by side, numbers and labels."""
    table = hazard_table(fits, fixed.CI_WIDTH)
    return side_by_side(table, ["model", "agedesc", "var"], "endpoint", endpoints, ["mean", "se", "exp_se", "l95", "u95", "label"])


def replicate_fits(
    records: DataFrame, spec: ModelSpec, cfg: StudyConfig, endpoints: Sequence[str], strata: Sequence[str], factors: Mapping, replicates: int,
    tag: str, band: str = "ageband", status: str = "reinfection_flag",
) -> DataFrame:
    """Coefficients of all replicates and endpoints: (endpoint, replicate, var, estimate).

    ``records`` are all whose status is imputed; those outside ``spec.rows`` count there only.
    """
    if spec.definition:
        raise ValueError("the bootstrap keeps the exposure that the status was imputed by")
    imputed = spec.by_endpoint[0][0] if spec.by_endpoint else "_imputed"
    frame = model_frame(records, replace(spec, rows=None))
    columns = {"_fits": F.coalesce(F.expr(spec.rows), F.lit(False)) if spec.rows else F.lit(True)}
    for e in endpoints:
        time, event = survival_columns(F.col(e), F.col(f"{e}_date"), F.col(INDEX), follow_up_days(e, cfg), cfg.censor_date)
        columns |= {f"{e}_time": time, f"{e}_event": event, f"{e}_idc": _stratum(spec, F.col(e))}
    terms = spec.terms()
    cells = cells_of(frame.withColumns(columns), terms, imputed, [*strata, band, status], endpoints, "_fits", tag)
    patterns = replicate_patterns(cells, terms, imputed, strata, endpoints, factors, replicates, band, status, fixed.REFERENCE_LEVELS)
    parts = F.split("fit", r"\|")
    return clean_labels(fit_hazards(patterns, standard_errors=False)).select(
        parts[0].alias("endpoint"), parts[1].cast("int").alias("replicate"), "var", "estimate"
    )


# Variables of the count table, in report order.
TABLE_VARIABLES = ["all", "ageband", "sex", "reinf", "imd_decile", "dose_vacc", "vacc_reinf", "dose_lv"]


def table_variables() -> dict[str, Column]:
    columns = {
        "all": F.lit("all"),
        "reinf": F.col("reinfection_flag"),
        "vacc_reinf": interaction("vaccinated", "reinfection_flag"),
    }
    return {v: columns.get(v, F.col(v)) for v in TABLE_VARIABLES}


def row_label(variable: str = "variable", level: str = "level") -> Column:
    """Row name of the count table: the level, prefixed where it would be ambiguous."""
    v, lv = F.col(variable), F.col(level)
    return (
        F.when(v == "all", "All")
        .when(v == "reinf", F.concat(F.lit("Reinfection:"), lv))
        .when(v == "imd_decile", F.concat(F.lit("IMD:"), lv))
        .otherwise(lv)
    )


def in_report_order(table: DataFrame) -> DataFrame:
    """Rows by variable, then reference level, declared or numeric order, then alphabetically."""
    position = F.array_position(F.array(*[F.lit(v) for v in TABLE_VARIABLES]), F.col("variable"))
    declared = F.array_position(F.array(*[F.lit(b) for b in band_labels(fixed.AGE_BREAKS)]), F.col("level"))
    references = F.array(*[F.lit(r) for r in sorted(set(fixed.REFERENCE_LEVELS.values()))])
    first = F.when(F.array_contains(references, F.col("level")), 0).otherwise(1)
    return table.orderBy(position, first, declared, F.expr("try_cast(level AS double)").asc_nulls_last(), "level")


def table_endpoints(names: Sequence[str] = fixed.TABLE_ENDPOINTS) -> dict[str, Column]:
    return {n: F.lit(True) if n == "case" else F.col(n) == 1 for n in names}


def exposure_counts(df: DataFrame, endpoints: Sequence[str] = fixed.TABLE_ENDPOINTS, declared: Mapping | None = None) -> DataFrame:
    return count_table(df, table_variables(), "omicron", {0: "delta", 1: "omicron"}, table_endpoints(endpoints), declared)


def unadjusted_hazards(
    df: DataFrame, cfg: StudyConfig, endpoints: Sequence[str] | None = None, variables: Mapping[str, Column] | None = None, eps: float = EPS
) -> DataFrame:
    """Unadjusted hazard ratio of the exposure for every level of every variable.

    All (variable, level, endpoint) fits share one collapse and one Newton loop.
    """
    endpoints = list(endpoints or cfg.endpoints)
    variables = variables or table_variables()
    wide = stack_endpoints(df, endpoints, cfg, ["omicron", *[c.cast("string").alias(f"v_{v}") for v, c in variables.items()]])
    stacked = stacked_levels(wide, {v: F.col(f"v_{v}") for v in variables}, ["omicron", "endpoint", "surv_time", "surv_status"])
    fit = F.concat_ws("\u0001", "variable", "level", "endpoint")
    patterns = collapse_patterns(
        stacked, [number("omicron")], fit, F.lit("all"), F.col("surv_time"), F.col("surv_status")
    )
    parts = F.split("fit", "\u0001")
    return fit_hazards(patterns, eps=eps).select(
        parts[0].alias("variable"), parts[1].alias("level"), parts[2].alias("endpoint"), "term", "estimate", "se", "n", "n_event"
    )


def table_with_hazards(
    df: DataFrame, cfg: StudyConfig, endpoints: Sequence[str] | None = None, table_cols: Sequence[str] = fixed.TABLE_ENDPOINTS,
    eps: float = EPS, declared: Mapping | None = None,
) -> DataFrame:
    """Count table with the unadjusted hazard ratio of each row next to it."""
    endpoints = list(endpoints or cfg.endpoints)
    ratios = hazard_table(unadjusted_hazards(df, cfg, endpoints, eps=eps), fixed.CI_WIDTH)
    wide = side_by_side(ratios, ["variable", "level"], "endpoint", endpoints, ["mean", "l95", "u95", "label"])
    counts = exposure_counts(df, table_cols, declared)
    return counts.join(wide, ["variable", "level"], "left")
