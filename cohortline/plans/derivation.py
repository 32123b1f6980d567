"""Filters, covariates, strata and data cuts on the linked table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.config import StudyConfig
from cohortline.functions.dates import days_between, in_lag, shift_days
from cohortline.functions.levels import band, band_floor, band_labels, collapse, interaction, within_band
from cohortline.functions.values import all_of, first_known, flag, masked, null_or, null_or_in
from cohortline.operators.joins import days_since_first
from cohortline.operators.selection import Step, apply_steps, complete_cases
from cohortline.plans import fixed
from cohortline.plans.linkage import use_definition

INDEX = "last_specimen_date"


def with_index_date(linked: DataFrame) -> DataFrame:
    """The analysis date, and dose 1 typed from dose 2 where its own type is missing."""
    return linked.withColumns(
        {
            INDEX: F.col("last_episode_specimen_date"),
            "vacc_dose_1": first_known("vacc_dose_1", "vacc_dose_2"),
        }
    )


def filter_steps(cfg: StudyConfig) -> list[Step]:
    """Study filters in report order."""
    dose3_gap = days_between("date_dose_3", "date_dose_2") >= cfg.min_days_dose2_to_dose3
    return [
        Step("In date range", F.col(INDEX).between(F.lit(cfg.date_start), F.lit(cfg.date_stop))),
        Step(
            "Sex, age, deprivation and ethnicity known",
            complete_cases(["age", "sex", "imd_decile", "ethnicity_final"], {"sex": "Unknown"}),
        ),
        Step("Not a traveller", F.col("traveller") == 0),
        Step("Not dead before the test", null_or("dod", F.col("dod") >= F.col(INDEX))),
        Step("Fewer than four doses", all_of([F.col(f"date_dose_{k}").isNull() for k in (4, 5, 6)])),
        Step("Dose 3 at least 80 days after dose 2", null_or("date_dose_3", dose3_gap)),
        Step(
            "Known products only",
            all_of(
                [
                    null_or_in("vacc_dose_1", fixed.PRIMARY_PRODUCTS),
                    null_or_in("vacc_dose_2", fixed.PRIMARY_PRODUCTS),
                    null_or_in("vacc_dose_3", fixed.BOOSTER_PRODUCTS),
                ]
            ),
        ),
    ]


def ledger_steps(cfg: StudyConfig) -> list[Step]:
    """All steps down to the analysed records: the filters, then selection and exposure."""
    omicron, delta, steps = "omicron", "delta", filter_steps(cfg)
    if cfg.pillar2_only:
        omicron, delta = "omicron4", "delta4"
        steps.append(Step("Pillar 2", F.col("pillar") == "Pillar 2"))
    if cfg.valid_id_only:
        steps.append(Step("Valid identifier", F.col("NHS_nv") == 0))
    return [*steps, Step("Known exposure", (F.col(omicron) == 1) | (F.col(delta) == 1))]


def exposure_status(df: DataFrame, cfg: StudyConfig, index: str = INDEX) -> DataFrame:
    """Vaccination status from the lags of three doses to the index date."""
    effect = cfg.dose_effect_days
    lags = {k: days_between(index, f"date_dose_{k}") for k in (1, 2, 3)}
    # Labels of the two phases after each dose.
    labels = {1: ("D1:<14", "D1:21+"), 2: ("D2:<14", "D2:14+"), 3: ("D3:<14", "D3:14+")}
    done, doses, since = F.lit("None"), F.lit(0), F.lit(0)
    for k, lag in lags.items():
        given = lag >= 0
        early, late = labels[k]
        done = F.when(given, F.when(lag < effect, early).otherwise(late)).otherwise(done)
        doses = F.when(given, k).otherwise(doses)
        since = F.when(given, F.when(lag < effect, -1).otherwise(lag - effect)).otherwise(since)
    out = df.withColumns({f"vacc2spec{k}": lag for k, lag in lags.items()})
    out = out.withColumns({"dose_done": done, "_doses": doses, "_since": since})
    product = F.col("vacc_dose_1")
    kind = F.when(product.isNull() | (F.col("dose_done") == "None"), "None").when(product == "AZ", "AZ").otherwise("PF/MD")
    out = out.withColumn("vacc_type", kind)
    no_type = F.col("vacc_type") == "None"
    out = out.withColumn("num_doses", F.when(no_type, 0).otherwise(F.col("_doses")))
    out = out.withColumns(
        {
            "dose_type": F.when(no_type, "None").otherwise(F.concat_ws(":", "vacc_type", "dose_done")),
            "dose_vacc": F.when(no_type, "None").otherwise(F.concat_ws(":", F.col("vacc_type"), F.col("num_doses").cast("string"))),
            "last_vacc2spec": F.when(no_type, 0).otherwise(F.col("_since")),
            "vaccinated": F.when(F.col("num_doses") == 0, "Unvacc").otherwise("Vacc"),
        }
    )
    return out.drop("_doses", "_since")


def time_since_exposure_band(df: DataFrame) -> DataFrame:
    """Weeks-since-dose band and its product with the dose group."""
    days, doses = F.col("last_vacc2spec"), F.col("num_doses")
    weeks = F.when(days < 0, 0).when(days < 42, 8).otherwise(
        F.least((12 + 4 * F.floor((days - 42) / 28)).cast("int"), F.lit(24))
    )
    capped = F.when(doses.isin(1, 3), F.least(weeks, F.lit(16))).otherwise(weeks)
    out = df.withColumn("lv2s", masked(capped, (doses == 1) & (F.col("vacc_type") == "AZ"), 0))
    key = interaction("dose_vacc", "lv2s")
    return out.withColumn("dose_lv", collapse(key, {"Unvaccinated": ["None.8"]}))


def age_bands(df: DataFrame, age: str = "age") -> DataFrame:
    return df.withColumns(
        {
            "ageband": band(age, fixed.AGE_BREAKS),
            "ageband1": band_floor(age),
            "ageband2": band_floor(age, low_bands=[(5, 0), (10, 5)]),
            "ageband3": band_floor(age, low_bands=[(1, 0), (5, 1), (10, 5)]),
            "ageband4": band_floor(age, low_bands=[(1, 0), (10, 1)]),
        }
    )


def death_endpoint(df: DataFrame, cfg: StudyConfig, index: str = INDEX) -> DataFrame:
    """Death within the window; the lower bound is that of the stay outcomes."""
    lag = days_between("dod", index)
    return df.withColumns(
        {"dead": flag(in_lag(lag, cfg.min_days_to_stay, cfg.max_days_to_death)), "dead_date": F.col("dod")}
    )


def prior_infection_order(df: DataFrame, first: str = "specimen_date") -> DataFrame:
    """Whether an earlier infection came before or after the first dose.

    Unknown when a first dose is dated and the first infection is not.
    """
    before = F.col(first) < F.col("date_dose_1")
    unknown = F.col(first).isNull() & F.col("date_dose_1").isNotNull()
    label = (
        F.when(F.col("reinfection_flag") == 0, "First infection")
        .when(F.col("vaccinated") == "Unvacc", "Prior infection, unvaccinated")
        .when(unknown, F.lit(None))
        .when(before, "Prior infection before dose 1")
        .otherwise("Prior infection after dose 1")
    )
    return df.withColumn("reinf_vacc_order", F.when(F.col("reinfection_flag").isNotNull(), label))


def stratifications(df: DataFrame, specs: Mapping[str, Sequence[str]] = fixed.STRATIFICATIONS) -> DataFrame:
    return df.withColumns({name: interaction(*parts) for name, parts in specs.items()})


def derive(filtered: DataFrame, cfg: StudyConfig) -> DataFrame:
    """All covariates and strata on the filtered table."""
    out = exposure_status(filtered, cfg)
    out = time_since_exposure_band(out)
    out = age_bands(out)
    out = out.withColumn("ethnicity_group2", collapse("ethnicity_final", fixed.ETHNICITY_GROUPS))
    out = death_endpoint(out, cfg)
    out = days_since_first(out, INDEX, "Tg")
    return stratifications(prior_infection_order(out))


def select_cut(derived: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Pillar and identifier selection with the matching exposure definition."""
    out = derived
    if cfg.pillar2_only:
        out = use_definition(out.where(F.col("pillar") == "Pillar 2"), "omicron4", "delta4")
    if cfg.valid_id_only:
        out = out.where(F.col("NHS_nv") == 0)
    return out


def analysis_table(linked: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Linked table to analysis cut: filters, derivations, selection."""
    filtered = apply_steps(with_index_date(linked), filter_steps(cfg))
    return select_cut(derive(filtered, cfg), cfg)


def known_exposure(df: DataFrame) -> DataFrame:
    return df.where((F.col("omicron") == 1) | (F.col("delta") == 1))


def exposure_interactions(df: DataFrame) -> DataFrame:
    """Exposure × vaccination and exposure × age keys, unexposed or unvaccinated collapsed."""
    labels = band_labels(fixed.AGE_BREAKS)
    by_dose_type = interaction("omicron", "dose_type")
    om_age = collapse(interaction("omicron", "ageband"), {"Delta": [f"0.{b}" for b in labels]})
    children = {"1.[0,10)": [f"1.{b}" for b in labels[:3]]}
    floors = [0, 5, *range(10, 90, 10)]
    om_age2 = collapse(interaction("omicron", "ageband2"), {"Delta": [f"0.{b}" for b in floors]})
    by_dose_time = interaction("omicron", "dose_vacc", "lv2s")
    by_dose = interaction("omicron", "dose_vacc")
    return df.withColumns(
        {
            "om_vacc3": collapse(by_dose_type, {"Unvaccinated": ["0.None", "1.None"]}),
            "om_vacc4": by_dose_type,
            "om_age": om_age,
            "om_age3": om_age,
            "om_age1": collapse(om_age, children),
            "om_age2": om_age2,
            "om_dose": collapse(by_dose_time, {"Unvaccinated": ["0.None.8", "1.None.8"]}),
            "om_dose2": collapse(by_dose, {"Unvaccinated": ["0.None", "1.None"]}),
        }
    )


def age_within_band(df: DataFrame, floor_col: str = "ageband1", age: str = "age") -> DataFrame:
    inside = within_band(age, floor_col)
    return df.withColumns(
        {"agebf": F.col(floor_col).cast("string"), "age_ib": inside, "age_ib2": inside * inside}
    )


def survival_columns(
    event: Column, event_date: Column, index: Column, follow_up: int, censor_date
) -> tuple[Column, Column]:
    """(time, event) from index to event, or to the end of follow-up or censoring.

    Event dates are not cut at the censor date; times of zero or less become half a day.
    """
    end = F.least(shift_days(index, follow_up), F.lit(censor_date).cast("date"))
    stop = F.when(event == 1, event_date).otherwise(end)
    days = F.datediff(stop, index).cast("double")
    return F.when(days <= 0, 0.5).otherwise(days), F.coalesce(event, F.lit(0)).cast("int")


def follow_up_days(endpoint: str, cfg: StudyConfig) -> int:
    return cfg.follow_up_days_death if endpoint == "dead" else cfg.follow_up_days


def phase_shifted_date(date: str, event: Column, days: int) -> Column:
    """Index date of event cases moved by ``days``, used to re-stratify only."""
    return masked(date, event == 1, F.date_add(F.col(date), days))
