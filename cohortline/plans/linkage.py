"""Record linkage: eight record tables to one row per person and latest episode.

Every table is reduced to at most one row per person before it is linked, so all links
share one hash partitioning on the person key. Deaths may repeat and are linked last;
their fields take no part in moving the index date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.config import StudyConfig
from cohortline.functions.dates import days_between, in_lag
from cohortline.functions.values import (
    all_of,
    any_of,
    blank_where,
    clamp_count,
    default_to,
    first_known,
    flag,
    masked,
    recode,
    repaired_interval,
    typed_null,
)
from cohortline.operators.aggregates import collapse_records, latest_event, latest_record, roll_up_outcomes, widen
from cohortline.operators.assays import resolve_conflicts, threshold_call
from cohortline.operators.joins import accept_in_window, link_lookup, link_many, move_to_late_record, recency_flag
from cohortline.plans import fixed

KEY = "finalid"
INDEX = "last_episode_specimen_date"


def prepare_reinfections(records: DataFrame) -> DataFrame:
    pillar = recode("pillar", {fixed.PILLAR_2_SOURCE: "Pillar 2"}, default="Pillar 1")
    return records.withColumn("pillar", pillar)


def prepare_stays(records: DataFrame, cfg: StudyConfig, key: str = "final_id") -> DataFrame:
    """Stay intervals: emergency dates win over inpatient dates; broken intervals drop out."""
    stays = records.select(
        F.col(key).alias(KEY),
        first_known("arrival_date", "spell_start_date").alias("hospital_in"),
        first_known("departure_date", "spell_end_date").alias("hospital_out"),
        F.coalesce(F.col("ecds_discharge").isin(*fixed.ADMITTED_DISCHARGES), F.lit(False)).alias("admitted"),
        F.coalesce(F.col("discharge_destination") == fixed.DIED_DESTINATION, F.lit(False)).alias("died_in_stay"),
        "hospital_event_rank",
    ).where(F.col("hospital_in") >= F.lit(cfg.first_stay_date))
    start, end = repaired_interval("hospital_in", "hospital_out")
    return stays.withColumns({"hospital_in": start, "hospital_out": end}).where(F.col("hospital_in").isNotNull())


def assay_calls(records: DataFrame, cfg: StudyConfig) -> DataFrame:
    """One definitive assay call per person with first and last test date."""
    reliable = records.where(F.col("specimen_date") <= F.lit(cfg.last_assay_date))
    called = threshold_call(reliable, fixed.ASSAY_TARGET, fixed.ASSAY_CONTROLS, fixed.ASSAY_LIMIT)
    return resolve_conflicts(
        called, KEY, "specimen_date", cfg.assay_look_back,
        first="sgtf_first_specimen_date", last="sgtf_last_specimen_date",
    )


def build_episodes(line_list: DataFrame, reinfections: DataFrame, cfg: StudyConfig, tie_break=()) -> DataFrame:
    """Overlay the latest repeat episode on the index record."""
    episodes = reinfections
    if cfg.pillar2_only:
        episodes = episodes.where(F.col("pillar") == "Pillar 2")
    latest = latest_record(
        episodes, KEY, "episode_date",
        {
            INDEX: "episode_date",
            "reinf_pillar": "pillar",
            "reinf_asymptomatic_indicator": "episode_asymptomatic_indicator",
        },
        tie_break, n="num_episodes",
    )
    ll = link_lookup(line_list, latest, KEY)
    count = F.col("num_episodes")
    if cfg.pillar2_only:
        count = masked("num_episodes", F.col("num_episodes").isNotNull() & (F.col("pillar") == "Pillar 1"), count - 1)
    repeated = F.col(INDEX).isNotNull()
    ll = ll.withColumns(
        {
            "num_episodes": F.coalesce(count, F.lit(0)) + 1,
            "pillar": masked("pillar", repeated, F.col("reinf_pillar")),
            "asymptomatic_indicator": masked("asymptomatic_indicator", repeated, F.col("reinf_asymptomatic_indicator")),
            INDEX: first_known(INDEX, "specimen_date"),
        }
    )
    if cfg.pillar2_only:
        ll = ll.where(F.col("pillar") == "Pillar 2")
    too_close = days_between(INDEX, "specimen_date") <= cfg.new_episode_gap
    return ll.withColumns(
        {
            "reinfection_flag": masked(flag(F.col("num_episodes") > 1), too_close, 0),
            "orig_last_episode_specimen_date": F.col(INDEX),
            "vam_sgtf_reinf": F.lit(0),
        }
    )


def link_genotype(ll: DataFrame, genotype: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Genotype calls: late ones open an episode, only those near the index count."""
    calls = genotype.where(F.col("vam_pillar") == "Pillar 2") if cfg.pillar2_only else genotype
    ll = link_lookup(ll, calls, KEY)
    if cfg.add_late_episodes:
        ll = move_to_late_record(
            ll, INDEX, "vam_specimen_date", cfg.new_episode_gap,
            {"reinfection_flag": F.lit(1), "pillar": F.col("vam_pillar"), "vam_sgtf_reinf": F.lit(1)},
        )
    lag = days_between("vam_specimen_date", INDEX)
    ll = ll.withColumn("pillar", masked("pillar", in_lag(lag, 0, cfg.match_window), F.col("vam_pillar")))
    ll = accept_in_window(ll, lag, 0, cfg.match_window, fixed.GENOTYPE_FIELDS)
    return classify_lineage(ll)


def classify_lineage(df: DataFrame) -> DataFrame:
    """0/1 lineage flags from variant and result status."""
    variant, result = F.col("variant"), F.col("seq_result")
    called = result.isin(*fixed.GENOTYPE_RESULTS)
    confirmed = result == fixed.CONFIRMED
    is_delta, is_omicron = variant.isin(*fixed.DELTA_VARIANTS), variant.isin(*fixed.OMICRON_VARIANTS)
    return df.withColumns(
        {
            "B16172": flag(called & is_delta),
            "B11529": flag(called & is_omicron),
            "other_var": flag(called & ~is_delta & ~is_omicron),
            "B16172_conf": flag(confirmed & is_delta),
            "B11529_conf": flag(confirmed & is_omicron),
        }
    )


def link_assay(ll: DataFrame, calls: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Assay calls: a late first test opens an episode and overrides an older genotype."""
    ll = link_lookup(ll, calls, KEY)
    first, last = "sgtf_first_specimen_date", "sgtf_last_specimen_date"
    if cfg.add_late_episodes:
        none = F.lit(None)
        cleared = {f: none for f in fixed.GENOTYPE_FIELDS}
        cleared.update({f: F.lit(0) for f in ("B11529", "B16172", "B11529_conf", "B16172_conf")})
        ll = move_to_late_record(
            ll, INDEX, first, cfg.new_episode_gap,
            {"reinfection_flag": F.lit(1), "pillar": F.lit("Pillar 2"), "vam_sgtf_reinf": F.lit(1), **cleared},
        )
    tested = F.col(first).isNotNull()
    near = in_lag(days_between(first, INDEX), 0, cfg.match_window) | in_lag(days_between(last, INDEX), 0, cfg.match_window)
    far = tested & ~near
    return ll.withColumns(
        {
            "pillar": masked("pillar", tested & near & F.col("vam_pillar").isNull(), "Pillar 2"),
            "spos": blank_where("spos", far),
            "sneg": blank_where("sneg", far),
            last: blank_where(last, far),
        }
    )


def without_assay(ll: DataFrame) -> DataFrame:
    """Typed empty assay columns for genotype-only runs."""
    return ll.withColumns(
        {
            "spos": typed_null("int"),
            "sneg": typed_null("int"),
            "sgtf_first_specimen_date": typed_null("date"),
            "sgtf_last_specimen_date": typed_null("date"),
        }
    )


def combine_classifiers(df: DataFrame) -> DataFrame:
    """Four exposure definitions: combined, assay only, genotype only, pillar-2 hybrid."""
    sneg, spos = F.col("sneg"), F.col("spos")
    no_lineage = (F.col("B11529") == 0) & (F.col("B16172") == 0) & (F.col("other_var") == 0)
    out = df.withColumns(
        {
            "omicron1": flag(((sneg == 1) & (spos == 0) & no_lineage) | (F.col("B11529") == 1)),
            "delta1": flag(((spos == 1) & (sneg == 0) & no_lineage) | (F.col("B16172") == 1)),
            "omicron2": flag(sneg == 1),
            "delta2": flag(spos == 1),
            "omicron3": flag(F.col("B11529") == 1),
            "delta3": flag(F.col("B16172") == 1),
        }
    )
    genotyped = F.col("vam_pillar") == "Pillar 2"
    return out.withColumns(
        {
            "omicron4": F.when(genotyped, F.col("omicron1")).otherwise(F.col("omicron2")),
            "delta4": F.when(genotyped, F.col("delta1")).otherwise(F.col("delta2")),
            "omicron": F.col("omicron1"),
            "delta": F.col("delta1"),
        }
    )


def use_definition(df: DataFrame, omicron: str, delta: str) -> DataFrame:
    """Make another definition the working exposure."""
    return df.withColumns({"omicron": F.col(omicron), "delta": F.col(delta)})


def stay_rules(cfg: StudyConfig) -> dict[str, Column]:
    """Outcome definitions on stay lags; past_hosp is the prior-event flag."""
    adm, dis, los = F.col("sp2adm"), F.col("sp2dis"), F.col("los")
    hosp = in_lag("sp2adm", cfg.min_days_to_stay, cfg.max_days_to_stay)
    hosp1 = in_lag("sp2adm", cfg.min_days_to_stay, cfg.short_days_to_stay)
    hosp2 = hosp & (dis > 0) & (los > 0)
    open_or_later = dis.isNull() | (dis > 0) | ((dis == 0) & (adm == 0))
    admitted_14 = hosp & F.col("admitted")
    died = hosp & F.col("died_in_stay")
    return {
        "hosp": hosp,
        "hosp1": hosp1,
        # no lower bound on purpose: a stay open at the index counts
        "hosp4": in_lag("sp2adm", None, cfg.max_days_to_stay) & open_or_later,
        "hosp2": hosp2,
        "hospE": admitted_14,
        "hospF": hosp1 & F.col("admitted"),
        "hospG": died,
        "hospA": any_of([admitted_14, F.coalesce(hosp2, F.lit(False)), died]),
        "past_hosp": prior_event(cfg),
    }


def prior_event(cfg: StudyConfig) -> Column:
    """Stay that began 1 to 90 days before the index and did not reach it, or is open."""
    began = in_lag("sp2adm", -cfg.prior_stay_days, -1)
    return all_of([began, F.col("sp2dis").isNull() | (F.col("sp2dis") < 0)])


def stay_lags(df: DataFrame, index: str = INDEX) -> DataFrame:
    return df.withColumns(
        {
            "los": days_between("hospital_out", "hospital_in"),
            "sp2adm": days_between("hospital_in", index),
            "sp2dis": days_between("hospital_out", index),
        }
    )


def flag_stays(df: DataFrame, cfg: StudyConfig) -> DataFrame:
    return df.withColumns({name: flag(rule) for name, rule in stay_rules(cfg).items()})


def link_stays(ll: DataFrame, stays: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Per person: whether each outcome was met, earliest dates, mean rank.

    Stays that look alike collapse first, so a person with very many of them meets the
    index with at most one row per distinct stay. The roll-up is per person and index
    date and narrow; the index list then joins it, so no row of the list is lost or merged.
    """
    shapes = collapse_records(stays, [KEY, "hospital_in", "hospital_out", "admitted", "died_in_stay"], "hospital_event_rank")
    index = ll.select(KEY, INDEX).distinct()
    flagged = flag_stays(stay_lags(index.join(shapes, KEY)), cfg)
    rolled = roll_up_outcomes(flagged, [KEY, INDEX], fixed.STAY_OUTCOMES, "hospital_in", "hospital_out", ["past_hosp"])
    same = (F.col(f"l.{KEY}") == F.col(f"r.{KEY}")) & F.col(f"l.{INDEX}").eqNullSafe(F.col(f"r.{INDEX}"))
    out = ll.alias("l").join(rolled.alias("r"), same, "left").select("l.*", *[f"r.{c}" for c in rolled.columns[2:]])
    out = out.withColumns({**{o: clamp_count(o) for o in fixed.STAY_OUTCOMES}, "past_hosp": default_to("past_hosp", 0)})
    return out.where(F.col("past_hosp") == 0) if cfg.drop_prior_stays else out


def censor_after_index(df: DataFrame, numbers=tuple(fixed.DOSE_NUMBERS), index: str = INDEX) -> DataFrame:
    """Blank doses given after the index date."""
    changes = {}
    for k in numbers:
        later = F.col(f"date_dose_{k}") > F.col(index)
        changes[f"vacc_dose_{k}"] = blank_where(f"vacc_dose_{k}", later)
        changes[f"date_dose_{k}"] = blank_where(f"date_dose_{k}", later)
    return df.withColumns(changes)


def link_doses(ll: DataFrame, doses: DataFrame) -> DataFrame:
    wide = widen(doses, KEY, "dose_number", fixed.DOSE_NUMBERS, "date_dose", ["vacc_dose"])
    return censor_after_index(link_lookup(ll, wide, KEY))


def link_travel(ll: DataFrame, travel: DataFrame, cfg: StudyConfig) -> DataFrame:
    known = travel.where(F.col("overall_travel") == "Yes")
    last = latest_event(known, KEY, "travel_specimen_date", "travel_specimen_date")
    return recency_flag(link_lookup(ll, last, KEY), INDEX, "travel_specimen_date", cfg.travel_days, "traveller")


def link_deaths(ll: DataFrame, deaths: DataFrame, on_duplicates: str = "keep") -> DataFrame:
    fields = deaths.select(KEY, "death_type28", "dod", "covidcod")
    out = link_many(ll, fields, KEY, on_duplicates, order=("dod",))
    return out.withColumn("death_type28", default_to("death_type28", 0))


def linked_cohort(tables: dict[str, DataFrame], cfg: StudyConfig, tie_break=(), deaths: str = "keep") -> DataFrame:
    """The whole linkage from typed record tables (see ``sources.records``)."""
    ll = build_episodes(tables["line_list"], prepare_reinfections(tables["reinfections"]), cfg, tie_break)
    ll = link_genotype(ll, tables["genotype"], cfg)
    ll = without_assay(ll) if cfg.genotype_only else link_assay(ll, assay_calls(tables["assay"], cfg), cfg)
    ll = combine_classifiers(ll)
    ll = link_stays(ll, prepare_stays(tables["hospital"], cfg), cfg)
    ll = link_doses(ll, tables["doses"])
    ll = link_travel(ll, tables["travel"], cfg)
    return link_deaths(ll, tables["deaths"], deaths)
