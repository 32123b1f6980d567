"""Joins, per-person aggregates, episodes, calls, stays, doses and the whole linkage."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.proxies import LINK
from catalog.registry import query
from cohortline.functions.dates import days_between
from cohortline.operators import joins
from cohortline.operators.aggregates import (
    collapse_records,
    count_and_latest,
    latest_event,
    latest_record,
    roll_up_outcomes,
    widen,
)
from cohortline.operators.assays import threshold_call
from cohortline.plans import fixed, linkage

P2 = LINK.variant(pillar2_only=True)


def _episodes_sql(pillar2: bool) -> str:
    where = "WHERE pillar = 'Pillar 2'" if pillar2 else ""
    minus = "- CASE WHEN e.n IS NOT NULL AND l.pillar = 'Pillar 1' THEN 1 ELSE 0 END" if pillar2 else ""
    last = "WHERE coalesce(CASE WHEN d IS NOT NULL THEN reinf_pillar ELSE pillar0 END, '') = 'Pillar 2'" if pillar2 else ""
    return f"""
SELECT finalid, specimen_date, Onsetdate, age, sex, imd_decile, ethnicity_final, NHSER_name, UTLA_name, NHS_nv,
  CASE WHEN d IS NOT NULL THEN reinf_pillar ELSE pillar0 END AS pillar,
  CASE WHEN d IS NOT NULL THEN reinf_asym ELSE asym0 END AS asymptomatic_indicator,
  reinf_pillar, reinf_asym AS reinf_asymptomatic_indicator, num_episodes, coalesce(d, specimen_date) AS last_episode_specimen_date,
  CASE WHEN num_episodes > 1 AND NOT coalesce(coalesce(d, specimen_date) - specimen_date <= 90, FALSE) THEN 1 ELSE 0 END AS reinfection_flag,
  coalesce(d, specimen_date) AS orig_last_episode_specimen_date, 0 AS vam_sgtf_reinf
FROM (SELECT l.*, l.pillar AS pillar0, l.asymptomatic_indicator AS asym0, coalesce(e.n {minus}, 0) + 1 AS num_episodes,
    e.episode_date AS d, e.pillar AS reinf_pillar, e.episode_asymptomatic_indicator AS reinf_asym
  FROM line_list l LEFT JOIN (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY finalid) AS n,
      row_number() OVER (PARTITION BY finalid ORDER BY episode_date DESC NULLS LAST, o_orderkey DESC) AS rn FROM reinf {where})
    WHERE rn = 1) e ON l.finalid = e.finalid) {last}"""


_CALLS = """
SELECT finalid, CASE WHEN tn = 0 AND ok THEN 1 ELSE 0 END AS sneg, CASE WHEN tn > 0 AND tn < 30 AND ok THEN 1 ELSE 0 END AS spos, specimen_date
FROM (SELECT *, P2CH3CQ AS tn, (P2CH1CQ > 0 AND P2CH1CQ < 30 AND P2CH2CQ > 0 AND P2CH2CQ < 30) AS ok FROM assay)"""

_RESOLVED = f"""
SELECT finalid, max(spos) AS spos, max(sneg) AS sneg, min(specimen_date) AS sgtf_first_specimen_date, max(specimen_date) AS sgtf_last_specimen_date
FROM (SELECT *, max(specimen_date) OVER (PARTITION BY finalid) AS last_test FROM ({_CALLS}) WHERE specimen_date <= DATE '2001-07-15')
WHERE sneg + spos = 1 AND last_test - specimen_date <= 365 GROUP BY finalid HAVING max(spos) + max(sneg) = 1"""

_LINEAGE = """
  CASE WHEN seq_result IN ('Confirmed', 'Provisional genotyping') AND variant IN ('VOC-21APR-02', 'VUI-21OCT-01') THEN 1 ELSE 0 END AS B16172,
  CASE WHEN seq_result IN ('Confirmed', 'Provisional genotyping') AND variant = 'VOC-21NOV-01' THEN 1 ELSE 0 END AS B11529,
  CASE WHEN seq_result IN ('Confirmed', 'Provisional genotyping') AND variant NOT IN ('VOC-21APR-02', 'VUI-21OCT-01', 'VOC-21NOV-01') THEN 1 ELSE 0 END AS other_var,
  CASE WHEN seq_result = 'Confirmed' AND variant IN ('VOC-21APR-02', 'VUI-21OCT-01') THEN 1 ELSE 0 END AS B16172_conf,
  CASE WHEN seq_result = 'Confirmed' AND variant = 'VOC-21NOV-01' THEN 1 ELSE 0 END AS B11529_conf"""


def _flags_sql(source: str, index: str) -> str:
    return f"""
SELECT *, CASE WHEN h AND a THEN 1 ELSE 0 END AS hospE, CASE WHEN h1 AND a THEN 1 ELSE 0 END AS hospF,
  CASE WHEN h AND g THEN 1 ELSE 0 END AS hospG, CASE WHEN h AND (a OR g OR (dis > 0 AND los > 0)) THEN 1 ELSE 0 END AS hospA,
  CASE WHEN h THEN 1 ELSE 0 END AS hosp, CASE WHEN h1 THEN 1 ELSE 0 END AS hosp1,
  CASE WHEN h AND dis > 0 AND los > 0 THEN 1 ELSE 0 END AS hosp2,
  CASE WHEN adm <= 14 AND (dis IS NULL OR dis > 0 OR (dis = 0 AND adm = 0)) THEN 1 ELSE 0 END AS hosp4,
  CASE WHEN adm BETWEEN -90 AND -1 AND (dis IS NULL OR dis < 0) THEN 1 ELSE 0 END AS past_hosp
FROM (SELECT s.*, hospital_in - {index} AS adm, hospital_out - {index} AS dis, hospital_out - hospital_in AS los,
    coalesce(hospital_in - {index} BETWEEN 0 AND 14, FALSE) AS h, coalesce(hospital_in - {index} BETWEEN 0 AND 7, FALSE) AS h1,
    admitted AS a, died_in_stay AS g FROM {source} s)"""


_OUT = fixed.STAY_OUTCOMES
_ROLL = (
    "SELECT finalid, "
    + ", ".join(
        f"CAST(sum({o}) AS BIGINT) AS {o}, min(hospital_in) FILTER ({o} = 1) AS {o}_date, min(hospital_out) FILTER ({o} = 1) AS {o}_out_date"
        for o in _OUT
    )
    + ", CAST(sum(past_hosp) AS BIGINT) AS past_hosp, avg(hospital_event_rank) AS hosp_rank FROM ({src}) WHERE "
    + " OR ".join(f"{o} = 1" for o in [*_OUT, "past_hosp"])
    + " GROUP BY finalid"
)


@query(
    "link_lookup_left",
    """SELECT l.finalid, sex, vam_specimen_date, variant FROM line_list l LEFT JOIN genotype g ON l.finalid = g.finalid""",
)
def link_lookup_left(p):
    g = p.genotype.select("finalid", "vam_specimen_date", "variant")
    return joins.link_lookup(p.line_list.select("finalid", "sex"), g, "finalid")


@query(
    "link_fanout_guard",
    """SELECT l.finalid, sex, dod, covidcod, coalesce(death_type28, 0) AS death_type28 FROM line_list l LEFT JOIN deaths_all d ON l.finalid = d.finalid""",
)
def link_fanout_guard(p):
    return linkage.link_deaths(p.line_list.select("finalid", "sex"), p.deaths_all)


@query(
    "link_first_match",
    """SELECT l.finalid, d.dod, d.covidcod, coalesce(d.death_type28, 0) AS death_type28 FROM line_list l LEFT JOIN
(SELECT *, row_number() OVER (PARTITION BY finalid ORDER BY dod, death_type28, covidcod) AS rn FROM deaths_all) d ON l.finalid = d.finalid AND d.rn = 1""",
)
def link_first_match(p):
    return linkage.link_deaths(p.line_list.select("finalid"), p.deaths_all, "first")


@query(
    "group_stat_to_rows",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_custkey, max(l_shipdate) OVER (PARTITION BY o_custkey) AS last_test,
  count(*) OVER (PARTITION BY o_custkey) AS n_tests FROM lines""",
)
def group_stat_to_rows(p):
    rows = p.person_lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "o_custkey", "l_shipdate")
    return joins.add_group_stats(rows, ["o_custkey"], [F.max("l_shipdate").alias("last_test")], n="n_tests").drop("l_shipdate")


@query(
    "link_one_to_many",
    """SELECT l.finalid, l.specimen_date, hospital_in, hospital_out FROM line_list l JOIN stay s ON l.finalid = s.finalid WHERE hospital_in IS NOT NULL""",
)
def link_one_to_many(p):
    events = p.stay.select(F.col("finalid").alias("final_id"), "hospital_in", "hospital_out")
    return joins.link_events(p.line_list.select("finalid", "specimen_date"), events, "finalid", "final_id", "hospital_in")


@query(
    "window_match",
    """SELECT l.finalid, CASE WHEN ok THEN variant END AS variant, CASE WHEN ok THEN vam_specimen_date END AS vam_specimen_date
FROM (SELECT c.case_id AS finalid, g.variant, g.vam_specimen_date, g.vam_specimen_date - c.last_specimen_date BETWEEN 0 AND 14 AS ok
  FROM cases c LEFT JOIN genotype g ON c.finalid = g.finalid) l""",
)
def window_match(p):
    g = p.genotype.select("finalid", "variant", "vam_specimen_date")
    linked = p.cases.select("case_id", "finalid", "last_specimen_date").join(g, "finalid", "left")
    lag = days_between("vam_specimen_date", "last_specimen_date")
    out = joins.accept_in_window(linked, lag, 0, LINK.match_window, ["variant", "vam_specimen_date"])
    return out.select(F.col("case_id").alias("finalid"), "variant", "vam_specimen_date")


@query(
    "late_record_new_episode",
    """SELECT l.finalid, CASE WHEN g.vam_specimen_date - specimen_date > 90 THEN g.vam_specimen_date ELSE specimen_date END AS index_date,
  CASE WHEN g.vam_specimen_date - specimen_date > 90 THEN 1 ELSE 0 END AS reinfection_flag,
  CASE WHEN g.vam_specimen_date - specimen_date > 90 THEN vam_pillar ELSE pillar END AS pillar
FROM line_list l LEFT JOIN genotype g ON l.finalid = g.finalid""",
)
def late_record_new_episode(p):
    g = p.genotype.select("finalid", "vam_specimen_date", "vam_pillar")
    linked = joins.link_lookup(p.line_list.select("finalid", "specimen_date", "pillar"), g, "finalid").select(
        "finalid", F.col("specimen_date").alias("index_date"), "pillar", "vam_specimen_date", "vam_pillar",
        F.lit(0).alias("reinfection_flag"),
    )
    out = joins.move_to_late_record(
        linked, "index_date", "vam_specimen_date", LINK.new_episode_gap,
        {"reinfection_flag": F.lit(1), "pillar": F.col("vam_pillar")},
    )
    return out.select("finalid", "index_date", "reinfection_flag", "pillar")


@query(
    "stay_window_match",
    """SELECT l.finalid, l.specimen_date, hospital_in, hospital_out, CAST(hospital_in - l.specimen_date AS INT) AS sp2adm
FROM line_list l JOIN stay s ON l.finalid = s.finalid
WHERE hospital_in - l.specimen_date BETWEEN -90 AND 14 AND NOT (hospital_in - l.specimen_date < 0 AND hospital_out - l.specimen_date = 0)""",
)
def stay_window_match(p):
    matched = joins.link_events_within(
        p.line_list.select("finalid", "specimen_date"), p.stay.select("finalid", "hospital_in", "hospital_out"),
        "finalid", "finalid", "specimen_date", "hospital_in", -LINK.prior_stay_days, LINK.max_days_to_stay,
    )
    lagged = linkage.stay_lags(matched, "specimen_date")
    keep = ~((F.col("sp2adm") < 0) & (F.col("sp2dis") == 0))
    return lagged.where(keep).select("finalid", "specimen_date", "hospital_in", "hospital_out", "sp2adm")


@query(
    "recency_flag",
    """SELECT l.finalid, t.d AS travel_specimen_date, CASE WHEN specimen_date - t.d < 14 THEN 1 ELSE 0 END AS traveller
FROM line_list l LEFT JOIN (SELECT finalid, max(travel_specimen_date) AS d FROM travel WHERE overall_travel = 'Yes' GROUP BY 1) t
  ON l.finalid = t.finalid""",
)
def recency(p):
    index = p.line_list.select("finalid", F.col("specimen_date").alias(linkage.INDEX))
    return linkage.link_travel(index, p.travel, LINK).drop(linkage.INDEX)


_SHARES = ", ".join(f"('{b}', {v})" for b, v in zip(
    ["[0,1)", "[1,5)", "[5,10)", "[10,20)", "[20,30)", "[30,40)", "[40,50)", "[50,60)", "[60,70)", "[70,80)", "[80,Inf]"], fixed.REPORTED_SHARE))


@query("level_lookup", f"SELECT case_id, CAST(v.s AS DOUBLE) AS prop_rep FROM banded LEFT JOIN (VALUES {_SHARES}) v(b, s) ON ageband = v.b")
def level_lookup(p):
    from cohortline.functions.levels import band, band_labels

    values = dict(zip(band_labels(fixed.AGE_BREAKS), fixed.REPORTED_SHARE))
    banded = p.cases.select("case_id", band("age", fixed.AGE_BREAKS).alias("ageband"))
    return joins.level_lookup(banded, "ageband", values, "prop_rep").select("case_id", "prop_rep")


@query("calendar_offset", "SELECT o_orderkey, CAST(o_orderdate - (SELECT min(o_orderdate) FROM ord) AS INT) AS Tg FROM ord")
def calendar_offset(p):
    return joins.days_since_first(p.orders.select("o_orderkey", "o_orderdate"), "o_orderdate", "Tg").drop("o_orderdate")


@query("agg_count_max", "SELECT user_id, count(*) AS n, max(ts) AS latest FROM events GROUP BY user_id")
def agg_count_max(p):
    return count_and_latest(p.table("events"), "user_id", "ts")


@query(
    "agg_sum_min_max",
    """SELECT finalid, CAST(sum(CASE WHEN admitted THEN 1 ELSE 0 END) AS BIGINT) AS n_admitted, min(hospital_in) AS first_in, max(hospital_in) AS last_in
FROM stay GROUP BY finalid""",
)
def agg_sum_min_max(p):
    return p.stay.groupBy("finalid").agg(
        F.sum(F.col("admitted").cast("int")).alias("n_admitted"), F.min("hospital_in").alias("first_in"), F.max("hospital_in").alias("last_in")
    )


@query("agg_latest", "SELECT finalid, max(travel_specimen_date) AS last_travel FROM travel WHERE overall_travel = 'Yes' GROUP BY finalid")
def agg_latest(p):
    return latest_event(p.travel.where("overall_travel = 'Yes'"), "finalid", "travel_specimen_date", "last_travel")


@query(
    "latest_record_per_key",
    """SELECT finalid, n, episode_date AS last_date, pillar AS last_pillar FROM (SELECT *, count(*) OVER (PARTITION BY finalid) AS n,
  row_number() OVER (PARTITION BY finalid ORDER BY episode_date DESC NULLS LAST, o_orderkey DESC) AS rn FROM reinf_raw) WHERE rn = 1""",
)
def latest_record_per_key(p):
    return latest_record(p.reinfections, "finalid", "episode_date", {"last_date": "episode_date", "last_pillar": "pillar"}, ["o_orderkey"])


@query("outcome_rollup", _ROLL.format(src=_flags_sql("stay", "order_date")))
def outcome_rollup(p):
    flagged = linkage.flag_stays(linkage.stay_lags(p.stay, "order_date"), LINK)
    keys = ["finalid", "hospital_in", "hospital_out", *_OUT, "past_hosp"]
    shapes = collapse_records(flagged, keys, "hospital_event_rank")
    return roll_up_outcomes(shapes, "finalid", _OUT, "hospital_in", "hospital_out", ["past_hosp"])


@query(
    "pivot_long_to_wide",
    "SELECT finalid, "
    + ", ".join(f"min(vacc_dose) FILTER (dose_number = {k} AND r = 1) AS vacc_dose_{k}" for k in fixed.DOSE_NUMBERS)
    + ", "
    + ", ".join(f"min(date_dose) FILTER (dose_number = {k} AND r = 1) AS date_dose_{k}" for k in fixed.DOSE_NUMBERS)
    + """ FROM (SELECT *, row_number() OVER (PARTITION BY finalid, dose_number ORDER BY date_dose NULLS LAST, vacc_dose) AS r FROM order_doses)
GROUP BY finalid""",
)
def pivot_long_to_wide(p):
    return widen(p.order_doses, "finalid", "dose_number", fixed.DOSE_NUMBERS, "date_dose", ["vacc_dose"])


@query("threshold_call", _CALLS)
def threshold(p):
    called = threshold_call(p.assay, fixed.ASSAY_TARGET, fixed.ASSAY_CONTROLS, fixed.ASSAY_LIMIT)
    return called.select("finalid", "sneg", "spos", "specimen_date")


@query("resolve_conflicts", _RESOLVED)
def conflicts(p):
    return linkage.assay_calls(p.assay, LINK)


@query("build_episodes", _episodes_sql(False))
def episodes(p):
    return linkage.build_episodes(p.line_list, linkage.prepare_reinfections(p.reinfections), LINK, ["o_orderkey"])


@query("build_episodes_subset", _episodes_sql(True))
def episodes_subset(p):
    return linkage.build_episodes(p.line_list, linkage.prepare_reinfections(p.reinfections), P2, ["o_orderkey"])


@query("classify_lineage", f"SELECT finalid, {_LINEAGE} FROM genotype")
def lineage(p):
    return linkage.classify_lineage(p.genotype).select("finalid", "B16172", "B11529", "other_var", "B16172_conf", "B11529_conf")


_DEFS = """
  CASE WHEN (sneg = 1 AND spos = 0 AND B11529 = 0 AND B16172 = 0 AND other_var = 0) OR B11529 = 1 THEN 1 ELSE 0 END AS omicron1,
  CASE WHEN (spos = 1 AND sneg = 0 AND B11529 = 0 AND B16172 = 0 AND other_var = 0) OR B16172 = 1 THEN 1 ELSE 0 END AS delta1,
  CASE WHEN sneg = 1 THEN 1 ELSE 0 END AS omicron2, CASE WHEN spos = 1 THEN 1 ELSE 0 END AS delta2,
  CASE WHEN B11529 = 1 THEN 1 ELSE 0 END AS omicron3, CASE WHEN B16172 = 1 THEN 1 ELSE 0 END AS delta3"""
_DEFS4 = """
  CASE WHEN vam_pillar = 'Pillar 2' THEN omicron1 ELSE omicron2 END AS omicron4,
  CASE WHEN vam_pillar = 'Pillar 2' THEN delta1 ELSE delta2 END AS delta4, omicron1 AS omicron, delta1 AS delta"""
_CLASSES = [f"{v}{i}" for i in (1, 2, 3, 4) for v in ("omicron", "delta")] + ["omicron", "delta"]


@query(
    "combine_classifiers",
    f"""SELECT finalid, {', '.join(_CLASSES)} FROM (SELECT *, {_DEFS4} FROM (SELECT *, {_DEFS} FROM (SELECT l.finalid, g.vam_pillar, {_LINEAGE}, sneg, spos
FROM line_list l LEFT JOIN genotype g ON l.finalid = g.finalid LEFT JOIN ({_RESOLVED}) a ON l.finalid = a.finalid)))""",
)
def classifiers(p):
    ll = joins.link_lookup(p.line_list.select("finalid"), p.genotype, "finalid")
    ll = joins.link_lookup(linkage.classify_lineage(ll), linkage.assay_calls(p.assay, LINK), "finalid")
    return linkage.combine_classifiers(ll).select("finalid", *_CLASSES)


@query(
    "variant_call_single_source",
    f"""SELECT finalid, {', '.join(_CLASSES)}, spos, sneg FROM (SELECT *, {_DEFS4} FROM (SELECT *, {_DEFS} FROM (SELECT l.finalid, g.vam_pillar, {_LINEAGE},
  CAST(NULL AS INT) AS sneg, CAST(NULL AS INT) AS spos FROM line_list l LEFT JOIN genotype g ON l.finalid = g.finalid)))""",
)
def single_source(p):
    ll = joins.link_lookup(p.line_list.select("finalid"), p.genotype, "finalid")
    ll = linkage.without_assay(linkage.classify_lineage(ll))
    return linkage.combine_classifiers(ll).select("finalid", *_CLASSES, "spos", "sneg")


@query(
    "outcome_flags",
    f"SELECT finalid, order_date, hospital_in, hospital_out, hospital_event_rank, {', '.join(_OUT)} FROM ({_flags_sql('stay', 'order_date')})",
)
def outcome_flags(p):
    flagged = linkage.flag_stays(linkage.stay_lags(p.stay, "order_date"), LINK)
    return flagged.select("finalid", "order_date", "hospital_in", "hospital_out", "hospital_event_rank", *_OUT)


@query(
    "prior_event_flag",
    f"SELECT finalid, order_date, hospital_in, hospital_out, hospital_event_rank, past_hosp FROM ({_flags_sql('stay', 'order_date')})",
)
def prior_event_flag(p):
    flagged = linkage.flag_stays(linkage.stay_lags(p.stay, "order_date"), LINK)
    return flagged.select("finalid", "order_date", "hospital_in", "hospital_out", "hospital_event_rank", "past_hosp")


_DOSE_COLS = ", ".join(
    f"min(vacc_dose) FILTER (dose_number = {k} AND r = 1) AS vd{k}, min(date_dose) FILTER (dose_number = {k} AND r = 1) AS dd{k}"
    for k in fixed.DOSE_NUMBERS
)
_DOSE_WIDE = f"""SELECT finalid, {_DOSE_COLS} FROM (SELECT *, row_number() OVER (PARTITION BY finalid, dose_number
  ORDER BY date_dose NULLS LAST, vacc_dose) AS r FROM doses) GROUP BY finalid"""


def _censored(index: str) -> str:
    return ", ".join(
        f"CASE WHEN dd{k} > {index} THEN NULL ELSE vd{k} END AS vacc_dose_{k}, CASE WHEN dd{k} > {index} THEN NULL ELSE dd{k} END AS date_dose_{k}"
        for k in fixed.DOSE_NUMBERS
    )


@query(
    "censor_after_index",
    f"SELECT l.finalid, specimen_date, {_censored('specimen_date')} FROM line_list l LEFT JOIN ({_DOSE_WIDE}) d ON l.finalid = d.finalid",
)
def censor(p):
    index = p.line_list.select("finalid", F.col("specimen_date").alias(linkage.INDEX))
    return linkage.link_doses(index, p.doses).withColumnRenamed(linkage.INDEX, "specimen_date")


def _linked_ctes(pillar2: bool, genotype_only: bool = False) -> str:
    """The linkage as a chain of table expressions, written independently of the DataFrame plan."""
    g_filter = "WHERE vam_pillar = 'Pillar 2'" if pillar2 else ""
    calls = _RESOLVED if not genotype_only else (
        "SELECT CAST(NULL AS BIGINT) AS finalid, CAST(NULL AS INT) AS spos, CAST(NULL AS INT) AS sneg, "
        "CAST(NULL AS DATE) AS sgtf_first_specimen_date, CAST(NULL AS DATE) AS sgtf_last_specimen_date"
    )
    return f"""WITH ep AS ({_episodes_sql(pillar2)}),
g1 AS (SELECT ep.*, g.variant AS va, g.variant_alt_name AS van, g.seq_result AS sr, g.vam_specimen_date AS vd, g.vam_pillar AS vp,
  coalesce(g.vam_specimen_date - last_episode_specimen_date > 90, FALSE) AS late
  FROM ep LEFT JOIN (SELECT * FROM genotype {g_filter}) g ON ep.finalid = g.finalid),
g2 AS (SELECT * EXCLUDE (late) REPLACE (CASE WHEN late THEN vd ELSE last_episode_specimen_date END AS last_episode_specimen_date,
  CASE WHEN late THEN 1 ELSE reinfection_flag END AS reinfection_flag, CASE WHEN late THEN 1 ELSE vam_sgtf_reinf END AS vam_sgtf_reinf) FROM g1),
g3 AS (SELECT *, coalesce(vd - last_episode_specimen_date BETWEEN 0 AND 14, FALSE) AS near FROM g2),
g4 AS (SELECT * EXCLUDE (va, van, sr, vd, vp, near) REPLACE (CASE WHEN near THEN vp ELSE pillar END AS pillar),
  CASE WHEN near THEN va END AS variant, CASE WHEN near THEN van END AS variant_alt_name, CASE WHEN near THEN sr END AS seq_result,
  CASE WHEN near THEN vd END AS vam_specimen_date, CASE WHEN near THEN vp END AS vam_pillar FROM g3),
g5 AS (SELECT *, {_LINEAGE} FROM g4),
calls AS ({calls}),
a1 AS (SELECT g5.*, a.* EXCLUDE (finalid), coalesce(a.sgtf_first_specimen_date - last_episode_specimen_date > 90, FALSE) AS late
  FROM g5 LEFT JOIN calls a ON g5.finalid = a.finalid),
a2 AS (SELECT * EXCLUDE (late) REPLACE (
  CASE WHEN late THEN sgtf_first_specimen_date ELSE last_episode_specimen_date END AS last_episode_specimen_date,
  CASE WHEN late THEN 1 ELSE reinfection_flag END AS reinfection_flag, CASE WHEN late THEN 1 ELSE vam_sgtf_reinf END AS vam_sgtf_reinf,
  CASE WHEN late THEN 'Pillar 2' ELSE pillar END AS pillar, CASE WHEN late THEN NULL ELSE variant END AS variant,
  CASE WHEN late THEN NULL ELSE variant_alt_name END AS variant_alt_name, CASE WHEN late THEN NULL ELSE seq_result END AS seq_result,
  CASE WHEN late THEN NULL ELSE vam_specimen_date END AS vam_specimen_date, CASE WHEN late THEN NULL ELSE vam_pillar END AS vam_pillar,
  CASE WHEN late THEN 0 ELSE B11529 END AS B11529, CASE WHEN late THEN 0 ELSE B16172 END AS B16172,
  CASE WHEN late THEN 0 ELSE B11529_conf END AS B11529_conf, CASE WHEN late THEN 0 ELSE B16172_conf END AS B16172_conf) FROM a1),
a3 AS (SELECT *, sgtf_first_specimen_date IS NOT NULL AS tested, sgtf_first_specimen_date - last_episode_specimen_date BETWEEN 0 AND 14
  OR sgtf_last_specimen_date - last_episode_specimen_date BETWEEN 0 AND 14 AS near FROM a2),
a4 AS (SELECT * EXCLUDE (tested, near) REPLACE (CASE WHEN tested AND near AND vam_pillar IS NULL THEN 'Pillar 2' ELSE pillar END AS pillar,
  CASE WHEN tested AND NOT near THEN NULL ELSE spos END AS spos, CASE WHEN tested AND NOT near THEN NULL ELSE sneg END AS sneg,
  CASE WHEN tested AND NOT near THEN NULL ELSE sgtf_last_specimen_date END AS sgtf_last_specimen_date) FROM a3),
v AS (SELECT *, {_DEFS4} FROM (SELECT *, {_DEFS} FROM a4)),
hs AS (SELECT v.finalid, v.last_episode_specimen_date AS ix, a AS hospital_in, b AS hospital_out,
    ecds_discharge IN ('Admitted', 'Transfer', 'Died') AS admitted, discharge_destination = 79 AS died_in_stay, hospital_event_rank
  FROM v JOIN (SELECT *, coalesce(arrival_date, spell_start_date) AS a, coalesce(departure_date, spell_end_date) AS b FROM hospital) h
    ON v.finalid = h.final_id WHERE a >= DATE '1995-06-01' AND NOT coalesce(b < a, FALSE)),
st AS ({_ROLL.format(src=_flags_sql('hs', 'ix'))}),
tr AS (SELECT finalid, max(travel_specimen_date) AS travel_specimen_date FROM travel WHERE overall_travel = 'Yes' GROUP BY 1),
linked AS (SELECT v.*, {', '.join(f'CASE WHEN st.{o} > 0 THEN 1 ELSE 0 END AS {o}' for o in _OUT)},
  {', '.join(f'st.{o}_date, st.{o}_out_date' for o in _OUT)}, coalesce(st.past_hosp, 0) AS past_hosp, st.hosp_rank,
  {_censored('v.last_episode_specimen_date')}, tr.travel_specimen_date,
  CASE WHEN v.last_episode_specimen_date - tr.travel_specimen_date < 14 THEN 1 ELSE 0 END AS traveller,
  coalesce(dt.death_type28, 0) AS death_type28, dt.dod, dt.covidcod
  FROM v LEFT JOIN st ON v.finalid = st.finalid LEFT JOIN ({_DOSE_WIDE}) dw ON v.finalid = dw.finalid
  LEFT JOIN tr ON v.finalid = tr.finalid LEFT JOIN deaths dt ON v.finalid = dt.finalid)
"""


@query("linked_cohort", _linked_ctes(False) + "SELECT * FROM linked")
def linked(p):
    return linkage.linked_cohort(p.linkage_tables(), LINK, ["o_orderkey"])


@query("linked_cohort_pillar2", _linked_ctes(True) + "SELECT * FROM linked WHERE past_hosp = 0")
def linked_pillar2(p):
    return linkage.linked_cohort(p.linkage_tables(), P2.variant(drop_prior_stays=True), ["o_orderkey"])


@query("linked_cohort_genotype_only", _linked_ctes(False, True) + "SELECT * FROM linked")
def linked_genotype(p):
    return linkage.linked_cohort(p.linkage_tables(), LINK.variant(genotype_only=True), ["o_orderkey"])


@query(
    "flagship",
    _linked_ctes(False)
    + """SELECT ageband, omicron, count(*) AS n_cases, CAST(sum(hosp) AS BIGINT) AS n_hosp, CAST(sum(hospA) AS BIGINT) AS n_admitted, min(hosp_date) AS first_stay
FROM (SELECT *, CASE WHEN age < 0 THEN NULL WHEN age < 1 THEN '[0,1)' WHEN age < 5 THEN '[1,5)' WHEN age < 10 THEN '[5,10)' WHEN age < 80
  THEN '[' || CAST(floor(age / 10) * 10 AS INT) || ',' || CAST(floor(age / 10) * 10 + 10 AS INT) || ')' ELSE '[80,Inf]' END AS ageband FROM linked)
GROUP BY ageband, omicron""",
)
def flagship(p):
    """How many index cases, by age band and exposure, had a stay within the window?"""
    from cohortline.plans.derivation import age_bands

    cohort = age_bands(linkage.linked_cohort(p.linkage_tables(), LINK, ["o_orderkey"]))
    return cohort.groupBy("ageband", "omicron").agg(
        F.count(F.lit(1)).alias("n_cases"), F.sum("hosp").alias("n_hosp"), F.sum("hospA").alias("n_admitted"),
        F.min("hosp_date").alias("first_stay"),
    )
