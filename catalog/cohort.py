"""Derived covariates, strata, cuts and descriptive tables on the order-level cohort."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.proxies import CASES
from catalog.registry import query
from cohortline.operators import tables
from cohortline.plans import derivation, fixed, models, reports

P2 = CASES.variant(pillar2_only=True)

_STATUS = ["dose_done", "num_doses", "dose_type", "dose_vacc", "vacc_type", "last_vacc2spec", "vaccinated"]


@query("exposure_status", f"SELECT case_id, {', '.join(_STATUS)} FROM status")
def exposure_status(p):
    return derivation.exposure_status(p.cases, CASES).select("case_id", *_STATUS)


@query("time_since_exposure_band", "SELECT case_id, lv2s, dose_lv FROM banded")
def time_since(p):
    return derivation.time_since_exposure_band(derivation.exposure_status(p.cases, CASES)).select("case_id", "lv2s", "dose_lv")


@query("death_endpoint", "SELECT case_id, dead, dead_date FROM derived")
def death_endpoint(p):
    return derivation.death_endpoint(p.cases, CASES).select("case_id", "dead", "dead_date")


@query("prior_infection_order", "SELECT case_id, reinf_vacc_order FROM derived")
def prior_infection_order(p):
    return derivation.prior_infection_order(derivation.exposure_status(p.cases, CASES)).select("case_id", "reinf_vacc_order")


_IDS = list(fixed.STRATIFICATIONS)


@query("stratifications", f"SELECT case_id, Tg, {', '.join(_IDS)} FROM strata")
def strat(p):
    return p.derived.select("case_id", "Tg", *_IDS)


@query(
    "data_cut",
    """SELECT case_id, pillar, omicron4 AS omicron, delta4 AS delta, 'pillar2' AS datacut FROM strata WHERE pillar = 'Pillar 2' AND NHS_nv = 0""",
)
def data_cut(p):
    cut = derivation.select_cut(p.derived, P2)
    return cut.select("case_id", "pillar", "omicron", "delta", F.lit(P2.data_cut()).alias("datacut"))


_KEYS = ["om_vacc3", "om_vacc4", "om_age", "om_age1", "om_age2", "om_age3", "om_dose", "om_dose2"]
_INTER = """
SELECT case_id, CASE WHEN dose_type = 'None' THEN 'Unvaccinated' ELSE omicron || '.' || dose_type END AS om_vacc3, omicron || '.' || dose_type AS om_vacc4,
  CASE WHEN omicron = 0 AND ageband IS NOT NULL THEN 'Delta' ELSE '1.' || ageband END AS om_age,
  CASE WHEN omicron = 0 AND ageband IS NOT NULL THEN 'Delta' WHEN age >= 0 AND age < 10 THEN '1.[0,10)' ELSE '1.' || ageband END AS om_age1,
  CASE WHEN omicron = 0 AND ageband2 BETWEEN 0 AND 80 THEN 'Delta' ELSE omicron || '.' || ageband2 END AS om_age2,
  CASE WHEN omicron = 0 AND ageband IS NOT NULL THEN 'Delta' ELSE '1.' || ageband END AS om_age3,
  CASE WHEN dose_vacc = 'None' AND lv2s = 8 THEN 'Unvaccinated' ELSE omicron || '.' || dose_vacc || '.' || lv2s END AS om_dose,
  CASE WHEN dose_vacc = 'None' THEN 'Unvaccinated' ELSE omicron || '.' || dose_vacc END AS om_dose2
FROM known"""


@query("exposure_interactions", _INTER)
def exposure_interactions(p):
    return p.known.select("case_id", *_KEYS)


_SURV = """
SELECT case_id, e AS endpoint, CAST(CASE WHEN days <= 0 THEN 0.5 ELSE days END AS DOUBLE) AS surv_time, ev AS surv_status
FROM (SELECT case_id, e, ev, CASE WHEN ev = 1 THEN ed ELSE least(last_specimen_date + h, DATE '2001-08-01') END - last_specimen_date AS days
  FROM (SELECT case_id, last_specimen_date, 'hosp' AS e, hosp AS ev, hosp_date AS ed, 60 AS h FROM known
    UNION ALL SELECT case_id, last_specimen_date, 'hospA', hospA, hospA_date, 60 FROM known
    UNION ALL SELECT case_id, last_specimen_date, 'dead', dead, dead_date, 90 FROM known))"""


@query("survival_outcome", _SURV)
def survival_outcome(p):
    return models.stack_endpoints(p.known, ["hosp", "hospA", "dead"], CASES, ["case_id"]).drop("idc")


@query(
    "epidemic_phase_shift",
    """SELECT case_id, ageband1 || '.' || NHSER_name || '.' || ethnicity_group2 || '.' ||
  CAST(last_specimen_date + CASE WHEN hosp = 1 THEN 2 ELSE 0 END AS DATE) || '.' || dose_vacc AS idc FROM known""",
)
def epidemic_phase_shift(p):
    spec = models.BY_NAME["sev_epb2"]
    return models.stack_endpoints(p.known, ["hosp"], CASES, ["case_id"], spec).select("case_id", "idc")


@query(
    "strata_informative",
    """SELECT id15, CAST(sum(omicron) AS BIGINT) AS om, CAST(sum(delta) AS BIGINT) AS dlt, CAST(sum(hosp * omicron) AS BIGINT) AS hosp_om
FROM known GROUP BY id15 HAVING sum(omicron) > 0 AND sum(delta) > 0""",
)
def strata_informative(p):
    base = p.known.withColumns({"om": F.col("omicron"), "dlt": F.col("delta"), "hosp_om": F.col("hosp") * F.col("omicron")})
    return tables.informative_strata(base, ["id15"], ["om", "dlt", "hosp_om"], ("om", "dlt"))


def _retained_sql(where: str) -> str:
    parts = []
    for name, column in fixed.STRATIFICATION_NAMES.items():
        parts.append(
            f"""SELECT '{name}' AS stratification, round(sum(om) FILTER (ok) / sum(om), 6) AS share_om, round(sum(dlt) FILTER (ok) / sum(dlt), 6) AS share_dlt,
  round(coalesce(sum(ho) FILTER (ok), 0) / sum(ho), 6) AS share_hosp_om, round(coalesce(sum(hd) FILTER (ok), 0) / sum(hd), 6) AS share_hosp_dlt
FROM (SELECT *, om > 0 AND dlt > 0 AS ok FROM (SELECT {column}, sum(omicron) AS om, sum(delta) AS dlt, sum(hosp * omicron) AS ho, sum(hosp * delta) AS hd
  FROM known {where} GROUP BY {column}))"""
        )
    text = " UNION ALL ".join(parts)
    return f"""SELECT stratification, coalesce(share_om, 0) AS share_om, coalesce(share_dlt, 0) AS share_dlt, share_hosp_om, share_hosp_dlt FROM ({text})"""


def _retained(df):
    out = tables.retained_share(df, fixed.STRATIFICATION_NAMES, "omicron", "delta", "hosp")
    shares = [c for c in out.columns if c != "stratification"]
    return out.select("stratification", *[F.round(c, 6).alias(c) for c in shares])


@query("retained_share", _retained_sql(""))
def retained_share(p):
    return _retained(p.known)


@query("retained_share_subset", _retained_sql("WHERE ageband1 = 0"))
def retained_share_subset(p):
    return _retained(p.known.where("ageband1 = 0"))


_TABLE_SQL_VARS = {
    "all": "'all'", "ageband": "ageband", "sex": "sex", "reinf": "CAST(reinfection_flag AS VARCHAR)",
    "imd_decile": "CAST(imd_decile AS VARCHAR)", "dose_vacc": "dose_vacc",
    "vacc_reinf": "vaccinated || '.' || reinfection_flag", "dose_lv": "dose_lv",
}
_COUNTS = ", ".join(
    f"count(*) FILTER ({'TRUE' if e == 'case' else f'{e} = 1'} AND omicron = {v}) AS {e}_{lab}"
    for e in fixed.TABLE_ENDPOINTS for v, lab in ((0, "delta"), (1, "omicron"))
)


def _count_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT '{v}' AS variable, {expr} AS level, {_COUNTS} FROM known WHERE {expr} IS NOT NULL GROUP BY {expr}"
        if v != "all" else f"SELECT 'all' AS variable, 'all' AS level, {_COUNTS} FROM known"
        for v, expr in _TABLE_SQL_VARS.items()
    )


_COUNT_COLS = [f"{e}_{lab}" for e in fixed.TABLE_ENDPOINTS for lab in ("delta", "omicron")]
# declared levels appear with zero counts when no record has them
_DECLARED = {"sex": ["Female", "Male", "Other", "Unknown"], "ageband": derivation.band_labels(fixed.AGE_BREAKS)}
_ZERO = " UNION ALL ".join(
    f"SELECT '{v}', '{level}', {', '.join('0' for _ in _COUNT_COLS)}" for v, levels in _DECLARED.items() for level in levels
)
_SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in _COUNT_COLS)


@query(
    "count_table",
    f"""SELECT variable, level, {_SUMS},
  CASE variable WHEN 'all' THEN 'All' WHEN 'reinf' THEN 'Reinfection:' || level WHEN 'imd_decile' THEN 'IMD:' || level ELSE level END AS row_label
FROM ({_count_sql()} UNION ALL {_ZERO}) c GROUP BY variable, level""",
)
def count_table(p):
    return models.exposure_counts(p.known, declared=_DECLARED).withColumn("row_label", models.row_label())


_BANDS = {f"age_{i}": b for i, b in enumerate(derivation.band_labels(fixed.AGE_BREAKS))}
_BAND_SUMS = ", ".join(f"count(*) FILTER (ageband = '{b}') AS {c}" for c, b in _BANDS.items())


@query(
    "count_matrix_by_date",
    " UNION ALL ".join(
        f"SELECT '{v}' AS voc, '{t}' AS type, last_specimen_date AS date, {_BAND_SUMS} FROM {'strata' if v == 'all' else 'known'} WHERE {vc} AND {tc} AND ageband IS NOT NULL GROUP BY last_specimen_date"
        for v, vc in (("all", "TRUE"), ("omicron", "omicron = 1"), ("delta", "delta = 1"))
        for t, tc in (("case", "TRUE"), ("hosp", "hosp = 1"))
    ),
)
def count_matrix(p):
    return reports.counts_by_date(p.derived, _BANDS, p.known)


def _delay_sql(delay: dict[str, str], keep: dict[str, str], groups: dict[str, dict[str, str]]) -> str:
    parts = []
    for e in ("hosp", "hospA"):
        g = groups[e]
        cols = ", ".join(
            f"round({f}, 6) AS {s}_{k}" if s != "n" else f"{f} AS n_{k}"
            for s in ("av", "se", "n")
            for k, cond in g.items()
            for f in [
                {
                    "av": f"avg(dl) FILTER ({cond})",
                    "se": f"stddev_samp(dl) FILTER ({cond}) / sqrt(nullif(count(*) FILTER ({cond}) - 1, 0))",
                    "n": f"nullif(count(*) FILTER ({cond}), 0)",
                }[s]
            ]
        )
        parts.append(f"SELECT ageband1, {cols}, '{e}' AS endpoint FROM (SELECT *, {delay[e]} AS dl FROM known) WHERE {keep[e]} GROUP BY ageband1")
    return " UNION ALL ".join(parts)


_VOC = {"Delta": "omicron = 0", "Omicron": "omicron = 1"}


def _voc_by(e):
    return {f"{k}_{v}": f"{cond} AND {e} = {v}" for k, cond in _VOC.items() for v in (0, 1)}


def _rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if c.startswith(("av_", "se_")) else F.col(c) for c in df.columns])


_ONSET = "last_specimen_date - Onsetdate BETWEEN 0 AND 14 AND reinfection_flag = 0"


@query(
    "delay_onset_to_test",
    _delay_sql(dict.fromkeys(("hosp", "hospA"), "last_specimen_date - Onsetdate"), dict.fromkeys(("hosp", "hospA"), f"{_ONSET}"),
               {e: {k: c for k, c in _voc_by(e).items()} for e in ("hosp", "hospA")}),
)
def delay_onset_to_test(p):
    return _rounded(reports.onset_to_test(p.known))


@query(
    "delay_onset_to_outcome",
    _delay_sql({e: f"{e}_date - Onsetdate" for e in ("hosp", "hospA")}, {e: f"{e} = 1 AND dl IS NOT NULL AND {_ONSET}" for e in ("hosp", "hospA")},
               {e: _VOC for e in ("hosp", "hospA")}),
)
def delay_onset_to_outcome(p):
    return _rounded(reports.onset_to_outcome(p.known))


@query(
    "delay_length_of_stay",
    _delay_sql({e: f"{e}_out_date - {e}_date" for e in ("hosp", "hospA")}, {e: f"{e} = 1 AND dl BETWEEN 0 AND 7" for e in ("hosp", "hospA")},
               {e: _VOC for e in ("hosp", "hospA")}),
)
def delay_length_of_stay(p):
    return _rounded(reports.length_of_stay(p.known))


@query(
    "delay_test_to_outcome",
    _delay_sql({e: f"{e}_date - last_specimen_date" for e in ("hosp", "hospA")}, {e: f"{e} = 1 AND dl IS NOT NULL" for e in ("hosp", "hospA")},
               {e: _VOC for e in ("hosp", "hospA")}),
)
def delay_test_to_outcome(p):
    return _rounded(reports.test_to_outcome(p.known))


@query(
    "level_dimension",
    """SELECT variable, level, CAST(row_number() OVER (PARTITION BY variable ORDER BY is_reference DESC, try_cast(level AS DOUBLE) NULLS LAST, level) AS INT) AS ordinal, is_reference
FROM (SELECT DISTINCT 'dose_vacc' AS variable, dose_vacc AS level, dose_vacc = 'None' AS is_reference FROM known
  UNION ALL SELECT DISTINCT 'imd_decile', CAST(imd_decile AS VARCHAR), FALSE FROM known
  UNION ALL SELECT DISTINCT 'dose_lv', dose_lv, dose_lv = 'Unvaccinated' FROM known)""",
)
def level_dimension(p):
    variables = {v: F.col(v) for v in ("dose_vacc", "imd_decile", "dose_lv")}
    return tables.level_dimension(p.known, variables, reference=fixed.REFERENCE_LEVELS)


@query(
    "crosstab_counts",
    """SELECT CAST(hosp_out_date - hosp_date AS INT) AS los, hospE, count(*) AS n FROM known WHERE hosp_date IS NOT NULL AND hosp_out_date IS NOT NULL GROUP BY 1, 2""",
)
def crosstab_counts(p):
    from cohortline.functions.dates import days_between

    return tables.crosstab(p.known.withColumn("los", days_between("hosp_out_date", "hosp_date")), "los", "hospE")
