"""Resampling, imputation, hazard and binomial models."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.proxies import CASES
from catalog.registry import query
from cohortline.functions.levels import interaction
from cohortline.functions.randomness import poisson_thresholds, uniform
from cohortline.operators import resampling
from cohortline.operators.design import design_matrix, factor, factor_levels, number, within
from cohortline.operators.hazard import collapse_patterns, fit_hazards, score_test, side_by_side
from cohortline.operators.logistic import fit_binomial, predict, roc_auc, term_totals
from cohortline.operators.tables import stacked_levels
from cohortline.plans import ascertainment, fixed, models

ENDPOINTS = ["hosp", "hosp4", "hospA", "dead"]
TIGHT = 1e-13
BOOT = 20


def _u(tag: str, *keys: str) -> str:
    """SQL twin of the key-hashed uniform."""
    text = ", ".join([f"'{tag}'", *[f"CAST({k} AS VARCHAR)" for k in keys]])
    return f"((('0x' || substr(md5(concat_ws('|', {text})), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)"


def _poisson(u: str) -> str:
    edges = poisson_thresholds()
    return "CASE " + " ".join(f"WHEN {u} < {e!r} THEN {k}" for k, e in enumerate(edges)) + f" ELSE {len(edges)} END"


@query(
    "bootstrap_exact",
    f"""WITH ix AS (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey) - 1 AS i FROM ord),
dr AS (SELECT CAST(floor({_u('boot', 'i', '7')} * (SELECT count(*) FROM ord)) AS BIGINT) AS j FROM ix)
SELECT o_orderkey, o_custkey, CAST(row_number() OVER (PARTITION BY o_orderkey) AS INT) AS copy FROM dr JOIN ix ON j = i""",
)
def bootstrap_exact(p):
    return resampling.bootstrap_exact(p.orders.select("o_orderkey", "o_custkey"), "o_orderkey", 7)


@query(
    "bootstrap_poisson",
    f"""SELECT * FROM (SELECT o_orderkey, {_poisson('u')} AS weight FROM (SELECT o_orderkey, {_u('boot', 'o_orderkey', '3')} AS u FROM ord)) WHERE weight > 0""",
)
def bootstrap_poisson(p):
    return resampling.bootstrap_weights(p.orders.select("o_orderkey"), ["o_orderkey"], F.lit(3))


_REPLICATES = f"""
SELECT replicate, omicron, CAST(sum(w) AS BIGINT) AS n, CAST(sum(w * hosp) AS BIGINT) AS n_hosp
FROM (SELECT omicron, hosp, replicate, {_poisson('u')} AS w FROM (SELECT omicron, hosp, r.r AS replicate, {_u('boot', 'case_id', 'r.r')} AS u
  FROM known, (SELECT unnest(generate_series(1, {BOOT})) AS r) r)) GROUP BY replicate, omicron"""


def _replicates(p):
    drawn = resampling.replicate(p.known.select("case_id", "omicron", "hosp"), ["case_id"], BOOT)
    return drawn.groupBy("replicate", "omicron").agg(
        F.sum("weight").alias("n"), F.sum(F.col("weight") * F.col("hosp")).alias("n_hosp")
    )


@query("bootstrap_replicates", f"SELECT CAST(replicate AS INT) AS replicate, omicron, n, n_hosp FROM ({_REPLICATES})")
def bootstrap_replicates(p):
    return _replicates(p)


@query(
    "bootstrap_summary",
    f"""SELECT omicron, round(quantile_cont(risk, 0.5), 6) AS risk_median, round(stddev_samp(risk), 6) AS risk_sd, round(quantile_cont(risk, 0.025), 6) AS risk_l95,
  round(quantile_cont(risk, 0.975), 6) AS risk_u95, count(*) FILTER (risk IS NULL) AS risk_na
FROM (SELECT omicron, n_hosp / n AS risk FROM ({_REPLICATES})) GROUP BY omicron""",
)
def bootstrap_summary(p):
    risks = _replicates(p).withColumn("risk", F.try_divide("n_hosp", "n"))
    out = resampling.percentile_summary(risks, ["omicron"], ["risk"])
    return out.select("omicron", *[F.round(f"risk_{s}", 6).alias(f"risk_{s}") for s in ("median", "sd", "l95", "u95")], "risk_na")


@query(
    "draw_parameters",
    f"""SELECT ageband, CAST(iteration AS INT) AS iteration, round(m + s * z, 6) AS draw FROM (SELECT ageband, m, s, it.i AS iteration,
    sqrt(-2.0 * ln({_u('par:r', 'ageband', 'it.i')})) * cos(2.0 * pi() * {_u('par:a', 'ageband', 'it.i')}) AS z
  FROM (SELECT ageband, avg(reinfection_flag) AS m, sqrt(avg(reinfection_flag) * (1 - avg(reinfection_flag)) / count(*)) AS s FROM banded GROUP BY ageband),
    (SELECT unnest(generate_series(1, 5)) AS i) it)""",
)
def draw_parameters(p):
    rate = F.avg("reinfection_flag")
    levels = p.derived.groupBy("ageband").agg(rate.alias("m"), F.sqrt(rate * (1 - rate) / F.count(F.lit(1))).alias("s"))
    levels = levels.withColumn("iteration", F.explode(F.sequence(F.lit(1), F.lit(5))))
    drawn = resampling.draw_parameters(levels, "ageband", "m", "s", F.col("iteration"))
    return drawn.select("ageband", "iteration", F.round("draw", 6).alias("draw"))


@query(
    "impute_exposure",
    f"""SELECT case_id, CASE WHEN u <= chance THEN 1 WHEN chance IS NOT NULL THEN 0 END AS omicron_drawn
FROM (SELECT s.case_id, CASE WHEN s.omicron = 1 THEN 1.0 WHEN s.delta = 1 THEN 0.0 ELSE g.pr END AS chance, {_u('exposure', 's.case_id', '0')} AS u FROM strata s LEFT JOIN
  (SELECT ageband, dose_vacc, avg(omicron) AS pr FROM known GROUP BY ALL) g ON s.ageband = g.ageband AND s.dose_vacc = g.dose_vacc)""",
)
def impute_exposure(p):
    known = (F.col("omicron") == 1) | (F.col("delta") == 1)
    from cohortline.operators.joins import add_group_stats

    rate = F.avg(F.when(known, F.col("omicron"))).alias("pr")
    base = p.derived.select("case_id", "omicron", "delta", "ageband", "dose_vacc")
    scored = add_group_stats(base, ["ageband", "dose_vacc"], [rate], few_keys=True)
    out = resampling.impute_bernoulli(
        scored, F.col("pr"), uniform("exposure", "case_id", F.lit(0)), "omicron_drawn",
        {1: F.col("omicron") == 1, 0: F.col("delta") == 1},
    )
    return out.select("case_id", "omicron_drawn")


_PROP = "CASE ageband " + " ".join(
    f"WHEN '{b}' THEN {v}" for b, v in zip(
        ["[0,1)", "[1,5)", "[5,10)", "[10,20)", "[20,30)", "[30,40)", "[40,50)", "[50,60)", "[60,70)", "[70,80)", "[80,Inf]"], fixed.REPORTED_SHARE)
) + " END"


@query(
    "impute_odds_scaled",
    f"""SELECT case_id, round(pred, 6) AS reinf_pred, CASE WHEN reinfection_flag = 1 THEN '2' WHEN u <= pred THEN '1' WHEN pred IS NOT NULL THEN '0' END AS reinf_rand,
  CASE WHEN reinfection_flag = 1 THEN vaccinated || '.2' WHEN u <= pred THEN vaccinated || '.1' WHEN pred IS NOT NULL THEN 'first' END AS vacc_reinf
FROM (SELECT *, CASE WHEN reinfection_flag = 1 OR pr / (1 - pr) * (1 / prop - 1) >= 1 THEN 1.0 ELSE pr / (1 - pr) * (1 / prop - 1) END AS pred
  FROM (SELECT case_id, reinfection_flag, vaccinated, avg(reinfection_flag) OVER (PARTITION BY NHSER_name, omicron) AS pr,
    CAST({_PROP} AS DOUBLE) AS prop, {_u('status', 'case_id', '0')} AS u FROM known))""",
)
def impute_odds_scaled(p):
    from cohortline.operators.joins import add_group_stats

    base = ascertainment.reported_shares(p.known.select("case_id", "reinfection_flag", "vaccinated", "NHSER_name", "omicron", "ageband"))
    scored = add_group_stats(base, ["NHSER_name", "omicron"], [F.avg("reinfection_flag").alias("pr")], few_keys=True)
    pred = resampling.odds_scaled(F.col("pr"), ascertainment.resampling_factor(F.col("prop_rep")), F.col("reinfection_flag"))
    out = ascertainment.odds_imputed(scored.withColumn("reinf_pred", pred), uniform("status", "case_id", F.lit(0)))
    return out.select("case_id", F.round("reinf_pred", 6).alias("reinf_pred"), "reinf_rand", "vacc_reinf")


_YEAR = "year(last_specimen_date)"
_RAW = (
    "SELECT *, " + ", ".join(
        f"CASE WHEN reinfection_flag = 1 THEN 1.0 ELSE f * r_{e} / nullif(n_{e} - r_{e}, 0) END AS raw_{e}" for e in ENDPOINTS
    ) + f""" FROM (SELECT case_id, reinfection_flag, {', '.join(ENDPOINTS)}, 1 / CAST({_PROP} AS DOUBLE) - 1 AS f, {_u('status', 'case_id', '0')} AS u, """
    + ", ".join(
        f"count(*) OVER (PARTITION BY ageband, {_YEAR}, dose_vacc, omicron, {e}) AS n_{e}, "
        f"sum(reinfection_flag) OVER (PARTITION BY ageband, {_YEAR}, dose_vacc, omicron, {e}) AS r_{e}"
        for e in ENDPOINTS
    ) + " FROM known)"
)
_STRATA = ["ageband", "year", "dose_vacc", "omicron"]


def _imputed(p):
    keep = ["case_id", "ageband", "dose_vacc", "omicron", "reinfection_flag", *ENDPOINTS]
    base = p.known.select(*keep, F.year("last_specimen_date").alias("year"))
    return ascertainment.impute_status(
        ascertainment.reported_shares(base), uniform("status", "case_id", F.lit(0)), ENDPOINTS, _STRATA
    )


@query(
    "stratified_impute",
    "SELECT case_id, " + ", ".join(
        f"round(least(coalesce(raw_{e}, 0), 1), 6) AS {e}_reinf_var, CASE WHEN u <= least(coalesce(raw_{e}, 0), 1) THEN 1 ELSE 0 END AS {e}_reinf_rand" for e in ENDPOINTS
    ) + f" FROM ({_RAW})",
)
def stratified_impute(p):
    out = []
    for e in ENDPOINTS:
        out += [F.round(f"{e}_reinf_var", 6).alias(f"{e}_reinf_var"), F.col(f"{e}_reinf_rand")]
    return _imputed(p).select("case_id", *out)


@query(
    "impute_qa_counts",
    " UNION ALL ".join(
        f"SELECT '{e}' AS endpoint, count(*) FILTER (raw_{e} IS NULL) AS n_undefined, count(*) FILTER (raw_{e} > 1) AS n_above_one FROM ({_RAW})" for e in ENDPOINTS
    ),
)
def impute_qa_counts(p):
    return resampling.imputation_checks(_imputed(p), ENDPOINTS)


def _newton_sql(cells: str, key: str, steps: int = 9) -> str:
    """CTEs that fit a one-covariate (0/1) stratified model per key by Newton's method.

    ``cells``: a query with (key, stratum, t, n, n1, d, d1). The last CTE is ``fit(key, b, se)``.
    """
    w = f"OVER (PARTITION BY {key}, stratum ORDER BY t DESC ROWS UNBOUNDED PRECEDING)"
    ctes = [
        f"cells AS ({cells})",
        f"risk AS (SELECT * FROM (SELECT {key}, d, d1, sum(n) {w} AS rn, sum(n1) {w} AS rn1 FROM cells) WHERE d > 0)",
        "ties AS (SELECT *, l / d AS f FROM (SELECT *, unnest(generate_series(0, CAST(d AS BIGINT) - 1)) AS l FROM risk))",
        f"b0 AS (SELECT {key}, CAST(0 AS DOUBLE) AS b FROM risk GROUP BY {key})",
    ]
    for k in range(steps):
        ctes.append(
            f"""b{k + 1} AS (SELECT {key}, any_value(b) + CASE WHEN sum(q - q * q) > 1e-12 THEN sum(CASE WHEN l = 0 THEN d1 ELSE 0 END - q) / sum(q - q * q) ELSE 0 END AS b,
  sum(q - q * q) AS info FROM (SELECT ties.*, b, exp(b) * (rn1 - f * d1) / ((rn - rn1) + exp(b) * rn1 - f * ((d - d1) + exp(b) * d1)) AS q
  FROM ties JOIN b{k} USING ({key})) GROUP BY {key})"""
        )
    last = steps
    ctes.append(
        f"""fit AS (SELECT {key}, any_value(b) AS b, 1 / sqrt(sum(q - q * q)) AS se FROM (SELECT ties.*, b,
  exp(b) * (rn1 - f * d1) / ((rn - rn1) + exp(b) * rn1 - f * ((d - d1) + exp(b) * d1)) AS q FROM ties JOIN b{last} USING ({key})) GROUP BY {key})"""
    )
    return ",\n".join(ctes)


_CELL_AGGS = "count(*) AS n, sum(x) AS n1, sum(surv_status) AS d, sum(surv_status * x) AS d1"
_UNI = " UNION ALL ".join(
    f"SELECT '{v}' AS variable, CAST({e} AS VARCHAR) AS level, surv_time, surv_status, x FROM survival"
    for v, e in (("all", "'all'"), ("segment", "c_mktsegment"), ("year", "order_year"))
)


@query(
    "cox_univariate",
    f"""WITH {_newton_sql(f"SELECT variable || ':' || level AS k, 0 AS stratum, surv_time AS t, {_CELL_AGGS} FROM ({_UNI}) GROUP BY ALL", 'k')}
SELECT k AS fit, round(b, 6) AS estimate, round(se, 6) AS se FROM fit""",
)
def cox_univariate(p):
    variables = {"all": F.lit("all"), "segment": F.col("c_mktsegment"), "year": F.col("order_year").cast("string")}
    stacked = stacked_levels(p.survival, variables, ["surv_time", "surv_status", "x"])
    patterns = collapse_patterns(
        stacked, [number("x")], interaction("variable", "level", sep=":"), F.lit("all"),
        F.col("surv_time"), F.col("surv_status"),
    )
    fits = fit_hazards(patterns, eps=TIGHT)
    return fits.select("fit", F.round("estimate", 6).alias("estimate"), F.round("se", 6).alias("se"))


@query(
    "cox_stratified_single",
    f"""WITH {_newton_sql(f"SELECT 'all' AS k, c_mktsegment || '.' || order_year AS stratum, surv_time AS t, {_CELL_AGGS} FROM survival GROUP BY ALL", 'k')}
SELECT k AS fit, round(b, 6) AS estimate, round(se, 6) AS se FROM fit""",
)
def cox_stratified_single(p):
    patterns = collapse_patterns(
        p.survival, [number("x")], F.lit("all"), interaction("c_mktsegment", "order_year"),
        F.col("surv_time"), F.col("surv_status"),
    )
    fits = fit_hazards(patterns, eps=TIGHT)
    return fits.select("fit", F.round("estimate", 6).alias("estimate"), F.round("se", 6).alias("se"))


@query(
    "cox_score_test",
    f"""WITH cells AS (SELECT order_year, c_mktsegment, surv_time AS t, {_CELL_AGGS} FROM survival GROUP BY ALL),
risk AS (SELECT * FROM (SELECT order_year, d, d1, sum(n) OVER w AS rn, sum(n1) OVER w AS rn1 FROM cells
  WINDOW w AS (PARTITION BY order_year, c_mktsegment ORDER BY t DESC ROWS UNBOUNDED PRECEDING)) WHERE d > 0),
q AS (SELECT order_year, l, d1, (rn1 - l / d * d1) / (rn - l / d * d) AS q FROM (SELECT *, unnest(generate_series(0, CAST(d AS BIGINT) - 1)) AS l FROM risk)),
s AS (SELECT order_year, sum(CASE WHEN l = 0 THEN d1 ELSE 0 END - q) AS score, sum(q - q * q) AS information FROM q GROUP BY order_year)
SELECT CAST(order_year AS INT) AS order_year, round(score, 6) AS score, round(information, 6) AS information, round(score * score / information, 6) AS chi_square FROM s""",
)
def cox_score_test(p):
    out = score_test(p.survival, ["order_year"], ["c_mktsegment"], "surv_time", "surv_status", "x")
    return out.select("order_year", *[F.round(c, 6).alias(c) for c in ("score", "information", "chi_square")])


_OM_AGE = """CASE WHEN omicron = 0 AND ageband IS NOT NULL THEN 'Delta' WHEN age >= 0 AND age < 10 THEN '1.[0,10)' ELSE '1.' || ageband END"""
_DERIVED_TERMS = {
    "om_dose": "CASE WHEN dose_vacc = 'None' AND lv2s = 8 THEN 'Unvaccinated' ELSE omicron || '.' || dose_vacc || '.' || lv2s END",
    "om_dose2": "CASE WHEN dose_vacc = 'None' THEN 'Unvaccinated' ELSE omicron || '.' || dose_vacc END",
    "reinf_var": "CASE WHEN reinfection_flag = 0 THEN 'No past infection' WHEN omicron = 0 THEN 'Past infection:Delta' ELSE 'Past infection:Omicron' END",
}


def _totals_sql(spec: models.ModelSpec) -> str:
    """What the events of each endpoint sum up to for every term of a model: the fit must expect the same."""
    band = "ageband3" if spec.fine else "ageband1"
    age = _OM_AGE.replace(" WHEN age >= 0 AND age < 10 THEN '1.[0,10)'", "") if spec.fine else _OM_AGE
    source = "known"
    if spec.definition:
        om, dlt = spec.definition
        source = f"(SELECT * REPLACE ({om} AS omicron, {dlt} AS delta) FROM known WHERE {om} = 1 OR {dlt} = 1)"
    terms = spec.terms()
    columns = list(dict.fromkeys(c for t in terms for c in t.columns()))
    made = {"om_age": age, "agebf": f"CAST({band} AS VARCHAR)", "age_ib": f"age - {band}", **_DERIVED_TERMS}
    known = " AND ".join(f"{c} IS NOT NULL" for c in [*columns, *spec.strata])
    ok = f"""SELECT * FROM (SELECT *, {', '.join(f'{made[c]} AS {c}' for c in columns if c in made)} FROM {source}
      WHERE {spec.rows or 'TRUE'}) WHERE {known}"""
    flags = ", ".join(ENDPOINTS)
    parts = []
    for t in terms:
        if t.factor is None:
            parts.append(f"SELECT '{t.number}' AS name, '' AS level, '' AS suffix, FALSE AS ref, FALSE AS drops, CAST({t.number} AS DOUBLE) AS x, {flags} FROM ok")
            continue
        ref = f"{t.factor} = '{fixed.REFERENCE_LEVELS[t.factor]}'" if t.factor in fixed.REFERENCE_LEVELS else "FALSE"
        x, suffix = (f"CAST({t.number} AS DOUBLE)", f":{t.number}") if t.number else ("CAST(1 AS DOUBLE)", "")
        parts.append(f"SELECT '{t.factor}' AS name, CAST({t.factor} AS VARCHAR) AS level, '{suffix}' AS suffix, {ref} AS ref, {t.number is None} AS drops, {x} AS x, {flags} FROM ok")
    sums = ", ".join(f"sum(x * {e}) AS s_{e}, (SELECT sum({e}) FROM ok) AS n_{e}" for e in ENDPOINTS)
    rows = " UNION ALL ".join(
        f"SELECT '{spec.name}' AS model, '{e}' AS endpoint, name || level || suffix AS term, CAST(n_{e} AS DOUBLE) AS n_event, round(s_{e}, 3) AS expected FROM kept WHERE n_{e} > 0" for e in ENDPOINTS
    )
    return f"""SELECT * FROM (WITH ok AS ({ok}), kept AS (SELECT name, level, suffix, {sums} FROM ({' UNION ALL '.join(parts)}) GROUP BY name, level, suffix, ref, drops
    QUALIFY NOT drops OR row_number() OVER (PARTITION BY name, suffix ORDER BY ref DESC, TRY_CAST(level AS DOUBLE) NULLS LAST, level) > 1)
  {rows})"""


def _totals(p, specs):
    out = models.event_totals(p.known, specs, CASES)
    return out.withColumn("expected", F.round(F.col("expected"), 3) + 0.0)


@query("cox_stratified", _totals_sql(models.BY_NAME["sev"]))
def cox_stratified(p):
    """Score equations of the main model: each term's sum over the events, as the fit expects it."""
    return _totals(p, [models.BY_NAME["sev"]])


@query(
    "cox_side_by_side",
    "SELECT term, " + ", ".join(f"max(expected) FILTER (endpoint = '{e}') AS {e}_expected, max(n_event) FILTER (endpoint = '{e}') AS {e}_n_event" for e in ENDPOINTS)
    + f" FROM ({_totals_sql(models.BY_NAME['sev_ms'])}) GROUP BY term",
)
def cox_side_by_side(p):
    """The day-only model, its endpoints next to each other."""
    return side_by_side(_totals(p, [models.BY_NAME["sev_ms"]]), ["term"], "endpoint", ENDPOINTS, ["expected", "n_event"])


def _catalogue(name: str, specs: list[models.ModelSpec]) -> None:
    query(name, " UNION ALL ".join(_totals_sql(s) for s in specs))(lambda p: _totals(p, specs))


# The models that need no imputed status, fitted together from one table of cells.
_catalogue("cox_main_models", [models.MODELS[k] for k in (1, 2, 3, 4, 6)])
_catalogue("cox_sensitivity_models", [models.MODELS[k] for k in (7, 9, 10, 11, 12, 13, 14, 15, 16, 17)])
_catalogue("cox_subset_models", [models.MODELS[k] for k in (18, 19, 21, 22, 23, 24, 25, 26, 27)])


@query("cox_estimates")
def cox_estimates(p):
    """Estimates of the main model."""
    fits = models.fit_model(p.known, models.BY_NAME["sev"], CASES)
    return fits.select("model", "endpoint", "var", "estimate", "se", "reason")


@query("cox_report")
def cox_report(p):
    """Hazard ratios of the day-only model, endpoints next to each other."""
    fits = models.fit_model(p.known, models.BY_NAME["sev_ms"], CASES)
    return models.report_model(fits, CASES.endpoints)


_VARS = {"all": "'all'", "sex": "sex", "reinf": "CAST(reinfection_flag AS VARCHAR)", "imd_decile": "CAST(imd_decile AS VARCHAR)", "dose_vacc": "dose_vacc"}
_HR_ROWS = " UNION ALL ".join(
    f"SELECT '{v}' AS variable, {expr} AS level, last_specimen_date AS ix, omicron AS x, hosp AS ev, hosp_date AS ed FROM known" for v, expr in _VARS.items()
)
_HR_CELLS = f"""SELECT variable || '|' || level AS k, 0 AS stratum, greatest(CASE WHEN ev = 1 THEN ed ELSE least(ix + 60, DATE '2001-08-01') END - ix, 0.5) AS t,
  count(*) AS n, sum(x) AS n1, sum(ev) AS d, sum(ev * x) AS d1 FROM ({_HR_ROWS}) GROUP BY ALL"""


@query(
    "table_with_hr",
    f"""WITH {_newton_sql(_HR_CELLS, 'k')},
n AS (SELECT variable, level, count(*) FILTER (x = 0) AS case_delta, count(*) FILTER (x = 1) AS case_omicron, count(*) FILTER (x = 0 AND ev = 1) AS hosp_delta,
  count(*) FILTER (x = 1 AND ev = 1) AS hosp_omicron FROM ({_HR_ROWS}) GROUP BY ALL)
SELECT n.*, CASE WHEN ok THEN round(exp(b), 5) END AS hosp_mean, CASE WHEN ok THEN round(exp(b - 1.96 * se), 5) END AS hosp_l95,
  CASE WHEN ok THEN round(exp(b + 1.96 * se), 5) END AS hosp_u95 FROM (SELECT *, hosp_delta > 0 AND hosp_omicron > 0 AS ok FROM n) n LEFT JOIN fit ON k = variable || '|' || level""".replace(
        "SELECT n.*,", "SELECT n.* EXCLUDE (ok),"
    ),
)
def table_with_hr(p):
    out = models.table_with_hazards(p.known, CASES, ["hosp"], ["case", "hosp"], eps=TIGHT)
    out = out.where(F.col("variable").isin(*_VARS))
    # without events in one arm the ratio has no finite estimate
    ok = (F.col("hosp_delta") > 0) & (F.col("hosp_omicron") > 0)
    return out.select(
        "variable", "level", "case_delta", "case_omicron", "hosp_delta", "hosp_omicron",
        *[F.when(ok, F.round(c, 5)).alias(c) for c in ("hosp_mean", "hosp_l95", "hosp_u95")],
    )


_TERMS = [factor("sex"), factor("imd_decile"), within("vaccinated", "reinfection_flag"), number("omicron")]


@query(
    "design_matrix",
    """SELECT case_id, """
    + ", ".join(f"CAST(sex = '{v}' AS DOUBLE) AS \"sex{v}\"" for v in ("Male", "Unknown"))
    + ", "
    + ", ".join(f"CAST(imd_decile = {v} AS DOUBLE) AS \"imd_decile{v}\"" for v in range(2, 11))
    + ", "
    + ", ".join(f"CASE WHEN vaccinated = '{v}' THEN CAST(reinfection_flag AS DOUBLE) ELSE 0.0 END AS \"vaccinated{v}:reinfection_flag\"" for v in ("Unvacc", "Vacc"))
    + ", CAST(omicron AS DOUBLE) AS omicron FROM known",
)
def design(p):
    levels = factor_levels(p.known, _TERMS, fixed.REFERENCE_LEVELS)
    return design_matrix(p.known, ["case_id"], _TERMS, levels)


@query(
    "glm_saturated",
    "SELECT NHSER_name, sex, count(*) AS n, round(avg(omicron), 5) AS p FROM known GROUP BY NHSER_name, sex",
)
def glm_saturated(p):
    base = p.known.select("omicron", "NHSER_name", "sex", interaction("NHSER_name", "sex").alias("cell"))
    scored = predict(fit_binomial(base, "omicron", [factor("cell")]), base)
    return scored.groupBy("NHSER_name", "sex").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("prediction"), 5).alias("p"))


def _logistic_sql(steps: int = 8) -> str:
    """CTEs that fit outcome ~ x by Newton's method; the last one is ``coef(a, b)``."""
    ctes = ["pts AS (SELECT age / 10 AS x, count(*) AS n, CAST(sum(omicron) AS DOUBLE) AS y FROM known GROUP BY ALL)",
            "c0 AS (SELECT CAST(0 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b)"]
    for k in range(steps):
        ctes.append(
            f"""c{k + 1} AS (SELECT a + (h11 * u0 - h01 * u1) / (h00 * h11 - h01 * h01) AS a, b + (h00 * u1 - h01 * u0) / (h00 * h11 - h01 * h01) AS b
  FROM (SELECT any_value(a) AS a, any_value(b) AS b, sum(y - n * q) AS u0, sum(x * (y - n * q)) AS u1, sum(n * q * (1 - q)) AS h00,
    sum(x * n * q * (1 - q)) AS h01, sum(x * x * n * q * (1 - q)) AS h11 FROM (SELECT *, 1 / (1 + exp(-a - b * x)) AS q FROM pts, c{k})))"""
        )
    return ",\n".join(ctes)


@query(
    "glm_single_covariate",
    f"WITH {_logistic_sql()} SELECT age, n, round(1 / (1 + exp(-a - b * age / 10)), 5) AS p FROM (SELECT age, count(*) AS n FROM known GROUP BY age), c8",
)
def glm_single_covariate(p):
    base = p.known.select("omicron", "age", (F.col("age") / 10).alias("x"))
    scored = predict(fit_binomial(base, "omicron", [number("x")]), base)
    return scored.groupBy("age").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("prediction"), 5).alias("p"))


def _term_totals_sql(terms: list, value: str) -> str:
    made = {"agebf": "CAST(ageband1 AS VARCHAR)", "age_ib": "age - ageband1", "imd_decile_f": "CAST(imd_decile AS VARCHAR)", "Tgf": "CAST(Tg AS VARCHAR)"}
    columns = list(dict.fromkeys(c for t in terms for c in t.columns()))
    ok = f"""SELECT * FROM (SELECT *, {', '.join(f'{made[c]} AS {c}' for c in columns if c in made)} FROM known)
      WHERE {' AND '.join(f'{c} IS NOT NULL' for c in columns)}"""
    parts = [f"SELECT 'all' AS term, 1.0 AS x, {value} AS y FROM ok"]
    for t in terms:
        label = f"'{t.factor}' || {t.factor}" + (f" || ':{t.number}'" if t.number else "") if t.factor else f"'{t.number}'"
        parts.append(f"SELECT {label}, CAST({t.number or 1} AS DOUBLE), {value} FROM ok")
    return f"WITH ok AS ({ok}) SELECT term, count(*) AS n, round(sum(x * y), 0) AS total FROM ({' UNION ALL '.join(parts)}) GROUP BY term"


def _rounded_totals(scored, terms, value):
    # to whole numbers: these fits end after 25 steps, where days of one outcome still leave some hundredths
    return term_totals(scored, terms, value).withColumn("total", F.round("total", 0) + 0.0)


@query("glm_binomial", _term_totals_sql(ascertainment.EXPOSURE_MODEL, "omicron"))
def glm_binomial(p):
    """Score equations of the exposure model: predicted sums of each term among the known."""
    out = ascertainment.impute_exposure_by_model(p.derived, ["case_id"]).select("case_id", "om_pred")
    known = ascertainment.model_columns(p.known).join(out, "case_id")
    return _rounded_totals(known, ascertainment.EXPOSURE_MODEL, "om_pred")


@query("impute_status_by_model", _term_totals_sql(ascertainment.STATUS_MODEL, "reinfection_flag"))
def impute_status_by_model(p):
    """Score equations of the status model: predicted sums of each term."""
    out = ascertainment.impute_status_by_model(p.known, ["case_id"])
    return _rounded_totals(out, ascertainment.STATUS_MODEL, "reinf_fit")


@query(
    "roc_auc",
    """SELECT round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) AS auc
FROM (SELECT hosp AS y, avg(rn) OVER (PARTITION BY age + imd_decile) AS r
  FROM (SELECT hosp, age, imd_decile, row_number() OVER (ORDER BY age + imd_decile) AS rn FROM known))""",
)
def auc(p):
    scored = p.known.select("hosp", (F.col("age") + F.col("imd_decile")).alias("score"))
    return roc_auc(scored, "hosp", "score").select(F.round("auc", 6).alias("auc"))


@query("bootstrap_hazards")
def bootstrap_hazards(p):
    """All replicates of the imputed model at once, summarised per term."""
    fits = ascertainment.bootstrap_under_ascertainment(p.derived, CASES, ["case_id"])
    return ascertainment.bootstrap_report(fits, CASES.endpoints)
