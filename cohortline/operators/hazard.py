"""Stratified proportional-hazards models as Spark jobs.

Records collapse to weighted patterns (fit, stratum, time, event, covariates) with
map-side combining. Each Newton step is one job: risk-set sums per bucket of whole
strata, added up in Spark; only the p × p system reaches the driver. Several fits over
the same covariates (endpoints, replicates, table levels) share the jobs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortline.operators import risksets
from cohortline.operators.design import Term, design_columns, design_entries, factor_levels, known_terms, term_columns
from cohortline.operators.joins import HOT_ROWS, join_unique
from cohortline.sources.storage import cut_lineage

# the kernel travels with the tasks, so executors need no installed copy of it
cloudpickle.register_pickle_by_value(risksets)

EPS = 1e-9
MAX_STEPS = 50
# a task holds about this many patterns in memory: of dense columns, or (in a fit) one entry per model term
PATTERNS_PER_BUCKET = 50_000
ENTRIES_PER_BUCKET = 200_000
MIN_PATTERNS_PER_BUCKET = 2_000
# Times of a spread stratum that one task finishes.
TIMES_PER_BLOCK = 500
# A step moves no column's part of the linear predictor by more than this.
LARGEST_MOVE = 5.0
# Damping starts at this share of the largest information.
LEAST_DAMPING = 1e-4
# A fit has settled when a full step promises to raise its log likelihood by no more than twice this.
SETTLED = 1e-6
# A column that a converged fit would still move by more than this has no finite estimate.
STILL_MOVING = 1e-3
PIVOT_TOLERANCE = float(np.finfo(float).eps ** 0.75)

FIT_SCHEMA = (
    "fit string, term string, estimate double, se double, loglik_null double, loglik double, "
    "n double, n_event double, steps int, converged boolean, reason string, beta double"
)
# Why a term has no estimate.
REDUNDANT, MONOTONE = "no information", "monotone likelihood"


@dataclass(frozen=True)
class Patterns:
    """Collapsed records of one or more fits, bucketed by fit or by stratum.

    A row has an entry per model term: the number of the column that the term sets (``at``) and its
    value (``v``); the other columns are zero. Strata are numbered.

    ``reach`` is the largest absolute value of each column (of each model's columns, where
    several are stacked); ``blocks`` numbers the times of strata that are spread over all buckets
    (fit, stratum, time, block; latest times first).

    ``packed`` holds the other strata as blocks for the steps of a fit (:meth:`laid_out`), but for those that add the
    same number at any coefficients; ``fixed`` has the sum of these for each fit.
    """

    table: DataFrame
    terms: tuple[str, ...]
    reach: tuple[float, ...] | dict[str, tuple[float, ...]]
    blocks: DataFrame | None = None
    entries: int = 1
    packed: DataFrame | None = None
    fixed: Mapping[str, float] | None = None

    @property
    def split_strata(self) -> bool:
        return self.blocks is not None

    def reach_of(self, fit: str) -> tuple[float, ...]:
        return self.reach[fit.split("|", 1)[0]] if isinstance(self.reach, dict) else self.reach

    def counts(self) -> DataFrame:
        """Records and events of each fit, in strata with events: (fit, n, d)."""
        weight = F.col("weight")
        return self.table.groupBy("fit").agg(F.sum(weight).alias("n"), F.sum(weight * F.col("event")).alias("d"))

    def sums(self, betas: dict[str, np.ndarray]) -> DataFrame:
        """(fit, pos, v): packed log likelihood (without what is ``fixed``), score and information at given coefficients."""
        return likelihood_sums(self, betas)

    def laid_out(self) -> Patterns:
        """The same patterns, stored for many steps: sorted, compressed and told apart by fit."""
        blocks = cut_lineage(self.table.where("NOT large").mapInArrow(risksets.laid_out, "fit string, data binary, fixed double"))
        fixed = {r["fit"]: r["v"] for r in blocks.groupBy("fit").agg(F.sum("fixed").alias("v")).collect()}
        return replace(self, packed=blocks.where("data IS NOT NULL").select("fit", "data"), fixed=fixed)


def bucket_count(patterns: int, parallelism: int, most: int = PATTERNS_PER_BUCKET) -> int:
    """Partitions for a number of patterns: all cores for small tables, bounded size for large ones."""
    by_size = -(-patterns // most)
    by_cores = min(parallelism, -(-patterns // MIN_PATTERNS_PER_BUCKET))
    return max(by_size, by_cores, 1)


def collapse_patterns(
    df: DataFrame,
    terms: Sequence[Term],
    fit: Column,
    stratum: Column,
    time: Column,
    event: Column,
    weight: Column | None = None,
    reference: Mapping[str, str] | None = None,
    max_stratum: int = HOT_ROWS,
    buckets: int | None = None,
) -> Patterns:
    """Reduce records to weighted patterns and lay them out by stratum.

    The records are read once: levels, strata and the layout all come from the
    patterns. Strata without events add nothing to any sum and are dropped. A fit that
    is smaller than a bucket lies whole in one, so that a step adds up one vector of it;
    a larger one is dealt by stratum. A stratum with more than ``max_stratum`` patterns is
    spread over all buckets, and its risk sets are prefix sums over blocks of its times,
    so no task holds it whole.
    """
    weight = F.lit(1) if weight is None else weight
    spark, covariates = df.sparkSession, term_columns(terms)
    rows = df.where(known_terms(terms)).select(
        fit.cast("string").alias("fit"), stratum.cast("string").alias("stratum"),
        time.cast("double").alias("time"), event.cast("int").alias("event"),
        weight.alias("weight"), *covariates,
    ).where("stratum IS NOT NULL AND time IS NOT NULL")
    key = ["fit", "stratum"]
    collapsed = rows.groupBy(*key, "time", "event", *covariates).agg(F.sum("weight").cast("double").alias("weight")).persist()
    try:
        levels = factor_levels(collapsed, terms, reference or {})
        design, entries = design_columns(terms, levels), design_entries(terms, levels)
        sizes = collapsed.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.max("event").alias("any_event"))
        # strata without events stay in the list, so that a giant one is spread before it is dropped
        # and get a number each, as their names are long
        sizes = cut_lineage(sizes.withColumn("_number", F.monotonically_increasing_id()))
        has_event = F.col("any_event") == 1
        total = sizes.where(has_event).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
        n_buckets = buckets or bucket_count(total, spark.sparkContext.defaultParallelism, ENTRIES_PER_BUCKET)
        large = not sizes.where(has_event & (F.col("n") >= max_stratum)).isEmpty()  # is a second stage needed?
        reach = collapsed.agg(*[F.max(F.abs(F.col(c).cast("double"))).alias(f"c{k}") for k, c in enumerate(_numbers(terms))]).first() if _numbers(terms) else ()
        informative = join_unique(collapsed, sizes, key, "n", hot_rows=max_stratum).where(has_event)
        # as many rows as there are fits, which the driver holds anyway
        of_fit = F.broadcast(sizes.where(has_event).groupBy("fit").agg(F.sum("n").alias("of_fit")))
        is_large = F.col("n") >= max_stratum
        spread = F.xxhash64("fit", "stratum", "time", "event", *covariates)
        whole = ~is_large & (F.col("of_fit") * n_buckets <= total)
        place = F.when(is_large, spread).when(whole, F.xxhash64("fit")).otherwise(F.xxhash64(*key))
        x = [F.array(*part).alias(name) for name, part in zip(("at", "v"), zip(*entries))]
        table = informative.join(of_fit, "fit").select(
            "fit", F.col("_number").alias("stratum"), "time", "event", "weight", is_large.alias("large"), *x, F.pmod(place, F.lit(n_buckets)).cast("int").alias("bucket")
        )
        table = cut_lineage(table.repartition(n_buckets, "bucket").drop("bucket"))
        blocks = None
        if large:
            latest = Window.partitionBy(*key).orderBy(F.desc("time"))
            times = table.where("large").select(*key, "time").distinct()
            blocks = cut_lineage(times.withColumn("block", F.floor((F.row_number().over(latest) - 1) / TIMES_PER_BLOCK).cast("int")))
    finally:
        collapsed.unpersist()
    known = dict(zip(_numbers(terms), reach))
    widest = tuple(known.get(label.split(":")[-1], 1.0) or 1.0 for label, _ in design)
    return Patterns(table, tuple(label for label, _ in design), widest, blocks, len(entries))


def _numbers(terms: Sequence[Term]) -> list[str]:
    return list(dict.fromkeys(t.number for t in terms if t.number))


_SUM_SCHEMA = "fit string, v array<double>"
_CELL_SCHEMA = "fit string, stratum long, time double, v array<double>"


def _added(parts: DataFrame, *keys: str) -> DataFrame:
    """Vectors of equal keys added up, number by number (with map-side combining)."""
    return parts.select(*keys, F.posexplode("v").alias("pos", "v")).groupBy(*keys, "pos").agg(F.sum("v").alias("v"))


def _vectors(added: DataFrame, *keys: str) -> DataFrame:
    """Back to one vector per key."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"])
    return added.groupBy(*keys).agg(ordered.alias("v"))


def likelihood_sums(patterns: Patterns, betas: dict[str, np.ndarray]) -> DataFrame:
    """(fit, pos, v): packed log likelihood, score and information at given coefficients."""
    # the stored partitions hold whole fits or strata, so this needs no shuffle
    if patterns.packed is None:
        parts = patterns.table.mapInArrow(risksets.partition_sums(betas), _SUM_SCHEMA)
    else:  # fits that have ended are not even read into the tasks' Python
        wanted = patterns.packed.where(F.col("fit").isin(list(betas)))
        parts = wanted.mapInArrow(risksets.block_sums(betas), _SUM_SCHEMA)
    if patterns.split_strata:
        parts = parts.unionByName(_spread_sums(patterns, betas))
    return _added(parts, "fit")


def _spread_sums(patterns: Patterns, betas: dict[str, np.ndarray]) -> DataFrame:
    """Sums of the strata that no task holds whole, by prefix sums over blocks of their times.

    Parts of a time add up first, with map-side combining. Blocks of times then add up to
    what is at risk after each block; with that a block finishes its own times. A task
    holds a part, the block sums of a stratum, or a block.
    """
    p = len(patterns.terms)
    rows = patterns.table.where("large")
    # linear predictors are shifted by their largest, so that nothing overflows: one number per large stratum
    tops = rows.mapInArrow(risksets.largest_predictors(betas), "fit string, stratum long, top double")
    tops = {(r["fit"], r["stratum"]): r["top"] for r in tops.groupBy("fit", "stratum").agg(F.max("top").alias("top")).collect()}
    key = ["fit", "stratum", "time"]
    parts = rows.mapInArrow(risksets.cell_sums(betas, tops), _CELL_SCHEMA)
    cells = _vectors(_added(parts, *key), *key)
    cells = cut_lineage(cells.join(patterns.blocks, key))
    in_block = ["fit", "stratum", "block"]
    later = _vectors(_added(cells.select(*in_block, "v"), *in_block), *in_block)
    later = later.groupBy("fit", "stratum").applyInPandas(risksets.sums_before(p), "fit string, stratum long, block int, later array<double>")
    return cells.join(later, in_block).groupBy(*in_block).applyInPandas(risksets.finish_block(p), _SUM_SCHEMA)


def _evaluate(patterns, betas: dict[str, np.ndarray]) -> dict[str, tuple]:
    p = len(patterns.terms)
    size = 1 + p + p * (p + 1) // 2
    # fits × size numbers, whatever the size of the data
    sums = patterns.sums(betas).toArrow().combine_chunks()
    codes, names = pd.factorize(sums.column("fit").to_numpy(zero_copy_only=False))
    packed = np.zeros((len(names), size))
    if "pos" in sums.column_names:
        packed[codes, sums.column("pos").to_numpy()] = sums.column("v").to_numpy()
    elif len(names):  # one whole vector of each fit
        packed[codes] = sums.column("v").combine_chunks().flatten().to_numpy().reshape(-1, size)
    info = np.zeros((len(names), p, p))
    info[:, *np.triu_indices(p)] = packed[:, 1 + p :]
    info += np.triu(info, 1).transpose(0, 2, 1)
    fixed = getattr(patterns, "fixed", None) or {}
    out = {fit: (fixed[fit], np.zeros(p), np.zeros((p, p))) for fit in betas if fit in fixed}
    return out | {fit: (packed[k, 0] + fixed.get(fit, 0.0), packed[k, 1 : 1 + p], info[k]) for k, fit in enumerate(names)}


def estimable(info: np.ndarray, tolerance: float = PIVOT_TOLERANCE) -> np.ndarray:
    """Columns that add information to those before them (sequential Cholesky pivots).

    ``info`` is one matrix or a stack of them, which are handled together.
    """
    work = np.array(info, float, ndmin=3)
    n, p = work.shape[:2]
    scale = np.maximum(np.diagonal(work, axis1=1, axis2=2).max(axis=1, initial=0.0), 0.0)
    keep = np.zeros((n, p), dtype=bool)
    for j in range(p):
        pivot = work[:, j, j]
        keep[:, j] = np.isfinite(pivot) & (pivot > tolerance * scale) & (pivot > 0)
        column = np.where(keep[:, j, None], work[:, j + 1 :, j] / np.where(keep[:, j], pivot, 1.0)[:, None], 0.0)
        work[:, j + 1 :, j + 1 :] -= column[:, :, None] * work[:, j, None, j + 1 :]
    return keep.reshape(np.shape(info)[:-1])


def _kept_only(info: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """A stack of matrices whose other columns are those of the identity."""
    both = keep[:, :, None] & keep[:, None, :]
    return np.where(both, info, np.eye(info.shape[-1]))


def _solve(info: np.ndarray, score: np.ndarray, damping: np.ndarray | None = None, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Newton steps of a stack of fits, and the columns that move; ``damping`` is added to the diagonal."""
    keep = estimable(info) if keep is None else keep
    system = _kept_only(info, keep)
    if damping is not None:
        system = system + damping[:, None, None] * np.eye(info.shape[-1])
    return np.linalg.solve(system, np.where(keep, score, 0.0)[:, :, None])[:, :, 0], keep


def _bounded_step(info: np.ndarray, score: np.ndarray, damping: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """Newton steps, damped (``damping`` grows in place) until none moves a linear predictor too far.

    Damping holds back the directions that the data say little about, and hardly the others.
    """
    step = _solve(info, score, damping, keep)[0]
    top = np.diagonal(info, axis1=1, axis2=2).max(axis=1, initial=0.0)
    while (far := np.flatnonzero(np.abs(step).max(axis=1, initial=0.0) > LARGEST_MOVE)).size:
        damping[far] = np.maximum(10 * damping[far], LEAST_DAMPING * top[far])
        step[far] = _solve(info[far], score[far], damping[far], keep[far])[0]
    return step


def fit_hazards(patterns, standard_errors: bool = True, eps: float = EPS, max_steps: int = MAX_STEPS) -> DataFrame:
    """Newton-Raphson for all fits at once; one row per fit and term.

    A step that lowers the log likelihood or moves a linear predictor far is damped and tried again.
    ``reason`` says why a term has no estimate: it adds no information to the terms before
    it, or the likelihood still rises along it when the fit has settled or used up its steps (events
    in one arm only, say), so that its estimate is not finite. ``beta`` is the coefficient at which
    the fit stopped, estimate or not. The driver holds p-vectors
    and p × p matrices only. ``n`` and ``n_event`` count the records of strata with events.
    """
    spark, p = patterns.table.sparkSession, len(patterns.terms)
    if isinstance(patterns, Patterns):
        patterns = patterns.laid_out()
    counts = {r["fit"]: (r["n"], r["d"]) for r in patterns.counts().collect()}

    def widths(fits: list[str]) -> np.ndarray:
        return np.array([patterns.reach_of(f) for f in fits], float).reshape(len(fits), p)

    def evaluate(betas: dict) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Log likelihoods, scores and informations, in units of each column's reach."""
        found = _evaluate(patterns, betas)
        at, none = list(betas), (0.0, np.zeros(p), np.zeros((p, p)))  # a fit without any risk set to compare
        ll, u, h = (np.array([found.get(f, none)[j] for f in at], float) for j in range(3))
        reach = widths(at)
        return at, ll, u.reshape(len(at), p) / reach, h.reshape(len(at), p, p) / (reach[:, :, None] * reach[:, None, :])

    names, loglik, score, info = evaluate({f: np.zeros(p) for f in counts})
    n, reach, informed = len(names), widths(names), estimable(info)
    null, beta, damping = loglik.copy(), np.zeros((n, p)), np.zeros(n)
    steps, converged = np.zeros(n, int), np.zeros(n, bool)
    keep = informed.copy()
    step = _bounded_step(info, score, damping, keep)
    while (active := np.flatnonzero(~converged & (steps < max_steps))).size:
        _, ll, u, h = evaluate({names[k]: (beta[k] + step[k]) / reach[k] for k in active})
        steps[active] += 1
        with np.errstate(divide="ignore", invalid="ignore"):
            change = np.minimum(np.abs(1 - loglik[active] / ll), np.abs(ll - loglik[active]))
        worse = ~np.isfinite(ll) | ((ll < loglik[active]) & (change > eps))
        good, bad = active[~worse], active[worse]
        # damped steps may gain little far from the top, so the gain that a full step promises counts too
        full, keep[good] = _solve(h[~worse], u[~worse])
        promised = np.einsum("kp,kp->k", u[~worse], full)
        converged[good] = (ll[~worse] == loglik[good]) | ((change[~worse] <= eps) & (promised <= SETTLED))
        beta[good], loglik[good], score[good], info[good] = beta[good] + step[good], ll[~worse], u[~worse], h[~worse]
        damping[good] = np.where(damping[good] > 1e-9, damping[good] / 30, 0.0)
        damping[bad] = np.maximum(10 * damping[bad], LEAST_DAMPING * np.diagonal(info[bad], axis1=1, axis2=2).max(axis=1, initial=0.0))
        left = active[~converged[active]]
        held = damping[left]
        step[left] = _bounded_step(info[left], score[left], held, keep[left])
        damping[left] = held
    rows = []
    pending, keep = _solve(info, score)
    known = keep & (np.abs(pending) <= STILL_MOVING)
    se = np.sqrt(np.diagonal(np.linalg.inv(_kept_only(info, keep)), axis1=1, axis2=2)) if standard_errors and n else None
    beta = beta / reach
    se = None if se is None else se / reach
    for k, fit in enumerate(names):
        for j, term in enumerate(patterns.terms):
            given = bool(known[k, j])
            # a column may lose what information it had as its coefficient grows
            reason = None if given else MONOTONE if informed[k, j] else REDUNDANT
            rows.append(
                (
                    fit, term, float(beta[k, j]) if given else None, float(se[k, j]) if given and se is not None else None,
                    float(null[k]), float(loglik[k]), float(counts[fit][0]), float(counts[fit][1]), int(steps[k]), bool(converged[k]), reason, float(beta[k, j]),
                )
            )
    return spark.createDataFrame(rows, FIT_SCHEMA)


def score_test(df: DataFrame, fits: Sequence[str], stratum: Sequence[str], time: str, event: str, x: str) -> DataFrame:
    """Score, information and chi-square of one covariate at zero.

    With no effect every record has weight one, so the risk sets are counts: records
    collapse to (stratum, time), and the window runs over times within a stratum. The sums
    over tied events are made per cell, in constant time where there are many.
    """
    by = [*fits, *stratum]
    d = F.when(F.col(event) == 1, 1).otherwise(0)
    v = F.col(x).cast("double")
    cells = df.groupBy(*by, time).agg(
        F.count(F.lit(1)).alias("c0"), F.sum(v).alias("c1"), F.sum(v * v).alias("c2"),
        F.sum(d).alias("d"), F.sum(d * v).alias("d1"), F.sum(d * v * v).alias("d2"),
    )
    at_risk = Window.partitionBy(*by).orderBy(F.col(time).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    risk = cells.select(
        *fits, "d", "d1", "d2",
        *[F.sum(c).over(at_risk).alias(s) for c, s in (("c0", "s0"), ("c1", "s1"), ("c2", "s2"))],
    ).where("d > 0")
    schema = risk.select(*fits).schema.add("score", "double").add("information", "double")
    cells = risk.mapInArrow(risksets.tie_scores(list(fits)), schema)
    summed = cells.groupBy(*fits).agg(F.sum("score").alias("score"), F.sum("information").alias("information"))
    return summed.withColumn("chi_square", F.try_divide(F.col("score") * F.col("score"), F.col("information")))


def hazard_table(fits: DataFrame, width: float = 1.96) -> DataFrame:
    """Hazard ratios with intervals: numbers and a formatted label."""
    b, se = F.col("estimate"), F.col("se")
    out = fits.withColumns(
        {
            "mean": F.exp(b), "exp_se": F.exp(se),
            "l95": F.exp(b - F.lit(width) * se), "u95": F.exp(b + F.lit(width) * se),
        }
    )
    parts = [F.round(c, 2).cast("string") for c in ("mean", "l95", "u95")]
    return out.withColumn("label", F.concat(parts[0], F.lit(" ("), parts[1], F.lit("-"), parts[2], F.lit(")")))


def side_by_side(table: DataFrame, by: Sequence[str], endpoint: str, endpoints: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Endpoint results next to each other: columns ``<endpoint>_<value>``."""
    aggs = [
        F.max(F.when(F.col(endpoint) == e, F.col(v))).alias(f"{e}_{v}") for e in endpoints for v in values
    ]
    return table.groupBy(*by).agg(*aggs)


def fitted_totals(patterns: Patterns, estimates: DataFrame) -> DataFrame:
    """What a fitted model expects of each term among its events: (fit, term, expected, n_event).

    Where the score is zero, the sum of a term over the events equals its expected sum, so the
    two sides check a fit without repeating it. ``estimates`` has the rows of ``fit_hazards``. Made
    of joins and windows alone, apart from the fit's own code: risk sets per time, what each
    time adds to the hazard, and back to the records.
    """
    names = F.array(*[F.lit(t) for t in patterns.terms])
    beta = estimates.groupBy("fit").agg(F.map_from_entries(F.collect_list(F.struct("term", "beta"))).alias("_of"))
    beta = beta.select("fit", F.transform(names, lambda t: F.coalesce(F.try_element_at("_of", t), F.lit(0.0))).alias("beta"))
    eta = F.aggregate(F.zip_with("at", "v", lambda a, v: F.get("beta", a) * v), F.lit(0.0), lambda s, v: s + v)
    # as many rows as fits
    rows = patterns.table.join(F.broadcast(beta), "fit").withColumn("risk", F.col("weight") * F.exp(eta)).drop("beta", "large")
    key = ["fit", "stratum"]
    dead = F.col("event") == 1
    cells = rows.groupBy(*key, "time").agg(
        F.sum("risk").alias("s0"), F.sum(F.when(dead, F.col("risk")).otherwise(0.0)).alias("d0"), F.sum(F.when(dead, F.col("weight")).otherwise(0.0)).alias("d")
    )
    at_risk = Window.partitionBy(*key).orderBy(F.desc("time")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = cells.withColumn("s0", F.sum("s0").over(at_risk))
    # ties are removed one after the other, each a further share of the dead
    removed = F.transform(F.sequence(F.lit(0), F.greatest(F.round("d").cast("int") - 1, F.lit(0))), lambda l: l / F.greatest(F.col("d"), F.lit(1.0)))
    inverse = lambda f: 1.0 / (F.col("s0") - f * F.col("d0"))
    total = lambda term: F.when(F.col("d") > 0, F.aggregate(F.transform(removed, term), F.lit(0.0), lambda s, v: s + v)).otherwise(0.0)
    so_far = Window.partitionBy(*key).orderBy("time").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = cells.select(*key, "time", F.sum(total(inverse)).over(so_far).alias("hazard"), total(lambda f: f * inverse(f)).alias("spared"))
    met = rows.join(cells, [*key, "time"])
    share = F.col("risk") * (F.col("hazard") - F.when(dead, F.col("spared")).otherwise(0.0))
    # records of equal covariates first: far fewer rows have their entries listed
    alike = met.groupBy("fit", "at", "v").agg(F.sum(share).alias("share"))
    terms = alike.select("fit", "share", F.inline(F.arrays_zip("at", "v")).alias("pos", "v")).where("v <> 0")
    summed = terms.groupBy("fit", "pos").agg(F.sum(F.col("share") * F.col("v")).alias("expected"))
    counts = rows.groupBy("fit").agg(F.sum(F.when(dead, F.col("weight")).otherwise(0.0)).alias("n_event"))
    every = counts.select("fit", "n_event", F.posexplode(names).alias("pos", "term"))
    return every.join(summed, ["fit", "pos"], "left").select("fit", "term", F.coalesce("expected", F.lit(0.0)).alias("expected"), "n_event")


def stacked(models: Mapping[str, Patterns]) -> Patterns:
    """Patterns of several models as one table, so that their fits share every job of a fit.

    Fits are named ``<model>|<fit>`` and terms by their number; shorter models end in columns
    of zeros, which get no estimates. :func:`unstacked` names the terms again.
    """
    p = max(len(m.terms) for m in models.values())
    # all rows get as many entries; those added are zero
    filled = lambda c, zero: F.concat(c, F.array_repeat(zero, F.lit(most) - F.size(c)))
    most = max(m.entries for m in models.values())
    tables = [
        m.table.withColumns({"fit": F.concat(F.lit(f"{name}|"), "fit"), "at": filled("at", F.lit(0)), "v": filled("v", F.lit(0.0))})
        for name, m in models.items()
    ]
    blocks = [m.blocks.withColumn("fit", F.concat(F.lit(f"{name}|"), "fit")) for name, m in models.items() if m.blocks is not None]
    reach = {name: (*m.reach, *[1.0] * (p - len(m.terms))) for name, m in models.items()}
    return Patterns(
        reduce(DataFrame.unionByName, tables), tuple(str(k) for k in range(p)), reach, reduce(DataFrame.unionByName, blocks) if blocks else None, most
    )


def unstacked(results: DataFrame, models: Mapping[str, Patterns]) -> DataFrame:
    """Rows per (fit, term) of stacked models with ``model`` and the terms' names."""
    names = F.create_map(*[v for name, m in models.items() for v in (F.lit(name), F.array(*[F.lit(t) for t in m.terms]))])
    model = F.substring_index("fit", "|", 1)
    out = results.withColumns({"model": model, "fit": F.expr("substring(fit, instr(fit, '|') + 1)"), "term": F.get(F.element_at(names, model), F.col("term").cast("int"))})
    return out.where(F.col("term").isNotNull())
