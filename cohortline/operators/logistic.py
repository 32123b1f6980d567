"""Binomial models on collapsed records."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import cloudpickle
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.operators import risksets
from cohortline.operators.design import Term, factor_levels, term_columns
from cohortline.operators.hazard import _kept_only, estimable
from cohortline.operators.joins import join_counted
from cohortline.operators.replicates import packed, unpacked
from cohortline.sources.storage import cut_lineage

# Iteration limit and tolerance of the binomial fits.
MAX_STEPS = 25
TOLERANCE = 1e-8
# A step that lowers the likelihood is halved this often at most.
HALVINGS = 30
# Vectors that the driver adds up itself; more are first added up by tasks.
FEW_PARTS = 16


@dataclass(frozen=True)
class BinomialModel:
    """A fitted model: its terms, the levels of its factors (the first is the reference) and coefficients.

    The levels of one plain factor, the one with most of them, are kept apart (``wide``, a coefficient for each
    but the reference in ``of_level``): a record sets one of these columns at most, so their part
    of the information is a diagonal, however many levels there are. ``beta`` has the constant and the other columns.
    """

    terms: tuple[Term, ...]
    levels: Mapping[str, list[str]]
    wide: Term | None
    beta: np.ndarray
    of_level: np.ndarray
    prediction: str = "prediction"
    steps: int = 0
    converged: bool = False

    def entries(self, table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Column numbers and values of the records, the level of the wide factor (-1: reference), and whether all is known."""
        n = table.num_rows
        at, v, level, known = [np.zeros(n, np.int32)], [np.ones(n)], np.full(n, -1), np.ones(n, bool)
        codes, numbers, first = {}, {}, 1
        for f, own in self.levels.items():
            found = pa.chunked_array([table.column(f"_f_{f}")] if isinstance(table, pa.RecordBatch) else table.column(f"_f_{f}").chunks)
            codes[f] = pa.compute.index_in(found, value_set=pa.array(own, pa.string())).fill_null(-1).to_numpy().astype(np.int64)
            known &= codes[f] >= 0
        for t in self.terms:
            if t.number and t.number not in numbers:
                numbers[t.number] = table.column(f"_n_{t.number}").to_numpy(zero_copy_only=False).astype(float)
                known &= ~np.isnan(numbers[t.number])
        for t in self.terms:
            if t == self.wide:
                level = codes[t.factor] - 1
            elif t.factor is None:
                at.append(np.full(n, first, np.int32))
                v.append(numbers[t.number])
                first += 1
            else:
                code = codes[t.factor] - (t.number is None)
                at.append(np.where(code >= 0, first + code, 0).astype(np.int32))
                v.append(np.where(code >= 0, numbers[t.number] if t.number else 1.0, 0.0))
                first += len(self.levels[t.factor]) - (t.number is None)
        return np.stack(at, axis=1), np.stack(v, axis=1), level, known

    def predictor(self, at: np.ndarray, v: np.ndarray, level: np.ndarray) -> np.ndarray:
        return (self.beta[at] * v).sum(axis=1) + np.append(self.of_level, 0.0)[level]


def _model(terms: Sequence[Term], levels: Mapping[str, list[str]], prediction: str) -> BinomialModel:
    plain = [t for t in terms if t.factor and not t.number]
    wide = max(plain, key=lambda t: len(levels[t.factor]), default=None)
    width = {t: 1 if t.factor is None else len(levels[t.factor]) - (t.number is None) for t in terms}
    terms = tuple(dict.fromkeys(terms))
    beta = np.zeros(1 + sum(width[t] for t in terms if t != wide))
    return BinomialModel(terms, levels, wide, beta, np.zeros(max(width[wide], 0) if wide else 0), prediction)


def _read_columns(terms: Sequence[Term]) -> list[Column]:
    """The columns that ``BinomialModel.entries`` reads."""
    factors, numbers = (dict.fromkeys(c for c in names if c) for names in ([t.factor for t in terms], [t.number for t in terms]))
    return [*(F.col(c).cast("string").alias(f"_f_{c}") for c in factors), *(F.col(c).cast("double").alias(f"_n_{c}") for c in numbers)]


def _laid_out(model: BinomialModel):
    """Arrow batches of patterns to compressed tables of their entries, outcome and weight."""

    def entries(batches):
        for batch in batches:
            at, v, level, known = model.entries(batch)
            keep = np.flatnonzero(known)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(c[keep].ravel()), c.shape[1]) for c in (at, v)]
            own = [batch.column(c).take(pa.array(keep)) for c in ("_y", "_weight")]
            yield pa.RecordBatch.from_arrays([*lists, pa.array(level[keep].astype(np.int32)), *own], names=["at", "v", "level", "y", "weight"])

    return lambda batches: packed(entries(batches))


def _vector(model: BinomialModel) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Zeros for the sums of a step, and the parts of that vector."""
    q, wide = len(model.beta), len(model.of_level)
    shapes = {"loglik": (1,), "score": (q,), "info": (q, q), "level_score": (wide,), "level_info": (wide,), "cross": (wide, q)}
    total = np.zeros(sum(int(np.prod(s)) for s in shapes.values()))
    parts, first = {}, 0
    for name, shape in shapes.items():
        size = int(np.prod(shape))
        parts[name] = total[first : first + size].reshape(shape)
        first += size
    return total, parts


def _likelihood(model: BinomialModel):
    """Arrow batches of laid-out patterns to one vector of log likelihood, score and information."""

    def run(batches: Iterator[pa.RecordBatch]):
        total, sums = _vector(model)
        q = len(model.beta)
        for batch in batches:
            for k in range(batch.num_rows):  # one compressed table at a time
                table = unpacked([batch.slice(k, 1)])
                at, v = risksets.entries_of(table)
                level, y, weight = (table.column(c).to_numpy() for c in ("level", "y", "weight"))
                eta = model.predictor(at, v, level)
                small = np.exp(-np.abs(eta))
                mean = np.where(eta >= 0, 1.0, small) / (1 + small)
                sums["loglik"] += (weight * (y * eta - np.maximum(eta, 0.0) - np.log1p(small))).sum()
                rest, spread = weight * (y - mean), weight * small / (1 + small) ** 2
                rows = max(1, 2_000_000 // q)
                for lo in range(0, len(y), rows):
                    cut = slice(lo, lo + rows)
                    x = risksets.dense((at[cut], v[cut]), q)
                    spread_x = spread[cut, None] * x
                    sums["score"] += rest[cut] @ x
                    sums["info"] += x.T @ spread_x
                    order = np.argsort(level[cut], kind="stable")
                    order = order[level[cut][order] >= 0]
                    if len(order):
                        own = level[cut][order]
                        start = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                        for name, values in (("level_score", rest[cut]), ("level_info", spread[cut]), ("cross", spread_x)):
                            sums[name][own[start]] += np.add.reduceat(values[order], start, axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    return run


def _added(batches: Iterator[pa.RecordBatch]):
    total = None
    for batch in batches:
        for data in batch.column("sums"):
            own = np.frombuffer(data.as_buffer())
            total = own.copy() if total is None else total + own
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])


def _evaluate(model: BinomialModel, patterns: DataFrame, parts: int) -> dict[str, np.ndarray]:
    """Log likelihood, score and information at the model's coefficients; a vector for each of a few tasks reaches the driver."""
    found = patterns.mapInArrow(_likelihood(model), "sums binary")
    if parts > FEW_PARTS:
        found = found.repartition(int(np.ceil(np.sqrt(parts)))).mapInArrow(_added, "sums binary")
    total, sums = _vector(model)
    for row in found.toLocalIterator():
        total += np.frombuffer(row["sums"])
    return sums


def _newton(sums: Mapping[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A Newton step; levels of the wide factor are eliminated first. Columns without information stay."""
    has = sums["level_info"] > 0
    own, score, cross = sums["level_info"][has], sums["level_score"][has], sums["cross"][has]
    root = cross / np.sqrt(own)[:, None]
    info, target = sums["info"] - root.T @ root, sums["score"] - cross.T @ (score / own)
    scale = np.sqrt(np.diagonal(sums["info"]))
    scale = np.where(scale > 0, scale, 1.0)
    info = info / np.outer(scale, scale)
    keep = estimable(info)
    step = np.linalg.solve(_kept_only(info[None], keep[None])[0], np.where(keep, target / scale, 0.0)) / scale
    of_level = np.zeros(len(has))
    of_level[has] = (score - cross @ step) / own
    return step, of_level


def fit_binomial(df: DataFrame, outcome: str, terms: Sequence[Term], prediction: str = "prediction") -> BinomialModel:
    """Logistic regression of a 0/1 outcome by Newton steps, that is reweighted least squares.

    Records with equal variables are one weighted record, laid out once, so a step passes over
    patterns instead of records and is one job. The alphabetically first level of a factor is its
    reference. The fit ends when the deviance changes by less than ``TOLERANCE`` of it, or after ``MAX_STEPS``.
    """
    spark, columns = df.sparkSession, term_columns(terms)
    collapsed = (
        df.select(F.col(outcome).cast("double").alias("_y"), *columns)
        .where(F.col("_y").isNotNull())
        .dropna(subset=columns)
        .groupBy("_y", *columns)
        .agg(F.count(F.lit(1)).cast("double").alias("_weight"))
        .persist()
    )
    try:
        levels = {f: sorted(own) for f, own in factor_levels(collapsed, terms, {}).items()}
        model = _model(terms, levels, prediction)
        parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        rows = collapsed.select("_y", "_weight", *_read_columns(terms)).repartition(parts, "_y", *columns)
        if model.wide:  # a level's records next to each other
            rows = rows.sortWithinPartitions(f"_f_{model.wide.factor}")
        patterns = cut_lineage(rows.mapInArrow(_laid_out(model), "data binary"))
    finally:
        collapsed.unpersist()
    sums, steps, converged = _evaluate(model, patterns, parts), 0, False
    while not converged and steps < MAX_STEPS:
        move, steps = _newton(sums), steps + 1
        for k in range(HALVINGS):
            tried = replace(model, beta=model.beta + move[0] / 2**k, of_level=model.of_level + move[1] / 2**k)
            new = _evaluate(tried, patterns, parts)
            deviance, before = -2 * new["loglik"][0], -2 * sums["loglik"][0]
            change = (before - deviance) / (abs(deviance) + 0.1)
            if change >= -TOLERANCE:
                break
        model, sums, converged = tried, new, bool(abs(change) < TOLERANCE)
    return replace(model, steps=steps, converged=converged)


def predict(model: BinomialModel, df: DataFrame, prediction: str = "prediction") -> DataFrame:
    """Predicted probability on every record; no record is lost.

    Records with a NULL variable, or with a level that the fit has not seen, get NULL.
    Only distinct patterns of the variables are scored, and joined back.
    """
    columns = term_columns(model.terms)
    patterns = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_records"))

    def scored(batches):
        for batch in batches:
            at, v, level, known = model.entries(batch)
            eta = model.predictor(at, np.where(known[:, None], v, 0.0), np.where(known, level, -1))
            small = np.exp(-np.abs(eta))
            values = pa.array(np.where(eta >= 0, 1.0, small) / (1 + small), mask=~known)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), values], names=[*kept, model.prediction])

    kept = [*columns, "_records"]
    schema = patterns.select(*kept).schema.add(model.prediction, "double")
    found = patterns.select(*kept, *_read_columns(model.terms)).mapInArrow(scored, schema).where(F.col(model.prediction).isNotNull())
    return join_counted(df, found, columns, "_records").select(*df.columns, prediction)


def term_totals(df: DataFrame, terms: Sequence[Term], value: str) -> DataFrame:
    """(term, n, total): records and sum of term × ``value``, for every level of every term and the whole table.

    For a fitted model the totals of the predictions equal those of the outcome (its score
    equations). Records with an unknown variable, which no fit uses, are left out.
    """
    entries = [F.struct(F.lit("all").alias("term"), F.lit(1.0).alias("x"))]
    for t in terms:
        level = F.col(t.factor).cast("string") if t.factor else F.lit("")
        label = F.concat(F.lit(t.factor or ""), level, F.lit(f":{t.number}" if t.factor and t.number else t.number or ""))
        entries.append(F.struct(label.alias("term"), (F.col(t.number).cast("double") if t.number else F.lit(1.0)).alias("x")))
    rows = df.dropna(subset=[*term_columns(terms), value]).select(value, F.inline(F.array(*entries)))
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("x") * F.col(value)).alias("total"))


def roc_auc(scored: DataFrame, outcome: str, score: str) -> DataFrame:
    """Area under the ROC curve; equal scores count half. Records collapse by score first."""
    weighted = (
        scored.select(F.col(outcome).cast("double").alias("label"), F.col(score).alias("score"))
        .groupBy("label", "score").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    )
    evaluator = BinaryClassificationEvaluator(
        rawPredictionCol="score", labelCol="label", weightCol="weight", metricName="areaUnderROC", numBins=0
    )
    value = evaluator.evaluate(weighted)
    return scored.sparkSession.createDataFrame([(float(value),)], "auc double")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
