"""Text quality by a factorisation machine, in numpy.

Inputs are hashed words, statistics of the text's structure, and its recorded length. Each
input has a weight and a short vector; two inputs of a text add the product of their values
and of their vectors. All pairs together are half of (square of the sum less sum of the
squares) in each dimension, so a text is scored in time linear in its inputs.
"""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.llm.bpe import slices
from cohortline.llm.common import text_or_empty, travels

# Hash buckets of words, length of the vectors, bins of each statistic.
WORD_BUCKETS, RANK, BINS = 1 << 17, 8, 8
# Labelled rows that the model is fitted on: the bound of each label, and of a text's bytes.
ROWS, TEXT_BYTES = 2000, 1 << 15
# Every so many sampled texts places the threshold instead of being learned from.
CHECKED = 5
EPOCHS, BATCH, RATE, SHRINK, SEED = 12, 64, 0.02, 1e-4, 11
FOLDS, THRESHOLD = 5, 0.3
# Words whose bucket a task remembers.
REMEMBERED = 300_000
# A word, or a run of marks.
TOKEN = re.compile(r"\w+|[^\w\s]+")
# Classes of bytes: other white space and controls, blank, line end, digit, capital, small, mark, beyond ASCII.
CLASSES = 8
CLASS = np.zeros(256, np.uint8)
CLASS[33:127], CLASS[128:] = 6, 7
for _k, _of in ((1, b" "), (2, b"\n"), (3, b"0123456789"), (4, bytes(range(65, 91))), (5, bytes(range(97, 123)))):
    CLASS[list(_of)] = _k


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def segment_sums(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums of the runs of ``values`` between ``cuts`` (runs may be empty)."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64)
    np.cumsum(values, axis=0, out=total[1:])
    return np.diff(total[cuts], axis=0)


class Inputs:
    """What the model reads of texts: sparse words and dense statistics."""

    def __init__(self, texts: list[str], lengths: list[int | None], bucket: dict[str, int]):
        n = len(texts)
        found = [TOKEN.findall(t.lower()) for t in texts]
        count = np.array([len(w) for w in found], np.int64)
        for w in {w for words in found for w in words}.difference(bucket):
            bucket[w] = crc32(w.encode()) % WORD_BUCKETS
        ids = np.array([bucket[w] for words in found for w in words], np.int64)
        keys, times = np.unique(np.repeat(np.arange(n), count) * WORD_BUCKETS + ids, return_counts=True)
        self.cuts = np.searchsorted(keys, np.arange(n + 1) * WORD_BUCKETS)
        self.ids = keys % WORD_BUCKETS
        value = 1 + np.log(times)
        norm = np.sqrt(segment_sums(value * value, self.cuts))
        distinct = np.diff(self.cuts)
        self.values = (value / np.repeat(np.where(norm > 0, norm, 1), distinct)).astype(np.float32)
        self.stats = self.structure(texts, lengths, found, count, distinct, times)

    def structure(self, texts, lengths, found, count, distinct, times) -> np.ndarray:
        """Statistics (text, kind), each bounded or on a logarithmic scale."""
        raw = [t.encode() for t in texts]
        size = np.array([len(r) for r in raw], np.int64)
        cuts = np.append(0, np.cumsum(size))
        kinds = CLASS[np.frombuffer(b"".join(raw), np.uint8)]
        share = np.stack([np.diff(np.append(0, np.cumsum(kinds == c))[cuts]) for c in range(CLASSES)], axis=1) / np.maximum(size, 1)[:, None]
        most = np.zeros(len(texts))
        full = np.flatnonzero(distinct)
        if len(full):
            most[full] = np.maximum.reduceat(times, self.cuts[full])
        lines = [t.split("\n") for t in texts]
        n_lines = np.array([len(part) for part in lines])
        repeated = 1 - np.array([len(set(part)) for part in lines]) / n_lines
        marks = np.array([sum(not w[0].isalnum() and w[0] != "_" for w in words) for words in found])
        words, chars = np.maximum(count, 1), np.array([len(t) for t in texts])
        told = np.array([np.nan if v is None else float(v) for v in lengths])
        return np.column_stack([
            share, np.log1p(size), np.log1p(count), np.log1p(chars / words), distinct / words, most / words, marks / words,
            np.log1p(size / n_lines), repeated, np.log1p(np.maximum(told, 0)), np.clip(told - chars, -1000, 1000),
        ])


class Model:
    """Weights and vectors of words and of the bins of each statistic."""

    def __init__(self, stats: np.ndarray):
        rng = np.random.default_rng(SEED)
        # bins between quantiles of the sample; a statistic that is not known has a bin of its own
        self.edges = np.nan_to_num(np.nanquantile(np.column_stack([stats.T, np.zeros(stats.shape[1])]), np.arange(1, BINS) / BINS, axis=1).T)
        self.size = WORD_BUCKETS + len(self.edges) * (BINS + 1)
        self.bias, self.weight = 0.0, np.zeros(self.size, np.float32)
        self.vector = (0.05 * rng.standard_normal((self.size, RANK))).astype(np.float32)

    def rows(self, inputs: Inputs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(input numbers, values, cuts) of texts: their words, then one bin of each statistic."""
        n, kinds = inputs.stats.shape
        bins = np.stack([np.searchsorted(e, s, side="right") for e, s in zip(self.edges, inputs.stats.T, strict=True)], axis=1)
        bins = np.where(np.isnan(inputs.stats), BINS, bins) + np.arange(kinds) * (BINS + 1) + WORD_BUCKETS
        where = np.repeat(inputs.cuts[1:], kinds)
        ids = np.insert(inputs.ids, where, bins.ravel())
        values = np.insert(inputs.values, where, np.float32(1 / np.sqrt(kinds)))
        return ids, values, inputs.cuts + np.arange(n + 1) * kinds

    def logits(self, ids: np.ndarray, values: np.ndarray, cuts: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """All pairs at once: half of the squared sums less the sums of squares."""
        scaled = self.vector[ids] * values[:, None]
        sums = segment_sums(scaled, cuts)
        squares = segment_sums(np.einsum("nk,nk->n", scaled, scaled), cuts)
        if keep is not None:
            keep.update(scaled=scaled, sums=sums)
        return self.bias + segment_sums(self.weight[ids] * values, cuts) + ((sums * sums).sum(axis=1) - squares) / 2

    def gradients(self, ids: np.ndarray, values: np.ndarray, cuts: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """Of the weighted mean cross-entropy: of the bias, and of the weight and vector of each distinct input."""
        keep: dict = {}
        up = (sigmoid(self.logits(ids, values, cuts, keep)) - target) * weight / weight.sum()
        own = np.repeat(up, np.diff(cuts)) * values
        distinct, at = np.unique(ids, return_inverse=True)
        of_vector = own[:, None] * (np.repeat(keep["sums"], np.diff(cuts), axis=0) - keep["scaled"])
        grads = np.zeros((len(distinct), RANK))
        np.add.at(grads, at, of_vector)
        return float(up.sum()), distinct, np.bincount(at, own, len(distinct)), grads


def taken(rows: tuple[np.ndarray, np.ndarray, np.ndarray], which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Some of the texts of :meth:`Model.rows`."""
    ids, values, cuts = rows
    size = np.diff(cuts)[which]
    out = np.append(0, np.cumsum(size))
    at = np.arange(out[-1]) + np.repeat(cuts[which] - out[:-1], size)
    return ids[at], values[at], out


def best_cut(logit: np.ndarray, label: np.ndarray) -> float:
    """The cut with the least sum of both labels' error rates, in the middle of its widest gap; 0 for one label."""
    if label.min(initial=1) == label.max(initial=0):
        return 0.0
    order = np.argsort(logit, kind="stable")
    value, y = logit[order], label[order]
    wrong = np.cumsum(y)[:-1] / y.sum() + (1 - y)[::-1].cumsum()[::-1][1:] / (1 - y).sum()
    gaps = np.where(wrong <= wrong.min() + 1e-12, value[1:] - value[:-1], -1.0)
    k = int(np.argmax(gaps))
    return float(value[k] + value[k + 1]) / 2


def fit(texts: list[str], lengths: list[int | None], labels: list[int]) -> Model:
    """Fit on labelled texts by Adam, both labels weighing the same.

    One text in ``CHECKED`` is not learned from: these place the score of ``THRESHOLD`` where it
    parts the labels best. Inputs that no learned text has get neither weight nor vector.
    """
    label = np.array(labels, np.float64)
    inputs = Inputs(texts, lengths, {})
    model, rng = Model(inputs.stats), np.random.default_rng(SEED)
    rows = model.rows(inputs)
    learned = np.flatnonzero(np.arange(len(label)) % CHECKED != 0)
    checked = np.flatnonzero(np.arange(len(label)) % CHECKED == 0)
    if len(set(labels[k] for k in learned)) < 2 or len(set(labels[k] for k in checked)) < 2:  # too few: learn and check on all
        learned = checked = np.arange(len(label))
    share = np.array([(label[learned] == y).mean() for y in (0, 1)])
    cost = 1 / np.maximum(share, 1e-9)[label.astype(int)]
    state = [np.zeros_like(v, np.float32) for v in (model.weight, model.weight, model.vector, model.vector)]
    step = 0
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(learned), -(-len(learned) // BATCH)):
            step += 1
            of_bias, ids, of_weight, of_vector = model.gradients(*taken(rows, part), label[part], cost[part])
            model.bias -= RATE * of_bias
            for param, grad, m, v in ((model.weight, of_weight, *state[:2]), (model.vector, of_vector, *state[2:])):
                grad = grad + SHRINK * param[ids]
                m[ids] += 0.1 * (grad - m[ids])
                v[ids] += 0.01 * (grad * grad - v[ids])
                param[ids] -= RATE * (m[ids] / (1 - 0.9**step)) / (np.sqrt(v[ids] / (1 - 0.99**step)) + 1e-6)
    seen = np.zeros(model.size, bool)
    seen[taken(rows, learned)[0]] = True
    model.weight[~seen], model.vector[~seen] = 0, 0
    cut = best_cut(model.logits(*taken(rows, checked)), label[checked])
    model.bias += float(np.log(THRESHOLD / (1 - THRESHOLD))) - cut
    return model


class Scorer:
    """Scores texts, remembering the buckets of words it has met."""

    def __init__(self, model: Model):
        self.model, self.bucket = model, {}

    def scores(self, texts: list[str], lengths: list[int | None]) -> np.ndarray:
        if len(self.bucket) > REMEMBERED:
            self.bucket = {}
        return sigmoid(self.model.logits(*self.model.rows(Inputs(texts, lengths, self.bucket))))


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from; NULL doc_id too."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def read(docs: DataFrame) -> DataFrame:
    """doc_id, text and recorded length (NULL where the table has none)."""
    told = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select("doc_id", text_or_empty().alias("text"), told.alias("told"))


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> tuple[list[str], list[int | None], list[int]]:
    """At most ``rows`` texts of each label that are not held out, in hash order of doc_id."""
    known = labels.where(~held_out(F.col("doc_id")) & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    order = known.select("doc_id", "quality", F.xxhash64("doc_id").alias("h"))
    picks = [order.where(F.col("quality") == y).orderBy("h", "doc_id").limit(rows) for y in (0, 1)]
    ids = picks[0].unionByName(picks[1])  # at most 2 * rows, so it may be broadcast
    texts = read(docs).where(F.octet_length("text") <= TEXT_BYTES).join(F.broadcast(ids), "doc_id")
    # one text of each id, so no more than 2 * rows reach the driver
    picked = texts.groupBy("doc_id").agg(F.min(F.struct("text", "told")).alias("t"), F.min("quality").alias("quality")).collect()
    picked.sort(key=lambda r: r.doc_id)
    return [r.t.text for r in picked], [r.t.told for r in picked], [int(r.quality) for r in picked]


def score_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Quality of every whole text: doc_id, held_out, score, predicted (score of ``THRESHOLD`` or more).

    The model is fitted by the driver on at most ``ROWS`` labelled texts of each label (of at most
    ``TEXT_BYTES`` bytes) whose crc32 of the doc_id, modulo five, is not 0, and is broadcast (its
    size is fixed). Inputs are the text and ``n_chars``, where there is one.

    NULL and empty texts have statistics but no words. Rows are independent: repeated rows
    score alike, hot groups do not matter, an empty table gives an empty result. Labels other
    than 0 and 1 are left out, a doc_id with both counts as 0; of texts that share a labelled
    doc_id the least is learned from. Without labels every score is 0.
    """
    texts, lengths, marks = training_sample(docs, labels)
    model = docs.sparkSession.sparkContext.broadcast(fit(texts, lengths, marks)) if texts else None

    def run(batches):
        scorer = Scorer(model.value) if model is not None else None
        for batch in batches:
            for part in slices(batch, "text"):
                values = scorer.scores(part.column("text").to_pylist(), part.column("told").to_pylist()) if scorer else np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(values, pa.float64())], names=["doc_id", "score"])

    scored = read(docs).mapInArrow(run, docs.select("doc_id").schema.add("score", "double"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


travels(__name__)
