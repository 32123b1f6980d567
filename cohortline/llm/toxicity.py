"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word is two inputs: itself and its character grams. Each has a learned vector and the
evidence that labelled texts give for it. The network reads windows of words both ways,
attention pools its states, and a text is as toxic as its most toxic window.
"""

from __future__ import annotations

import re
from array import array
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.llm.bpe import slices
from cohortline.llm.common import text_or_empty, travels

# Words of a window, and from one window to the next: windows overlap by half.
WINDOW, STRIDE = 32, 16
# Hash buckets of words and of character grams, lengths of grams, size of learned vectors.
WORD_BUCKETS, GRAM_BUCKETS, GRAMS, EMBED = 1 << 17, 1 << 18, (3, 4, 5), 4
# Inputs of the network for each word; units of each direction; units of the attention.
INPUTS, HIDDEN, ATTEND = 2 + 2 * EMBED, 8, 8
# Labelled rows that the model is fitted on: the bound of each class, and of a text's bytes.
TOXIC_ROWS, CLEAN_ROWS, TEXT_BYTES = 800, 1600, 1 << 16
STEPS, BATCH, RATE, SEED = 300, 64, 0.01, 7
# Rows whose crc32 is 0 modulo this are held out.
FOLDS = 5
# Labelled texts of average rate that count as already seen for every word and gram.
PRIOR = 5.0
# Windows scored together; words that a task remembers.
LANES, REMEMBERED = 4096, 150_000
WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def grams_of(word: str) -> list[int]:
    """Hashes of the character grams of a word."""
    marked = f"<{word}>".encode()
    return [crc32(marked[k : k + n]) for n in GRAMS for k in range(max(1, len(marked) - n + 1))]


def two_buckets(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """A bucket in each of two tables that lie end to end, from the low and from the high bits."""
    return hashes % buckets, buckets + (hashes >> 32 - buckets.bit_length() + 1)


class Words:
    """Hashes of distinct words: ``word`` (one each) and of their ``grams`` (ragged, by ``at``)."""

    def __init__(self, words: list[str]):
        self.word = np.array([crc32(w.encode()) for w in words], np.uint32)
        flat, counts = array("I"), array("I")
        for w in words:
            grams = grams_of(w)
            counts.append(len(grams))
            flat.extend(grams)
        self.count = np.array(counts, np.int64)
        self.at = np.cumsum(self.count) - self.count
        self.grams = np.array(flat, np.uint32)

    def take(self, numbers: np.ndarray) -> Words:
        """The given words of the table."""
        out = object.__new__(Words)
        out.word, out.count = self.word[numbers], self.count[numbers]
        out.at = np.cumsum(out.count) - out.count
        out.grams = self.grams[np.arange(out.count.sum()) + np.repeat(self.at[numbers] - out.at, out.count)]
        return out

    def means(self, table: np.ndarray) -> np.ndarray:
        return np.add.reduceat(table[self.grams % GRAM_BUCKETS], self.at) / self.count[:, None] if len(self.at) else np.zeros((0, EMBED), np.float32)


def windows_of(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, end word) of all overlapping windows of texts laid end to end.

    Every text has one window at least; an empty text has an empty one.
    """
    n = np.maximum(1, -(-(lengths - STRIDE) // STRIDE))
    begin = np.cumsum(lengths) - lengths
    text = np.repeat(np.arange(len(lengths)), n)
    start = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * STRIDE + begin[text]
    return text, start, np.minimum(start + WINDOW, (begin + lengths)[text])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters, forward pass and gradients."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"Wa": draw(2 * HIDDEN, ATTEND), "ba": np.zeros(ATTEND, np.float32), "v": draw(ATTEND), "wo": draw(2 * HIDDEN), "bo": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": draw(INPUTS, 3 * HIDDEN), f"U{d}": draw(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}

    def inputs(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """The inputs' share of the gates, for each direction."""
        return {d: x @ self.p[f"W{d}"] + self.p[f"c{d}"] for d in "fb"}

    def run(self, direction: str, gates: np.ndarray, which: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (window, place, unit) of one direction; ``which`` picks the rows of ``gates``."""
        h = np.zeros((len(which), HIDDEN), np.float32)
        states = np.empty((*which.shape, HIDDEN), np.float32)
        recur = self.p[f"U{direction}"]
        places = range(which.shape[1])
        for t in places if direction == "f" else reversed(places):
            own, back = gates[which[:, t]], h @ recur
            zr = sigmoid(own[:, : 2 * HIDDEN] + back[:, : 2 * HIDDEN])
            z, r, inner = zr[:, :HIDDEN], zr[:, HIDDEN:], back[:, 2 * HIDDEN :]
            new = np.tanh(own[:, 2 * HIDDEN :] + r * inner)
            m = mask[:, t, None]
            nxt = h + m * (1 - z) * (new - h)
            if keep is not None:
                keep.append((t, h, z, r, inner, new, m))
            h = nxt
            states[:, t] = h
        return states

    def score(self, gates: dict[str, np.ndarray], which: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logit of each window."""
        p = self.p
        tape = {d: [] if keep is not None else None for d in "fb"}
        states = np.concatenate([self.run(d, gates[d], which, mask, tape[d]) for d in "fb"], axis=2)
        hidden = np.tanh(states @ p["Wa"] + p["ba"])
        energy = np.where(mask > 0, hidden @ p["v"], -1e9)
        weight = np.exp(energy - energy.max(axis=1, keepdims=True)) * mask
        weight /= np.maximum(weight.sum(axis=1, keepdims=True), 1e-9)
        pooled = np.einsum("bt,bth->bh", weight, states)
        if keep is not None:
            keep.update(tape=tape, states=states, hidden=hidden, weight=weight, pooled=pooled)
        return pooled @ p["wo"] + p["bo"][0]

    def gradients(self, x: np.ndarray, which: np.ndarray, mask: np.ndarray, target: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the mean cross-entropy: of the parameters, and of the input rows ``x``."""
        p, keep, gates = self.p, {}, self.inputs(x)
        logit = self.score(gates, which, mask, keep)
        up = (sigmoid(logit) - target) / len(target)
        g = {"wo": keep["pooled"].T @ up, "bo": up.sum(keepdims=True)}
        d_pooled = up[:, None] * p["wo"]
        d_states = keep["weight"][:, :, None] * d_pooled[:, None]
        d_weight = np.einsum("bth,bh->bt", keep["states"], d_pooled)
        d_energy = keep["weight"] * (d_weight - (keep["weight"] * d_weight).sum(axis=1, keepdims=True))
        g["v"] = np.einsum("bt,bta->a", d_energy, keep["hidden"])
        d_hidden = d_energy[:, :, None] * p["v"] * (1 - keep["hidden"] ** 2)
        g["Wa"], g["ba"] = np.einsum("bth,bta->ha", keep["states"], d_hidden), d_hidden.sum(axis=(0, 1))
        d_states = d_states + d_hidden @ p["Wa"].T
        dx = np.zeros_like(x)
        for k, d in enumerate("fb"):
            d_gates, g[f"U{d}"] = np.zeros_like(gates[d]), np.zeros_like(p[f"U{d}"])
            dh = np.zeros((len(which), HIDDEN), np.float32)
            for t, h, z, r, inner, new, m in reversed(keep["tape"][d]):
                dh = dh + d_states[:, t, k * HIDDEN : (k + 1) * HIDDEN]
                step = m * dh
                d_new = step * (1 - z) * (1 - new**2)
                d_z = step * (h - new) * z * (1 - z)
                d_r = d_new * inner * r * (1 - r)
                own = np.concatenate([d_z, d_r, d_new], axis=1)
                back = np.concatenate([d_z, d_r, d_new * r], axis=1)
                np.add.at(d_gates, which[:, t], own)
                g[f"U{d}"] += h.T @ back
                dh = dh - step * (1 - z) + back @ p[f"U{d}"].T
            g[f"W{d}"], g[f"c{d}"] = x.T @ d_gates, d_gates.sum(axis=0)
            dx += d_gates @ p[f"W{d}"].T
        return g, dx


class Model:
    """A fitted classifier of texts."""

    def __init__(self):
        rng = np.random.default_rng(SEED)
        self.net = Network()
        self.word_vectors = (0.1 * rng.standard_normal((WORD_BUCKETS, EMBED))).astype(np.float32)
        self.gram_vectors = (0.1 * rng.standard_normal((GRAM_BUCKETS, EMBED))).astype(np.float32)
        self.seen = {kind: np.zeros((2, 2 * n), np.float32) for kind, n in (("word", WORD_BUCKETS), ("gram", GRAM_BUCKETS))}
        self.rate = 0.5

    def evidence(self, kind: str, hashes: np.ndarray, without: int | None = None) -> np.ndarray:
        """Shrunk log-odds of toxic texts among those that hold a word or gram, over the average.

        Texts are counted in two hash tables, and the smaller count is taken. ``without``
        leaves out one text of that label: the one that is being learned from.
        """
        low, high = two_buckets(hashes, WORD_BUCKETS if kind == "word" else GRAM_BUCKETS)
        clean, toxic = (np.minimum(seen[low], seen[high]) for seen in self.seen[kind])
        if without is not None:
            clean, toxic = (clean, toxic - 1) if without else (clean - 1, toxic)
        toxic, clean = np.maximum(toxic, 0) + PRIOR * self.rate, np.maximum(clean, 0) + PRIOR * (1 - self.rate)
        return ((np.log(toxic / clean) - np.log(self.rate / (1 - self.rate))) / 2).astype(np.float32)

    def features(self, words: Words, without: int | None = None) -> np.ndarray:
        if not len(words.word):
            return np.zeros((0, INPUTS), np.float32)
        grams = np.maximum.reduceat(self.evidence("gram", words.grams, without), words.at)
        own = np.stack([self.evidence("word", words.word, without), grams], axis=1)
        return np.concatenate([own, self.word_vectors[words.word % WORD_BUCKETS], words.means(self.gram_vectors)], axis=1).astype(np.float32)

    def count(self, texts: list[Words], labels: np.ndarray) -> None:
        self.rate = float((labels.sum() + 0.5) / (len(labels) + 1))
        for words, label in zip(texts, labels.tolist(), strict=True):
            self.seen["word"][label][np.unique(np.concatenate(two_buckets(words.word, WORD_BUCKETS)))] += 1
            self.seen["gram"][label][np.unique(np.concatenate(two_buckets(words.grams, GRAM_BUCKETS)))] += 1

    def logits(self, gates: dict[str, np.ndarray], ids: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Logits of windows of a run of word numbers (``ids`` index the rows of ``gates``)."""
        out = np.empty(len(start), np.float32)
        padded = np.append(ids, 0)
        for k in range(0, len(start), LANES):
            at = start[k : k + LANES, None] + np.arange(WINDOW)
            mask = at < end[k : k + LANES, None]
            out[k : k + LANES] = self.net.score(gates, padded[np.where(mask, at, len(ids))], mask.astype(np.float32))
        return out


def fit(texts: list[str], labels: list[int]) -> Model:
    """Fit on labelled texts, each learned from by its most toxic window (clean ones by one more).

    Evidence of a text leaves out the text itself, so that rare words of the sample do not
    look certain. Windows are chosen anew in every epoch, first by evidence, then by score;
    epochs go on for ``STEPS`` steps. At last the score of one half is put where it best parts
    the sample.
    """
    model, rng, label = Model(), np.random.default_rng(SEED), np.array(labels, np.int64)
    number: dict[str, int] = {}
    ids = [np.array([number.setdefault(w, len(number)) for w in words_of(t)], np.int64) for t in texts]
    table = Words(list(number))
    model.count([table.take(np.unique(x)) for x in ids], label)
    # the texts of a label lie end to end, as do their windows: (label, text, first word, end word)
    sides = []
    for y in (0, 1):
        mine = np.flatnonzero(label == y)
        text, start, end = windows_of(np.array([len(ids[k]) for k in mine], np.int64))
        sides.append((np.concatenate([np.zeros(0, np.int64), *[ids[k] for k in mine]]), text, start, end))
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.net.p.items()}
    step = 0
    while step < STEPS:
        chosen = []
        for y, (words, text, start, end) in enumerate(sides):
            rows = model.features(table, y)
            if step:
                value = model.logits(model.net.inputs(with_blank(rows)), words, start, end)
            else:
                best = np.append(rows[:, 0] + rows[:, 1], -9.0)
                at = start[:, None] + np.arange(WINDOW)
                value = best[np.where(at < end[:, None], np.append(words, 0)[np.minimum(at, len(words))], -1)].max(axis=1)
            picks = [top_of(text, value)]
            if not y:
                picks.append(top_of(text, rng.random(len(text))))
            chosen += [(y, int(k)) for k in np.concatenate(picks)]
        rng.shuffle(chosen)
        for at in range(0, len(chosen), BATCH):
            step += 1
            part = chosen[at : at + BATCH]
            keys, mask = np.full((len(part), WINDOW), -1, np.int64), np.zeros((len(part), WINDOW), np.float32)
            for row, (y, k) in enumerate(part):
                words = sides[y][0][sides[y][2][k] : sides[y][3][k]]
                keys[row, : len(words)], mask[row, : len(words)] = words * 2 + y, 1
            distinct, which = np.unique(keys, return_inverse=True)
            known = table.take(np.maximum(distinct, 0) // 2)
            x = np.where((distinct % 2 == 1)[:, None], model.features(known, 1), model.features(known, 0))
            g, dx = model.net.gradients(x, which.reshape(keys.shape), mask, np.array([y for y, _ in part], np.float32))
            for name, value in g.items():
                m, v = state[name]
                m += 0.1 * (value - m)
                v += 0.001 * (value * value - v)
                model.net.p[name] -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            np.add.at(model.word_vectors, known.word % WORD_BUCKETS, -RATE * 10 * dx[:, 2 : 2 + EMBED])
            np.add.at(model.gram_vectors, known.grams % GRAM_BUCKETS, -RATE * 10 * np.repeat(dx[:, 2 + EMBED :] / known.count[:, None], known.count, axis=0))
    tops, marks = [], []
    for y, (words, text, start, end) in enumerate(sides):
        value = model.logits(model.net.inputs(with_blank(model.features(table, y))), words, start, end)
        tops.append(value[top_of(text, value)])
        marks.append(np.full(len(tops[-1]), y))
    model.net.p["bo"] = model.net.p["bo"] - np.float32(best_cut(np.concatenate(tops), np.concatenate(marks)))
    return model


def with_blank(rows: np.ndarray) -> np.ndarray:
    """At least one row, for places that the mask hides."""
    return rows if len(rows) else np.zeros((1, INPUTS), np.float32)


def top_of(text: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The window of greatest value of each text (texts in order, each with a window)."""
    order = np.lexsort((value, text))
    return order[np.flatnonzero(np.diff(np.append(text[order], -1)))] if len(order) else order


def best_cut(logit: np.ndarray, label: np.ndarray) -> float:
    """Middle of the widest gap among the cuts with the fewest errors; 0 for a single class."""
    if label.min() == label.max():
        return 0.0
    order = np.argsort(logit, kind="stable")
    value, y = logit[order], label[order]
    errors = np.cumsum(y)[:-1] + (1 - y)[::-1].cumsum()[::-1][1:]  # toxic below, clean above
    gaps = np.where(errors == errors.min(), value[1:] - value[:-1], -1.0)
    k = int(np.argmax(gaps))
    return float(value[k] + value[k + 1]) / 2


class Scorer:
    """Scores texts, remembering the gate inputs of words it has met."""

    def __init__(self, model: Model):
        self.model, self.number = model, {}
        self.gates = {d: np.zeros((0, 3 * HIDDEN), np.float32) for d in "fb"}

    def scores(self, texts: list[str]) -> np.ndarray:
        found = [words_of(t) for t in texts]
        if len(self.number) > REMEMBERED:
            self.__init__(self.model)
        number = self.number
        fresh = list({w for words in found for w in words if w not in number})
        for w in fresh:
            number[w] = len(number)
        more = self.model.net.inputs(self.model.features(Words(fresh)))
        self.gates = {d: np.concatenate([self.gates[d], more[d]]) for d in "fb"} if fresh else self.gates
        ids = np.array([number[w] for words in found for w in words], np.int64)
        text, start, end = windows_of(np.array([len(w) for w in found], np.int64))
        gates = self.gates if len(number) else self.model.net.inputs(with_blank(np.zeros((0, INPUTS), np.float32)))
        logit = self.model.logits(gates, ids, start, end)
        best = np.full(len(texts), -np.inf, np.float32)
        np.maximum.at(best, text, logit)
        return sigmoid(best.astype(np.float64))


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from; NULL doc_id too."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def training_sample(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> tuple[list[str], list[int]]:
    """A bounded sample of labelled rows that are not held out, in hash order of doc_id."""
    known = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = known.select("doc_id", "toxic", F.xxhash64("doc_id").alias("h"))
    picks = [order.where(F.col("toxic") == t).orderBy("h", "doc_id").limit(n) for t, n in ((1, toxic_rows), (0, clean_rows))]
    ids = picks[0].unionByName(picks[1])  # at most the two bounds, so it may be broadcast
    texts = docs.select("doc_id", text_or_empty().alias("text")).where(F.octet_length("text") <= TEXT_BYTES)
    rows = texts.join(F.broadcast(ids), "doc_id").select("doc_id", "text", "toxic").limit(4 * (toxic_rows + clean_rows)).collect()
    rows.sort(key=lambda r: (r.doc_id, r.text))
    return [r.text for r in rows], [int(r.toxic) for r in rows]


def score_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Toxicity of every whole text: doc_id, held_out, score, predicted.

    The model is fitted by the driver on at most ``TOXIC_ROWS`` + ``CLEAN_ROWS`` labelled texts
    (of at most ``TEXT_BYTES`` bytes each) whose crc32 of the doc_id, modulo five, is not 0, and
    is broadcast (its size is fixed). Tasks then score all overlapping windows of their rows;
    the score is that of the most toxic window. Only the text is an input.

    NULL and empty texts score as one empty window. Rows are independent: repeated rows
    score alike, hot groups do not matter, an empty table gives an empty result. Labels other
    than 0 and 1 are left out, a doc_id with both counts as toxic; without labels every
    score is 0. Only doc_id and text, and doc_id and toxic of the labels, are read.
    """
    texts, marks = training_sample(docs, labels)
    model = docs.sparkSession.sparkContext.broadcast(fit(texts, marks)) if texts else None

    def run(batches):
        scorer = Scorer(model.value) if model is not None else None
        for batch in batches:
            for part in slices(batch, "text"):
                values = scorer.scores(part.column("text").to_pylist()) if scorer else np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(values, pa.float64())], names=["doc_id", "score"])

    rows = docs.select("doc_id", text_or_empty().alias("text"))
    scored = rows.mapInArrow(run, docs.select("doc_id").schema.add("score", "double"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows that are not predicted toxic; all columns stay.

    Each row is scored and kept or dropped by its own text, in one pass without a join, so
    rows that share a doc_id or have none get decisions of their own.
    """
    texts, marks = training_sample(docs, labels)
    if not texts:
        return docs
    model = docs.sparkSession.sparkContext.broadcast(fit(texts, marks))

    def run(batches):
        scorer = Scorer(model.value)
        for batch in batches:
            for part in slices(batch, "text"):
                clean = scorer.scores([t or "" for t in part.column("text").to_pylist()]) < 0.5
                yield part.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)


travels(__name__)
