"""Hard negatives of anchor vectors by exact integer inner products.

Components become whole numbers. A candidate is stored as bit planes: byte (group, plane) holds
that bit of eight neighbouring components. For each group of eight dimensions an anchor has a
table of its 256 subset sums, so a plane's byte looks up the sum of the anchor's components at
its set bits; doubling from the highest plane down and adding gives the full product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortline.llm.common import stored, travels

SCALE = 256
# Rows whose vec_id is a multiple of these: anchors; rows whose label moves on by one of ten.
ANCHOR_EVERY, MOVE_EVERY, LABELS = 100, 7, 10
POSITIVES, NEGATIVES = 5, 10
# Percent of a positive's score that a negative's may have.
LOW, HIGH = 30, 90
# Candidates of a block, about as many anchors of a block, candidates that are looked up together.
ROWS, ANCHORS, LANES = 1024, 512, 256
# So many blocks of anchors (some MB) are sent to every task; more are joined by the grid.
SENT_BLOCKS = 32
# Pairs that a task scores, about (a minute or two).
TASK_PAIRS = 1 << 32
# Hits that wait before they are merged into the best.
WAITING = 50_000

BLOCK = "id binary, known binary, label binary, row binary, dims int, planes int, bits binary"
ANCHOR_BLOCK = "j int, row binary, label binary, dims int, values binary, reach long, low binary, high binary"
FOUND = "anchor long, slot int, id long, row long, score long"
NEVER = np.iinfo(np.int64).max


def usable(rows: DataFrame, id_: str, vector: str, label: str) -> DataFrame:
    """row, id, label (moved on where it must), q (whole components) of the rows that take part."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    moved = F.when(F.col(id_) % MOVE_EVERY == 0, F.pmod(F.col(label).cast("long") + 1, F.lit(LABELS))).otherwise(F.col(label).cast("long"))
    return rows.where(F.col(label).isNotNull() & F.col(vector).isNotNull() & finite).select(
        F.monotonically_increasing_id().alias("row"), F.col(id_).cast("long").alias("id"), moved.alias("label"),
        F.transform(v, lambda x: F.floor(x * SCALE)).alias("q"),
    )


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    """Vectors of a batch as rows; shorter ones end in zeros."""
    column = batch.column("q")
    sizes = np.array(pa.compute.list_value_length(column).to_pylist(), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def widened(values: np.ndarray, dims: int) -> np.ndarray:
    return np.pad(values, ((0, 0), (0, dims - values.shape[1])))


def bit_planes(values: np.ndarray) -> tuple[int, np.ndarray]:
    """Number of planes and their bytes (plane, group, row), lowest plane first.

    Numbers are in two's complement, so the highest plane counts negative.
    """
    values = widened(values, -(-values.shape[1] // 8) * 8)
    reach = int(max(values.max(initial=0), -values.min(initial=0) - 1, 0))
    planes = reach.bit_length() + 1
    packed = [np.packbits(((values >> k) & 1).astype(np.uint8), axis=1, bitorder="little") for k in range(planes)]
    return planes, np.ascontiguousarray(np.stack(packed).transpose(0, 2, 1))


def subset_sums(anchors: np.ndarray, kind: type) -> np.ndarray:
    """(group, byte, anchor): sum of an anchor's components at the set bits of a byte."""
    anchors = widened(anchors, -(-anchors.shape[1] // 8) * 8).astype(kind)
    groups = anchors.T.reshape(-1, 8, len(anchors))
    out = np.zeros((len(groups), 256, len(anchors)), kind)
    for bit in range(8):
        half = 1 << bit
        out[:, half : 2 * half] = out[:, :half] + groups[:, bit, None]
    return out


def scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Exact inner products (candidate, anchor): looked up, doubled plane by plane, and added."""
    out = np.zeros((planes.shape[2], tables.shape[2]), tables.dtype)
    looked = np.empty_like(out)
    groups = min(len(tables), planes.shape[1])  # dimensions that one side lacks are zeros
    top = len(planes) - 1
    for k in range(top, -1, -1):
        out <<= 1
        for g in range(groups):
            np.take(tables[g], planes[k, g], axis=0, out=looked, mode="clip")
            out = np.subtract(out, looked, out=out) if k == top else np.add(out, looked, out=out)
    return out


def packed(kind: str, row: list) -> pa.RecordBatch:
    """A batch of one row of a schema given as ``name type, …``."""
    fields = [f.split(" ") for f in kind.split(", ")]
    kinds = {"binary": pa.binary(), "int": pa.int32(), "long": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array([v], kinds[k]) for v, (_, k) in zip(row, fields, strict=True)], names=[n for n, _ in fields])


def numbers(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch.column(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def blocks(rows: DataFrame) -> DataFrame:
    """Pack candidates, up to ``ROWS`` at a time: ids, labels, row numbers, bit planes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                values = matrix(part)
                planes, bits = bit_planes(values)
                known = part.column("id").is_valid().to_numpy(zero_copy_only=False)
                yield packed(BLOCK, [numbers(part, "id").tobytes(), known.tobytes(), numbers(part, "label").tobytes(), numbers(part, "row").tobytes(), values.shape[1], planes, bits.tobytes()])

    return rows.select("row", "id", "label", "q").mapInArrow(run, BLOCK)


def anchor_blocks(anchors: DataFrame, count: int) -> DataFrame:
    """Pack anchors into ``count`` blocks, ordered by label; ``low`` and ``high`` bound each slot's scores."""

    def pack(table: pa.Table) -> pa.Table:
        batch = table.combine_chunks().to_batches()[0]
        values, label = matrix(batch), numbers(batch, "label")
        order = np.argsort(label, kind="stable")
        slots = [batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(order), -1)[order].tobytes() for c in ("low", "high")]
        reach = int(max(values.max(initial=0), -values.min(initial=0)))
        return pa.Table.from_batches([packed(ANCHOR_BLOCK, [batch.column("j")[0].as_py(), numbers(batch, "row")[order].tobytes(), label[order].tobytes(), values.shape[1], values[order].tobytes(), reach, *slots])])

    dealt = anchors.select(F.pmod(F.xxhash64("row"), F.lit(count)).cast("int").alias("j"), "row", "label", "q", "low", "high")
    return dealt.groupBy("j").applyInArrow(pack, ANCHOR_BLOCK)


def meet(candidates: DataFrame, anchors: DataFrame, count: int, pairs: int, sent_blocks: int) -> DataFrame:
    """Every block of candidates with every block of anchors, about ``TASK_PAIRS`` pairs in a task.

    Few anchor blocks are sent to the tasks. More are joined over a grid: a candidate block is
    copied once for each anchor block and lies in one of many columns, an anchor block is
    copied for each column, so no key gathers all blocks of a side.
    """
    tasks = max(1, -(-pairs // TASK_PAIRS))
    named = anchors.select(*[F.col(c).alias(f"a_{c}") for c in anchors.columns])
    every = F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("j")
    if count <= sent_blocks:
        return candidates.select("*", every).join(F.broadcast(named), F.col("j") == F.col("a_j"))
    columns = -(-tasks // count)
    spread = candidates.select("*", every, F.pmod(F.xxhash64("row"), F.lit(columns)).alias("i")).repartition(columns * count, "i", "j")
    copies = named.select("*", F.explode(F.expr(f"sequence(0L, {columns - 1}L)")).alias("a_i")).repartition(columns * count, "a_i", "a_j")
    return spread.join(copies, (F.col("i") == F.col("a_i")) & (F.col("j") == F.col("a_j")))


class Best:
    """The best rows met so far for the slots of a block of anchors."""

    def __init__(self, row: np.ndarray, slots: int, size: int):
        self.row, self.slots, self.size = row, slots, size
        self.hits = [tuple(np.zeros(0, np.int64) for _ in range(4))]  # slot, score, id (NULL: NEVER), row
        self.waiting = 0
        self.full = np.zeros((2, len(row) * slots), np.int64)  # score and id of the last of a full slot
        self.full[0] = np.iinfo(np.int64).min

    def add(self, *hit: np.ndarray) -> None:
        self.hits.append(hit)
        self.waiting += len(hit[0])
        if self.waiting > WAITING or len(self.hits) == 2:
            self.merge()

    def merge(self) -> None:
        slot, score, ids, row = (np.concatenate(c) for c in zip(*self.hits, strict=True))
        order = np.lexsort((row, ids, -score, slot))
        ranked = slot[order]
        rank = np.arange(len(order)) - np.searchsorted(ranked, ranked)
        best = order[rank < self.size]
        self.hits, self.waiting = [tuple(c[best] for c in (slot, score, ids, row))], 0
        last = order[rank == self.size - 1]
        self.full[:, slot[last]] = score[last], ids[last]

    def rows(self) -> Iterator[pa.RecordBatch]:
        self.merge()
        slot, score, ids, row = self.hits[0]
        columns = [pa.array(self.row[slot // self.slots]), pa.array((slot % self.slots).astype(np.int32)), pa.array(ids, mask=ids == NEVER), pa.array(row), pa.array(score)]
        yield pa.RecordBatch.from_arrays(columns, names=["anchor", "slot", "id", "row", "score"])


class Scored:
    """A block of anchors with the subset-sum tables of its labels (one for all where ``split`` is false)."""

    def __init__(self, row: dict, split: bool):
        self.j, self.reach = row["a_j"], row["a_reach"]
        self.row, self.label = (np.frombuffer(row[f"a_{c}"], np.int64) for c in ("row", "label"))
        n = len(self.row)
        self.values = np.frombuffer(row["a_values"], np.int64).reshape(n, row["a_dims"])
        self.low, self.high = (np.frombuffer(row[f"a_{c}"], np.int64).reshape(n, -1) for c in ("low", "high"))
        cuts = np.flatnonzero(np.diff(self.label)) + 1 if split else np.zeros(0, np.int64)
        self.parts = list(zip([0, *cuts.tolist()], [*cuts.tolist(), n], strict=True))
        self.kind, self.tables = None, []

    def fitted(self, dims: int, planes: int) -> list[np.ndarray]:
        """Tables of the narrowest kind that holds every number on the way to a product."""
        most = self.reach * max(dims, 1) << planes
        if most >= 1 << 55:
            raise ValueError("vector components are too large: their products would not fit 64 bits")
        kind = np.int32 if most < 1 << 30 else np.int64
        if kind is not self.kind:
            self.kind, self.tables = kind, [subset_sums(self.values[a:b], kind) for a, b in self.parts]
        return self.tables


def search(met: DataFrame, slots: int, size: int, same_label: bool) -> DataFrame:
    """The best ``size`` rows of each anchor's slots: anchor, slot, id, row, score.

    A row fits a slot if its label is the anchor's (or is not), and its score is within the
    slot's bounds. Tasks keep the best rows only; those of all tasks are ranked at last.
    """

    def look(block: dict, anchors: Scored, best: Best) -> None:
        ids, label, row = (np.frombuffer(block[c], np.int64) for c in ("id", "label", "row"))
        ids = np.where(np.frombuffer(block["known"], bool), ids, NEVER)
        planes = np.frombuffer(block["bits"], np.uint8).reshape(block["planes"], -1, len(row))
        for (begin, end), table in zip(anchors.parts, anchors.fitted(block["dims"], block["planes"]), strict=True):
            picked = np.flatnonzero(label == anchors.label[begin]) if same_label else np.arange(len(row))
            for at in range(0, len(picked), LANES):
                few = picked[at : at + LANES]
                score = scores(table, planes[:, :, few])
                barred = row[few][:, None] == anchors.row[begin:end] if same_label else label[few][:, None] == anchors.label[begin:end]
                for k in range(slots):
                    number = np.arange(begin, end) * slots + k
                    floor, last = best.full[:, number]
                    good = (score >= np.maximum(floor, anchors.low[begin:end, k])) & (score <= anchors.high[begin:end, k]) & ~barred
                    r, c = np.nonzero(good)
                    value, id_ = score[r, c].astype(np.int64), ids[few][r]
                    better = (value > floor[c]) | (id_ <= last[c])
                    r, c, value, id_ = r[better], c[better], value[better], id_[better]
                    if len(r):
                        best.add(number[c], value, id_, row[few][r])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Best] = {}
        anchors = None
        for batch in batches:
            for k in range(batch.num_rows):
                block = batch.slice(k, 1).to_pylist()[0]
                if anchors is None or anchors.j != block["a_j"]:
                    anchors = Scored(block, same_label)
                if anchors.j not in held:
                    if len(held) >= SENT_BLOCKS:
                        for best in held.values():
                            yield from best.rows()
                        held.clear()
                    held[anchors.j] = Best(anchors.row, slots, size)
                look(block, anchors, held[anchors.j])
        for best in held.values():
            yield from best.rows()

    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    found = met.mapInArrow(run, FOUND).withColumn("rank", F.row_number().over(order))
    return found.where(F.col("rank") <= size)


def hard_negatives(
    rows: DataFrame, id_: str = "vec_id", vector: str = "embedding", label: str = "label",
    every: int = ANCHOR_EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, sent_blocks: int = SENT_BLOCKS,
) -> DataFrame:
    """Hard negatives of every anchor and positive, from exact scores of all rows.

    anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score. Anchors
    are the rows whose id is a multiple of ``every``. Their positives are the best ``positives``
    other rows of the same label; the negatives of a positive are the best ``negatives`` rows
    of other labels with a score between ``low`` and ``high`` percent of the positive's. Higher
    scores come first, ties by smaller id, rows without an id last.

    Rows without label or vector, or with a NULL, NaN or infinite component take no part. Rows
    are compared as rows: of repeated ids each is an anchor and a candidate of its own, and an
    anchor may have its own copy as a positive. Vectors shorter than others end in zeros. Products that
    might not fit 64 bits raise. An empty table gives an empty result; other columns are not read.
    All rows meet all anchors twice, block by block, so the work grows with rows × anchors,
    which is the task itself; a task holds blocks and the best rows only.
    """
    spark = rows.sparkSession
    all_rows = stored(usable(rows, id_, vector, label), "vectors")
    chosen = F.col("id") % every == 0
    n, n_anchors = all_rows.select(F.count(F.lit(1)), F.count(F.when(chosen, 1))).first()
    count, pairs = max(1, -(-n_anchors // ANCHORS)), n * n_anchors
    spread = all_rows
    if pairs > TASK_PAIRS * spark.sparkContext.defaultParallelism:  # a file's rows would be too much work for a task
        spread = all_rows.repartition(-(-pairs // TASK_PAIRS))
    anchors = all_rows.where(chosen)
    bounds = lambda v: F.array_repeat(F.lit(v).cast("long"), 1)
    free = anchors.select("*", bounds(-NEVER).alias("low"), bounds(NEVER).alias("high"))
    meeting = lambda table: meet(blocks(spread), anchor_blocks(table, count), count, pairs, sent_blocks)
    near = stored(search(meeting(free), 1, positives, True), "positives")

    of = near.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("rank", "score"))).alias("of"))  # at most ``positives``
    ends = lambda whole, none: F.transform(
        F.sequence(F.lit(1), F.lit(positives)), lambda k: F.coalesce(whole(F.try_element_at("of", k)), F.lit(none))
    )
    # whole bounds, rounded inwards; a slot without a positive takes nothing
    up = lambda s: F.call_function("div", s * low + F.pmod(-s * low, F.lit(100)), F.lit(100))
    down = lambda s: F.call_function("div", s * high - F.pmod(s * high, F.lit(100)), F.lit(100))
    bounded = anchors.join(of, F.col("row") == F.col("anchor")).select("row", "label", "q", ends(up, NEVER).alias("low"), ends(down, -NEVER).alias("high"))
    far = search(meeting(bounded), positives, negatives, False)
    named = near.join(anchors.select("row", F.col("id").alias("anchor_id")).alias("n"), F.col("anchor") == F.col("n.row")).select(
        "anchor", "anchor_id", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    return far.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).join(named, ["anchor", "slot"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


SQL = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND coalesce(len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))), 0) = 0
), met AS (
    SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same,
           CASE WHEN len(a.q) = 0 THEN 0 ELSE list_inner_product(a.q, r.q)::BIGINT END AS score
    FROM v AS a JOIN v AS r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id
), positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score
    FROM met WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER w::INTEGER AS "rank", vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN met USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 10
"""


travels(__name__)
