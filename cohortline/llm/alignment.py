"""Alignment of the tokens that two tokenizers make of the same text.

Both tokenise a whole text. Shared ends before a space-marked token of both, verified on the
bytes that the tokens spell, are anchors: they split the document into windows, each a pair of
token-id tuples. A window is aligned once and remembered by its id tuples.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from cohortline.llm.bpe import LONG, Codec, slices
from cohortline.llm.common import kept_by_worker, stored, travels

# Windows that a worker remembers, and links of all of them; beyond either, all are forgotten.
WINDOWS, LINKS = 400_000, 4_000_000
# Fragments whose ids a worker remembers; longer ones are not remembered.
FRAGMENTS_KEPT = 300_000
# Linked id pairs whose corpus counts are sent to every task: the commonest, at most so many.
HEAVY_PAIRS = 500_000
# Distinct pairs that a counting task holds before it passes them on.
COUNTED_PAIRS = 1_000_000

# Added to B's ids in a window's key.
SIDE = 1 << 31
MARK = "▁"
# A run of spaces with the word behind it.
FRAGMENT = re.compile(" +[^ ]*")
# Spelled like this only by a model that neither changes characters nor drops spaces.
PROBE = "ﬁ  ½ "

ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs binary, times binary"


class PieceEncoder:
    """Ids of a sentencepiece model, and the bytes that each id stands for.

    A model without a piece that goes on after a space mark can merge nothing across the start
    of a run of spaces, so a text's ids are those of its fragments, each encoded once for many texts. Any
    other model encodes whole texts.
    """

    def __init__(self, model: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = range(self.model.get_piece_size())
        names = [self.model.id_to_piece(k) for k in ids]
        self.spelled = [bytes([int(n[3:5], 16)]) if self.model.is_byte(k) else n.replace(MARK, " ").encode() for k, n in zip(ids, names, strict=True)]
        lone = self.model.piece_to_id(MARK)
        self.lone = np.uint32(lone).tobytes()
        whole = "".join(self.model.encode(PROBE, out_type=str)) == MARK + PROBE.replace(" ", MARK)
        self.parted = whole and not self.model.is_unknown(lone) and not any(MARK in n.lstrip(MARK) for n in names)
        self.known = {" ": self.lone}

    def encode_all(self, spaced: list[str]) -> list[bytes | None]:
        """Ids of texts, given with the space that the model adds, as 32-bit numbers; None if they spell another text."""
        if not self.parted:
            return [self.checked(t, ids) for t, ids in zip(spaced, self.model.encode([t[1:] for t in spaced], num_threads=1), strict=True)]
        if len(self.known) > FRAGMENTS_KEPT:
            self.known = {" ": self.lone}
        known, parts = self.known, [FRAGMENT.findall(t) for t in spaced]
        fresh = list(set().union(*parts).difference(known))
        # the model itself puts the first space before a text
        wrong = set()
        for fragment, ids in zip(fresh, self.model.encode([f[1:] for f in fresh], num_threads=1), strict=True):
            known[fragment] = self.checked(fragment, ids)
            if known[fragment] is None:
                wrong.add(fragment)
        out = [b"".join(map(known.__getitem__, f)) if wrong.isdisjoint(f) else None for f in parts]
        for fragment in fresh:
            if len(fragment) > LONG or fragment in wrong:
                del known[fragment]
        return out

    def checked(self, spaced: str, ids: list[int]) -> bytes | None:
        spelled = self.spelled
        return array("I", ids).tobytes() if b"".join([spelled[k] for k in ids]) == spaced.encode() else None


class Side:
    """What a tokenizer's ids stand for, and how they are written in groups."""

    def __init__(self, spelled: list[bytes], end: str):
        self.spelled = spelled
        self.length = np.array([len(s) for s in spelled], np.int64)
        self.spaced = np.array([s.startswith(b" ") for s in spelled])
        self.inner, self.last = (np.array([f"{k}{mark}" for k in range(len(spelled))], object) for mark in (",", end))

    def bytes_of(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.spelled.__getitem__, ids.tolist()))


class Aligner:
    """Aligns documents, remembering the windows it has met."""

    def __init__(self, byte_file: str, piece_model: bytes):
        self.codec, self.pieces = Codec(byte_file), PieceEncoder(piece_model)
        self.a, self.b = Side(self.codec.spelled, "|"), Side(self.pieces.spelled, ";")
        self.forget()

    def forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.text: list[str] = []
        self.n_groups, self.n_links, self.links = array("q"), array("q"), array("q")
        # linked pairs by number: A's id in the upper half of 64 bits
        self.pair: dict[int, int] = {}

    def learn(self, windows: list[bytes]) -> None:
        """Align windows: groups between common ends, and links of tokens that overlap.

        The windows lie end to end. Between two neighbouring ends, of whichever side, lies one
        overlap of one token of A and one of B.
        """
        ids = np.frombuffer(b"".join(windows), "<u4")
        of = np.repeat(np.arange(len(windows)), [len(w) // 4 for w in windows])
        right = ids >= SIDE
        a, b, of_a = ids[~right].astype(np.int64), ids[right].astype(np.int64) - SIDE, of[~right]
        if self.a.bytes_of(a) != self.b.bytes_of(b):
            raise ValueError("the byte-level tokenizer changed a text")
        ends_a, ends_b = np.cumsum(self.a.length[a]), np.cumsum(self.b.length[b])
        ends = np.union1d(ends_a, ends_b)
        at_a = np.searchsorted(ends_a, ends)
        names, code = np.unique(a[at_a] << 32 | b[np.searchsorted(ends_b, ends)], return_inverse=True)
        pair = self.pair
        numbers = np.array([pair.setdefault(k, len(pair)) for k in names.tolist()], np.int64)
        self.links.frombytes(numbers[code].tobytes())
        self.n_links.frombytes(np.bincount(of_a[at_a], minlength=len(windows)).astype(np.int64).tobytes())
        last_a, last_b = np.isin(ends_a, ends_b, assume_unique=True), np.isin(ends_b, ends_a, assume_unique=True)
        self.n_groups.frombytes(np.bincount(of_a[last_a], minlength=len(windows)).astype(np.int64).tobytes())
        written = np.concatenate([np.where(last, s.last[k], s.inner[k]) for s, k, last in ((self.a, a, last_a), (self.b, b, last_b))])
        group = np.concatenate([2 * (np.cumsum(last_a) - last_a), 2 * (np.cumsum(last_b) - last_b) + 1])
        written = written[np.argsort(group, kind="stable")].tolist()
        cuts = np.cumsum([0, *[len(w) // 4 for w in windows]]).tolist()
        self.number.update(zip(windows, range(len(self.text), len(self.text) + len(windows)), strict=True))
        self.text += ["".join(written[lo:hi])[:-1] for lo, hi in zip(cuts, cuts[1:])]

    def encoded(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """Ids of both sides; none unless both spell the text with a space before it.

        B is compared with the text here, piece by piece; A has as many bytes, and each window
        compares them with those of B.
        """
        spaced = [" " + t if t else "" for t in texts]
        out = []
        for t, b in zip(spaced, self.pieces.encode_all(spaced), strict=True):
            a = self.codec.encode_segment(t) if b else b""  # the special token's string is plain text here
            same = b and self.a.length[np.frombuffer(a, "<u4")].sum() == self.b.length[np.frombuffer(b, "<u4")].sum()
            out.append((a, b) if same else (b"", b""))
        return out

    def align(self, texts: list[str | None]) -> dict[str, list]:
        """Columns of ``ALIGNED`` but the doc_id, for texts laid end to end."""
        if len(self.text) > WINDOWS or len(self.links) > LINKS:
            self.forget()
        both = self.encoded(texts)
        raw_a, raw_b = b"".join([a for a, _ in both]), b"".join([b for _, b in both])
        ids_a, ids_b = np.frombuffer(raw_a, "<u4"), np.frombuffer(raw_b, "<u4")
        n_a, n_b = (np.array([len(pair[k]) // 4 for pair in both], np.int64) for k in (0, 1))
        last = np.cumsum(n_a) - 1
        ends_a, ends_b = np.cumsum(self.a.length[ids_a]), np.cumsum(self.b.length[ids_b])
        at_b = np.searchsorted(ends_b, ends_a)
        shared = np.flatnonzero(ends_b[at_b] == ends_a) if len(ids_a) else np.zeros(0, np.int64)
        at_b = at_b[shared]
        # anchors: both go on with a space-marked token; the end of a document is one too
        follows = self.a.spaced[np.append(ids_a, 0)[shared + 1]] & self.b.spaced[np.append(ids_b, 0)[at_b + 1]]
        anchor = follows | np.isin(shared, last)
        stop_a, stop_b = shared[anchor] + 1, at_b[anchor] + 1
        start_a, start_b = (np.append(0, s[:-1])[: len(s)] for s in (stop_a, stop_b))
        # each window's ids in one run: those of A, then those of B, marked as such
        of_a, of_b = (np.repeat(np.arange(len(stop_a)), stop - start) for stop, start in ((stop_a, start_a), (stop_b, start_b)))
        both_ids = np.empty(len(ids_a) + len(ids_b), np.uint32)
        both_ids[np.arange(len(ids_a)) + start_b[of_a]] = ids_a
        both_ids[np.arange(len(ids_b)) + stop_a[of_b]] = ids_b + np.uint32(SIDE)
        raw, cuts = both_ids.tobytes(), np.append(0, (stop_a + stop_b) * 4).tolist()
        number = self.number
        found = [number.get(raw[lo:hi]) for lo, hi in zip(cuts, cuts[1:])]
        fresh = [k for k, n in enumerate(found) if n is None]
        if fresh:
            keys = [raw[cuts[k] : cuts[k + 1]] for k in fresh]
            self.learn(list(dict.fromkeys(keys)))
            for k, key in zip(fresh, keys, strict=True):
                found[k] = number[key]
        window = np.array(found, np.int64)
        # windows of document k are bounds[k] to bounds[k + 1]
        bounds = np.append(0, np.searchsorted(stop_a, last + 1, side="right"))
        n_groups, n_links = np.array(self.n_groups, np.int64), np.array(self.n_links, np.int64)
        begin = np.cumsum(n_links) - n_links
        count = n_links[window]
        flat = np.array(self.links, np.int64)[np.arange(count.sum()) + np.repeat(begin[window] - (np.cumsum(count) - count), count)]
        total = np.append(0, np.cumsum(count))[bounds]
        groups_to = np.append(0, np.cumsum(n_groups[window]))[bounds]
        text, out = self.text, {"n_a": n_a, "n_b": n_b, "n_groups": np.diff(groups_to), "n_links": np.diff(total)}
        out["groups"] = [";".join([text[w] for w in found[lo:hi]]) for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        # distinct pairs of each document, with how often it links them
        names = np.array([*self.pair, 0], np.uint64)
        keys, times = np.unique(np.repeat(np.arange(len(texts)), np.diff(total)) * len(names) + flat, return_counts=True)
        cuts = np.searchsorted(keys, np.arange(len(texts) + 1) * len(names)).tolist()
        pairs, times = names[keys % len(names)].tobytes(), times.astype("<u4").tobytes()
        out["pairs"] = [pairs[8 * lo : 8 * hi] for lo, hi in zip(cuts, cuts[1:])]
        out["times"] = [times[4 * lo : 4 * hi] for lo, hi in zip(cuts, cuts[1:])]
        return out


def align(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """Tokens of a byte-level BPE file (A) and of a sentencepiece model (B) side by side.

    Per row of ``docs``: doc_id, n_a and n_b (tokens), n_groups (byte ranges between ends that
    both share), n_links (pairs of tokens that overlap), groups (``a1,a2|b1;a3|b2,b3``: ids in
    order), pairs (binary: distinct linked ids, A's id in the upper half of 64 bits),
    times (binary: how often the document links each, 32 bits). A sees the text with a space
    before it, B adds that itself; special tokens' strings are plain text.

    NULL and empty texts have no tokens, nor has a text whose bytes are not those that both
    sides spell (one with the space mark itself, say). Rows are independent: repeated rows
    repeat, hot groups do not matter, an empty table stays empty, other columns are not read.
    Texts are handled whole; memory beyond a text's own arrays is bounded.
    """
    sc = docs.sparkSession.sparkContext
    with open(byte_path, encoding="utf-8") as f, open(piece_path, "rb") as g:
        files = sc.broadcast((f.read(), g.read()))  # vocabulary files: their size does not grow

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = kept_by_worker(("aligner", *files.value), lambda: Aligner(*files.value))
        for batch in batches:
            for part in slices(batch, "text"):
                done = aligner.align(part.column("text").to_pylist())
                kinds = {"groups": pa.string(), "pairs": pa.binary(), "times": pa.binary()}
                columns = [pa.array(v, kinds.get(c, pa.int64())) for c, v in done.items()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=["doc_id", *done])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ALIGNED)


def flat_pairs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a batch end to end, and where each row's begin (with the end of the last)."""
    values = batch.column("pairs").to_pylist()
    return np.frombuffer(b"".join(values), "<u8"), np.append(0, np.cumsum([len(v) // 8 for v in values])).astype(np.int64)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """In how many documents each pair is linked: a, b, n, best (n is the highest of its A id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def rows():
            a, b = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(counts)], names=["a", "b", "n"])

        for batch in batches:
            more, times = np.unique(flat_pairs(batch)[0], return_counts=True)
            merged, at = np.unique(np.concatenate([keys, more]), return_inverse=True)
            summed = np.zeros(len(merged), np.int64)
            np.add.at(summed, at, np.concatenate([counts, times]))
            keys, counts = merged, summed
            if len(keys) > COUNTED_PAIRS:
                yield rows()
                keys, counts = keys[:0], counts[:0]
        yield rows()

    summed = stored(aligned.select("pairs").mapInArrow(run, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")), "pair-counts")
    # one row per id of a vocabulary, whatever the size of the corpus
    highest = F.broadcast(summed.groupBy("a").agg(F.max("n").alias("most")))
    return summed.join(highest, "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def heavy_from(counts: DataFrame, most: int) -> int:
    """The least power of two such that at most ``most`` pairs are in as many documents; 1 if all pairs fit."""
    sizes = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).count().collect()  # at most 63 rows
    held, limit = 0, 64
    for k, n in sorted(((r["k"], r["count"]) for r in sizes), reverse=True):
        if held + n > most:
            return 1 << limit if limit < 63 else (1 << 63) - 1
        held, limit = held + n, k
    return 1


def with_counts(aligned: DataFrame, heavy_pairs: int = HEAVY_PAIRS) -> DataFrame:
    """Add n_best (links whose pair's count is the highest of its A id) and count_sum (over links).

    ``aligned`` is stored. Counts of the commonest pairs, at most ``heavy_pairs``, go to every
    task; pairs that are rarer than those, hence never hot, meet theirs in a join. Both ways
    read the same counts.
    """
    counts = stored(pair_counts(aligned), "pair-best")
    limit = heavy_from(counts, heavy_pairs)
    top = counts.where(F.col("n") >= limit).toArrow()  # at most heavy_pairs rows
    keys = top.column("a").to_numpy().astype(np.uint64) << np.uint64(32) | top.column("b").to_numpy().astype(np.uint64)
    order = np.argsort(keys)
    heavy = aligned.sparkSession.sparkContext.broadcast(
        (keys[order], top.column("n").to_numpy()[order], top.column("best").to_numpy(zero_copy_only=False)[order].astype(bool))
    )
    kept = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, sizes, best = heavy.value
        for batch in batches:
            pairs, cuts = flat_pairs(batch)
            times = np.frombuffer(b"".join(batch.column("times").to_pylist()), "<u4").astype(np.int64)
            if len(names):
                at = np.minimum(np.searchsorted(names, pairs), len(names) - 1)
                hit = names[at] == pairs
            else:
                at, hit = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), bool)
            of = lambda v: np.diff(np.append(0, np.cumsum(np.where(hit, v[at], 0) * times) if len(names) else np.zeros(len(pairs), np.int64))[cuts])
            rest = np.append(0, np.cumsum(~hit))[cuts].astype(np.int32)
            left = [pa.ListArray.from_arrays(pa.array(rest), pa.array(v[~hit].astype(np.int64))) for v in (pairs, times)]
            columns = [pa.array(of(best.astype(np.int64))), pa.array(of(sizes)), *left]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *columns], names=[*kept, "n_best", "count_sum", "rest", "rest_times"])

    longs = ArrayType(LongType(), containsNull=False)
    schema = aligned.select(*kept).schema.add("n_best", "long").add("count_sum", "long").add("rest", longs).add("rest_times", longs)
    found = aligned.select(*kept, "pairs", "times").mapInArrow(run, schema)
    if limit <= 1:  # every pair was sent, so none is left to join
        return found.drop("row", "rest", "rest_times")
    found = stored(found, "pairs-left")
    rare = counts.where(F.col("n") < limit).select(F.expr("shiftleft(a, 32) | b").alias("pair"), "n", "best")
    left = found.select("row", F.explode(F.arrays_zip("rest", "rest_times")).alias("r")).select("row", F.col("r.rest").alias("pair"), F.col("r.rest_times").alias("times"))
    summed = left.join(rare, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("times")).alias("more_sum")
    )
    plus = lambda c, more: (F.col(c) + F.coalesce(F.col(more), F.lit(0))).alias(c)
    return found.join(summed, "row", "left").select(*kept[1:], plus("n_best", "more_best"), plus("count_sum", "more_sum"))


def agreement(docs: DataFrame, byte_path: str, piece_path: str, heavy_pairs: int = HEAVY_PAIRS) -> DataFrame:
    """How two tokenizers agree on each document, against the whole corpus.

    doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (empty without
    tokens). Rows are documents, also when they repeat a doc_id or have none.
    """
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    aligned = align(docs, byte_path, piece_path).select("doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "pairs", "times")
    # rows are numbered as they are written, so a number never changes
    return with_counts(stored(aligned.withColumn("row", F.monotonically_increasing_id()), "aligned"), heavy_pairs)


travels(__name__)
