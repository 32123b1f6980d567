"""Line dedup: a sharded minimal perfect hash over repeated lines, probed by the documents."""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.llm.bpe import slices
from cohortline.llm.common import LOWER, SPACES, UPPER, ascii_lower, kept_by_worker, same, stored, text_or_empty, travels

# Shorter keys (in code points) are never dropped.
MIN_KEY = 10
# Keys of a shard, on average; bits of a level for each key that is left.
SHARD_KEYS, LOAD = 50_000, 2
# The index is broadcast when it was counted to hold no more keys (about 23 bytes each).
INDEX_KEYS = 2_000_000
# Probes of one task on the way that routes probes to shards.
PROBES = 500_000
# Second hash of a line: seeded by the hash of this number.
SECOND = 7
SECOND_SEED = xxhash.xxh64_intdigest(struct.pack("<i", SECOND), 42)
LINE_SPACES = SPACES.encode()
TO_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def lines_of(docs: DataFrame) -> DataFrame:
    """Lines that count: doc_id, line (its number), and two hashes h, g of the key."""
    cut = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "key"))
    keys = cut.select("doc_id", "line", line_key(F.col("key")).alias("key")).where(F.length("key") >= MIN_KEY)
    return keys.select("doc_id", "line", F.xxhash64("key").alias("h"), F.xxhash64(F.lit(SECOND), "key").alias("g"))


def slots(h: np.ndarray, level: int, size: int) -> np.ndarray:
    """Place of each hash in a level of ``size`` bits."""
    x = h ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return ((x ^ (x >> np.uint64(33))) % np.uint64(size)).astype(np.int64)


class Shard:
    """Minimal perfect hash over one shard's keys, and the arrays it indexes.

    Each level is a bit array. A key that is alone in its place keeps it; the others go on
    to the next, smaller level. A key's number is the count of bits set before its own.
    """

    def __init__(self, levels: list[np.ndarray], fingerprint: np.ndarray, count: np.ndarray, first: np.ndarray):
        self.levels, self.fingerprint, self.count, self.first = levels, fingerprint, count, first
        self.before, total = [], 0
        for bits in levels:
            ranks = np.cumsum(bits, dtype=np.int64)
            self.before.append(ranks - bits + total)
            total += int(ranks[-1])

    @staticmethod
    def build(h: np.ndarray, g: np.ndarray, count: np.ndarray, first: np.ndarray) -> Shard:
        levels, left = [], np.arange(len(h))
        while len(left):
            size = LOAD * len(left) + 1
            at = slots(h[left], len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone.astype(np.uint8))
            left = left[~alone[at]]
        empty = Shard(levels, g[:0], count[:0], first[:0])
        order = np.argsort(empty.find(h)) if len(h) else np.arange(0)
        return Shard(levels, g[order], count[order], first[order])

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number of each key, -1 where no level holds its place."""
        out, left = np.full(len(h), -1, np.int64), np.arange(len(h))
        for level, bits in enumerate(self.levels):
            at = slots(h[left], level, len(bits))
            hit = bits[at] == 1
            out[left[hit]] = self.before[level][at[hit]]
            left = left[~hit]
        return out

    def first_of(self, h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether the key is in the index, the smallest doc_id that holds it)."""
        at = self.find(h)
        known = at >= 0
        known[known] = self.fingerprint[at[known]] == g[known]
        first = np.zeros(len(h), np.int64)
        first[known] = self.first[at[known]]
        return known, first

    def pack(self) -> bytes:
        sizes = [len(x) for x in self.levels]
        head = struct.pack(f"<{2 + len(sizes)}Q", len(self.first), len(sizes), *sizes)
        bits = b"".join(np.packbits(x).tobytes() for x in self.levels)
        return head + self.fingerprint.astype("<u8").tobytes() + self.count.astype("<u4").tobytes() + self.first.astype("<i8").tobytes() + bits

    @staticmethod
    def unpack(data: bytes) -> Shard:
        n, depth = struct.unpack_from("<2Q", data)
        sizes, at = struct.unpack_from(f"<{depth}Q", data, 16), 16 + 8 * depth
        arrays = []
        for kind, width in (("<u8", 8), ("<u4", 4), ("<i8", 8)):
            arrays.append(np.frombuffer(data, kind, n, at))
            at += width * n
        levels = []
        for size in sizes:
            packed = np.frombuffer(data, np.uint8, (size + 7) // 8, at)
            levels.append(np.unpackbits(packed, count=size))
            at += len(packed)
        return Shard(levels, *arrays)


def repeated_lines(lines: DataFrame) -> DataFrame:
    """Hashes of keys that two documents or more hold: h, g, n (lines), first (smallest doc_id)."""
    held = lines.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    return held.where("first < last").select("h", "g", "n", "first")


def build_index(repeated: DataFrame, keys: int) -> DataFrame:
    """Shards of the index: shard, n_lines (of its keys in the corpus), data."""
    count = -(-keys // SHARD_KEYS)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        h, g = pdf["h"].to_numpy(np.int64).view(np.uint64), pdf["g"].to_numpy(np.int64).view(np.uint64)
        n = np.minimum(pdf["n"].to_numpy(np.int64), (1 << 32) - 1)
        shard = Shard.build(h, g, n, pdf["first"].to_numpy(np.int64))
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "n_lines": [int(pdf["n"].sum())], "data": [shard.pack()]})

    sharded = repeated.withColumn("shard", shard_of(F.col("h"), count))
    return sharded.groupBy("shard").applyInPandas(build, "shard long, n_lines long, data binary")


def shard_of(h: Column, count: int) -> Column:
    return F.pmod(h, F.lit(max(1, count)))


def hashed_lines(text: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """(lines, whether each counts, h, g), equal to ``lines_of``."""
    lines, digest = text.split(b"\n"), xxhash.xxh64_intdigest
    keys = [x.strip(LINE_SPACES).translate(TO_LOWER) for x in lines]
    counts = np.array([len(k) >= MIN_KEY and len(k.decode()) >= MIN_KEY for k in keys])
    hs = np.array([digest(k, 42) for k in keys], np.uint64)
    return lines, counts, hs, np.array([digest(k, SECOND_SEED) for k in keys], np.uint64)


def _rewrite(docs: DataFrame, drops) -> DataFrame:
    """Apply ``drops(doc_id, h, g, of, extra)`` -> mask to the lines of many documents at a time.

    ``of`` numbers the document of each line, ``extra`` holds the further columns of the documents.
    """
    schema = "doc_id long, kept string, n_lines long, n_dropped long"
    extra = [c for c in docs.columns if c not in ("doc_id", "text")]

    def run(batches):
        dropper = drops()
        for batch in batches:
            for part in slices(batch, "text"):
                ids = part.column("doc_id").to_numpy()
                lines, counts, hs, gs = zip(*[hashed_lines(t.encode()) for t in part.column("text").to_pylist()], strict=True)
                sizes = np.array([len(x) for x in lines])
                of = np.repeat(np.arange(len(ids)), sizes)
                gone = np.concatenate(counts) & dropper(ids[of], np.concatenate(hs), np.concatenate(gs), of, {c: part.column(c).to_pylist() for c in extra})
                kept, flags, at = [], gone.tolist(), 0
                for found in lines:
                    own = flags[at : at + len(found)]
                    kept.append(b"\n".join([x for x, y in zip(found, own, strict=True) if not y]).decode())
                    at += len(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(kept, pa.string()), pa.array(sizes, pa.int64()), pa.array(np.bincount(of, gone, len(ids)).astype(np.int64))],
                    names=["doc_id", "kept", "n_lines", "n_dropped"],
                )

    return docs.mapInArrow(run, schema)


def _broadcast_way(docs: DataFrame, index: DataFrame, count: int) -> DataFrame:
    mark = uuid.uuid4().hex
    blobs = docs.sparkSession.sparkContext.broadcast({r.shard: bytes(r.data) for r in index.select("shard", "data").collect()})

    def drops():
        # the index is unpacked once for all tasks of a worker
        shards = kept_by_worker(("lines", mark), lambda: {k: Shard.unpack(v) for k, v in blobs.value.items()})

        def gone(doc_id, h, g, *_):
            out = np.zeros(len(h), bool)
            home = h.view(np.int64) % count
            for k in np.unique(home).tolist():
                if k in shards:
                    at = np.flatnonzero(home == k)
                    known, first = shards[k].first_of(h[at], g[at])
                    out[at] = known & (first < doc_id[at])
            return out

        return gone

    return _rewrite(docs, drops)


def _routed_way(docs: DataFrame, lines: DataFrame, index: DataFrame, count: int, probes: int) -> DataFrame:
    """Send hashes, never texts, to the shards; a shard with many probes is copied to several tasks."""
    load = lines.select(shard_of(F.col("h"), count).alias("shard")).groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    copies = stored(load.select("shard", F.ceil(F.col("n") / probes).cast("int").alias("copies")), "lines-copies")
    sent = lines.withColumn("shard", shard_of(F.col("h"), count)).join(copies, "shard")
    copy = F.pmod(F.xxhash64("doc_id", "line"), F.col("copies"))
    sent = sent.select("shard", copy.cast("int").alias("copy"), "doc_id", "h", "g")
    held = index.join(copies, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), "data")

    def probe(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"doc_id": pd.Series([], dtype="Int64"), "h": pd.Series([], dtype="int64")})
        h, g = left["h"].to_numpy(np.int64).view(np.uint64), left["g"].to_numpy(np.int64).view(np.uint64)
        known, first = Shard.unpack(bytes(right["data"].iloc[0])).first_of(h, g)
        return left.loc[known & (first < left["doc_id"].to_numpy(np.int64)), ["doc_id", "h"]]

    gone = sent.groupBy("shard", "copy").cogroup(held.groupBy("shard", "copy")).applyInPandas(probe, "doc_id long, h long")
    gone = gone.groupBy("doc_id").agg(F.collect_set("h").alias("gone"))  # no more than a document's own lines
    marked = docs.alias("d").join(gone.alias("g"), same("d", "g", "doc_id"), "left").select("d.doc_id", "d.text", "g.gone")

    def drops():
        def gone(doc_id, h, g, of, extra):
            out, starts = np.zeros(len(h), bool), np.searchsorted(of, np.arange(len(extra["gone"]) + 1))
            for k, own in enumerate(extra["gone"]):
                if own:
                    at = slice(starts[k], starts[k + 1])
                    out[at] = np.isin(h[at].view(np.int64), np.array(own, np.int64))
            return out

        return gone

    return _rewrite(marked, drops)


def drop_repeated_lines(docs: DataFrame, index_keys: int = INDEX_KEYS, probes: int = PROBES) -> DataFrame:
    """Drop lines that an earlier document holds: doc_id, kept (text), n_lines, n_dropped.

    A line's key is the line stripped of ASCII white space, A-Z lower-cased. Keys of at least
    ten code points that two documents hold lose all lines but those in the smallest doc_id.

    One pass counts keys by two 64-bit hashes with map-side combining. Keys of two documents
    or more are dealt by hash to shards of about ``SHARD_KEYS`` keys, and each shard becomes a
    minimal perfect hash with arrays of fingerprints, counts and smallest doc_ids. The
    documents probe these arrays: with up to ``index_keys`` keys the shards are broadcast
    and no text moves. A larger index stays in its table; hashes are sent to the shards, a
    shard with more than ``probes`` of them is copied to several tasks (so a line that
    every document has is no hot key), and only hits come back to the documents.

    NULL and empty texts are one empty line. A line repeated within the smallest doc_id
    stays there each time. Rows that repeat a doc_id are one document. NULL doc_id counts as
    the smallest of all. An empty table gives an empty result. Only doc_id and text are read.
    """
    lowest = F.lit(-(1 << 63))
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), lowest).alias("doc_id"), text_or_empty().alias("text"))
    repeated = stored(repeated_lines(lines_of(base)), "lines-repeated")
    keys = repeated.count()
    count = max(1, -(-keys // SHARD_KEYS))
    index = stored(build_index(repeated, keys), "lines-index")
    out = _broadcast_way(base, index, count) if keys <= index_keys else _routed_way(base, lines_of(base), index, count, probes)
    return out.withColumn("doc_id", F.nullif("doc_id", lowest))


SQL = r"""
WITH rows AS (SELECT doc_id, generate_subscripts(ls, 1) AS n, unnest(ls) AS line
              FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
keyed AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM rows),
held AS (SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING min(doc_id) < max(doc_id)),
marked AS (SELECT doc_id, n, line, coalesce(first < doc_id, false) AS gone FROM keyed LEFT JOIN held USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

travels(__name__)
travels(kept_by_worker.__module__)
