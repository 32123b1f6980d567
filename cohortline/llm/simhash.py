"""Near-duplicate documents by SimHash and deletion-variant signatures."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.llm.bpe import slices
from cohortline.llm.common import numbered, same, shuffled, sized, stored, text_or_empty, travels, without
from cohortline.llm.graph import components

# Words of a shingle, seed of its hash, and bits in which linked fingerprints may differ.
WORDS, SEED, BITS = 4, 42, 4
# Bits of the three segments: of four differing bits, some segment holds one at most.
SEGMENTS = (22, 21, 21)
# Shingles whose bits are counted at a time.
CHUNK = 1 << 15


def fingerprint(text: str, words: int = WORDS, seed: int = SEED) -> int:
    """64-bit SimHash: a bit is 1 if it is set in over half of the shingle hashes."""
    found = text.encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not found:
        return 0
    joined, k, digest = b" ".join(found), min(words, len(found)), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate([[0], ends[: len(found) - k] + 1]).tolist()
    hashes = np.array([digest(joined[s:e], seed) for s, e in zip(starts, ends[k - 1 :].tolist(), strict=True)], ">u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        ones += np.unpackbits(hashes[at : at + CHUNK].view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes)).view(">u8")[0])


def fingerprints(docs: DataFrame, row: str | None = None) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed 64-bit number) of every row; ``row`` is a number to carry along."""
    carried = ["doc_id"] if row is None else ["doc_id", "_row"]

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                values = np.array([fingerprint(t.as_py()) for t in part.column("text")], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carried), pa.array(values)], names=[*carried, "fp"])

    number = [] if row is None else [F.col(row).alias("_row")]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *number, text_or_empty().alias("text"))
    return texts.mapInArrow(run, ", ".join(f"{c} long" for c in [*carried, "fp"]))


def _masks() -> list[tuple[int, int, int]]:
    """(first bit, mask as a signed number, lowest bit as a signed number) of the segments."""
    out, at = [], 0
    for width in SEGMENTS:
        mask = ((1 << width) - 1) << at
        out.append((at, mask - (1 << 64) if mask >> 63 else mask, 1 << at))
        at += width
    return out


def variants(distinct: DataFrame) -> DataFrame:
    """One row per bit: the segment that holds the bit, with that bit wiped out, as ``key``."""
    bit = F.explode(F.sequence(F.lit(0), F.lit(63)))
    rows = distinct.select("fp", "id", bit.alias("bit"))
    segment = None
    for (at, mask, _), width in zip(_masks(), SEGMENTS, strict=True):
        value = F.shiftrightunsigned(F.col("fp").bitwiseAND(F.lit(mask)), at)
        segment = F.when(F.col("bit") < at + width, value) if segment is None else segment.when(F.col("bit") < at + width, value)
        last = at
    start = F.when(F.col("bit") < SEGMENTS[0], 0).when(F.col("bit") < SEGMENTS[0] + SEGMENTS[1], SEGMENTS[0]).otherwise(last)
    wiped = segment.bitwiseAND(F.bitwise_not(F.expr("shiftleft(1L, bit - at)")))
    rows = rows.withColumn("at", start)
    return rows.select("fp", "id", "bit", (F.expr("shiftleft(bit, 22)") + wiped).cast("int").alias("key"))


def _once(x: Column) -> Column:
    """The one wildcard (as a mask) under which a pair that differs in ``x`` is reported."""
    (_, first, low), (_, second, low2), (_, third, low3) = _masks()
    parts = [x.bitwiseAND(F.lit(m)) for m in (first, second, third)]
    pick = lambda part, lowest: F.when(part == 0, F.lit(lowest)).otherwise(part)
    return F.when(F.bit_count(parts[0]) <= 1, pick(parts[0], low)).when(F.bit_count(parts[1]) <= 1, pick(parts[1], low2)).otherwise(pick(parts[2], low3))


def links(distinct: DataFrame, bits: int = BITS) -> DataFrame:
    """Pairs (a, b) of ids of different fingerprints within ``bits`` bits, each pair once.

    Three segments are enough up to four bits: one then differs by a bit at most, so both
    fingerprints share the variant in which that bit is wiped out. Distance is verified
    within the equality-join, so candidates that fail are never rows. ``distinct`` (fp, id) has
    one row for each fingerprint.
    """
    if bits > 2 * len(SEGMENTS) - 2:
        raise ValueError("too many bits for the segments")
    # only a fingerprint and its key travel 64 times: the key tells the bit, and ids are joined to the few pairs
    wiped = variants(distinct).select("fp", "key")
    left, right = wiped.alias("a"), shuffled(wiped).alias("b")
    x = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    near = (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & (F.bit_count(x) <= bits)
    first = F.expr("shiftleft(1L, shiftright(a.key, 22))") == _once(x)
    pairs = left.join(right, near & first).select(F.col("a.fp").alias("_a"), F.col("b.fp").alias("_b"))
    known = sized(distinct)
    ids = [known.select(F.col("fp").alias(f"_{c}"), F.col("id").alias(c)) for c in ("a", "b")]
    return pairs.join(ids[0], "_a").join(ids[1], "_b").select("a", "b")


def _grouped(rows: DataFrame, bits: int) -> DataFrame:
    """Fingerprint rows with the component of their fingerprint: component_id added."""
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("id")), "near-distinct")
    # rows that repeat a doc_id tie their fingerprints together
    tied = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).where("x <> y").select("doc_id")
    tied = rows.join(shuffled(tied), "doc_id").join(sized(distinct), "fp").where("id <> doc_id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    edges = stored(links(distinct.where("id IS NOT NULL"), bits).unionByName(tied).distinct(), "near-links")
    roots = components(edges)
    named = stored(distinct.join(sized(roots), "id", "left").select("fp", F.coalesce("root", "id").alias("component_id")), "near-roots")
    return rows.alias("r").join(sized(named).alias("n"), same("r", "n", "fp")).select("r.*", "component_id")


def near_groups(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """Components of documents whose fingerprints are linked: doc_id, fingerprint, component_id.

    Fingerprints link at ``bits`` differing bits or fewer; component_id is the smallest
    doc_id reachable. Equal fingerprints are first reduced to their smallest doc_id, so
    copies never meet in pairs, and only different fingerprints are joined. Components come
    from rounds of contraction on stored tables (``graph.components``).

    NULL, empty and blank texts have fingerprint zero and link like others; fewer than four
    words are one shingle. Rows that repeat a doc_id are one node. A fingerprint that only
    NULL doc_ids have has a NULL component. An empty table gives an empty result. Only
    doc_id and text are read.
    """
    out = _grouped(stored(fingerprints(docs), "near-fingerprints"), bits)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """One row of each component, that of the smallest doc_id; all columns stay.

    Rows are numbered in a stored table first: of rows that share that doc_id one stays, and
    rows without doc_id go unless no row with one is in their component. Rows whose fingerprint only rows
    without doc_id have are a component of that fingerprint. Only numbers of dropped rows are joined.
    """
    rows, name = numbered(docs, "near-numbered")
    found = stored(_grouped(stored(fingerprints(rows, name), "near-fingerprints"), bits), "near-grouped")
    group = ["component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("fp")]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("_row").alias("row")))
    stays = found.groupBy(*group).agg(first.alias("first")).select(F.col("first.row").alias("_row"))
    dropped = stored(found.select("_row").join(shuffled(stays), "_row", "left_anti").select(F.col("_row").alias(name)), "near-dropped")
    return without(rows, dropped, name).drop(name)


travels(__name__)
