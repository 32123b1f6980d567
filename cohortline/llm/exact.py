"""Exact dedup by progressive refinement: length, then a prefix hash, then the full text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.llm.common import BROADCAST_ROWS, numbered, shuffled, sized, small, stored, text_or_empty, without, without_spaces

# Code points of the normalised text that the prefix hash covers.
PREFIX = 64


def _hashed(docs: DataFrame, row: Column, digest_all: bool, prefix: int, broadcast_rows: int) -> DataFrame:
    """Stored narrow rows: _row, doc_id, _n, _again (its class has a second member), _full."""
    plain = without_spaces(F.col("_text"))
    base = docs.select(row.alias("_row"), "doc_id", text_or_empty().alias("_text")).select(
        "_row", "doc_id", F.length("_text").alias("_n"), plain.alias("_plain")
    )
    keyed = base.select(
        "_row", "doc_id", "_n", "_plain", F.length("_plain").alias("_len"), F.xxhash64(F.left("_plain", F.lit(prefix))).alias("_head")
    )
    heads = keyed.groupBy("_len", "_head").agg(F.count(F.lit(1)).alias("_rows"))
    # a class with two members has a length with two members, so one table holds both levels
    classes = stored(heads.where("_rows > 1").select("_len", "_head"), "exact-classes")
    full = F.sha2("_plain", 256)
    marks = classes.withColumn("_again", F.lit(True))
    again = F.coalesce("_again", F.lit(False))
    if small(classes, broadcast_rows):
        marked = keyed.join(F.broadcast(marks), ["_len", "_head"], "left")
        rows = marked.select("_row", "doc_id", "_n", again.alias("_again"), (full if digest_all else F.when(again, full)).alias("_full"))
    else:
        narrow = keyed.select("_row", "doc_id", "_n", "_len", "_head", full.alias("_full"))
        rows = narrow.join(shuffled(marks), ["_len", "_head"], "left").select(
            "_row", "doc_id", "_n", again.alias("_again"), (F.col("_full") if digest_all else F.when(again, F.col("_full"))).alias("_full")
        )
    return stored(rows, "exact-rows")


def _decided(rows: DataFrame) -> DataFrame:
    """Rows of repeated classes with the decision on their group: _row, doc_id, _full, _size, _keep, _kept."""
    again = rows.where("_again")
    order = F.struct((-F.col("_n")).alias("n"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("_row").alias("row"))
    groups = again.groupBy("_full").agg(F.count(F.lit(1)).alias("_size"), F.min(order).alias("_best"))
    groups = stored(groups.where("_size > 1").select("_full", "_size", F.col("_best.id").alias("_keep"), F.col("_best.row").alias("_stays")), "exact-groups")
    alone = F.col("_size").isNull()
    return again.join(sized(groups), "_full", "left").select(
        "_row", "doc_id", "_full",
        F.coalesce("_size", F.lit(1).cast("long")).alias("_size"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("_keep")).alias("_keep"),
        (alone | (F.col("_row") == F.col("_stays"))).alias("_kept"),
    )


def exact_groups(docs: DataFrame, digest_all: bool = False, prefix: int = PREFIX, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Group documents whose texts are equal after deleting ASCII white space.

    One row per input row: doc_id, keep_id, group_size, kept, text_sha256. Of equal texts
    one row stays: the one with the most code points in the original, then the smallest
    doc_id (rows without one come last), then any one of the rows that tie in both.

    The first pass keeps length and prefix hash per row and counts both levels with map-side
    combining. Only rows whose (length, prefix hash) class has a second member are hashed in
    full; the digest of other rows is NULL unless ``digest_all`` asks for it. The class
    list is broadcast when it has at most ``broadcast_rows`` rows; a longer one joins narrow
    rows (hashes only, never texts), for which every text is hashed in full before the join,
    whatever ``digest_all`` says; the digests of rows without a second member are then dropped. A group of any size is one row of counts, and the rows
    join it with an adaptive (skew-splitting) join; rows without a digest take no part in it.

    NULL text counts as empty; empty texts are equal. Rows that repeat a doc_id or have none
    are rows of their own. An empty table gives an empty result. Only doc_id and text are
    read, so other columns never clash.
    """
    rows = _hashed(docs, F.monotonically_increasing_id(), digest_all, prefix, broadcast_rows)
    single = rows.where("NOT _again").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("_full").alias("text_sha256")
    )
    grouped = _decided(rows).select(
        "doc_id", F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"), F.col("_kept").alias("kept"), F.col("_full").alias("text_sha256")
    )
    return single.unionByName(grouped)


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts; all columns stay.

    Rows are numbered in a stored table first, so rows that share a doc_id or have none get
    decisions of their own. Only the numbers of dropped rows are joined.
    """
    rows, name = numbered(docs, "exact-numbered")
    found = _decided(_hashed(rows, F.col(name), False, PREFIX, BROADCAST_ROWS))
    dropped = stored(found.where("NOT _kept").select(F.col("_row").alias(name)), "exact-dropped")
    return without(rows, dropped, name).drop(name)


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY h) AS group_size,
       row_number() OVER (PARTITION BY h ORDER BY n DESC, doc_id) = 1 AS kept,
       h AS text_sha256
FROM d
"""
