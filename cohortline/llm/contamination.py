"""Benchmark decontamination by a prefix-filtered set join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.llm.common import ascii_lower, sized, stored, text_or_empty

# Words of a window of an item, and of a shingle of a window.
WINDOW, SHINGLE = 10, 5
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# A shingle table is broadcast only after counting no more rows than this (about 100 MB).
SHINGLE_ROWS = 500_000


def normalised(text: Column) -> Column:
    """Words of a text, joined by single spaces."""
    return F.trim(F.regexp_replace(ascii_lower(text), GAPS, " "))


def word_count(words: Column) -> Column:
    return F.when(words == "", F.lit(0)).otherwise(F.length(words) - F.length(F.replace(words, F.lit(" "), F.lit(""))) + 1)


def shingles(words: Column, k: int) -> Column:
    """All runs of ``k`` words of a normalised text, overlapping, in order."""
    run = r"[^ ]+" if k == 1 else rf"(?:[^ ]+ ){{{k - 1}}}[^ ]+"
    return F.regexp_extract_all(words, F.lit(rf"(?<![^ ])(?=({run}))"), F.lit(1))


def item_windows(items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(distinct windows: wid, n, words; which items hold them: wid, item_id)."""
    words = items.select("item_id", normalised(text_or_empty()).alias("words"))
    words = words.select("item_id", "words", word_count(F.col("words")).alias("n")).where("n > 0")
    cut = F.when(F.col("n") >= window, shingles(F.col("words"), window)).otherwise(F.array("words"))
    held = words.select("item_id", F.least("n", F.lit(window)).alias("n"), F.explode(cut).alias("words")).distinct()
    held = stored(held, "leak-held")
    windows = stored(held.select("n", "words").distinct().select(F.monotonically_increasing_id().alias("wid"), "n", "words"), "leak-windows")
    return windows, held.join(windows, ["n", "words"]).select("wid", "item_id")


def window_shingles(windows: DataFrame, k: int = SHINGLE) -> DataFrame:
    """Shingles of every window with their offset: wid, n, k, off, shingle, cover.

    Windows shorter than a shingle are one shingle. ``cover`` marks the first and the last
    one; together they spell the whole window as long as ``window <= 2 * shingle``.
    """
    cut = F.when(F.col("n") >= k, shingles(F.col("words"), k)).otherwise(F.array("words"))
    rows = windows.select("wid", "n", F.least("n", F.lit(k)).alias("k"), F.posexplode(cut).alias("off", "shingle"))
    return rows.withColumn("cover", (F.col("off") == 0) | (F.col("off") == F.col("n") - F.col("k")))


def text_key(text: str = "text") -> Column:
    """Digest of a text. Rows are told apart by it, never by a doc_id that others may share."""
    return F.unhex(F.sha2(F.encode(text_or_empty(text), "UTF-8"), 256))


def shared_shingles(docs: DataFrame, tokens: DataFrame, sizes: list[int], rows: int = SHINGLE_ROWS) -> DataFrame:
    """Shingles of documents that are also shingles of the benchmark: doc_id, key, n_words, pos, sid.

    One scan of the texts for each shingle size. Position -1 is a row that every document has.
    """
    words = docs.select("doc_id", text_key().alias("key"), normalised(text_or_empty()).alias("words"))
    words = words.select("doc_id", "key", word_count(F.col("words")).alias("n_words"), "words")
    tokens = sized(tokens, rows)
    parts = [words.select("doc_id", "key", "n_words", F.lit(-1).alias("pos"), F.lit(-1).cast("long").alias("sid"))] if not sizes else []
    for i, k in enumerate(sizes):
        runs = shingles(F.col("words"), k)
        if i == 0:  # an empty string is no shingle: it stands for the document itself
            runs = F.concat(F.array(F.lit("")), runs)
        cut = words.select("doc_id", "key", "n_words", F.posexplode(runs).alias("pos", "shingle"))
        cut = cut.select("doc_id", "key", "n_words", (F.col("pos") - (1 if i == 0 else 0)).alias("pos"), "shingle", F.xxhash64("shingle").alias("h"))
        own = tokens.where(F.col("k").isin(k, 0) if i == 0 else F.col("k") == k)
        met = (F.col("c.h") == F.col("t.h")) & (F.col("c.shingle") == F.col("t.shingle"))
        parts.append(cut.alias("c").join(own.alias("t"), met).select("doc_id", "key", "n_words", "pos", "sid"))
    return reduce(DataFrame.unionByName, parts)


def _text_leaks(docs: DataFrame, items: DataFrame, window: int, shingle: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, n_words of every row; key, n_hit, items of the texts with hits)."""
    if window > 2 * shingle:
        raise ValueError("a window may be at most two shingles long")
    windows, held = item_windows(items, window)
    parts = stored(window_shingles(windows, shingle), "leak-shingles")
    sizes = sorted((r.k for r in parts.select("k").distinct().collect()), reverse=True)  # at most ``shingle`` numbers
    distinct = parts.select("k", "shingle").distinct().select("k", "shingle", F.monotonically_increasing_id().alias("sid"))
    whole = docs.sparkSession.range(1).select(F.lit(0).alias("k"), F.lit("").alias("shingle"), F.lit(-1).cast("long").alias("sid"))
    tokens = stored(distinct.unionByName(whole).withColumn("h", F.xxhash64("shingle")), "leak-tokens")
    parts = parts.join(tokens.select("k", "shingle", "sid"), ["k", "shingle"]).select("wid", "n", "off", "sid", "cover")

    found = stored(shared_shingles(docs, tokens, sizes), "leak-found")
    places = found.where("sid >= 0")
    rarity = places.groupBy("sid").agg(F.count(F.lit(1)).alias("places"))
    # windows with a shingle that no document holds cannot occur: all must be found
    ranked = parts.join(rarity, "sid", "left").groupBy("wid", "n").agg(
        F.min(F.struct(F.coalesce("places", F.lit(0).cast("long")).alias("places"), "off", "sid")).alias("rarest")
    )
    prefixes = stored(ranked.where("rarest.places > 0").select("wid", "n", "rarest.off", "rarest.sid"), "leak-prefixes")
    start = F.col("pos") - F.col("off")
    candidates = places.join(sized(prefixes), "sid").select("key", "wid", "n", start.alias("start"), "n_words")
    # copies of one text share a digest: combined on the map side before either side is shuffled
    candidates = candidates.where("start >= 0 AND start + n <= n_words").distinct()
    covers = stored(parts.where("cover").select("wid", "off", "sid"), "leak-covers")
    wanted = candidates.join(sized(covers), "wid").select("key", "wid", "n", "start", (F.col("start") + F.col("off")).alias("pos"), "sid")
    met = wanted.join(places.select("key", "pos", "sid").distinct(), ["key", "pos", "sid"], "left_semi")
    spelled = met.groupBy("key", "wid", "n", "start").agg(F.count_distinct("pos").alias("got"))
    exact = stored(spelled.where(f"got = IF(n > {shingle}, 2, 1)").select("key", "wid", "n", "start"), "leak-exact")

    spans = exact.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("end")))).alias("spans"))
    covered = F.expr(
        "aggregate(spans, struct(0 AS hit, 0 AS upto), (a, s) -> struct("
        "a.hit + greatest(0, s.end - greatest(s.start, a.upto)) AS hit, greatest(a.upto, s.end) AS upto), a -> a.hit)"
    )
    hits = spans.select("key", covered.cast("long").alias("n_hit"))
    names = exact.select("key", "wid").distinct().join(sized(stored(held, "leak-items")), "wid").select("key", F.col("item_id").cast("string").alias("item"))
    names = names.distinct().groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    total = found.where("pos = -1").select("doc_id", "key", F.col("n_words").cast("long").alias("n_words"))
    return total, stored(hits.join(names, "key"), "leak-hits")


def find_leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Words of documents that lie in a window of a benchmark item.

    One row per input row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A window (``window`` words running, or a whole shorter item) is a set of positioned
    shingles. All must be found, so its prefix is its single rarest shingle: rarity is the
    number of places in the documents, counted on the shingles that both sides share. Only
    places of prefixes become candidates; length and position bounds drop those that start
    before the document or end after it, and a candidate counts when the shingles that
    spell the window stand at their exact positions (texts are compared, not hashes).

    The texts are scanned once (once more for each length of items below ``shingle`` words).
    Only shared shingles are stored; later steps are equi-joins on (digest of the text, pos, sid), so
    neither a common passage nor a long document gathers in one task. The benchmark's
    shingles are broadcast when counted small, else joined by shuffle.

    NULL or wordless texts have no words and no hits; NULL or wordless items have no window.
    Rows that repeat a doc_id or have none are documents of their own: the digest of a text
    stands for its rows, so no window is made of two rows. Items that repeat
    a text each count. Empty tables give no rows or no hits. Only doc_id, item_id and text are read.
    """
    total, hits = _text_leaks(docs, items, window, shingle)
    out = total.join(sized(hits), "key", "left")
    n_hit, found_items = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(found_items).cast("long").alias("n_items"),
        F.sha2(F.array_join(found_items, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def drop_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows without a benchmark window; all columns stay.

    Equal texts get the same decision, whatever their doc_ids.
    """
    _, hits = _text_leaks(docs, items, WINDOW, SHINGLE)
    return docs.alias("d").join(sized(hits.select("key")).alias("l"), text_key("d.text") == F.col("l.key"), "left_anti")


SQL = rf"""
WITH low AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
spots AS (SELECT item_id, w, least(len(w), {WINDOW}) AS n, unnest(range(greatest(1, len(w) - {WINDOW - 1}))) AS pos FROM items WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, n, array_to_string(w[pos + 1 : pos + n], ' ') AS win FROM spots),
sizes AS (SELECT DISTINCT n FROM wins),
runs AS (SELECT r, w, n, unnest(range(len(w) - n + 1)) AS pos FROM low, sizes WHERE len(w) >= n),
cut AS (SELECT r, n, pos, array_to_string(w[pos + 1 : pos + n], ' ') AS win FROM runs),
hits AS (SELECT r, item_id, pos, n FROM cut JOIN wins USING (n, win)),
words AS (SELECT r, count(DISTINCT pos + k) AS n_hit FROM (SELECT r, pos, unnest(range(n)) AS k FROM hits) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
          FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM low LEFT JOIN words USING (r) LEFT JOIN named USING (r)
"""
