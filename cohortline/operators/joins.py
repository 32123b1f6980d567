"""Linking tables to an index list.

All links are left equi-joins on an entity key. A key may hold a large share of a
table, so joins that meet repeated keys spread the hot ones over salted copies.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.functions.dates import days_between, in_lag
from cohortline.functions.values import all_of, blank_where, flag, masked
from cohortline.sources.storage import cut_lineage

# A key is hot when it holds HOT_ROWS rows or more. Beyond 10**11 rows the limit is this
# share of them, so that there are never more than 1 / HOT_SHARE hot keys to broadcast.
HOT_SHARE = 1.0 / 500_000
HOT_ROWS = 200_000
SALTS = 64
# A lookup is sent to every task only when it has been counted and is no larger.
BROADCAST_ROWS = 500_000


def hot_keys(counts: DataFrame, keys: Sequence[str], n: str = "n", share: float = HOT_SHARE, rows: int = HOT_ROWS) -> DataFrame:
    """Keys too large for one task, from a table of rows per key: at most 1 / share of them."""
    total = counts.agg(F.sum(n)).scalar()
    return counts.where((F.col(n) >= rows) & (F.col(n) >= total * F.lit(share))).select(*keys)


def _same(left: str, right: str, keys: Sequence[str]) -> list[Column]:
    return [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys]


def _with_hot_mark(df: DataFrame, hot: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``_hot``; the broadcast side is bounded by :func:`hot_keys`."""
    marks = F.broadcast(hot.select(*keys, F.lit(True).alias("_mark")))
    joined = df.alias("d").join(marks.alias("h"), all_of(_same("d", "h", keys)), "left")
    return joined.select("d.*", F.coalesce(F.col("h._mark"), F.lit(False)).alias("_hot"))


def _salted(df: DataFrame, hot: DataFrame, keys: Sequence[str], salts: int) -> DataFrame:
    """Add ``_hot`` and ``_salt``; rows of hot keys are dealt round by their position.

    The position, unlike the content, differs between equal rows. It may change when a task
    is run again, so rows that need it are stored with it before they are shuffled; without
    hot keys nothing is stored.
    """
    marked = _with_hot_mark(df, hot, keys)
    if hot.isEmpty():
        return marked.withColumn("_salt", F.lit(0))
    position = F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")
    return cut_lineage(marked.withColumn("_salt", F.when(F.col("_hot"), position).otherwise(0)))


def _copied(df: DataFrame, hot: DataFrame, keys: Sequence[str], salts: int) -> DataFrame:
    """Add ``_hot`` and ``_salt``; a row of a hot key is copied to every salt."""
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return _with_hot_mark(df, hot, keys).withColumn("_salt", F.explode(copies))


def join_unique(
    rows: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    n: str,
    salts: int = SALTS,
    hot_rows: int = HOT_ROWS,
    share: float = HOT_SHARE,
) -> DataFrame:
    """Add to each row the lookup row of its key, where keys repeat in ``rows``.

    ``lookup`` has one row per key and counts in column ``n`` how many rows share the
    key. Rows of hot keys are spread over ``salts`` tasks. NULL keys match NULL keys.
    """
    hot = hot_keys(lookup, keys, n, share, hot_rows)
    left, right = _salted(rows, hot, keys, salts), _copied(lookup, hot, keys, salts)
    joined = left.alias("l").join(right.alias("r"), all_of(_same("l", "r", [*keys, "_salt"])), "left")
    extra = [c for c in lookup.columns if c not in keys]
    return joined.select(*[F.col(f"l.{c}") for c in rows.columns], *[F.col(f"r.{c}") for c in extra])


def join_counted(
    rows: DataFrame, lookup: DataFrame, keys: Sequence[str], n: str, max_rows: int = BROADCAST_ROWS, **limits
) -> DataFrame:
    """:func:`join_unique` for a lookup that is expected to be small.

    The lookup is computed once and counted. Up to ``max_rows`` it is broadcast, so the
    rows are not shuffled at all; beyond that the salted join is used.
    """
    lookup = cut_lineage(lookup)
    if lookup.limit(max_rows + 1).count() > max_rows:
        return join_unique(rows, lookup, keys, n, **limits)
    joined = rows.alias("l").join(F.broadcast(lookup.alias("r")), all_of(_same("l", "r", keys)), "left")
    extra = [c for c in lookup.columns if c not in keys]
    return joined.select(*[F.col(f"l.{c}") for c in rows.columns], *[F.col(f"r.{c}") for c in extra])


def add_group_stats(
    rows: DataFrame, keys: Sequence[str], aggs: Sequence[Column], n: str = "_n", few_keys: bool = False, **limits
) -> DataFrame:
    """Aggregate per key and put the result on every row of the key.

    Same result as an aggregate over an unordered window, without pulling a whole
    group into one task: map-side aggregation, then a salted join, or a broadcast of
    the counted result when ``few_keys`` are expected.
    """
    stats = rows.groupBy(*keys).agg(*aggs, F.count(F.lit(1)).alias("_rows_of_key"))
    if few_keys:
        out = join_counted(rows, stats, keys, "_rows_of_key", **limits)
    else:
        # stored once, as the hot-key list and the join both read it
        out = join_unique(rows, cut_lineage(stats), keys, "_rows_of_key", **limits)
    return out.withColumnRenamed("_rows_of_key", n) if n != "_n" else out.drop("_rows_of_key")


def link_lookup(index: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Left join to a table with at most one row per key; no row is added or lost."""
    shared = (set(index.columns) & set(table.columns)) - {key}
    if shared:
        raise ValueError(f"columns on both sides of the link: {sorted(shared)}")
    return index.join(table, key, "left")


def link_many(
    index: DataFrame,
    table: DataFrame,
    key: str,
    on_duplicates: str = "keep",
    order: Sequence[str] = (),
    salts: int = SALTS,
    hot_rows: int = HOT_ROWS,
    share: float = HOT_SHARE,
) -> DataFrame:
    """Left join of a unique index list to a table that may repeat keys.

    ``keep`` returns one row per match, ``first`` only the first match in ``order``,
    ``error`` fails the job when a key repeats.
    """
    extra = [c for c in table.columns if c != key]
    if on_duplicates == "first":
        packed = F.struct(*order, *[c for c in extra if c not in order])
        first = table.groupBy(key).agg(F.min(packed).alias("_row"))
        return link_lookup(index, first.select(key, *[F.col(f"_row.{c}").alias(c) for c in extra]), key)
    if on_duplicates == "error":
        one = table.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*extra)).alias("_row"))
        message = F.lit(f"{key} repeats in a table expected to be unique")
        one = one.where(F.assert_true(F.col("_n") == 1, message).isNull())
        return link_lookup(index, one.select(key, *[F.col(f"_row.{c}").alias(c) for c in extra]), key)
    # stored once, as the lists of hot keys on both sides read it
    counts = cut_lineage(table.groupBy(key).agg(F.count(F.lit(1)).alias("n")))

    # keep: spread the repeated side of hot keys, copy their single index row to each salt
    hot = hot_keys(counts, [key], "n", share, hot_rows).where(F.col(key).isNotNull())
    right = _salted(table, hot, [key], salts).drop("_hot").withColumn("_found", F.lit(True))
    joined = _copied(index, hot, [key], salts).join(right, [key, "_salt"], "left")
    # a hot key has matches under some salt, so its unmatched copies are no rows of the result
    kept = joined.where(F.col("_found").isNotNull() | ~F.col("_hot"))
    return kept.select(*index.columns, *extra)


def _present(events: DataFrame, key: str, event_key: str, present: str) -> DataFrame:
    found = events.where(F.col(present).isNotNull() & F.col(event_key).isNotNull())
    return found if event_key == key else found.withColumnRenamed(event_key, key)


def link_events(
    index: DataFrame, events: DataFrame, key: str, event_key: str, present: str,
    salts: int = SALTS, hot_rows: int = HOT_ROWS, share: float = HOT_SHARE,
) -> DataFrame:
    """Index × events of the same entity, events without ``present`` dropped.

    Events of hot keys are dealt over ``salts`` tasks, the index rows of those keys copied to each.
    """
    found = _present(events, key, event_key, present)
    # stored once, as the total and the list of hot keys both read it
    counts = cut_lineage(found.groupBy(key).agg(F.count(F.lit(1)).alias("n")))
    hot = hot_keys(counts, [key], "n", share, hot_rows)
    right = _salted(found, hot, [key], salts).drop("_hot")
    joined = _copied(index, hot, [key], salts).join(right, [key, "_salt"], "inner")
    return joined.select(*index.columns, *[c for c in found.columns if c != key])


def link_events_within(
    index: DataFrame, events: DataFrame, key: str, event_key: str, index_date: str, event_date: str, low: int, high: int
) -> DataFrame:
    """Index × events of the same entity whose lag (event minus index, in days) is low to high.

    Dates are cut into bins as wide as the window, so an index row reaches two bins at most
    and an event lies in one. The join is on (entity, bin): an entity of any size is spread
    over its bins, a pair outside the window is never a row, and a pair inside comes once.
    Rows without a key or a date have no pairs.
    """
    if high < low:
        raise ValueError("the window ends before it starts")
    width = high - low + 1
    day = lambda c, shift: F.floor((F.unix_date(F.col(c)) + shift) / width).cast("int")
    bins = F.array_distinct(F.array(day(index_date, low), day(index_date, high)))
    left = index.where(F.col(index_date).isNotNull()).withColumn("_bin", F.explode(bins))
    found = _present(events, key, event_key, event_date)
    right = found.withColumn("_bin", day(event_date, 0))
    lag = F.datediff(F.col(f"e.{event_date}"), F.col(f"i.{index_date}"))
    met = all_of([F.col(f"i.{key}") == F.col(f"e.{key}"), F.col("i._bin") == F.col("e._bin"), lag.between(low, high)])
    joined = left.alias("i").join(right.alias("e"), met)
    return joined.select(*[F.col(f"i.{c}") for c in index.columns], *[F.col(f"e.{c}") for c in found.columns if c != key])


def accept_in_window(df: DataFrame, lag: Column, low: int, high: int, fields: Sequence[str]) -> DataFrame:
    """Keep linked fields only when the lag lies in the window; rows always stay."""
    outside = lag.isNotNull() & ~in_lag(lag, low, high)
    return df.withColumns({f: blank_where(f, outside) for f in fields})


def move_to_late_record(
    df: DataFrame,
    index_date: str,
    record_date: str,
    gap: int,
    updates: Mapping[str, Column],
) -> DataFrame:
    """Treat a linked record more than ``gap`` days after the index as a new episode.

    The index moves to the record and ``updates`` (new value per column) apply to the
    rows concerned. All masks are evaluated on the state before the move.
    """
    late = in_lag(days_between(record_date, index_date), gap + 1)
    changes = {index_date: masked(index_date, late, F.col(record_date))}
    changes.update({c: masked(c, late, v) for c, v in updates.items()})
    return df.withColumns(changes)


def recency_flag(df: DataFrame, index_date: str, event_date: str, days: int, name: str) -> DataFrame:
    """1 when the index is less than ``days`` days after the event, or before it."""
    return df.withColumn(name, flag(days_between(index_date, event_date) < days))


def level_lookup(df: DataFrame, level_col: str, values: Mapping, name: str) -> DataFrame:
    """Value per level from a literal map: a projection, so no join is needed."""
    out = None
    for level, value in values.items():
        hit = F.col(level_col) == F.lit(level)
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return df.withColumn(name, out)


def days_since_first(df: DataFrame, date_col: str, name: str) -> DataFrame:
    """Days since the earliest date of the whole table."""
    first = df.agg(F.min(date_col)).scalar()
    return df.withColumn(name, days_between(F.col(date_col), first))
