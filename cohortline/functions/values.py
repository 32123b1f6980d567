"""Masking, defaults, precedence, indicators and recoding on Columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortline.functions.dates import col


def masked(c, mask: Column, value) -> Column:
    """Replace ``c`` by ``value`` where ``mask`` is TRUE; a NULL mask keeps ``c``."""
    value = value if isinstance(value, Column) else F.lit(value)
    return F.when(mask, value).otherwise(col(c))


def blank_where(c, mask: Column) -> Column:
    """NULL where ``mask`` is TRUE, else the value."""
    return F.when(~F.coalesce(mask, F.lit(False)), col(c))


def flag(condition: Column) -> Column:
    """0/1 indicator; NULL conditions count as 0."""
    return F.when(condition, 1).otherwise(0)


def clamp_count(c) -> Column:
    """Turn a count (NULL = none) into a 0/1 status."""
    return flag(col(c) > 0)


def default_to(c, value) -> Column:
    return F.coalesce(col(c), F.lit(value))


def first_known(*cs) -> Column:
    """Value of the first source that has one."""
    return F.coalesce(*[col(c) for c in cs])


def earliest_of(*dates) -> Column:
    """Earliest of several dates, ignoring the missing ones."""
    return F.least(*[col(d) for d in dates])


def repaired_interval(start, end) -> tuple[Column, Column]:
    """Both ends of an interval, NULL where it ends before it starts."""
    broken = col(end) < col(start)
    return blank_where(start, broken), blank_where(end, broken)


def recode(c, mapping: Mapping, default=None) -> Column:
    """Map listed values, send the rest to ``default``; NULL stays NULL."""
    c = col(c)
    out = F.when(c.isNull(), F.lit(None))
    for old, new in mapping.items():
        out = out.when(c == F.lit(old), F.lit(new))
    return out.otherwise(F.lit(default))


def exactly_one(*flags) -> Column:
    """TRUE when exactly one of several 0/1 columns is set."""
    return reduce(lambda a, b: a + b, [col(f) for f in flags]) == 1


def null_or(c, test: Column) -> Column:
    """Null-tolerant condition: missing values pass."""
    return col(c).isNull() | test


def null_or_in(c, allowed: Sequence) -> Column:
    return null_or(c, col(c).isin(*allowed))


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def typed_null(sql_type: str) -> Column:
    return F.lit(None).cast(sql_type)
