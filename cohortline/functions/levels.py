"""Bands, level maps and interaction keys (categorical variables as strings)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortline.functions.dates import col


def band_labels(breaks: Sequence[float]) -> list[str]:
    """Labels of left-closed bands; the last band is open-ended."""
    inner = [f"[{lo:g},{hi:g})" for lo, hi in zip(breaks[:-1], breaks[1:])]
    return inner + [f"[{breaks[-1]:g},Inf]"]


def band(c, breaks: Sequence[float]) -> Column:
    """Label of the left-closed band that holds the value, NULL below the first."""
    c = col(c)
    labels = band_labels(breaks)
    out = F.when(c.isNull() | (c < breaks[0]), F.lit(None))
    for upper, label in zip(breaks[1:], labels):
        out = out.when(c < upper, label)
    return out.otherwise(labels[-1])


def band_floor(c, width: int = 10, low_bands: Sequence[tuple[float, int]] = (), cap: int = 80) -> Column:
    """Lower edge of the value's band as an integer.

    ``low_bands`` lists (exclusive upper edge, band value) pairs tried first; the
    rest falls in bands of ``width``, and everything from ``cap`` upwards is one band.
    """
    c = col(c)
    # least() skips NULLs, so a missing value needs its own guard
    regular = F.when(c.isNotNull(), F.least((F.floor(c / width) * width).cast("int"), F.lit(cap)))
    if not low_bands:
        return regular
    out = F.when(c.isNull(), F.lit(None).cast("int"))
    for upper, value in low_bands:
        out = out.when(c < upper, value)
    return out.otherwise(regular)


def within_band(c, floor_col) -> Column:
    """Distance of a value from the lower edge of its band."""
    return col(c) - col(floor_col)


def collapse(c, groups: Mapping[str, Sequence]) -> Column:
    """Merge listed levels into named groups; unlisted levels stay as they are."""
    c = col(c)
    out = None
    for name, members in groups.items():
        hit = c.isin(*members)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return c if out is None else out.otherwise(c)


def interaction(*parts, sep: str = ".") -> Column:
    """Key of a product of categories; NULL as soon as one part is NULL."""
    pieces: list[Column] = []
    for i, part in enumerate(parts):
        if i:
            pieces.append(F.lit(sep))
        pieces.append(col(part).cast("string"))
    return F.concat(*pieces)


def prefixed(prefix: str, c) -> Column:
    return F.concat(F.lit(prefix), col(c).cast("string"))


def strip_labels(c, prefixes: Sequence[str]) -> Column:
    """Remove the first occurrence of each given text from a term label."""
    out = col(c)
    for text in prefixes:
        out = F.when(
            F.instr(out, text) > 0,
            F.concat(F.substring_index(out, text, 1), _after_first(out, text)),
        ).otherwise(out)
    return out


def _after_first(c: Column, text: str) -> Column:
    start = F.instr(c, text) + F.lit(len(text))
    return F.substr(c, start)
