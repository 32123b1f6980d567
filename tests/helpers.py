"""Shared test helpers."""

from datetime import date, timedelta

DAY0 = date(2021, 12, 10)
SF = "/root/testdata/sf0.001"


def day(n):
    return None if n is None else DAY0 + timedelta(days=n)


def rows(df, *columns):
    """Rows as sorted tuples (NULLs first)."""
    out = [tuple(r) for r in df.select(*columns).collect()] if columns else [tuple(r) for r in df.collect()]
    return sorted(out, key=lambda r: [(v is not None, str(type(v)), v) if v is not None else (False, "", 0) for v in r])


def by_key(df, key, column):
    return {r[key]: r[column] for r in df.select(key, column).collect()}
