"""Date parsing and day arithmetic on Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The text layouts found in the record files. Single-letter day and
# month patterns read both "3/1/2022" and "03/01/2022".
LAYOUTS = {
    "dmy": "d/M/yyyy",
    "iso": "yyyy-M-d",
    "dmon": "dMMMyyyy",
}


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_date(c, layout: str = "iso") -> Column:
    """Text to date; unreadable text becomes NULL instead of an error."""
    return F.try_to_date(F.trim(col(c)), LAYOUTS[layout])


def days_between(later, earlier) -> Column:
    """Whole days from ``earlier`` to ``later`` as an integer."""
    return F.datediff(col(later), col(earlier))


def shift_days(c, days) -> Column:
    return F.date_add(col(c), days)


def in_lag(lag, low: int | None = None, high: int | None = None) -> Column:
    """TRUE when a day lag lies in the closed range, FALSE for a NULL lag."""
    lag = col(lag)
    test = lag.isNotNull()
    if low is not None:
        test = test & (lag >= low)
    if high is not None:
        test = test & (lag <= high)
    return test
