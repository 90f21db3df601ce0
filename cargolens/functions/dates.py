"""Relative dates for query parameters, and period keys for columns."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def relative_date(text: str, today: dt.date) -> dt.date | None:
    """ISO dates, today, yesterday, last_N_days, mtd, qtd, ytd and qN_YYYY (that quarter's first day); None for anything else."""
    low = text.lower()
    if re.match(r"\d{4}-\d{2}-\d{2}", text):
        try:
            return dt.date.fromisoformat(text[:10])
        except ValueError:
            return None
    starts = {"today": today, "yesterday": today - dt.timedelta(days=1), "mtd": today.replace(day=1), "qtd": dt.date(today.year, (today.month - 1) // 3 * 3 + 1, 1), "ytd": dt.date(today.year, 1, 1)}
    if low in starts:
        return starts[low]
    if m := re.fullmatch(r"last_(\d+)_days", low):
        return today - dt.timedelta(days=int(m[1]))
    if m := re.fullmatch(r"q([1-4])_(\d{4})", low):
        return dt.date(int(m[2]), int(m[1]) * 3 - 2, 1)
    return None


def period(date: Column, grain: str) -> Column:
    """Key of a daily, weekly (weeks start on Monday, days before the first Monday are week 00) or monthly period."""
    if grain == "daily":
        return F.date_format(date, "yyyy-MM-dd")
    if grain == "monthly":
        return F.date_format(date, "yyyy-MM")
    if grain == "weekly":
        week = F.floor((F.dayofyear(date) + 6 - F.weekday(date)) / 7).cast("string")
        return F.concat(F.date_format(date, "yyyy"), F.lit("-W"), F.lpad(week, 2, "0"))
    raise ValueError("grain is daily, weekly or monthly")
