"""Rounding of figures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Added before rounding, so that values that are ties but for their last bit round alike on any engine.
GUARD = 1e-9


def r4(value: Column | str) -> Column:
    """Four places, ties upwards."""
    return F.round((F.col(value) if isinstance(value, str) else value) + F.lit(GUARD), 4)


def r2(value: Column | str) -> Column:
    """Two places, ties upwards."""
    return F.round((F.col(value) if isinstance(value, str) else value) + F.lit(GUARD), 2)
