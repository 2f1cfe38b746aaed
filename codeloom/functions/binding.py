"""Naming intermediate values inside one column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often ``body`` uses it.

    Written out several times, a sub-expression would be planned and evaluated several times, and
    a filter pushed below a projection would copy it again.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
