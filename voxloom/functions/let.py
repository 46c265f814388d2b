"""A value that an expression uses many times, computed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), the value bound as a lambda's variable: the optimizer would put a column's expression into each use
    within a lambda, to be computed again for every element."""
    return F.get(F.transform(F.array(value), body), 0)
