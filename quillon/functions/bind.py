"""A value that an expression uses more than once, worked out once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``.  Spark writes a column out wherever it is used, and shares nothing inside lambdas; the variable of a lambda is worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
