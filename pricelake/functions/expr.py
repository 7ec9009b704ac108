"""Binding of an intermediate value inside one Column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    Using a regex result several times would repeat it in the plan; inside a DataFrame a
    ``withColumn`` does the same job, in a Column function this does.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
