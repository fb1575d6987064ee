"""A name for a value inside a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once per row, however often the body mentions it.

    A column that is mentioned twice is two expressions, and one inside a higher-order function
    is computed for every element; a variable of a higher-order function is neither.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
