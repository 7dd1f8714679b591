"""Names for intermediate values inside one column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often the body uses it.

    Columns are trees: a part used twice is copied, and parts of parts grow as powers.
    """
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)
