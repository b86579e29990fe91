"""A value bound once within an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value made once though f names it several times."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """let, without the copy that a transform makes of all that f gives: the end of a fold over nothing. It nests less deep."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda a, _: a, f)
