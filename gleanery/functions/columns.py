"""Helpers that build column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(array: Column, kind: str = "long") -> Column:
    """Sum of an array's numbers; 0 for an empty one."""
    return F.aggregate(array, F.lit(0).cast(kind), lambda a, x: a + x.cast(kind))


def share(part: Column, whole: Column, digits: int = 4) -> Column:
    """part / whole, rounded; 0 where whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(part / whole, digits))


def count_share(part: Column, whole: Column, digits: int = 4) -> Column:
    """What ``share`` gives of two counts, by whole numbers: exact, half up, and without a decimal made for each row."""
    tens = 10**digits
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.call_function("div", 2 * tens * part + whole, 2 * whole) / tens)
