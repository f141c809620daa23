"""Literals, and float arithmetic as IEEE 754 has it where Spark raises or gives NULL."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

INF, NAN = float("inf"), float("nan")


def literal(value: Any) -> Column:
    """The Column of an expression or Column; anything else as a constant."""
    if isinstance(value, Column):
        return value
    column = getattr(value, "column", None)
    return column if isinstance(column, Column) else F.lit(value)


def ieee_divide(x: Column, y: Column) -> Column:
    x, y = x.cast("double"), y.cast("double")
    return F.when(y == 0, x * F.lit(INF)).otherwise(F.try_divide(x, y))


def ieee_log(x: Column, log: Callable[[Column], Column]) -> Column:
    return F.when(x == 0, F.lit(-INF)).when(x < 0, F.lit(NAN)).otherwise(log(x))
