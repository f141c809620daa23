"""Entry points that make expressions."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.expr import FALSE, TRUE, UNKNOWN, Expr, _predicate
from tessera.functions.nulls import literal


def col(name: str) -> Expr:
    """A column by name."""
    return Expr(F.col(name), leaf=name.rsplit(".", 1)[-1].strip("`"))


def lit(value: Any) -> Expr:
    """A constant."""
    return Expr(F.lit(value))


def t_col(name: str, unknown: set | None = None) -> Expr:
    """A column for three-valued comparisons; `unknown` lists values that count as unknown (default: NULL).
    A set without None makes NULL compare as false."""
    return Expr(F.col(name), leaf=name, unknown=None if unknown is None else frozenset(unknown))


def native(column: Column) -> Expr:
    """A Spark Column as an expression."""
    if not isinstance(column, Column):
        raise TypeError(f"native takes a Spark Column, not {type(column).__name__}")
    return Expr(column)


def _several(name: str, exprs: tuple) -> list[Column]:
    if len(exprs) < 2:
        raise ValueError(f"{name} takes two or more arguments")
    return [literal(e) for e in exprs]


def coalesce(*exprs: Any) -> Expr:
    return Expr(F.coalesce(*_several("coalesce", exprs)))


def greatest(*exprs: Any) -> Expr:
    return Expr(F.greatest(*_several("greatest", exprs)))


def least(*exprs: Any) -> Expr:
    return Expr(F.least(*_several("least", exprs)))


def count_records() -> Expr:
    """The number of rows, NULLs included."""
    return Expr(F.count(F.lit(1)))


def corr(x: Any, y: Any, **_: Any) -> Expr:
    return Expr(F.corr(literal(x), literal(y)))


def median(*args: Any, **_: Any) -> Expr:
    """median(x), or median(precision, x) whose precision says nothing here: the result is exact."""
    return Expr(F.median(literal(args[-1])))


def quantile(x: Any, q: float, interpolation: str = "linear") -> Expr:
    """The exact quantile: linear between neighbours, or lower (a value that occurs)."""
    if interpolation == "linear":
        return Expr(F.percentile(literal(x), F.lit(q)))
    if interpolation == "lower":
        return Expr(F.percentile_approx(literal(x), q, 2**31 - 1))
    raise ValueError("interpolation is linear or lower")


def always_true() -> Expr:
    return Expr(F.lit(TRUE), kind="ternary")


def always_false() -> Expr:
    return Expr(F.lit(FALSE), kind="ternary")


def always_unknown() -> Expr:
    return Expr(F.lit(UNKNOWN), kind="ternary")


def today() -> Expr:
    return Expr(F.current_date())


def now() -> Expr:
    return Expr(F.localtimestamp())


class When:
    """when(condition).then(value) ... .otherwise(value)"""

    def __init__(self, condition: Any, done: tuple[tuple[Column, Column], ...] = ()):
        self._condition, self._done = condition, done

    def then(self, value: Any) -> Then:
        return Then((*self._done, (_predicate(self._condition), literal(value))))


class Then:
    def __init__(self, done: tuple[tuple[Column, Column], ...]):
        self._done = done

    def when(self, condition: Any) -> When:
        return When(condition, self._done)

    def otherwise(self, value: Any) -> Expr:
        (condition, result), *rest = self._done
        out = F.when(condition, result)
        for condition, result in rest:
            out = out.when(condition, result)
        return Expr(out.otherwise(literal(value)))


def when(condition: Any) -> When:
    return When(condition)


def within_last(column: Expr, duration: str) -> Expr:
    return column.dt.within_last(duration)


def older_than(column: Expr, duration: str) -> Expr:
    return column.dt.older_than(duration)


def between_last(column: Expr, older: str, newer: str) -> Expr:
    return column.dt.between_last(older, newer)
