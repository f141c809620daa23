"""Column expressions: a thin facade over Spark's Column.

An Expr holds a Column and what a Column can't say: whether its values are three-valued (1 true, 0 unknown,
-1 false), which sentinel values of a column count as unknown, the name of the column it comes from, and whether
it still needs a window. Everything compiles to built-in functions, so Catalyst sees all of it.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tessera.functions.dtypes import UNSIGNED_MAX, resolve_dtype, spark_type
from tessera.functions.nulls import ieee_divide, ieee_log, literal

TRUE, UNKNOWN, FALSE = 1, 0, -1
BOOLEANIZERS = ("is_true", "is_false", "is_unknown", "is_known", "maybe_true", "maybe_false")


class Expr:
    """An expression; build one with col(), lit(), t_col(), native() or when()."""

    def __init__(
        self,
        column: Column,
        *,
        kind: str = "value",
        unknown: frozenset | None = None,
        leaf: str | None = None,
        window: str | None = None,
        named: str | None = None,
    ):
        """kind: value, boolean or ternary. unknown: values of a column that count as unknown. window: "needed" for a
        window function without its window, "whole" for one that by default sees the whole partition."""
        self.column, self.kind, self.unknown, self.leaf, self.window, self.named = column, kind, unknown, leaf, window, named

    # ---- building blocks

    def _with(self, column: Column, kind: str = "value", **more: Any) -> Expr:
        return Expr(column, kind=kind, leaf=self.leaf, **more)

    def _bool(self, column: Column) -> Expr:
        return self._with(column, "boolean")

    @property
    def as_boolean(self) -> Column:
        """The column as a predicate: three-valued results keep only what is true."""
        return self.column == TRUE if self.kind == "ternary" else self.column

    @property
    def as_ternary(self) -> Column:
        return self.column if self.kind == "ternary" else F.when(self.column, TRUE).otherwise(FALSE)

    def compile(self, booleanizer: str | Callable[[Expr], Expr] | None = "is_true") -> Column:
        """The Spark Column. Three-valued results become boolean by `booleanizer`; None keeps -1, 0, 1."""
        if self.window is not None:
            raise ValueError("this function needs a window: call .over(...)")
        out = self
        if self.kind == "ternary" and booleanizer is not None:
            if callable(booleanizer):
                out = booleanizer(self)
            elif booleanizer in BOOLEANIZERS:
                out = getattr(self, booleanizer)()
            else:
                raise ValueError(f"unknown booleanizer {booleanizer!r}; known: {', '.join(BOOLEANIZERS)}")
        return out.column.alias(self.named) if self.named else out.column

    def __repr__(self) -> str:
        return f"Expr({self.column}, {self.kind})"

    __hash__ = object.__hash__

    def __bool__(self) -> bool:
        raise TypeError("an expression has no truth value: combine with & | ~")

    # ---- namespaces; their methods can also be called on the expression itself

    @property
    def str(self):
        from tessera.functions.strings import StringMethods

        return StringMethods(self)

    @property
    def dt(self):
        from tessera.functions.datetimes import DateTimeMethods

        return DateTimeMethods(self)

    @property
    def name(self):
        from tessera.functions.names import NameMethods

        return NameMethods(self)

    def __getattr__(self, method: str) -> Any:
        if not method.startswith("_"):
            from tessera.functions.datetimes import DateTimeMethods
            from tessera.functions.names import NameMethods
            from tessera.functions.strings import StringMethods

            for space in (StringMethods, DateTimeMethods, NameMethods):
                if hasattr(space, method):
                    return getattr(space(self), method)
        raise AttributeError(f"expressions have no method {method!r}")

    # ---- comparison

    def eq(self, other: Any) -> Expr:
        return self._bool(self.column == literal(other))

    def ne(self, other: Any) -> Expr:
        return self._bool(self.column != literal(other))

    def gt(self, other: Any) -> Expr:
        return self._bool(self.column > literal(other))

    def lt(self, other: Any) -> Expr:
        return self._bool(self.column < literal(other))

    def ge(self, other: Any) -> Expr:
        return self._bool(self.column >= literal(other))

    def le(self, other: Any) -> Expr:
        return self._bool(self.column <= literal(other))

    equal, not_equal, gte, lte = eq, ne, ge, le

    def between(self, low: Any, high: Any, closed: str = "both") -> Expr:
        """Within bounds; closed is both, left, right or none."""
        if closed not in ("both", "left", "right", "none"):
            raise ValueError("closed is one of both, left, right, none")
        over = self.column >= literal(low) if closed in ("both", "left") else self.column > literal(low)
        under = self.column <= literal(high) if closed in ("both", "right") else self.column < literal(high)
        return self._bool(over & under)

    is_between = between

    def is_null(self) -> Expr:
        return self._bool(self.column.isNull())

    def is_not_null(self) -> Expr:
        return self._bool(self.column.isNotNull())

    def is_nan(self) -> Expr:
        return self._bool(F.when(self.column.isNotNull(), F.isnan(self.column)))

    def is_not_nan(self) -> Expr:
        return self._bool(~self.is_nan().column)

    def is_finite(self) -> Expr:
        return self._bool(~self.is_nan().column & (F.abs(self.column) != float("inf")))

    def is_infinite(self) -> Expr:
        return self._bool(F.abs(self.column) == float("inf"))

    def eq_missing(self, other: Any) -> Expr:
        """Equality in which NULL equals NULL."""
        return self._bool(self.column.eqNullSafe(literal(other)))

    def ne_missing(self, other: Any) -> Expr:
        return self._bool(~self.column.eqNullSafe(literal(other)))

    is_not_distinct_from, is_distinct_from = eq_missing, ne_missing

    def is_close(self, other: Any, abs_tol: float = 1e-8, rel_tol: float = 1e-5) -> Expr:
        b = literal(other)
        return self._bool(F.abs(self.column - b) <= F.lit(abs_tol) + F.lit(rel_tol) * F.abs(b))

    def coalesce(self, *others: Any) -> Expr:
        return self._with(F.coalesce(self.column, *map(literal, others)))

    def greatest(self, *others: Any) -> Expr:
        """The largest; NULLs are passed over."""
        return self._with(F.greatest(self.column, *map(literal, others)) if others else self.column)

    def least(self, *others: Any) -> Expr:
        return self._with(F.least(self.column, *map(literal, others)) if others else self.column)

    greatest_skip_null, least_skip_null = greatest, least

    def nullif(self, other: Any) -> Expr:
        return self._with(F.nullif(self.column, literal(other)))

    null_if = nullif

    def clip(self, lower: Any = None, upper: Any = None) -> Expr:
        """Values bound to a range; NULL stays NULL."""
        out = self.column
        if lower is not None:
            out = F.when(out < literal(lower), literal(lower)).otherwise(out)
        if upper is not None:
            out = F.when(out > literal(upper), literal(upper)).otherwise(out)
        return self._with(out)

    # ---- membership

    def is_in(self, *values: Any) -> Expr:
        some = _flat(values)
        return self._bool(self.column.isin(*map(literal, some)) if some else F.lit(False))

    def is_not_in(self, *values: Any) -> Expr:
        return self._bool(~self.is_in(*values).column)

    def index_in(self, *values: Any) -> Expr:
        """0-based place of the first equal value, -1 if none; NULL only finds a NULL."""
        out = F.lit(-1)
        for i, v in reversed(list(enumerate(_flat(values)))):
            out = F.when(self.column.eqNullSafe(literal(v)), i).otherwise(out)
        return self._with(out)

    # ---- boolean logic

    def and_(self, *others: Any) -> Expr:
        return self._bool(functools.reduce(operator.and_, map(_predicate, others), self.as_boolean))

    def or_(self, *others: Any) -> Expr:
        return self._bool(functools.reduce(operator.or_, map(_predicate, others), self.as_boolean))

    def not_(self) -> Expr:
        return self._bool(~self.as_boolean)

    def xor_(self, *others: Any) -> Expr:
        return self._bool(functools.reduce(operator.ne, map(_predicate, others), self.as_boolean))

    xor = xor_parity = xor_

    def and_not(self, other: Any) -> Expr:
        return self._bool(self.as_boolean & ~_predicate(other))

    def always_true(self) -> Expr:
        return self._bool(F.lit(True))

    def always_false(self) -> Expr:
        return self._bool(F.lit(False))

    # ---- truth tests: of three-valued results, else of booleans

    def is_true(self) -> Expr:
        return self._bool(self.column == TRUE if self.kind == "ternary" else self.column == F.lit(True))

    def is_false(self) -> Expr:
        return self._bool(self.column == FALSE if self.kind == "ternary" else self.column == F.lit(False))

    def is_not_true(self) -> Expr:
        return self._bool(~self.as_boolean.eqNullSafe(F.lit(True)))

    def is_not_false(self) -> Expr:
        return self._bool(self.column != FALSE if self.kind == "ternary" else ~self.column.eqNullSafe(F.lit(False)))

    def is_unknown(self) -> Expr:
        return self._bool(self.as_ternary == UNKNOWN)

    def is_known(self) -> Expr:
        return self._bool(self.as_ternary != UNKNOWN)

    def maybe_true(self) -> Expr:
        return self._bool(self.as_ternary >= UNKNOWN)

    def maybe_false(self) -> Expr:
        return self._bool(self.as_ternary <= UNKNOWN)

    # ---- three-valued logic

    def to_ternary(self) -> Expr:
        """TRUE is 1; FALSE and NULL are -1."""
        return self._with(self.as_ternary, "ternary")

    def _is_unknown_value(self) -> Column:
        values = self.unknown if self.unknown is not None else frozenset({None})
        some = [v for v in values if v is not None]
        tests = ([self.column.isNull()] if None in values else []) + ([F.coalesce(self.column.isin(*some), F.lit(False))] if some else [])
        return functools.reduce(operator.or_, tests, F.lit(False))

    def _compare(self, other: Any, test: Callable[[Column, Column], Column]) -> Expr:
        right = other if isinstance(other, Expr) else Expr(literal(other))
        unknown = self._is_unknown_value() | right._is_unknown_value()
        return self._with(F.when(unknown, UNKNOWN).when(test(self.column, right.column), TRUE).otherwise(FALSE), "ternary")

    def t_eq(self, other: Any) -> Expr:
        return self._compare(other, operator.eq)

    def t_ne(self, other: Any) -> Expr:
        return self._compare(other, operator.ne)

    def t_gt(self, other: Any) -> Expr:
        return self._compare(other, operator.gt)

    def t_lt(self, other: Any) -> Expr:
        return self._compare(other, operator.lt)

    def t_ge(self, other: Any) -> Expr:
        return self._compare(other, operator.ge)

    def t_le(self, other: Any) -> Expr:
        return self._compare(other, operator.le)

    def _member(self, values: Any) -> tuple[Column, Column]:
        if isinstance(values, (Expr, Column)):  # a list column; a NULL list tells nothing
            listed = literal(values)
            return F.array_contains(listed, self.column), self._is_unknown_value() | listed.isNull()
        some = list(values)
        return (self.column.isin(*map(literal, some)) if some else F.lit(False)), self._is_unknown_value()

    def t_is_in(self, values: Any) -> Expr:
        found, unknown = self._member(values)
        return self._with(F.when(unknown, UNKNOWN).when(found, TRUE).otherwise(FALSE), "ternary")

    def t_is_not_in(self, values: Any) -> Expr:
        found, unknown = self._member(values)
        return self._with(F.when(unknown, UNKNOWN).when(~found, TRUE).otherwise(FALSE), "ternary")

    def t_and(self, *others: Any) -> Expr:
        return self._with(F.least(self.as_ternary, *map(_ternary, others)) if others else self.as_ternary, "ternary")

    def t_or(self, *others: Any) -> Expr:
        return self._with(F.greatest(self.as_ternary, *map(_ternary, others)) if others else self.as_ternary, "ternary")

    def t_not(self) -> Expr:
        return self._with(-self.as_ternary, "ternary")

    def _count_true(self, others: tuple, holds: Callable[[Column], Column]) -> Expr:
        every = [self.as_ternary, *map(_ternary, others)]
        unknown = functools.reduce(operator.or_, [c == UNKNOWN for c in every])
        true = functools.reduce(operator.add, [(c == TRUE).cast("int") for c in every])
        return self._with(F.when(unknown, UNKNOWN).when(holds(true), TRUE).otherwise(FALSE), "ternary")

    def t_xor(self, *others: Any) -> Expr:
        """True if exactly one is; unknown if any is."""
        return self._count_true(others, lambda n: n == 1)

    def t_xor_parity(self, *others: Any) -> Expr:
        """True if an odd number is; unknown if any is."""
        return self._count_true(others, lambda n: n % 2 == 1)

    # ---- arithmetic

    def add(self, other: Any) -> Expr:
        return self._with(self.column + literal(other))

    def subtract(self, other: Any) -> Expr:
        return self._with(self.column - literal(other))

    def rsubtract(self, other: Any) -> Expr:
        return self._with(literal(other) - self.column)

    def multiply(self, other: Any) -> Expr:
        return self._with(self.column * literal(other))

    def divide(self, other: Any) -> Expr:
        """Float division as IEEE 754 has it: x/0 is an infinity, 0/0 is NaN."""
        return self._with(ieee_divide(self.column, literal(other)))

    def rdivide(self, other: Any) -> Expr:
        return self._with(ieee_divide(literal(other), self.column))

    def modulo(self, other: Any) -> Expr:
        """The remainder with the sign of the divisor; NULL for a divisor of 0."""
        return self._with(_modulo(self.column, literal(other)))

    def rmodulo(self, other: Any) -> Expr:
        return self._with(_modulo(literal(other), self.column))

    def floor_divide(self, other: Any) -> Expr:
        """Division rounded towards minus infinity; NULL for a divisor of 0."""
        return self._with(F.floor(F.try_divide(self.column, literal(other))))

    def rfloor_divide(self, other: Any) -> Expr:
        return self._with(F.floor(F.try_divide(literal(other), self.column)))

    def power(self, other: Any) -> Expr:
        return self._with(F.pow(self.column, literal(other)))

    def rpower(self, other: Any) -> Expr:
        return self._with(F.pow(literal(other), self.column))

    def negate(self) -> Expr:
        return self._with(-self.column)

    sub, mul, truediv, mod, pow, neg = subtract, multiply, divide, modulo, power, negate
    modulus, rmodulus = modulo, rmodulo

    def abs(self, **_: Any) -> Expr:
        return self._with(F.abs(self.column))

    def sign(self) -> Expr:
        return self._with(F.signum(self.column))

    def round(self, decimals: int | None = None) -> Expr:
        """Half away from zero."""
        if decimals is not None and not isinstance(decimals, int):
            raise TypeError("decimals is an int")
        return self._with(F.round(self.column, decimals or 0))

    def ceil(self) -> Expr:
        return self._with(F.ceil(self.column))

    def floor(self) -> Expr:
        return self._with(F.floor(self.column))

    def ln(self) -> Expr:
        return self._with(ieee_log(self.column, F.ln))

    def log10(self) -> Expr:
        return self._with(ieee_log(self.column, F.log10))

    def log2(self) -> Expr:
        return self._with(ieee_log(self.column, F.log2))

    def log1p(self) -> Expr:
        return self._with(ieee_log(self.column + 1, lambda _: F.log1p(self.column)))

    def log(self, base: Any) -> Expr:
        return self._with(ieee_divide(ieee_log(self.column, F.ln), ieee_log(literal(base), F.ln)))

    def atan2(self, other: Any) -> Expr:
        return self._with(F.atan2(self.column, literal(other)))

    def factorial(self) -> Expr:
        return self._with(F.factorial(self.column))

    def bitwise_and(self, other: Any) -> Expr:
        return self._with(self.column.bitwiseAND(literal(other)))

    def bitwise_or(self, other: Any) -> Expr:
        return self._with(self.column.bitwiseOR(literal(other)))

    def bitwise_xor(self, other: Any) -> Expr:
        return self._with(self.column.bitwiseXOR(literal(other)))

    def bitwise_not(self) -> Expr:
        return self._with(F.bitwise_not(self.column))

    def shift_left(self, n: int) -> Expr:
        return self._with(F.shiftleft(self.column, n))

    def shift_right(self, n: int) -> Expr:
        return self._with(F.shiftright(self.column, n))

    def shift_right_unsigned(self, n: int) -> Expr:
        return self._with(F.shiftrightunsigned(self.column, n))

    # ---- nulls, casts, escape hatch

    def fill_null(self, value: Any) -> Expr:
        return self._with(F.coalesce(self.column, literal(value)), self.kind)

    def fill_nan(self, value: Any) -> Expr:
        return self._with(F.nanvl(self.column, literal(value).cast("double")))

    def cast(self, dtype: Any, *, failure_behavior: str = "throw") -> Expr:
        """To a type by name, alias, Python or Spark type. failure_behavior "null" gives NULL for what can't be
        cast, "throw" fails."""
        if failure_behavior not in ("throw", "null"):
            raise ValueError('failure_behavior is "throw" or "null"')
        lenient, target = failure_behavior == "null", spark_type(dtype)
        name = None if dtype is target else resolve_dtype(dtype)
        if name == "time":
            return self._with(F.date_format(self.column.try_cast("timestamp_ntz") if lenient else self.column.cast("timestamp_ntz"), "HH:mm:ss.SSSSSS"))
        out = self.column.try_cast(target) if lenient else self.column.cast(target)
        if name in UNSIGNED_MAX:
            bad = F.lit(None) if lenient else F.raise_error(F.lit(f"value out of range for {name}"))
            out = F.when(out.isNull() | out.between(F.lit(0), F.lit(UNSIGNED_MAX[name]).cast(target)), out).otherwise(bad.cast(target))
        return self._with(out)

    def as_native(self) -> Expr:
        return self

    # ---- aggregates

    def count(self, **_: Any) -> Expr:
        return self._with(F.count(self.column))

    def sum(self, **_: Any) -> Expr:
        return self._with(F.sum(self.column))

    def sum0(self) -> Expr:
        return self._with(F.coalesce(F.sum(self.column), F.lit(0)))

    def avg(self, **_: Any) -> Expr:
        return self._with(F.avg(self.column))

    mean = avg

    def min(self) -> Expr:
        return self._with(F.min(self.column))

    def max(self) -> Expr:
        return self._with(F.max(self.column))

    def product(self, **_: Any) -> Expr:
        return self._with(F.product(self.column))

    def std_dev(self, *, distribution: str | None = None, **_: Any) -> Expr:
        return self._with((F.stddev_pop if _population(distribution) else F.stddev_samp)(self.column))

    def variance(self, *, distribution: str | None = None, **_: Any) -> Expr:
        return self._with((F.var_pop if _population(distribution) else F.var_samp)(self.column))

    def mode(self) -> Expr:
        """The most frequent value; of several, the smallest."""
        return self._with(F.mode(self.column, deterministic=True))

    def any_value(self, *, ignore_nulls: bool | None = None) -> Expr:
        return self._with(F.any_value(self.column, F.lit(bool(ignore_nulls))))

    def bool_and(self) -> Expr:
        return self._bool(F.bool_and(self.column))

    def bool_or(self) -> Expr:
        return self._bool(F.bool_or(self.column))

    def string_agg(self, separator: str = ",") -> Expr:
        return self._with(F.listagg(self.column, F.lit(separator)))

    def count_distinct(self) -> Expr:
        return self._with(F.count_distinct(self.column))

    def approx_count_distinct(self) -> Expr:
        return self._with(F.approx_count_distinct(self.column))

    # ---- window functions

    def row_number(self) -> Expr:
        return self._with(F.row_number(), window="needed")

    def rank(self) -> Expr:
        return self._with(F.rank(), window="needed")

    def dense_rank(self) -> Expr:
        return self._with(F.dense_rank(), window="needed")

    def percent_rank(self) -> Expr:
        return self._with(F.percent_rank(), window="needed")

    def cume_dist(self) -> Expr:
        return self._with(F.cume_dist(), window="needed")

    def ntile(self, n: int) -> Expr:
        return self._with(F.ntile(n), window="needed")

    def lead(self, offset: int = 1, default: Any = None) -> Expr:
        return self._with(F.lead(self.column, offset, _plain(default)), window="needed")

    def lag(self, offset: int = 1, default: Any = None) -> Expr:
        return self._with(F.lag(self.column, offset, _plain(default)), window="needed")

    def first_value(self) -> Expr:
        return self._with(F.first(self.column), window="whole")

    def last_value(self) -> Expr:
        return self._with(F.last(self.column), window="whole")

    def nth_value(self, n: int) -> Expr:
        return self._with(F.nth_value(self.column, n), window="whole")

    def over(self, *partition_by: Any, order_by: str | list[str] | None = None, rows_between: tuple[int | None, int | None] | None = None) -> Expr:
        """Within a window: "-name" orders descending, NULLs last. rows_between counts rows from the current one,
        None is unbounded. Without it first_value, last_value and nth_value see the whole partition and other
        functions have SQL's default frame, which with order_by runs up to the current row and its peers."""
        spec = Window.partitionBy(*[literal(p) if isinstance(p, Expr) else p for p in partition_by])
        if order_by is not None:
            spec = spec.orderBy(*[sort_column(c) for c in ([order_by] if isinstance(order_by, (str, Expr)) else order_by)])
        if rows_between is not None:
            low, high = rows_between
            spec = spec.rowsBetween(Window.unboundedPreceding if low is None else low, Window.unboundedFollowing if high is None else high)
        elif self.window == "whole":
            spec = spec.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return self._with(self.column.over(spec), self.kind)

    # ---- operators

    __gt__, __lt__, __ge__, __le__, __eq__, __ne__ = gt, lt, ge, le, eq, ne
    __and__, __or__, __xor__, __invert__ = and_, or_, xor_, not_
    __add__, __sub__, __rsub__, __mul__ = add, subtract, rsubtract, multiply
    __truediv__, __rtruediv__, __floordiv__, __rfloordiv__ = divide, rdivide, floor_divide, rfloor_divide
    __mod__, __rmod__, __pow__, __rpow__, __neg__ = modulo, rmodulo, power, rpower, negate

    def __radd__(self, other: Any) -> Expr:
        return self._with(literal(other) + self.column)

    def __rmul__(self, other: Any) -> Expr:
        return self._with(literal(other) * self.column)

    def __rand__(self, other: Any) -> Expr:
        return self._bool(_predicate(other) & self.as_boolean)

    def __ror__(self, other: Any) -> Expr:
        return self._bool(_predicate(other) | self.as_boolean)


def _math(name: str, function: Callable[[Column], Column]) -> None:
    def method(self: Expr, **_: Any) -> Expr:
        return self._with(function(self.column))

    method.__name__ = name
    setattr(Expr, name, method)


for _name in ("sqrt", "exp", "sin", "cos", "tan", "asin", "acos", "atan", "sinh", "cosh", "tanh", "asinh", "acosh", "atanh", "radians", "degrees"):
    _math(_name, getattr(F, _name))


def _plain(value: Any) -> Any:
    return value.column if isinstance(value, Expr) else value


def _flat(values: Iterable[Any]) -> list[Any]:
    return [v for some in values for v in (some if isinstance(some, (list, tuple, set, frozenset, range)) else [some])]


def _predicate(value: Any) -> Column:
    return value.as_boolean if isinstance(value, Expr) else literal(value)


def _ternary(value: Any) -> Column:
    if isinstance(value, Expr):
        return value.as_ternary
    return F.when(literal(value), TRUE).otherwise(FALSE) if isinstance(value, bool) else literal(value)


def _modulo(a: Column, b: Column) -> Column:
    return F.try_mod(F.try_mod(a, b) + b, b)


def _population(distribution: str | None) -> bool:
    if distribution not in (None, "SAMPLE", "POPULATION", "sample", "population"):
        raise ValueError("distribution is SAMPLE or POPULATION")
    return str(distribution).upper() == "POPULATION"


def sort_column(by: Any, descending: bool | None = None) -> Column:
    """A sort key with NULLs last; "-name" is descending where the direction isn't given."""
    if isinstance(by, str) and descending is None and by.startswith("-"):
        by, descending = by[1:], True
    column = F.col(by) if isinstance(by, str) else literal(by)
    return column.desc_nulls_last() if descending else column.asc_nulls_last()
