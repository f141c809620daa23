"""Named converters of values: each with a Column form, which runs in the JVM, or a Python form, or both.

A converter that has only a Python form runs as a vectorised UDF when applied to a Column.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.dtypes import UNIVERSAL_TO_SPARK, UniversalType, normalize_type

DIRECTIONS = ("ingress", "egress", "both")


@dataclass(frozen=True)
class Converter:
    name: str
    target: UniversalType
    python: Callable[..., Any] | None = None
    column: Callable[[Column], Column] | None = None
    description: str = ""
    direction: str = "both"

    @property
    def is_vectorized(self) -> bool:
        return self.column is not None

    @property
    def has_python_fallback(self) -> bool:
        return self.python is not None


class ConverterRegistry:
    """Converters by name."""

    def __init__(self) -> None:
        self._known: dict[str, Converter] = {}

    def register(self, name: str, target: Any, python: Callable[..., Any] | None = None, column: Callable[[Column], Column] | None = None, description: str = "", direction: str = "both") -> Converter:
        if python is None and column is None:
            raise ValueError("a converter needs a Python or a Column form")
        if direction not in DIRECTIONS:
            raise ValueError(f"direction is one of {', '.join(DIRECTIONS)}")
        self._known[name] = Converter(name, normalize_type(target), python, column, description, direction)
        return self._known[name]

    def unregister(self, name: str) -> None:
        del self._known[self.get_spec(name).name]

    def has_converter(self, name: str) -> bool:
        return name in self._known

    def get_spec(self, name: str) -> Converter:
        if name not in self._known:
            raise KeyError(f"no converter {name!r}; known: {', '.join(sorted(self._known))}")
        return self._known[name]

    def is_vectorized(self, name: str) -> bool:
        return name in self._known and self._known[name].is_vectorized

    def is_native_type(self, name: str) -> bool:
        """Whether the name is a logical type rather than a converter."""
        return name in set(UniversalType)

    def list_converters(self) -> list[str]:
        return sorted(self._known)

    def clear(self) -> None:
        self._known.clear()

    def convert(self, value: Any, name: str, field_name: str | None = None, raise_on_error: bool = True) -> Any:
        """One Python value; with raise_on_error False what can't be converted is None."""
        spec = self.get_spec(name)
        if spec.python is None:
            raise ValueError(f"converter {name!r} has no Python form")
        try:
            return spec.python(value)
        except (TypeError, ValueError, OverflowError) as error:
            if not raise_on_error:
                return None
            raise ValueError(f"cannot convert {value!r} by {name!r}" + (f" in field {field_name!r}" if field_name else "")) from error

    def column(self, name: str, column: Column) -> Column:
        spec = self.get_spec(name)
        if spec.column is not None:
            return spec.column(column)
        convert = spec.python

        def each(values: pd.Series) -> pd.Series:
            return values.map(lambda v: None if v is None else convert(v))

        return F.pandas_udf(each, UNIVERSAL_TO_SPARK[spec.target])(column)


def safe_float(value: Any) -> float | None:
    """NULL, NaN and infinities are None."""
    number = None if value is None else float(value)
    return number if number is not None and math.isfinite(number) else None


def safe_int(value: Any) -> int | None:
    """NULL, NaN and infinities are None; fractions are cut off."""
    if value is None or (isinstance(value, float) and not math.isfinite(value)):
        return None
    return int(value)


#: XML's predefined entities, the ampersand first.
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"))
YES, NO = ("yes", "true", "1"), ("no", "false", "0")


def xml_string(value: Any) -> str | None:
    if value is None:
        return None
    out = str(value)
    for char, entity in ENTITIES:
        out = out.replace(char, entity)
    return out


def rich_boolean(value: Any) -> bool | None:
    """yes/no, true/false and 1/0 in any case; ValueError for others."""
    if value is None or isinstance(value, bool):
        return value
    text = str(int(value)) if isinstance(value, float) and value.is_integer() else str(value).strip().lower()
    if text in YES:
        return True
    if text in NO:
        return False
    raise ValueError(f"{value!r} is neither yes nor no")


def restore_special_characters(value: Any) -> Any:
    """XML entities back to characters, also within lists, sets, dicts and tuples."""
    if isinstance(value, str):
        for char, entity in (*ENTITIES[1:3], ENTITIES[0], ENTITIES[4], ENTITIES[3]):
            value = value.replace(entity, char)
        return value
    if isinstance(value, dict):
        return {restore_special_characters(k): restore_special_characters(v) for k, v in value.items()}
    if isinstance(value, (list, set, tuple)):
        return type(value)(restore_special_characters(v) for v in value)
    return value


def restore_column(column: Column) -> Column:
    for char, entity in (*ENTITIES[1:3], ENTITIES[0], ENTITIES[4], ENTITIES[3]):
        column = F.replace(column, F.lit(entity), F.lit(char))
    return column


def _finite(column: Column) -> Column:
    c = column.try_cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def _escape(column: Column) -> Column:
    out = column.cast("string")
    for char, entity in ENTITIES:
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def _truth(column: Column) -> Column:
    c = F.lower(F.trim(column.cast("string")))
    return F.when(c.isin(*YES, "y", "t"), True).when(c.isin(*NO, "n", "f"), False)


def separate_conversions(spec: Any) -> tuple[dict[str, UniversalType], dict[str, str], dict[str, str]]:
    """A spec's fields by how they convert: by cast, by a converter with a Column form, by one in Python only."""
    casts = {f.name: f.type for f in spec.fields if f.type != UniversalType.ANY and not f.custom_cast}
    custom = {f.name: f.custom_cast for f in spec.fields if f.custom_cast}
    columns = {n: c for n, c in custom.items() if REGISTRY.is_vectorized(c)}
    return casts, columns, {n: c for n, c in custom.items() if n not in columns}


def apply_converters_to_dict(record: dict[str, Any], conversions: dict[str, str]) -> dict[str, Any]:
    """A record with named converters applied to its fields; fields that it lacks are left out."""
    return record | {n: REGISTRY.convert(record[n], c, n) for n, c in conversions.items() if n in record}


def apply_converters_to_dicts(records: list[dict[str, Any]], conversions: dict[str, str]) -> list[dict[str, Any]]:
    return [apply_converters_to_dict(r, conversions) for r in records]


REGISTRY = ConverterRegistry()
REGISTRY.register("safe_float", "number", safe_float, _finite, "floats; NaN and infinities are NULL")
REGISTRY.register("safe_int", "integer", safe_int, lambda c: _finite(c).try_cast("long"), "integers, fractions cut off")
REGISTRY.register("xml_string", "string", xml_string, _escape, "strings with XML entities")
REGISTRY.register("rich_boolean", "boolean", rich_boolean, _truth, "booleans from words")
