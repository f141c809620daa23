"""DataFrames into Python structures. All of these bring the rows to the driver: for results, not for corpora."""

from __future__ import annotations

import datetime
import typing
from collections import namedtuple
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.operators.relation import relation
from tessera.plans.conform import compile_conform
from tessera.plans.typespec import TypeSpec
from tessera.sources import mappers


def _frame(data: Any) -> DataFrame:
    return relation(data).compile()


def to_dictionary_of_lists(data: Any) -> dict[str, list]:
    return relation(data).to_dict()


def to_dictionary_of_series(data: Any) -> dict[str, Any]:
    pdf = _frame(data).toPandas()
    return {c: pdf[c] for c in pdf.columns}


def to_list_of_dictionaries(data: Any) -> list[dict[str, Any]]:
    return relation(data).to_dicts()


def to_list_of_tuples(data: Any) -> list[tuple]:
    return relation(data).to_tuples()


def _row_type(df: DataFrame) -> type:
    return namedtuple("Row", df.columns, rename=True)


def to_list_of_named_tuples(data: Any) -> list[tuple]:
    df = _frame(data)
    make = _row_type(df)
    return [make(*r) for r in df.collect()]


_PYTHON = (
    (T.BooleanType, bool),
    (T.IntegralType, int),
    (T.FractionalType, float),
    (T.StringType, str),
    (T.BinaryType, bytes),
    (T.DateType, datetime.date),
    ((T.TimestampType, T.TimestampNTZType), datetime.datetime),
    (T.DayTimeIntervalType, datetime.timedelta),
    (T.ArrayType, list),
    ((T.MapType, T.StructType), dict),
)


def _typed(df: DataFrame, preserve_dates: bool) -> tuple[type, Callable[[Any], Any]]:
    """A NamedTuple with field types, and how values become them: dates as ISO text unless preserved."""
    dates = (datetime.date, datetime.datetime)

    def kind(dtype: T.DataType) -> type:
        found = next((p for kinds, p in _PYTHON if isinstance(dtype, kinds)), object)
        return str if found in dates and not preserve_dates else found

    make = typing.NamedTuple("Row", [(f.name, kind(f.dataType)) for f in df.schema.fields])
    return make, lambda v: v.isoformat() if isinstance(v, dates) and not preserve_dates else v


def to_list_of_typed_named_tuples(data: Any, preserve_dates: bool = False) -> list[tuple]:
    df = _frame(data)
    make, fit = _typed(df, preserve_dates)
    return [make(*map(fit, r)) for r in df.collect()]


def _index(data: Any, index_fields: str | list[str], row: Callable[[Any], Any], df: DataFrame | None = None) -> dict[Any, list]:
    """Rows by the value of one field, or by the tuple of several."""
    df = _frame(data) if df is None else df
    fields = [index_fields] if isinstance(index_fields, str) else list(index_fields)
    out: dict[Any, list] = {}
    for r in df.collect():
        key = r[fields[0]] if isinstance(index_fields, str) else tuple(r[f] for f in fields)
        out.setdefault(key, []).append(row(r))
    return out


def to_index_of_dictionaries(data: Any, index_fields: str | list[str]) -> dict[Any, list[dict]]:
    return _index(data, index_fields, lambda r: r.asDict())


def to_index_of_tuples(data: Any, index_fields: str | list[str]) -> dict[Any, list[tuple]]:
    return _index(data, index_fields, tuple)


def to_index_of_named_tuples(data: Any, index_fields: str | list[str]) -> dict[Any, list[tuple]]:
    df = _frame(data)
    make = _row_type(df)
    return _index(data, index_fields, lambda r: make(*r), df)


def to_index_of_typed_named_tuples(data: Any, index_fields: str | list[str], preserve_dates: bool = False) -> dict[Any, list[tuple]]:
    df = _frame(data)
    make, fit = _typed(df, preserve_dates)
    return _index(data, index_fields, lambda r: make(*map(fit, r)), df)


def to_list_of_dataclasses(data: Any, cls: type, spec: TypeSpec | None = None, apply_defaults: bool = False) -> list[Any]:
    df = _frame(data)
    df = compile_conform(spec, df) if spec else df
    return mappers.map_list_of_dicts_to_dataclasses([r.asDict() for r in df.collect()], cls, apply_defaults=apply_defaults)


def to_list_of_pydantic(data: Any, cls: type, spec: TypeSpec | None = None) -> list[Any]:
    df = _frame(data)
    df = compile_conform(spec, df) if spec else df
    return mappers.map_list_of_dicts_to_pydantic([r.asDict() for r in df.collect()], cls)


def to_pandas(data: Any) -> Any:
    return _frame(data).toPandas()


def to_pyarrow(data: Any) -> Any:
    return _frame(data).toArrow()
