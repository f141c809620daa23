"""Python data into DataFrames: records of any common shape, columns, indexed rows, plain values, pandas, Arrow."""

from __future__ import annotations

import dataclasses
from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tessera.functions.dtypes import UNIVERSAL_TO_SPARK
from tessera.plans.typespec import TypeSpec

KINDS = ("pydantic", "dataclass", "namedtuple", "tuple", "series_dict", "indexed", "columns", "collection", "records", "unknown")


def _is_named(value: Any) -> bool:
    return isinstance(value, tuple) and hasattr(value, "_fields")


def _is_pydantic(value: Any) -> bool:
    return hasattr(value, "__pydantic_core_schema__")


def _is_dataclass(value: Any) -> bool:
    return dataclasses.is_dataclass(value)


def detect(data: Any) -> str:
    """One of KINDS for a value or a list of values."""
    for name, test in (("pydantic", _is_pydantic), ("dataclass", _is_dataclass), ("namedtuple", _is_named)):
        if test(data):
            return name
    if isinstance(data, tuple):
        return "namedtuple" if data and all(map(_is_named, data)) else "tuple"
    if isinstance(data, dict):
        first = next(iter(data.values()), None)
        if type(first).__name__ == "Series":
            return "series_dict"
        if isinstance(first, (list, tuple)) and not _is_named(first) and first and isinstance(first[0], (tuple, dict)):
            return "indexed"
        return "columns" if all(isinstance(v, (list, tuple)) for v in data.values()) else "unknown"
    if isinstance(data, (list, set, frozenset)):
        first = next(iter(data), None)
        if isinstance(first, dict):
            return "records" if all(isinstance(r, dict) for r in data) else "unknown"
        for name, test in (("pydantic", _is_pydantic), ("dataclass", _is_dataclass), ("namedtuple", _is_named)):
            if test(first):
                return name
        return "tuple" if isinstance(first, tuple) else "collection"
    return "unknown"


def _one_or_many(data: Any) -> list:
    return list(data) if isinstance(data, (list, set, frozenset)) or (isinstance(data, tuple) and not _is_named(data) and data and isinstance(data[0], tuple)) else [data]


def _from_indexed(data: dict, names: str | list[str] | None) -> list[dict[str, Any]]:
    out = []
    for key, rows in data.items():
        parts = key if isinstance(key, tuple) else (key,)
        wanted = [names] if isinstance(names, str) else names
        labels = wanted or (["index"] if not isinstance(key, tuple) else [f"index_{i}" for i in range(len(parts))])
        if len(labels) != len(parts):
            raise ValueError(f"{len(parts)} key parts but {len(labels)} index columns")
        if not isinstance(rows, (list, tuple)):
            raise ValueError(f"rows of key {key!r} are no list")
        for row in rows:
            if not isinstance(row, (dict, tuple)):
                raise ValueError(f"a row is a dict or a tuple, not {type(row).__name__}")
            body = dict(row) if isinstance(row, dict) else row._asdict() if _is_named(row) else {f"col_{i}": v for i, v in enumerate(row)}
            out.append(body | dict(zip(labels, parts, strict=True)))
    return out


def to_records(data: Any, index_column_names: str | list[str] | None = None, column_names: list[str] | None = None) -> tuple[list[str], list[tuple]]:
    """Column names (in order of first sight) and rows."""
    kind = detect(data)
    if kind == "pydantic":
        rows = [r.model_dump() for r in _one_or_many(data)]
    elif kind == "dataclass":
        rows = [{f.name: getattr(r, f.name) for f in dataclasses.fields(r)} for r in _one_or_many(data)]
    elif kind == "namedtuple":
        rows = [r._asdict() for r in _one_or_many(data)]
    elif kind == "tuple":
        some = _one_or_many(data)
        width = max((len(r) for r in some), default=0)
        names = column_names or [f"column_{i}" for i in range(width)]
        return names, [tuple(r) for r in some]
    elif kind in ("columns", "series_dict"):
        lengths = {len(v) for v in data.values()}
        if len(lengths) > 1:
            raise ValueError(f"columns have different lengths: {sorted(lengths)}")
        return list(data), list(zip(*[list(v) for v in data.values()], strict=True))
    elif kind == "indexed":
        rows = _from_indexed(data, index_column_names)
    elif kind == "records":
        rows = list(data)
    elif kind == "collection":
        return [(column_names or ["value"])[0]], [(v,) for v in data]
    else:
        raise TypeError(f"can't make a table of {type(data).__name__}")
    names = list(dict.fromkeys(k for r in rows for k in r))
    return names, [tuple(r.get(n) for n in names) for r in rows]


def _plain(value: Any) -> Any:
    value = value.item() if hasattr(value, "item") and type(value).__module__ == "numpy" else value
    return list(value) if isinstance(value, (set, frozenset)) else value


def _schema(names: Iterable[str], rows: list[tuple], spec: TypeSpec | None) -> T.StructType:
    """Types by the values, widened where ints and floats meet; by the spec, or string, for a column of NULLs."""
    import datetime
    import decimal

    by_type = ((bool, T.BooleanType()), (int, T.LongType()), (float, T.DoubleType()), (decimal.Decimal, T.DecimalType(38, 18)), (str, T.StringType()), (bytes, T.BinaryType()), (datetime.datetime, T.TimestampNTZType()), (datetime.date, T.DateType()), (datetime.timedelta, T.DayTimeIntervalType()))

    def of(values: list, name: str) -> T.DataType:
        some = [v for v in values if v is not None]
        if not some:
            declared = next((f for f in spec.fields if f.source_name == name), None) if spec else None
            return UNIVERSAL_TO_SPARK[declared.type] if declared else T.StringType()
        if all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in some) and any(isinstance(v, float) for v in some):
            return T.DoubleType()
        for kind, out in by_type:
            if all(isinstance(v, kind) and (kind is bool or not isinstance(v, bool)) for v in some):
                return out
        if all(isinstance(v, (list, tuple)) for v in some):
            return T.ArrayType(of([x for v in some for x in v], name))
        if all(isinstance(v, dict) for v in some):
            return T.MapType(T.StringType(), of([x for v in some for x in v.values()], name))
        return T.StringType()

    return T.StructType([T.StructField(str(n), of([r[i] if i < len(r) else None for r in rows], n)) for i, n in enumerate(names)])


def _fit(value: Any, dtype: T.DataType) -> Any:
    if value is None:
        return None
    if isinstance(dtype, T.DoubleType):
        return float(value)
    if isinstance(dtype, T.StringType):
        return value if isinstance(value, str) else str(value)
    if isinstance(dtype, T.ArrayType):
        return [_fit(_plain(v), dtype.elementType) for v in value]
    if isinstance(dtype, T.MapType):
        return {str(k): _fit(_plain(v), dtype.valueType) for k, v in value.items()}
    return value


def to_frame(data: Any, spark: SparkSession, type_spec: TypeSpec | None = None, index_column_names: str | list[str] | None = None, column_names: list[str] | None = None) -> DataFrame:
    """A DataFrame of Python data, pandas or Arrow; conformed to type_spec where given."""
    if isinstance(data, DataFrame):
        df = data
    elif type(data).__module__.split(".")[0] == "pandas" and hasattr(data, "columns"):
        df = spark.createDataFrame(data)
    elif type(data).__module__.split(".")[0] == "pyarrow":
        df = spark.createDataFrame(data)
    else:
        names, rows = to_records(data, index_column_names, column_names)
        plain = [tuple(map(_plain, r)) for r in rows]
        schema = _schema(names, plain, type_spec)
        df = spark.createDataFrame([tuple(_fit(r[i] if i < len(r) else None, f.dataType) for i, f in enumerate(schema)) for r in plain], schema)
    if type_spec is not None:
        from tessera.plans.conform import compile_conform

        return compile_conform(type_spec, df)
    return df
