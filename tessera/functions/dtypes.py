"""Type vocabularies: physical names for casts, logical names for declared schemas, and Spark's types."""

from __future__ import annotations

import datetime
import decimal
import logging
import typing
from enum import StrEnum

from pyspark.sql import types as T

log = logging.getLogger(__name__)

PHYSICAL: dict[str, T.DataType] = {
    "bool": T.BooleanType(),
    "i8": T.ByteType(),
    "i16": T.ShortType(),
    "i32": T.IntegerType(),
    "i64": T.LongType(),
    "u8": T.ShortType(),
    "u16": T.IntegerType(),
    "u32": T.LongType(),
    "u64": T.DecimalType(20, 0),
    "fp32": T.FloatType(),
    "fp64": T.DoubleType(),
    "string": T.StringType(),
    "binary": T.BinaryType(),
    "date": T.DateType(),
    "time": T.StringType(),
    "timestamp": T.TimestampNTZType(),
}
#: Spark has no unsigned integers: they are held in the next wider type, within these bounds.
UNSIGNED_MAX = {f"u{bits}": 2**bits - 1 for bits in (8, 16, 32, 64)}


def _aliases() -> dict[str, str]:
    out = {name: name for name in PHYSICAL}
    for bits in (8, 16, 32, 64):
        out |= {f"int{bits}": f"i{bits}", f"Int{bits}": f"i{bits}", f"uint{bits}": f"u{bits}", f"UInt{bits}": f"u{bits}"}
    for bits in (32, 64):
        out |= {f"{name}{bits}": f"fp{bits}" for name in ("f", "float", "Float")}
    words = {"bool": "boolean Boolean", "string": "str Utf8 String", "binary": "Binary", "date": "Date", "time": "Time", "timestamp": "Datetime", "i64": "int", "fp64": "float"}
    return out | {alias: name for name, some in words.items() for alias in some.split()}


ALIASES = _aliases()
PYTHON_PHYSICAL = {int: "i64", float: "fp64", str: "string", bool: "bool"}


def resolve_dtype(dtype: object) -> str:
    """The physical name for a name, alias or Python type; ValueError for anything else."""
    if isinstance(dtype, type) and dtype in PYTHON_PHYSICAL:
        return PYTHON_PHYSICAL[dtype]
    name = dtype.value if isinstance(dtype, UniversalType) else str(dtype)
    if isinstance(dtype, UniversalType):
        return bridge_type(dtype)
    if name not in ALIASES:
        raise ValueError(f"unknown dtype {dtype!r}; known: {', '.join(sorted(ALIASES))}")
    return ALIASES[name]


def spark_type(dtype: object) -> T.DataType:
    """The Spark type for a cast; a Spark type stands for itself."""
    return dtype if isinstance(dtype, T.DataType) else PHYSICAL[resolve_dtype(dtype)]


class UniversalType(StrEnum):
    """Logical types of declared schemas (the Table Schema vocabulary)."""

    STRING = "string"
    INTEGER = "integer"
    NUMBER = "number"
    BOOLEAN = "boolean"
    DATE = "date"
    TIME = "time"
    DATETIME = "datetime"
    DURATION = "duration"
    YEAR = "year"
    YEARMONTH = "yearmonth"
    ARRAY = "array"
    OBJECT = "object"
    ANY = "any"


U = UniversalType
UNIVERSAL_TO_SPARK: dict[UniversalType, T.DataType] = {
    U.STRING: T.StringType(),
    U.INTEGER: T.LongType(),
    U.NUMBER: T.DoubleType(),
    U.BOOLEAN: T.BooleanType(),
    U.DATE: T.DateType(),
    U.TIME: T.StringType(),
    U.DATETIME: T.TimestampNTZType(),
    U.DURATION: T.DayTimeIntervalType(),
    U.YEAR: T.IntegerType(),
    U.YEARMONTH: T.StringType(),
    U.ARRAY: T.ArrayType(T.StringType()),
    U.OBJECT: T.MapType(T.StringType(), T.StringType()),
    U.ANY: T.StringType(),
}
#: Logical types that name a cast.
BRIDGED = {U.STRING: "string", U.INTEGER: "i64", U.NUMBER: "fp64", U.BOOLEAN: "bool", U.DATE: "date", U.TIME: "time", U.DATETIME: "timestamp"}
_SPARK_UNIVERSAL = (
    ((T.StringType, T.CharType, T.VarcharType, T.BinaryType), U.STRING),
    ((T.ByteType, T.ShortType, T.IntegerType, T.LongType), U.INTEGER),
    ((T.FloatType, T.DoubleType, T.DecimalType), U.NUMBER),
    ((T.BooleanType,), U.BOOLEAN),
    ((T.DateType,), U.DATE),
    ((T.TimestampType, T.TimestampNTZType), U.DATETIME),
    ((T.DayTimeIntervalType, T.YearMonthIntervalType), U.DURATION),
    ((T.ArrayType,), U.ARRAY),
    ((T.StructType, T.MapType), U.OBJECT),
)
_PYTHON_UNIVERSAL = {
    str: U.STRING, bytes: U.STRING, int: U.INTEGER, float: U.NUMBER, decimal.Decimal: U.NUMBER, bool: U.BOOLEAN,
    list: U.ARRAY, tuple: U.ARRAY, set: U.ARRAY, dict: U.OBJECT, datetime.date: U.DATE, datetime.time: U.TIME,
    datetime.datetime: U.DATETIME, datetime.timedelta: U.DURATION, object: U.ANY,
}
_NAMED = {
    "str": U.STRING, "utf8": U.STRING, "large_string": U.STRING, "object": U.STRING, "category": U.STRING,
    "int": U.INTEGER, "bigint": U.INTEGER, "smallint": U.INTEGER, "tinyint": U.INTEGER, "long": U.INTEGER,
    "float": U.NUMBER, "double": U.NUMBER, "decimal": U.NUMBER, "halffloat": U.NUMBER, "bool": U.BOOLEAN,
    "boolean": U.BOOLEAN, "date32": U.DATE, "date64": U.DATE, "timestamp": U.DATETIME, "timestamp_ntz": U.DATETIME,
    "datetime64": U.DATETIME, "time32": U.TIME, "time64": U.TIME, "timedelta64": U.DURATION, "interval": U.DURATION,
    "list": U.ARRAY, "struct": U.OBJECT, "map": U.OBJECT, "dict": U.OBJECT,
}


def bridge_type(universal: UniversalType) -> str:
    """The physical name that a logical type is cast to; ValueError where there is none."""
    if universal not in BRIDGED:
        raise ValueError(f"{universal.value!r} has no cast; castable: {', '.join(BRIDGED)}")
    return BRIDGED[universal]


def universal_of(dtype: T.DataType) -> UniversalType:
    """The logical type of a Spark type; ANY if none fits."""
    return next((u for kinds, u in _SPARK_UNIVERSAL if isinstance(dtype, kinds)), U.ANY)


def normalize_type(value: object, source_format: str = "universal") -> UniversalType:
    """The logical type for a name or type of Spark, Python, Arrow or pandas; ANY, with a warning, if unknown."""
    if isinstance(value, str) and value in UniversalType.__members__.values() and source_format == "universal":
        return UniversalType(value)
    if isinstance(value, T.DataType):
        return universal_of(value)
    origin = typing.get_origin(value) or value
    if origin in (typing.Union, type(int | None)):
        inner = [a for a in typing.get_args(value) if a is not type(None)]
        return normalize_type(inner[0], source_format) if len(inner) == 1 else U.ANY
    if isinstance(origin, type) and origin in _PYTHON_UNIVERSAL:
        return _PYTHON_UNIVERSAL[origin]
    name = str(getattr(value, "name", value)).lower().split("[")[0].split("(")[0].split("<")[0]
    if name in UniversalType.__members__.values():
        return UniversalType(name)
    if name in _NAMED:
        return _NAMED[name]
    if name in {a.lower() for a in ALIASES}:
        physical = next(p for a, p in ALIASES.items() if a.lower() == name)
        return universal_of(PHYSICAL[physical]) if physical != "time" else U.TIME
    log.warning("unknown type %r taken as any", value)
    return U.ANY


SAFE_CASTS = frozenset({(U.INTEGER, U.NUMBER), (U.DATE, U.DATETIME), (U.DATETIME, U.DATE), (U.BOOLEAN, U.INTEGER), *((u, U.STRING) for u in (U.INTEGER, U.NUMBER, U.BOOLEAN, U.DATE, U.TIME, U.DATETIME, U.DURATION))})
UNSAFE_CASTS = frozenset({(U.NUMBER, U.INTEGER), *((U.STRING, u) for u in (U.INTEGER, U.NUMBER, U.BOOLEAN, U.DATE, U.TIME, U.DATETIME))})


def is_safe_cast(from_type: object, to_type: object) -> bool:
    """Whether a cast between logical types cannot lose data; pairs that aren't known count as unsafe."""
    a, b = normalize_type(from_type), normalize_type(to_type)
    return a == b or U.ANY in (a, b) or (a, b) in SAFE_CASTS
