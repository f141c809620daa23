"""Conversions by a spec in three tiers: casts and converters with a Column form run in Spark, in one select; those in
Python only run on records, before they become a DataFrame or after they leave it, and so need no Python workers."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.dtypes import UniversalType, bridge_type, spark_type
from tessera.plans.conform import compile_conform
from tessera.plans.converters import REGISTRY
from tessera.plans.typespec import FieldSpec, TypeSpec

FORMATS = ("dict", "namedtuple")


def _python_only(field: FieldSpec) -> bool:
    return field.custom_cast is not None and not REGISTRY.is_vectorized(field.custom_cast)


def _in_spark(spec: TypeSpec, **changes: Any) -> TypeSpec:
    """The spec with changes to the fields that only Python converts."""
    return dataclasses.replace(spec, fields=[dataclasses.replace(f, custom_cast=None, **changes) if _python_only(f) else f for f in spec.fields])


def apply_native_conversions_to_dataframe(df: DataFrame, casts: dict[str, UniversalType]) -> DataFrame:
    """The columns that casts names, cast; others, and names that df lacks, are left as they are."""
    kinds = {n: spark_type(bridge_type(t)) for n, t in casts.items() if t != UniversalType.ANY and n in df.columns}
    return df.withColumns({n: F.col("`" + n.replace("`", "``") + "`").cast(kind) for n, kind in kinds.items()}) if kinds else df


def apply_hybrid_conversion(records: list[dict[str, Any]], spec: TypeSpec | None, spark: SparkSession) -> DataFrame:
    """Records as a conformed DataFrame. Fields that only Python converts are filled and converted as records, then cast."""
    from tessera.sources.ingress import to_frame

    if spec is None:
        return to_frame(records, spark)
    custom = [f for f in spec.fields if _python_only(f)]

    def changed(record: dict[str, Any]) -> dict[str, Any]:
        out = dict(record)
        for f in custom:
            value = record.get(f.source_name)
            value = f.null_fill if value is None else value
            if f.source_name in record and value is not None:
                out[f.source_name] = REGISTRY.convert(value, f.custom_cast, f.name)
        return out

    return to_frame([changed(r) for r in records], spark, _in_spark(spec, null_fill=None))


def apply_native_conversions_for_egress(df: DataFrame, spec: TypeSpec | None) -> tuple[DataFrame, dict[str, str]]:
    """df conformed as far as Spark does it, and by field the converters that are left for Python."""
    if spec is None:
        return df, {}
    return compile_conform(_in_spark(spec, type=UniversalType.ANY), df), {f.name: f.custom_cast for f in spec.fields if _python_only(f)}


def apply_custom_converters_to_python_data(data: Iterable[Any], conversions: dict[str, str], data_format: str = "dict") -> list[Any]:
    """Dicts or named tuples with named converters applied to their fields; NULLs and fields that they lack are left."""
    if data_format not in FORMATS:
        raise ValueError(f"data_format is one of {', '.join(FORMATS)}")

    def changes(record: dict[str, Any]) -> dict[str, Any]:
        return {n: REGISTRY.convert(record[n], c, n) for n, c in conversions.items() if record.get(n) is not None}

    if data_format == "dict":
        return [r | changes(r) for r in data]
    return [r._replace(**changes(r._asdict())) for r in data]


def apply_hybrid_egress_conversion(df: Any, spec: TypeSpec | None = None, extract: Callable[[DataFrame], list[Any]] | None = None, data_format: str = "dict") -> list[Any]:
    """Rows on the driver by extract (by default dicts or named tuples, as data_format says), converted by the spec."""
    from tessera.operators.relation import relation
    from tessera.sources import egress

    if data_format not in FORMATS:
        raise ValueError(f"data_format is one of {', '.join(FORMATS)}")
    conformed, rest = apply_native_conversions_for_egress(relation(df).compile(), spec)
    extract = extract or (egress.to_list_of_dictionaries if data_format == "dict" else egress.to_list_of_named_tuples)
    return apply_custom_converters_to_python_data(extract(conformed), rest, data_format)
