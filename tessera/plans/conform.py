"""Conforming data to a spec: one select that fills, converts, casts and renames each field in order."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.dtypes import UniversalType, bridge_type, spark_type
from tessera.plans.converters import REGISTRY
from tessera.plans.typespec import FieldSpec, TypeSpec


def compile_conform(spec: TypeSpec, df: DataFrame) -> DataFrame:
    """The conformed DataFrame, lazily. NULLs are filled before the cast (a number into a string column as its
    text); columns that the spec doesn't name follow unchanged unless keep_only_mapped."""
    kinds, out = {f.name: f.dataType for f in df.schema.fields}, []
    for f in spec.fields:
        if f.source_name not in kinds:
            raise KeyError(f"no source column {f.source_name!r} for field {f.name!r}")
        column, kind = F.col(f"`{f.source_name}`"), kinds[f.source_name]
        if f.null_fill is not None:
            fill = str(f.null_fill) if isinstance(kind, T.StringType) and not isinstance(f.null_fill, str) else f.null_fill
            column = F.coalesce(column, F.lit(fill))
        if f.custom_cast:
            column = REGISTRY.column(f.custom_cast, column)
        if f.type != UniversalType.ANY:
            column = F.date_format(column.cast("timestamp_ntz"), "HH:mm:ss.SSSSSS") if f.type == UniversalType.TIME and not isinstance(kind, T.StringType) else column.cast(spark_type(bridge_type(f.type)))
        out.append(column.alias(f.name))
    mapped = {f.source_name for f in spec.fields}
    rest = [] if spec.keep_only_mapped else [F.col(f"`{c}`") for c in df.columns if c not in mapped]
    return df.select(*out, *rest)


class ConformBuilder:
    """From a spec, or a dict of target column -> {cast, rename_from, null_fill}; a cast that is no logical type names
    a registered converter."""

    def __init__(self, source: dict[str, dict[str, Any]] | TypeSpec):
        self._spec = source if isinstance(source, TypeSpec) else TypeSpec([self._field(n, c) for n, c in source.items()])

    @staticmethod
    def _field(name: str, config: dict[str, Any]) -> FieldSpec:
        cast = config.get("cast")
        logical = cast in set(UniversalType)
        return FieldSpec(name, UniversalType(cast) if logical else UniversalType.ANY, rename_from=config.get("rename_from"), null_fill=config.get("null_fill"), custom_cast=None if logical else cast)

    @property
    def spec(self) -> TypeSpec:
        return self._spec

    @classmethod
    def from_frictionless(cls, data: Any) -> ConformBuilder:
        return cls(TypeSpec.from_frictionless(data))

    def to_frictionless(self) -> dict[str, Any]:
        return self._spec.to_frictionless()

    def apply(self, df: Any) -> DataFrame:
        from tessera.operators.relation import relation

        return compile_conform(self._spec, relation(df).compile())
