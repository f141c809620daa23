"""A PySpark-native analytics layer: column expressions with three-valued logic, relational plans, declared
schemas and data packages, all compiled to Spark DataFrames."""

from __future__ import annotations

from typing import Any

from tessera.functions.build import always_false, always_true, always_unknown, between_last, coalesce, col, corr, count_records, greatest, least, lit, median, native, now, older_than, quantile, t_col, today, when, within_last
from tessera.functions.dtypes import UniversalType, is_safe_cast, normalize_type, resolve_dtype
from tessera.functions.expr import Expr
from tessera.operators.relation import GroupedRelation, Relation, RelationDAGRequired, concat, relation
from tessera.plans.conform import ConformBuilder, compile_conform
from tessera.plans.dag import MissingResourceSchema, RelationDAG
from tessera.plans.typespec import FieldConstraints, FieldSpec, TypeSpec, compare_specs, validate_match
from tessera.sources.package import DataPackage, DataResource, ResourceRef, TableDialect
from tessera.sources.readers import UnsupportedResourceFormat

__version__ = "0.1.0"


def typespec(columns: dict[str, Any], **metadata: Any) -> TypeSpec:
    """A schema from names and types."""
    return TypeSpec.from_simple_dict(columns, **metadata)


def conform(source: dict | TypeSpec) -> ConformBuilder:
    """What turns data into a schema's columns."""
    return ConformBuilder(source)


__all__ = [
    "ConformBuilder", "DataPackage", "DataResource", "Expr", "FieldConstraints", "FieldSpec", "GroupedRelation", "MissingResourceSchema", "Relation", "RelationDAG", "RelationDAGRequired", "ResourceRef", "TableDialect", "TypeSpec", "UniversalType", "UnsupportedResourceFormat",
    "always_false", "always_true", "always_unknown", "between_last", "coalesce", "col", "compare_specs", "compile_conform", "concat", "conform", "corr", "count_records", "greatest", "is_safe_cast", "least", "lit", "median", "native", "normalize_type", "now", "older_than", "quantile", "relation", "resolve_dtype", "t_col", "today", "typespec", "validate_match", "when", "within_last",
]
