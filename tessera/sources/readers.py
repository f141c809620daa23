"""Readers of resources: Spark's own sources by format, then conformed to the declared schema, all lazily."""

from __future__ import annotations

import functools
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.conform import compile_conform
from tessera.sources.ingress import to_frame

TABULAR = frozenset({"csv", "tsv", "json", "ndjson", "jsonl", "parquet", "orc"})
_MEDIA = (("tab-separated", "tsv"), ("csv", "csv"), ("ndjson", "ndjson"), ("jsonl", "jsonl"), ("json", "json"), ("parquet", "parquet"), ("orc", "orc"))


class UnsupportedResourceFormat(ValueError):
    """No reader for a resource's format."""


def detect_format(resource: Any) -> str:
    """By the declared format, else the media type, else the first path's extension."""
    if resource.format:
        return resource.format.lower()
    media = (resource.mediatype or "").lower()
    if found := next((f for part, f in _MEDIA if part in media), None):
        return found
    paths = resource.paths
    if paths and "." in paths[0].rsplit("/", 1)[-1]:
        return paths[0].rsplit(".", 1)[-1].lower()
    raise UnsupportedResourceFormat(f"can't tell the format of resource {resource.name!r}")


def read_resource(resource: Any, spark: SparkSession) -> DataFrame:
    """Inline data or files; all files of a resource have the same columns."""
    if resource.data is not None:
        df = to_frame(resource.data, spark)
    else:
        form = detect_format(resource)
        if form not in TABULAR:
            raise UnsupportedResourceFormat(f"no reader for format {form!r} (resource {resource.name!r})")
        df = _read(spark, form, resource)
    spec = resource.typespec
    if spec is None or not spec.fields:
        return df
    declared = [f.source_name for f in spec.fields]
    if resource.dialect is not None and (other := [n for n in declared if n not in df.columns]):
        if resource.dialect.case_sensitive_header:
            raise ValueError(f"resource {resource.name!r} has no columns {', '.join(other)} in this case")
        lowered = {n.lower(): n for n in other}
        df = df.withColumnsRenamed({c: lowered[c.lower()] for c in df.columns if c.lower() in lowered})
    missing = spec.missing_values or []
    if missing and resource.data is None:
        texts = {n for n, kind in df.dtypes if kind == "string" and n in declared}
        df = df.withColumns({n: F.when(~F.col(f"`{n}`").isin(*missing), F.col(f"`{n}`")) for n in texts})
    return compile_conform(spec, df)


def _read(spark: SparkSession, form: str, resource: Any) -> DataFrame:
    paths = resource.paths
    if form in ("csv", "tsv"):
        options = resource.dialect.spark_options() if resource.dialect else {"header": True}
        if form == "tsv":
            options = {"sep": "\t"} | options
        if resource.encoding:
            options["encoding"] = resource.encoding
        options["inferSchema"] = resource.schema is None
        frames = [spark.read.options(**options).csv(p) for p in paths]
        return functools.reduce(DataFrame.unionByName, frames) if len(frames) > 1 else frames[0]
    if form in ("json", "ndjson", "jsonl"):
        return spark.read.option("multiLine", form == "json").json(paths)
    return spark.read.format(form).load(paths)
