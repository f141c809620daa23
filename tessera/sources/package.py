"""Data packages: descriptors of resources (files or inline data) with dialects and schemas, as relations."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession

from tessera.operators.relation import Relation, relation
from tessera.plans.typespec import TypeSpec, read_descriptor, typespec_to_frictionless
from tessera.sources.readers import TABULAR, detect_format, read_resource

_DIALECT = {
    "delimiter": "delimiter", "line_terminator": "lineTerminator", "quote_char": "quoteChar",
    "double_quote": "doubleQuote", "escape_char": "escapeChar", "null_sequence": "nullSequence",
    "skip_initial_space": "skipInitialSpace", "header": "header", "header_rows": "headerRows",
    "header_join": "headerJoin", "comment_char": "commentChar", "case_sensitive_header": "caseSensitiveHeader",
    "csvddf_version": "csvddfVersion",
}


@dataclass
class TableDialect:
    """How a CSV file is written."""

    delimiter: str | None = None
    line_terminator: str | None = None
    quote_char: str | None = None
    double_quote: bool | None = None
    escape_char: str | None = None
    null_sequence: str | None = None
    skip_initial_space: bool | None = None
    header: bool | None = None
    header_rows: list[int] | None = None
    header_join: str | None = None
    comment_char: str | None = None
    case_sensitive_header: bool | None = None
    csvddf_version: str | None = None

    @classmethod
    def from_descriptor(cls, raw: dict[str, Any]) -> TableDialect:
        """Unknown keys are dropped."""
        return cls(**{a: raw[key] for a, key in _DIALECT.items() if key in raw})

    def to_descriptor(self) -> dict[str, Any]:
        return {key: getattr(self, a) for a, key in _DIALECT.items() if getattr(self, a) is not None}

    def spark_options(self) -> dict[str, Any]:
        """Options of Spark's CSV reader. Quotes within quotes are doubled or follow the escape character; with neither
        they stand for themselves. case_sensitive_header is checked against the schema when the file has been read."""
        if self.header_rows is not None and list(self.header_rows) not in ([], [1]):
            raise ValueError(f"header rows {self.header_rows}: only the first row of a file can be its header, or none")
        escape = self.escape_char
        if escape is None and self.double_quote is not None:
            escape = (self.quote_char or '"') if self.double_quote else ""
        pairs = (("sep", self.delimiter), ("lineSep", self.line_terminator), ("quote", self.quote_char), ("escape", escape), ("nullValue", self.null_sequence), ("ignoreLeadingWhiteSpace", self.skip_initial_space), ("comment", self.comment_char))
        header = self.header if self.header_rows is None else bool(self.header_rows)
        return {k: v for k, v in pairs if v is not None} | {"header": True if header is None else header}


_RESOURCE = ("path", "data", "type", "title", "description", "format", "mediatype", "encoding", "bytes", "hash", "sources", "licenses")


@dataclass
class DataResource:
    """A table or file: exactly one of path (or paths) and inline data."""

    name: str
    path: str | list[str] | None = None
    data: Any = None
    type: str | None = None
    dialect: TableDialect | None = None
    schema: dict[str, Any] | TypeSpec | None = None
    title: str | None = None
    description: str | None = None
    format: str | None = None
    mediatype: str | None = None
    encoding: str | None = None
    bytes: int | None = None
    hash: str | None = None
    sources: list[dict] | None = None
    licenses: list[dict] | None = None
    extras: dict[str, Any] = field(default_factory=dict)
    base: str | None = None

    def __post_init__(self) -> None:
        if (self.path is None) == (self.data is None):
            raise ValueError(f"resource {self.name!r} needs either path or data")

    @classmethod
    def from_descriptor(cls, raw: dict[str, Any], base: str | None = None) -> DataResource:
        known = {k: raw[k] for k in ("name", "schema", *_RESOURCE) if k in raw}
        dialect = raw.get("dialect")
        extras = {k: v for k, v in raw.items() if k not in known and k != "dialect"}
        return cls(**known, dialect=TableDialect.from_descriptor(dialect) if isinstance(dialect, dict) else None, extras=extras, base=base)

    def to_descriptor(self) -> dict[str, Any]:
        out = {"name": self.name} | {k: getattr(self, k) for k in _RESOURCE if getattr(self, k) is not None}
        if self.dialect and (written := self.dialect.to_descriptor()):
            out["dialect"] = written
        if self.schema is not None:
            out["schema"] = self.schema if isinstance(self.schema, dict) else typespec_to_frictionless(self.schema)
        return out | self.extras

    def renamed(self, name: str) -> DataResource:
        return self if name == self.name else dataclasses.replace(self, name=name)

    @property
    def typespec(self) -> TypeSpec | None:
        return TypeSpec.from_frictionless(self.schema) if isinstance(self.schema, dict) else self.schema

    @property
    def paths(self) -> list[str]:
        """Paths, relative ones from the descriptor's folder."""
        some = [self.path] if isinstance(self.path, str) else list(self.path or [])
        return [p if "://" in p or p.startswith("/") or not self.base else f"{self.base}/{p}" for p in some]


class ResourceRef:
    """A resource as a relation, if it's a table, or as bytes."""

    def __init__(self, resource: DataResource, spark: SparkSession | None = None):
        self.resource, self._spark = resource, spark

    @property
    def is_tabular(self) -> bool:
        r = self.resource
        if r.type == "table" or (r.format or "").lower() in TABULAR:
            return True
        try:
            return r.data is not None or (r.type is None and r.format is None and detect_format(r) in TABULAR)
        except ValueError:
            return False

    def read_bytes(self) -> bytes:
        """The content of a file, whatever store it's in."""
        if self.resource.data is not None:
            raise ValueError(f"resource {self.resource.name!r} has inline data")
        path = self.resource.paths[0]
        if "://" not in path:
            return Path(path).read_bytes()
        spark = self._spark or SparkSession.getActiveSession()
        return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])

    def relation(self) -> Relation:
        if not self.is_tabular:
            raise ValueError(f"resource {self.resource.name!r} is no table")
        return Relation(lambda _: read_resource(self.resource, self._spark or SparkSession.getActiveSession()), resource=self.resource, output_schema=self.resource.typespec)


_PACKAGE = ("name", "id", "licenses", "profile", "title", "description", "homepage", "version", "created", "keywords", "contributors", "sources", "image")


@dataclass
class DataPackage:
    """Resources with unique names, whose foreign keys refer to each other."""

    resources: list[DataResource]
    name: str | None = None
    id: str | None = None
    licenses: list[dict] | None = None
    schema_url: str | None = None
    profile: str | None = None
    title: str | None = None
    description: str | None = None
    homepage: str | None = None
    version: str | None = None
    created: str | None = None
    keywords: list[str] | None = None
    contributors: list[dict] | None = None
    sources: list[dict] | None = None
    image: str | None = None
    extras: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.resources:
            raise ValueError("a package needs a resource")
        names = [r.name for r in self.resources]
        if twice := {n for n in names if names.count(n) > 1}:
            raise ValueError(f"resource names used twice: {', '.join(sorted(twice))}")
        for r in self.resources:
            for target in self._foreign(r):
                if target not in names:
                    raise ValueError(f"resource {r.name!r} refers to unknown resource {target!r}")

    @staticmethod
    def _foreign(r: DataResource) -> list[str]:
        spec = r.typespec
        return [k.reference.resource or r.name for k in (spec.foreign_keys if spec else None) or []]

    @classmethod
    def from_descriptor(cls, raw: Any) -> DataPackage:
        """From a dict, JSON text, or the path of a descriptor, whose folder relative paths start from."""
        is_path = isinstance(raw, Path) or (isinstance(raw, str) and not raw.lstrip().startswith("{"))
        base = str(Path(raw).resolve().parent) if is_path else None
        raw = read_descriptor(raw)
        known = {k: raw[k] for k in _PACKAGE if k in raw}
        extras = {k: v for k, v in raw.items() if k not in known and k not in ("resources", "$schema")}
        return cls([DataResource.from_descriptor(r, base) for r in raw["resources"]], schema_url=raw.get("$schema"), extras=extras, **known)

    def to_descriptor(self) -> dict[str, Any]:
        out = {"$schema": self.schema_url} if self.schema_url is not None else {}
        out |= {k: getattr(self, k) for k in _PACKAGE if getattr(self, k) is not None}
        return out | {"resources": [r.to_descriptor() for r in self.resources]} | self.extras

    def write(self, path: str | Path) -> None:
        """The descriptor as JSON."""
        Path(path).write_text(json.dumps(self.to_descriptor(), indent=2))

    def to_relation_dag(self, overrides: dict[str, Any] | None = None, spark: SparkSession | None = None) -> Any:
        """Tables as relations (overrides give others in their place), the rest as assets, foreign keys as
        constraint edges."""
        from tessera.plans.dag import RelationDAG

        dag, overrides = RelationDAG(), overrides or {}
        for r in self.resources:
            ref = ResourceRef(r, spark)
            if not ref.is_tabular:
                dag.assets[r.name] = ref
            else:
                dag.add(r.name, relation(overrides[r.name], spark) if r.name in overrides else ref.relation())
        dag.constraint_edges |= {(t, r.name) for r in self.resources for t in self._foreign(r) if t in dag.relations and r.name in dag.relations}
        return dag
