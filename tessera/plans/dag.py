"""Named relations with dependencies: each is built after those it refers to, and stays a lazy DataFrame."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame

from tessera.operators.relation import Relation
from tessera.plans.typespec import extract_from_dataframe


class MissingResourceSchema(ValueError):
    """A relation can't be described as a resource."""


class RelationDAG:
    """Relations by name, assets (resources that aren't tables), and two kinds of edges: dependency_edges from a
    relation to those that refer to it, constraint_edges from foreign keys."""

    def __init__(self) -> None:
        self.relations: dict[str, Relation] = {}
        self.assets: dict[str, Any] = {}
        self.dependency_edges: set[tuple[str, str]] = set()
        self.constraint_edges: set[tuple[str, str]] = set()

    def add(self, name: str, relation: Relation) -> None:
        if name in self.relations:
            raise ValueError(f"relation {name!r} is in the DAG already")
        self.relations[name] = relation
        self.dependency_edges |= {(upstream, name) for upstream in relation.refs}

    def ref(self, name: str) -> Relation:
        """A placeholder for a named relation, to build others on."""
        return Relation(lambda resolve: resolve(name), frozenset({name}))

    def ancestors(self, target: str) -> set[str]:
        """The target and all that it depends on."""
        known, new = set(), {target}
        while new:
            known |= new
            new = {u for u, d in self.dependency_edges if d in new} - known
        return known

    def topological_order(self, target: str | None = None) -> list[str]:
        """Names so that each comes after those it depends on, by name where free; ValueError for a cycle."""
        left = set(self.relations) if target is None else self.ancestors(target)
        edges = {(u, d) for u, d in self.dependency_edges if u in left and d in left}
        out: list[str] = []
        while left:
            ready = sorted(n for n in left if not any(u in left for u, d in edges if d == n))
            if not ready:
                raise ValueError(f"cycle among {', '.join(sorted(left))}")
            out.append(ready[0])
            left.remove(ready[0])
        return out

    def collect(self, name: str, persist_shared: bool = False) -> DataFrame:
        """The DataFrame of a relation, each ancestor built once. persist_shared keeps ancestors that several
        relations use, for plans where reading them again costs more than holding them."""
        if name not in self.relations:
            raise KeyError(f"no relation {name!r} in the DAG")
        order, built = self.topological_order(name), {}
        for n in order:
            if n not in self.relations:
                raise KeyError(f"no relation {n!r} in the DAG")
            frame = self.relations[n].resolve(built.__getitem__)
            users = sum(u == n and d in order for u, d in self.dependency_edges)
            built[n] = frame.persist() if persist_shared and users > 1 else frame
        return built[name]

    def to_package(self) -> Any:
        """A data package of the relations that come from resources or whose schema is known, and the assets."""
        from tessera.sources.package import DataPackage, DataResource

        resources, missing = [], []
        for name, rel in self.relations.items():
            if rel.resource is not None:
                resources.append(rel.resource.renamed(name))
                continue
            schema = rel.output_schema
            if schema is None and not rel.refs:
                schema = extract_from_dataframe(rel.compile())
            if schema is None:
                missing.append(name)
            else:
                resources.append(DataResource(name, path=f"{name}.csv", type="table", format="csv", schema=schema))
        if missing:
            raise MissingResourceSchema(f"no schema for {', '.join(missing)}")
        return DataPackage(resources + [a.resource.renamed(n) for n, a in self.assets.items()])
