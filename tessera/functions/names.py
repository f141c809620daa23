"""Output names of expressions, derived from the column that they come from."""

from __future__ import annotations

from typing import Any


class NameMethods:
    """Reached as expr.name.suffix("_x") or expr.suffix("_x")."""

    def __init__(self, expr: Any):
        self._expr = expr

    def _named(self, name: str):
        from tessera.functions.expr import Expr

        e = self._expr
        return Expr(e.column, kind=e.kind, unknown=e.unknown, leaf=e.leaf, window=e.window, named=name)

    def _root(self) -> str:
        if self._expr.leaf is None:
            raise ValueError("this expression comes from no column whose name could be changed; use alias")
        return self._expr.leaf

    def alias(self, name: str):
        return self._named(name)

    def prefix(self, prefix: str):
        return self._named(prefix + self._root())

    def suffix(self, suffix: str):
        return self._named(self._root() + suffix)

    def name_to_upper(self):
        return self._named(self._root().upper())

    def name_to_lower(self):
        return self._named(self._root().lower())

    to_upper, to_lower = name_to_upper, name_to_lower
