"""Relations: fluent, immutable, lazy query plans over Spark DataFrames.

A relation is a function from named relations (the refs of a DAG) to a DataFrame; each method composes one more
step. The DataFrame is itself a lazy plan, so nothing runs before a terminal method, and Catalyst sees the whole.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.expr import Expr, sort_column
from tessera.sources.storage import shared_folder

JOINS = {"inner": "inner", "left": "left", "right": "right", "outer": "full", "full": "full", "semi": "left_semi", "anti": "left_anti", "cross": "cross"}
#: Columns that a pivot makes at most by itself.
MOST_PIVOTED = 10_000
AGGREGATES = ("first", "last", "sum", "min", "max", "mean", "avg", "median", "count", "len")
Resolver = Callable[[str], DataFrame]


def _place(df: DataFrame, name: str) -> int:
    """Where a column stands, by its exact name or else, as Spark finds columns, in any case."""
    if name in df.columns:
        return df.columns.index(name)
    found = [i for i, c in enumerate(df.columns) if c.lower() == str(name).lower()]
    return found[0] if len(found) == 1 else df.columns.index(df.select(name).columns[0])


class RelationDAGRequired(RuntimeError):
    """A relation that refers to others by name was run outside the DAG that has them."""


def _outside(name: str) -> DataFrame:
    raise RelationDAGRequired(f"relation refers to {name!r}: run it with RelationDAG.collect")


def compiled(value: Any) -> Any:
    """What a DataFrame method takes: expressions as Columns, three-valued ones as predicates."""
    return value.compile() if isinstance(value, Expr) else value


def _names(values: Iterable[Any]) -> list[Any]:
    return [v for some in values for v in (some if isinstance(some, (list, tuple)) else [some])]


class Relation:
    """Make one with relation(); methods return new relations, terminals run the plan."""

    def __init__(
        self,
        plan: Callable[[Resolver], DataFrame],
        refs: frozenset[str] = frozenset(),
        order: tuple[Column, ...] = (),
        resource: Any = None,
        output_schema: Any = None,
    ):
        self._plan, self.refs, self._order, self.resource, self.output_schema = plan, refs, order, resource, output_schema
        self._frame: DataFrame | None = None

    def _then(self, step: Callable[[DataFrame], DataFrame], *others: Relation, order: tuple[Column, ...] = ()) -> Relation:
        if not others:
            out = Relation(lambda resolve: step(self.resolve(resolve)), self.refs, order)
            out._backwards = self._backwards if order else ()
            return out
        refs = self.refs.union(*[o.refs for o in others])
        return Relation(lambda resolve: step(self.resolve(resolve), *[o.resolve(resolve) for o in others]), refs, order)

    def resolve(self, resolver: Resolver) -> DataFrame:
        """The DataFrame, with named relations looked up by the resolver."""
        if self.refs:
            return self._plan(resolver)
        if self._frame is None:
            self._frame = self._plan(resolver)
        return self._frame

    # ---- columns and rows

    def select(self, *columns: Any) -> Relation:
        return self._then(lambda df: df.select(*[compiled(c) for c in _names(columns)]))

    def with_columns(self, *exprs: Any, **named: Any) -> Relation:
        """Add or replace columns; all expressions see the input's columns."""

        def step(df: DataFrame) -> DataFrame:
            new = {}
            for e in _names(exprs):
                c = compiled(e)
                new[(e.named or e.leaf) if isinstance(e, Expr) and (e.named or e.leaf) else df.select(c).columns[0]] = c
            return df.withColumns(new | {k: compiled(v) if isinstance(v, (Expr, Column)) else F.lit(v) for k, v in named.items()})

        return self._then(step, order=self._order)

    def drop(self, *columns: str) -> Relation:
        """KeyError for a column that isn't there."""

        def step(df: DataFrame) -> DataFrame:
            if missing := [c for c in _names(columns) if c not in df.columns]:
                raise KeyError(f"no column {', '.join(missing)}")
            return df.drop(*_names(columns))

        return self._then(step)

    def rename(self, mapping: dict[str, str]) -> Relation:
        return self._then(lambda df: df.withColumnsRenamed(mapping))

    def filter(self, *predicates: Any) -> Relation:
        """Rows for which every predicate is true; three-valued predicates keep what is known to be true."""
        return self._then(lambda df: functools.reduce(lambda d, p: d.filter(compiled(p)), predicates, df), order=self._order)

    # ---- order and position

    def sort(self, *by: Any, descending: bool | list[bool] = False) -> Relation:
        """NULLs last in either direction."""
        keys = _names(by)
        down = [descending] * len(keys) if isinstance(descending, bool) else list(descending)
        if len(down) != len(keys):
            raise ValueError(f"{len(keys)} sort columns but {len(down)} directions")
        order = tuple(sort_column(k, d) for k, d in zip(keys, down, strict=True))
        columns = [F.col(k) if isinstance(k, str) else compiled(k) for k in keys]
        backwards = tuple(c.asc_nulls_first() if d else c.desc_nulls_first() for c, d in zip(columns, down, strict=True))
        out = self._then(lambda df: df.orderBy(*order), order=order)
        out._backwards, out._unsorted = backwards, self
        return out

    #: The reverse of the order, and what a sort sorted: steps that go by the order themselves start there.
    _backwards: tuple[Column, ...] = ()
    _unsorted: Relation | None = None

    def head(self, n: int = 5) -> Relation:
        return self._then(lambda df: df.limit(n), order=self._order)

    def slice(self, offset: int, length: int | None = None) -> Relation:
        return self._then(lambda df: df.offset(offset) if length is None else df.offset(offset).limit(length), order=self._order)

    def tail(self, n: int = 5) -> Relation:
        """The last rows: right after sort by taking the first of the reverse order, else by row position."""
        order, backwards = self._order, self._backwards
        if order and backwards:
            return self._then(lambda df: df.orderBy(*backwards).limit(n).orderBy(*order), order=order)

        def step(df: DataFrame) -> DataFrame:
            last = df.withColumn("__row", F.monotonically_increasing_id()).orderBy(F.col("__row").desc()).limit(n)
            return last.orderBy("__row").drop("__row")

        return self._then(step)

    def top_k(self, k: int, *, by: Any, descending: bool = True) -> Relation:
        return self.sort(*_names([by]), descending=descending).head(k)

    def with_row_index(self, name: str = "index") -> Relation:
        """0-based positions in the current order. Rows are numbered within tasks, then shifted by the counts of the
        tasks before; the ordered rows are checkpointed meanwhile, so that both passes see the same tasks whatever is lost."""

        def step(df: DataFrame) -> DataFrame:
            context, folder = df.sparkSession.sparkContext, shared_folder(df.sparkSession)
            if not context.getCheckpointDir():
                context.setCheckpointDir(folder)
            held = df.withColumn("__row", F.monotonically_increasing_id()).checkpoint()
            part = F.shiftright("__row", 33)
            counts = sorted((r["p"], r["n"]) for r in held.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
            starts, total = [], 0
            for p, n in counts:
                starts.append((p, total))
                total += n
            offsets = df.sparkSession.createDataFrame(starts or [(0, 0)], "__part long, __start long")
            inside = F.col("__row").bitwiseAND((1 << 33) - 1)
            joined = held.join(F.broadcast(offsets), part == F.col("__part"))  # one row for each task
            return joined.select((F.col("__start") + inside).alias(name), *df.columns)

        return self._then(step)

    # ---- joins

    def join(
        self,
        other: Any,
        *,
        on: Any = None,
        left_on: Any = None,
        right_on: Any = None,
        how: str = "inner",
        suffix: str = "_right",
        execute_on: str | None = None,
    ) -> Relation:
        """Equi-join. Key columns appear once (an outer join keeps the right's with the suffix); other columns of the
        right that clash get the suffix; NULL keys don't match. execute_on="broadcast" sends the right side, whose
        size the caller answers for, to every task; left alone, Spark decides by size."""
        if how not in JOINS:
            raise ValueError(f"unknown join {how!r}; known: {', '.join(JOINS)}")
        left_keys, right_keys = _names([left_on or on or []]), _names([right_on or on or []])
        if how != "cross" and (not left_keys or len(left_keys) != len(right_keys)):
            raise ValueError("a join needs on, or left_on and right_on of the same length")

        def step(left: DataFrame, right: DataFrame) -> DataFrame:
            # Both sides go by place, so that no name of a column means anything to the join.
            own, others = [f"l{i}" for i in range(len(left.columns))], [f"r{i}" for i in range(len(right.columns))]
            a, b = left.toDF(*own), right.toDF(*others)
            if execute_on == "broadcast":
                b = F.broadcast(b)
            left_at, right_at = [_place(left, k) for k in left_keys], [_place(right, k) for k in right_keys]
            rest = [i for i in range(len(others)) if i not in right_at]
            names = [c + suffix if c in left.columns else c for c in right.columns]
            if how == "cross":
                return a.crossJoin(b).toDF(*left.columns, *names)
            match = functools.reduce(lambda x, y: x & y, [F.col(own[i]) == F.col(others[j]) for i, j in zip(left_at, right_at, strict=True)])
            joined = a.join(b, match, JOINS[how])
            if how in ("semi", "anti"):
                return joined.toDF(*left.columns)
            if JOINS[how] == "full":
                return joined.select(*own, *[others[i] for i in [*right_at, *rest]]).toDF(*left.columns, *[names[i] for i in [*right_at, *rest]])
            if how == "right":
                own = [others[right_at[left_at.index(i)]] if i in left_at else c for i, c in enumerate(own)]
            columns = [F.col(c).alias(f"o{i}") for i, c in enumerate([*own, *[others[i] for i in rest]])]
            return joined.select(*columns).toDF(*left.columns, *[names[i] for i in rest])

        return self._then(step, relation(other, spark=None if isinstance(other, (Relation, DataFrame)) else _session()))

    def join_asof(self, other: Any, *, on: str, by: Any = None, strategy: str = "backward", tolerance: float | None = None, suffix: str = "_right", ranges: int | None = None) -> Relation:
        """Each row with the nearest row of other by `on`, within equal `by`; see asof_join. ranges: how many the key is
        cut into, by default as many as a shuffle has partitions, 64 at least."""
        from tessera.operators.asof import asof_join

        keys = _names([by]) if by is not None else []
        return self._then(lambda left, right: asof_join(left, right, on, keys, strategy, tolerance, suffix, ranges), relation(other))

    # ---- groups and sets

    def group_by(self, *keys: Any) -> GroupedRelation:
        return GroupedRelation(self, _names(keys))

    def agg(self, *measures: Any) -> Relation:
        """One row over all rows."""
        return self._then(lambda df: df.agg(*[compiled(m) for m in _names(measures)]))

    def unique(self, *columns: Any, subset: Any = None, keep: str = "any") -> Relation:
        """One row for each combination of the columns (all of them by default), with all columns. keep: any; first or
        last in the current order, which must come from sort and goes by the keys' present values; none drops all rows that have an equal."""
        keys = _names(columns) or (_names([subset]) if subset is not None else None)
        order, backwards = self._order, self._backwards
        if keep not in ("any", "first", "last", "none"):
            raise ValueError("keep is any, first, last or none")
        if keep in ("first", "last") and not order:
            raise ValueError(f"keep={keep!r} needs a preceding sort")

        def step(df: DataFrame) -> DataFrame:
            on = keys or df.columns
            if keep == "any":
                return df.dropDuplicates(on)
            if keep == "none":  # counted before the shuffle, so a frequent key stays small
                held = df.groupBy(*on).agg(F.count("*").alias("__n"), F.first(F.struct(F.lit(0).alias("__"), *[c for c in df.columns if c not in on])).alias("__row"))
                return held.where("__n = 1").select(*[F.col(f"`{c}`") if c in on else F.col(f"__row.`{c}`").alias(c) for c in df.columns])
            first = Window.partitionBy(*on).orderBy(*(order if keep == "first" else backwards))
            return df.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")

        return (self._unsorted or self)._then(step)

    def union_distinct(self, other: Any) -> Relation:
        return self._then(lambda a, b: a.unionByName(b).distinct(), relation(other))

    def intersect(self, other: Any) -> Relation:
        return self._then(lambda a, b: a.intersect(b.select(a.columns)), relation(other))

    def difference(self, other: Any) -> Relation:
        return self._then(lambda a, b: a.subtract(b.select(a.columns)), relation(other))

    # ---- shape

    def drop_nulls(self, subset: Any = None) -> Relation:
        """Rows without NULL in the subset (or anywhere); NaN is a value."""

        def step(df: DataFrame) -> DataFrame:
            on = _names([subset]) if subset is not None else df.columns
            return df.filter(functools.reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() for c in on]))

        return self._then(step, order=self._order)

    def explode(self, *columns: str) -> Relation:
        """One row for each element, lists side by side; an empty or NULL list gives one row with NULL."""
        names = _names(columns)

        def step(df: DataFrame) -> DataFrame:
            if len(names) == 1:
                return df.withColumn(names[0], F.explode_outer(names[0]))
            zipped = df.withColumn("__zip", F.explode_outer(F.arrays_zip(*[F.col(n).alias(n) for n in names])))
            return zipped.select(*[F.col(f"__zip.`{c}`").alias(c) if c in names else F.col(f"`{c}`") for c in df.columns])

        return self._then(step)

    def sample(self, n: int | None = None, fraction: float | None = None, seed: int | None = None) -> Relation:
        """n rows, or each row with a chance; without replacement."""
        if (n is None) == (fraction is None):
            raise ValueError("sample takes n or fraction")
        if n is None:
            return self._then(lambda df: df.sample(fraction=fraction, seed=seed))
        return self._then(lambda df: df.orderBy(F.rand(seed) if seed is not None else F.rand()).limit(n))

    def unpivot(self, on: Any, index: Any = None, variable_name: str = "variable", value_name: str = "value") -> Relation:
        """Columns `on` as rows; columns in neither list go."""
        return self._then(lambda df: df.unpivot(_names([index]) if index is not None else [], _names([on]), variable_name, value_name))

    melt = unpivot

    def pivot(self, on: str, index: Any, values: Any, aggregate_function: str = "first", on_values: list[Any] | None = None) -> Relation:
        """Values of `on` as columns, in ascending order. on_values names them and saves the pass that finds them."""
        if aggregate_function not in AGGREGATES:
            raise ValueError(f"aggregate_function is one of {', '.join(AGGREGATES)}")
        function = {"mean": F.avg, "len": F.count}.get(aggregate_function) or getattr(F, aggregate_function)

        def step(df: DataFrame) -> DataFrame:
            columns = _names([values])
            found = on_values
            if found is None:
                found = [r[0] for r in df.select(on).where(F.col(on).isNotNull()).distinct().orderBy(on).limit(MOST_PIVOTED + 1).collect()]
                if len(found) > MOST_PIVOTED:
                    raise ValueError(f"{on!r} has more than {MOST_PIVOTED} values; name those wanted in on_values")
            measures = [function(c).alias(c) for c in columns]
            return df.groupBy(*_names([index])).pivot(on, found).agg(*measures)

        return self._then(step)

    # ---- terminals

    def pipe(self, function: Callable[..., Any], *args: Any, **kwargs: Any) -> Any:
        return function(self, *args, **kwargs)

    def compile(self) -> DataFrame:
        """The DataFrame, not run."""
        return self.resolve(_outside)

    def collect(self) -> list:
        return self.compile().collect()

    @property
    def columns(self) -> list[str]:
        return self.compile().columns

    def item(self, column: str, row: int = 0) -> Any:
        """One cell, by position in the current order."""
        df = self.compile()
        if column not in df.columns:
            raise KeyError(column)
        found = df.select(F.col(f"`{column}`")).offset(row).limit(1).collect() if row >= 0 else []
        if not found:
            raise IndexError(f"no row {row}")
        return found[0][0]

    def count_rows(self) -> int:
        return self.compile().count()

    def _scalar(self, column: Any, method: str, **options: Any) -> Any:
        e = column if isinstance(column, Expr) else Expr(F.col(column))
        return self.compile().agg(getattr(e, method)(**options).column).first()[0]

    def sum(self, column: Any) -> Any:
        return self._scalar(column, "sum")

    def avg(self, column: Any) -> Any:
        return self._scalar(column, "avg")

    mean = avg

    def min(self, column: Any) -> Any:
        return self._scalar(column, "min")

    def max(self, column: Any) -> Any:
        return self._scalar(column, "max")

    def product(self, column: Any) -> Any:
        return self._scalar(column, "product")

    def std_dev(self, column: Any, **options: Any) -> Any:
        return self._scalar(column, "std_dev", **options)

    def variance(self, column: Any, **options: Any) -> Any:
        return self._scalar(column, "variance", **options)

    def any_value(self, column: Any, **options: Any) -> Any:
        return self._scalar(column, "any_value", **options)

    def to_pandas(self) -> Any:
        return self.compile().toPandas()

    def to_arrow(self) -> Any:
        return self.compile().toArrow()

    def to_dict(self) -> dict[str, list]:
        df = self.compile()
        rows = df.collect()
        return {c: [r[i] for r in rows] for i, c in enumerate(df.columns)}

    def to_dicts(self) -> list[dict[str, Any]]:
        return [r.asDict() for r in self.collect()]

    def to_tuples(self) -> list[tuple]:
        return [tuple(r) for r in self.collect()]

    def to_dataclasses(self, cls: type) -> list[Any]:
        return [cls(**r.asDict()) for r in self.collect()]

    def to_pydantic(self, cls: type) -> list[Any]:
        return [cls.model_validate(r.asDict()) for r in self.collect()]


class GroupedRelation:
    """Group keys awaiting measures; NULL is a group."""

    def __init__(self, base: Relation, keys: list[Any]):
        self._base, self._keys = base, keys

    def agg(self, *measures: Any) -> Relation:
        """Without measures, the distinct keys."""
        keys, some = [compiled(k) for k in self._keys], [compiled(m) for m in _names(measures)]
        if not some:
            return self._base._then(lambda df: df.select(*keys).distinct())
        return self._base._then(lambda df: df.groupBy(*keys).agg(*some))

    def rollup(self, *measures: Any) -> Relation:
        return self._base._then(lambda df: df.rollup(*[compiled(k) for k in self._keys]).agg(*[compiled(m) for m in _names(measures)]))

    def cube(self, *measures: Any) -> Relation:
        return self._base._then(lambda df: df.cube(*[compiled(k) for k in self._keys]).agg(*[compiled(m) for m in _names(measures)]))


def _session() -> SparkSession:
    found = SparkSession.getActiveSession()
    if found is None:
        raise RuntimeError("no active SparkSession")
    return found


def relation(data: Any, spark: SparkSession | None = None, format: str | None = None) -> Relation:
    """A relation over a DataFrame, a table name, a path (with its format), pandas, Arrow or Python data."""
    if isinstance(data, Relation):
        return data
    if isinstance(data, DataFrame):
        return Relation(lambda _: data)
    if isinstance(data, str):
        return Relation(lambda _: (spark or _session()).read.format(format).load(data) if format else (spark or _session()).table(data))

    def ingress(_: Resolver) -> DataFrame:
        from tessera.sources.ingress import to_frame

        return to_frame(data, spark or _session())

    return Relation(ingress)


def concat(relations: Iterable[Any]) -> Relation:
    """All rows of relations with the same columns."""
    first, *rest = [relation(r) for r in relations]
    return first._then(lambda *frames: functools.reduce(DataFrame.unionByName, frames), *rest) if rest else first
