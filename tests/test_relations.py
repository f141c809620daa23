"""Relations on literal rows: layouts, order, edge cases, DAGs."""

import bisect
import random

import pytest

import tessera as te
from tessera import col, relation


@pytest.fixture(scope="module")
def rows(spark):
    return relation([{"id": i, "g": "ab"[i % 2], "v": None if i == 3 else float(i)} for i in range(6)], spark)


def test_pipeline_is_lazy_and_immutable(rows):
    kept = rows.filter(col("v") > 1, col("id") < 5)
    assert kept.sort("id").select("id").to_tuples() == [(2,), (4,)]
    assert rows.count_rows() == 6
    assert rows.pipe(lambda r, n: r.sort("id").head(n), 2).to_dict() == {"id": [0, 1], "g": ["a", "b"], "v": [0.0, 1.0]}


def test_with_columns_sees_the_input(rows):
    out = rows.with_columns((col("id") + 10).alias("id"), (col("id") * 2).alias("w"), k=1).sort("id").head(1).to_dicts()
    assert out == [{"id": 10, "g": "a", "v": 0.0, "w": 0, "k": 1}]


def test_drop_and_rename(rows):
    assert rows.drop("v").rename({"g": "group"}).columns == ["id", "group"]
    with pytest.raises(KeyError):
        rows.drop("no").compile()


def test_order(rows):
    assert [r[0] for r in rows.sort("v").select("id").to_tuples()] == [0, 1, 2, 4, 5, 3]
    assert [r[0] for r in rows.sort("v", descending=True).select("id").to_tuples()] == [5, 4, 2, 1, 0, 3]
    assert [r["id"] for r in rows.sort("v").tail(2).to_dicts()] == [5, 3]
    assert [r["id"] for r in rows.sort("id").slice(2, 2).to_dicts()] == [2, 3]
    assert [r["id"] for r in rows.top_k(2, by="v").to_dicts()] == [5, 4]
    assert rows.sort("id", descending=True).with_row_index("n").sort("n").select("n", "id").to_tuples() == [(i, 5 - i) for i in range(6)]
    with pytest.raises(ValueError):
        rows.sort("id", "v", descending=[True])


def test_items(rows):
    ordered = rows.sort("id")
    assert ordered.item("id", 4) == 4
    with pytest.raises(KeyError):
        ordered.item("no")
    for bad in (-1, 6):
        with pytest.raises(IndexError):
            ordered.item("id", bad)


def test_scalar_terminals(spark):
    x = relation([{"x": v} for v in (1, 2, 3, 4, 6)], spark)
    assert (x.sum("x"), x.avg("x"), x.product("x"), x.min("x"), x.max("x")) == (16, 3.2, 144.0, 1, 6)
    empty = x.filter(col("x") > 100)
    assert (empty.sum("x"), empty.avg("x"), empty.any_value("x"), empty.count_rows()) == (None, None, None, 0)


def test_join_layouts(spark):
    left = relation([{"k": 1, "v": "a"}, {"k": 2, "v": "b"}, {"k": None, "v": "n"}], spark)
    right = relation([{"k": 2, "v": "x"}, {"k": 3, "v": "y"}, {"k": None, "v": "m"}], spark)
    assert left.join(right, on="k").to_dicts() == [{"k": 2, "v": "b", "v_right": "x"}]
    outer = left.join(right, on="k", how="outer")
    assert outer.columns == ["k", "v", "k_right", "v_right"]
    assert len(outer.collect()) == 5
    r = left.join(right, on="k", how="right", suffix="_r").sort("k").to_tuples()
    assert r == [(2, "b", "x"), (3, None, "y"), (None, None, "m")]
    assert left.join(right, on="k", how="semi").to_tuples() == [(2, "b")]
    assert sorted(left.join(right, on="k", how="anti").to_tuples(), key=str) == sorted([(1, "a"), (None, "n")], key=str)
    assert left.join([{"k": 1, "z": 9}], on="k", execute_on="broadcast").to_tuples() == [(1, "a", 9)]
    assert left.join(right, left_on="v", right_on="v", how="left").columns == ["k", "v", "k_right"]
    with pytest.raises(ValueError):
        left.join(right, on="k", how="sideways")


@pytest.mark.parametrize("strategy", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("by", [None, "g"])
@pytest.mark.parametrize("tolerance", [None, 3])
def test_asof_against_brute_force(spark, strategy, by, tolerance):
    rng = random.Random(4)
    left = [{"i": i, "t": rng.choice([None, *range(200)]), "g": rng.choice("xyz")} for i in range(150)]
    times = {g: sorted(rng.sample(range(200), 20)) for g in "xyz"}
    if by is None:
        times = {"x": times["x"]}
    right = [{"t": t, "g": g, "w": f"{g}{t}"} for g, some in times.items() for t in some]
    out = relation(left, spark).join_asof(relation(right, spark), on="t", by=by, strategy=strategy, tolerance=tolerance)
    got = {r["i"]: r["w"] for r in out.to_dicts()}
    assert len(got) == len(left)
    for row in left:
        some, t, want = times.get(row["g"] if by else "x", []), row["t"], None
        if t is not None:
            back = some[bisect.bisect_right(some, t) - 1] if bisect.bisect_right(some, t) else None
            ahead = some[bisect.bisect_left(some, t)] if bisect.bisect_left(some, t) < len(some) else None
            want = {"backward": back, "forward": ahead}.get(strategy)
            if strategy == "nearest":
                want = back if ahead is None or (back is not None and t - back <= ahead - t) else ahead
            if want is not None and tolerance is not None and abs(want - t) > tolerance:
                want = None
        assert got[row["i"]] == (None if want is None else f"{row['g'] if by else 'x'}{want}")


def test_groups(rows):
    assert rows.group_by("g").agg().sort("g").to_tuples() == [("a",), ("b",)]
    assert rows.group_by((col("id") % 3).alias("m")).agg(te.count_records().alias("n")).sort("m").to_tuples() == [(0, 2), (1, 2), (2, 2)]
    assert rows.agg(col("v").sum().alias("s")).to_tuples() == [(12.0,)]
    assert rows.group_by("g").rollup(te.count_records().alias("n")).count_rows() == 3


def test_unique(rows):
    assert rows.unique("g").columns == ["id", "g", "v"]
    assert sorted(r["id"] for r in rows.sort("id").unique("g", keep="last").to_dicts()) == [4, 5]
    assert sorted(r["id"] for r in rows.sort("id").unique("g", keep="first").to_dicts()) == [0, 1]
    assert sorted(r["id"] for r in rows.sort("id").filter(col("id") < 4).unique("g", keep="last").to_dicts()) == [2, 3]
    assert sorted(r["id"] for r in rows.sort("id").head(3).unique("g", keep="last").to_dicts()) == [1, 2]
    plan = rows.sort("id").unique("g", keep="last").compile()._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "Sort [" not in plan
    assert [r["id"] for r in rows.sort("id").filter(col("id") < 4).tail(2).to_dicts()] == [2, 3]
    assert rows.unique("g", keep="none").count_rows() == 0
    with pytest.raises(ValueError):
        rows.unique("g", keep="first")


def test_sets(spark):
    a, b = relation([{"x": 1}, {"x": 1}, {"x": 2}], spark), relation([{"x": 2}, {"x": 3}], spark)
    assert te.concat([a, b]).count_rows() == 5
    assert sorted(a.union_distinct(b).to_tuples()) == [(1,), (2,), (3,)]
    assert a.intersect(b).to_tuples() == [(2,)]
    assert a.difference(b).to_tuples() == [(1,)]


def test_shape(spark):
    lists = relation([{"i": 1, "a": [1, 2], "b": ["x", "y"]}, {"i": 2, "a": [], "b": []}, {"i": 3, "a": None, "b": None}], spark)
    assert lists.explode("a", "b").sort("i", "a").to_tuples() == [(1, 1, "x"), (1, 2, "y"), (2, None, None), (3, None, None)]
    wide = relation([{"k": "p", "x": 1, "y": 2}, {"k": "q", "x": 3, "y": None}], spark)
    long = wide.unpivot(["x", "y"], "k")
    assert long.count_rows() == 4 and long.columns == ["k", "variable", "value"]
    assert long.pivot("variable", "k", "value").sort("k").to_tuples() == [("p", 1, 2), ("q", 3, None)]
    assert wide.drop_nulls().to_tuples() == [("p", 1, 2)]
    assert wide.drop_nulls(subset="x").count_rows() == 2
    nan = relation([{"f": float("nan")}, {"f": None}], spark)
    assert nan.drop_nulls().count_rows() == 1
    assert wide.sample(n=1).count_rows() == 1
    with pytest.raises(ValueError):
        wide.sample()


def test_dag(spark):
    dag = te.RelationDAG()
    dag.add("base", relation([{"x": 1}, {"x": 2}], spark))
    dag.add("doubled", dag.ref("base").with_columns((col("x") * 2).alias("y")))
    dag.add("joined", dag.ref("doubled").join(dag.ref("base").rename({"x": "z"}), left_on="y", right_on="z"))
    assert dag.dependency_edges == {("base", "doubled"), ("base", "joined"), ("doubled", "joined")}
    assert dag.topological_order() == ["base", "doubled", "joined"]
    assert dag.topological_order("doubled") == ["base", "doubled"]
    assert [tuple(r) for r in dag.collect("joined", persist_shared=True).collect()] == [(1, 2)]
    with pytest.raises(te.RelationDAGRequired):
        dag.ref("base").compile()
    with pytest.raises(ValueError):
        dag.add("base", relation([{"x": 1}], spark))
    with pytest.raises(KeyError):
        dag.collect("no")
    dag.add("p", dag.ref("q"))
    dag.add("q", dag.ref("p"))
    with pytest.raises(ValueError, match="cycle"):
        dag.topological_order()


def test_join_keeps_every_column_whatever_its_name(spark):
    left = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (None, "c", "z")], ["k", "l0", "a.b"])
    right = spark.createDataFrame([(1, "p", "q", 7, "t"), (3, "r", "s", 8, "u")], ["K", "__keyword", "r0", "a.b", "__key0"])
    for how, rows in {
        "inner": {(1, "a", "x", "p", "q", 7, "t")},
        "left": {(1, "a", "x", "p", "q", 7, "t"), (2, "b", "y", None, None, None, None), (None, "c", "z", None, None, None, None)},
        "right": {(1, "a", "x", "p", "q", 7, "t"), (3, None, None, "r", "s", 8, "u")},
    }.items():
        out = relation(left).join(relation(right), left_on="k", right_on="k", how=how).compile()
        assert out.columns == ["k", "l0", "a.b", "__keyword", "r0", "a.b_right", "__key0"]
        assert {tuple(r) for r in out.collect()} == rows
    outer = relation(left).join(relation(right), left_on="k", right_on="K", how="outer").compile()
    assert outer.columns == ["k", "l0", "a.b", "K", "__keyword", "r0", "a.b_right", "__key0"]
    assert outer.count() == 4
    assert {tuple(r) for r in relation(left).join(relation(right), left_on="k", right_on="K", how="anti").compile().collect()} == {(2, "b", "y"), (None, "c", "z")}
    assert relation(left).join(relation(left), on="k").compile().count() == 2


@pytest.mark.parametrize("ranges", [None, 1, 3, 500])
def test_asof_in_any_number_of_ranges(spark, ranges):
    left = spark.createDataFrame([(i, None if i % 5 == 0 else i * 3) for i in range(60)], "id long, t long")
    right = spark.createDataFrame([(j * 7 - 300, f"r{j}") for j in range(100)], "t long, name string")
    out = relation(left).join_asof(relation(right), on="t", strategy="backward", ranges=ranges).compile().collect()
    keys = [j * 7 - 300 for j in range(100)]
    assert len(out) == 60
    for r in out:
        near = [j for j, k in enumerate(keys) if r["t"] is not None and k <= r["t"]]
        assert r["name"] == (f"r{near[-1]}" if near else None)
