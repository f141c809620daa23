"""Three-valued logic: truth tables, sentinels, coercion and booleanizers."""

import itertools

import pytest

import tessera as te
from tessera import col, relation, t_col

VALUES = (-1, 0, 1)


@pytest.fixture(scope="module")
def table(spark):
    rows = [{"i": i, "a": {1: 1, 0: None, -1: 0}[a], "b": {1: 1, 0: None, -1: 0}[b], "c": {1: 1, 0: None, -1: 0}[c], "ta": a, "tb": b, "tc": c} for i, (a, b, c) in enumerate(itertools.product(VALUES, repeat=3))]
    return relation(rows, spark)


def raw(e):
    return te.native(e.compile(booleanizer=None))


def test_truth_tables(table):
    a, b, c = (t_col(n).t_eq(1) for n in "abc")
    out = table.select("ta", "tb", "tc", raw(a).alias("a"), raw(a.t_and(b, c)).alias("and_"), raw(a.t_or(b, c)).alias("or_"), raw(a.t_not()).alias("not_"), raw(a.t_xor(b, c)).alias("xor_"), raw(a.t_xor_parity(b, c)).alias("parity")).to_dicts()
    for r in out:
        x = (r["ta"], r["tb"], r["tc"])
        assert r["a"] == x[0]
        assert (r["and_"], r["or_"], r["not_"]) == (min(x), max(x), -x[0])
        assert r["xor_"] == (0 if 0 in x else 1 if x.count(1) == 1 else -1)
        assert r["parity"] == (0 if 0 in x else 1 if x.count(1) % 2 else -1)


def test_booleanizers(table):
    a = t_col("a").t_eq(1)
    tests = {"is_true": (1,), "is_false": (-1,), "is_unknown": (0,), "is_known": (1, -1), "maybe_true": (1, 0), "maybe_false": (-1, 0)}
    for name, kept in tests.items():
        assert {r[0] for r in table.filter(getattr(a, name)()).select("ta").to_tuples()} == set(kept)
        assert {r[0] for r in table.filter(te.native(a.compile(booleanizer=name))).select("ta").to_tuples()} == set(kept)
    assert {r[0] for r in table.filter(a).select("ta").to_tuples()} == {1}
    assert {r[0] for r in table.filter(te.native(a.compile(booleanizer=lambda e: e.is_unknown()))).select("ta").to_tuples()} == {0}
    with pytest.raises(ValueError, match="booleanizer"):
        a.compile(booleanizer="perhaps")


def test_sentinels(spark):
    r = relation([{"s": 80}, {"s": -99999}, {"s": 60}, {"s": None}], spark)
    for unknown, want in ((None, [1, -1, -1, 0]), ({-99999}, [1, 0, -1, -1]), ({-99999, None}, [1, 0, -1, 0])):
        assert [x for (x,) in r.select(raw(t_col("s", unknown=unknown).t_gt(70))).to_tuples()] == want


def test_coercion(spark):
    r = relation([{"x": True, "y": 5}, {"x": False, "y": None}, {"x": None, "y": 1}], spark)
    mixed = col("x").and_(t_col("y").t_gt(3))
    assert [x for (x,) in r.select(mixed.alias("m")).to_tuples()] == [True, False, False]
    assert [x for (x,) in r.select(raw(t_col("y").t_gt(3).t_and(col("x")))).to_tuples()] == [1, -1, -1]
    assert [x for (x,) in r.select(raw(col("x").to_ternary())).to_tuples()] == [1, -1, -1]


def test_lists(spark):
    r = relation([{"x": "a", "l": ["a", "b"]}, {"x": "c", "l": ["a"]}, {"x": "a", "l": None}, {"x": None, "l": ["a"]}], spark)
    assert [x for (x,) in r.select(raw(t_col("x").t_is_in(col("l")))).to_tuples()] == [1, -1, 0, 0]
    assert [x for (x,) in r.select(raw(t_col("x").t_is_not_in(["a"]))).to_tuples()] == [-1, 1, -1, 0]
    assert [x for (x,) in r.select(raw(t_col("x").t_is_in([]))).to_tuples()] == [-1, -1, -1, 0]


def test_constants(spark):
    r = relation([{"x": 1}], spark)
    assert r.select(raw(te.always_true()).alias("t"), raw(te.always_unknown()).alias("u"), raw(te.always_false()).alias("f")).to_tuples() == [(1, 0, -1)]
    assert r.filter(te.always_unknown()).count_rows() == 0
