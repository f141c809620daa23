"""Conversions by spec on the way in and out: casts and Column converters in Spark, Python-only ones on records."""

import pytest

from tessera.functions.dtypes import UniversalType as U
from tessera.plans import hybrid
from tessera.plans.converters import REGISTRY
from tessera.plans.typespec import FieldSpec, TypeSpec


@pytest.fixture
def spec():
    REGISTRY.register("shout", "string", python=lambda v: v.upper() + "!")
    REGISTRY.register("whisper", "string", python=lambda v: str.lower(v))
    fields = [FieldSpec("n", U.INTEGER, rename_from="raw"), FieldSpec("ok", U.BOOLEAN, custom_cast="rich_boolean"), FieldSpec("s", U.STRING, rename_from="said", null_fill="nothing", custom_cast="shout")]
    yield TypeSpec(fields)
    REGISTRY.unregister("shout")
    REGISTRY.unregister("whisper")


RECORDS = [{"raw": "1", "ok": "yes", "said": "a", "x.y": 1}, {"raw": None, "ok": None, "said": None, "x.y": 2}, {"raw": "3", "ok": "0", "said": "b", "x.y": 3}]
WANT = [(1, True, "A!", 1), (None, None, "NOTHING!", 2), (3, False, "B!", 3)]


def test_in(spark, spec):
    df = hybrid.apply_hybrid_conversion(RECORDS, spec, spark)
    assert df.columns == ["n", "ok", "s", "x.y"] and [tuple(r) for r in df.collect()] == WANT
    assert "Python" not in df._jdf.queryExecution().toString()
    assert hybrid.apply_hybrid_conversion([{"a": 1}], None, spark).collect()[0].asDict() == {"a": 1}
    with pytest.raises(ValueError, match="field 's'"):
        hybrid.apply_hybrid_conversion([{"raw": 1, "ok": 1, "said": 7}], TypeSpec([FieldSpec("s", rename_from="said", custom_cast="whisper")]), spark)


def test_out(spark, spec):
    df = spark.createDataFrame([tuple(r.values()) for r in RECORDS], "raw string, ok string, said string, `x.y` long")
    half, rest = hybrid.apply_native_conversions_for_egress(df, spec)
    assert rest == {"s": "shout"} and [r["s"] for r in half.collect()] == ["a", "nothing", "b"]
    assert [tuple(r.values()) for r in hybrid.apply_hybrid_egress_conversion(df, spec)] == WANT
    named = hybrid.apply_hybrid_egress_conversion(df.drop("x.y"), spec, data_format="namedtuple")
    assert [(r.n, r.ok, r.s) for r in named] == [w[:3] for w in WANT]
    assert hybrid.apply_hybrid_egress_conversion(df.drop("x.y"), spec, lambda d: [r.asDict() for r in d.tail(1)]) == [{"n": 3, "ok": False, "s": "B!"}]
    assert hybrid.apply_hybrid_egress_conversion(df.limit(0), spec) == []
    assert len(hybrid.apply_hybrid_egress_conversion(df)) == 3
    with pytest.raises(ValueError):
        hybrid.apply_hybrid_egress_conversion(df, spec, data_format="list")


def test_casts_and_python_data(spark):
    df = spark.createDataFrame([("1", "2", "x")], "`a.b` string, c string, d string")
    out = hybrid.apply_native_conversions_to_dataframe(df, {"a.b": U.INTEGER, "c": U.NUMBER, "d": U.ANY, "gone": U.DATE})
    assert [tuple(r) for r in out.collect()] == [(1, 2.0, "x")] and out.columns == df.columns
    assert hybrid.apply_native_conversions_to_dataframe(df, {}) is df
    data = [{"b": "no", "z": 1}, {"b": None}, {}]
    assert hybrid.apply_custom_converters_to_python_data(data, {"b": "rich_boolean"}) == [{"b": False, "z": 1}, {"b": None}, {}]
