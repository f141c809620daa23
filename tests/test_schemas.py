"""Specs, conforming, converters, packages, and Python data in and out."""

import dataclasses
import datetime
import json
from collections import namedtuple
from enum import Enum
from typing import Optional

import pytest
from pyspark.sql import types as T

import tessera as te
from tessera import UniversalType as U
from tessera import col, relation
from tessera.plans import typespec as ts
from tessera.plans.converters import REGISTRY, restore_special_characters, safe_float, safe_int
from tessera.sources import egress, mappers
from tessera.sources.ingress import detect, to_frame


def test_types():
    assert te.resolve_dtype("Int64") == te.resolve_dtype(int) == "i64"
    assert te.normalize_type("double") == U.NUMBER and te.normalize_type(T.DateType()) == U.DATE
    assert te.normalize_type(Optional[int]) == te.normalize_type(int | None) == U.INTEGER
    assert te.normalize_type(list[str]) == U.ARRAY and te.normalize_type("nonsense") == U.ANY
    assert te.is_safe_cast("integer", "number") and not te.is_safe_cast("number", "integer") and not te.is_safe_cast("array", "date")


DESCRIPTOR = {
    "title": "Staff",
    "primaryKey": "employee_id",
    "missingValues": ["", "-"],
    "fields": [
        {"name": "employee_id", "type": "integer", "constraints": {"required": True, "unique": True}},
        {"name": "full_name", "type": "string", "constraints": {"maxLength": 5, "pattern": "[A-Z].*"}, "x-other": {"rename_from": "n"}},
        {"name": "salary", "type": "number", "constraints": {"minimum": 0}, "x-tessera": {"null_fill": -1}},
        {"name": "role", "constraints": {"enum": ["a", "b"]}, "trueValues": ["y"]},
    ],
    "foreignKeys": [{"fields": ["role"], "reference": {"resource": "roles", "fields": ["id"]}}],
    "x-tessera": {"keep_only_mapped": True},
}


def test_frictionless_round_trip(tmp_path):
    spec = te.TypeSpec.from_frictionless(DESCRIPTOR)
    assert spec.get_field("full_name").source_name == "n" and spec.keep_only_mapped
    assert spec.get_field("salary").null_fill == -1 and spec.get_field("role").type == U.STRING
    again = te.TypeSpec.from_frictionless(json.dumps(spec.to_frictionless()))
    assert again == spec
    (tmp_path / "s.json").write_text(json.dumps(DESCRIPTOR))
    assert te.TypeSpec.from_frictionless(tmp_path / "s.json") == spec
    assert spec.to_struct_type()["employee_id"].nullable is False


def test_compare_and_validate(spark):
    df = spark.createDataFrame([(1, "x")], "id long, name string")
    assert te.validate_match(df, te.typespec({"id": "integer", "name": "string"}), strict=True) == []
    errors = te.validate_match(df, te.typespec({"id": "string", "more": "date"}), strict=True)
    assert len(errors) == 3
    with pytest.raises(AssertionError):
        ts.assert_match(df, te.typespec({"more": "date"}))
    diff = te.compare_specs(te.typespec({"a": "integer"}), te.typespec({"a": "string", "b": "date"}))
    assert diff.missing_columns == ["b"] and diff.type_mismatches == [("a", U.INTEGER, U.STRING)] and not diff.is_compatible


def test_constraints(spark):
    spec = te.TypeSpec.from_frictionless(DESCRIPTOR)
    df = spark.createDataFrame([(1, "Ann", 5.0, "a"), (1, "annabel", -1.0, "c"), (None, "Bo", None, None)], "employee_id long, full_name string, salary double, role string")
    assert ts.check_constraints(df, spec) == {("employee_id", "required"): 1, ("employee_id", "unique"): 1, ("full_name", "max_length"): 1, ("full_name", "pattern"): 1, ("salary", "minimum"): 1, ("role", "enum"): 1}


def test_conform(spark):
    df = spark.createDataFrame([("1", None, "x"), (None, "2024-05-06", "y")], "a string, b string, c string")
    out = te.conform({"n": {"cast": "integer", "rename_from": "a", "null_fill": -1}, "day": {"cast": "date", "rename_from": "b"}}).apply(df)
    assert out.columns == ["n", "day", "c"]
    assert [tuple(r) for r in out.collect()] == [(1, None, "x"), (-1, datetime.date(2024, 5, 6), "y")]
    builder = te.ConformBuilder.from_frictionless(te.conform({"n": {"rename_from": "a"}}).to_frictionless())
    assert builder.spec.get_field("n").source_name == "a"
    with pytest.raises(KeyError):
        te.conform({"n": {"rename_from": "zz"}}).apply(df)


def test_converters(spark):
    df = spark.createDataFrame([("1.5", "<a & 'b'>", "Y"), ("NaN", None, "nope"), (None, "x", "0"), ("-2.9", "", "True")], "f string, x string, b string")
    r = df.select(*[REGISTRY.column(n, df[c]).alias(n) for n, c in (("safe_float", "f"), ("safe_int", "f"), ("xml_string", "x"), ("rich_boolean", "b"))]).collect()
    assert [tuple(x) for x in r] == [(1.5, 1, "&lt;a &amp; &apos;b&apos;&gt;", True), (None, None, None, None), (None, None, "x", False), (-2.9, -2, "", True)]
    assert restore_special_characters({"k": ["&lt;a &amp; &quot;b&quot;&gt;"]}) == {"k": ['<a & "b">']}
    assert REGISTRY.convert("yes", "rich_boolean") is True and REGISTRY.convert("junk", "rich_boolean", raise_on_error=False) is None
    with pytest.raises(ValueError, match="field 'q'"):
        REGISTRY.convert("junk", "rich_boolean", field_name="q")
    REGISTRY.register("shout", "string", python=lambda v: v.upper() + "!")
    try:
        assert not REGISTRY.is_vectorized("shout")
        out = te.conform({"x": {"cast": "shout"}}).apply(df.select("x"))
        assert [x for (x,) in out.collect()] == ["<A & 'B'>!", None, "X!", "!"]
    finally:
        REGISTRY.unregister("shout")


@dataclasses.dataclass
class Person:
    name: str
    age: int | None = None
    tags: list = dataclasses.field(default_factory=list)


Point = namedtuple("Point", "x y")


@pytest.mark.parametrize(
    ("data", "kind", "columns", "n"),
    [
        ([{"a": 1}, {"a": 2, "b": "x"}], "records", ["a", "b"], 2),
        ({"a": [1, 2], "b": [None, 2.5]}, "columns", ["a", "b"], 2),
        ([Person("Ann", 3), Person("Bo")], "dataclass", ["name", "age", "tags"], 2),
        (Person("Ann"), "dataclass", ["name", "age", "tags"], 1),
        ([Point(1, 2)], "namedtuple", ["x", "y"], 1),
        ([(1, "a"), (2, "b")], "tuple", ["column_0", "column_1"], 2),
        ([1, 2, 3], "collection", ["value"], 3),
        ({1.5, 2.5}, "collection", ["value"], 2),
        ({"A": [(1, "x"), (2, "y")], "B": [(3, "z")]}, "indexed", ["col_0", "col_1", "index"], 3),
        ({("A", 1): [{"v": 1}]}, "indexed", ["v", "index_0", "index_1"], 1),
    ],
)
def test_ingress(spark, data, kind, columns, n):
    assert detect(data) == kind
    df = to_frame(data, spark)
    assert df.columns == columns and df.count() == n


def test_ingress_more(spark):
    import pandas as pd
    import pyarrow as pa

    assert to_frame(pd.DataFrame({"a": [1]}), spark).columns == ["a"]
    assert to_frame(pa.table({"a": [1]}), spark).count() == 1
    assert to_frame({"a": pd.Series([1, 2])}, spark).count() == 2
    assert to_frame([], spark).count() == 0
    spec = te.typespec({"a": "string", "b": "date"})
    assert to_frame([{"a": 1, "b": None}], spark, spec).dtypes == [("a", "string"), ("b", "date")]
    with pytest.raises(TypeError):
        to_frame(object(), spark)
    with pytest.raises(ValueError):
        to_frame({"a": [1], "b": [1, 2]}, spark)
    pydantic = pytest.importorskip("pydantic")
    Model = pydantic.create_model("Model", a=(int, ...), b=(str, "z"))
    assert [tuple(r) for r in to_frame([Model(a=1)], spark).collect()] == [(1, "z")]
    assert ts.extract_from_pydantic(Model).get_field("a").constraints.required


def test_egress(spark):
    r = relation([{"k": "a", "v": 1, "d": datetime.date(2024, 1, 2)}, {"k": "a", "v": 2, "d": None}, {"k": "b", "v": 3, "d": None}], spark).sort("v")
    assert egress.to_dictionary_of_lists(r)["v"] == [1, 2, 3]
    assert egress.to_index_of_tuples(r.select("k", "v"), "k") == {"a": [("a", 1), ("a", 2)], "b": [("b", 3)]}
    assert list(egress.to_index_of_dictionaries(r, ["k", "v"])) == [("a", 1), ("a", 2), ("b", 3)]
    assert egress.to_list_of_named_tuples(r)[0].v == 1
    assert egress.to_list_of_typed_named_tuples(r)[0].d == "2024-01-02"
    assert egress.to_index_of_typed_named_tuples(r, "k", preserve_dates=True)["a"][0].d == datetime.date(2024, 1, 2)
    people = egress.to_list_of_dataclasses(relation([{"name": "Ann", "age": None}], spark), Person, apply_defaults=True)
    assert people == [Person("Ann", None, [])]
    assert r.to_pandas().shape == (3, 3) and r.to_arrow().num_rows == 3
    assert egress.to_dictionary_of_series(r)["k"].tolist() == ["a", "a", "b"]
    assert relation([{"name": "x", "age": 2, "tags": ["t"]}], spark).to_dataclasses(Person) == [Person("x", 2, ["t"])]


def test_mappers():
    assert mappers.map_dict_to_dataclass({"n": "Ann"}, Person, {"name": "n"}) == Person("Ann", None, None)
    assert mappers.map_tuple_to_dataclass(("Ann", 4), Person, apply_defaults=True) == Person("Ann", 4, [])
    assert mappers.map_namedtuple_to_dataclass(Point(1, 2), Person, {"name": "x"}).name == 1
    assert mappers.get_required_fields(Person) == ["name"] and mappers.get_optional_fields(Person) == ["age", "tags"]
    assert mappers.is_dataclass_object_all_none(mappers.create_all_none_dataclass(Person))

    class Colour(Enum):
        RED = 1
        CRIMSON = 1
        BLUE = "b"

    assert mappers.member_names(Colour) == ["RED", "BLUE"] and mappers.find_all_member_names(Colour, 1) == ["RED", "CRIMSON"]
    assert mappers.find_member(Colour, "b") is Colour.BLUE and mappers.is_valid_member_name(Colour, "CRIMSON")
    assert not mappers.is_valid_member_value(Colour, True) and mappers.is_empty([]) and not mappers.is_empty(0)
    with pytest.raises(TypeError):
        mappers.member_names(Person)


def test_extraction(spark):
    spec = ts.extract_from_dataclass(Person)
    assert spec.field_names == ["name", "age", "tags"] and spec.get_field("name").constraints.required
    assert spec.get_field("age").type == U.INTEGER and spec.get_field("age").constraints is None
    out = ts.extract_from_dataframe(spark.createDataFrame([(1,)], "a int"), preserve_backend_types=True)
    assert out.get_field("a").backend_type == "int"


def test_package(spark, tmp_path):
    (tmp_path / "gdp.csv").write_text("Country Name;Year;Value\n# note\nAB;2020;1.5\nCD;2021;NA\n")
    (tmp_path / "more.tsv").write_text("a\tb\n1\tx\n")
    (tmp_path / "rows.json").write_text(json.dumps([{"x": 1}, {"x": 2}]))
    (tmp_path / "lines.ndjson").write_text('{"x": 1}\n{"x": 5}\n')
    (tmp_path / "note.txt").write_text("hello")
    raw = {
        "name": "p",
        "resources": [
            {"name": "gdp", "path": "gdp.csv", "dialect": {"delimiter": ";", "commentChar": "#", "nope": 1}, "schema": {"missingValues": ["NA"], "fields": [{"name": "country", "type": "string", "x-tessera": {"rename_from": "Country Name"}}, {"name": "Year", "type": "integer"}, {"name": "Value", "type": "number"}]}, "custom": 3},
            {"name": "tabs", "path": "more.tsv"},
            {"name": "rows", "path": "rows.json"},
            {"name": "lines", "path": ["lines.ndjson", "lines.ndjson"]},
            {"name": "inline", "data": [{"x": 7}], "schema": {"fields": [{"name": "x", "type": "integer"}], "foreignKeys": [{"fields": ["x"], "reference": {"resource": "rows", "fields": ["x"]}}]}},
            {"name": "note", "path": "note.txt"},
        ],
        "extra": True,
    }
    (tmp_path / "datapackage.json").write_text(json.dumps(raw))
    package = te.DataPackage.from_descriptor(tmp_path / "datapackage.json")
    assert package.to_descriptor()["extra"] is True and package.to_descriptor()["resources"][0]["custom"] == 3
    dag = package.to_relation_dag(spark=spark)
    assert [tuple(r) for r in dag.collect("gdp").collect()] == [("AB", 2020, 1.5), ("CD", 2021, None)]
    assert dag.collect("tabs").columns == ["a", "b"] and dag.collect("rows").count() == 2 and dag.collect("lines").count() == 4
    assert dag.assets["note"].read_bytes() == b"hello" and dag.constraint_edges == {("rows", "inline")}
    assert package.to_relation_dag({"rows": [{"x": 9}]}, spark).collect("rows").count() == 1
    back = dag.to_package()
    assert {r.name for r in back.resources} == {r["name"] for r in raw["resources"]}
    package.write(tmp_path / "again.json")
    assert te.DataPackage.from_descriptor(tmp_path / "again.json").to_descriptor() == package.to_descriptor()
    for bad in ({"resources": []}, {"resources": [{"name": "a", "path": "x", "data": []}]}, {"resources": [{"name": "a", "path": "x.csv"}, {"name": "a", "path": "x.csv"}]}):
        with pytest.raises(ValueError):
            te.DataPackage.from_descriptor(bad)
    with pytest.raises(te.UnsupportedResourceFormat):
        te.ResourceRef(te.DataResource("a", path="x.xls", type="table"), spark).relation().compile()
    dag.add("loose", dag.ref("rows").filter(col("x") > 1))
    with pytest.raises(te.MissingResourceSchema):
        dag.to_package()


def test_more_schema_forms():
    from tessera.plans.converters import apply_converters_to_dicts, separate_conversions

    spec = te.conform({"a": {"cast": "integer"}, "b": {"cast": "rich_boolean"}, "c": {}}).spec
    assert separate_conversions(spec) == ({"a": U.INTEGER}, {"b": "rich_boolean"}, {})
    assert apply_converters_to_dicts([{"b": "no"}, {"a": 1}], {"b": "rich_boolean"}) == [{"b": False}, {"a": 1}]
    assert ts.to_pandas_dtypes(spec) == {"a": "Int64", "b": "object", "c": "object"}
    assert [f.name for f in ts.to_arrow_schema(te.typespec({"x": "date", "y": "number"}))] == ["x", "y"]


def test_infinities_are_missing():
    for value in (float("inf"), float("-inf"), float("nan"), None):
        assert safe_float(value) is None and safe_int(value) is None
    assert safe_float("inf") is None and safe_float("2.5") == 2.5 and safe_int(2.9) == 2
    assert REGISTRY.convert(float("inf"), "safe_int", raise_on_error=False) is None


def test_dialects(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Id;said\n1;'it''s'\n2;'a;b'\n")

    def rows(dialect, fields=("Id", "said")):
        resource = {"name": "a", "path": f"{tmp_path}/a.csv", "dialect": {"delimiter": ";", "quoteChar": "'"} | dialect, "schema": {"fields": [{"name": n, "type": "string"} for n in fields]}}
        return [tuple(r) for r in te.DataPackage.from_descriptor({"name": "p", "resources": [resource]}).to_relation_dag(spark=spark).collect("a").collect()]

    assert rows({"doubleQuote": True}) == [("1", "it's"), ("2", "a;b")]
    assert rows({"doubleQuote": False})[1] == ("2", "a;b")
    assert rows({"doubleQuote": True, "headerRows": [1]}) == [("1", "it's"), ("2", "a;b")]
    assert len(rows({"headerRows": []}, ("_c0", "_c1"))) == 3
    assert rows({"doubleQuote": True}, ("ID", "said"))[0] == ("1", "it's")
    with pytest.raises(ValueError):
        rows({"caseSensitiveHeader": True}, ("ID", "said"))
    with pytest.raises(ValueError):
        rows({"headerRows": [1, 2], "headerJoin": "-"})


def test_pydantic_mappers():
    pydantic = pytest.importorskip("pydantic")

    class Person(pydantic.BaseModel):
        name: str
        age: int = 3

    Pair = namedtuple("Pair", ["name", "age"])
    want = Person(name="a", age=4)
    assert mappers.map_dict_to_pydantic({"name": "a", "age": 4}, Person) == want
    assert mappers.map_tuple_to_pydantic(("a", 4), Person) == want
    assert mappers.map_namedtuple_to_pydantic(Pair("a", 4), Person) == want
    assert mappers.map_list_of_dicts_to_pydantic([{"name": "a", "age": 4}], Person) == [want]
    assert mappers.map_list_of_tuples_to_pydantic([("a", 4)], Person) == [want]
    assert mappers.map_list_of_namedtuples_to_pydantic([Pair("a", 4)], Person) == [want]
