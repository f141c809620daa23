"""Physical plans: what must reach the scan does, and nothing leaves the JVM."""

import re

import pytest

from tessera import catalog, col, relation

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in ("streaming_filter", "pydata_roundtrip", "terminals")])
def test_stays_in_the_jvm(spark, name):
    text = plan(catalog.QUERIES[name](spark, SF))
    assert not re.search("Python|Pandas|ArrowEval|MapInArrow", text)
    assert "CartesianProduct" not in text
    assert ("NestedLoop" in text) <= (name in ("join_cross", "agg_values", "custom_converters"))


def test_pushdown_and_pruning(spark):
    rows = catalog.read(spark, SF, "lineitem").filter(col("l_quantity") < 5, col("l_returnflag") == "R").select("l_orderkey")
    text = plan(rows.compile())
    assert "LessThan(l_quantity,5.0)" in text and "EqualTo(l_returnflag,R)" in text
    assert re.search(r"ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_returnflag:string>", text)


def test_top_k_keeps_no_full_sort(spark):
    text = plan(catalog.top_k(spark, SF))
    assert "TakeOrderedAndProject" in text and "Exchange" not in text


def test_aggregates_combine_before_the_shuffle(spark):
    assert "partial_sum" in plan(catalog.group_by_expression(spark, SF)) or "partial_count" in plan(catalog.group_by_expression(spark, SF))


def test_as_of_join_has_no_single_task_window(spark):
    text = plan(catalog.join_asof_forward(spark, SF))
    windows = re.findall(r"Window \[last\(__right", text)
    assert windows and "hashpartitioning(__range" in text


def test_windows_over_one_key_shuffle_once(spark):
    text = plan(catalog.window_frames(spark, SF))
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 1


def test_relation_over_a_table_name(spark):
    relation([{"x": 1}], spark).compile().createOrReplaceTempView("named_rows")
    assert relation("named_rows", spark).count_rows() == 1
    assert relation(f"{SF}/region.parquet", spark, format="parquet").count_rows() == 5
