"""Functions on literal rows, including what options change."""

import datetime
import math

import pytest

import tessera as te
from tessera import col, lit, relation, when


@pytest.fixture(scope="module")
def one(spark):
    """Evaluate expressions over rows given as dicts."""

    def run(rows, *exprs, ddl=None):
        df = spark.createDataFrame(rows, ddl) if ddl else relation(rows, spark).compile()
        return [tuple(r) for r in relation(df).select(*[e.alias(f"c{i}") for i, e in enumerate(exprs)]).collect()]

    return run


def column(rows):
    return [r[0] for r in rows]


def test_python_style_division(one):
    rows = [{"a": -10, "b": 3}, {"a": 10, "b": -3}, {"a": -10, "b": -3}, {"a": 7, "b": 0}]
    out = one(rows, col("a") % col("b"), col("a") // col("b"), col("a") / col("b"))
    for r, (m, f, d) in zip(rows, out, strict=True):
        if r["b"]:
            assert (m, f, d) == (r["a"] % r["b"], r["a"] // r["b"], pytest.approx(r["a"] / r["b"]))
        else:
            assert (m, f, d) == (None, None, math.inf)


def test_ieee_edges(one):
    out = one([{"x": 0.0}, {"x": -1.0}, {"x": None}, {"x": 1.0}], col("x").ln(), col("x") / 0, ddl="x double")
    assert out[0][0] == -math.inf and math.isnan(out[0][1])
    assert math.isnan(out[1][0]) and out[1][1] == -math.inf
    assert out[2] == (None, None) and out[3] == (0.0, math.inf)


def test_null_and_nan(one):
    rows = [(1.0,), (None,), (float("nan"),), (float("inf"),)]
    out = one(rows, col("x").is_null(), col("x").is_nan(), col("x").is_finite(), col("x").fill_null(0), col("x").clip(2, 3), ddl="x double")
    assert out[0] == (False, False, True, 1.0, 2.0)
    assert out[1] == (True, None, None, 0.0, None)
    assert out[2][:3] == (False, True, False)
    assert out[3][:3] == (False, False, False)


@pytest.mark.parametrize(("closed", "want"), [("both", [1, 1, 1]), ("left", [1, 1, 0]), ("right", [0, 1, 1]), ("none", [0, 1, 0])])
def test_between_closed(one, closed, want):
    assert column(one([{"x": 1}, {"x": 2}, {"x": 3}], col("x").between(1, 3, closed=closed))) == [bool(w) for w in want]


def test_case_sensitivity_changes_results(one):
    rows = [{"s": "Hello World"}]
    for make in (lambda cs: col("s").contains("hello", case_sensitive=cs), lambda cs: col("s").starts_with("HELLO", case_sensitive=cs), lambda cs: col("s").ends_with("WORLD", case_sensitive=cs), lambda cs: col("s").like("hello%", case_sensitive=cs), lambda cs: col("s").regex_contains("hello", case_sensitive=cs), lambda cs: col("s").regex_match("hello world", case_sensitive=cs)):
        assert one(rows, make(True), make(False)) == [(False, True)]
    assert one(rows, col("s").replace("hello", "x$", case_sensitive=False)) == [("x$ World",)]


def test_strings(one):
    s = col("s").str
    out = one([{"s": "Straße über"}], s.upper(), s.swapcase(), s.capitalize(), s.reverse(), s.substring(1, 3), s.substring(-4), s.replace_slice(2, 2, "--"), s.strpos("e"), s.count_substring("e"), s.octet_length())
    assert out == [("STRASSE ÜBER", "sTRASSE ÜBER", "Straße über", "rebü eßartS", "tra", "über", "S--aße über", 6, 2, 13)]


@pytest.mark.parametrize("width", [2, 6, 7, 8, 9])
@pytest.mark.parametrize("text", ["abc", "abcd", ""])
def test_center_is_pythons(one, text, width):
    assert one([{"s": text}], col("s").center(width, "*"), col("s").lpad(width, "x"), col("s").rpad(width)) == [(text.center(width, "*"), text.rjust(width, "x"), text.ljust(width))]


def test_affixes_and_regex(one):
    out = one([{"s": "pre-body-suf"}], col("s").strip_prefix("pre-"), col("s").strip_suffix("-suf"), col("s").strip_prefix("no"), col("s").regexp_match_substring("[a-z]+", occurrence=2), col("s").regexp_match_substring("zz"), col("s").regexp_replace("[a-z]+", "_", occurrence=1), col("s").regex_match("pre|x"))
    assert out == [("body-suf", "pre-body", "pre-body-suf", "body", None, "_-body-suf", False)]


def test_casts(one):
    out = one([{"s": "12"}, {"s": "x"}], col("s").cast("i32", failure_behavior="null"), col("s").cast("u8", failure_behavior="null"))
    assert out == [(12, 12), (None, None)]
    assert one([{"x": 1.9}, {"x": -1.9}], col("x").cast(int)) == [(1,), (-1,)]
    with pytest.raises(Exception, match="out of range"):
        one([{"x": 300}], col("x").cast("u8"))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        one([{"s": "x"}], col("s").cast("i32"))


def test_membership_and_conditions(one):
    rows = [{"x": 1}, {"x": 5}, {"x": None}]
    out = one(rows, col("x").is_in([1, 2]), col("x").is_not_in(1), col("x").index_in(5, 1), when(col("x") > 3).then("big").otherwise("small"), col("x").eq_missing(None))
    assert out == [(True, False, 1, "small", False), (False, True, 0, "big", False), (None, None, -1, "small", True)]


def test_argument_checks():
    for make in (te.coalesce, te.greatest, te.least):
        with pytest.raises(ValueError):
            make(1)
    with pytest.raises(TypeError):
        te.native(3)
    with pytest.raises(ValueError):
        te.resolve_dtype("no such type")


def test_dates(one):
    rows = [(datetime.datetime(2024, 12, 30, 13, 45, 59, 123456),), (datetime.datetime(2023, 3, 31, 0, 0),)]
    d = col("t").dt
    out = one(rows, d.day_of_week(), d.week_of_year(), d.iso_year(), d.is_leap_year(), d.millisecond(), d.add_months(-1), d.month_end(), d.truncate("2h"), d.ceil("1d"), d.round("1h"), d.strftime("%d.%m.%Y o'clock %H%%"), ddl="t timestamp_ntz")
    assert out[0][:5] == (1, 1, 2025, True, 123)
    assert out[0][5:] == (datetime.datetime(2024, 11, 30, 13, 45, 59, 123456), datetime.datetime(2024, 12, 31, 13, 45, 59, 123456), datetime.datetime(2024, 12, 30, 12), datetime.datetime(2024, 12, 31), datetime.datetime(2024, 12, 30, 14), "30.12.2024 o'clock 13%")
    assert out[1][5:10] == (datetime.datetime(2023, 2, 28), datetime.datetime(2023, 3, 31), datetime.datetime(2023, 3, 31), datetime.datetime(2023, 3, 31), datetime.datetime(2023, 3, 31))


def test_zones(one):
    rows = [(datetime.datetime(2024, 7, 1, 12),), (datetime.datetime(2024, 1, 1, 12),)]
    out = one(rows, col("t").is_dst("America/New_York"), col("t").to_timezone("America/New_York"), col("t").assume_timezone("America/New_York"), ddl="t timestamp_ntz")
    assert out == [(True, datetime.datetime(2024, 7, 1, 8), datetime.datetime(2024, 7, 1, 16)), (False, datetime.datetime(2024, 1, 1, 7), datetime.datetime(2024, 1, 1, 17))]


def test_present(one):
    now = datetime.datetime.now()
    rows = [(now - datetime.timedelta(minutes=5),), (now - datetime.timedelta(days=2),), (now + datetime.timedelta(minutes=5),)]
    t = col("t")
    out = one(rows, t.within_last("1 hour"), t.older_than("1d"), t.within_next("10m"), t.between_last("3 days", "1 day"), ddl="t timestamp_ntz")
    assert out == [(True, False, False, False), (False, True, False, True), (True, False, True, False)]
    free = one(rows, te.within_last(t, "1 hour"), te.older_than(t, "1d"), te.between_last(t, "3 days", "1 day"), ddl="t timestamp_ntz")
    assert free == [(a, b, d) for a, b, _, d in out]


def test_durations():
    from tessera.functions import durations as d

    assert d.parse_time_expression("3 minutes") == (3, "minutes")
    assert d.to_timedelta("2 mo") == datetime.timedelta(days=60)
    assert d.to_offset_string("2 days") == "2d"
    assert d.parse_combined_duration("-2w3d") == ["-2w", "-3d"]
    for bad in ("soon", "3 fortnights"):
        with pytest.raises(ValueError):
            d.parse_time_expression(bad)
    with pytest.raises(ValueError):
        d.parse_combined_duration("1d!")


def test_names(one, spark):
    df = relation([{"a": 1}], spark).select(col("a").name.prefix("x_"), col("a").suffix("_y"), (col("a") + 1).name.name_to_upper(), col("a").alias("b")).compile()
    assert df.columns == ["x_a", "a_y", "A", "b"]
    with pytest.raises(ValueError):
        lit(1).name.suffix("_x")


def test_aggregates(spark):
    r = relation([{"g": "a", "x": 1.0}, {"g": "a", "x": 3.0}, {"g": "b", "x": None}, {"g": None, "x": 5.0}], spark)
    x = col("x")
    out = r.group_by("g").agg(x.sum().alias("s"), x.count().alias("n"), te.count_records().alias("r"), x.std_dev().alias("sd"), x.std_dev(distribution="POPULATION").alias("sp"), x.any_value(ignore_nulls=True).alias("v"), te.quantile(x, 0.5, "lower").alias("q"), x.sum0().alias("z")).to_dicts()
    by = {o["g"]: o for o in out}
    assert set(by) == {"a", "b", None}
    assert (by["a"]["s"], by["a"]["n"], by["a"]["sp"], by["a"]["q"]) == (4.0, 2, 1.0, 1.0)
    assert by["a"]["sd"] == pytest.approx(math.sqrt(2))
    assert (by["b"]["s"], by["b"]["n"], by["b"]["r"], by["b"]["z"]) == (None, 0, 1, 0)


def test_windows(spark):
    rows = [{"team": t, "score": s, "id": i} for i, (t, s) in enumerate([("A", 10), ("A", 20), ("A", 20), ("B", 30), ("B", 10), ("B", 20)])]
    c = col("score")
    out = relation(rows, spark).select("id", c.rank().over("team", order_by="-score").alias("r"), c.dense_rank().over("team", order_by="-score").alias("d"), c.sum().over("team", order_by="id", rows_between=(None, 0)).alias("run"), c.last_value().over("team", order_by="id").alias("last"), c.nth_value(2).over("team", order_by="id").alias("n2"), c.lag(1, -1).over("team", order_by="id").alias("lag")).sort("id").to_tuples()
    assert out == [(0, 3, 2, 10, 20, 20, -1), (1, 1, 1, 30, 20, 20, 10), (2, 1, 1, 50, 20, 20, 20), (3, 1, 1, 30, 20, 10, -1), (4, 3, 3, 40, 20, 10, 30), (5, 2, 2, 60, 20, 10, 10)]
    with pytest.raises(ValueError, match="over"):
        relation(rows, spark).select(c.rank()).compile()
