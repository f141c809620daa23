"""Queries over the supplied tables, one or more for each operator, with the SQL that gives the same rows.

A family of scalar functions is one query: a base relation with a key, and a list of (output name, expression,
SQL). Floats are rounded on both sides, since engines sum in different orders.
"""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import tessera as te
from tessera import Expr, Relation, col, lit, relation, t_col, when
from tessera.sources.storage import shared_folder
from tessera.streaming import read_stream, run_available

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> Relation:
    return relation(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, and its SQL where there is one."""

    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return add


def r6(e: Expr) -> Expr:
    return e.round(6)


def r6_signed(e: Expr) -> Expr:
    """r6 for floats whose zeros have a sign, which DuckDB's round keeps and Spark's drops."""
    out = r6(e)
    return when((out == 0) & e.cast("string").starts_with("-")).then(-out).otherwise(out)


# ---- bases: a relation and the SQL of the same rows


def orders_base(spark: SparkSession, sf_dir: str) -> Relation:
    o = read(spark, sf_dir, "orders")
    n = col("o_orderkey").modulo(7).subtract(3)
    return o.select(
        col("o_orderkey").alias("k"),
        n.alias("n"),
        col("o_custkey").modulo(5).subtract(2).alias("m"),
        (col("o_totalprice") / 1000).alias("x"),
        when(n == 0).then(None).otherwise(col("o_totalprice")).alias("z"),
        when(n == 1).then(lit(float("nan"))).when(n == 2).then(lit(float("inf"))).otherwise(col("o_totalprice")).alias("f"),
        col("o_orderdate").alias("t"),
        col("o_orderpriority").alias("p"),
        when(n == -1).then(None).otherwise(n > 0).alias("b"),
        (col("o_orderkey").modulo(2) == 0).alias("c"),
    )


ORDERS = """(SELECT o_orderkey AS k, ((o_orderkey % 7) + 7) % 7 - 3 AS n, o_custkey % 5 - 2 AS m, o_totalprice / 1000 AS x,
  CASE WHEN o_orderkey % 7 = 3 THEN NULL ELSE o_totalprice END AS z,
  CASE WHEN o_orderkey % 7 = 4 THEN 'nan'::DOUBLE WHEN o_orderkey % 7 = 5 THEN 'inf'::DOUBLE ELSE o_totalprice END AS f,
  o_orderdate AS t, o_orderpriority AS p, CASE WHEN o_orderkey % 7 = 2 THEN NULL ELSE o_orderkey % 7 > 3 END AS b, o_orderkey % 2 = 0 AS c FROM orders)"""


def parts_base(spark: SparkSession, sf_dir: str) -> Relation:
    p = read(spark, sf_dir, "part")
    return p.select(col("p_partkey").alias("k"), col("p_name").alias("s"), col("p_type").alias("u"), col("p_brand").alias("b"), when(col("p_partkey").modulo(5) == 0).then(None).otherwise(col("p_type")).alias("v"))


PARTS = "(SELECT p_partkey AS k, p_name AS s, p_type AS u, p_brand AS b, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_type END AS v FROM part)"


def events_base(spark: SparkSession, sf_dir: str) -> Relation:
    return read(spark, sf_dir, "events").select(col("event_id").alias("k"), col("ts").alias("t"), col("user_id").alias("u"), col("ts").add_days(col("user_id").modulo(400).cast("i32")).alias("o"))


EVENTS = "(SELECT event_id AS k, ts AS t, user_id AS u, ts + to_days((user_id % 400)::INTEGER) AS o FROM events)"


def scores_base(spark: SparkSession, sf_dir: str) -> Relation:
    """Balances of which some are NULL and some a sentinel."""
    c = read(spark, sf_dir, "customer")
    key = col("c_custkey")
    return c.select(
        key.alias("k"),
        when(key.modulo(5) == 0).then(None).when(key.modulo(7) == 0).then(-99999.0).otherwise(col("c_acctbal")).alias("a"),
        when(key.modulo(3) == 0).then(None).otherwise(col("c_acctbal") + (key.modulo(3) - 1) * 10).alias("b"),
        when(key.modulo(11) == 0).then(None).otherwise(col("c_mktsegment")).alias("s"),
        when(key.modulo(4) == 0).then(None).otherwise(key.modulo(2) == 0).alias("q"),
    )


SCORES = """(SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN -99999.0 ELSE c_acctbal END AS a,
  CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal + (c_custkey % 3 - 1) * 10 END AS b, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_mktsegment END AS s,
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_custkey % 2 = 0 END AS q FROM customer)"""


def family(name: str, base: Callable, source: str, rows: list[tuple[str, Expr, str]]) -> None:
    """One query with a column for each function."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return base(spark, sf_dir).select(col("k"), *[e().alias(n) for n, e, _ in rows]).compile()

    QUERIES[name] = run
    SQL[name] = f"SELECT k, {', '.join(f'{s} AS {n}' for n, _, s in rows)} FROM {source}"


family("fn_comparison", orders_base, ORDERS, [
    ("eq", lambda: col("n").eq(col("m")), "n = m"),
    ("ne", lambda: col("n").ne(col("m")), "n <> m"),
    ("gt", lambda: col("z").gt(150000), "z > 150000"),
    ("lt", lambda: col("z") < 150000, "z < 150000"),
    ("ge", lambda: col("n").ge(col("m")), "n >= m"),
    ("le", lambda: col("n").lte(col("m")), "n <= m"),
    ("between_both", lambda: col("n").between(-1, 1), "n >= -1 AND n <= 1"),
    ("between_left", lambda: col("n").is_between(-1, 1, closed="left"), "n >= -1 AND n < 1"),
    ("between_right", lambda: col("n").between(-1, 1, closed="right"), "n > -1 AND n <= 1"),
    ("between_none", lambda: col("n").between(-1, 1, closed="none"), "n > -1 AND n < 1"),
    ("eq_missing", lambda: col("z").eq_missing(None), "z IS NOT DISTINCT FROM NULL"),
    ("ne_missing", lambda: col("b").ne_missing(col("c")), "b IS DISTINCT FROM c"),
    ("is_close", lambda: col("x").is_close(100, abs_tol=5, rel_tol=0.1), "abs(x - 100) <= 5 + 0.1 * 100"),
    ("clip", lambda: col("z").clip(50000, 200000), "CASE WHEN z < 50000 THEN 50000 WHEN z > 200000 THEN 200000 ELSE z END"),
])
family("fn_null_predicates", orders_base, ORDERS, [
    ("is_null", lambda: col("z").is_null(), "z IS NULL"),
    ("is_not_null", lambda: col("z").is_not_null(), "z IS NOT NULL"),
    ("is_nan", lambda: col("f").is_nan(), "isnan(f)"),
    ("is_not_nan", lambda: col("f").is_not_nan(), "NOT isnan(f)"),
    ("is_finite", lambda: col("f").is_finite(), "isfinite(f)"),
    ("is_infinite", lambda: col("f").is_infinite(), "isinf(f)"),
    ("is_true", lambda: col("b").is_true(), "b = TRUE"),
    ("is_not_true", lambda: col("b").is_not_true(), "b IS NOT TRUE"),
    ("is_false", lambda: col("b").is_false(), "b = FALSE"),
    ("is_not_false", lambda: col("b").is_not_false(), "b IS NOT FALSE"),
    ("coalesced", lambda: te.coalesce(col("z"), col("x")), "coalesce(z, x)"),
    ("coalesced_method", lambda: col("z").coalesce(-1.0), "coalesce(z, -1.0)"),
    ("largest", lambda: te.greatest(col("n"), col("m"), lit(0)), "greatest(n, m, 0)"),
    ("smallest", lambda: te.least(col("n"), col("m"), lit(0)), "least(n, m, 0)"),
    ("largest_skip_null", lambda: col("z").greatest_skip_null(col("x")), "greatest(z, x)"),
    ("smallest_skip_null", lambda: col("z").least_skip_null(col("x")), "least(z, x)"),
    ("null_if", lambda: col("n").null_if(col("m")), "nullif(n, m)"),
    ("nullif", lambda: col("n").nullif(0), "nullif(n, 0)"),
    ("fill_null", lambda: col("z").fill_null(0.0), "coalesce(z, 0)"),
    ("fill_nan", lambda: col("f").fill_nan(0), "CASE WHEN isnan(f) THEN 0 ELSE f END"),
])
family("fn_boolean", orders_base, ORDERS, [
    ("and_", lambda: col("b") & col("c"), "b AND c"),
    ("or_", lambda: col("b").or_(col("c"), col("n") == 3), "b OR c OR n = 3"),
    ("not_", lambda: ~col("b"), "NOT b"),
    ("xor_", lambda: col("b") ^ col("c"), "b <> c"),
    ("and_not", lambda: col("b").and_not(col("c")), "b AND NOT c"),
    ("xor_parity", lambda: col("b").xor_parity(col("c"), col("n") > 1), "(b <> c) <> (n > 1)"),
    ("and_empty", lambda: col("b").and_(), "b"),
    ("always_true", lambda: col("b").always_true(), "TRUE"),
    ("always_false", lambda: col("b").always_false(), "FALSE"),
])
family("fn_arithmetic", orders_base, ORDERS, [
    ("added", lambda: col("n") + col("m"), "n + m"),
    ("subtracted", lambda: col("n") - col("m"), "n - m"),
    ("rsubtracted", lambda: 10 - col("n"), "10 - n"),
    ("multiplied", lambda: col("n") * col("m"), "n * m"),
    ("divided", lambda: r6_signed(col("n") / col("m")), "CASE WHEN m = 0 THEN n * 'inf'::DOUBLE ELSE round(n::DOUBLE / m, 6) END"),
    ("rdivided", lambda: r6(1 / (col("x") + 1)), "round(1 / (x + 1), 6)"),
    ("modulo", lambda: col("n") % (col("m") * 2 + 1), "((n % (m * 2 + 1)) + (m * 2 + 1)) % (m * 2 + 1)"),
    ("rmodulo", lambda: 17 % (col("m") * 2 + 1), "((17 % (m * 2 + 1)) + (m * 2 + 1)) % (m * 2 + 1)"),
    ("modulo_zero", lambda: col("n").modulus(col("m")), "CASE WHEN m = 0 THEN NULL ELSE ((n % m) + m) % m END"),
    ("floor_divided", lambda: col("n") // (col("m") * 2 + 1), "floor(n / (m * 2 + 1))::BIGINT"),
    ("rfloor_divided", lambda: 17 // (col("m") * 2 + 1), "floor(17 / (m * 2 + 1))::BIGINT"),
    ("powered", lambda: col("n") ** 3, "pow(n, 3)"),
    ("rpowered", lambda: 2 ** col("n"), "pow(2, n)"),
    ("negated", lambda: -col("n"), "-n"),
    ("absolute", lambda: col("n").abs(), "abs(n)"),
    ("signed", lambda: col("n").sign(), "sign(n)::DOUBLE"),
    ("ceiled", lambda: col("x").ceil(), "ceil(x)::BIGINT"),
    ("floored", lambda: col("x").floor(), "floor(x)::BIGINT"),
    ("rounded", lambda: col("x").round(1), "round(x, 1)"),
    ("factorial", lambda: col("m").add(2).cast("i32").factorial(), "factorial((m + 2)::INTEGER)::BIGINT"),
    ("bit_and", lambda: col("n").bitwise_and(5), "n & 5"),
    ("bit_or", lambda: col("n").bitwise_or(4), "n | 4"),
    ("bit_xor", lambda: col("n").bitwise_xor(col("m")), "xor(n, m)"),
    ("bit_not", lambda: col("n").bitwise_not(), "~n"),
    ("shifted", lambda: col("k").shift_left(2).shift_right(1), "(k << 2) >> 1"),
])
family("fn_math", orders_base, ORDERS, [
    ("sqrt_", lambda: r6(col("x").sqrt()), "round(sqrt(x), 6)"),
    ("exp_", lambda: r6((col("x") / 1000).exp()), "round(exp(x / 1000), 6)"),
    *[(f"{f}_", lambda f=f: r6(getattr(col("x"), f)()), f"round({f}(x), 6)") for f in ("sin", "cos", "tan", "atan", "radians", "degrees")],
    *[(f"{f}_", lambda f=f: r6(getattr(col("n") / 3, f)()), f"round({f}(n / 3), 6)") for f in ("asin", "acos", "sinh", "cosh", "tanh", "asinh")],
    ("acosh_", lambda: r6((col("x") + 1).acosh()), "round(acosh(x + 1), 6)"),
    ("atanh_", lambda: r6((col("n") / 4).atanh()), "round(atanh(n / 4), 6)"),
    ("atan2_", lambda: r6(col("n").atan2(col("m"))), "round(atan2(n, m), 6)"),
    ("ln_", lambda: col("n").ln().round(6), "CASE WHEN n = 0 THEN '-inf'::DOUBLE WHEN n < 0 THEN 'nan'::DOUBLE ELSE round(ln(greatest(n, 1)), 6) END"),
    ("log10_", lambda: r6(col("x").log10()), "round(log10(x), 6)"),
    ("log2_", lambda: r6(col("x").log2()), "round(log2(x), 6)"),
    ("log_", lambda: r6(col("x").log(3)), "round(ln(x) / ln(3), 6)"),
    ("log1p_", lambda: r6(col("x").log1p()), "round(ln(1 + x), 6)"),
])
family("fn_string_case_trim", parts_base, PARTS, [
    ("upper_", lambda: col("s").str.upper(), "upper(s)"),
    ("lower_", lambda: col("u").lower(), "lower(u)"),
    ("swapped", lambda: col("s").str.swapcase(), "translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ')"),
    ("capitalized", lambda: col("u").str.capitalize(), "upper(u[1]) || lower(u[2:])"),
    ("titled", lambda: col("s").title(), "array_to_string(list_transform(string_split(lower(s), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"),
    ("initcapped", lambda: col("u").initcap(), "array_to_string(list_transform(string_split(lower(u), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"),
    ("trimmed", lambda: lit("  ").concat(col("s"), lit(" \t")).str.trim(), "trim(s, ' \t')"),
    ("ltrimmed", lambda: lit("xx").concat(col("s")).ltrim("x"), "ltrim('xx' || s, 'x')"),
    ("rtrimmed", lambda: col("s").concat("  ").strip_chars_end(), "rtrim(s)"),
    ("lpadded", lambda: col("b").lpad(12, "*"), "CASE WHEN length(b) >= 12 THEN b ELSE lpad(b, 12, '*') END"),
    ("lpad_short", lambda: col("b").str.lpad(3), "CASE WHEN length(b) >= 3 THEN b ELSE lpad(b, 3, ' ') END"),
    ("rpadded", lambda: col("b").rpad(12, "ab"), "CASE WHEN length(b) >= 12 THEN b ELSE rpad(b, 12, 'ab') END"),
    ("centered", lambda: col("b").center(13, "-"), "CASE WHEN length(b) >= 13 THEN b ELSE rpad(repeat('-', ((13 - length(b)) // 2 + CASE WHEN (13 - length(b)) % 2 = 1 THEN 1 ELSE 0 END)::INTEGER) || b, 13, '-') END"),
    ("no_prefix", lambda: col("b").strip_prefix("Brand#"), "CASE WHEN starts_with(b, 'Brand#') THEN b[7:] ELSE b END"),
    ("no_suffix", lambda: col("u").strip_suffix("STEEL"), "CASE WHEN ends_with(u, 'STEEL') THEN u[:length(u) - 5] ELSE u END"),
])
family("fn_string_parts", parts_base, PARTS, [
    ("substring_", lambda: col("s").substring(2, 5), "substring(s, 3, 5)"),
    ("substring_rest", lambda: col("s").str.slice(3), "substring(s, 4)"),
    ("substring_end", lambda: col("s").substring(-4, 3), "substring(s, -4, 3)"),
    ("left_", lambda: col("s").str.left(4), "left(s, 4)"),
    ("right_", lambda: col("s").right(4), "right(s, 4)"),
    ("sliced", lambda: col("s").replace_slice(2, 3, "__"), "s[1:1] || '__' || s[5:]"),
    ("chars", lambda: col("s").char_length(), "length(s)"),
    ("bits", lambda: col("s").bit_length(), "bit_length(s)"),
    ("octets", lambda: col("s").octet_length(), "strlen(s)"),
    ("concatenated", lambda: col("s").str.concat("-", col("v")), "s || '-' || v"),
    ("concat_ws_", lambda: col("s").concat_ws("|", col("v"), lit("z")), "concat_ws('|', s, v, 'z')"),
    ("repeated", lambda: col("b").repeat(2), "repeat(b, 2)"),
    ("reversed_", lambda: col("s").reverse(), "reverse(s)"),
    ("replaced", lambda: col("s").str.replace("e", "EE"), "replace(s, 'e', 'EE')"),
    ("replaced_any_case", lambda: col("u").replace("steel", "x", case_sensitive=False), "regexp_replace(u, 'steel', 'x', 'gi')"),
    ("split_at", lambda: col("s").string_split(" "), "string_split(s, ' ')"),
])
family("fn_string_search", parts_base, PARTS, [
    ("contains_", lambda: col("s").str.contains("a"), "contains(s, 'a')"),
    ("contains_any_case", lambda: col("u").contains("steel", case_sensitive=False), "contains(lower(u), 'steel')"),
    ("starts", lambda: col("u").starts_with("S"), "starts_with(u, 'S')"),
    ("ends", lambda: col("u").ends_with("L"), "ends_with(u, 'L')"),
    ("ends_any_case", lambda: col("u").str.ends_with("l", case_sensitive=False), "ends_with(lower(u), 'l')"),
    ("position_", lambda: col("s").strpos("e"), "strpos(s, 'e')"),
    ("counted", lambda: col("s").count_substring("e"), "((length(s) - length(replace(s, 'e', '')))::BIGINT)"),
    ("like_", lambda: col("u").like("%E_L%"), "u LIKE '%E_L%'"),
    ("ilike_", lambda: col("u").like("%e_l%", case_sensitive=False), "u ILIKE '%e_l%'"),
    ("regex_contains_", lambda: col("s").regex_contains("[aeiou]{2}"), "regexp_matches(s, '[aeiou]{2}')"),
    ("regex_any_case", lambda: col("u").regex_contains("st.*l", case_sensitive=False), "regexp_matches(u, '(?i)st.*l')"),
    ("regex_whole", lambda: col("b").regex_match("Brand#1.|x"), "regexp_full_match(b, 'Brand#1.|x')"),
    ("matched", lambda: col("b").regexp_match_substring("[0-9]+"), "nullif(regexp_extract(b, '[0-9]+'), '')"),
    ("matched_group", lambda: col("b").regexp_match_substring("([0-9])([0-9])", group=2), "nullif(regexp_extract(b, '([0-9])([0-9])', 2), '')"),
    ("matched_all", lambda: col("s").regexp_match_substring_all("[aeiou]"), "regexp_extract_all(s, '[aeiou]')"),
    ("regex_count", lambda: col("s").regexp_count_substring("[aeiou]").cast("i64"), "len(regexp_extract_all(s, '[aeiou]'))"),
    ("regex_replaced", lambda: col("s").regexp_replace("[aeiou]+", "*"), "regexp_replace(s, '[aeiou]+', '*', 'g')"),
    ("regex_replaced_first", lambda: col("s").regexp_replace("[aeiou]+", "*", occurrence=1), "regexp_replace(s, '[aeiou]+', '*')"),
    ("regex_split", lambda: col("s").regexp_string_split("[aeiou]"), "regexp_split_to_array(s, '[aeiou]')"),
])
family("fn_set_membership", parts_base, PARTS, [
    ("is_in_", lambda: col("b").is_in("Brand#11", "Brand#12"), "b IN ('Brand#11', 'Brand#12')"),
    ("is_not_in_", lambda: col("v").is_not_in(["STEEL", "BRASS"]), "v NOT IN ('STEEL', 'BRASS')"),
    ("is_in_empty", lambda: col("b").is_in([]), "FALSE"),
    ("index_in_", lambda: col("k").modulo(4).index_in(3, 1, 0), "CASE k % 4 WHEN 3 THEN 0 WHEN 1 THEN 1 WHEN 0 THEN 2 ELSE -1 END"),
])
family("fn_cast_conditional", orders_base, ORDERS, [
    ("to_i32", lambda: col("n").cast("i32"), "n::INTEGER"),
    ("truncated", lambda: col("x").cast(int), "trunc(x)::BIGINT"),
    ("to_text", lambda: col("n").cast("string"), "n::VARCHAR"),
    ("to_float", lambda: col("n").cast("Float64"), "n::DOUBLE"),
    ("to_bool", lambda: col("n").cast("bool"), "n::BOOLEAN"),
    ("to_date", lambda: col("t").cast("date"), "t::DATE"),
    ("tried", lambda: col("p").cast("i64", failure_behavior="null"), "try_cast(p AS BIGINT)"),
    ("to_u8", lambda: col("k").modulo(300).cast("u8", failure_behavior="null").cast("i32"), "CASE WHEN k % 300 <= 255 THEN (k % 300)::INTEGER END"),
    ("graded", lambda: when(col("x") > 200).then("high").when(col("x") > 100).then("middle").otherwise("low"), "CASE WHEN x > 200 THEN 'high' WHEN x > 100 THEN 'middle' ELSE 'low' END"),
    ("nested", lambda: when(col("b")).then(col("n")).otherwise(-col("n")), "CASE WHEN b THEN n ELSE -n END"),
    ("from_native", lambda: te.native(F.col("n") + 1), "n + 1"),
])
family("fn_date_parts", events_base, EVENTS, [
    *[(f"{n}_", lambda n=n: getattr(col("t").dt, n)(), f"{f}(t)") for n, f in (("year", "year"), ("month", "month"), ("day", "day"), ("hour", "hour"), ("minute", "minute"), ("second", "second"), ("quarter", "quarter"), ("day_of_year", "dayofyear"), ("day_of_week", "isodow"), ("week_of_year", "week"), ("iso_year", "isoyear"))],
    ("millisecond_", lambda: col("t").millisecond(), "(microsecond(t) // 1000) % 1000"),
    ("microsecond_", lambda: col("t").microsecond(), "microsecond(t) % 1000000"),
    ("nanosecond_", lambda: col("t").nanosecond(), "(microsecond(t) % 1000000) * 1000"),
    ("unix", lambda: col("t").unix_timestamp(), "epoch_us(t) // 1000000"),
    ("offset_", lambda: col("t").timezone_offset(), "0"),
    ("leap", lambda: col("o").is_leap_year(), "(year(o) % 4 = 0 AND year(o) % 100 <> 0) OR year(o) % 400 = 0"),
    ("no_dst", lambda: col("t").is_dst(), "FALSE"),
    ("extracted", lambda: col("t").dt.extract("MONTH"), "month(t)"),
    ("date_", lambda: col("t").date(), "t::DATE"),
    ("time_", lambda: col("t").time(), "strftime(t, '%H:%M:%S.%f')"),
    ("first_day", lambda: col("t").month_start(), "date_trunc('month', t)::TIMESTAMP"),
    ("last_day", lambda: col("t").month_end(), "t + to_days((day(last_day(t)) - day(t))::INTEGER)"),
    ("days", lambda: col("t").days_in_month(), "day(last_day(t))"),
])
family("fn_date_shift", events_base, EVENTS, [
    ("years", lambda: col("t").add_years(1), "t + INTERVAL 1 YEAR"),
    ("months", lambda: col("t").add_months(-2), "t - INTERVAL 2 MONTH"),
    ("months_column", lambda: col("t").add_months(col("u").modulo(5).cast("i32")), "t + to_months((u % 5)::INTEGER)"),
    ("days", lambda: col("t").add_days(10), "t + INTERVAL 10 DAY"),
    ("hours", lambda: col("t").add_hours(5), "t + INTERVAL 5 HOUR"),
    ("minutes", lambda: col("t").add_minutes(-90), "t - INTERVAL 90 MINUTE"),
    ("seconds", lambda: col("t").add_seconds(61), "t + INTERVAL 61 SECOND"),
    ("milliseconds", lambda: col("t").add_milliseconds(1500), "t + INTERVAL 1500 MILLISECOND"),
    ("microseconds", lambda: col("t").add_microseconds(7), "t + INTERVAL 7 MICROSECOND"),
    ("combined", lambda: col("t").offset_by("1d2h30m"), "t + INTERVAL 1 DAY + INTERVAL 2 HOUR + INTERVAL 30 MINUTE"),
    ("back", lambda: col("t").offset_by("-1mo2d"), "t - INTERVAL 1 MONTH - INTERVAL 2 DAY"),
    ("diff_years_", lambda: col("o").diff_years(col("t")), "date_diff('year', t, o)"),
    ("diff_months_", lambda: col("o").diff_months(col("t")), "date_diff('month', t, o)"),
    ("diff_days_", lambda: col("o").diff_days(lit(datetime.datetime(2024, 1, 1))), "date_sub('day', TIMESTAMP '2024-01-01', o)"),
    ("diff_hours_", lambda: col("o").diff_hours(col("t")), "date_sub('hour', t, o)"),
    ("diff_minutes_", lambda: col("o").diff_minutes(col("t")), "date_sub('minute', t, o)"),
    ("diff_seconds_", lambda: col("o").diff_seconds(col("t")), "date_sub('second', t, o)"),
    ("diff_milliseconds_", lambda: col("o").diff_milliseconds(col("t")), "date_sub('millisecond', t, o)"),
])
family("fn_date_round", events_base, EVENTS, [
    *[(f"trunc_{u}", lambda u=u: col("t").truncate(u), f"date_trunc('{u}', t)::TIMESTAMP") for u in ("year", "quarter", "month", "week", "day", "hour", "minute", "second")],
    ("trunc_15m", lambda: col("t").truncate("15m"), "time_bucket(INTERVAL 15 MINUTE, t, TIMESTAMP '1970-01-01')"),
    ("trunc_2mo", lambda: col("t").dt.floor("2mo"), "time_bucket(INTERVAL 2 MONTH, t, TIMESTAMP '1970-01-01')"),
    ("ceil_hour", lambda: col("t").dt.ceil("1h"), "CASE WHEN date_trunc('hour', t) = t THEN t ELSE date_trunc('hour', t) + INTERVAL 1 HOUR END"),
    ("round_day", lambda: col("t").dt.round("1d"), "(date_trunc('day', t + INTERVAL 12 HOUR))::TIMESTAMP"),
    ("formatted", lambda: col("t").strftime("%Y/%m/%d at %H:%M"), "strftime(t, '%Y/%m/%d at %H:%M')"),
    ("weekday_name", lambda: col("t").strftime("%a %d %b"), "strftime(t, '%a %d %b')"),
    ("parsed", lambda: col("t").strftime("%Y-%m-%d").strptime_date("%Y-%m-%d"), "t::DATE"),
    ("parsed_timestamp", lambda: col("t").strftime("%Y-%m-%d %H:%M:%S").strptime_timestamp("%Y-%m-%d %H:%M:%S"), "date_trunc('second', t)::TIMESTAMP"),
    ("zone_minus_5", lambda: col("t").to_timezone("Etc/GMT+5"), "t - INTERVAL 5 HOUR"),
    ("from_zone_plus_2", lambda: col("t").assume_timezone("Etc/GMT-2"), "t - INTERVAL 2 HOUR"),
])


def _t(sql: str, unknown: str) -> str:
    return f"CASE WHEN {unknown} THEN 0 WHEN {sql} THEN 1 ELSE -1 END"


def raw(make: Callable[[], Expr]) -> Callable[[], Expr]:
    """Three-valued results as -1, 0, 1."""
    return lambda: te.native(make().compile(booleanizer=None))


_A = lambda: t_col("a", unknown={None, -99999.0})
_AU, _BU = "(a IS NULL OR a = -99999)", "b IS NULL"
family("ternary_compare", scores_base, SCORES, [
    *[(f"t_{n}_", raw(lambda n=n: getattr(_A(), f"t_{n}")(col("b"))), _t(f"a {s} b", f"{_AU} OR {_BU}")) for n, s in (("eq", "="), ("ne", "<>"), ("gt", ">"), ("lt", "<"), ("ge", ">="), ("le", "<="))],
    ("plain_null", raw(lambda: t_col("a").t_gt(0)), _t("a > 0", "a IS NULL")),
    ("sentinel_only", raw(lambda: t_col("a", unknown={-99999.0}).t_gt(0)), _t("a > 0", "a = -99999")),
    ("text", raw(lambda: t_col("s", unknown={"MACHINERY", None}).t_eq("BUILDING")), _t("s = 'BUILDING'", "s IS NULL OR s = 'MACHINERY'")),
    ("in_list", raw(lambda: t_col("s").t_is_in(["BUILDING", "AUTOMOBILE"])), _t("s IN ('BUILDING', 'AUTOMOBILE')", "s IS NULL")),
    ("not_in_list", raw(lambda: t_col("s").t_is_not_in(["BUILDING"])), _t("s NOT IN ('BUILDING')", "s IS NULL")),
    ("of_boolean", raw(lambda: col("q").to_ternary()), "CASE WHEN q THEN 1 ELSE -1 END"),
])
_P, _Q, _R = (lambda: _A().t_gt(0)), (lambda: t_col("b").t_gt(1000)), (lambda: t_col("s").t_eq("BUILDING"))
_SP, _SQ, _SR = _t("a > 0", _AU), _t("b > 1000", _BU), _t("s = 'BUILDING'", "s IS NULL")
_TERNARY = f"(SELECT k, q, {_SP} AS p1, {_SQ} AS p2, {_SR} AS p3 FROM {SCORES})"
family("ternary_logic", scores_base, _TERNARY, [
    ("t_and_", raw(lambda: _P().t_and(_Q(), _R())), "least(p1, p2, p3)"),
    ("t_or_", raw(lambda: _P().t_or(_Q(), _R())), "greatest(p1, p2, p3)"),
    ("t_not_", raw(lambda: _P().t_not()), "-p1"),
    ("t_xor_", raw(lambda: _P().t_xor(_Q(), _R())), "CASE WHEN 0 IN (p1, p2, p3) THEN 0 WHEN (p1 = 1)::INTEGER + (p2 = 1)::INTEGER + (p3 = 1)::INTEGER = 1 THEN 1 ELSE -1 END"),
    ("t_xor_parity_", raw(lambda: _P().t_xor_parity(_Q(), _R())), "CASE WHEN 0 IN (p1, p2, p3) THEN 0 WHEN ((p1 = 1)::INTEGER + (p2 = 1)::INTEGER + (p3 = 1)::INTEGER) % 2 = 1 THEN 1 ELSE -1 END"),
    ("with_boolean", raw(lambda: _P().t_and(col("q"))), "least(p1, CASE WHEN q THEN 1 ELSE -1 END)"),
    ("boolean_with", lambda: col("q").and_(_P()), "q AND p1 = 1"),
    ("constants", raw(lambda: te.always_true().t_and(te.always_unknown()).t_or(te.always_false())), "0"),
])
family("ternary_booleanizers", scores_base, _TERNARY, [
    ("is_true_", lambda: _P().is_true(), "p1 = 1"),
    ("is_false_", lambda: _P().is_false(), "p1 = -1"),
    ("is_unknown_", lambda: _P().is_unknown(), "p1 = 0"),
    ("is_known_", lambda: _P().is_known(), "p1 <> 0"),
    ("maybe_true_", lambda: _P().maybe_true(), "p1 >= 0"),
    ("maybe_false_", lambda: _P().maybe_false(), "p1 <= 0"),
    ("by_default", _P, "p1 = 1"),
    ("by_name", lambda: te.native(_P().compile(booleanizer="maybe_true")), "p1 >= 0"),
])


# ---- relations


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
  round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_quantity), 4) AS avg_qty, count(*) AS count_order
  FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2 ORDER BY 1, 2""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = col("l_extendedprice")
    return (
        read(spark, sf_dir, "lineitem")
        .filter(col("l_shipdate") <= lit(datetime.datetime(1998, 9, 2)))
        .group_by("l_returnflag", "l_linestatus")
        .agg(
            col("l_quantity").sum().round(2).alias("sum_qty"),
            price.sum().round(2).alias("sum_base_price"),
            (price * (1 - col("l_discount"))).sum().round(2).alias("sum_disc_price"),
            col("l_quantity").avg().round(4).alias("avg_qty"),
            te.count_records().alias("count_order"),
        )
        .sort("l_returnflag", "l_linestatus")
        .compile()
    )


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.03 AND 0.05 AND l_quantity < 24 AND l_returnflag <> 'N'")
def filter_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").filter(col("l_discount").between(0.03, 0.05), col("l_quantity") < 24, col("l_returnflag") != "N")
    return rows.select("l_orderkey", "l_linenumber", (col("l_extendedprice") * (1 - col("l_discount"))).round(4).alias("revenue")).compile()


@query("SELECT c_custkey, c_name AS customer, c_acctbal * 2 AS c_acctbal, c_acctbal > 0 AS positive, c_acctbal + 1 AS more FROM customer")
def projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").with_columns((col("c_acctbal") * 2).alias("c_acctbal"), (col("c_acctbal") > 0).alias("positive"), more=col("c_acctbal") + 1)
    return c.drop("c_nationkey", "c_mktsegment").rename({"c_name": "customer"}).compile()


@query('SELECT n_nationkey AS id_n_nationkey, n_name AS n_name_right, n_regionkey AS "N_REGIONKEY", upper(n_name) AS n_name FROM nation')
def name_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").select(col("n_nationkey").name.prefix("id_"), col("n_name").name.suffix("_right"), col("n_regionkey").name.name_to_upper(), col("n_name").upper().name.name_to_lower()).compile()


@query(f"SELECT k FROM {SCORES} WHERE a > 0 AND a <> -99999 AND b IS NOT NULL AND b > 1000")
def ternary_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores_base(spark, sf_dir).filter(_P().t_and(_Q())).select("k").compile()


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 0 WHEN list_contains(string_split(text, ' '), lang) THEN 1 ELSE -1 END AS found FROM documents")
def ternary_list_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").with_columns(when(col("doc_id").modulo(3) == 0).then(None).otherwise(col("text").string_split(" ")).alias("listed"))
    return docs.select("doc_id", te.native(t_col("lang").t_is_in(col("listed")).compile(booleanizer=None)).alias("found")).compile()


def _join(how: str, on: str) -> None:
    @query(on)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = read(spark, sf_dir, "customer").filter(col("c_acctbal") > 0).select(col("c_custkey").alias("key"), "c_name", col("c_nationkey").alias("tag"))
        o = read(spark, sf_dir, "orders").filter(col("o_orderstatus") != "F").select(col("o_custkey").alias("key"), "o_orderkey", col("o_orderstatus").alias("tag"))
        return c.join(o, on="key", how=how).compile()

    QUERIES[f"join_{how}"] = QUERIES.pop("run")
    SQL[f"join_{how}"] = SQL.pop("run")


_C = "(SELECT c_custkey AS key, c_name, c_nationkey AS tag FROM customer WHERE c_acctbal > 0) c"
_O = "(SELECT o_custkey AS key, o_orderkey, o_orderstatus AS tag FROM orders WHERE o_orderstatus <> 'F') o"
_join("inner", f"SELECT c.key, c_name, c.tag, o_orderkey, o.tag AS tag_right FROM {_C} JOIN {_O} ON c.key = o.key")
_join("left", f"SELECT c.key, c_name, c.tag, o_orderkey, o.tag AS tag_right FROM {_C} LEFT JOIN {_O} ON c.key = o.key")
_join("right", f"SELECT o.key, c_name, c.tag, o_orderkey, o.tag AS tag_right FROM {_C} RIGHT JOIN {_O} ON c.key = o.key")
_join("outer", f"SELECT c.key, c_name, c.tag, o.key AS key_right, o_orderkey, o.tag AS tag_right FROM {_C} FULL JOIN {_O} ON c.key = o.key")
_join("semi", f"SELECT key, c_name, tag FROM {_C} WHERE EXISTS (SELECT 1 FROM {_O} WHERE c.key = o.key)")
_join("anti", f"SELECT key, c_name, tag FROM {_C} WHERE NOT EXISTS (SELECT 1 FROM {_O} WHERE c.key = o.key)")


@query("SELECT n_name, n_regionkey, r_name, r_regionkey FROM nation CROSS JOIN region")
def join_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").select("n_name", "n_regionkey").join(read(spark, sf_dir, "region"), how="cross").compile()


@query("""SELECT r_name, n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def join_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), left_on="o_custkey", right_on="c_custkey")
    n = o.join(read(spark, sf_dir, "nation"), left_on="c_nationkey", right_on="n_nationkey").join(read(spark, sf_dir, "region"), left_on="n_regionkey", right_on="r_regionkey")
    return n.group_by("r_name", "n_name").agg(te.count_records().alias("n_orders"), col("o_totalprice").sum().round(2).alias("total")).compile()


def _asof(spark: SparkSession, sf_dir: str, strategy: str, by: str | None, tolerance: float | None = None) -> DataFrame:
    """Purchases with the nearest click; clicks are made unique in time."""
    e = read(spark, sf_dir, "events")
    left = e.filter(col("event_type") == "purchase").select("event_id", "ts", "user_id")
    clicks = e.filter(col("event_type") == "click").group_by("user_id", "ts").agg(col("event_id").min().alias("click_id")) if by else e.filter(col("event_type") == "click").group_by("ts").agg(col("event_id").min().alias("click_id"))
    return left.join_asof(clicks, on="ts", by=by, strategy=strategy, tolerance=tolerance).compile()


_LEFT = "(SELECT event_id, ts, user_id FROM events WHERE event_type = 'purchase') l"
_RIGHT_BY = "(SELECT user_id, ts, min(event_id) AS click_id FROM events WHERE event_type = 'click' GROUP BY 1, 2) r"
_RIGHT = "(SELECT ts, min(event_id) AS click_id FROM events WHERE event_type = 'click' GROUP BY 1) r"


@query(f"SELECT l.event_id, l.ts, l.user_id, r.click_id FROM {_LEFT} ASOF LEFT JOIN {_RIGHT_BY} ON l.user_id = r.user_id AND l.ts >= r.ts")
def join_asof_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asof(spark, sf_dir, "backward", "user_id")


@query(f"SELECT l.event_id, l.ts, l.user_id, r.click_id FROM {_LEFT} ASOF LEFT JOIN {_RIGHT} ON l.ts <= r.ts")
def join_asof_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asof(spark, sf_dir, "forward", None)


@query(f"""SELECT l.event_id, l.ts, l.user_id, CASE WHEN b.click_id IS NULL THEN f.click_id WHEN f.click_id IS NULL THEN b.click_id
  WHEN f.ts - l.ts < l.ts - b.ts THEN f.click_id ELSE b.click_id END AS click_id
  FROM {_LEFT} ASOF LEFT JOIN {_RIGHT[:-1]}b ON l.ts >= b.ts ASOF LEFT JOIN {_RIGHT[:-1]}f ON l.ts <= f.ts""")
def join_asof_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asof(spark, sf_dir, "nearest", None)


@query(f"SELECT l.event_id, l.ts, l.user_id, CASE WHEN l.ts - r.ts <= INTERVAL 1 HOUR THEN r.click_id END AS click_id FROM {_LEFT} ASOF LEFT JOIN {_RIGHT} ON l.ts >= r.ts")
def join_asof_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asof(spark, sf_dir, "backward", None, 3600e6)


@query("""SELECT o_orderpriority, count(z) AS counted, count(*) AS records, round(sum(z), 2) AS summed, round(avg(z), 4) AS mean, min(z) AS least, max(z) AS most,
  round(stddev_samp(z), 4) AS sd, round(stddev_pop(z), 4) AS sd_pop, round(var_samp(z / 1000), 4) AS variance, round(var_pop(z / 1000), 4) AS variance_pop,
  round(product(1 + z / 1e9), 6) AS multiplied, round(corr(z, o_custkey), 6) AS correlation, round(median(z), 4) AS middle, round(quantile_cont(z, 0.9), 4) AS high,
  bool_and(z > 0) AS every, bool_or(z > 400000) AS some, count(DISTINCT o_custkey) AS customers
  FROM (SELECT *, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS z FROM orders) GROUP BY 1""")
def agg_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = col("z")
    o = read(spark, sf_dir, "orders").with_columns(when(col("o_orderkey").modulo(7) == 0).then(None).otherwise(col("o_totalprice")).alias("z"))
    return (
        o.group_by("o_orderpriority")
        .agg(
            z.count().alias("counted"), te.count_records().alias("records"), z.sum().round(2).alias("summed"), z.mean().round(4).alias("mean"), z.min().alias("least"), z.max().alias("most"),
            z.std_dev().round(4).alias("sd"), z.std_dev(distribution="POPULATION").round(4).alias("sd_pop"), (z / 1000).variance().round(4).alias("variance"), (z / 1000).variance(distribution="POPULATION").round(4).alias("variance_pop"),
            (1 + z / 1e9).product().round(6).alias("multiplied"), te.corr(z, col("o_custkey")).round(6).alias("correlation"), te.median(z).round(4).alias("middle"), te.quantile(z, 0.9).round(4).alias("high"),
            (z > 0).bool_and().alias("every"), (z > 400000).bool_or().alias("some"), col("o_custkey").count_distinct().alias("customers"),
        )
        .compile()
    )


@query("""SELECT n_regionkey, min(n_name) AS any_name, string_agg(n_name, '+' ORDER BY n_name) AS names,
  (SELECT mode(l_quantity) FROM (SELECT l_quantity FROM lineitem GROUP BY l_quantity ORDER BY count(*) DESC, l_quantity LIMIT 1)) AS usual FROM nation GROUP BY 1""")
def agg_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    usual = read(spark, sf_dir, "lineitem").agg(col("l_quantity").mode().alias("usual"))
    n = read(spark, sf_dir, "nation").sort("n_name")
    named = n.group_by("n_regionkey").agg(col("n_name").min().alias("any_name"), te.native(F.array_join(F.array_sort(F.collect_list("n_name")), "+")).alias("names"))
    return named.join(usual, how="cross").compile()


@query("SELECT count(*) AS records, round(sum(o_totalprice), 2) AS total, max(o_orderdate) AS latest FROM orders")
def agg_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").agg(te.count_records().alias("records"), col("o_totalprice").sum().round(2).alias("total"), col("o_orderdate").max().alias("latest")).compile()


@query("SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders")
def terminals(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    price = "o_totalprice"
    return relation([{"n": o.count_rows(), "total": round(o.sum(price), 2), "mean": round(o.avg(price), 4), "least": o.min(price), "most": o.max(price)}], spark).compile()


@query("SELECT year(o_orderdate) AS y, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2")
def group_by_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").group_by(col("o_orderdate").year().alias("y"), "o_orderstatus").agg(te.count_records().alias("n")).compile()


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def unique_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").unique(subset=["o_orderstatus", "o_orderpriority"]).select("o_orderstatus", "o_orderpriority").compile()


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def group_by_keys_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").group_by("o_orderstatus", "o_orderpriority").agg().compile()


@query("SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def unique_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").sort("o_orderdate", "o_orderkey").unique("o_custkey", keep="last").compile()


@query("""SELECT row_number() OVER (ORDER BY a DESC NULLS LAST, c_custkey) - 1 AS place, c_custkey, a
  FROM (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END AS a FROM customer)""")
def sort_nulls_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order itself is in the result, as positions."""
    c = read(spark, sf_dir, "customer").select("c_custkey", when(col("c_custkey").modulo(5) == 0).then(None).otherwise(col("c_acctbal")).alias("a"))
    return c.sort("a", "c_custkey", descending=[True, False]).with_row_index("place").compile()


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 25")
def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").top_k(25, by=["o_totalprice", "o_orderkey"]).compile()


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 100")
def slice_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey").sort("o_orderkey").slice(100, 20).compile()


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 15")
def tail_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey").sort("o_orderkey").tail(15).compile()


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS position, o_orderkey FROM orders")
def with_row_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey").sort("o_orderkey").with_row_index("position").compile()


@query("SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def set_union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select(col("c_custkey").alias("id"), col("c_name").alias("name"))
    return te.concat([c, read(spark, sf_dir, "supplier").select(col("s_suppkey").alias("id"), col("s_name").alias("name"))]).compile()


@query("SELECT c_nationkey AS n FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(col("c_nationkey").alias("n")).union_distinct(read(spark, sf_dir, "supplier").select(col("s_nationkey").alias("n"))).compile()


@query("SELECT c_custkey, a, s FROM (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END AS a, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS s FROM customer) WHERE a IS NOT NULL AND s IS NOT NULL")
def drop_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = col("c_custkey")
    return read(spark, sf_dir, "customer").select("c_custkey", when(key.modulo(5) == 0).then(None).otherwise(col("c_acctbal")).alias("a"), when(key.modulo(3) == 0).then(None).otherwise(col("c_mktsegment")).alias("s")).drop_nulls().compile()


@query("SELECT vec_id, round(sum(x::DOUBLE), 4) AS total, count(x) AS n FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) GROUP BY vec_id")
def explode_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", "embedding").explode("embedding").group_by("vec_id").agg(col("embedding").cast("fp64").sum().round(4).alias("total"), col("embedding").count().alias("n")).compile()


@query("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS a, unnest(list_reverse(string_split(p_name, ' '))) AS b FROM part")
def explode_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = col("p_name").string_split(" ")
    return read(spark, sf_dir, "part").select("p_partkey", split.alias("a"), split.reverse().alias("b")).explode("a", "b").compile()


@query("SELECT l_orderkey, l_linenumber, 'l_discount' AS kind, l_discount AS rate FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem")
def unpivot_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").unpivot(["l_discount", "l_tax"], ["l_orderkey", "l_linenumber"], "kind", "rate").compile()


@query("""SELECT l_returnflag, round(sum(l_quantity) FILTER (l_linestatus = 'F'), 2) AS "F", round(sum(l_quantity) FILTER (l_linestatus = 'O'), 2) AS "O" FROM lineitem GROUP BY 1""")
def pivot_(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = read(spark, sf_dir, "lineitem").pivot("l_linestatus", "l_returnflag", "l_quantity", "sum")
    return wide.select("l_returnflag", col("F").round(2).alias("F"), col("O").round(2).alias("O")).compile()


@query()
def sample_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").sample(n=100, seed=3).select("o_orderkey").compile()


_W = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"


@query(f"""SELECT o_orderkey, row_number() OVER ({_W}) AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS rk, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS dr,
  round(percent_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority), 6) AS pr, round(cume_dist() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority), 6) AS cd, ntile(4) OVER ({_W}) AS nt FROM orders""")
def window_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, by = col("o_orderkey"), ["o_orderdate", "o_orderkey"]
    return (
        read(spark, sf_dir, "orders")
        .select(
            "o_orderkey",
            k.row_number().over("o_custkey", order_by=by).alias("rn"),
            k.rank().over("o_custkey", order_by="o_orderpriority").alias("rk"),
            k.dense_rank().over("o_custkey", order_by="o_orderpriority").alias("dr"),
            k.percent_rank().over("o_custkey", order_by="o_orderpriority").round(6).alias("pr"),
            k.cume_dist().over("o_custkey", order_by="o_orderpriority").round(6).alias("cd"),
            k.ntile(4).over("o_custkey", order_by=by).alias("nt"),
        )
        .compile()
    )


_WHOLE = f"{_W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"


@query(f"""SELECT o_orderkey, lag(o_orderkey) OVER ({_W}) AS before, lead(o_orderkey, 2, -1) OVER ({_W}) AS after, first_value(o_orderkey) OVER ({_WHOLE}) AS first,
  last_value(o_orderkey) OVER ({_WHOLE}) AS last, nth_value(o_orderkey, 2) OVER ({_WHOLE}) AS second FROM orders""")
def window_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, w = col("o_orderkey"), {"order_by": ["o_orderdate", "o_orderkey"]}
    return (
        read(spark, sf_dir, "orders")
        .select(
            "o_orderkey",
            k.lag().over("o_custkey", **w).alias("before"),
            k.lead(2, -1).over("o_custkey", **w).alias("after"),
            k.first_value().over("o_custkey", **w).alias("first"),
            k.last_value().over("o_custkey", **w).alias("last"),
            k.nth_value(2).over("o_custkey", **w).alias("second"),
        )
        .compile()
    )


@query(f"""SELECT o_orderkey, round(sum(o_totalprice) OVER ({_W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS recent, round(avg(o_totalprice) OVER ({_W} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 4) AS around,
  round(sum(o_totalprice) OVER ({_W}), 2) AS running, round(max(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS most,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders""")
def window_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, by = col("o_totalprice"), ["o_orderdate", "o_orderkey"]
    return (
        read(spark, sf_dir, "orders")
        .select(
            "o_orderkey",
            x.sum().over("o_custkey", order_by=by, rows_between=(-2, 0)).round(2).alias("recent"),
            x.avg().over("o_custkey", order_by=by, rows_between=(-1, 1)).round(4).alias("around"),
            x.sum().over("o_custkey", order_by=by).round(2).alias("running"),
            x.max().over("o_custkey").round(2).alias("most"),
            x.row_number().over("o_custkey", order_by=["-o_totalprice", "o_orderkey"]).alias("place"),
        )
        .compile()
    )


@query("SELECT event_id FROM events WHERE ts > TIMESTAMP '1900-01-01' AND ts < now()::TIMESTAMP - INTERVAL 7 DAY")
def time_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = col("ts")
    return read(spark, sf_dir, "events").filter(ts.older_than("7 days"), ~ts.within_next("1h"), ts.between_last("100 years", "1 week") | ts.within_last("200 years")).select("event_id").compile()


# ---- schemas, packages, DAGs, Python data


@query("SELECT o_orderkey AS id, o_totalprice::VARCHAR AS price, trunc(o_totalprice)::BIGINT AS whole, o_orderdate::DATE AS day, coalesce(nullif(o_orderstatus, 'P'), '?') AS status FROM orders")
def conform_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").with_columns(col("o_orderstatus").null_if("P").alias("o_orderstatus"), col("o_totalprice").alias("w"))
    columns = {"id": {"cast": "integer", "rename_from": "o_orderkey"}, "price": {"cast": "string", "rename_from": "o_totalprice"}, "whole": {"cast": "integer", "rename_from": "w"}, "day": {"cast": "date", "rename_from": "o_orderdate"}, "status": {"rename_from": "o_orderstatus", "null_fill": "?"}}
    spec = te.conform(columns).spec
    spec.keep_only_mapped = True
    return te.conform(spec).apply(o)


@query("""SELECT c_custkey, replace(replace(c_name || ' & <co>', '&', '&amp;'), '<', '&lt;') AS escaped, CASE WHEN c_custkey % 2 = 0 THEN TRUE ELSE FALSE END AS flag, trunc(c_acctbal)::BIGINT AS whole FROM
  (SELECT * REPLACE (c_name AS c_name) FROM customer)""")
def custom_converters(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select("c_custkey", col("c_name").concat(" & <co").alias("escaped"), when(col("c_custkey").modulo(2) == 0).then("Yes").otherwise("no").alias("flag"), col("c_acctbal").alias("whole"))
    done = te.conform({"escaped": {"cast": "xml_string"}, "flag": {"cast": "rich_boolean"}, "whole": {"cast": "safe_int"}}).apply(c)
    return done.select("c_custkey", F.concat("escaped", F.lit(">")).alias("escaped"), "flag", "whole")


@query("SELECT n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY 1")
def dag_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    dag = te.RelationDAG()
    dag.add("customers", read(spark, sf_dir, "customer").filter(col("c_acctbal") > 0))
    dag.add("nations", read(spark, sf_dir, "nation"))
    dag.add("joined", dag.ref("customers").join(dag.ref("nations"), left_on="c_nationkey", right_on="n_nationkey"))
    dag.add("counts", dag.ref("joined").group_by("n_name").agg(te.count_records().alias("customers")))
    return dag.collect("counts")


@query("SELECT r_name, n_name, code FROM nation JOIN region ON n_regionkey = r_regionkey JOIN (VALUES (0, 'A'), (1, 'B')) v(region, code) ON region = r_regionkey")
def datapackage_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    package = te.DataPackage.from_descriptor(
        {
            "name": "places",
            "resources": [
                {"name": "nation", "path": f"{sf_dir}/nation.parquet", "format": "parquet"},
                {"name": "region", "path": f"{sf_dir}/region.parquet", "schema": {"fields": [{"name": "r_regionkey", "type": "integer"}, {"name": "r_name", "type": "string"}]}},
                {"name": "codes", "data": [{"region": 0, "code": "A"}, {"region": 1, "code": "B"}], "format": "json", "schema": {"fields": [{"name": "region", "type": "integer"}, {"name": "code"}], "foreignKeys": [{"fields": ["region"], "reference": {"resource": "region", "fields": ["r_regionkey"]}}]}},
            ],
        }
    )
    dag = package.to_relation_dag(spark=spark)
    nation = dag.ref("nation").join(dag.ref("region"), left_on="n_regionkey", right_on="r_regionkey")
    dag.add("out", nation.join(dag.ref("codes"), left_on="n_regionkey", right_on="region").select("r_name", "n_name", "code"))
    return dag.collect("out")


@query("SELECT r_regionkey AS key, r_name AS name, r_regionkey * 1.5::DOUBLE AS half FROM region")
def pydata_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "region").to_tuples()
    return relation({"key": [k for k, _ in rows], "name": [n for _, n in rows], "half": [k * 1.5 for k, _ in rows]}, spark).select("key", "name", "half").compile()


@query("SELECT event_type, count(*) AS n FROM events WHERE value > 50 GROUP BY 1")
def streaming_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same steps over a stream: rows that pass are written as they arrive, then counted."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    stream = read_stream(spark, sf_dir, schema, pathGlobFilter="events.parquet").filter(col("value") > 50).select("event_type")
    run_available(stream, f"{path}/out", f"{path}/state")
    return relation(spark.read.parquet(f"{path}/out")).group_by("event_type").agg(te.count_records().alias("n")).compile()


# ---- operators that no query above calls


@query("""SELECT n_regionkey, 'same' AS any_name, string_agg(n_name, '+' ORDER BY n_name) AS names, sum(n_nationkey) AS keys, 0 AS no_keys FROM nation GROUP BY 1""")
def agg_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").with_columns(lit("same").alias("same"))
    none = when(col("n_nationkey") < 0).then(col("n_nationkey")).otherwise(None)
    joined = n.group_by("n_regionkey").agg(col("same").any_value().alias("any_name"), col("n_name").string_agg("+").alias("joined"), col("n_nationkey").sum0().alias("keys"), none.sum0().alias("no_keys"))
    # A list's order within a group is open, so its parts are compared in order.
    return joined.select("n_regionkey", "any_name", te.native(F.array_join(F.array_sort(F.split("joined", "[+]")), "+")).alias("names"), "keys", "no_keys").compile()


@query("""SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)""")
def group_by_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = read(spark, sf_dir, "orders").group_by("o_orderstatus", "o_orderpriority")
    return grouped.rollup(te.count_records().alias("n"), col("o_totalprice").sum().round(2).alias("total")).compile()


@query("""SELECT o_orderstatus, o_orderpriority, count(*) AS n, max(o_totalprice) AS most FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""")
def group_by_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").group_by("o_orderstatus", "o_orderpriority").cube(te.count_records().alias("n"), col("o_totalprice").max().alias("most")).compile()


@query("SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = read(spark, sf_dir, "customer").filter(col("c_acctbal") > 0).select(col("c_custkey").alias("o_custkey"))
    return read(spark, sf_dir, "orders").filter(col("o_orderstatus") == "F").select("o_custkey").intersect(rich).compile()


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = read(spark, sf_dir, "orders").filter(col("o_orderstatus") == "F").select(col("o_custkey").alias("c_custkey"))
    return read(spark, sf_dir, "customer").select("c_custkey").difference(ordered).compile()


@query("""SELECT o_orderkey, o_orderdate < current_date AS past, o_orderdate < now()::TIMESTAMP AS before_now, o_orderdate > now()::TIMESTAMP - INTERVAL 30 DAY AS new,
  o_orderdate + INTERVAL 1 HOUR AS local, (year(o_orderdate) % 4 = 0 AND year(o_orderdate) % 100 <> 0) OR year(o_orderdate) % 400 = 0 AS leap, FALSE AS dst FROM orders""")
def clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = col("o_orderdate")
    return (
        read(spark, sf_dir, "orders")
        .select(
            "o_orderkey", (t < te.today()).alias("past"), (t < te.now()).alias("before_now"), t.dt.newer_than("30d").alias("new"), t.dt.local_timestamp("Etc/GMT-1").alias("local"),
            t.dt.extract_boolean("IS_LEAP_YEAR").alias("leap"), t.dt.extract_boolean("IS_DST", "UTC").alias("dst"),
        )
        .compile()
    )


@query("""SELECT o_orderkey, strftime(o_orderdate, '%H:%M:%S') || '.000000' AS clock, coalesce(instr(o_orderpriority, regexp_extract(o_orderpriority, '[A-Z]+')), 0) AS at, (o_orderkey >> 2) AS shifted, o_custkey AS kept FROM orders""")
def fn_extras(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    said = col("o_orderdate").dt.strftime("%H|%M|%S").str
    return o.select("o_orderkey", said.strptime_time("%H|%M|%S").alias("clock"), col("o_orderpriority").str.regexp_strpos("[A-Z]+").alias("at"), col("o_orderkey").shift_right_unsigned(2).alias("shifted"), col("o_custkey").as_native().alias("kept")).compile()


@query("""SELECT round(product(1 + o_totalprice / 1e12), 6) AS multiplied, round(stddev_samp(o_totalprice), 4) AS sd, round(var_pop(o_totalprice / 1000), 4) AS variance, 'O' AS some, 1 AS item, 9 AS wide FROM orders WHERE o_orderstatus = 'O'""")
def terminals_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").filter(col("o_orderstatus") == "O").with_columns((1 + col("o_totalprice") / 1e12).alias("f"), (col("o_totalprice") / 1000).alias("p"))
    row = {"multiplied": round(o.product("f"), 6), "sd": round(o.std_dev("o_totalprice"), 4), "variance": round(o.variance("p", distribution="POPULATION"), 4), "some": o.any_value("o_orderstatus")}
    first = read(spark, sf_dir, "orders").sort("o_orderkey").head(1)
    return relation([row | {"item": relation([{"x": 1}], spark).item("x"), "wide": len(first.columns) + 3}], spark).compile()


@query("SELECT 100 AS n, 100 AS apart, 100 AS members, TRUE AS same, TRUE AS near")
def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds of any sample: its size, that rows are distinct and come from the table, and that a seed repeats it."""
    orders = read(spark, sf_dir, "orders")
    drawn, again = ([k for (k,) in orders.sample(n=100, seed=3).select("o_orderkey").to_tuples()] for _ in range(2))
    members = orders.filter(col("o_orderkey").is_in(drawn)).count_rows()
    share = orders.sample(fraction=0.5, seed=1).count_rows() / orders.count_rows()
    return relation([{"n": len(drawn), "apart": len(set(drawn)), "members": members, "same": sorted(drawn) == sorted(again), "near": 0.4 < share < 0.6}], spark).compile()


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT r_regionkey + 100, r_name, r_regionkey FROM region")
def files_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV file of its own dialect and a file of JSON lines, read as a package with declared types."""
    folder = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    spark.read.parquet(f"{sf_dir}/nation.parquet").coalesce(1).write.options(sep=";", quote="'", quoteAll=True, escape="'", header=True).csv(f"{folder}/nation")
    spark.read.parquet(f"{sf_dir}/region.parquet").write.json(f"{folder}/region")
    package = te.DataPackage.from_descriptor(
        {
            "name": "files",
            "resources": [
                {"name": "nation", "path": f"{folder}/nation", "format": "csv", "dialect": {"delimiter": ";", "quoteChar": "'", "doubleQuote": True, "headerRows": [1], "caseSensitiveHeader": True}, "schema": {"fields": [{"name": "n_nationkey", "type": "integer"}, {"name": "n_name", "type": "string"}, {"name": "n_regionkey", "type": "integer"}]}},
                {"name": "region", "path": f"{folder}/region", "format": "ndjson"},
            ],
        }
    )
    dag = package.to_relation_dag(spark=spark)
    region = dag.ref("region").select((col("r_regionkey") + 100).alias("n_nationkey"), col("r_name").alias("n_name"), col("r_regionkey").alias("n_regionkey"))
    dag.add("all", te.concat([dag.ref("nation").select("n_nationkey", "n_name", "n_regionkey"), region]))
    return dag.collect("all")
