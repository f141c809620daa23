"""Every catalog query against its SQL on the smallest tables."""

import glob
import os
import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tessera import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if value != value else float(f"{value:.9g}") + 0.0
    return [plain(v) for v in value] if isinstance(value, (list, tuple)) else value


def rows_of(rows, columns):
    return Counter(repr([plain(r[columns.index(c)]) for c in sorted(columns)]) for r in rows)


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name in catalog.SQL:
        want = duck.sql(catalog.SQL[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert rows_of(rows, df.columns) == rows_of(want.fetchall(), want.columns)
    else:
        assert rows


def signed(value):
    return ("nan" if value != value else str(value)) if isinstance(value, float) else value


@pytest.mark.parametrize("name", ["fn_arithmetic", "fn_math", "fn_null_predicates"])
def test_infinities_and_signs_of_zero(spark, duck, name):
    """The queries whose results hold infinities or NaN, cell by cell and to the last digit; a NaN has no sign."""
    df = catalog.QUERIES[name](spark, SF)
    got = {r.k: {c: signed(r[c]) for c in df.columns} for r in df.collect()}
    want = duck.sql(catalog.SQL[name])
    columns, k = want.columns, want.columns.index("k")
    assert got == {r[k]: {c: signed(v) for c, v in zip(columns, r, strict=True)} for r in want.fetchall()}


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_corpus_package():
    code = "import sys; sys.modules['tessera.llm'] = None; import __spark_entry__ as e; assert 'pricing_summary' in e.queries() and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).parents[1])
