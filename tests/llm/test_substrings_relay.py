"""Packets that go by relays bring the same rows as those that go straight, and what brute force removes."""

import pytest
from cases import documents, frame
from test_exact import brute_repeats, got

from tessera.llm import substrings

COLUMNS = ("n_words", "n_removed", "kept_sha256")


@pytest.fixture(params=[4, 7])
def parts(spark, request):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_relays_against_brute_force(spark, parts):
    rows = documents()
    out = got(substrings.remove_repeats(frame(spark, rows), direct=1))
    assert {i: tuple(o[c] for c in COLUMNS) for i, o in out.items()} == brute_repeats(rows)


def test_relays_over_rows_without_an_id_and_over_nothing(spark):
    rows = [(None if i % 3 == 0 else 50 if i % 3 == 1 else r[0], *r[1:]) for i, r in enumerate(documents())]
    straight, relayed = ([*map(tuple, substrings.remove_repeats(frame(spark, rows), direct=d).collect())] for d in (1024, 1))
    assert sum(r[2] for r in straight) > 50
    assert sorted(straight, key=str) == sorted(relayed, key=str)
    assert substrings.remove_repeats(frame(spark, []), direct=1).count() == 0
    assert substrings.remove_repeats(frame(spark, [(1, None, *rows[0][2:])]), direct=1).count() == 1


def test_bundles_keep_packets_and_numbers():
    rows = [(3, 9, False, b"abc"), (0, 2, True, b""), (3, 8, False, b"\x00" * 40), (1, 9, False, b"z")]
    table = substrings._table(rows)
    bundles = substrings._bundled(table, table["part"].to_numpy() // 2, table["grp"].to_numpy() // 5)
    assert sorted((p, g) for p, g in zip(bundles["part"].to_pylist(), bundles["grp"].to_pylist())) == [(0, 0), (0, 1), (1, 1)]
    opened = substrings._unbundled(bundles)
    assert sorted(tuple(r.values()) for r in opened.to_pylist()) == sorted(rows)
    assert substrings._bundled(table.slice(0, 0), table["part"].to_numpy()[:0], table["grp"].to_numpy()[:0]).num_rows == 0
