"""Columns of any name and type, rows without ids, ties and long texts, by value."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from tessera.llm import contamination, licenses, lines, mixing, quality, registry, shared, simhash, token_files

NAMES = ("__keep", "__text", "__sid", "__mark", "__hit", "__slot", "__start", "__sid0", "__MARK0", "__hit0", "__slot0", "__start0", "row", "size", "of", "k", "c0", "words", "a.b", "with`tick")
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), *[T.StructField(n, T.StringType()) for n in NAMES], T.StructField("tags", T.MapType(T.StringType(), T.IntegerType()))])


def wide(spark):
    rng = random.Random(4)
    rows = []
    for i in range(30):
        text = " ".join(f"w{rng.randint(0, 60)}" for _ in range(40)) if i % 3 else "the same words stand in every third one of these texts"
        rows.append((i, text, "en", "ab"[i % 2], len(text), *[f"{n}-{i}" for n in NAMES], {"n": i}))
    return spark.createDataFrame(rows, SCHEMA)


def plain(row):
    return tuple(sorted(x.items()) if isinstance(x, dict) else x for x in row)


def test_stages_keep_all_columns(spark):
    docs = wide(spark)
    given = {r["doc_id"]: plain(r) for r in docs.collect()}
    items = spark.createDataFrame([(1, "the same words stand in every third one of these texts")], "item_id long, text string")
    kept = simhash.one_of_each(docs)
    assert kept.schema == docs.schema
    assert {r["doc_id"]: plain(r) for r in kept.collect()} == {i: r for i, r in given.items() if i % 3 or i == 0}
    for mb in (8, 0):
        left = contamination.decontaminate(docs, items, broadcast_mb=mb)
        assert left.schema == docs.schema
        assert {r["doc_id"]: plain(r) for r in left.collect()} == {i: r for i, r in given.items() if i % 3}
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(30)], "doc_id long, quality int")
    good = quality.keep_good(docs, labels)
    assert good.schema == docs.schema
    assert all(plain(r) == given[r["doc_id"]] for r in good.collect())
    for mixed in (mixing.mixed_documents(docs), corpus_pipeline.source_mix(spark, docs, "")):
        assert mixed.columns == docs.columns
        rows = mixed.collect()
        taken = {r["doc_id"]: r["taken"] for r in mixing.taken_words(mixing.mix(docs)).collect()}
        assert {r["doc_id"] for r in rows} == {i for i, n in taken.items() if n}
        for r in rows:
            own, text = given[r["doc_id"]], r["text"]
            assert plain(r)[5:] == own[5:] and own[1].startswith(text)


def test_lines_count_documents_and_keep_rows_without_ids(spark):
    line = "This line is long enough to be counted, and many hold it."
    other = line.replace("line", "row ")
    rows = [(1, line)] * 4 + [(2, line)] + [(i, other) for i in range(10, 14)] + [(None, other)] * 5
    out = lines.drop_shared_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["n_dropped"] for r in out.collect()} == {0}
    out = lines.drop_shared_lines(spark.createDataFrame([*rows, (14, other + "\nend")], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["n_dropped"], r["kept_text"]) for r in out if r["doc_id"] not in (1, 2)) == [(0, 0, other)] * 5 + [(i, 1, "") for i in range(10, 14)] + [(14, 0, other + "\nend")]


def test_lines_of_long_texts(spark):
    """Twenty documents of 32,000 shared lines each: the work is linear in lines."""
    text = "\n".join(f"Line number {i} of a long text that several documents have" for i in range(32_000))
    out = lines.drop_shared_lines(spark.createDataFrame([(i, f"{i}\n{text}") for i in range(6)], "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], len(r["kept_text"])) for r in out} == {i: (32_001, 32_000 if i < 5 else 0, 1 if i < 5 else len(text) + 2) for i in range(6)}


@pytest.mark.parametrize("constants", [10_000, 0])
def test_licenses_by_constants_and_by_join(spark, constants):
    mit = dict(licenses.LICENSES)["MIT"]
    docs = [(1, "x\nReleased under the MIT License.\nLicensed under CC BY 4.0."), (1, mit), (None, None), (3, "Released under the MIT Licence!\nreleased under the MIT license"), (None, mit)]
    out = licenses.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string"), constants=constants).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r["doc_id"], r["license"], r["notices"]) for r in out), key=key) == sorted([(1, None, "CC-BY-4.0,MIT"), (1, "MIT", None), (None, None, None), (3, None, "MIT"), (None, "MIT", None)], key=key)


def test_schedule_is_golden(spark):
    """Slots against the points one by one."""
    rows = [(i, " ".join(["w"] * (5 + i % 7)), "abc"[i % 3]) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(docs, block_words=10)
    got = {(r["sid"], r["slot"]) for r in mixed.join(docs.select("doc_id", "source"), "doc_id").select((F.ascii("source") - 97).alias("sid"), "slot").where("slot is not null").collect()}
    first = {r["source"]: (r["source_size"], r["target"]) for r in mixed.join(docs.select("doc_id", "source"), "doc_id").select("source", "source_size", "target").distinct().collect()}
    total, sizes = sum(n for n, _ in first.values()), [first[s][1] for s in "abc"]
    edges = np.cumsum([0, *sizes]) / sum(sizes)
    need = [-(-round(t) // 10) for t in sizes]
    ranks, want = [0, 0, 0], set()
    for slot in range(-(-total // 10)):
        point = (slot * 1_327_217_885 % 2**31) / 2**31
        s = next(k for k in range(3) if edges[k] <= point < edges[k + 1])
        if ranks[s] < need[s]:
            want.add((s, slot))
        ranks[s] += 1
    drawn = -(-total // 10)
    want |= {(s, b * 1_000_000 + s + drawn) for s in range(3) for b in range(ranks[s], need[s])}
    assert got == want


def test_tokens_of_one_hot_id(spark, tmp_path):
    """Rows without an id are dealt over several files and all come back, whole."""
    rows = [(None, f"text number {i}") for i in range(300)] + [(i, "x") for i in range(20)]
    files = token_files.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), registry.tokenizer_path(), f"file://{tmp_path}/t")
    assert files.count() >= 3
    out = token_files.read_tokens(files, f"file://{tmp_path}/t").orderBy("start").collect()
    assert [r["doc_id"] for r in out] == [*range(20), *[None] * 300]
    assert [r["start"] for r in out] == np.cumsum([0, *[r["n_tokens"] for r in out]])[:-1].tolist()
    encode = token_files.Encoder(registry.tokenizer_path(), "<u2")
    assert sorted(r["n_tokens"] for r in out) == sorted(len(x) // 2 + 1 for x in encode([t for _, t in rows]))
    held = token_files.TokenFile(f"file://{tmp_path}/t", files.first()["path"])
    ids, mask = held.sequence(0)
    assert mask.dtype == bool and mask.base is not None and ids.base is not None


def test_range_buckets(spark):
    rng = random.Random(8)
    values = [rng.choice([5, 5, 5, 9, 30, -7, rng.randint(-50, 50)]) for _ in range(400)]
    bounds = np.array([-7, 5, 5, 5, 9, 9, 30])
    df = spark.createDataFrame([(v, rng.random()) for v in values], "v long, u double")
    for r in df.select("v", "u", shared.range_bucket(F.col("v"), bounds).alias("b"), shared.range_bucket(F.col("v"), bounds, F.col("u")).alias("t")).collect():
        low, high = np.searchsorted(bounds, r["v"], "left"), np.searchsorted(bounds, r["v"], "right")
        assert r["b"] == high and r["t"] == low + int(r["u"] * (high - low + 1))
