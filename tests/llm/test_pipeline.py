"""Each stage of the pipeline on the input that it got, held against a plain version."""

import re
import zlib

import corpus_pipeline
from cases import documents, frame
from test_exact import brute_components, brute_simhash

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        kept.append(spark.read.parquet(f"{tmp_path}/{k}"))
        docs = kept[-1]
    first = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [{r["doc_id"]: r["text"] for r in df.collect()} for df in (first, *kept[:4])]
    for df in kept[:4]:
        assert df.columns == first.columns

    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((i in rows[1]) == labels[i] for i in held) >= 0.9 * len(held)

    component = brute_components({i: brute_simhash(t) for i, t in rows[1].items()})
    assert set(rows[2]) == {i for i, c in component.items() if i == c}

    def grams(text):
        w = re.sub(r"[!-/:-@\[-`{-~]", "", text.lower()).split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    items = [grams(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(rows[3]) == {i for i, t in rows[2].items() if not any(len(g & grams(t)) >= 0.8 * len(g) for g in items)}
    assert set(rows[4]) <= set(rows[3])
    assert kept[4].count() == kept[3].count()


def test_odd_rows(spark, tmp_path):
    docs = frame(spark, documents() + [(None, None, None, None, None, None, None, None)] * 2)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[1:]):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    assert docs.count() > 0


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0, name
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert out.columns == docs.columns
