"""The order of the mix's slots reaches the token files."""

import corpus_pipeline

from tessera.llm import mixing


def test_tokens_lie_in_the_order_of_the_slots(spark, tmp_path):
    rows = [(i, " ".join(f"w{i}" for _ in range(40)), "en", ("a", "b", "c")[i % 3], 0) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    slots = mixing.mix(docs, block_words=1024).where("slot is not null").groupBy("doc_id").agg({"slot": "min"}).collect()
    first = {r["doc_id"]: r["min(slot)"] for r in slots}
    corpus_pipeline.source_mix(spark, docs, "").write.parquet(f"{tmp_path}/mix")
    mixed = spark.read.parquet(f"{tmp_path}/mix")
    index = corpus_pipeline.token_output(spark, mixed, "").orderBy("start").collect()
    assert len(index) == mixed.count()
    order = list(dict.fromkeys(r["doc_id"] for r in index))
    assert [first[i] for i in order] == sorted(first.values())
    at = {r["doc_id"]: r["source"] for r in docs.collect()}
    turns = [at[r["doc_id"]] for r in index]
    # A block holds about 25 documents, so sources take turns instead of standing by doc_id.
    assert 5 < sum(a != b for a, b in zip(turns, turns[1:], strict=False)) < 60
    assert [r["doc_id"] for r in index] != sorted(r["doc_id"] for r in index)
