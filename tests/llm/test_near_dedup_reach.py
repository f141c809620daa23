"""What the SimHash stage of the pipeline leaves, as the README says: pairs at 0.8 and above beyond 4 differing bits."""

from test_exact import brute_simhash

SF = "/root/testdata"


def grams(text):
    w = [x.decode("utf-8", "replace") for x in (text or "").encode().lower().split()]
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def test_fingerprints_miss_pairs_that_are_similar(spark):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/sf0.001/documents.parquet").collect()}
    assert 5 * len(grams(rows[1]) & grams(rows[177])) >= 4 * len(grams(rows[1]) | grams(rows[177]))
    assert (brute_simhash(rows[1]) ^ brute_simhash(rows[177])).bit_count() > 4
