"""Size partitions and the sketches' filter of the containment search, against brute force."""

import math
import random
import re

import numpy as np
import pytest

from tessera.llm import contamination


def grams(text, n=5):
    w = re.sub(r"[!-/:-@\[-`{-~]", "", text.lower()).split()
    k = min(n, len(w))
    return k, {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def made(seed=6):
    rng = random.Random(seed)
    say = lambda n: " ".join(f"v{rng.randint(0, 3000)}" for _ in range(n))
    items = [(i, say(rng.choice([1, 2, 3, 4, 5, 6, 9, 20, 60, 300]))) for i in range(60)]
    docs = []
    for i in range(200):
        w = items[rng.randrange(60)][1].split()
        for at in rng.sample(range(len(w)), rng.choice([0, 0, 1, len(w) // 40, len(w) // 20]) % max(len(w), 1)):
            w[at] = "changed"
        docs.append((i, f"{say(rng.randint(0, 400))} {' '.join(w)} {say(rng.randint(0, 400))}"))
    return docs, items


@pytest.mark.parametrize("mb", [8, 0])
def test_all_sizes(spark, mb):
    docs, items = made()
    want = set()
    for i, t in items:
        k, own = grams(t)
        for d, text in docs:
            w = re.sub(r"[!-/:-@\[-`{-~]", "", text.lower()).split()
            hits = len(own & {tuple(w[a : a + k]) for a in range(len(w) - k + 1)})
            if hits >= 0.8 * len(own):
                want.add((d, i, len(own), hits))
    out = contamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), broadcast_mb=mb)
    assert {(r["doc_id"], r["item_id"], r["n_shingles"], r["n_found"]) for r in out.collect()} == want
    assert len(want) > 100


def test_partitions_have_their_own_sketches():
    _, items = made()
    held = contamination.Items([(i, t.encode()) for i, t in items], 5, 0.8)
    parts = held.partitions[5]
    assert len(parts) >= 4 and [p.least for p in parts] == sorted(p.least for p in parts)
    for p in parts:
        assert p.most.bit_length() == p.least.bit_length()
        assert p.k == p.most - math.ceil(0.8 * p.most) + 1 and p.needed == math.ceil(0.8 * p.least)


def test_filter_holds_what_went_in(spark):
    rng = np.random.default_rng(2)
    hashes = rng.integers(0, 2**64, 2000, dtype="u8")
    rows = spark.createDataFrame([(int(h),) for h in hashes[:1000].view("int64")], "hash long").select(*contamination._filter_places(contamination.F.col("hash"))).collect()
    words = np.zeros(1 << contamination.FILTER_BITS - 6, "<u8")
    for r in rows:
        for at in r:
            words[at >> 6] |= np.uint64(1 << (at & 63))
    inside = contamination._in_filter(words, hashes)
    assert inside[:1000].all() and inside[1000:].sum() < 5
