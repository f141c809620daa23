"""The classifier end to end against numpy: statistics, moments, fit and scores."""

import math
import random
import re
import zlib

import numpy as np
import pytest

from tessera.llm import quality

SF = "/root/testdata/sf0.001"


def brute_statistics(text):
    """From characters and regular expressions; words are what ASCII white space separates."""
    text = text or ""
    words = re.findall(r"[^ \t\n\x0b\x0c\r]+", text)
    lines, raw = text.split("\n"), text.encode()
    n, w = max(len(raw), 1), max(len(words), 1)
    share = lambda count, whole: math.log(count / whole + 1e-3)
    lengths = [len(x.encode()) for x in words]
    capital = lambda x: any("A" <= c <= "Z" for c in x) and not any("a" <= c <= "z" for c in x)
    return [
        math.log(1 + len(raw)),
        math.log(1 + len(words)),
        share(len(lines), w),
        share(len(re.findall(r"[#$%&*@^~<>{}=+\\_/\[\]]", text)), n),
        share(text.count("!"), n),
        share(text.count("|"), n),
        share(text.count("."), w),
        share(text.count(","), w),
        share(len(re.findall("[0-9]", text)), n),
        share(len(re.findall("[A-Z]", text)), n),
        share(sum(map(capital, words)), w),
        share(sum(words[i] == words[i + 1] for i in range(len(words) - 1)), w),
        share(len(set(words)), w),
        min(math.sqrt(sum(lengths) / len(words)), 32.0) if words else 0.0,
        share(sum(k > 20 for k in lengths), w),
        share(sum(re.fullmatch("[A-Za-z]+", x) is not None for x in words), w),
        share(len(lines) - len(set(lines)), len(lines)),
    ]


TEXTS = ["", " ", "one", "A B! c|d", "x\nx\n\nThe END. 12,5 %", "word " * 50, "w" * 5000, "Ämter ÄB naïve straße", "A\x0bB\x0cC\rD", "...", "\n" * 30]


def test_statistics():
    rng = random.Random(9)
    made = ["".join(rng.choice("aB1 .,!|#\n\tÄß") for _ in range(rng.randint(0, 200))) for _ in range(300)]
    for text in TEXTS + made:
        got = quality.statistics(text.encode())
        assert got == pytest.approx(brute_statistics(text)), text
        assert all(abs(x) < 45 for x in got)


def test_scores_from_texts_to_chances(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    x = {i: np.array(brute_statistics(t)) for i, t in texts.items()}
    known = [(x[r["doc_id"]], r["quality"]) for r in labels.collect() if r["doc_id"] in x and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1]
    every, y = np.array([a for a, _ in known]), np.array([b for _, b in known])
    centre, scale = every.mean(0), every.std(0)
    scale[scale < 1e-5] = 1
    z, size = (every - centre) / scale, every.shape[1]
    own = [np.cov(z[y == c].T, bias=True) for c in (0, 1)]
    pooled = sum(own[c] * (y == c).mean() for c in (0, 1))

    def density(c, at):
        few = size / (size + (y == c).sum())
        cov = (1 - few) * own[c] + few * pooled
        cov = 0.98 * cov + 0.02 * (np.trace(cov) / size + 1e-3) * np.eye(size)
        d = at - z[y == c].mean(0)
        return math.log((y == c).sum()) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * d @ np.linalg.inv(cov) @ d

    got = {r["doc_id"]: r["score"] for r in quality.classify(docs, labels).collect()}
    assert got.keys() == texts.keys()
    for i, stats in x.items():
        at = (stats - centre) / scale
        logit = np.clip(density(1, at) - density(0, at), -700, 700)
        assert got[i] == pytest.approx(1 / (1 + math.exp(-logit)), rel=1e-5, abs=1e-9)


def test_sums_do_not_depend_on_the_deal(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    runs = [sorted(tuple(r) for r in quality.classify(docs.repartition(n), labels.repartition(n)).collect()) for n in (1, 5)]
    assert runs[0] == runs[1]


def test_inverse_of_triangle():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(9, 9))
    factor = np.linalg.cholesky(a @ a.T + np.eye(9))
    assert np.allclose(quality.inverse_of_triangle(factor) @ factor, np.eye(9))
