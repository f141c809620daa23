"""Quality classifier: a regularised quadratic discriminant over transformed document statistics.

Each text gives a few statistics (shares of symbols, capitals, repeated words and lines, word lengths), log- or
square-root-transformed. Each class is a normal distribution whose covariance is shrunk towards the pooled one,
the more the fewer rows the class has, and then a little towards the identity; its Cholesky factor is computed once and kept in the model. A score is the logistic of the
difference of log densities, from Mahalanobis distances, plus the log prior odds; a distance is the length of the
difference times the inverse of the factor, a triangle found once by substitution and kept in the model.

Fitting needs only each class's count, sum and sum of products, which tasks gather from all labelled rows: no
sample, and what reaches the driver is as large for any input. Sums are of whole numbers (statistics and their products
in steps of 2^-40, added as decimals), so they don't depend on the order in which tasks end.

Defined results: null and empty texts have the statistics of an empty text; with fewer than two labelled rows
of either class every score is the share of label 1 among those labelled (0.5 with none); labels that are null
or whose document is missing count for nothing, repeated ones count each time; a null id is never held out.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import arrow_map, kept_rows, quoted, texts, written

SYMBOLS = b"#$%&*@^~<>{}=+\\_/[]"
SHRINKAGE = 0.02
#: Statistics and their products are added up in whole numbers of this part of one.
STEPS = 2.0**40
FLOOR = 1e-3
FEATURES = ("chars", "words", "lines", "symbols", "bangs", "bars", "stops", "commas", "digits", "capitals", "capital_words", "repeats", "variety", "word_length", "long_words", "bare_words", "line_repeats")


def statistics(text: bytes) -> list[float]:
    """Transformed statistics of a whole text, in the order of FEATURES, all between -45 and 45 (mean word lengths over
    1,024 bytes count as 1,024)."""
    words, lines = text.split(), text.split(b"\n")
    n, w = max(len(text), 1), max(len(words), 1)

    def share(count: float, whole: float) -> float:
        return float(np.log(count / whole + FLOOR))

    def bytes_in(chars: bytes) -> int:
        return len(text) - len(text.translate(None, chars))

    lengths = np.fromiter(map(len, words), "int64", len(words))
    return [
        float(np.log1p(len(text))),
        float(np.log1p(len(words))),
        share(len(lines), w),
        share(bytes_in(SYMBOLS), n),
        share(text.count(b"!"), n),
        share(text.count(b"|"), n),
        share(text.count(b"."), w),
        share(text.count(b","), w),
        share(bytes_in(b"0123456789"), n),
        share(bytes_in(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), n),
        share(sum(map(bytes.isupper, words)), w),
        share(sum(map(operator.eq, words, words[1:])), w),
        share(len(set(words)), w),
        min(float(np.sqrt(lengths.mean())), 32.0) if len(words) else 0.0,
        share(int((lengths > 20).sum()), w),
        share(sum(map(bytes.isalpha, words)), w),
        share(len(lines) - len(set(lines)), len(lines)),
    ]


def inverse_of_triangle(factor: np.ndarray) -> np.ndarray:
    """The inverse of a lower triangle, row by row by forward substitution."""
    out = np.zeros_like(factor)
    for k in range(len(factor)):
        row = -factor[k, :k] @ out[:k]
        row[k] += 1
        out[k] = row / factor[k, k]
    return out


@dataclass(frozen=True)
class Discriminant:
    """A fitted model: scaling, each class's mean and the inverse of its Cholesky factor, and the log normaliser."""

    centre: np.ndarray
    scale: np.ndarray
    means: tuple[np.ndarray, np.ndarray] | None
    factors: tuple[np.ndarray, np.ndarray] | None
    offset: float

    @classmethod
    def from_moments(cls, counts: list[float], sums: list[np.ndarray], products: list[np.ndarray], shrinkage: float = SHRINKAGE) -> Discriminant:
        total = sum(counts)
        if min(counts) < 2:
            odds = np.log(max(counts[1], 1e-9) / max(counts[0], 1e-9)) if total else 0.0
            return cls(np.zeros(1), np.ones(1), None, None, float(np.clip(odds, -20, 20)))
        centre = (sums[0] + sums[1]) / total
        spread = np.sqrt(np.maximum(np.diag(products[0] + products[1]) / total - centre**2, 1e-12))
        scale = np.where(spread < 1e-5, 1.0, spread)
        means, factors, offset = [], [], np.log(counts[1] / counts[0])
        size, own, pooled = len(centre), [], 0.0
        for c in (0, 1):
            mean = sums[c] / counts[c]
            own.append((products[c] / counts[c] - np.outer(mean, mean)) / np.outer(scale, scale))
            means.append((mean - centre) / scale)
            pooled = pooled + own[c] * (counts[c] / total)
        for c, sign in ((0, -1), (1, 1)):
            few = size / (size + counts[c])
            covariance = (1 - few) * own[c] + few * pooled
            shrunk = (1 - shrinkage) * covariance + shrinkage * (np.trace(covariance) / size + 1e-3) * np.eye(size)
            factor = np.linalg.cholesky(shrunk)
            factors.append(inverse_of_triangle(factor))
            offset -= sign * np.log(np.diag(factor)).sum()
        return cls(centre, scale, tuple(means), tuple(factors), float(offset))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Chances of label 1 for rows of statistics."""
        logit = np.full(len(x), self.offset)
        if self.means is not None and len(x):
            z = (x - self.centre) / self.scale
            for sign, mean, factor in zip((0.5, -0.5), self.means, self.factors, strict=True):
                logit += sign * (((z - mean) @ factor.T) ** 2).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(logit, -700, 700)))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept from fitting: crc32 of the id's text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(quoted(id_col).cast("string")) % 3 == 1, F.lit(False))


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, x (an array in the order of FEATURES)."""

    def measure(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch["doc_id"], "x": [statistics(t) for t in texts(batch["text"])]}

    return arrow_map(docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).alias("text")), "doc_id long, x array<double>", measure)


def fit(stats: DataFrame, labels: DataFrame, label_col: str = "quality", shrinkage: float = SHRINKAGE) -> Discriminant:
    """Fit to labels (doc_id, label_col) of documents that aren't held out."""
    size = len(FEATURES)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), quoted(label_col).cast("int").alias("label")).where("label in (0, 1) and doc_id is not null").where(~held_out())
    schema = "label int, at int, value decimal(38, 0)"
    target = pa.schema([("label", pa.int32()), ("at", pa.int32()), ("value", pa.decimal128(38, 0))])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [[0] * (1 + size + size * size) for _ in (0, 1)]
        for batch in batches:
            every = batch["x"].flatten().to_numpy().reshape(-1, size)
            labels = batch["label"].to_numpy(zero_copy_only=False)
            for at in range(0, len(every), 1024):
                x, label = every[at : at + 1024], labels[at : at + 1024]
                for c in (0, 1):
                    own = x[label == c]
                    rows = np.concatenate([np.ones((len(own), 1)), own, (own[:, :, None] * own[:, None, :]).reshape(len(own), size * size)], axis=1)
                    steps = np.rint(rows * STEPS).astype("int64")  # statistics are below 45, so 1024 products below 2^61
                    sums[c] = [a + b for a, b in zip(sums[c], steps.sum(axis=0).tolist(), strict=True)]
        for c in (0, 1):
            at = np.arange(len(sums[c]), dtype="int32")
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), c, "int32")), pa.array(at), pa.array([Decimal(v) for v in sums[c]], pa.decimal128(38, 0))], schema=target)

    rows = stats.join(known, "doc_id").select("x", "label").mapInArrow(gather, schema).groupBy("label", "at").agg(F.sum("value").alias("value")).collect()
    sums = np.zeros((2, 1 + size + size * size))
    for r in rows:
        sums[r["label"], r["at"]] = int(r["value"] or 0) / STEPS
    return Discriminant.from_moments(sums[:, 0].tolist(), list(sums[:, 1 : 1 + size]), [s[1 + size :].reshape(size, size) for s in sums], shrinkage)


def score(stats: DataFrame, model: Discriminant) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of document_statistics()."""

    def rate(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch["doc_id"], "score": model.score(batch["x"].flatten().to_numpy().reshape(-1, len(FEATURES)))}

    scored = arrow_map(stats, "doc_id long, score double", rate)
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Fit on the labelled documents that aren't held out, then score all."""
    stats = written(document_statistics(docs, id_col, text_col), "statistics")
    return score(stats, fit(stats, labels, label_col))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The documents that the classifier accepts, with all their columns; scores are joined by row, not by id,
    so repeated ids are judged each by their own text."""
    stats = written(document_statistics(docs, id_col, text_col), "statistics")
    model = fit(stats, labels, label_col)

    def accept(given: list[bytes]) -> list[bool]:
        x = np.array([statistics(t) for t in given], dtype="float64").reshape(-1, len(FEATURES))
        return (model.score(x) >= 0.5).tolist()

    return kept_rows(docs, text_col, accept)
