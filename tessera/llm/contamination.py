"""Benchmark decontamination: which documents hold most of a test item's word shingles.

Texts are lowered, ASCII punctuation is dropped, and words are what white space separates. Containment is the
share of an item's distinct five-word shingles that a document has; at 0.8 or more the pair is reported.

Search by MinHash, in partitions by size: items of 2^c to 2^(c+1) - 1 shingles are one partition. Where the largest
has n shingles, the partition's sketches are the k smallest hashes of each item, k = n - ceil(0.8 n) + 1: a document with
0.8 of an item's shingles misses fewer than k of them and so has one of the sketch, whatever the document's length. A
document is held against a partition only if it has 0.8 of the shingles of its smallest item, and only shingles whose
hash isn't above the partition's largest sketch can meet. Candidates are verified by exact containment of shingles,
not hashes.

The items go to every task only while their size is below `broadcast_mb`. Beyond it the documents' hashes that pass a
filter of the sketches (a Bloom filter of FILTER_BITS bits, of one size for any number of items; fuller, it lets more
through, never less) are joined with the sketches by a shuffle, and the candidates' texts by another.

Defined results: items and documents that are null or have no words match nothing; an item of fewer than five
words has its whole word sequence as its one shingle; rows with equal ids are matched each, and pairs are
distinct; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tessera.llm.shared import kept_rows, own_name, quoted, slices, texts, written

PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
FILTER_BITS = 26
PAIRS = "doc_id long, item_id long, n_shingles int, n_found int, containment double"


def normal_words(text: bytes) -> list[bytes]:
    """Lowered words without ASCII punctuation."""
    lowered = text.lower() if text.isascii() else text.decode("utf-8", "replace").lower().encode()
    return lowered.translate(None, PUNCTUATION).split()


def shingles(words: list[bytes], size: int) -> list[bytes]:
    """Runs of `size` words, joined by a space."""
    joined = b" ".join(words)
    ends = (np.cumsum(np.fromiter(map(len, words), "int64", len(words)) + 1) - 1).tolist()
    starts = [0, *[e + 1 for e in ends[:-1]]]
    return [joined[a:b] for a, b in zip(starts, ends[size - 1 :], strict=False)]


def gram_hash(gram: bytes) -> int:
    return xxhash.xxh3_64_intdigest(gram)


def fewest(n: int, threshold: float) -> int:
    """How many of n shingles reach the threshold."""
    return math.ceil(threshold * n - 1e-9)


def sketch_size(n: int, threshold: float) -> int:
    """How many of n shingles cannot all be missing at the threshold."""
    return n - fewest(n, threshold) + 1


class Partition:
    """Items of one shingle length whose numbers of shingles lie between two powers of two."""

    def __init__(self, sizes: Iterable[int], threshold: float):
        self.least, self.most = min(sizes), max(sizes)
        self.needed, self.k = fewest(self.least, threshold), sketch_size(self.most, threshold)
        self.probes: dict[bytes, list[int]] = defaultdict(list)

    def sketch(self, grams: Iterable[bytes]) -> list[bytes]:
        """The shingles with the smallest hashes."""
        return sorted(grams, key=lambda g: (gram_hash(g), g))[: self.k]


class Items:
    """Test items by their sketches: shingle length -> partitions by ascending size."""

    def __init__(self, items: Iterable[tuple[int, bytes]], size: int, threshold: float):
        self.threshold = threshold
        self.grams: list[tuple[int, frozenset[bytes]]] = []
        sorted_out: dict[tuple[int, int], list[int]] = defaultdict(list)
        for item_id, text in items:
            words = normal_words(text)
            if words:
                length = min(size, len(words))
                grams = frozenset(shingles(words, length))
                sorted_out[length, len(grams).bit_length()].append(len(self.grams))
                self.grams.append((item_id, grams))
        self.partitions: dict[int, list[Partition]] = defaultdict(list)
        for (length, _), own in sorted(sorted_out.items()):
            part = Partition([len(self.grams[k][1]) for k in own], threshold)
            for k in own:
                for probe in part.sketch(self.grams[k][1]):
                    part.probes[probe].append(k)
            self.partitions[length].append(part)

    def found_in(self, text: bytes) -> list[tuple[int, int, int]]:
        """(item, its shingles, how many of them the text has) for each item at the threshold."""
        words = normal_words(text)
        found: dict[int, tuple[int, int]] = {}
        for length, parts in self.partitions.items():
            own = frozenset(shingles(words, length)) if len(words) >= length else frozenset()
            for part in parts:
                if len(own) < part.needed:
                    break
                for k in {k for g in part.probes.keys() & own for k in part.probes[g]}:
                    item_id, grams = self.grams[k]
                    hits = len(grams & own)
                    if hits >= fewest(len(grams), self.threshold):
                        found[item_id] = max(found.get(item_id, (0, 0)), (hits, len(grams)))
        return [(i, n, hits) for i, (hits, n) in found.items()]


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", size: int = 5, threshold: float = 0.8, broadcast_mb: float = 8) -> DataFrame:
    """Pairs (doc_id, item_id) with n_shingles, n_found and containment, at the threshold or above."""
    tests = _tests(items, item_id_col, item_text_col)
    source = docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).alias("text"))
    make = _small(tests, size, threshold, broadcast_mb)
    return (_by_shuffle(source, tests, size, threshold) if make is None else _scan(source, make)).distinct()


def _tests(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return items.select(quoted(id_col).cast("long").alias("item_id"), quoted(text_col).alias("item")).where("item is not null")


def _small(tests: DataFrame, size: int, threshold: float, broadcast_mb: float) -> Callable[[], Items] | None:
    """What makes the items' index in a task, if their size is below the bound."""
    found = tests.agg(F.coalesce(F.sum(F.octet_length("item")), F.lit(0)).alias("n"), F.count("*").alias("rows")).first()
    if found["n"] + 200 * found["rows"] > broadcast_mb * 1e6:
        return None
    known = tests.sparkSession.sparkContext.broadcast([(r["item_id"], r["item"].encode()) for r in tests.collect()])
    return lambda: Items(known.value, size, threshold)


def _scan(source: DataFrame, make: Callable[[], Items]) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_shingles", pa.int32()), ("n_found", pa.int32()), ("containment", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = make()
        for batch in slices(batches):
            rows = [(d, i, n, hits, hits / n) for d, t in zip(batch["doc_id"].to_pylist(), texts(batch["text"]), strict=True) for i, n, hits in known.found_in(t)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return source.mapInArrow(run, PAIRS)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _filter_places(hashed: Column) -> list[Column]:
    """The two bits of a hash in the filter."""
    mask = (1 << FILTER_BITS) - 1
    return [F.shiftrightunsigned(hashed, k * FILTER_BITS).bitwiseAND(F.lit(mask)).cast("int") for k in (0, 1)]


def _in_filter(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes have both bits."""
    mask, held = np.uint64((1 << FILTER_BITS) - 1), np.ones(len(hashes), bool)
    for k in (0, 1):
        at = hashes >> np.uint64(k * FILTER_BITS) & mask
        held &= (words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
    return held


def _by_shuffle(source: DataFrame, tests: DataFrame, size: int, threshold: float, by_text: bool = False) -> DataFrame:
    """Sketches joined with the documents' shingles by hash; candidates verified with both texts at hand. Texts go
    by their MD5, so that rows with null or equal ids are matched by what they hold."""
    texts_of = {"doc": source.select(F.md5("text").alias("doc"), "text").where("text is not null").distinct(), "item": tests.select(F.md5("item").alias("key"), "item").distinct().withColumnsRenamed({"item": "text", "key": "item"})}

    def hashed(kind: str, columns: str, rows_of: Callable[[bytes], Iterable[tuple]]) -> DataFrame:
        schema = to_arrow_schema(StructType.fromDDL(f"{kind} string, {columns}"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 1 << 20):
                rows = [(k, *row) for k, t in zip(batch[kind].to_pylist(), texts(batch["text"]), strict=True) for row in rows_of(t)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        return texts_of[kind].mapInArrow(run, f"{kind} string, {columns}")

    def measured(text: bytes) -> Iterable[tuple]:
        words = normal_words(text)
        length = min(size, len(words))
        return [(length, len(set(shingles(words, length))))] if words else []

    sizes = hashed("item", "length int, n int", measured).groupBy("length", F.length(F.bin("n")).alias("class")).agg(F.min("n").alias("least"), F.max("n").alias("most"))
    classes = {(r["length"], r["class"]): (r["least"], r["most"]) for r in sizes.collect()}  # at most `size` times 32 rows

    def probes(text: bytes) -> Iterable[tuple]:
        for length, n in measured(text):
            grams, key = set(shingles(normal_words(text), length)), (length, n.bit_length())
            yield from [(*key, n, _signed(gram_hash(g))) for g in Partition(classes[key], threshold).sketch(grams)]

    wanted = written(hashed("item", "length int, class int, n int, hash long", probes), "sketches")
    # Hashes are compared as unsigned: their top halves as numbers.
    tops = {(r["length"], r["class"]): r["top"] for r in wanted.groupBy("length", "class").agg(F.max(F.shiftrightunsigned("hash", 32)).alias("top")).collect()}
    places = wanted.select(F.explode(F.array(*_filter_places(F.col("hash")))).alias("at"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("at", F.lit(64)).cast("int"))
    filter_words = np.zeros(1 << FILTER_BITS - 6, "<u8")
    for r in places.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).collect():  # at most 2^20 rows, however many items there are
        filter_words[r["word"]] = r["bits"] & 0xFFFFFFFFFFFFFFFF
    passing = source.sparkSession.sparkContext.broadcast(filter_words)
    bounds: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for (length, c), (least, _) in sorted(classes.items()):
        bounds[length].append((fewest(least, threshold), tops[length, c]))

    def candidates(text: bytes) -> Iterable[tuple]:
        words, rows = normal_words(text), []
        for length, parts in bounds.items():
            grams = list(set(shingles(words, length))) if len(words) >= length else []
            top = max((top for needed, top in parts if needed <= len(grams)), default=-1)
            if top >= 0:
                found = np.array([gram_hash(g) for g in grams], "<u8")
                found = found[(found >> np.uint64(32)).astype("int64") <= top]
                rows += [(length, len(grams), h) for h in found[_in_filter(passing.value, found)].view("int64").tolist()]
        return rows

    held = hashed("doc", "length int, m int, hash long", candidates)
    met = held.join(wanted, ["length", "hash"]).where(F.col("m") >= F.ceil(threshold * F.col("n") - 1e-9))
    near = met.select("doc", "item").distinct()
    both = near.join(texts_of["doc"], "doc").join(texts_of["item"].withColumnRenamed("text", "item_text"), "item")
    checked = pa.schema([("doc", pa.string()), ("item", pa.string()), ("n_shingles", pa.int32()), ("n_found", pa.int32()), ("containment", pa.float64())])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2 << 20):
            rows = []
            for d, t, i, item in zip(batch["doc"].to_pylist(), texts(batch["text"]), batch["item"].to_pylist(), texts(batch["item_text"]), strict=True):
                rows += [(d, i, n, hits, hits / n) for _, n, hits in Items([(0, item)], size, threshold).found_in(t)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), checked, strict=True)], schema=checked)

    found = both.mapInArrow(verify, "doc string, item string, n_shingles int, n_found int, containment double")
    if by_text:
        return found.select("doc").distinct()
    docs, items = source.select("doc_id", F.md5("text").alias("doc")), tests.select("item_id", F.md5("item").alias("item"))
    return found.join(docs, "doc").join(items, "item").select("doc_id", "item_id", "n_shingles", "n_found", "containment")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", size: int = 5, threshold: float = 0.8, broadcast_mb: float = 8) -> DataFrame:
    """The documents that hold no test item, with all their columns; rows with equal or null ids are judged each by
    their own text."""
    tests = _tests(items, item_id_col, item_text_col)
    make = _small(tests, size, threshold, broadcast_mb)
    if make is None:
        source = docs.select(F.lit(None).cast("long").alias("doc_id"), quoted(text_col).alias("text"))
        hit = own_name("hit", *docs.columns)
        hits = _by_shuffle(source, tests, size, threshold, by_text=True).toDF(hit)
        return docs.join(hits, F.md5(quoted(text_col)) == F.col(hit), "left_anti")

    held: list[Items] = []

    def clean(given: list[bytes]) -> list[bool]:
        if not held:
            held.append(make())
        return [not held[0].found_in(t) for t in given]

    return kept_rows(docs, text_col, clean)
