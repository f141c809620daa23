"""SimHash near-duplicates: 64-bit fingerprints compared as bit planes.

A fingerprint takes the majority of each bit over the hashes of a document's word shingles. Two fingerprints
link if they differ in at most `radius` bits. Exact search: the 64 bits are cut into radius + 2 blocks, so
fingerprints within the radius agree in two blocks at least; every pair of blocks is one table, and only
fingerprints with equal bits there meet. Among those, blocks of fingerprints are held as 64 bit planes (one
bit of 64 fingerprints in each machine word); XOR with a query's bits and a carry-save counter over the planes
update all distances at once, and queries whose every distance has passed the radius are abandoned.

Equal fingerprints are one row before any comparison, so copies cost nothing however many there are. A key
shared by more than `chunk` fingerprints is cut into chunks, and each pair of chunks is its own piece of work;
within a piece only links that join something new are kept, so a group's rows don't grow with its square.

Defined results: a null or empty text has fingerprint zero and links like any other; a text of fewer words
than a shingle is one shingle; a null id counts as the largest; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.shared import NULL_ID, arrow_map, id_or_last, own_name, partitions, quoted, texts, worker_memory, written

ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Runs of equal keys up to this length are compared by offset, longer ones as stored planes.
SHORT_RUN = 64
TILE = 256


def simhash(text: bytes, words: int = 4) -> int:
    """The unsigned fingerprint: A-Z lowered, words split at ASCII white space, shingles joined by a space and
    hashed by XXH64 with seed 42; a bit is one if over half of the hashes have it."""
    split = text.lower().split()
    if not split:
        return 0
    joined = b" ".join(split)
    if len(split) <= words:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, split), "int64", len(split)) + 1) - 1
        starts = [0, *(ends[:-1] + 1).tolist()]
        each, view = xxhash.xxh64_intdigest, memoryview(joined)
        hashes = [each(view[a:b], 42) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=False)]
    bits = np.unpackbits(np.array(hashes, dtype="<u8").view("u1").reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(bits.sum(axis=0, dtype="int32") * 2 > len(hashes), bitorder="little").view("<u8")[0])


def planes(values: np.ndarray) -> np.ndarray:
    """(64, n / 64 rounded up) words; bit j of word k in plane b is bit b of value 64 k + j."""
    padded = np.zeros(-(-len(values) // 64) * 64, dtype="<u8")
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view("u1").reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def beyond(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Bits of the lanes whose bit-sliced count is over the radius."""
    over, equal = np.zeros_like(counters[0]), np.full_like(counters[0], ALL)
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            equal &= counters[k]
        else:
            over |= equal & counters[k]
            equal &= ~counters[k]
    return over


def within(stored: np.ndarray, queries: np.ndarray, radius: int) -> np.ndarray:
    """For each query, lanes of the stored planes at a distance of at most radius: (queries, lanes) booleans."""
    width = stored.shape[1]
    found = np.zeros((len(queries), width), dtype="<u8")
    alive = np.arange(len(queries))
    counters = [np.zeros((len(queries), width), dtype="<u8") for _ in range(7)]
    for b in range(64):
        flip = np.where(queries[alive] >> np.uint64(b) & np.uint64(1), ALL, np.uint64(0))
        carry = stored[b][None, :] ^ flip[:, None]
        for k in range(min(7, (b + 1).bit_length())):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        if b % 8 == 7:
            over = beyond(counters, radius)
            stay = ~(over == ALL).all(axis=1)
            if b == 63:
                found[alive] = ~over
            elif not stay.all():
                alive, counters = alive[stay], [c[stay] for c in counters]
                if not len(alive):
                    break
    return np.unpackbits(found.view("u1"), axis=1, bitorder="little").astype(bool)


def pairs_within(left: np.ndarray, right: np.ndarray, radius: int) -> np.ndarray:
    """Which pairs are at a distance of at most radius: their XORs as planes, all lanes counted at once."""
    return within(planes(left ^ right), np.zeros(1, dtype="<u8"), radius)[0][: len(left)]


def joining_links(values: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Links of a spanning forest among values (distinct) within the radius of each other."""
    stored, label = planes(values), np.arange(len(values))
    left: list[int] = []
    right: list[int] = []
    for at in range(0, len(values), TILE):
        for i, row in enumerate(within(stored, values[at : at + TILE], radius)[:, : len(values)], at):
            near = np.flatnonzero(row)
            groups, first = np.unique(label[near], return_index=True)
            for group, j in zip(groups.tolist(), near[first].tolist(), strict=True):
                if group != label[i]:
                    left.append(i)
                    right.append(j)
                    label[label == group] = label[i]
    return left, right


def _links(radius: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def found(part: np.ndarray, value: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        lengths = np.diff(np.r_[starts, len(part)])
        short = np.repeat(lengths <= SHORT_RUN, lengths)
        for d in range(1, int(min(SHORT_RUN, lengths.max()))):
            i = np.flatnonzero((part[:-d] == part[d:]) & short[:-d])
            for at in range(0, len(i), 1 << 20):
                j = i[at : at + (1 << 20)]
                hit = j[pairs_within(value[j], value[j + d], radius)]
                yield value[hit], value[hit + d]
        for start, length in zip(starts[lengths > SHORT_RUN].tolist(), lengths[lengths > SHORT_RUN].tolist(), strict=True):
            run = value[start : start + length]
            left, right = joining_links(run, radius)
            yield run[left], run[right]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory()
        part, value = np.empty(0, "int64"), np.empty(0, "<u8")
        last = False
        batches = iter(batches)
        while not last:
            batch = next(batches, None)
            if last := batch is None:
                whole = len(part)
            else:
                part = np.r_[part, batch["piece"].to_numpy(zero_copy_only=False)]
                value = np.r_[value, batch["fp"].to_numpy(zero_copy_only=False).astype("int64").view("<u8")]
                whole = int(np.searchsorted(part, part[-1])) if len(part) else 0
            if whole:
                for a, b in found(part[:whole], value[:whole]):
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(a.view("int64")), pa.array(b.view("int64"))], schema=schema)
                part, value = part[whole:], value[whole:]

    return run


def fingerprint_links(values: DataFrame, radius: int = 4, chunk: int = 8192) -> DataFrame:
    """Links (a, b) between distinct fingerprints `fp` that connect all those within the radius of each other."""
    spark = values.sparkSession
    blocks = radius + 2
    edges = [64 * i // blocks for i in range(blocks + 1)]
    tables = []
    for t, (i, j) in enumerate(combinations(range(blocks), 2)):
        bits = [F.shiftrightunsigned("fp", edges[k]).bitwiseAND((1 << edges[k + 1] - edges[k]) - 1) for k in (i, j)]
        tables.append(F.shiftleft(bits[1], edges[i + 1] - edges[i]).bitwiseOR(bits[0]).bitwiseOR(F.lit(t << 56).cast("long")))
    keyed = values.select("fp", F.explode(F.array(*tables)).alias("key"))
    large = written(keyed.groupBy("key").count().where(F.col("count") > chunk), "large-keys")
    if large.isEmpty():
        pieces = keyed.select(F.col("key").alias("piece"), "fp")
    else:
        parts = F.ceil(F.col("count") / chunk).cast("int")
        cut = keyed.join(large, "key", "left").withColumn("parts", F.coalesce(parts, F.lit(1)))
        own = F.pmod(F.xxhash64("fp"), F.col("parts"))
        pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda other: F.struct(F.least(own, other).alias("i"), F.greatest(own, other).alias("j")))
        pieces = cut.withColumn("pair", F.explode(pairs)).select(F.when(F.col("parts") == 1, F.col("key")).otherwise(F.xxhash64("key", "pair.i", "pair.j")).alias("piece"), "fp")
    dealt = pieces.repartition(partitions(spark), "piece").sortWithinPartitions("piece", "fp")
    return dealt.mapInArrow(_links(radius), "a long, b long").distinct()


def _classes(docs: DataFrame, id_col: str, text_col: str, words: int, radius: int, chunk: int) -> tuple[DataFrame, DataFrame]:
    """Tables: each row's doc_id, a hash of its text (mark) and fingerprint fp; each distinct fp with its first id and
    its component, which is named by its smallest fp."""
    source = docs.select(quoted(id_col).cast("long").alias("doc_id"), F.xxhash64(quoted(text_col)).alias("mark"), quoted(text_col).alias("text"))

    def sign(batch: pa.RecordBatch) -> dict:
        values = np.array([simhash(t, words) for t in texts(batch["text"])], dtype="<u8")
        return {"doc_id": batch["doc_id"], "mark": batch["mark"], "fp": values.view("int64")}

    signed = written(arrow_map(source, "doc_id long, mark long, fp long", sign), "simhashes")
    firsts = signed.groupBy("fp").agg(F.min(id_or_last("doc_id")).alias("first"))
    linked = components(fingerprint_links(firsts.select("fp"), radius, chunk))
    classes = firsts.join(linked, firsts["fp"] == linked["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    return signed, written(classes, "simhash-classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4, chunk: int = 8192) -> DataFrame:
    """One row for each document: doc_id, fingerprint (16 hex digits), component_id (the smallest id reachable)."""
    signed, classes = _classes(docs, id_col, text_col, words, radius, chunk)
    smallest = classes.groupBy("component").agg(F.min("first").alias("component_id"))
    named = classes.join(smallest, "component").select("fp", "component_id")
    known = F.when(F.col("component_id") < NULL_ID, F.col("component_id"))
    return signed.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), known.alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4, chunk: int = 8192) -> DataFrame:
    """One document of each component, with all its columns: the one with the smallest id. Of rows with equal ids (or
    none) in a component, the one whose text has the smallest hash; different components never cost each other a row."""
    signed, classes = _classes(docs, id_col, text_col, words, radius, chunk)
    member = signed.join(classes.select("fp", "component"), "fp").select("component", F.struct(id_or_last("doc_id").alias("sid"), "mark").alias("row"))
    sid, mark = own_name("sid", *docs.columns), own_name("mark", *docs.columns)
    keep = member.groupBy("component").agg(F.min("row").alias("row")).select(F.col("row.sid").alias(sid), F.col("row.mark").alias(mark))
    named = docs.withColumns({sid: id_or_last(id_col), mark: F.xxhash64(quoted(text_col))})
    return named.join(keep, [sid, mark], "left_semi").dropDuplicates([sid, mark]).select(*[quoted(c) for c in docs.columns])
