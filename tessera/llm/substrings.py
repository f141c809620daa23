"""Substring dedup: remove passages of `window` words that also start in a document with a smaller id.

Anchors of `anchor` words are hashed only at word positions whose remainder modulo a period lies in a
difference cover. For any two positions some shift below the period brings both to cover positions, so two
equal windows of period + anchor - 1 words share an aligned anchor. Work goes in rounds between groups of
documents and ranges of hashes:

1. each group sends the distinct hashes of its anchors to the ranges that they fall in;
2. each range tells the groups which of their hashes also occur in other groups;
3. each group extends shared anchors to the whole windows around them, marks those that a smaller id of the group
   has, and sends the hashes (96 bits and the range) of the others, each once, with the id;
4. each range tells the groups which of these start in a smaller id elsewhere; the groups remove the words.

What a group has worked out in round 3 (the windows and its marks, as runs and bits) passes through the exchange
of round 4 back to itself, so the last pass hashes nothing.

What travels is one packed array for each pair of group and range, not rows: a passage that a third of the
documents share is one hash for each group, however often it occurs. Documents are dealt into groups by hash
of their id and text, once, so that rows without an id, or with the same one, spread too; the three passes over
the texts read that one shuffle.

Pairs of group and range grow with the square of the partitions. Beyond `direct` ranges packets therefore go by relays:
a relay serves a cluster of groups and a block of ranges, each about the square root of all, so a group sends one bundle
for each block and a range gets one from each cluster, and replies go back the same way. That moves what is
sent twice, and bundles grow with the partitions times their square root only.

Defined results: null and empty texts have no words; a null id counts as larger than all others; rows with
equal ids aren't smaller than each other, so neither loses words to the other; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import NULL_ID, arrow_map, id_or_last, partitions, quoted, texts

#: A perfect difference cover: every remainder modulo PERIOD is a difference of two of its members.
PERIOD, COVER = 7, (0, 1, 3)
#: Groups of documents for each range of hashes: a task holds one group's texts at a time.
GROUPS = 4
COVERED = np.isin(np.arange(PERIOD), COVER)
MASK48 = (1 << 48) - 1


class _Words:
    """Words of some texts in a row: all joined by one space, with each word's bytes, text and place in the text."""

    def __init__(self, texts: list[bytes]):
        self.n = len(texts)
        split = [t.split() for t in texts]
        counts = np.array([len(w) for w in split], "int32")
        flat = list(chain.from_iterable(split))
        self.joined = b" ".join(flat)
        lengths = np.fromiter(map(len, flat), "int32", len(flat))
        self.ends = np.cumsum(lengths + 1, dtype="int32") - 1
        self.starts = self.ends - lengths
        self.text = np.repeat(np.arange(len(texts), dtype="int32"), counts)
        self.place = np.arange(len(flat), dtype="int32") - np.repeat(np.cumsum(counts, dtype="int32") - counts, counts)
        self.left = counts[self.text] - self.place

    def slices(self, at: np.ndarray, length: int) -> Iterator[bytes]:
        """The bytes of `length` words from each position."""
        joined = self.joined
        return (joined[a:b] for a, b in zip(self.starts[at].tolist(), self.ends[at + length - 1].tolist(), strict=True))

    def anchors(self, length: int) -> np.ndarray:
        """Positions of anchors: at cover places, within one text."""
        return np.flatnonzero(COVERED[self.place % PERIOD] & (self.left >= length))

    def hashes(self, at: np.ndarray, length: int) -> np.ndarray:
        return np.array([*map(xxhash.xxh3_64_intdigest, self.slices(at, length))], dtype="<u8")

    def wide_hashes(self, at: np.ndarray, length: int) -> np.ndarray:
        raw = b"".join(map(xxhash.xxh3_128_digest, self.slices(at, length)))
        return np.frombuffer(raw, dtype=[("high", ">u8"), ("low", ">u8")])


def _some(texts: list[bytes], most: int = 2 << 20) -> Iterator[list[bytes]]:
    """Runs of texts of about `most` bytes."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t)
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


def _ranges(high: np.ndarray, ranges: int) -> np.ndarray:
    """The range that each hash belongs to, by its top 32 bits."""
    return ((high >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype("int32")


def _short(hashes: np.ndarray) -> np.ndarray:
    """What travels of an anchor's hash besides its range: 48 bits."""
    return hashes & np.uint64(MASK48)


def _pack48(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view("u1").reshape(-1, 8)[:, :6]).tobytes()


def _unpack48(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), "u1")
    out[:, :6] = np.frombuffer(raw, "u1").reshape(-1, 6)
    return out.reshape(-1).view("<u8")


#: A window on its way to a range: its hash, the id, and its number within the group.
WINDOW = np.dtype([("high", "<u8"), ("low", "<u4"), ("doc", "<i8"), ("number", "<u4")])


def _read(table: pa.Table) -> list[tuple[int, bytes]]:
    """A group's documents by ascending id."""
    unpack = zstandard.ZstdDecompressor().decompress
    return sorted(zip(table["sid"].to_pylist(), map(unpack, table["packed"].to_pylist()), strict=True))


def _by_hash(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stable order by hash, and where in it each new hash starts."""
    order = np.argsort(high, kind="stable")
    new = np.r_[True, high[order][1:] != high[order][:-1]]
    if (~new[1:] & (low[order][1:] != low[order][:-1])).any():  # 64 bits collide: the other 32 decide
        order = np.lexsort((low, high))
        new = np.r_[True, (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])]
    return order, new


def _note(doc: np.ndarray, place: np.ndarray, beaten: np.ndarray, twins: np.ndarray) -> bytes:
    """A group's windows as runs (document, first start, length), one bit each for those beaten within the group, and
    pairs (window, the one that decides for it)."""
    first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (place[1:] != place[:-1] + 1)])
    runs = np.stack([doc[first], place[first], np.diff(np.r_[first, len(place)])], axis=1).astype("<u4")
    return np.array([len(runs), len(twins)], "<u8").tobytes() + runs.tobytes() + twins.astype("<u4").tobytes() + np.packbits(beaten).tobytes()


def _from_note(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each window's document and start, whether it's beaten, and the pairs."""
    n, m = np.frombuffer(raw, "<u8", 2).tolist()
    runs = np.frombuffer(raw, "<u4", 3 * n, 16).reshape(-1, 3).astype("int64")
    twins = np.frombuffer(raw, "<u4", 2 * m, 16 + 12 * n).reshape(-1, 2).astype("int64")
    total = int(runs[:, 2].sum())
    inside = np.arange(total) - np.repeat(np.cumsum(runs[:, 2]) - runs[:, 2], runs[:, 2])
    beaten = np.unpackbits(np.frombuffer(raw, "u1", -1, 16 + 12 * n + 8 * m), count=total).astype(bool)
    return np.repeat(runs[:, 0], runs[:, 2]), np.repeat(runs[:, 1], runs[:, 2]) + inside, beaten, twins


PACKET = pa.schema([("part", pa.int32()), ("grp", pa.int32()), ("note", pa.bool_()), ("packet", pa.binary())])
PACKET_DDL = "part int, grp int, note boolean, packet binary"


def _packets(split: np.ndarray, ranges: int, pieces: Callable[[int, int], bytes], group: int, note: bytes | None = None) -> pa.Table:
    """One row for each range that has anything (split: the range of each item, ascending); a note goes by a range
    that the group's number picks."""
    cuts = np.searchsorted(split, np.arange(ranges + 1))
    some = np.flatnonzero(cuts[1:] > cuts[:-1]).tolist()
    rows = [(k, group, False, pieces(int(cuts[k]), int(cuts[k + 1]))) for k in some]
    if note is not None:
        rows.append((group % ranges, group, True, note))
    return _table(rows)


def _table(rows: list[tuple[int, int, bool, bytes]]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(PACKET)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, PACKET, strict=True)], schema=PACKET)


#: Ranges up to which packets go straight: with 100 partitions a GB a packet then still holds some 30 hashes, and relays
#: would move more than they save.
DIRECT = 8192
#: What stands in a bundle: how many packets and their smallest numbers, then for each its numbers from there and its size.
BUNDLE = np.dtype([("count", "<i8"), ("part", "<i4"), ("grp", "<i4")])
HEAD = np.dtype([("part", "<u2"), ("grp", "<u2"), ("size", "<u4")])
NOTE = 1 << 31


def _bundled(table: pa.Table, part: np.ndarray, grp: np.ndarray) -> pa.Table:
    """One row for each (part, grp) that packets of the table go to next, with all of these and their own numbers."""
    if not table.num_rows:
        return table
    order = np.lexsort((grp, part))
    part, grp = part[order], grp[order]
    packets = table["packet"].to_pylist()
    packets = [packets[k] for k in order.tolist()]
    numbers = [table[name].to_numpy()[order] for name in ("part", "grp")]
    sizes = np.array([len(p) for p in packets], "<u4") | table["note"].to_numpy()[order] * np.uint32(NOTE)
    starts = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (grp[1:] != grp[:-1])]).tolist()
    rows = []
    for a, b in zip(starts, [*starts[1:], len(packets)], strict=True):
        least = [int(n[a:b].min()) for n in numbers]
        heads = np.empty(b - a, HEAD)
        heads["part"], heads["grp"], heads["size"] = *(n[a:b] - low for n, low in zip(numbers, least, strict=True)), sizes[a:b]
        raw = np.array([(b - a, *least)], BUNDLE).tobytes() + heads.tobytes() + b"".join(packets[a:b])
        rows.append((int(part[a]), int(grp[a]), False, raw))
    return _table(rows)


def _unbundled(table: pa.Table) -> pa.Table:
    """The packets of all bundles, with their own numbers."""
    rows = []
    for raw in table["packet"].to_pylist():
        n, part, grp = np.frombuffer(raw, BUNDLE, 1)[0].tolist()
        heads = np.frombuffer(raw, HEAD, n, BUNDLE.itemsize)
        sizes = heads["size"].astype("int64")
        bounds = (BUNDLE.itemsize + HEAD.itemsize * n + np.cumsum(np.r_[0, sizes & NOTE - 1])).tolist()
        own = zip((heads["part"] + np.int64(part)).tolist(), (heads["grp"] + np.int64(grp)).tolist(), (sizes >= NOTE).tolist(), strict=True)
        rows += [(*numbers, raw[a:b]) for numbers, a, b in zip(own, bounds, bounds[1:], strict=False)]
    return _table(rows)


def _replies(asked: pa.Table, some: np.ndarray, packed: bytes, size: int, counts: list[int]) -> pa.Table:
    """To each asking packet those of its items that are marked; packed has them all in order, `size` bytes each."""
    ends = np.cumsum(np.r_[0, some])[np.cumsum([0, *counts])] * size
    rows = zip(asked["part"].to_pylist(), asked["grp"].to_pylist(), ends.tolist(), ends[1:].tolist(), strict=False)
    return _table([(part, group, False, packed[a:b]) for part, group, a, b in rows if b > a])


def _mixed(part: np.ndarray, short: np.ndarray) -> np.ndarray:
    """One word for a range and 48 bits of hash; two that coincide only add candidates."""
    return short ^ (part.astype("<u8") * np.uint64(0x9E3779B97F4A7C15))


DONE = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("kept_sha256", pa.string())])



def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, with_text: bool = True, direct: int = DIRECT) -> DataFrame:
    """One row for each document: doc_id, n_words, n_removed, kept_text (or null), kept_sha256. direct: how many ranges
    there may be for packets to go straight to them; it changes the way, not the result."""
    if window < PERIOD:
        raise ValueError(f"a window has at least {PERIOD} words")
    spark = docs.sparkSession
    ranges = partitions(spark)
    groups = GROUPS * ranges
    anchor = window - PERIOD + 1
    relayed = ranges > direct
    block, cluster = math.isqrt(ranges - 1) + 1, math.isqrt(groups - 1) + 1

    def send(packets: pa.Table) -> pa.Table:
        return _bundled(packets, packets["part"].to_numpy() // block, packets["grp"].to_numpy() // cluster) if relayed else packets

    def opened(packets: pa.Table) -> pa.Table:
        return _unbundled(packets) if relayed else packets

    def to_ranges(table: pa.Table) -> pa.Table:
        packets = _unbundled(table)
        return _bundled(packets, packets["part"].to_numpy(), packets["grp"].to_numpy() // cluster)

    def to_groups(table: pa.Table) -> pa.Table:
        packets = _unbundled(table)
        return _bundled(packets, packets["part"].to_numpy() // block, packets["grp"].to_numpy())

    def by_relay(packets: DataFrame, onward: Callable[[pa.Table], pa.Table]) -> DataFrame:
        return packets.groupBy("part", "grp").applyInArrow(onward, PACKET_DDL) if relayed else packets

    sid = id_or_last(id_col)
    source = docs.select(F.pmod(F.xxhash64(sid, quoted(text_col)), F.lit(groups)).cast("int").alias("grp"), sid.alias("sid"), quoted(text_col).alias("text"))

    def pack(batch: pa.RecordBatch) -> dict:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        return {"grp": batch["grp"], "sid": batch["sid"], "packed": [squeeze(t) for t in texts(batch["text"])]}

    dealt = arrow_map(source, "grp int, sid long, packed binary", pack).repartition(ranges, "grp")

    def ask(table: pa.Table) -> pa.Table:
        each = []
        for run in _some([t for _, t in _read(table)]):
            words = _Words(run)
            each.append(np.unique(words.hashes(words.anchors(anchor), anchor)))
        distinct = np.unique(np.concatenate(each))
        values = _short(distinct)
        return send(_packets(_ranges(distinct, ranges), ranges, lambda a, b: _pack48(values[a:b]), table["grp"][0].as_py()))

    def answer(table: pa.Table) -> pa.Table:
        table = opened(table)
        packets = table["packet"].to_pylist()
        every = _unpack48(b"".join(packets))
        order = np.argsort(every, kind="stable")
        begins = np.flatnonzero(np.r_[True, every[order][1:] != every[order][:-1]])
        sizes = np.diff(np.r_[begins, len(every)])
        shared = np.empty(len(every), bool)
        shared[order] = np.repeat(sizes > 1, sizes)
        return send(_replies(table, shared, _pack48(every[shared]), 6, [len(p) // 6 for p in packets]))

    def candidates(raws: list[bytes], answers: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows around an anchor that another text has: their text's number, their start in it, their hash."""
        runs = [_Words(run) for run in _some(raws)]
        at = [w.anchors(anchor) for w in runs]
        every = np.concatenate([w.hashes(a, anchor) for w, a in zip(runs, at, strict=True)])
        first = np.cumsum([0, *[w.n for w in runs]]).tolist()
        owner = np.concatenate([w.text[a] + f for w, a, f in zip(runs, at, first, strict=False)])
        order = np.argsort(every, kind="stable")
        begins = np.flatnonzero(np.r_[True, every[order][1:] != every[order][:-1]]) if len(every) else np.empty(0, "int64")
        distinct = every[order][begins]
        shared = np.minimum.reduceat(owner[order], begins) < np.maximum.reduceat(owner[order], begins) if len(every) else np.empty(0, bool)
        part, short = _ranges(distinct, ranges), _short(distinct)
        packets = answers["packet"].to_pylist()
        told = np.repeat(answers["part"].to_numpy(), [len(p) // 6 for p in packets])
        shared |= np.isin(_mixed(part, short), _mixed(told, _unpack48(b"".join(packets))))
        hit = np.empty(len(every), bool)
        hit[order] = np.repeat(shared, np.diff(np.r_[begins, len(every)]))
        text, place, wide = [], [], []
        for w, a, h, f in zip(runs, at, np.split(hit, np.cumsum([len(a) for a in at])[:-1]), first, strict=False):
            back = np.arange(PERIOD)[None, :]
            near = a[h][:, None] - back
            near = np.unique(near[back <= w.place[a[h]][:, None]])
            near = near[w.left[near] >= window]
            wide.append(w.wide_hashes(near, window))
            text.append(w.text[near] + f)
            place.append(w.place[near])
        return np.concatenate(text), np.concatenate(place), np.concatenate(wide)

    def ask_windows(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _table([])
        docs = _read(left)
        text, place, wide = candidates([t for _, t in docs], opened(right))
        if not len(wide):
            return _table([])
        doc = np.array([sid_ for sid_, _ in docs], "int64")[text]
        high, low = wide["high"].astype("<u8"), wide["low"].astype("<u4")
        order, new = _by_hash(high, low)
        # Windows are numbered by ascending id, so the first of a hash decides for the others.
        leader = order[np.flatnonzero(new)][np.cumsum(new) - 1]
        same = doc[order] == doc[leader]
        beaten = np.zeros(len(doc), bool)
        beaten[order[~same]] = True
        follows = same & (order != leader)
        sent = np.empty(int(new.sum()), WINDOW)
        first = order[new]
        sent["high"], sent["low"], sent["doc"], sent["number"] = high[first], low[first], doc[first], first
        note = _note(text, place, beaten, np.stack([order[follows], leader[follows]], axis=1))
        return send(_packets(_ranges(sent["high"], ranges), ranges, lambda a, b: sent[a:b].tobytes(), left["grp"][0].as_py(), note))

    def answer_windows(table: pa.Table) -> pa.Table:
        table = opened(table)
        is_note = table["note"].to_numpy()
        notes = table.filter(pa.array(is_note))
        own = table.filter(pa.array(~is_note))
        if not own.num_rows:
            return send(notes)
        packets = own["packet"].to_pylist()
        every = np.frombuffer(b"".join(packets), WINDOW)
        order, new = _by_hash(every["high"], every["low"])
        least = np.minimum.reduceat(every["doc"][order], np.flatnonzero(new))[np.cumsum(new) - 1]
        beaten = np.empty(len(every), bool)
        beaten[order] = least < every["doc"][order]
        answered = _replies(own, beaten, every["number"][beaten].tobytes(), 4, [len(p) // WINDOW.itemsize for p in packets])
        return send(pa.concat_tables([answered, notes]))

    def finish(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return DONE.empty_table()
        docs, right = _read(left), opened(right)
        cuts, place = np.zeros(len(docs) + 1, "int64"), np.empty(0, "int64")
        beaten = np.empty(0, bool)
        replies = list(zip(right["note"].to_pylist(), right["packet"].to_pylist(), strict=True))
        if notes := [p for note, p in replies if note]:
            doc, place, beaten, twins = _from_note(notes[0])
            for _, packet in (r for r in replies if not r[0]):
                beaten[np.frombuffer(packet, "<u4")] = True
            beaten[twins[:, 0]] |= beaten[twins[:, 1]]
            cuts = np.searchsorted(doc, np.arange(len(docs) + 1))
        out: list[list] = [[], [], [], [], []]
        for (sid_, raw), a, b in zip(docs, cuts.tolist(), cuts[1:].tolist(), strict=False):
            words, gone, removed = raw.split(), place[a:b][beaten[a:b]], 0
            if len(gone):
                depth = np.zeros(len(words) + 1, "int64")
                depth[gone] += 1
                depth[gone + window] -= 1
                covered = np.cumsum(depth[:-1]) > 0
                removed = int(covered.sum())
                words = [x for x, c in zip(words, covered.tolist(), strict=True) if not c]
            kept = b" ".join(words)
            row = (None if sid_ == NULL_ID else sid_, len(words) + removed, removed, kept.decode("utf-8", "replace") if with_text else None, hashlib.sha256(kept).hexdigest())
            for column, value in zip(out, row, strict=True):
                column.append(value)
        return pa.table([pa.array(c, f.type) for c, f in zip(out, DONE, strict=True)], schema=DONE)

    by_group = dealt.groupBy("grp")
    asked_anchors = by_relay(by_group.applyInArrow(ask, PACKET_DDL), to_ranges)
    known = by_relay(asked_anchors.groupBy("part").applyInArrow(answer, PACKET_DDL), to_groups)
    asked = by_relay(by_group.cogroup(known.groupBy("grp")).applyInArrow(ask_windows, PACKET_DDL), to_ranges)
    beaten = by_relay(asked.groupBy("part").applyInArrow(answer_windows, PACKET_DDL), to_groups)
    return by_group.cogroup(beaten.groupBy("grp")).applyInArrow(finish, "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string")
