"""Token-ID output: Arrow IPC files whose batches are fixed-size lists, read back through a memory map.

Texts are encoded where they are read, so what crosses the network is token ids, compressed. Documents are dealt into ranges of
doc_id (or of another order), as many as there are partitions; each range becomes one file with the ranges' order, so
the files in order hold the ids in ascending order of documents. A file's ids are cut into sequences of one length:
columns `ids` and `mask` are fixed-size lists (mask 0 marks padding after the file's last id), batches hold equal
numbers of sequences, and sequence k of a file lies at a place that follows from k alone; both columns are whole bytes
and read without a copy. Beside it a second file lists its documents (doc_id, where they start, how many ids).

Both are written under a name of their own and then renamed, so a task that runs again replaces them whole.

A batch's distinct pieces between single spaces and line ends go through the tokenizer once, and a worker remembers
them up to a bound in bytes: byte-level BPE never merges across a lone space or line end between other characters, so
pieces encode as they do in the whole text. Texts with any other white space go through the tokenizer whole.

Defined results: null and empty texts give the end id alone; a null id sorts last; rows with equal ids are all
written, ordered by a hash of their compressed token ids; where one id (or none) fills several ranges, its rows
are dealt over them in that order. An empty table gives no files and no rows.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import NULL_ID, hash_share, id_or_last, partitions, quoted, range_bounds, range_bucket, shared_folder, slices, texts, unpacked, worker_memory

#: How many pieces a Python worker remembers, and near how many bytes; past either it learns others for the batch at
#: hand only.
PIECES, PIECES_BYTES = 1_000_000, 64 << 20
#: Bytes of a remembered piece besides its characters and ids.
PIECE_COST = 140
#: Characters that are neither letters nor numbers, and a bound below which every version of Unicode knows letters.
MARKS, OLD_LETTERS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", "\u0600"
#: White space other than spaces and line ends.
OTHER_SPACE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

FILE_DDL = "file int, path string, n_ids long"


def plain(text: str) -> bool:
    """Whether all white space is single spaces and single line ends between other characters."""
    if text == "" or text[0].isspace() or text[-1].isspace() or "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
        return False
    return not any(c in text for c in (OTHER_SPACE[:8] if text.isascii() else OTHER_SPACE))


class Encoder:
    """Ids of texts by a byte-level tokenizers file, with a bounded memory of pieces.

    A piece is the characters from one space or line end to the next; a line end stays in front of its piece.
    A call holds the ids and places of one batch beside that memory.
    """

    def __init__(self, tokenizer_path: str, dtype: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype = Tokenizer.from_file(tokenizer_path), np.dtype(dtype)
        self.line_end = self.tokenizer.encode("a\nb", add_special_tokens=False).ids[1]
        self.known: dict[str, bytes] = {"": b"", "\n": np.array([self.line_end], self.dtype).tobytes()}
        self.held = 0

    @classmethod
    def of_worker(cls, tokenizer_path: str, dtype: str) -> Encoder:
        """The Python worker's own encoder, which outlives a task of this operator."""
        held = worker_memory("tokens")
        if (tokenizer_path, dtype) not in held:
            held[tokenizer_path, dtype] = cls(tokenizer_path, dtype)
        return held[tokenizer_path, dtype]

    def __call__(self, texts: list[str]) -> list[bytes]:
        size = self.dtype.itemsize
        flat, counts = self.ids(texts)
        raw, ends = flat.tobytes(), (np.cumsum(counts) * size).tolist()
        return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=False)]

    def ids(self, texts: list[str], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, with end_id after each if given, and each text's number of ids."""
        is_plain = np.fromiter(map(plain, texts), bool, len(texts))
        counts, parts = np.zeros(len(texts), "int64"), {}
        whole = self._whole([t for t, p in zip(texts, is_plain.tolist(), strict=True) if not p])
        for at, raw in zip(np.flatnonzero(~is_plain).tolist(), whole, strict=True):
            parts[at] = np.frombuffer(raw, self.dtype)
            counts[at] = len(parts[at])
        flat, own = self._plain([t for t, p in zip(texts, is_plain.tolist(), strict=True) if p])
        counts[is_plain] = own
        ends = int(end_id is not None)
        out = np.empty(int(counts.sum()) + ends * len(texts), self.dtype)
        stops = np.cumsum(counts + ends)
        keep = np.ones(len(out), bool)
        if ends:
            out[stops - 1] = end_id
            keep[stops - 1] = False
        for at, part in parts.items():
            a = stops[at] - counts[at] - ends
            out[a : a + len(part)] = part
            keep[a : a + len(part)] = False
        out[keep] = flat
        return out, counts + ends

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids in a row and their number for each text; pieces are split, made distinct and put back by Arrow and numpy."""
        if not texts:
            return np.empty(0, self.dtype), np.empty(0, "int64")
        spaced = ["\n" + t.replace("\n", " \n") for t in texts]
        split = pc.split_pattern(pa.array(spaced, pa.large_string()), " ")
        coded = split.flatten().dictionary_encode()
        known, size = self.known, self.dtype.itemsize
        distinct = coded.dictionary.to_pylist()
        learned = self._learn([p for p in distinct if p not in known])
        values = [known[p] for p in distinct]
        if len(known) > PIECES or self.held > PIECES_BYTES:
            for p in learned:
                self.held -= self._cost(p, known.pop(p))
        lengths = np.fromiter(map(len, values), "int64", len(values)) // size
        table, begins = np.frombuffer(b"".join(values), self.dtype), np.cumsum(lengths) - lengths
        at = coded.indices.to_numpy()
        counts = lengths[at]
        ends = np.cumsum(counts)
        flat = table[np.repeat(begins[at] - (ends - counts), counts) + np.arange(int(ends[-1]))]
        last = split.offsets.to_numpy()[1:] - 1
        stops = ends[last]
        keep = np.ones(len(flat), bool)
        keep[np.r_[0, stops[:-1]]] = False  # the line end in front of each text
        return flat[keep], np.diff(np.r_[0, stops]) - 1

    def _cost(self, piece: str, ids: bytes) -> int:
        return PIECE_COST + len(piece) + len(ids)

    def _learn(self, new: list[str], at_once: int = 1000) -> list[str]:
        """Encode pieces, many as one text with each on a line of its own, and return what is known now. Of letters
        with marks after them the two are learned apart, since no byte-level pre-tokenizer joins them."""
        known, size = self.known, self.dtype.itemsize
        whole, apart = [], []
        for p in new:
            letters = p.rstrip(MARKS)
            tested = letters[1:] if letters[:1] == "\n" else letters
            if len(letters) < len(p) and tested.isalpha() and max(tested) < OLD_LETTERS:
                apart.append((p, letters, "\n" + p[len(letters) :]))
            else:
                whole.append(p)
        whole += {part for _, *both in apart for part in both}.difference(known, whole)
        for at in range(0, len(whole), at_once):
            part = whole[at : at + at_once]
            line = "".join([p if p[0] == "\n" else "\n " + p for p in part])
            ids = np.array(self.tokenizer.encode_batch_fast([line], add_special_tokens=False)[0].ids, dtype=self.dtype)
            starts = np.flatnonzero(ids == self.line_end)
            if len(starts) != len(part):
                raise ValueError("this tokenizer doesn't keep line ends apart")
            raw = ids.tobytes()
            cuts = (starts * size).tolist()
            ends = [*cuts[1:], len(raw)]
            known.update({p: raw[a if p[0] == "\n" else a + size : b] for p, a, b in zip(part, cuts, ends, strict=True)})
        known.update({p: known[letters] + known[marks][size:] for p, letters, marks in apart})
        learned = [*whole, *[p for p, _, _ in apart]]
        self.held += sum(self._cost(p, known[p]) for p in learned)
        return learned

    def _whole(self, texts: list[str]) -> list[bytes]:
        done = self.tokenizer.encode_batch(texts, add_special_tokens=False) if texts else []
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in done]


def _open(folder: str) -> tuple[pa.fs.FileSystem, str]:
    system, path = pa.fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    return system, path


def vocabulary_size(tokenizer_path: str) -> int:
    """One more than the largest id of a tokenizers file."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(tokenizer_path).get_vocab().values(), default=0) + 1


def _width(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, length: int = 2048, batch_sequences: int = 256, vocabulary: int | None = None, order_col: str | None = None) -> DataFrame:
    """Write the files; one row for each: file (their order), path, n_ids. Eager: the files exist on return.
    vocabulary: how many ids there are, by default what the tokenizer says. order_col: a long that the documents are
    ordered by instead of their ids."""
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    dtype = _width(max(vocabulary or vocabulary_size(tokenizer_path), end_id + 1))
    sid, place, files = id_or_last(id_col), id_or_last(order_col or id_col), partitions(spark)
    bounds = range_bounds(docs.select(place.alias("place")), "place", files, ties=True)
    system, path = _open(folder)
    system.create_dir(path, recursive=True)
    target = pa.schema([("place", pa.int64()), ("sid", pa.int64()), ("ids", pa.binary())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, pack = Encoder.of_worker(tokenizer_path, dtype), zstandard.ZstdCompressor(level=3).compress
        for part in slices(batches, 4 << 20):
            flat, counts = encoder.ids([t.decode("utf-8", "replace") for t in texts(part["text"])], end_id)
            ends = np.cumsum(counts).tolist()
            ids = [pack(flat[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=False)]
            yield pa.RecordBatch.from_arrays([part["place"], part["sid"], pa.array(ids, pa.binary())], schema=target)

    coded = docs.select(place.alias("place"), sid.alias("sid"), quoted(text_col).alias("text")).mapInArrow(encode, "place long, sid long, ids binary")
    ranged = coded.withColumn("tie", hash_share("ids"))
    file = range_bucket(F.col("place"), bounds, F.col("tie"))
    dealt = ranged.withColumn("file", file).repartitionById(files, "file").sortWithinPartitions("file", "place", "tie", "sid", "ids").select("file", "sid", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory()
        out = None
        for part in slices(batches, 4 << 20):
            for at, sid_, ids in zip(part["file"].to_pylist(), part["sid"].to_pylist(), unpacked(part["ids"]), strict=True):
                if out is None or out.file != at:
                    if out is not None:
                        yield out.close()
                    out = _TokenFile(folder, at, dtype, length, batch_sequences)
                out.add(sid_, ids)
        if out is not None:
            yield out.close()

    written = dealt.mapInArrow(run, FILE_DDL).collect()  # one row for each range
    return spark.createDataFrame(sorted((r["file"], r["path"], r["n_ids"]) for r in written), FILE_DDL)


class _TokenFile:
    """One range's file while it's being written; holds at most one batch of sequences."""

    def __init__(self, folder: str, file: int, dtype: str, length: int, batch_sequences: int):
        self.system, base = _open(folder)
        self.file, self.path, self.dtype, self.length = file, f"{base}/{file:08d}.arrow", np.dtype(dtype), length
        self.own = f"{self.path}.{uuid.uuid4().hex}"
        kind = pa.uint16() if self.dtype.itemsize == 2 else pa.uint32()
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.uint8(), length))])
        self.sink = self.system.open_output_stream(self.own)
        self.writer = pa.ipc.new_file(self.sink, self.schema)
        self.size = batch_sequences * length * self.dtype.itemsize
        self.waiting, self.held, self.n = [], 0, 0
        self.docs: list[tuple[int, int, int]] = []

    def add(self, sid: int, ids: bytes) -> None:
        count = len(ids) // self.dtype.itemsize
        self.docs.append((sid, self.n, count))
        self.n += count
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= self.size:
            whole = b"".join(self.waiting)
            for at in range(0, len(whole) - self.size + 1, self.size):
                self._write(np.frombuffer(whole, self.dtype, self.size // self.dtype.itemsize, at))
            rest = whole[len(whole) // self.size * self.size :]
            self.waiting, self.held = [rest], len(rest)

    def _write(self, ids: np.ndarray) -> None:
        missing = -len(ids) % self.length
        mask = np.ones(len(ids) + missing, "u1")
        if missing:
            mask[len(ids) :] = 0
            ids = np.r_[ids, np.zeros(missing, self.dtype)]
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> pa.RecordBatch:
        if rest := b"".join(self.waiting):
            self._write(np.frombuffer(rest, self.dtype))
        self.writer.close()
        self.sink.close()
        table = pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("doc_id", "start", "n_tokens"), zip(*self.docs, strict=True), strict=True)})
        with self.system.open_output_stream(f"{self.own}.docs") as sink, pa.ipc.new_file(sink, table.schema) as writer:
            writer.write_table(table)
        self.system.move(f"{self.own}.docs", f"{self.path}.docs")
        self.system.move(self.own, self.path)
        return pa.RecordBatch.from_pydict({"file": pa.array([self.file], pa.int32()), "path": [self.path], "n_ids": pa.array([self.n], pa.int64())})


class TokenFile:
    """Random access to one file: sequence k (ids and mask), or any span of ids, without copying where one batch holds it."""

    def __init__(self, folder: str, path: str):
        system, _ = _open(folder)
        local = isinstance(system, pa.fs.LocalFileSystem)
        self.reader = pa.ipc.open_file(pa.memory_map(path) if local else system.open_input_file(path))
        docs = pa.ipc.open_file(pa.memory_map(f"{path}.docs") if local else system.open_input_file(f"{path}.docs"))
        self.docs = docs.read_all()
        self.length = self.reader.schema.field("ids").type.list_size
        self.per_batch = self.reader.get_batch(0).num_rows if self.reader.num_record_batches else 1
        self._at, self._batch = -1, None

    def batch(self, k: int) -> pa.RecordBatch:
        if k != self._at:
            self._at, self._batch = k, self.reader.get_batch(k)
        return self._batch

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of the k-th sequence."""
        batch, row = self.batch(k // self.per_batch), k % self.per_batch
        a, b = row * self.length, (row + 1) * self.length
        ids, mask = (batch[c].flatten().to_numpy(zero_copy_only=True)[a:b] for c in ("ids", "mask"))
        return ids, mask.view(bool)

    def span(self, start: int, count: int) -> np.ndarray:
        """Ids start .. start + count of the file's stream."""
        size, parts = self.per_batch * self.length, []
        while count > 0:
            ids = self.batch(start // size)["ids"].flatten().to_numpy()[start % size : start % size + count]
            parts.append(ids)
            start, count = start + len(ids), count - len(ids)
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def read_tokens(files: DataFrame, folder: str) -> DataFrame:
    """One row for each document, from the files: doc_id, start (over all files), n_tokens, ids_crc32."""
    rows = files.orderBy("file").collect()  # one for each range
    starts = np.r_[0, np.cumsum([r["n_ids"] for r in rows])].tolist()
    spark = files.sparkSession
    listed = spark.createDataFrame([(k, r["path"], s) for k, (r, s) in enumerate(zip(rows, starts, strict=False))], "at int, path string, base long")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch["path"].to_pylist(), batch["base"].to_pylist(), strict=True):
                held = TokenFile(folder, path)
                places = list(zip(held.docs["start"].to_pylist(), held.docs["n_tokens"].to_pylist(), strict=True))
                sums = [zlib.crc32(held.span(a, n).astype("<u4").tobytes()) for a, n in places]
                ids = [None if x == NULL_ID else x for x in held.docs["doc_id"].to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([base + a for a, _ in places], pa.int64()), held.docs["n_tokens"].combine_chunks(), pa.array(sums, pa.int64())], schema=schema)

    spread = listed.repartitionById(min(max(len(rows), 1), partitions(spark)), "at")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_index(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, **options) -> DataFrame:
    """Write the files under the shared folder and describe each document as read back from them."""
    folder = f"{shared_folder(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    return read_tokens(write_tokens(docs, tokenizer_path, folder, id_col, text_col, end_id, **options), folder)
