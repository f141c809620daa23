"""Document fingerprints: a canonical exact digest, grouped wide and compared byte by byte.

The canonical form of a text is its Unicode NFKC form, case-folded, with every run of white space made one
space. Its fingerprint is the XXH3 128-bit digest of that form. Documents whose digests are equal are then
compared by their canonical bytes; should two differ, the later class gets a suffix, so that equal
fingerprints mean equal canonical texts.

Texts cross the network once, compressed, dealt into ranges of doc_id, which also brings each document next to its
successor. Within a task only the first holder of a shared digest passes its bytes on; the others are compared
with it there, so a group that holds a third of the table sends one text for each task.

Defined results: a null text counts as empty; a null id sorts after all others; rows with equal ids
come in a fixed order; an empty table gives no rows; columns besides id and text aren't read.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import arrow_map, id_or_last, partitions, quoted, range_bounds, range_bucket, slices, texts, written

#: Bytes of canonical texts that a task keeps to compare others with; past it, it starts anew.
KEEP_BYTES = 64 << 20


def canonical(text: bytes) -> bytes:
    """NFKC, case folding, NFKC again (folding can undo it), white space folded to single spaces."""
    if text.isascii():
        folded = text.decode().lower()
    else:
        s = text.decode("utf-8", "replace")
        folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", s).casefold())
    return " ".join(folded.split()).encode()


def digest(canon: bytes, bits: int = 128) -> str:
    """Hex of the top `bits` of the XXH3 128-bit digest."""
    return xxhash.xxh3_128_hexdigest(canon)[: bits // 4]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bits: int = 128) -> DataFrame:
    """One row for each document, in relation to the next by id (after the last comes the first).

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, group_id.
    The edited text has its last quarter (code points, rounded down) replaced by as many from the start of the
    next document. An exact digest knows no degrees: likeness is 1.0 if the canonical bytes are equal, else 0.0.
    group_id is the smallest id among documents with the same canonical text.
    """
    spark = docs.sparkSession
    source = docs.select(quoted(id_col).cast("long").alias("doc_id"), id_or_last(id_col).alias("sid"), quoted(text_col).alias("text"))

    def digests(batch: pa.RecordBatch) -> dict:
        return {"sid": batch["sid"], "digest": [digest(canonical(t), digest_bits) for t in texts(batch["text"])]}

    ids = written(arrow_map(source.select("sid", "text"), "sid long, digest string", digests), "digests")
    bounds = range_bounds(ids, "sid", partitions(spark))
    bucket = range_bucket(F.col("sid"), bounds)

    # The first document of each range is also sent to the range before, as the last one's successor.
    firsts = sorted((r["bucket"], r["first"]) for r in ids.groupBy(bucket.alias("bucket")).agg(F.min("sid").alias("first")).collect())
    before = {first: firsts[i - 1][0] for i, (_, first) in enumerate(firsts)}

    def deal(batch: pa.RecordBatch) -> dict:
        pack = zstandard.ZstdCompressor(level=1).compress
        sids = batch["sid"].to_numpy()
        own = np.searchsorted(bounds, sids, side="right").tolist()
        packed = [pack(t) for t in texts(batch["text"])]
        rows = list(zip(own, [0] * len(own), sids.tolist(), batch["doc_id"].to_pylist(), packed, strict=True))
        rows += [(before[sid], 1, sid, doc_id, raw) for _, _, sid, doc_id, raw in rows if sid in before]
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        return dict(zip(("bucket", "guard", "sid", "doc_id", "packed"), columns, strict=True)) | {"kind": [1] * len(rows)}

    row = "bucket int, guard int, sid long, kind int, doc_id long, packed binary"
    rows = arrow_map(source, row, deal)

    counts = written(ids.groupBy("digest").count().where("count > 1").select("digest"), "shared-digests")
    marks = ids.join(counts, "digest").select(bucket.alias("bucket"), F.lit(0).alias("guard"), "sid", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("packed"))
    dealt = rows.unionByName(marks).repartition(partitions(spark), "bucket").sortWithinPartitions("bucket", "guard", "sid", "kind", "packed")

    schema = "doc_id long, sid long, n_chars long, edited_sha256 string, digest string, edited_fingerprint string, near_edited double, near_next double, same_as long, canon binary"
    result = written(dealt.mapInArrow(_successors(digest_bits), schema), "fingerprints")

    classes = (
        result.where("canon is not null")
        .withColumn("group_id", F.min("sid").over(Window.partitionBy("digest", "canon")))
        .withColumn("place", F.dense_rank().over(Window.partitionBy("digest").orderBy("canon")))
        .select("same_as", F.col("digest").alias("of"), "group_id", "place")
        .dropDuplicates(["same_as", "of"])
    )
    joined = result.drop("canon").join(classes, (result["same_as"] == classes["same_as"]) & (result["digest"] == classes["of"]), "left")
    group = F.coalesce("group_id", result["sid"])
    return joined.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.when(F.col("place") > 1, F.concat_ws("-", "digest", F.col("place").cast("string"))).otherwise(F.col("digest")).alias("fingerprint"),
        "edited_fingerprint",
        "near_edited",
        "near_next",
        F.when(F.col("doc_id").isNull() & (group == result["sid"]), F.lit(None)).otherwise(group).alias("group_id"),
    )


def _successors(bits: int):
    """A task's pass over its ranges: holds one document until the next one is seen."""
    names = ("doc_id", "sid", "n_chars", "edited_sha256", "digest", "edited_fingerprint", "near_edited", "near_next", "same_as", "canon")
    schema = pa.schema([("doc_id", pa.int64()), ("sid", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("digest", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("same_as", pa.int64()), ("canon", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        kept: dict[str, tuple[int, bytes]] = {}
        kept_bytes = 0
        shared = None  # the id that a mark has announced
        held = None  # bucket, doc_id, sid, text, canonical bytes, whether its digest is shared
        done = None  # the bucket whose successor has been seen

        def row(now: tuple, text: str, canon: bytes) -> tuple:
            nonlocal kept_bytes
            _, doc_id, sid, own, own_canon, is_shared = now
            cut = len(own) // 4
            edited = own[: len(own) - cut] + text[:cut]
            changed = canonical(edited.encode("utf-8", "surrogatepass"))
            name, same_as, carried = digest(own_canon, bits), sid, None
            if is_shared:
                first = kept.get(name)
                if first and first[1] == own_canon:
                    same_as = first[0]
                else:
                    carried = own_canon
                    if not first:
                        if kept_bytes > KEEP_BYTES:
                            kept.clear()
                            kept_bytes = 0
                        kept[name] = (sid, own_canon)
                        kept_bytes += len(own_canon) + 200
            sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
            return doc_id, sid, len(own), sha, name, digest(changed, bits), float(changed == own_canon), float(canon == own_canon), same_as, carried

        for batch in batches:
            for part in slices(iter((batch,))):
                out = []
                for bucket, guard, sid, kind, doc_id, packed in zip(*[part[c].to_pylist() for c in ("bucket", "guard", "sid", "kind", "doc_id", "packed")], strict=True):
                    if kind == 0:
                        shared = sid
                        continue
                    if guard and bucket == done:
                        continue
                    raw = unpack(packed)
                    text, canon = raw.decode("utf-8", "replace"), canonical(raw)
                    if held is not None and held[0] == bucket:
                        out.append(row(held, text, canon))
                        held = None
                    if guard:
                        done = bucket
                    else:
                        held = (bucket, doc_id, sid, text, canon, sid == shared)
                yield pa.RecordBatch.from_arrays([pa.array(c, type=schema.field(n).type) for n, c in zip(names, zip(*out, strict=True) if out else [[]] * len(names), strict=True)], schema=schema)

    return run
