"""Line dedup: lines that many documents share go, but for the document with the largest id that holds one.

A line's key is the line without ASCII white space at its ends, A-Z lowered. Keys of at least `min_chars` code
points held by at least `min_docs` documents lose their lines in all other documents. Lines are exploded with
their positions and hashed (XXH3-128 of the key), documents are counted distinct for each hash, with counts summed
before the shuffle, and the texts are reassembled by position without the positions that their row loses.

One pass over the texts writes them, compressed, with the positions and hashes of their long lines, under a number
of each row's own; so a text is split twice however many lines it has, and only compressed texts cross the network.

Defined results: null and empty texts are one empty line; rows with equal ids count as one document and are each
rewritten; a row without an id counts as no document and keeps its lines; an empty table gives no rows.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import arrow_map, packed, quoted, texts, unpacked, written

SPACE = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    """The line trimmed of ASCII white space, A-Z lowered."""
    return line.strip(SPACE).lower()


def is_long(key: bytes, min_chars: int) -> bool:
    """Whether UTF-8 holds at least so many code points."""
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars)


def long_lines(text: bytes, min_chars: int) -> tuple[list[int], list[bytes]]:
    """Positions and hashes of the lines whose keys are long enough."""
    keys = [(at, line_key(line)) for at, line in enumerate(text.split(b"\n")) if len(line) >= min_chars]
    kept = [(at, xxhash.xxh3_128_digest(key)) for at, key in keys if is_long(key, min_chars)]
    return [at for at, _ in kept], [h for _, h in kept]


def drop_shared_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """One row for each document: doc_id, n_lines, n_dropped, kept_text."""
    source = docs.select(F.monotonically_increasing_id().alias("row"), quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).alias("text"))

    def split(batch: pa.RecordBatch) -> dict:
        held = [long_lines(t, min_chars) for t in texts(batch["text"])]
        return {"row": batch["row"], "doc_id": batch["doc_id"], "packed": packed(batch["text"]), "places": [p for p, _ in held], "hashes": [h for _, h in held]}

    table = written(arrow_map(source, "row long, doc_id long, packed binary, places array<int>, hashes array<binary>", split), "lines")
    exploded = table.where("doc_id is not null").select("row", "doc_id", F.explode(F.arrays_zip("places", "hashes")).alias("line"))
    held = exploded.select("row", "doc_id", F.col("line.places").alias("place"), F.col("line.hashes").alias("hash"))
    counts = held.groupBy("hash").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("keeper"))
    # As a table of its own it leaves Spark free to split a hash that very many documents hold.
    shared = written(counts.where(F.col("n") >= min_docs).select("hash", "keeper"), "shared-lines")
    lost = held.join(shared, "hash").where("doc_id < keeper").groupBy("row").agg(F.collect_list("place").alias("lost"))

    def reassemble(batch: pa.RecordBatch) -> dict:
        sizes, kept, gone = [], [], []
        for text, places in zip(unpacked(batch["packed"]), batch["lost"].to_pylist(), strict=True):
            own = text.split(b"\n")
            sizes.append(len(own))
            gone.append(len(places or ()))
            for at in places or ():
                own[at] = None
            kept.append(b"\n".join([line for line in own if line is not None]) if places else text)
        return {"doc_id": batch["doc_id"], "n_lines": sizes, "n_dropped": gone, "kept_text": pc.cast(pa.array(kept, pa.binary()), options=pc.CastOptions(pa.string(), allow_invalid_utf8=True))}

    joined = table.select("row", "doc_id", "packed").join(lost, "row", "left").select("doc_id", "packed", "lost")
    return arrow_map(joined, "doc_id long, n_lines long, n_dropped long, kept_text string", reassemble, most=2 << 20)
