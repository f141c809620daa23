"""Helpers that several corpus operators share: tables in shared storage, id ranges, Arrow batches."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator
from itertools import count
from types import ModuleType
from typing import Any

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.storage import shared_folder

#: Sorts after every document id: what a null id stands for inside the operators.
NULL_ID = 2**63 - 1


def written(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, so a lost executor costs
    a reread, and several readers don't compute df again."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def quoted(name: str) -> Column:
    """The column of that name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def own_name(label: str, *taken: str) -> str:
    """A column name that none of the taken ones equals, whatever their case."""
    lowered = {t.lower() for t in taken}
    return next(n for n in (f"__{label}{k}" for k in count()) if n not in lowered)


def partitions(spark: SparkSession) -> int:
    """How many partitions a shuffle of the session has; the operators size their own by it."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_or_last(column: str) -> Column:
    """The id as a long; null counts as the largest."""
    return F.coalesce(quoted(column).cast("long"), F.lit(NULL_ID))


def range_bounds(ids: DataFrame, column: str, buckets: int, ties: bool = False) -> np.ndarray:
    """Ascending upper bounds that cut a long column into about equal ranges; with ties, a value that fills several
    ranges is a bound several times.

    What reaches the driver is one number for each bucket, from Spark's quantile sketch; where the cuts fall
    changes only how work is dealt out.
    """
    points = [i / buckets for i in range(1, buckets)]
    cuts = ids.approxQuantile(column, points, 0.2 / max(buckets, 1)) if points else []
    points = np.sort(np.asarray(cuts, dtype="float64"))
    bounds = np.where(points >= 2.0**63, NULL_ID, np.clip(points, -(2.0**63), 2.0**63 - 1024).astype("int64"))
    return bounds if ties else np.unique(bounds)


def range_bucket(column: Column, bounds: np.ndarray, tie: Column | None = None) -> Column:
    """The index of the range that holds a long, as range_bounds cut them: how many bounds aren't above it, by halving
    steps over a constant array. tie: a double in 0 .. 1 that deals rows with one value, in its order, over all the
    ranges that the value fills."""
    if not len(bounds):
        return F.lit(0)
    # One literal, which the optimizer makes an array once, however many bounds there are.
    held = F.split(F.lit(",".join(map(str, bounds.tolist()))), ",").cast("array<long>")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])

    def count(below: Callable[[Column], Column]) -> Column:
        def step(at: Column, more: Column) -> Column:
            return F.when(below(F.get(held, at + more - 1)), at + more).otherwise(at)

        return F.aggregate(steps, F.lit(0), step)

    high = count(lambda bound: bound <= column)
    if tie is None:
        return high
    low = count(lambda bound: bound < column)
    return low + F.least(F.floor(tie * (high - low + 1)).cast("int"), high - low)


def hash_share(*columns: str) -> Column:
    """A hash of the columns as a double in 0 .. 1."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))


def packed(column: pa.Array) -> list[bytes]:
    """A batch's strings compressed; null as empty."""
    pack = zstandard.ZstdCompressor(level=1).compress
    return [pack(t) for t in texts(column)]


def unpacked(column: pa.Array) -> list[bytes]:
    """The strings that packed() compressed."""
    unpack = zstandard.ZstdDecompressor().decompress
    return [unpack(x) for x in column.to_pylist()]


def texts(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """A batch's strings as UTF-8 bytes; null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that what one step holds as Python objects is near `most` bytes, however long texts are."""
    for batch in batches:
        size = max(1, batch.num_rows * most // max(batch.nbytes, 1))
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def worker_memory(owner: str = "") -> dict[Any, Any]:
    """What an operator's tasks keep in a Python worker between them. A task of another operator drops it, so that
    a worker, which lives as long as the session, holds no more than one operator's."""
    held = vars(sys.modules.setdefault("_tessera_worker", ModuleType("_tessera_worker")))
    if held.get("owner") != owner:
        held["owner"], held["memory"] = owner, {}
    return held["memory"]


def arrow_map(df: DataFrame, schema: str, rows: Callable[[pa.RecordBatch], dict], most: int = 8 << 20) -> DataFrame:
    """mapInArrow with a function from a batch of near `most` bytes to a dict of columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory()
        for batch in slices(batches, most):
            out = rows(batch)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def kept_rows(docs: DataFrame, text_col: str, keep: Callable[[list[bytes]], list[bool]]) -> DataFrame:
    """The rows of docs whose texts pass, with columns of any name as they are. keep is called in each task, on batches."""
    from pyspark.sql.types import StructField, StructType

    places = [f"c{k}" for k in range(len(docs.columns))]
    text = places[docs.columns.index(text_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory()
        for batch in slices(batches):
            yield batch.filter(pa.array(keep(texts(batch[text])), pa.bool_()))

    schema = StructType([StructField(n, f.dataType, f.nullable) for n, f in zip(places, docs.schema, strict=True)])
    return docs.toDF(*places).mapInArrow(run, schema).toDF(*docs.columns)
