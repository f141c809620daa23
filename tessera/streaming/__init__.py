"""Relations over streams: row-wise steps and windowed aggregates run unchanged on a streaming DataFrame."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tessera.operators.relation import Relation, relation


def read_stream(spark: SparkSession, path: str, schema: Any, format: str = "parquet", **options: Any) -> Relation:
    """A relation over files as they arrive."""
    return relation(spark.readStream.format(format).schema(schema).options(**options).load(path))


def run_available(rel: Relation, path: str, checkpoint: str, format: str = "parquet", mode: str = "append") -> None:
    """Write what has arrived, then stop; a later call goes on from the checkpoint."""
    writer = rel.compile().writeStream.format(format).outputMode(mode).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start(path).awaitTermination()


def is_stream(df: DataFrame) -> bool:
    return df.isStreaming
