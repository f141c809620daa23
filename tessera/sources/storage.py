"""Where intermediate tables go."""

from __future__ import annotations

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which the driver and all executors share.

    Only where neither that setting nor a checkpoint folder exists (a local session, as in tests) does this
    set one of its own; on a cluster that is an error, since a machine-local folder would lose data.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named and not (named := context.getCheckpointDir()):
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        named = "/tmp/checkpoints/tessera"
        context.setCheckpointDir(named)
    return named.rstrip("/")
