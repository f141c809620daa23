"""As-of join: each left row with the nearest right row by an ordered key.

Both sides are unioned and dealt into ranges of the key within each `by` group; within a range one running
window carries the last (or next) right row along. What a range inherits from those before it is one row for
each range, so neither a single `by` group nor no `by` at all puts everything in one task. Ranges are quantiles of
both sides' keys; rows whose key is NULL match nothing and are dealt out evenly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The fewest ranges by default, and over how many NULL keys are dealt.
RANGES, NULL_RANGES = 64, 1024


def _number(column: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), column)
    if isinstance(dtype, (T.TimestampType, T.DateType)):
        return F.unix_micros(column.cast("timestamp"))
    return column


def _range_of(key: Column, cuts: list[float]) -> Column:
    """How many cuts lie below the key, by halving steps over a constant array."""
    if not cuts:
        return F.lit(0).cast("long")
    held = F.array(*[F.lit(c) for c in cuts])
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, more: F.when(F.get(held, at + more - 1) < key, at + more).otherwise(at)).cast("long")


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: str,
    by: list[str],
    strategy: str = "backward",
    tolerance: float | None = None,
    suffix: str = "_right",
    ranges: int | None = None,
) -> DataFrame:
    """Left rows, each with the columns of the nearest right row (NULLs if none).

    strategy: backward (right key <= left key), forward (>=) or nearest (the closer; backward on a tie). Equal
    keys match. tolerance bounds the distance, in the key's unit or microseconds for dates and times. NULL keys
    match nothing. Of right rows with equal keys, backward takes the last by its other columns, forward the
    first.
    """
    if strategy not in ("backward", "forward", "nearest"):
        raise ValueError("strategy is backward, forward or nearest")
    kind = left.schema[on].dataType
    names = {c: f"{c}{suffix}" if c in left.columns else c for c in right.columns if c not in by and c != on}
    payload = F.struct(_number(F.col(on), kind).alias("__at"), *[F.col(c).alias(n) for c, n in names.items()])
    kept = right.where(F.col(on).isNotNull())
    for b in by:
        kept = kept.where(F.col(b).isNotNull())
    head = [*[F.col(b).alias(f"__by{i}") for i, b in enumerate(by)], _number(F.col(on), kind).alias("__key")]
    row_of_left, row_of_right = F.struct("*").alias("__left"), payload.alias("__right")
    no_left = F.lit(None).cast(left.select(row_of_left).schema[0].dataType).alias("__left")
    no_right = F.lit(None).cast(kept.select(row_of_right).schema[0].dataType).alias("__right")
    both = left.select(*head, F.lit(1).alias("__side"), row_of_left, no_right).unionByName(
        kept.select(*head, F.lit(0).alias("__side"), no_left, row_of_right)
    )
    ranges = ranges or max(RANGES, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    every_key = both.select(F.col("__key").cast("double").alias("k")).where("k is not null")
    points = [i / ranges for i in range(1, ranges)]
    cuts = sorted(set(every_key.approxQuantile("k", points, 0.5 / ranges))) if points else []
    spread = -1 - F.monotonically_increasing_id() % NULL_RANGES
    ranged = both.withColumn("__range", F.when(F.col("__key").isNull(), spread).otherwise(_range_of(F.col("__key").cast("double"), cuts)))
    keys = [f"__by{i}" for i in range(len(by))]

    def nearest(back: bool) -> Column:
        """Within the range, else what the ranges before (or after) end (or start) with."""
        order = [F.col("__key"), F.col("__side"), F.col("__right")] if back else [F.col("__key").desc(), F.col("__side"), F.col("__right").desc()]
        frame = Window.partitionBy(*keys, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return F.last("__right", ignorenulls=True).over(frame)

    wanted = [s for s in ("backward", "forward") if strategy in (s, "nearest")]
    ends = ranged.where("__side = 0").groupBy(*keys, "__range").agg(*[(F.max if s == "backward" else F.min)("__right").alias(f"__end_{s}") for s in wanted])
    every = ranged.select(*keys, "__range").distinct().join(ends, [*keys, "__range"], "left")
    carried = []
    for s in wanted:
        order = F.col("__range") if s == "backward" else F.col("__range").desc()
        frame = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        carried.append(F.last(f"__end_{s}", ignorenulls=True).over(frame).alias(f"__carry_{s}"))
    carry = every.select(*[F.col(k).alias(f"{k}c") for k in keys], F.col("__range").alias("__rangec"), *carried)
    inside = ranged.withColumns({f"__in_{s}": nearest(s == "backward") for s in wanted}).where("__side = 1")
    match = F.col("__range") == F.col("__rangec")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"{k}c"))
    joined = inside.join(carry, match, "left")
    found = {s: F.when(F.col("__key").isNotNull(), F.coalesce(f"__in_{s}", f"__carry_{s}")) for s in wanted}
    for k in keys:
        found = {s: F.when(F.col(k).isNotNull(), c) for s, c in found.items()}
    if strategy == "nearest":
        joined = joined.withColumns({"__b": found["backward"], "__f": found["forward"]})
        ahead = F.col("__f.__at") - F.col("__key") < F.col("__key") - F.col("__b.__at")
        hit = F.when(F.col("__b").isNull() | ahead, F.col("__f")).otherwise(F.col("__b"))
        hit = F.coalesce(hit, F.col("__b"))
    else:
        hit = found[strategy]
    joined = joined.withColumn("__hit", hit)
    if tolerance is not None:
        joined = joined.withColumn("__hit", F.when(F.abs(F.col("__hit.__at") - F.col("__key")) <= F.lit(tolerance), F.col("__hit")))
    return joined.select("__left.*", *[F.col(f"__hit.`{n}`").alias(n) for n in names.values()])
