"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each source's documents, in a shuffled order (by MD5 of their id; without one, of their row's number), form a stream
of words that repeats; the stream is cut into blocks of `block_words` words. Slot i of the mix gets the point i * g mod 2^31 of a golden-
ratio sequence, which falls into one source's interval of the cumulative target weights; the k-th slot of a
source takes the k-th block of its stream, until the source's target is reached, where its last block is cut.
Slots that the sequence gives a source short of its target come after the others.

Targets share the whole by weight but stop at `most` times a source's size; what is over is shared again by
weight. That fixpoint has a closed form over sources sorted by size per weight, found with running sums.

All of it is DataFrame functions, over numbers of rows and sizes; texts are read for their sizes and, to write the
mix, once more. Positions in a stream are running sums within ranges of the shuffled order (as many as there are
partitions, or more) plus the sums of the ranges before, so a source that holds a third of all rows is many tasks;
slots are ranked within chunks in the same way. Only the number of slots, one number, comes to the driver.

Defined results: a null or empty text has size 0 and is taken 0 times; a null source is a source and comes
last; repeated rows are mixed each, in the order of size, text's hash and row's number; columns of any name and type
(maps too) are carried; with no words at all targets and taken are 0; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import own_name, partitions, quoted, written

WORD = r"[^\x20\x09-\x0D]+"
POINTS = 1 << 31
#: 2^31 divided by the golden ratio, made odd.
GOLDEN = 1_327_217_885
BLOCK_WORDS = 1024
CHUNK = 1 << 14
CELLS = 4096


def size_of(text: Column) -> Column:
    """Number of words."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """sizes(source, source_size) -> the same with sid (by code point, null last), weight, target and the ends
    of its interval low, high in 0 .. 1.

    One task orders the sources, a dimension of few values; its running sums don't hold rows.
    """
    ordered = sizes.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int")).cast("long")
    cap = (F.col("source_size") * most).alias("cap")
    known = ordered.withColumn("weight", weight).withColumn("cap", cap)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    summed = known.select(
        "*",
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("caps"),
        F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("passed"),
        F.sum("source_size").over(everything).alias("total"),
        F.sum("weight").over(everything).alias("all_weights"),
    )
    # Level (words a unit of weight) if the sources before this one, by ratio, stop at their caps and no other does.
    level = (F.col("total") - F.col("caps")).cast("double") / (F.col("all_weights") - F.col("passed"))
    levels = summed.withColumn("level", level).withColumn("open", F.col("cap") >= F.col("level") * F.col("weight"))
    final = levels.withColumn("final", F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), "sid", "level"))).over(everything)["level"])
    target = F.when(F.col("final").isNull() | (F.col("cap") < F.col("final") * F.col("weight")), F.col("cap").cast("double")).otherwise(F.col("final") * F.col("weight"))
    aimed = final.withColumn("target", target)
    running = Window.orderBy("sid")
    ends = aimed.withColumn("high", F.coalesce(F.try_divide(F.sum("target").over(running), F.sum("target").over(everything)), F.lit(0.0)))
    return ends.withColumn("low", F.coalesce(F.lag("high").over(running), F.lit(0.0))).select("source", "source_size", "sid", "weight", "target", "low", "high")


def streams(sized: DataFrame, aims: DataFrame) -> DataFrame:
    """sized(row, id, mark, source, size) with the columns of aims and at: the words before the document in its
    source's stream."""
    parts = max(CELLS, partitions(sized.sparkSession))
    order = F.md5(F.coalesce("id", F.concat(F.lit("row "), F.col("row").cast("string"))).cast("binary"))
    near = sized.join(aims, sized["source"].eqNullSafe(aims["source"])).drop("source").withColumn("shuffled", order)
    # The first eight hex digits cut the shuffled order into ranges.
    first = F.conv(F.substring("shuffled", 1, 8), 16, 10).cast("long")
    ranged = near.withColumn("range", F.shiftright(first * parts, 32))
    sums = ranged.groupBy("sid", "range").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("sid").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("sid", "range", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("sid", "range").orderBy("shuffled", F.col("id").cast("long"), "id", "size", "mark", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = placed.join(offsets, ["sid", "range"])
    return joined.withColumn("at", F.col("offset") + F.col("inside")).drop("offset", "inside", "range", "shuffled", "mark", "id")


def copies(stream: DataFrame, most: int = 3) -> DataFrame:
    """One row for each time that a document is taken: start (its place in the repeated stream) and words (of it)."""
    goal = F.round("target").cast("long")
    turns = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda e: F.col("at") + e * F.col("source_size"))
    taken = F.transform(F.filter(turns, lambda s: (s < goal) & (F.col("size") > 0)), lambda s: F.struct(s.alias("start"), F.least(F.col("size"), goal - s).alias("words")))
    return stream.withColumn("copy", F.explode_outer(taken)).withColumns({"start": F.col("copy.start"), "words": F.coalesce("copy.words", F.lit(0))}).drop("copy")


def schedule(spark, aims: DataFrame, total: int, block_words: int) -> DataFrame:
    """slot, sid, block: the block of each source that each slot of the mix takes."""
    slots = -(-total // block_words)
    needed = F.ceil(F.round("target") / block_words).cast("long")
    point = (F.col("id") % POINTS * GOLDEN % POINTS) / F.lit(float(POINTS))
    drawn = spark.range(slots).select(F.col("id").alias("slot"), point.alias("point")).withColumn("cell", F.floor(F.col("point") * CELLS).cast("int"))
    first, last = F.floor(F.col("low") * CELLS).cast("int"), F.least(F.floor(F.col("high") * CELLS).cast("int"), F.lit(CELLS - 1))
    parts = aims.where("high > low").select("sid", "low", "high", F.explode(F.sequence(first, last)).alias("cell"))
    given = drawn.join(parts, "cell").where("point >= low and point < high").select("slot", "sid", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    counts = given.groupBy("chunk", "sid").agg(F.count("*").alias("n"))
    before = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    ranked = given.withColumn("rank", F.row_number().over(Window.partitionBy("chunk", "sid").orderBy("slot")) - 1).join(offsets, ["chunk", "sid"])
    placed = ranked.select("slot", "sid", (F.col("rank") + F.col("offset")).alias("block"))
    inside = placed.join(aims.select(F.col("sid").alias("of"), needed.alias("needed")), F.col("sid") == F.col("of")).where("block < needed").select("slot", "sid", "block")
    got = counts.groupBy("sid").agg(F.sum("n").alias("got"))
    short = aims.join(got, "sid", "left").select("sid", needed.alias("needed"), F.coalesce("got", F.lit(0)).alias("got")).where("needed > got")
    rest = short.select("sid", F.explode(F.sequence(F.col("got"), F.col("needed") - 1)).alias("block"))
    return inside.unionByName(rest.select((F.col("block") * 1_000_000 + F.col("sid") + slots).alias("slot"), "sid", "block"))


def _aimed(sized: DataFrame, weights: tuple[int, ...], most: int) -> tuple[DataFrame, int]:
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    aims = written(targets(sums, weights, most), "targets")
    return aims, aims.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    """Written, so that each row keeps its number: row, id (as text), mark (of the text), source, size, and more."""
    text = quoted(text_col)
    numbered = (F.monotonically_increasing_id().alias("row"), quoted(id_col).cast("string").alias("id"), F.xxhash64(text).alias("mark"))
    return written(docs.select(*numbered, quoted(source_col).alias("source"), size_of(text).alias("size"), *more), "sizes", "zstd")


def _pieces(sized: DataFrame, weights: tuple[int, ...], most: int, block_words: int) -> tuple[DataFrame, DataFrame, int]:
    """Each copy that the mix takes of each row (or a null one), the slots of each block, and how many slots are drawn."""
    known = sized.select("row", "id", "mark", "source", "size")
    aims, total = _aimed(known, weights, most)
    slots = schedule(sized.sparkSession, aims, total, block_words).withColumnRenamed("block", "k").withColumnRenamed("sid", "of")
    return copies(streams(known, aims), most), slots, max(-(-total // block_words), 1)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row for each piece of a document in a slot of the mix: row, doc_id, size, source_size, target, slot, words;
    a document that isn't taken has one row with a null slot and no words."""
    sized = _sized(docs, id_col, text_col, source_col, quoted(id_col).cast("long").alias("doc_id"))
    taken, slots, _ = _pieces(sized, weights, most, block_words)
    first, last = F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("words") - 1) / block_words)
    pieces = taken.withColumn("block", F.explode_outer(F.when(F.col("words") > 0, F.sequence(first, last))))
    inside = F.least(F.col("start") + F.col("words"), (F.col("block") + 1) * block_words) - F.greatest("start", F.col("block") * block_words)
    # Rows that aren't taken go to blocks that no schedule has, many of them.
    spread = F.coalesce("block", -1 - F.pmod(F.xxhash64("row"), F.lit(1 << 20)))
    cut = pieces.withColumns({"words": F.coalesce(inside, F.lit(0)).cast("long"), "block": spread})
    joined = cut.join(slots, (cut["sid"] == slots["of"]) & (cut["block"] == slots["k"]), "left")
    named = joined.select("row", "sid", "size", "source_size", "target", "slot", F.when(F.col("slot").isNull(), 0).otherwise(F.col("words")).alias("words"))
    return named.join(sized.select("row", "doc_id"), "row")


def taken_words(mixed: DataFrame) -> DataFrame:
    """One row for each document of mix(): doc_id, size, source_size, target, taken, and where the schedule puts it:
    first_slot and last_slot (null if it isn't taken) and n_pieces."""
    of_row = mixed.groupBy("row", "doc_id", "size", "source_size", "target")
    each = of_row.agg(F.sum("words").cast("long").alias("taken"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"), F.count("slot").alias("n_pieces"))
    return each.drop("row")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix as documents with all their columns: one row for each time that one is taken, in the order of the
    slots where they start, from partition to partition. Only the document where a source's target is reached is cut,
    after the words that the mix takes of it."""
    columns = docs.columns
    held = _sized(docs, id_col, text_col, source_col, *[quoted(c).alias(f"c{k}") for k, c in enumerate(columns)])
    taken, slots, drawn = _pieces(held, weights, most, block_words)
    begun = taken.where("words > 0").withColumn("block", F.floor(F.col("start") / block_words))
    placed = begun.join(slots, (begun["sid"] == slots["of"]) & (begun["block"] == slots["k"])).select("row", "slot", "start", "words")
    text = f"c{columns.index(text_col)}"
    whole = placed.join(held.drop("id", "mark", "source"), "row")
    cut = F.when(F.col("words") < F.col("size"), F.array_join(F.slice(F.regexp_extract_all(F.col(text), F.lit(f"({WORD})"), F.lit(1)), F.lit(1), F.col("words").cast("int")), " "))
    slot, start = own_name("slot", *columns), own_name("start", *columns)
    named = [(F.coalesce(cut, F.col(text)) if c == text_col else F.col(f"c{k}")).alias(c) for k, c in enumerate(columns)]
    rows = whole.select(*named, F.col("slot").alias(slot), F.col("start").alias(start))
    # Slots in a row share a partition; those after the drawn ones are in the last.
    parts = partitions(docs.sparkSession)
    part = F.least(F.floor(F.col(slot) * parts / drawn), F.lit(parts - 1)).cast("int")
    return rows.repartitionById(parts, part).sortWithinPartitions(slot, start).select(*[quoted(c) for c in columns])
