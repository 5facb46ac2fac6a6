"""Mixing sources to target weights by weighted fair queueing.

A document's size is its number of words.  The sources, in code point order with
the missing source last, take the weights in turn and share a budget, a percentage
of all sizes.  No target exceeds `repeats` times its source's size; what a source
cannot use is shared again by weight until no target is above its limit.

Every source is a queue of its documents in shuffled order, served `repeats` times
over.  A document's virtual finish time is the number of words its queue has served
once it is through, divided by the source's target, so at any virtual time all
sources have got the same part of their targets.  The document in which a queue
reaches its target is cut there.  All queues together are put in order of the finish
time, by ranges of it, and cut off where the words reach the budget.

Everything is DataFrame and SQL functions.  The shuffle is an md5 of id and copy
number, so reruns agree and a queue falls into even cells by the leading bits: sums
over (source, cell) give the words before each cell, and a source that holds a third
of all rows is numbered in CELLS tasks.  Finish times are cut into SLOTS ranges of
equal width, which hold equally many words each, since all sources advance alike.

Null text has no words.  Null sources are one source, null ids ids like any other.
Repeated rows count each: rows equal in source, id and size are told apart by a copy
number, which their order in the queue hangs on, so that a group of copies spreads
over all cells.  A source without words has target 0.  Documents without words take
none.  An empty table gives no rows.  Only the id, text and source columns are read.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from drayage.llm.common import stage
from drayage.operators.numbering import ascending, number_rows
from drayage.operators.rows import expand_rows

WORD = r"[^\x20\x09-\x0D]+"
SEED = "mix"
#: Hexadecimal digits of the shuffle and bits in them.
DIGITS = 15
CELL_BITS = 12
CELLS = 1 << CELL_BITS
SLOTS = 4096


def shuffled(*keys: Column) -> Column:
    """A place in [0, 2 ** 60) drawn from the keys."""
    text = F.concat_ws("|", *[F.coalesce(k.cast("string"), F.lit("")) for k in keys], F.lit(SEED))
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("long")


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, source, size, copy, place and cell of every row, written once; the texts are read here alone."""
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words.alias("size"))
    alike = rows.groupBy("source", "id", "size").agg(F.count("*").alias("copies"))
    rows = expand_rows(alike, "copies", "copy").drop("copies").withColumn("place", shuffled(F.col("id"), F.col("copy")))
    return stage(rows.withColumn("cell", F.shiftright("place", 4 * DIGITS - CELL_BITS).cast("int")), "mix-rows")


def water_level(sources: DataFrame, budget: float) -> float:
    """Words for each unit of weight, once what full sources leave is shared among the others.

    Every round is one aggregation over the sources; the level only rises, and the
    rounds end when no further source is full.
    """
    level = 0.0
    while True:
        full = F.col("most") <= F.col("weight") * F.lit(level)
        held, weights = sources.agg(
            F.coalesce(F.sum(F.when(full, F.col("most"))), F.lit(0)), F.sum(F.when(~full, F.col("weight")))
        ).first()
        if not weights or (budget - held) / weights <= level:
            return level
        level = (budget - held) / weights


def targets(sizes: DataFrame, weights=(3, 1, 2), percent: int = 150, repeats: int = 2) -> tuple[DataFrame, int]:
    """(source, rank, source_size, target, cut) from (source, source_size), and the budget in whole words."""
    sources = number_rows(sizes, [ascending("source", last=True)], name="rank")
    listed = F.array(*[F.lit(int(w)) for w in weights])
    weight = F.element_at(listed, ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("long")
    sources = sources.withColumns({"weight": weight, "most": F.col("source_size") * repeats})
    sources = stage(sources, "mix-sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = water_level(sources, total * percent / 100)
    target = F.least(F.col("most").cast("double"), F.col("weight") * F.lit(level))
    known = sources.select("source", "rank", "source_size", target.alias("target"))
    return known.withColumn("cut", F.ceil("target").cast("long")), total * percent // 100


def queue(
    docs: DataFrame,
    weights=(3, 1, 2),
    percent: int = 150,
    repeats: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Every service of a row: id, size, copy, rank, source_size, target, pass, words, finish, position.

    `words` is what the mix takes of the row in that pass and `position` the number of
    words the mix holds before.  The first pass is listed for every row, with no words,
    finish or position where the mix takes none.
    """
    rows = measured(docs, id_col, text_col, source_col)
    cells = stage(rows.groupBy("source", "cell").agg(F.sum("size").alias("words")), "mix-cells")
    sizes = cells.groupBy("source").agg(F.sum("words").alias("source_size"))
    known, budget = targets(sizes, weights, percent, repeats)

    # at most CELLS rows a source
    earlier = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select("source", "cell", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("before"))
    offsets = offsets.join(known.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    offsets = offsets.withColumnsRenamed({"source": "of", "cell": "at"})
    placed = rows.join(offsets, F.col("source").eqNullSafe(F.col("of")) & (F.col("cell") == F.col("at")))

    order = Window.partitionBy("rank", "cell").orderBy("place", "id", "size", "copy")
    through = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = placed.withColumn("start", F.col("before") + through - F.col("size"))
    served = placed.withColumn("pass", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    start = F.col("start") + (F.col("pass") - 1) * F.col("source_size")
    words = F.greatest(F.lit(0), F.least(F.col("size"), F.col("cut") - start)).cast("long")
    served = served.withColumns({"start": start, "words": words}).where("words > 0 OR pass = 1")
    served = served.withColumn("finish", F.when(F.col("words") > 0, (F.col("start") + F.col("words")) / F.col("target")))
    served = served.select(
        "id", "size", "copy", "rank", "source_size", "target", "pass", "words", "finish", "place",
        F.floor(F.col("finish") * SLOTS).alias("slot"),
    )
    served = stage(served, "mix-queue")

    # one row for each range of finish times
    slots = served.where("words > 0").groupBy("slot").agg(F.sum("words").alias("held"))
    earlier = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.select("slot", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("before"))
    order = Window.partitionBy("slot").orderBy("finish", "rank", "place", "id", "size", "copy", "pass")
    within = F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")
    mixed = served.where("words > 0").join(slots, "slot").withColumn("position", F.col("before") + within)
    left = F.greatest(F.lit(0), F.least(F.col("words"), F.lit(budget) - F.col("position")))
    kept = ["id", "size", "copy", "rank", "source_size", "target", "pass", "words", "finish", "position"]
    mixed = mixed.withColumn("words", left.cast("long")).select(*kept)
    rest = served.where("words = 0").withColumn("position", F.lit(None).cast("long")).select(*kept)
    return mixed.unionByName(rest)


def in_order(services: DataFrame) -> DataFrame:
    """What the mix takes, range-sorted: each task holds a stretch of the mix."""
    return services.where("words > 0").orderBy("position")


def taken(services: DataFrame) -> DataFrame:
    """Per row of the documents: id, size, source_size, target and the words that the mix takes of it."""
    alike = ["rank", "id", "size", "copy", "source_size", "target"]
    return services.groupBy(*alike).agg(F.sum("words").cast("long").alias("taken")).drop("rank", "copy")
