"""Minimax contiguous partition of documents into shards of near equal bytes.

Equal texts form an atomic group.  Groups are ordered by a hash of their text;
neighbours with the same leading `cell_bits` bits of it form one cell, so the
ordered list of sizes has at most 2 ** cell_bits entries however many documents
there are.  The smallest capacity for which a greedy pass over that list needs
at most `shards` shards is found by binary search, and the greedy cuts at that
capacity are the shards.  A cell that alone exceeds the capacity, as a large
group of copies may, has a shard to itself and does not widen the others.

Everything is DataFrame and SQL functions.  Rows are numbered within (cell, lot)
where the lot is drawn from the id, so a group that holds a third of all rows is
numbered in many tasks.  Null text has no bytes and is equal to the empty text;
a null id is an id like any other.  Repeated rows count each and get slots of
their own.  An empty table gives no rows.  Only the id and text column are read.
"""

from pyspark.sql import DataFrame, Window, functions as F

from drayage.llm.common import stage, text_bytes

SHARDS = 16
CELL_BITS = 16
LOTS = 64


def _start():
    return F.struct(F.lit(0).alias("shard"), F.lit(0).cast("long").alias("filled"))


def _step(state, size, capacity):
    """One cell further in a greedy pass: the open shard and the bytes in it."""
    full = (state["filled"] > 0) & (state["filled"] + size > capacity)
    return F.struct(
        (state["shard"] + full.cast("int")).alias("shard"),
        F.when(full, size).otherwise(state["filled"] + size).alias("filled"),
    )


def capacity_of(sizes, shards: int):
    """The smallest capacity whose greedy pass over the array of sizes needs at most `shards` shards."""
    total = F.aggregate(sizes, F.lit(0).cast("long"), lambda a, n: a + n)
    bounds = F.struct(F.lit(1).cast("long").alias("low"), total.alias("high"))

    def halve(state, _):
        middle = F.floor((state["low"] + state["high"]) / 2).cast("long")
        fits = F.aggregate(sizes, _start(), lambda at, size: _step(at, size, middle))["shard"] < shards
        halved = F.struct(
            F.when(fits, state["low"]).otherwise(middle + 1).alias("low"),
            F.when(fits, middle).otherwise(state["high"]).alias("high"),
        )
        return F.when(state["low"] >= state["high"], state).otherwise(halved)

    return F.aggregate(F.sequence(F.lit(1), F.lit(63)), bounds, halve)["high"]


def shard_plan(cells: DataFrame, shards: int = SHARDS) -> DataFrame:
    """cell and shard, from the ordered cells (cell, bytes): at most 2 ** CELL_BITS rows, in one row as an array."""
    listed = cells.agg(F.array_sort(F.collect_list(F.struct("cell", "bytes"))).alias("cells"))
    sizes = F.transform("cells", lambda c: c["bytes"])
    known = listed.select("cells", sizes.alias("sizes"))
    known = known.select("cells", "sizes", capacity_of(F.col("sizes"), shards).alias("capacity"))

    def place(state, cell):
        now = _step(state["at"], cell["bytes"], F.col("capacity"))
        cuts = F.when(now["shard"] > state["at"]["shard"], F.array(cell["cell"])).otherwise(F.array().cast("array<long>"))
        return F.struct(now.alias("at"), F.concat(state["cuts"], cuts).alias("cuts"))

    start = F.struct(_start().alias("at"), F.array().cast("array<long>").alias("cuts"))
    cuts = F.aggregate("cells", start, place)["cuts"]
    # a cell lies in the shard that as many cuts precede
    known = known.select("cells", cuts.alias("cuts"))
    return known.select(F.explode("cells").alias("c"), "cuts").select(
        F.col("c.cell").alias("cell"), F.size(F.filter("cuts", lambda cut: cut <= F.col("c.cell"))).alias("shard")
    )


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, size, text_crc32, shard, slot (gapless from 0 in each shard)."""
    text = text_bytes(text_col)
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(text), 64 - CELL_BITS).alias("cell"),
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(LOTS)).cast("int").alias("lot"),
    )
    rows = stage(rows, "shard-rows")
    lots = stage(rows.groupBy("cell", "lot").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes")), "shard-lots")
    plan = stage(shard_plan(lots.groupBy("cell").agg(F.sum("bytes").alias("bytes")), shards), "shard-plan")
    # rows of the shard's earlier cells, then of the cell's earlier lots
    cells = lots.groupBy("cell").agg(F.sum("rows").alias("rows")).join(plan, "cell")
    earlier = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("cell", "shard", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"))
    earlier = Window.partitionBy("cell").orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)
    lots = lots.select("cell", "lot", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("within"))
    offsets = lots.join(cells, "cell").select("cell", "lot", "shard", (F.col("before") + F.col("within")).alias("first"))
    order = Window.partitionBy("cell", "lot").orderBy("id", "size", "text_crc32")
    numbered = rows.withColumn("place", F.row_number().over(order) - 1)
    return numbered.join(offsets, ["cell", "lot"]).select(
        "id", "size", "text_crc32", "shard", (F.col("first") + F.col("place")).cast("long").alias("slot")
    )
