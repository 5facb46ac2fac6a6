"""Row numbers and neighbours without one huge window.

A window puts all rows of a key into one task.  Keys of ordinary size are
numbered that way; keys above the hot limit (and global numbering, which has
no key) are cut into ranges of key and order instead, so that a key spans as
many tasks as it needs.  Each row then gets its position inside its own range,
plus the number of rows the key has in earlier ranges.

Ranges are fixed by written bounds, so a row's range hangs on its own values
alone: it is the same however often a task is run again.  One pass over the key
and order columns counts the rows of each range; the rows themselves are read
once, in the query that asks for them, and not written in between.
"""

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from drayage.functions.draws import format_id
from drayage.operators.joins import AUTO
from drayage.operators.skew import hot_keys
from drayage.sources.staging import stage

#: Rows sampled for each bound, and rows of a range.
SAMPLE = 20
RANGE_ROWS = 1_000_000
MOST_RANGES = 1_000


@dataclass(frozen=True)
class Order:
    """One column of an order; missing values come last where ``last`` says so."""

    name: str
    descending: bool = False
    last: bool = False

    def column(self) -> Column:
        c = F.col(self.name)
        if self.descending:
            return c.desc_nulls_last() if self.last else c.desc_nulls_first()
        return c.asc_nulls_last() if self.last else c.asc_nulls_first()

    def beyond(self, value: Column, bound: Column) -> Column:
        """The value comes after the bound."""
        after = value < bound if self.descending else value > bound
        known = value.isNotNull() & bound.isNotNull()
        missing = (value.isNull() & bound.isNotNull()) if self.last else (value.isNotNull() & bound.isNull())
        return F.coalesce(known & after, F.lit(False)) | missing


def ascending(name: str, last: bool = False) -> Order:
    return Order(name, False, last)


def descending(name: str, last: bool = True) -> Order:
    return Order(name, True, last)


def _orders(order) -> list[Order]:
    return [o if isinstance(o, Order) else ascending(o) for o in order]


def _exprs(order) -> list[Column]:
    return [o.column() for o in _orders(order)]


def _bounds(rows: DataFrame, order: list[Order], count: int) -> DataFrame:
    """One row: the array of bounds between ranges of about equal size, written once.

    Bounds only say where to cut; any will do for right numbers.
    """
    names = [o.name for o in order]
    ranges = max(1, min(MOST_RANGES, max(-(-count // RANGE_ROWS), rows.sparkSession.sparkContext.defaultParallelism)))
    wanted = ranges * SAMPLE
    sample = rows if count <= wanted else rows.sample(min(1.0, 1.2 * wanted / count), seed=11)
    # a bounded sample, in one task
    place = Window.orderBy(*[o.column() for o in order])
    ranked = sample.select(*names, F.row_number().over(place).alias("__n"))
    cuts = ranked.where(F.col("__n") % SAMPLE == 0).orderBy("__n").select(F.struct(*names).alias("b"))
    return stage(cuts.agg(F.collect_list("b").alias("bounds")), "bounds")


def _ranged(df: DataFrame, order: list[Order], bounds: DataFrame, name: str) -> DataFrame:
    """df with the number of bounds that each row lies beyond."""

    def passed(bound):
        beyond, same = F.lit(False), F.lit(True)
        for o in order:
            value = F.col(o.name)
            beyond = beyond | (same & o.beyond(value, bound[o.name]))
            same = same & value.eqNullSafe(bound[o.name])
        return beyond

    held = f"{name}_bounds"
    known = df.withColumn(held, bounds.select("bounds").scalar())
    return known.withColumn(name, F.size(F.filter(held, passed))).drop(held)


def _range_numbered(df: DataFrame, keys: list[str], order, name: str) -> DataFrame:
    by = [ascending(k) for k in keys] + _orders(order)
    columns = list(dict.fromkeys(o.name for o in by))
    thin = df.select(*columns)
    count = thin.count()
    bounds = _bounds(thin, by, count)
    of, before, key = (f"__{part}_{uuid.uuid4().hex[:6]}" for part in ("range", "before", "key"))
    ranged = _ranged(df, by, bounds, of)
    # one row per range and key in it: number of ranges + number of hot keys
    pieces = _ranged(thin, by, bounds, of).groupBy(of, *keys).agg(F.count(F.lit(1)).alias("rows"))
    earlier = Window.partitionBy(*keys).orderBy(of).rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn(before, F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
    pieces = stage(pieces.select(*[F.col(k).alias(f"{key}_{k}") for k in keys], F.col(of).alias(f"{key}_range"), before), "pieces")
    place = Window.partitionBy(of, *keys).orderBy(*_exprs(order))
    placed = ranged.withColumn(name, F.row_number().over(place).cast("long"))
    same = placed[of] == F.col(f"{key}_range")
    for k in keys:
        same = same & placed[k].eqNullSafe(F.col(f"{key}_{k}"))
    # at most MOST_RANGES rows, and one more for each hot key
    numbered = placed.join(F.broadcast(pieces), same)
    return numbered.select(*df.columns, (F.col(name) + F.col(before)).alias(name))


def number_rows(df: DataFrame, order, keys=(), name: str = "row_no", hot=AUTO) -> DataFrame:
    """1-based position of every row in the order, per key if keys are given.

    ``order`` lists column names, ascending, or what ascending() and descending() give.
    """
    keys = list(keys)
    if not keys:
        return _range_numbered(df, keys, order, name)
    in_window = F.row_number().over(Window.partitionBy(*keys).orderBy(*_exprs(order))).cast("long")
    if hot is AUTO:
        hot = hot_keys(df, keys)
    if hot is None:
        return df.withColumn(name, in_window)
    usual = df.join(hot.renamed(), hot.matches(df), "left_anti").withColumn(name, in_window)
    large = df.join(hot.renamed(), hot.matches(df), "left_semi")
    return usual.unionByName(_range_numbered(large, keys, order, name))


def dense_id(df: DataFrame, order, prefix: str = "", width: int = 1, name: str = "dense_id") -> DataFrame:
    """Gap-free ids 1..n over the whole table."""
    numbered = number_rows(df, order, name="__n")
    return numbered.select(*df.columns, format_id(prefix, F.col("__n"), width).alias(name))


def first_n(df: DataFrame, order, n: int) -> DataFrame:
    """The first n rows of a total order: a distributed top-k."""
    return df.orderBy(*_exprs(order)).limit(n)


def rank_zip_join(left: DataFrame, right: DataFrame, keys, left_order, right_order, how: str = "left") -> DataFrame:
    """Join the k-th left row of a key with the k-th right row of the same key.

    After numbering, (keys, k) is unique on both sides, so the join spreads
    evenly however large a key is.
    """
    keys = list(keys)
    left = number_rows(left, left_order, keys, "pair_no")
    right = number_rows(right, right_order, keys, "pair_no")
    return left.join(right, [*keys, "pair_no"], how)


def previous_row(df: DataFrame, keys, order, columns, hot=AUTO, piece: int = 100_000) -> DataFrame:
    """Add prev_<column> from the row before within the key (NULL on the first).

    Hot keys are cut into pieces of consecutive rows; the last row of a piece is
    repeated as the predecessor of the next one.
    """
    keys, columns = list(keys), list(columns)
    outputs = [*df.columns, *[f"prev_{c}" for c in columns]]

    def lagged(frame, by, sort):
        w = Window.partitionBy(*by).orderBy(*sort)
        return frame.withColumns({f"prev_{c}": F.lag(c).over(w) for c in columns})

    if hot is AUTO:
        hot = hot_keys(df, keys)
    if hot is None:
        return lagged(df, keys, _exprs(order)).select(*outputs)
    usual = df.join(hot.renamed(), hot.matches(df), "left_anti")
    large = df.join(hot.renamed(), hot.matches(df), "left_semi")
    piece = min(piece, hot.limit)
    numbered = _range_numbered(large, keys, order, "__n")
    home = F.floor((F.col("__n") - 1) / piece)
    lead_in = F.when(F.col("__n") % piece == 0, F.array(home, home + 1)).otherwise(F.array(home))
    pieces = numbered.withColumn("__piece", F.explode(lead_in))
    cut = lagged(pieces, [*keys, "__piece"], [F.col("__n")])
    own = cut.where(F.col("__piece") == F.floor((F.col("__n") - 1) / piece))
    return lagged(usual, keys, _exprs(order)).select(*outputs).unionByName(own.select(*outputs))
