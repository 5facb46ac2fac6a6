"""Ranked lexical search by a dual tree over items and documents.

A document is a vector with one coordinate for each term of the items: the term's
weight times its saturated frequency, a whole number.  An item is the vector of its
term counts, and a score their inner product.  A node of either tree holds the
greatest value of every coordinate below it, so the product of two nodes bounds the
score of every item under one with every document under the other.  Pairs of nodes
are taken by falling bound; a pair whose bound lies under the weakest k-th score of
its items is dropped with all that it holds.  Equal bounds are followed up, so ties
go to the lesser id and the result is that of comparing all.

Two passes: the first counts the items' terms in every text and writes them, with
numbers of documents, terms and holders added up by Spark; the second builds a tree
over each batch of documents and searches it.  A task keeps k documents for each item
whatever it reads, and Spark merges them.  The k-th scores that a task starts from
come from the first SEEDS rows; they only prune, every document is in the search.

Items are taken in groups of GROUP_ITEMS, a pass each, so what is sent to the tasks
is bounded; each group is searched in trees of TREE_ITEMS.

Null text has no terms.  Items without terms have no result.  Every row of the
documents is a document of its own, repeated rows and null ids included (null ids
come last among equal scores); every row of the items is an item, and repeated items
each get their rows.  Empty tables give no rows.  Other columns are not read.
"""

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from drayage.llm.common import map_batches, stage, text_bytes
from drayage.operators.numbering import number_rows

#: Letters and digits of ASCII and all bytes of other characters make terms; only A-Z are lowered.
TERM_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)
GROUP_ITEMS = 4096
TREE_ITEMS = 256
ITEM_LEAF = 8
DOC_LEAF = 32
#: Cells of a matrix of documents and coordinates; larger batches are halved.
MATRIX_CELLS = 1 << 22
#: Rows whose scores give the tasks a first bound.
SEEDS = 2000
#: Whole numbers up to here are exact in doubles.
EXACT = 1 << 53


def terms(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


def item_bags(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, and terms with their counts."""
    rows = items.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [Counter(terms(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array([list(b) for b in bags], pa.list_(pa.binary())),
                    pa.array([list(b.values()) for b in bags], pa.list_(pa.int32())),
                ],
                names=["id", "terms", "counts"],
            )

    return map_batches(rows, count, "id long, terms array<binary>, counts array<int>")


def postings(docs: DataFrame, vocabulary: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """id, number of terms, and the vocabulary's terms (by place) with their counts, for every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("text"))
    places = {t: i for i, t in enumerate(vocabulary)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ends, found, counts = [], [0], [], []
            for text in batch.column("text"):
                own = terms(text.as_py())
                sizes.append(len(own))
                for term, times in Counter(own).items():
                    place = places.get(term)
                    if place is not None:
                        found.append(place)
                        counts.append(times)
                ends.append(len(found))
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(ends, pa.array(found, pa.int32())),
                    pa.ListArray.from_arrays(ends, pa.array(counts, pa.int64())),
                ],
                names=["id", "n", "terms", "counts"],
            )

    return map_batches(rows, count, "id long, n long, terms array<int>, counts array<long>")


def halves(matrix: np.ndarray, lengths: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows nearer to each of two unlike ones, by the angle between them."""
    own = matrix[rows]
    first = int((own @ own.sum(axis=0) / lengths[rows]).argmin())
    to_first = own @ own[first] / lengths[rows]
    second = int(to_first.argmin())
    lean = to_first / lengths[rows[first]] - own @ own[second] / lengths[rows[second]] / lengths[rows]
    order, cut = lean.argsort(kind="stable"), int((lean <= 0).sum())
    if min(cut, len(rows) - cut) < len(rows) // 8 or cut in (0, len(rows)):
        cut = len(rows) // 2
    return rows[order[:cut]], rows[order[cut:]]


@dataclass
class Tree:
    """Nodes of a binary tree; the root is 0 and parents come before children."""

    rows: list[np.ndarray]
    children: list[tuple[int, int] | None]

    def maxima(self, matrix: np.ndarray) -> np.ndarray:
        top = np.zeros((len(self.rows), matrix.shape[1]), matrix.dtype)
        for node in range(len(self.rows) - 1, -1, -1):
            pair = self.children[node]
            if pair:
                np.maximum(top[pair[0]], top[pair[1]], out=top[node])
            elif len(self.rows[node]):
                top[node] = matrix[self.rows[node]].max(axis=0)
        return top


def grow(matrix: np.ndarray, leaf: int) -> Tree:
    """A tree over the rows of a matrix of doubles, alike rows together."""
    lengths = np.maximum(np.sqrt((matrix * matrix).sum(axis=1)), 1.0)
    tree = Tree([np.arange(len(matrix))], [None])
    node = 0
    while node < len(tree.rows):
        rows = tree.rows[node]
        if len(rows) > leaf:
            tree.children[node] = (len(tree.rows), len(tree.rows) + 1)
            for part in halves(matrix, lengths, rows):
                tree.rows.append(part)
                tree.children.append(None)
        node += 1
    return tree


@dataclass
class Items:
    """Up to TREE_ITEMS items: which coordinates each holds how often, and their tree."""

    ids: list[int | None]
    row: np.ndarray
    place: np.ndarray
    count: np.ndarray
    tree: Tree

    @classmethod
    def of(cls, bags: list[tuple], places: dict[bytes, int], weights: np.ndarray) -> "Items":
        row = np.array([i for i, (_, own, _) in enumerate(bags) for _ in own], np.int64)
        place = np.array([places[t] for _, own, _ in bags for t in own], np.int64)
        count = np.array([c for _, _, counts in bags for c in counts], np.int64)
        known, at = np.unique(place, return_inverse=True)
        matrix = np.zeros((len(bags), len(known)))
        matrix[row, at] = count * weights[place]
        return cls([i for i, _, _ in bags], row, place, count, grow(matrix, ITEM_LEAF))

    def matrix(self, columns: np.ndarray, size: int) -> np.ndarray:
        """Items x the given coordinates."""
        at = np.full(size, -1, np.int64)
        at[columns] = np.arange(len(columns))
        own = at[self.place]
        inside = own >= 0
        matrix = np.zeros((len(self.ids), len(columns)), np.int64)
        matrix[self.row[inside], own[inside]] = self.count[inside]
        return matrix


@dataclass
class Best:
    """The k best documents of each item so far, and the score under which none counts."""

    k: int
    floors: np.ndarray
    lists: list[list[tuple]]

    def add(self, item: int, score: int, doc: int | None) -> None:
        own = self.lists[item]
        own.append((-score, doc is None, doc or 0))
        if len(own) >= 2 * self.k:
            self.trim(item)
        if len(own) == self.k:
            self.floors[item] = max(self.floors[item], -max(own)[0])

    def trim(self, item: int) -> None:
        own = self.lists[item]
        own.sort()
        del own[self.k :]
        if len(own) == self.k:
            self.floors[item] = max(self.floors[item], -own[-1][0])


def search_matrix(matrix: np.ndarray, tree: Tree, ids: list, columns: np.ndarray, size: int, items: Items, best: Best) -> int:
    """Search documents x coordinates for the items; returns how many leaf pairs were compared."""
    wanted = items.matrix(columns, size)
    if int(wanted.sum(axis=1).max(initial=0)) * int(matrix.max(initial=0)) < EXACT:
        matrix, wanted = matrix.astype(np.float64), wanted.astype(np.float64)
    bounds = tree.maxima(matrix) @ items.tree.maxima(wanted).T
    compared = 0
    heap = [(-int(bounds[0, 0]), 0, 0)]
    while heap:
        bound, a, b = heapq.heappop(heap)
        own = items.tree.rows[b]
        if -bound < max(1, best.floors[own].min()):
            continue
        docs_below, items_below = tree.children[a], items.tree.children[b]
        if docs_below and (not items_below or len(tree.rows[a]) * ITEM_LEAF >= len(own) * DOC_LEAF):
            for child in docs_below:
                heapq.heappush(heap, (-int(bounds[child, b]), child, b))
        elif items_below:
            for child in items_below:
                heapq.heappush(heap, (-int(bounds[a, child]), a, child))
        else:
            compared += 1
            rows = tree.rows[a]
            scores = matrix[rows] @ wanted[own].T
            for r, i in zip(*np.nonzero(scores >= np.maximum(best.floors[own], 1))):
                if scores[r, i] >= best.floors[own[i]]:
                    best.add(int(own[i]), int(scores[r, i]), ids[rows[r]])
    return compared


@dataclass
class Corpus:
    """What scores need to know of all documents: documents and terms in all, weights of the vocabulary."""

    documents: int
    terms: int
    weights: np.ndarray

    def coordinates(self, n: np.ndarray, place: np.ndarray, times: np.ndarray) -> np.ndarray:
        """The value of each (document of n terms, term, count)."""
        m = 25 + (75 * n * self.documents) // self.terms
        return self.weights[place] * ((1_000_000_000 * times) // (1000 * times + 8 * m))


def term_weights(documents: int, holders: np.ndarray) -> np.ndarray:
    each = {int(df): math.floor(1000 * math.log((2 * documents + 2) / (2 * int(df) + 1))) for df in np.unique(holders)}
    return np.array([each[int(df)] for df in holders], np.int64)


def search_batch(batch: pa.RecordBatch, corpus: Corpus, trees: list[Items], bests: list[Best]) -> int:
    """Search a batch of postings, in halves where it has too many coordinates."""
    lengths = np.diff(batch.column("terms").offsets.to_numpy())
    place = batch.column("terms").flatten().to_numpy().astype(np.int64)
    columns, at = np.unique(place, return_inverse=True)
    if not len(place):
        return 0
    if batch.num_rows > 1 and batch.num_rows * len(columns) > MATRIX_CELLS:
        middle = batch.num_rows // 2
        return sum(search_batch(b, corpus, trees, bests) for b in (batch.slice(0, middle), batch.slice(middle)))
    row = np.repeat(np.arange(batch.num_rows), lengths)
    n = batch.column("n").to_numpy()[row]
    matrix = np.zeros((batch.num_rows, len(columns)), np.int64)
    matrix[row, at] = corpus.coordinates(n, place, batch.column("counts").flatten().to_numpy())
    ids, size, tree = batch.column("id").to_pylist(), len(corpus.weights), grow(matrix.astype(np.float64), DOC_LEAF)
    return sum(search_matrix(matrix, tree, ids, columns, size, t, b) for t, b in zip(trees, bests))


def nearest(held: DataFrame, corpus: Corpus, trees: list[Items], k: int, floors: list[np.ndarray]) -> DataFrame:
    """item (its number), id and score of the k best documents of each item in each task."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bests = [Best(k, f.copy(), [[] for _ in t.ids]) for t, f in zip(trees, floors)]
        for batch in batches:
            search_batch(batch, corpus, trees, bests)
        number = 0
        for best in bests:
            found = []
            for item, own in enumerate(best.lists):
                best.trim(item)
                found += [(number + item, None if null else doc, -score) for score, null, doc in own]
            number += len(best.lists)
            if found:
                columns = [pa.array(c, t) for c, t in zip(zip(*found), (pa.int32(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["item", "id", "score"])

    return map_batches(held, search, "item int, id long, score long")


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_group(docs: DataFrame, bags: list[tuple], k: int, id_col: str, text_col: str) -> DataFrame:
    """item_id, rank, id and score for a bounded group of items."""
    spark: SparkSession = docs.sparkSession
    vocabulary = sorted({t for _, own, _ in bags for t in own})
    held = stage(postings(docs, vocabulary, id_col, text_col), "postings")
    documents, total = held.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    holders = np.zeros(len(vocabulary), np.int64)
    # at most one row for each term of the group
    for place, count in held.select(F.explode("terms").alias("place")).groupBy("place").count().collect():
        holders[place] = count
    corpus = Corpus(documents, max(total, 1), term_weights(documents, holders))
    places = {t: i for i, t in enumerate(vocabulary)}
    trees = [Items.of(bags[i : i + TREE_ITEMS], places, corpus.weights) for i in range(0, len(bags), TREE_ITEMS)]
    floors = [np.zeros(len(t.ids), np.int64) for t in trees]
    # any k documents bound the k-th score from below; all rows are searched after
    seeds = ranked(nearest(held.limit(SEEDS), corpus, trees, k, floors), k).where(F.col("rank") == k)
    for item, score in seeds.select("item", "score").collect():
        floors[item // TREE_ITEMS][item % TREE_ITEMS] = score
    found = ranked(nearest(held, corpus, trees, k, floors), k)
    names = F.broadcast(spark.createDataFrame([(i, b[0]) for i, b in enumerate(bags)], "item int, item_id long"))
    return found.join(names, "item").select("item_id", "rank", "id", "score")


def search(
    items: DataFrame,
    docs: DataFrame,
    k: int = 10,
    item_id: str = "item_id",
    item_text: str = "text",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per item the k documents of highest score above 0: item_id, rank, id, score."""
    bags = stage(item_bags(items, item_id, item_text), "item-bags").where(F.size("terms") > 0)
    count, results = bags.count(), None
    if count > GROUP_ITEMS:
        bags = stage(number_rows(bags, ["id", "terms", "counts"], name="no"), "item-numbers")
    for first in range(0, max(count, 1), GROUP_ITEMS):
        group = bags if count <= GROUP_ITEMS else bags.where((F.col("no") > first) & (F.col("no") <= first + GROUP_ITEMS))
        listed = [(r.id, [bytes(t) for t in r.terms], r.counts) for r in group.select("id", "terms", "counts").collect()]
        listed.sort(key=lambda b: (b[0] is None, b[0] or 0, b[1], b[2]))
        if not listed:
            return docs.sparkSession.createDataFrame([], "item_id long, rank int, id long, score long")
        found = search_group(docs, listed, k, id_col, text_col)
        results = found if results is None else results.unionByName(found)
    return results
