"""Exact duplicates by compressed radix tries over whole byte strings.

A text's key is its UTF-8 form with A-Z lower-cased.  First every task collapses
the equal texts it reads, so a text that fills a third of the rows leaves each
task as one entry.  Entries are then partitioned by length and content hash and
arrive sorted by them; a Patricia trie takes the full key of each, and its
terminal nodes hold the identifier that wins.  All keys of a trie have one
length, so every terminal is a leaf.  When a trie outgrows its budget, the
subtrees whose (length, hash) lies before the current one, which no later key
can reach, are written out and dropped, so memory is bounded by the budget plus
one text.

Of equal texts the row with the largest id stays, or the smallest if asked; a
null id loses to any other, and of rows equal in id and text exactly one stays.
Null text counts as empty, so all null and empty texts are one group.  An empty
table gives no rows.  `survivors` returns whole rows, whatever their columns are
named; `assignments` reads the id and the text column only.
"""

import hashlib

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from drayage.llm.common import map_batches, stage

#: Bytes of keys a task holds in tries before it writes subtrees out.
TRIE_BYTES = 24 << 20
#: Rows of one text that an entry lists.
ENTRY_IDS = 50_000


class Node:
    """An edge's bytes with what hangs below it; a terminal has a value."""

    __slots__ = ("edge", "children", "value")

    def __init__(self, edge: bytes, value=None):
        self.edge, self.children, self.value = edge, {}, value


def common_length(a: bytes, b: bytes) -> int:
    """Bytes that a and b begin with together."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class PatriciaTrie:
    """Owners of byte strings of one length."""

    def __init__(self):
        self.root = Node(b"")
        self.bytes = 0

    def terminal(self, key: bytes) -> Node:
        """The key's terminal, made if it is new."""
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = Node(key[at:])
                self.bytes += len(key) - at + 200
                return child
            if not key.startswith(child.edge, at):
                shared = common_length(child.edge, key[at : at + len(child.edge)])
                upper = Node(child.edge[:shared])
                child.edge = child.edge[shared:]
                upper.children[child.edge[0]] = child
                node.children[key[at]] = upper
                child = upper
            at += len(child.edge)
            node = child
        return node

    def terminals(self):
        """(key, value) of all terminals, subtree by subtree."""
        stack = [(self.root, b"")]
        while stack:
            node, key = stack.pop()
            key += node.edge
            if node.value is not None:
                yield key, node.value
            stack.extend((child, key) for child in node.children.values())


def normal(text: bytes) -> bytes:
    """A-Z lower-cased; bytes of other characters stay."""
    return text.lower()


def _better(a, b, largest: bool) -> bool:
    """Whether id a wins over id b."""
    if a is None or b is None:
        return a is not None and b is None
    return a > b if largest else a < b


class _Found:
    """One text of a task: its best row so far and all its ids."""

    __slots__ = ("ids", "best", "row")

    def __init__(self):
        self.ids, self.best, self.row = [], 0, None


def collapse(docs: DataFrame, id_col: str, text_col: str, largest: bool = True) -> DataFrame:
    """Each task's distinct texts as a written table: entry, length, hash, row (the best one), best (its place), ids."""
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))

    def run(batches):
        from pyspark import TaskContext

        base, number = TaskContext.get().partitionId() << 33, 0
        tries: dict[tuple[int, int], PatriciaTrie] = {}
        found: list[tuple[int, int, _Found]] = []
        held: list[pa.RecordBatch] = []
        size = 0

        def flush():
            nonlocal number
            if not found:
                return
            starts = [0]
            for b in held:
                starts.append(starts[-1] + b.num_rows)
            every = pa.Table.from_batches(held).combine_chunks()
            picked = every.column("row").take(pa.array([f.row for *_, f in found], pa.int64())).combine_chunks()
            for a in range(0, len(found), 1000):
                part = found[a : a + 1000]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(range(base + number, base + number + len(part)), pa.int64()),
                        pa.array([n for n, *_ in part], pa.int64()),
                        pa.array([h for _, h, _ in part], pa.int64()),
                        picked.slice(a, len(part)),
                        pa.array([f.best for *_, f in part], pa.int32()),
                        pa.array([f.ids for *_, f in part], pa.list_(every.column("id").type)),
                    ],
                    names=["entry", "length", "hash", "row", "best", "ids"],
                )
                number += len(part)
            tries.clear()
            found.clear()
            held.clear()

        offset = 0
        for batch in batches:
            held.append(batch)
            ids = batch.column("id").to_pylist()
            for i, text in enumerate(batch.column("text").to_pylist()):
                key = normal(text or b"")
                digest = xxhash.xxh64_intdigest(key)
                digest -= (digest >> 63) << 64
                trie = tries.setdefault((len(key), digest), PatriciaTrie())
                node = trie.terminal(key)
                if node.value is None or len(node.value.ids) >= ENTRY_IDS:
                    node.value = _Found()
                    found.append((len(key), digest, node.value))
                own = node.value
                if own.row is None or _better(ids[i], own.ids[own.best], largest):
                    own.best, own.row = len(own.ids), offset + i
                own.ids.append(ids[i])
            offset += batch.num_rows
            size += batch.nbytes
            if size > TRIE_BYTES:
                yield from flush()
                size = offset = 0
        yield from flush()

    schema = T.StructType(
        [
            T.StructField("entry", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("hash", T.LongType()),
            T.StructField("row", rows.schema["row"].dataType),
            T.StructField("best", T.IntegerType()),
            T.StructField("ids", T.ArrayType(kind)),
        ]
    )
    return stage(map_batches(rows, run, schema), "exact-entries")


class _Owner:
    """A terminal's winner, and the entries that led here."""

    __slots__ = ("id", "entry", "rows", "entries", "slice", "hash")

    def __init__(self, hash_):
        self.id, self.entry, self.rows, self.entries, self.slice, self.hash = None, None, 0, [], None, hash_


def _owners(entries: DataFrame, text_col: str, largest: bool, with_rows: bool) -> DataFrame:
    """Per entry its owner, or whole rows of the owners.  Entries of equal texts meet in one trie."""
    kind = entries.schema["ids"].dataType.elementType
    row = entries.schema["row"].dataType
    names = [f.name for f in row.fields]
    keyed = entries.select(
        "length",
        "hash",
        "entry",
        F.element_at("ids", F.col("best") + 1).alias("id"),
        F.size("ids").cast("long").alias("rows"),
        F.col("row").getField(names[names.index(text_col)]).cast("binary").alias("text"),
        *([F.col("row")] if with_rows else []),
    )
    keyed = keyed.repartition("length", "hash").sortWithinPartitions("length", "hash", "entry")

    def run(batches):
        trie, shared, ready = PatriciaTrie(), None, []

        def drain():
            done = list(ready)
            ready.clear()
            if with_rows:
                for a in range(0, len(done), 1000):
                    whole = pa.Table.from_batches([o.slice for o in done[a : a + 1000]]).combine_chunks()
                    yield from whole.to_batches()
                return
            out = [(e, o.id, e == o.entry, o.rows, s) for o, s in done for e in o.entries]
            for a in range(0, len(out), 10_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out[a : a + 10_000]), types)], names=["entry", "keep_id", "owner", "group_size", "text_sha256"]
                )

        def finish(owners):
            for key, owner in owners:
                ready.append(owner if with_rows else (owner, hashlib.sha256(key).hexdigest()))

        types = None
        for batch in batches:
            types = types or [pa.int64(), batch.column("id").type, pa.bool_(), pa.int64(), pa.string()]
            columns = [batch.column(c).to_pylist() for c in ("length", "hash", "entry", "id", "rows", "text")]
            for i, (length, digest, entry, id_, rows, text) in enumerate(zip(*columns)):
                if shared is not None and shared != (length, digest >> 48):
                    finish(trie.terminals())
                    trie = PatriciaTrie()
                elif trie.bytes > TRIE_BYTES:
                    full, trie = list(trie.terminals()), PatriciaTrie()
                    finish((k, o) for k, o in full if o.hash != digest)
                    for k, o in full:
                        if o.hash == digest:
                            trie.terminal(k).value = o
                shared = (length, digest >> 48)
                node = trie.terminal(normal(text or b""))
                if node.value is None:
                    node.value = _Owner(digest)
                owner = node.value
                if owner.entry is None or _better(id_, owner.id, largest):
                    owner.id, owner.entry = id_, entry
                    if with_rows:
                        owner.slice = pa.RecordBatch.from_struct_array(batch.column("row").slice(i, 1))
                owner.rows += rows
                if not with_rows:
                    owner.entries.append(entry)
            if len(ready) >= 1000:
                yield from drain()
        finish(trie.terminals())
        yield from drain()

    if with_rows:
        return map_batches(keyed, run, row)
    schema = T.StructType(
        [
            T.StructField("entry", T.LongType()),
            T.StructField("keep_id", kind),
            T.StructField("owner", T.BooleanType()),
            T.StructField("group_size", T.LongType()),
            T.StructField("text_sha256", T.StringType()),
        ]
    )
    return map_batches(keyed, run, schema)


def assignments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: bool = True) -> DataFrame:
    """Per row: id, keep_id (id of the row that stays), group_size, kept, text_sha256."""
    entries = collapse(docs.select(id_col, text_col), id_col, text_col, largest)
    owners = _owners(entries, text_col, largest, False)
    rows = entries.select("entry", "best", "ids").join(owners, "entry")
    return rows.select("best", "keep_id", "owner", "group_size", "text_sha256", F.posexplode("ids").alias("place", "id")).select(
        "id", "keep_id", "group_size", (F.col("owner") & (F.col("place") == F.col("best"))).alias("kept"), "text_sha256"
    )


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: bool = True) -> DataFrame:
    """The rows that stay, with all their columns."""
    return _owners(collapse(docs, id_col, text_col, largest), text_col, largest, True)
