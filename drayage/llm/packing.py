"""Pack documents into sequences of a fixed length: first-fit decreasing in randomised groups.

Every document becomes its ids plus an end id and is cut into pieces of at most
`capacity` ids.  Pieces are dealt to groups by a random draw that is written
down with them, so that a recomputed task sees the same groups; the number of
groups follows the number of pieces, so a group's size does not.  Within a group
the pieces go, longest first, each into the first bin with room, which a
tournament tree over the bins' free room finds in logarithmic time.

Null text counts as empty and yields one piece, the end id alone.  A text of any
length is packed whole.  Repeated rows are packed as often as they occur.  Ties
of length are broken by id and start, so equal pieces are interchangeable.  An
empty table gives no rows.  Only the id and the text column are read.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from drayage.llm.bpe import TOGETHER_BYTES, vocabulary, vocabulary_text
from drayage.llm.common import chunks, map_batches, stage, text_bytes

#: Pieces of one group, on average.  A piece is a few numbers; ids stay out of the groups.
GROUP_PIECES = 8192
SEED = 20


class Tournament:
    """Leftmost bin with enough room: each inner node holds the most room below it."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        room, node = self.room, 1
        while node < self.leaves:
            node *= 2
            if room[node] < size:
                node += 1
        room[node] -= size
        found = node - self.leaves
        while node > 1:
            node >>= 1
            most = max(room[2 * node], room[2 * node + 1])
            if room[node] == most:
                break
            room[node] = most
        return found


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size; sizes must come in decreasing order."""
    tree = Tournament(len(sizes), capacity)
    bins = np.array([tree.place(int(n)) for n in sizes], np.int64)
    filled = np.zeros(len(sizes) + 1, np.int64)
    offsets = np.empty(len(sizes), np.int64)
    for i, (b, n) in enumerate(zip(bins.tolist(), sizes.tolist())):
        offsets[i] = filled[b]
        filled[b] += n
    return bins, offsets


def pieces(docs: DataFrame, vocabulary_path: str, end_id: int, capacity: int, id_col="doc_id", text_col="text", with_ids=False) -> DataFrame:
    """Pieces of at most `capacity` ids: id, start, length, ids_crc32, doc_tokens and, if asked, ids (binary)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary_text(vocabulary_path))
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()
    step = 4 * capacity

    def run(batches):
        vocab = vocabulary(shared.value)
        for batch in batches:
            texts = [t.decode("utf-8", "replace") for t in batch.column(1).to_pylist()]
            rows, start, length, crc, total, ids = [], [], [], [], [], []
            for a, b in chunks(list(map(len, texts)), TOGETHER_BYTES):
                for row, own in zip(range(a, b), vocab.encode(texts[a:b])):
                    own += end
                    for at in range(0, len(own), step):
                        part = own[at : at + step]
                        rows.append(row)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        total.append(len(own) // 4)
                        if with_ids:
                            ids.append(part)
            columns = [batch.column(0).take(pa.array(rows, pa.int64()))]
            columns += [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
            if with_ids:
                columns.append(pa.array(ids, pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=["id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(columns)])

    plain = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("text"))
    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    return map_batches(plain, run, schema)


def pack(docs: DataFrame, vocabulary_path: str, end_id: int, capacity: int = 2048, id_col="doc_id", text_col="text", with_ids=False) -> DataFrame:
    """The pieces with sequence_id and offset (gapless from 0 in each sequence)."""
    cut = pieces(docs, vocabulary_path, end_id, capacity, id_col, text_col, with_ids)
    cut = stage(cut.withColumn("draw", F.rand(SEED)), "pieces")
    groups = max(1, round(cut.count() / GROUP_PIECES))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(key, table):
        table = table.sort_by([("length", "descending"), ("id", "ascending"), ("start", "ascending")])
        bins, offsets = first_fit_decreasing(table.column("length").to_numpy(), capacity)
        numbers = (key[0].as_py() << 32) + bins
        table = table.drop_columns(["batch"])
        return table.append_column("sequence_id", pa.array(numbers)).append_column("offset", pa.array(offsets))

    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    dealt = cut.withColumn("batch", F.floor(F.col("draw") * groups).cast("long")).drop("draw")
    return dealt.groupBy("batch").applyInArrow(run, schema + ", sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves, from `pack(..., with_ids=True)`: sequence_id, ids (binary), length."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda done, part: F.concat(done, part["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"), F.sum("length").alias("length"))
