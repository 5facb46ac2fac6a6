"""Near duplicates by MinHash bands, odd sketches and a check of full sets.

Each text becomes its set of distinct word shingles.  Texts with equal sets form
one class, so copies cost nothing further.  BANDS groups of a class's MinHash
values are keys under which similar classes meet.  Classes that meet another one
are sketched: SAMPLES MinHash values are folded into an odd sketch, a bitmap in
which each value flips one bit.  The population count of the XOR of two sketches
estimates the similarity; pairs estimated below SKETCH_LEAST are put aside and
all others are confirmed on the full sets, so every link is exact.

Buckets are never expanded into all their pairs.  First every member is compared
with its bucket's smallest id, which links most groups of near copies as stars.
Then, round by round, each component takes its likeliest pair into another
component of the bucket, until no such pair is a link any more.  Members that
still share a bucket but no component are last compared across components, by
their sketches within a task, in blocks, and what passes is confirmed too.  So
texts that share a band end linked or compared.  Two classes of similarity s
share no band with probability (1 - s ** 4) ** 32, which is 5e-6 at 0.75, and a
sketch puts a link aside with about the same; that is the only way to miss one.

Null text counts as empty; a text without words is linked with nothing.  An id
names one document: rows that share an id share a component and stay or go
together.  Rows without id are linked with nothing and stay.  An empty table
gives no rows.  Only the id and the text column are read, except for
`survivors`, which returns whole rows.
"""

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from drayage.llm.common import chunks, map_batches, stage, text_bytes
from drayage.llm.components import stars
from drayage.llm.shingles import overlap, shingle_sets

SIMILAR = (75, 100)
BANDS, ROWS = 32, 4
SAMPLES = 2048
SKETCH_BITS = 4096
#: 4.5 standard deviations below the threshold, so a sketch puts hardly a link aside.
SKETCH_LEAST = 0.687
#: Members compared with one text by one task, and members of a block.
MEMBERS = 256
BLOCK = 2048

_rng = np.random.default_rng(0xBA2D)
_FACTOR = _rng.integers(0, 2**32, SAMPLES, dtype=np.uint32) | np.uint32(1)
_OFFSET = _rng.integers(0, 2**32, SAMPLES, dtype=np.uint32)
_FLIP = _rng.integers(0, 2**32, SAMPLES, dtype=np.uint32) | np.uint32(1)
_BAND = _rng.integers(0, 2**64, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)


def minhash(shingles: np.ndarray, samples: int) -> np.ndarray:
    """The least value of the set under each of the first `samples` hash functions."""
    least = np.full(samples, 2**32 - 1, np.uint32)
    values = (shingles >> np.uint64(32)).astype(np.uint32)
    step = (1 << 18) // samples
    for a in range(0, len(values), step):
        np.minimum(least, (values[a : a + step, None] * _FACTOR[:samples] + _OFFSET[:samples]).min(0), out=least)
    return least


def odd_sketch(shingles: np.ndarray) -> np.ndarray:
    """SKETCH_BITS parities as 64-bit words: each of SAMPLES MinHash values flips the bit it hashes to."""
    least = minhash(shingles, SAMPLES)
    bit = ((least ^ (least >> np.uint32(15))) * _FLIP) >> np.uint32(32 - SKETCH_BITS.bit_length() + 1)
    odd = np.bincount(bit, minlength=SKETCH_BITS).astype(np.uint8) & 1
    return np.packbits(odd).view("<i8")


def band_keys(shingles: np.ndarray) -> np.ndarray:
    least = minhash(shingles, BANDS * ROWS)
    keys = (least.reshape(BANDS, ROWS).astype(np.uint64) * _BAND).sum(1, dtype=np.uint64) + _BAND[:, 0]
    keys = (keys ^ (keys >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (keys ^ (keys >> np.uint64(32))).view(np.int64)


def most_flipped() -> int:
    """The XOR population count at which the estimate is SKETCH_LEAST."""
    different = 2 * SAMPLES * (1 - SKETCH_LEAST)
    return math.floor(SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** different))


def banded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, key of the set and band keys."""
    kind = docs.schema[id_col].dataType

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            count, key, bands = [], [], []
            for a, b in chunks(list(map(len, texts))):
                for own in shingle_sets(texts[a:b]):
                    count.append(len(own))
                    key.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                    bands.append(band_keys(own) if len(own) else [])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(count, pa.int64()),
                    pa.array(key, pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())),
                ],
                names=["id", "n_shingles", "key", "bands"],
            )

    schema = T.StructType(
        [
            T.StructField("id", kind),
            T.StructField("n_shingles", T.LongType()),
            T.StructField("key", T.BinaryType()),
            T.StructField("bands", T.ArrayType(T.LongType())),
        ]
    )
    return map_batches(docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("text")), run, schema)


def sketched(texts: DataFrame) -> DataFrame:
    """id, text, odd sketch and band keys of some documents' texts (id, text as bytes)."""

    def run(batches):
        for batch in batches:
            raws, sketch, bands = batch.column(1).to_pylist(), [], []
            for a, b in chunks(list(map(len, raws))):
                for own in shingle_sets(raws[a:b]):
                    sketch.append(odd_sketch(own))
                    bands.append(band_keys(own))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sketch, longs), pa.array(bands, longs)],
                names=["id", "text", "sketch", "bands"],
            )

    kind = texts.schema["id"].dataType.simpleString()
    return map_batches(texts.select("id", "text"), run, f"id {kind}, text binary, sketch array<long>, bands array<long>")


def confirm(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of ids whose full sets are similar enough, as a written table.  docs: id, text as bytes.

    Members of a text are dealt to tasks in lots of about MEMBERS; the text goes once to each lot.
    """
    kind = pairs.schema["a"].dataType
    pairs = stage(pairs, "near-pairs")
    lots = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).alias("lots"))
    dealt = pairs.join(lots, "a").withColumn("lot", F.pmod(F.xxhash64("b"), F.col("lots")).cast("int"))
    members = dealt.select("a", "lot", F.col("b").alias("id"), F.lit(1).alias("member"))
    heads = lots.select("a", F.explode(F.sequence(F.lit(0), F.col("lots").cast("int") - 1)).alias("lot"))
    roles = heads.select("a", "lot", F.col("a").alias("id"), F.lit(0).alias("member")).unionAll(members)
    texts = docs.join(roles, "id").select("a", "lot", "member", "id", "text")
    texts = texts.repartition("a", "lot").sortWithinPartitions("a", "lot", "member", "id")

    def run(batches):
        head, current = None, None
        for batch in batches:
            a, lot, member, ids = (batch.column(i).to_pylist() for i in range(4))
            texts = batch.column(4).to_pylist()
            linked = []
            for x, y in chunks(list(map(len, texts))):
                for i, own in zip(range(x, y), shingle_sets(texts[x:y])):
                    if not member[i]:
                        head, current = (a[i], lot[i]), own
                    elif head == (a[i], lot[i]):
                        both = overlap(current, own)
                        if SIMILAR[1] * both >= SIMILAR[0] * (len(current) + len(own) - both) and both:
                            linked.append(i)
            at = pa.array(linked, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(3).take(at)], names=["a", "b"])

    found = map_batches(texts, run, T.StructType([T.StructField("a", kind), T.StructField("b", kind)]))
    return stage(found, "near-links")


def _flipped(left: str, right: str):
    return F.aggregate(
        F.zip_with(left, right, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, bits: n + bits
    )


def _likely(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """Pairs that their sketches do not rule out."""
    sketch = facts.select("node", "sketch")
    both = pairs.join(sketch.toDF("a", "left"), "a").join(sketch.toDF("b", "right"), "b")
    return both.filter(_flipped("left", "right") <= most_flipped()).select("a", "b")


def _across(members: DataFrame, best: bool) -> DataFrame:
    """Likely pairs of members of one bucket but of different components, by comparing sketches in blocks.

    With best, only the likeliest pair of each component of a block.  A pair that
    shares several bands is given by the bucket of the first one alone.
    """
    kind = members.schema["node"].dataType
    most = most_flipped()

    def run(key, table):
        p, q = key[1].as_py(), key[2].as_py()
        words = np.array(table.column("sketch").combine_chunks().flatten()).view(np.uint64).reshape(-1, SKETCH_BITS // 64)
        component = table.column("component").combine_chunks().dictionary_encode().indices.to_numpy()
        block = table.column("block").to_numpy()
        first, second = np.flatnonzero(block == p), np.flatnonzero(block == q)
        bands = np.array(table.column("bands").combine_chunks().flatten()).reshape(-1, BANDS)
        nodes = table.column("node")
        left, right, flipped = [], [], []
        for i in first.tolist():
            others = second[second > i] if p == q and not best else second
            others = others[component[others] != component[i]]
            away = np.bitwise_count(words[others] ^ words[i]).sum(1, dtype=np.int64)
            near = np.flatnonzero(away <= most)
            if not best and len(near):
                shared = bands[others[near]] == bands[i]
                near = near[~shared.any(1) | (bands[i][shared.argmax(1)] == key[0].as_py())]
            if best and len(near):
                near = near[[int(away[near].argmin())]]
            left += [i] * len(near)
            right += others[near].tolist()
            flipped += away[near].tolist()
        if best and left:  # of all members of a component the one that is nearest to another component
            order = np.lexsort((flipped, component[left]))
            chosen = order[np.unique(component[left][order], return_index=True)[1]]
            left, right = np.array(left)[chosen].tolist(), np.array(right)[chosen].tolist()
        return pa.table({"x": nodes.take(pa.array(left, pa.int64())), "y": nodes.take(pa.array(right, pa.int64()))})

    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(
        "bucket", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "node", "component", "sketch", "bands"
    )
    schema = T.StructType([T.StructField("x", kind), T.StructField("y", kind)])
    found = dealt.groupBy("bucket", "p", "q").applyInArrow(run, schema)
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _mixed(buckets: DataFrame, found: DataFrame) -> DataFrame:
    """Members of the buckets that still hold several components, with their component, as a written table."""
    labelled = buckets.join(found.toDF("node", "component"), "node", "left")
    labelled = labelled.select("bucket", "size", "node", F.coalesce("component", "node").alias("component"))
    labelled = stage(labelled, "near-labelled")
    spread = labelled.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    return stage(labelled.join(spread.filter("low < high"), "bucket", "left_semi"), "near-mixed")


def assignments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest id reachable by links), kept (whether it is that id)."""
    rows = stage(banded(docs, id_col, text_col), "near-rows")
    usable = rows.filter((F.col("n_shingles") > 0) & F.col("id").isNotNull())
    classes = stage(usable.groupBy("key").agg(F.min("id").alias("node"), F.first("bands").alias("bands")), "near-classes")
    entries = classes.select("node", F.explode(F.array_distinct("bands")).alias("bucket"))
    leads = entries.groupBy("bucket").agg(F.min("node").alias("lead"), F.count("*").alias("size")).filter("size > 1")
    buckets = stage(entries.join(leads, "bucket"), "near-buckets")

    # texts of the classes that meet others, by one shuffle of the texts whatever the sizes
    texts = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("text"))
    meeting = buckets.select(F.col("node").alias("id")).distinct()
    known = stage(sketched(texts.join(meeting.hint("merge"), "id", "left_semi")), "near-sketched")
    facts = known.select(F.col("id").alias("node"), "sketch", "bands").dropDuplicates(["node"])
    facts = stage(facts, "near-facts")

    # each bucket's members against its smallest
    first = buckets.filter("node > lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    found = stars(confirm(_likely(first, facts), known))

    # buckets that still hold several components: the likeliest pair of each, while there are links among them,
    # and then all pairs; a bucket that holds one component keeps to it
    mixed = _mixed(buckets, found)

    def further(best: bool) -> DataFrame:
        return confirm(_across(mixed.join(facts, "node"), best), known)

    while not (more := further(best=True)).isEmpty():
        found = stars(found.toDF("a", "b").unionAll(more))
        mixed = _mixed(mixed.drop("component"), found)
    if not (more := further(best=False)).isEmpty():
        found = stars(found.toDF("a", "b").unionAll(more))

    sets = classes.select("key", "node").join(found.toDF("node", "component"), "node", "left")
    sets = sets.select("key", F.coalesce("component", "node").alias("component"))
    joined = rows.select("id", "n_shingles", "key").join(sets, "key", "left")
    linked = (F.col("n_shingles") > 0) & F.col("id").isNotNull()
    joined = joined.select("id", "n_shingles", F.when(linked, F.col("component")).otherwise(F.col("id")).alias("component_id"))
    return joined.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Whole rows of one document of each component."""
    kept = assignments(docs, id_col, text_col).filter("kept").select(F.col("id").alias(_KEPT)).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept[f"`{_KEPT}`"]), "left_semi")


#: A name that no column of a document table has.
_KEPT = "near_dedup kept id"
