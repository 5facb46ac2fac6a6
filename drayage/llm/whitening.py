"""Embedding whitening by exact spectra.

Vectors are put on a whole-number grid, floor(64 * c); an offset would change nothing.  The distinct ones are the fit list; Spark adds
up their exact scatter n * sum(x x') - S S' in whole numbers, which is n * n times the
covariance.  Its characteristic polynomial, taken modulo a prime in each row of a Spark
table and put together, gives exact eigenvalues, and inverse iteration the components
(see polynomial.py).  Every row is then projected on the components.

What is sent to the driver depends on the width of the vectors alone: the sums of each
pair of dimensions, residues for each prime, and the components.

Rows without a vector, or with null or non-finite entries, are dropped, as are rows
with entries beyond the whole numbers of 62 bits and rows whose width is not the one
that most rows have (of equally many the greater).  Null ids are ids like any other.
Repeated rows get a result each and count once in the fit list.  Directions in which
the fit list does not vary have eigenvalue 0 and are no components, so a single
distinct vector, or an empty table, gives no rows.  A deviation beyond a long is null.
Other columns are not read.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Context, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from drayage.llm import polynomial
from drayage.llm.common import map_batches, stage

SCALE = 64
COMPONENTS = 16
#: Bytes of an entry, narrowest first.
TYPES = (np.int8, np.int16, np.int32, np.int64)
FARTHEST = 1 << 62
#: Sums are carried as two decimals, multiples of 2 ** LIMB and the rest.
LIMB = 96


def packed(entries: np.ndarray) -> bytes:
    """One code for a vector of whole numbers: the width of its entries, then the entries."""
    far = max(int(entries.max(initial=0)), -1 - int(entries.min(initial=0)))
    kind = next(i for i, t in enumerate(TYPES) if far <= np.iinfo(t).max)
    return bytes([kind]) + entries.astype(np.dtype(TYPES[kind]).newbyteorder("<")).tobytes()


def unpacked(codes: list[bytes]) -> np.ndarray:
    """Rows of whole numbers."""
    return np.array([np.frombuffer(c, np.dtype(TYPES[c[0]]).newbyteorder("<"), offset=1).astype(np.int64) for c in codes])


def on_grid(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, code and width of every vector with finite entries; entries are floor(64 * c)."""
    vectors = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vector = batch.column("vector")
            flat = vector.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
            with np.errstate(over="ignore", invalid="ignore"):
                grid = np.floor(SCALE * flat)
                bad = ~(np.abs(grid) < FARTHEST)
            whole = np.where(bad, 0, grid).astype(np.int64)
            lengths = np.array([n or 0 for n in vector.value_lengths().to_pylist()], np.int64)
            ends = np.cumsum(lengths)
            faults = np.concatenate([[0], np.cumsum(bad)])
            good = vector.is_valid().to_numpy(zero_copy_only=False) & (lengths > 0)
            good &= faults[ends] == faults[ends - lengths]
            codes = [packed(whole[e - n : e]) for e, n in zip(ends[good], lengths[good])]
            kept = batch.column("id").filter(pa.array(good))
            yield pa.RecordBatch.from_arrays(
                [kept, pa.array(codes, pa.binary()), pa.array(lengths[good], pa.int32())], names=["id", "code", "width"]
            )

    kind = vectors.schema["id"].dataType.simpleString()
    return map_batches(vectors, place, f"id {kind}, code binary, width int")


def products(y: np.ndarray) -> list[list[int]]:
    """Exact sums over the rows of [1, y] times [1, y]', as whole numbers of any size."""
    far = int(np.abs(y).max(initial=0)) + 1
    ones = np.column_stack([np.ones(len(y), np.int64), y])
    if far * far * len(y) < 1 << 53:
        return (ones.T.astype(np.float64) @ ones.astype(np.float64)).astype(np.int64).tolist()
    whole = ones if far * far * len(y) < 1 << 63 else ones.astype(object)
    return (whole.T @ whole).tolist()


def scatter(fit: DataFrame) -> tuple[int, list[int], list[list[int]]]:
    """n, the sums, and n * sum(y y') - S S' over distinct vectors of one width (code, width)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = products(unpacked(batch.column("code").to_pylist()))
                total = own if total is None else [[a + b for a, b in zip(r, s)] for r, s in zip(total, own)]
        if total:
            cells = [(i, j, v) for i, row in enumerate(total) for j, v in enumerate(row) if i <= j]
            high = [Decimal(v >> LIMB) for _, _, v in cells]
            low = [Decimal(v & (1 << LIMB) - 1) for _, _, v in cells]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([i for i, _, _ in cells], pa.int32()),
                    pa.array([j for _, j, _ in cells], pa.int32()),
                    pa.array(high, pa.decimal128(38, 0)),
                    pa.array(low, pa.decimal128(38, 0)),
                ],
                names=["i", "j", "high", "low"],
            )

    parts = map_batches(fit.select("code"), add, "i int, j int, high decimal(38,0), low decimal(38,0)")
    sums = parts.groupBy("i", "j").agg(F.sum("high"), F.sum("low")).collect()
    cells = {(i, j): (int(high) << LIMB) + int(low) for i, j, high, low in sums}
    if not cells:
        return 0, [], []
    n, width = cells[0, 0], max(j for _, j in cells)
    s = [cells[0, i + 1] for i in range(width)]
    both = [[cells[min(i, j) + 1, max(i, j) + 1] for j in range(width)] for i in range(width)]
    return n, s, [[n * both[i][j] - s[i] * s[j] for j in range(width)] for i in range(width)]


def characteristic(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Coefficients of the characteristic polynomial, lowest first; each prime is a row of a Spark table."""
    width = len(matrix)
    primes = polynomial.primes_for(sum(matrix[i][i] for i in range(width)), width)
    tasks = min(len(primes), spark.sparkContext.defaultParallelism)
    rows = spark.createDataFrame([(p,) for p in primes], "p long").repartition(tasks, "p")

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column("p").to_pylist():
                residues = np.array([[x % p for x in row] for row in matrix], np.int64)
                values = polynomial.characteristic(residues, p).tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p], pa.int64()), pa.array([values], pa.list_(pa.int64()))], names=["p", "residues"]
                )

    found = map_batches(rows, reduce, "p long, residues array<long>").collect()
    return polynomial.remaindered([(r.p, r.residues) for r in found])


@dataclass
class Whitening:
    """What the fit list determines."""

    width: int
    n: int
    sums: np.ndarray
    #: width x components, each divided by the square root of its eigenvalue of the scatter.
    axes: np.ndarray
    explained: list[float]

    def project(self, y: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Whitened entries, and the exact squared lengths of n * y - S."""
        far = self.n * (int(np.abs(y).max(initial=0)) + 1) + max((abs(int(s)) for s in self.sums), default=0)
        if far * far * self.width < 1 << 63:
            spread = self.n * y - self.sums.astype(np.int64)
            deviation = (spread * spread).sum(axis=1).tolist()
        else:
            spread = self.n * y.astype(object) - self.sums
            deviation = (spread * spread).sum(axis=1).tolist()
        return spread.astype(np.float64) @ self.axes, deviation


def components(spark: SparkSession, matrix: list[list[int]], coefficients: list[int], count: int):
    """Eigenvalues, and axes as columns; each distinct eigenvalue is a row of a Spark table."""
    roots = polynomial.RealRoots(coefficients).greatest(count)
    if not roots:
        return [], np.zeros((len(matrix), 0))
    starts = [i for i, r in enumerate(roots) if not i or r != roots[i - 1]]
    spans = [(i, str(roots[i]), roots.count(roots[i])) for i in starts]
    rows = spark.createDataFrame(spans, "first int, root string, copies int").repartition(len(spans), "first")

    def iterate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                scale, vectors = polynomial.eigenvectors(matrix, int(row["root"]), row["first"], row["copies"])
                axes = [[x / scale for x in v] for v in vectors]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["first"]], pa.int32()), pa.array([axes], pa.list_(pa.list_(pa.float64())))],
                    names=["first", "axes"],
                )

    found = map_batches(rows, iterate, "first int, axes array<array<double>>").collect()
    axes = [axis for row in sorted(found, key=lambda r: r.first) for axis in row.axes]
    return roots, np.array(axes).T


def fit(vectors: DataFrame, count: int = COMPONENTS) -> Whitening:
    """Learn from the distinct vectors (code, width), all of one width."""
    spark = vectors.sparkSession
    n, sums, matrix = scatter(vectors)
    trace = sum(matrix[i][i] for i in range(len(matrix)))
    if not trace:
        return Whitening(len(matrix), n, np.array(sums, object), np.zeros((len(matrix), 0)), [])
    roots, axes = components(spark, matrix, characteristic(spark, matrix), count)
    context = Context(prec=40)
    whole = context.multiply(Decimal(trace), Decimal(2) ** polynomial.BITS)
    explained = [float(context.divide(Decimal(r), whole)) for r in roots]
    return Whitening(len(matrix), n, np.array(sums, object), axes, explained)


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """The largest entry of the whitened fit list's covariance minus the identity."""
    size = model.axes.shape[1]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size + 1, size + 1))
        for batch in batches:
            if batch.num_rows:
                white, _ = model.project(unpacked(batch.column("code").to_pylist()))
                ones = np.column_stack([np.ones(len(white)), white])
                total += ones.T @ ones
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["sums"])

    parts = map_batches(vectors.select("code"), add, "sums array<double>")
    cells = parts.select(F.posexplode("sums").alias("cell", "part")).groupBy("cell").agg(F.sum("part")).collect()
    total = np.zeros((size + 1) ** 2)
    for cell, value in cells:
        total[cell] = value
    total = total.reshape(size + 1, size + 1)
    mean = total[0, 1:] / total[0, 0]
    return float(np.abs(total[1:, 1:] / total[0, 0] - np.outer(mean, mean) - np.eye(size)).max())


def apply(rows: DataFrame, model: Whitening, error: float) -> DataFrame:
    """Per row (id, code) and component: id, component, n, deviation, whitened, explained, identity_error."""
    size = model.axes.shape[1]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            white, deviation = model.project(unpacked(batch.column("code").to_pylist()))
            count = batch.num_rows
            at = pa.array(np.repeat(np.arange(count), size))
            deviation = pa.array([d if d < 1 << 63 else None for d in deviation], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(at),
                    pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), count)),
                    pa.array(np.full(count * size, model.n, np.int64)),
                    deviation.take(at),
                    pa.array(white.ravel()),
                    pa.array(np.tile(model.explained, count)),
                    pa.array(np.full(count * size, error)),
                ],
                names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return map_batches(rows.select("id", "code"), project, schema)


def whiten(
    rows: DataFrame, count: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """Per remaining row and component: id, component, n, deviation, whitened, explained, identity_error."""
    placed = stage(on_grid(rows, id_col, vector_col), "grid")
    distinct = stage(placed.select("code", "width").distinct(), "fit-list")
    common = placed.groupBy("width").count().orderBy(F.desc("count"), F.desc("width")).first()
    width = common["width"] if common else 0
    distinct, placed = distinct.where(F.col("width") == width), placed.where(F.col("width") == width)
    model = fit(distinct, count)
    if not model.explained:
        return apply(placed.where("false"), model, 0.0)
    return apply(placed, model, identity_error(distinct, model))
