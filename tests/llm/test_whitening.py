from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import types as T

from drayage.llm import polynomial, whitening
from tests.conftest import DATA

VECTORS = T.StructType(
    [T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("label", T.IntegerType())]
)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)


def integer_polynomial(matrix):
    """Coefficients of the characteristic polynomial by Faddeev and LeVerrier, lowest first."""
    size = len(matrix)
    own = [[Fraction(x) for x in row] for row in matrix]
    held = [[Fraction(0)] * size for _ in range(size)]
    coefficients = [Fraction(1)]
    for k in range(1, size + 1):
        held = [[sum(own[i][m] * held[m][j] for m in range(size)) for j in range(size)] for i in range(size)]
        for i in range(size):
            held[i][i] += coefficients[-1]
        trace = sum(own[i][m] * held[m][i] for i in range(size) for m in range(size))
        coefficients.append(-trace / k)
    return [int(c) for c in reversed(coefficients)]


def exact_scatter(vectors):
    """n, S and n * sum(x x') - S S' over distinct x, in Python's whole numbers."""
    fit = sorted({tuple(int(np.floor(64 * np.float64(c))) + 1000000 for c in v) for v in vectors})
    n, width = len(fit), len(fit[0])
    s = [sum(x[i] for x in fit) for i in range(width)]
    return n, s, [[n * sum(x[i] * x[j] for x in fit) - s[i] * s[j] for j in range(width)] for i in range(width)]


def check(spark, rows, count=16):
    """Hold whiten() against plain arithmetic; returns its rows by id."""
    got = whitening.whiten(frame(spark, rows), count).collect()
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    n, s, matrix = exact_scatter([v for _, v in kept])
    values = np.linalg.eigvalsh(np.array(matrix, float))[::-1]
    by_id = {}
    for r in got:
        by_id.setdefault(r.id, []).append(r)
    assert set(by_id) == {i for i, _ in kept}
    size = max(r.component for r in got)
    trace = sum(matrix[i][i] for i in range(len(matrix)))
    white = {}
    for i, v in kept:
        x = [int(np.floor(64 * np.float64(c))) + 1000000 for c in v]
        own = sorted(by_id[i], key=lambda r: r.component)
        assert [r.component for r in own] == list(range(1, size + 1))
        deviation = sum((n * a - b) ** 2 for a, b in zip(x, s))
        assert {r.deviation for r in own} == {deviation if deviation < 1 << 63 else None}
        assert {r.n for r in own} == {n}
        assert np.allclose([r.explained for r in own], values[:size] / trace, rtol=1e-6)
        white[tuple(x)] = [r.whitened for r in own]
    w = np.array(list(white.values()))
    assert np.abs(np.cov(w.T, bias=True).reshape(size, size) - np.eye(size)).max() < 1e-8
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-8
    return by_id, size, white, (n, s, matrix)


def test_polynomial_equals_exact_arithmetic():
    draw = np.random.default_rng(1)
    for size in (1, 2, 3, 6, 9):
        half = draw.integers(-40, 40, (size, size + 2))
        for matrix in ((half @ half.T).tolist(), np.diag([5] * size).tolist(), np.zeros((size, size), int).tolist()):
            want = integer_polynomial(matrix)
            primes = polynomial.primes_for(sum(matrix[i][i] for i in range(size)), size)
            parts = [(p, polynomial.characteristic(np.array(matrix, np.int64) % p, p).tolist()) for p in primes]
            assert all([c % p for c in want] == r for p, r in parts)
            assert polynomial.remaindered(parts) == want


def test_primes():
    small = [n for n in range(2000) if polynomial.is_prime(n)]
    assert small == [n for n in range(2, 2000) if all(n % d for d in range(2, n))]
    assert not polynomial.is_prime(46337 * 46327) and polynomial.is_prime((1 << 31) - 1)


def poly(roots):
    own = [1]
    for r in roots:
        own = [a - r * b for a, b in zip([0, *own], [*own, 0])]
    return own


def test_roots_with_their_multiples():
    unit = 1 << polynomial.BITS
    for roots in ([1, 2, 3], [5, 5, 5, 1], [0, 0, 7, 7, 100], [10**12, 10**12 - 1, 3], [4], [2**70, 2**70 + 1, 2**70 + 2]):
        want = sorted((r * unit for r in roots if r), reverse=True)
        found = polynomial.RealRoots(poly(roots))
        assert found.greatest(len(roots)) == want
        assert found.greatest(2) == want[:2]
    assert polynomial.RealRoots([0, 0, 1]).greatest(3) == []
    # roots of x^2 - 4x + 2: 2 +- sqrt 2
    high, low = polynomial.RealRoots([2, -4, 1]).greatest(2)
    assert abs(high / unit - 2 - 2**0.5) < 1e-15 and abs(low / unit - 2 + 2**0.5) < 1e-15


def test_vectors_of_close_and_equal_eigenvalues():
    # eigenvalues 3, 1, 1 and a pair 2 ** -40 apart beside them
    big = 1 << 40
    for matrix, count in (([[2, 1, 0], [1, 2, 0], [0, 0, 1]], 3), ([[big, 1, 0], [1, big, 0], [0, 0, big + 5]], 3)):
        roots = polynomial.RealRoots(integer_polynomial(matrix)).greatest(count)
        vectors = []
        for i in sorted({roots.index(r) for r in roots}):
            vectors += polynomial.eigenvectors(matrix, roots[i], i, roots.count(roots[i]))[1]
        v = np.array(vectors)
        assert np.abs(v @ v.T - np.eye(count)).max() < 1e-14
        values = [Fraction(r, 1 << polynomial.BITS) for r in roots]
        for value, vector in zip(values, vectors):
            own = [Fraction(x) for x in vector]
            rest = [sum(a * b for a, b in zip(row, own)) - value * x for row, x in zip(matrix, own)]
            assert max(abs(x) for x in rest) < Fraction(1, 10**14) * max(max(row) for row in matrix)
    close = np.array(vectors)[[0, 2]]  # (0, 0, 1) is apart from (1, 1) / sqrt 2 by four units in 2 ** 40
    assert np.allclose(np.abs(close), [[0, 0, 1], [0.5**0.5, 0.5**0.5, 0]], atol=1e-14)


def test_the_embeddings(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    _, size, white, (n, s, matrix) = check(spark, rows)
    assert size == 16
    values, vectors = np.linalg.eigh(np.array(matrix, float) / n**2)
    x = np.array(list(white)) - np.array(s) / n
    for c in range(16):
        want, got = x @ vectors[:, -1 - c] / values[-1 - c] ** 0.5, np.array([w[c] for w in white.values()])
        assert min(np.abs(want - got).max(), np.abs(want + got).max()) < 1e-6


def test_odd_rows(spark):
    draw = np.random.default_rng(2)
    rows = [(i, draw.normal(size=5).tolist()) for i in range(60)]
    for _, v in rows:
        v[3] = 0.25  # does not vary
    nan, inf = float("nan"), float("inf")
    odd = [(100, None), (101, [1.0, None, 2.0, 0.25, 1.0]), (102, [nan, 1.0, 1.0, 0.25, 1.0]), (103, [1.0, 1.0, -inf, 0.25, 1.0])]
    again = [(200 + i, rows[0][1]) for i in range(50)] + [(None, rows[1][1])]
    by_id, size, _, _ = check(spark, rows + odd + again)
    assert size == 4 and not by_id.keys() & {100, 101, 102, 103}
    # equal vectors have equal results, and do not count in the fit list
    assert {r.whitened for i in range(50) for r in by_id[200 + i]} == {r.whitened for r in by_id[0]}
    # other widths, entries too far out, no entries
    other = [(300, [1.0, 2.0]), (301, [1e30, 0.0, 0.0, 0.25, 0.0]), (302, [])]
    wide = whitening.whiten(frame(spark, rows + other)).select("id").distinct()
    assert {r.id for r in wide.collect()} == {i for i, _ in rows}


def test_equal_and_far_apart_spreads(spark):
    axes = [[(1.0 if j == i else 0.0) * sign for j in range(4)] for i in range(4) for sign in (1, -1)]
    by_id, size, _, _ = check(spark, list(enumerate(axes)))
    assert size == 4 and {round(r.explained, 12) for own in by_id.values() for r in own} == {0.25}
    far = [(i, [float(i) * 1e9, float(i % 7) / 64, float(i * i % 11)]) for i in range(80)]
    check(spark, far)


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]])
def test_nothing_to_fit(spark, rows):
    none = whitening.whiten(frame(spark, rows))
    assert none.isEmpty()
    assert none.columns == ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_clashing_names(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").limit(80)
    clashing = rows.selectExpr("*", "label AS id", "label AS code", "embedding AS vector", "vec_id AS width", "label AS n")
    a, b = (sorted(map(tuple, whitening.whiten(r).drop("identity_error").collect())) for r in (rows, clashing))
    assert len(a) == 80 * 16 and [r[:4] for r in a] == [r[:4] for r in b]
    assert np.allclose([r[4] for r in a], [r[4] for r in b], atol=1e-12)


def test_sums_of_any_size():
    for far in (3, 1 << 20, 1 << 40, 1 << 61):
        y = np.array([[far, -far], [far - 1, 5], [0, 7]], np.int64)
        own = [[1, *map(int, row)] for row in y]
        assert whitening.products(y) == [[sum(r[i] * r[j] for r in own) for j in range(3)] for i in range(3)]
        assert (whitening.unpacked([whitening.packed(row) for row in y[:1]])[0] == y[0]).all()
