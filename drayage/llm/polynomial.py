"""Exact eigenvalues of a whole symmetric matrix, and eigenvectors to double precision.

The characteristic polynomial is taken modulo many primes, by reduction to Hessenberg
form, and put together by the Chinese remainder theorem.  All its roots are real, so
the number of roots above a point is the number of sign changes of the polynomial
shifted there (Descartes' rule is exact then, multiple roots counted).  Bisection by
that count isolates the roots, safeguarded Newton steps on exact values refine them
to 2 ** -BITS.  Eigenvectors come from inverse iteration on the all but singular
matrix in DIGITS decimal digits.  All of it depends on the width alone.
"""

from decimal import Context, Decimal, localcontext
from functools import lru_cache
from math import comb

import numpy as np

BITS = 96
DIGITS = 100


def is_prime(n: int) -> bool:
    """Miller-Rabin, exact below 3.2e9 with these bases."""
    if n < 2 or any(n % p == 0 for p in (2, 3, 5, 7)):
        return n in (2, 3, 5, 7)
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if x in (1, n - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes_for(trace: int, width: int) -> list[int]:
    """The largest primes under 2 ** 31 whose product exceeds twice every coefficient.

    The eigenvalues are not negative and sum to the trace, so the k-th coefficient is
    at most comb(width, k) * (trace / width) ** k.
    """
    top = max(comb(width, k) * (trace // width + 1) ** k for k in range(width + 1))
    found, product, n = [], 1, (1 << 31) - 1
    while product <= 2 * top:
        if is_prime(n):
            found.append(n)
            product *= n
        n -= 2
    return found


def hessenberg(matrix: np.ndarray, p: int) -> np.ndarray:
    """A similar matrix modulo p with nothing below the first subdiagonal."""
    h = matrix.copy()
    for m in range(1, len(h) - 1):
        below = np.nonzero(h[m:, m - 1])[0]
        if not len(below):
            continue
        pivot = m + int(below[0])
        if pivot != m:
            h[[m, pivot]] = h[[pivot, m]]
            h[:, [m, pivot]] = h[:, [pivot, m]]
        factors = h[m + 1 :, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1 :] = (h[m + 1 :] - factors[:, None] * h[m] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1 :] * factors % p).sum(axis=1)) % p
    return h


def characteristic(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(x - matrix) modulo p, lowest first; p is under 2 ** 31."""
    h = hessenberg(matrix, p)
    size = len(h)
    polys = [np.zeros(size + 1, np.int64) for _ in range(size + 1)]
    polys[0][0] = 1
    for k in range(size):
        now = np.roll(polys[k], 1) - h[k, k] * polys[k] % p
        chain = 1
        for i in range(k - 1, -1, -1):
            chain = chain * int(h[i + 1, i]) % p
            if not chain:
                break
            now -= int(h[i, k]) * chain % p * polys[i] % p
        polys[k + 1] = now % p
    return polys[size]


def remaindered(residues: list[tuple[int, list[int]]]) -> list[int]:
    """Whole numbers of least size with the given residues (prime, values)."""
    product = 1
    for p, _ in residues:
        product *= p
    sums = [0] * len(residues[0][1])
    for p, values in residues:
        rest = product // p
        unit = rest * pow(rest % p, -1, p)
        sums = [s + v * unit for s, v in zip(sums, values)]
    sums = [s % product for s in sums]
    return [s - product if 2 * s > product else s for s in sums]


class RealRoots:
    """The roots above 0, greatest first, of a polynomial whose roots are all real and none negative.

    Points are whole multiples of 2 ** -BITS, given as whole numbers.
    """

    def __init__(self, coefficients: list[int]):
        zeros = next(i for i, c in enumerate(coefficients) if c)
        own = coefficients[zeros:]
        self.degree = len(own) - 1
        self.scaled = [c << (BITS * (self.degree - k)) for k, c in enumerate(own)]
        # no root exceeds the sum of all
        self.top = -self.scaled[-2] + 1 if self.degree else 0
        self.above = lru_cache(maxsize=None)(self._above)

    def _above(self, point: int) -> int:
        """Roots greater than the point."""
        shifted = list(self.scaled)
        for i in range(self.degree):
            for k in range(self.degree - 1, i - 1, -1):
                shifted[k] += point * shifted[k + 1]
        signs = [c > 0 for c in shifted if c]
        return sum(a != b for a, b in zip(signs, signs[1:]))

    def value(self, point: int) -> tuple[int, int]:
        """The polynomial and its derivative."""
        now = slope = 0
        for c in reversed(self.scaled):
            slope = slope * point + now
            now = now * point + c
        return now, slope

    def refine(self, low: int, high: int) -> int:
        """The only root in (low, high], rounded."""
        sign_high = self.value(high)[0]
        if sign_high == 0:
            return high
        point = (low + high) // 2
        while high - low > 1:
            now, slope = self.value(point)
            if now == 0:
                return point
            low, high = (low, point) if (now > 0) == (sign_high > 0) else (point, high)
            after = point - now // slope if slope else low
            point = after if low < after < high and abs(after - point) * 2 < high - low else (low + high) // 2
        return high

    def greatest(self, count: int) -> list[int]:
        """The `count` greatest roots, multiple ones as often as they count."""
        count = min(count, self.degree)
        found: list[int] = []
        spans = [(0, self.top)]
        while spans and len(found) < count:
            low, high = spans.pop()
            inside = self.above(low) - self.above(high)
            if not inside:
                continue
            if inside == 1:
                found.append(self.refine(low, high))
            elif high - low <= 1:
                found += [high] * inside
            else:
                middle = (low + high) // 2
                spans += [(low, middle), (middle, high)]
        return found[:count]


def _start(width: int, number: int) -> list[Decimal]:
    """A vector in no special direction, the same on every run."""
    seed, entries = 7 + number, []
    for _ in range(width):
        seed = seed * 6364136223846793005 + 1442695040888963407 & (1 << 64) - 1
        entries.append(Decimal((seed >> 40) - (1 << 23)))
    return entries


def _dot(a: list[Decimal], b: list[Decimal]) -> Decimal:
    return sum((x * y for x, y in zip(a, b)), Decimal(0))


def _unit(v: list[Decimal]) -> list[Decimal]:
    length = _dot(v, v).sqrt()
    return [x / length for x in v]


def _factor(matrix: list[list[int]], root: Decimal):
    """Rows, order and multipliers of matrix - root, eliminated with row exchange."""
    rows = [[Decimal(x) for x in row] for row in matrix]
    size = len(rows)
    for i in range(size):
        rows[i][i] -= root
    tiny = max(abs(root), *(abs(x) for row in rows for x in row)) * Decimal(10) ** -(DIGITS - 5)
    swaps = []
    for k in range(size):
        best = max(range(k, size), key=lambda i: abs(rows[i][k]))
        rows[k], rows[best] = rows[best], rows[k]
        swaps.append(best)
        if abs(rows[k][k]) < tiny:
            rows[k][k] = tiny
        pivot, lead = rows[k], rows[k][k]
        for i in range(k + 1, size):
            row = rows[i]
            if row[k]:
                times = row[k] / lead
                row[k + 1 :] = [x - times * y for x, y in zip(row[k + 1 :], pivot[k + 1 :])]
                row[k] = times
    return rows, swaps


def _solve(factored, right: list[Decimal]) -> list[Decimal]:
    rows, swaps = factored
    size, x = len(rows), list(right)
    # multipliers moved with their rows, so all exchanges come first
    for k, best in enumerate(swaps):
        x[k], x[best] = x[best], x[k]
    for i in range(size):
        x[i] -= _dot(rows[i][:i], x[:i])
    for i in range(size - 1, -1, -1):
        x[i] = (x[i] - _dot(rows[i][i + 1 :], x[i + 1 :])) / rows[i][i]
    return x


def eigenvectors(matrix: list[list[int]], root: int, number: int, count: int) -> tuple[float, list[list[float]]]:
    """The square root of an eigenvalue and `count` orthonormal vectors of its space.

    `number` only chooses where the iteration starts.  The greatest entry is positive.
    """
    with localcontext(Context(prec=DIGITS, Emax=10**12, Emin=-(10**12))):
        value = Decimal(root) / Decimal(2) ** BITS
        factored = _factor(matrix, value)
        found: list[list[Decimal]] = []
        for i in range(count):
            vector = _start(len(matrix), number + i)
            for _ in range(3):
                vector = _unit(_solve(factored, vector))
                for other in found:
                    along = _dot(vector, other)
                    vector = [x - along * y for x, y in zip(vector, other)]
                vector = _unit(vector)
            largest = max(vector, key=abs)
            found.append([-x for x in vector] if largest < 0 else vector)
        return float(value.sqrt()), [[float(x) for x in v] for v in found]
