"""Eigenvalues and eigenvectors of a symmetric positive semidefinite integer matrix, from its exact characteristic polynomial.

The polynomial is found modulo many primes, by reduction to Hessenberg form, and put together
by the Chinese remainder theorem; a bound on its coefficients tells how many primes are
enough. All its roots are real and none is negative, so the number of roots above ``a`` is
exactly the number of sign changes in the coefficients of ``p(x + a)``: bisection with whole
numbers isolates each root to as many bits as wanted, equal roots included. Components come
from inverse iteration close to the root, in decimals of enough digits.
"""

from __future__ import annotations

from decimal import Decimal, localcontext
from math import comb

import numpy as np

#: Bits of a root behind the binary point of a whole eigenvalue, and digits of the null-space steps.
FRACTION, DIGITS = 64, 80


def primes(count: int) -> list[int]:
    """The largest primes below 2**31: products of two residues fit a signed 64-bit number."""
    found, n = [], (1 << 31) - 1
    while len(found) < count:
        if n % 3 and all(_passes(n, b) for b in (2, 3, 5, 7)):
            found.append(n)
        n -= 2
    return found


def _passes(n: int, base: int) -> bool:
    """The strong probable-prime test, which for these four bases is a proof below 3.2 * 10**9."""
    twos = (n - 1 & 1 - n).bit_length() - 1
    x = pow(base, n - 1 >> twos, n)
    return x in (1, n - 1) or any((x := x * x % n) == n - 1 for _ in range(twos - 1))


def coefficient_bound(trace: int, size: int) -> int:
    """No coefficient is larger: the roots are not negative and add up to ``trace`` (Maclaurin)."""
    return max(comb(size, k) * (trace**k // size**k + 1) for k in range(size + 1))


def residues(matrix: list[list[int]], p: int) -> list[int]:
    """The coefficients of det(x - matrix) modulo ``p``, highest power first."""
    n = len(matrix)
    a = np.array([[v % p for v in row] for row in matrix], dtype=np.int64).reshape(n, n)
    for k in range(n - 2):  # similar matrices: rows and columns change together
        below = np.flatnonzero(a[k + 1 :, k])
        if not len(below):
            continue
        if below[0]:
            at = k + 1 + int(below[0])
            a[[k + 1, at]] = a[[at, k + 1]]
            a[:, [k + 1, at]] = a[:, [at, k + 1]]
        u = a[k + 2 :, k] * pow(int(a[k + 1, k]), p - 2, p) % p
        a[k + 2 :] = (a[k + 2 :] - u[:, None] * a[k + 1]) % p
        a[:, k + 1] = (a[:, k + 1] + (a[:, k + 2 :] * u % p).sum(1)) % p
    # leading minors of x - a: row m holds the polynomial of size m, lowest power first
    minors = np.zeros((n + 1, n + 1), dtype=np.int64)
    minors[0, 0] = 1
    for m in range(1, n + 1):
        minors[m, 1:] = minors[m - 1, :-1]
        weights = np.empty(m, dtype=np.int64)
        weights[m - 1] = a[m - 1, m - 1]
        product = 1
        for i in range(m - 2, -1, -1):
            product = product * int(a[i + 1, i]) % p
            weights[i] = int(a[i, m - 1]) * product % p
        minors[m] = (minors[m] - (minors[:m] * weights[:, None] % p).sum(0)) % p
    return minors[n, ::-1].tolist()


def combine(rows: list[tuple[int, list[int]]]) -> list[int]:
    """The whole coefficients, of either sign, from their residues by prime."""
    modulus, values = 1, [0] * len(rows[0][1])
    for p, part in rows:
        inverse = pow(modulus, p - 2, p)
        values = [v + modulus * ((r - v) * inverse % p) for v, r in zip(values, part, strict=True)]
        modulus *= p
    return [v - modulus if 2 * v > modulus else v for v in values]


def _above(poly: list[int], a: int) -> int:
    """How many roots, all of them real, are greater than ``a``."""
    shifted, n = list(poly), len(poly)
    for stop in range(n, 1, -1):
        for i in range(1, stop):
            shifted[i] += a * shifted[i - 1]
    signs = [c > 0 for c in shifted if c]
    return sum(x != y for x, y in zip(signs, signs[1:], strict=False))


def roots(poly: list[int], count: int, bits: int = FRACTION) -> list[int]:
    """The ``count`` largest roots times ``2**bits``, each rounded up, largest first."""
    scaled = [c << bits * k for k, c in enumerate(poly)]
    top = max(1, -scaled[1] if len(scaled) > 1 else 1)  # the sum of the roots
    found = []

    def isolate(low: int, high: int, over: int, upto: int) -> None:
        """Roots in ``(low, high]``: those numbered ``over + 1`` to ``upto`` from the top."""
        if over >= min(upto, count):
            return
        if high - low == 1:
            found.extend([high] * (min(upto, count) - over))
            return
        middle = (low + high) // 2
        between = _above(scaled, middle)
        isolate(middle, high, over, between)
        isolate(low, middle, between, upto)

    isolate(-1, top, 0, len(poly) - 1)
    return found


def components(matrix: list[list[int]], scaled: list[int], bits: int = FRACTION) -> np.ndarray:
    """A unit vector for each of the roots, orthogonal to each other, in double precision."""
    n = len(matrix)
    held: list[np.ndarray] = []
    with localcontext() as context:
        context.prec = DIGITS + len(str(max(scaled, default=1)))
        exact = np.array([[Decimal(v) for v in row] for row in matrix], dtype=object).reshape(n, n)
        for number, root in enumerate(scaled):
            near = exact.copy()
            shift = Decimal(root) / Decimal(1 << bits) + Decimal(1) / Decimal(1 << bits + 8)  # beside the root, so that it can be solved
            for i in range(n):
                near[i, i] -= shift
            factors, order = _factor(near)
            rng = np.random.default_rng(number)
            v = np.array([Decimal(int(x)) for x in rng.integers(-1000, 1001, n)], dtype=object)
            for _ in range(3):
                v = _solve(factors, order, v)
                for other, at in zip(held, scaled, strict=False):
                    if abs(at - root) <= 1 << bits // 2:  # equal, or as good as equal: any basis of their space will do
                        v = v - other * (other @ v)
                v = v / (v @ v).sqrt()
            held.append(v)
    return np.array([[float(x) for x in v] for v in held]).reshape(len(held), n)


def _factor(a: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """LU with row exchanges, in place."""
    n = len(a)
    order = list(range(n))
    for k in range(n):
        at = k + max(range(n - k), key=lambda i: abs(a[k + i, k]))
        if at != k:
            a[[k, at]] = a[[at, k]]
            order[k], order[at] = order[at], order[k]
        if k + 1 < n:
            a[k + 1 :, k] = a[k + 1 :, k] / a[k, k]
            a[k + 1 :, k + 1 :] = a[k + 1 :, k + 1 :] - a[k + 1 :, k, None] * a[k, k + 1 :]
    return a, order


def _solve(a: np.ndarray, order: list[int], b: np.ndarray) -> np.ndarray:
    x = b[order]
    for i in range(1, len(x)):
        x[i] = x[i] - a[i, :i] @ x[:i]
    for i in range(len(x) - 1, -1, -1):
        rest = a[i, i + 1 :] @ x[i + 1 :] if i + 1 < len(x) else Decimal(0)
        x[i] = (x[i] - rest) / a[i, i]
    return x


def enough_primes(trace: int, size: int) -> list[int]:
    """As many primes as the coefficients of a matrix of this trace and size, and their signs, can need; each exceeds 2**30."""
    return primes((2 * coefficient_bound(trace, size) + 1).bit_length() // 30 + 1)
