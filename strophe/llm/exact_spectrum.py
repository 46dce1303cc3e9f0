"""Eigenvalues and eigenvectors of a symmetric positive semidefinite integer matrix, exactly or to any precision.

The characteristic polynomial comes from its residues modulo many primes (Hessenberg form, then a recurrence)
by the Chinese remainder theorem. As all its roots are real, sign changes of the shifted polynomial count roots
exactly (Descartes), so roots are isolated by bisection on dyadic numbers; once alone, a root is narrowed by the sign of the
polynomial. Vectors come from inverse iteration on the shifted matrix in long decimal arithmetic.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator, Sequence
from decimal import Decimal

import numpy as np

#: Relative width of a root's interval: 2^-BITS.
BITS = 128
DIGITS = 100


def is_prime(n: int) -> bool:
    """Miller-Rabin; these bases decide all numbers below 2^32."""
    if n < 4 or n % 2 == 0:
        return n in (2, 3)
    d, r = n - 1, 0
    while d % 2 == 0:
        d, r = d // 2, r + 1
    for base in (2, 7, 61):
        x = pow(base, d, n)
        if base % n == 0 or x in (1, n - 1):
            continue
        if not any((x := x * x % n) == n - 1 for _ in range(r - 1)):
            return False
    return True


def primes(product_over: int) -> list[int]:
    """The largest primes below 2^31 whose product exceeds a bound."""
    out, product, n = [], 1, 1 << 31
    while product <= product_over:
        n -= 1
        if is_prime(n):
            out.append(n)
            product *= n
    return out


def coefficient_bound(matrix: Sequence[Sequence[int]]) -> int:
    """No coefficient is larger: elementary symmetric means of non-negative roots fall with the order."""
    d = len(matrix)
    return (2 + sum(matrix[i][i] for i in range(d)) // max(d, 1)) ** d


def hessenberg(matrix: np.ndarray, p: int) -> np.ndarray:
    """A similar matrix modulo p with zeros below the first subdiagonal; one row update per column."""
    a = matrix.copy()
    for k in range(1, len(a) - 1):
        below = np.flatnonzero(a[k:, k - 1])
        if len(below) == 0:
            continue
        pivot = k + int(below[0])
        if pivot != k:
            a[[k, pivot]] = a[[pivot, k]]
            a[:, [k, pivot]] = a[:, [pivot, k]]
        m = a[k + 1:, k - 1] * pow(int(a[k, k - 1]), -1, p) % p
        a[k + 1:] = (a[k + 1:] - m[:, None] * a[k]) % p
        a[:, k] = (a[:, k] + (a[:, k + 1:] * m % p).sum(axis=1)) % p
    return a


def residue(matrix: Sequence[Sequence[int]], p: int) -> np.ndarray:
    """Characteristic polynomial modulo p, lowest coefficient first."""
    d = len(matrix)
    h = hessenberg(np.array([[v % p for v in row] for row in matrix], dtype=np.int64).reshape(d, d), p)
    poly = np.zeros((d + 1, d + 1), dtype=np.int64)
    poly[0, 0] = 1
    for k in range(1, d + 1):
        weights, chain = np.zeros(k, dtype=np.int64), 1
        weights[k - 1] = h[k - 1, k - 1]
        for i in range(1, k):
            chain = chain * int(h[k - i, k - i - 1]) % p
            if chain == 0:
                break
            weights[k - 1 - i] = int(h[k - 1 - i, k - 1]) * chain % p
        poly[k, 1:] = poly[k - 1, :-1]
        poly[k] = (poly[k] - (weights[:, None] * poly[:k] % p).sum(axis=0)) % p
    return poly[d]


def from_residues(moduli: Sequence[int], residues: Sequence[Sequence[int]]) -> list[int]:
    """Signed whole numbers from their residues, by the Chinese remainder theorem."""
    whole = 1
    for p in moduli:
        whole *= p
    parts = [(whole // p) * pow(whole // p, -1, p) for p in moduli]
    out = []
    for column in zip(*residues):
        v = sum(int(r) * part for r, part in zip(column, parts)) % whole
        out.append(v - whole if 2 * v > whole else v)
    return out


def _scaled(poly: Sequence[int], shift: int) -> list[int]:
    """Coefficients of 2^(shift * degree) * poly(y / 2^shift)."""
    d = len(poly) - 1
    return [c << (shift * (d - k)) for k, c in enumerate(poly)]


def roots_above(poly: Sequence[int], at: int, shift: int) -> int:
    """How many roots, with multiplicity, exceed at / 2^shift; all roots have to be real."""
    c = _scaled(poly, shift)
    for i in range(len(c) - 1):
        for j in range(len(c) - 2, i - 1, -1):
            c[j] += at * c[j + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def sign_at(poly: Sequence[int], at: int, shift: int) -> int:
    value = 0
    for c in reversed(_scaled(poly, shift)):
        value = value * at + c
    return (value > 0) - (value < 0)


def largest_roots(poly: Sequence[int], bound: int, count: int) -> list[tuple[int, int, int]]:
    """(low, high, shift) of the ``count`` largest positive roots, falling: low < root * 2^shift <= high. ``bound`` is over all roots.
    Equal roots come with equal intervals."""
    out = []
    for k in range(1, min(count, roots_above(poly, 0, 0)) + 1):
        lo, hi, shift = 0, bound, 0
        above_lo, above_hi = roots_above(poly, 0, 0), 0
        while hi - lo > 1 or lo.bit_length() <= BITS:
            if hi - lo == 1:
                step = max(1, BITS + 1 - lo.bit_length()) if lo else BITS
                lo, hi, shift = lo << step, hi << step, shift + step
            mid = (lo + hi) // 2
            if above_lo - above_hi == 1:
                sign, end = sign_at(poly, mid, shift), 1 if above_hi % 2 == 0 else -1
                above = above_lo if sign == -end else above_hi
            else:
                above = roots_above(poly, mid, shift)
            if above >= k:
                lo, above_lo = mid, above
            else:
                hi, above_hi = mid, above
        out.append((lo, hi, shift))
    return out


def _solver(matrix: Sequence[Sequence[int]], value: Decimal):
    """LU factors of matrix - value * I with row exchanges; pivots of zero become tiny."""
    d = len(matrix)
    a = [[Decimal(v) - (value if i == j else 0) for j, v in enumerate(row)] for i, row in enumerate(matrix)]
    tiny, order = max(abs(v) for row in a for v in row).scaleb(-DIGITS + 5), list(range(d))
    for k in range(d):
        pivot = max(range(k, d), key=lambda i: abs(a[i][k]))
        a[k], a[pivot], order[k], order[pivot] = a[pivot], a[k], order[pivot], order[k]
        if abs(a[k][k]) < tiny:
            a[k][k] = tiny
        top = a[k]
        for i in range(k + 1, d):
            row = a[i]
            m = row[k] / top[k]
            row[k] = m
            if m:
                for j in range(k + 1, d):
                    row[j] -= m * top[j]

    def solve(b: list[Decimal]) -> list[Decimal]:
        x = [b[i] for i in order]
        for i in range(d):
            x[i] -= sum((a[i][j] * x[j] for j in range(i)), Decimal(0))
        for i in reversed(range(d)):
            x[i] = (x[i] - sum((a[i][j] * x[j] for j in range(i + 1, d)), Decimal(0))) / a[i][i]
        return x

    return solve


def _unit(v: list[Decimal], others: Sequence[list[Decimal]]) -> list[Decimal]:
    for _ in range(2):
        for o in others:
            part = sum((x * y for x, y in zip(v, o)), Decimal(0))
            v = [x - part * y for x, y in zip(v, o)]
        size = sum((x * x for x in v), Decimal(0)).sqrt()
        v = [x / size for x in v]
    return v


def components(matrix: Sequence[Sequence[int]], poly: Sequence[int], count: int) -> Iterator[tuple[Decimal, list[Decimal]]]:
    """(eigenvalue, unit eigenvector) of the ``count`` largest positive eigenvalues; the largest entry of a vector is positive.
    Equal eigenvalues share a solver and get orthogonal vectors."""
    d, last, group, solve = len(matrix), None, [], None
    with decimal.localcontext(prec=DIGITS, Emax=decimal.MAX_EMAX, Emin=decimal.MIN_EMIN):
        for interval in largest_roots(poly, 1 + sum(matrix[i][i] for i in range(d)), count):
            if interval != last:
                lo, hi, shift = last = interval
                value = Decimal(lo + hi) / Decimal(2 << shift)
                group, solve = [], _solver(matrix, value)
            v = [Decimal(1 + (i * 2654435761 + len(group) * 40503) % 65536) for i in range(d)]
            for _ in range(3):
                v = _unit(solve(_unit(v, group)), group)
            group.append(v)
            largest = max(v, key=abs)
            yield value, v if largest > 0 else [-x for x in v]
