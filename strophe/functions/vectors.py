"""Vector arithmetic on array columns with higher-order functions.

Lambdas are interpreted per element, so anything that is constant for the row is bound
once with ``let`` instead of being repeated inside the inner lambda.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NEG = -1e300


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body`` (a one-element transform)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)


def logsumexp(x: Column) -> Column:
    """Stable log-sum-exp of an array; entries at or below -1e299 count as impossible."""

    def body(mx: Column) -> Column:
        s = F.aggregate(x, F.lit(0.0), lambda acc, v: acc + F.when(v > NEG / 10, F.exp(v - mx)).otherwise(0.0))
        return F.when(mx <= NEG / 10, F.lit(NEG)).otherwise(mx + F.log(s))

    return let(F.array_max(x), body)


def log_softmax(x: Column) -> Column:
    """Log-softmax with the maximum shifted out."""
    return let(logsumexp(x), lambda z: F.transform(x, lambda v: v - z))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def affine(matrix: Column, bias: Column, x: Column) -> Column:
    """``W x + b`` for a matrix given as an array of rows."""
    return F.zip_with(F.transform(matrix, lambda row: dot(row, x)), bias, lambda v, b: v + b)


def entropy(logp: Column) -> Column:
    return -total(F.transform(logp, lambda v: F.exp(v) * v))


def log_add(a: Column, b: Column) -> Column:
    """log(exp a + exp b) with -1e300 standing for zero."""
    hi, lo = F.greatest(a, b), F.least(a, b)
    return F.when(lo <= NEG / 10, hi).otherwise(hi + F.log1p(F.exp(lo - hi)))
