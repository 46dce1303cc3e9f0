"""Column expressions shared by the operators. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR = 1e-300
EULER_GAMMA = 0.5772156649015329


def ratio(num: Column, den: Column) -> Column:
    """``num / den`` as a double, null where the denominator is zero."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def ratio_or_zero(num: Column, den: Column) -> Column:
    return F.coalesce(ratio(num, den), F.lit(0.0))


def harmonic_f1(precision: Column, recall: Column) -> Column:
    """F1 from precision and recall; null when either is null or both are zero."""
    return ratio(2 * precision * recall, precision + recall)


def count_if(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))



def signed_log(x: Column) -> Column:
    """Monotone compression ``sign(x) * log1p(|x|)``."""
    return F.signum(x) * F.log1p(F.abs(x))


def log_ratio(a: Column, b: Column) -> Column:
    floor = F.lit(FLOOR)
    return F.log(F.greatest(a, floor)) - F.log(F.greatest(b, floor))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-F.greatest(F.least(x, F.lit(709.0)), F.lit(-709.0))))


def clipped(p: Column, eps: float) -> Column:
    return F.least(F.greatest(p, F.lit(eps)), F.lit(1.0 - eps))


def log_loss(label: Column, p: Column, eps: float) -> Column:
    c = clipped(p, eps)
    return -F.when(label == 1, F.log(c)).otherwise(F.log1p(-c))


def order_code(x: Column, integral: bool = False) -> Column:
    """Monotone 64-bit code of a number: integers as they are, doubles by exponent and mantissa.

    The code is a fixed function of the value (no sampling), so every task and every retry gets
    the same; numbers that differ have codes that differ down to the last bits of a double.
    Magnitudes under 1e-300 share the code of zero.
    """
    if integral:
        return x.cast("long")
    d = x.cast("double")
    size = F.least(F.abs(d), F.lit(1.7e308))
    guess = F.floor(F.log2(size))
    scaled = size / F.pow(F.lit(2.0), guess)
    # the logarithm may be off by one next to a power of two
    shift = F.when(scaled >= 2.0, 1).when(scaled < 1.0, -1).otherwise(0)
    mantissa = size / F.pow(F.lit(2.0), guess + shift) - 1.0
    code = (guess + shift + 1000).cast("long") * (1 << 52) + F.floor(mantissa * float(1 << 52)).cast("long")
    return F.when(size < 1e-300, F.lit(0).cast("long")).otherwise(F.when(d < 0, -code).otherwise(code))


def harmonic(n: Column) -> Column:
    """Harmonic number H(n): exact sum for small n, asymptotic series (1e-16) above."""
    x = n.cast("double")
    small = F.aggregate(
        F.sequence(F.lit(1), F.least(F.greatest(n.cast("int"), F.lit(1)), F.lit(32))),
        F.lit(0.0),
        lambda acc, i: acc + 1.0 / i,
    )
    large = (
        F.log(x) + EULER_GAMMA + 1.0 / (2 * x) - 1.0 / (12 * x * x)
        + 1.0 / (120 * F.pow(x, F.lit(4))) - 1.0 / (252 * F.pow(x, F.lit(6)))
    )
    return F.when(n <= 0, F.lit(0.0)).when(n <= 32, small).otherwise(large)


def hash_long(*parts: Column, digits: int = 8) -> Column:
    """Non-negative draw of 4 * ``digits`` bits (at most 60) from an md5 digest; the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", *parts)), 1, digits), 16, 10).cast("long")
