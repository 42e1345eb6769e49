"""Small fixed-size vector and matrix algebra on ``array<double>`` columns.

Sizes are known (2, 3, 4 or a row-major 3x3), so the expressions are unrolled:
they run inside whole-stage code generation, which higher-order functions do not.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``.

    Inlined reuse doubles an expression at every step and soon exceeds what the code
    generator accepts; a bound variable keeps it linear.
    """
    return F.transform(F.array(value), lambda v: body(v)).getItem(0)


def vec(*parts) -> Column:
    return F.array(*[(p if isinstance(p, Column) else F.lit(p)).cast("double") for p in parts])


def parts(v: Column, n: int = 3) -> list[Column]:
    return [v.getItem(i) for i in range(n)]


def total(columns) -> Column:
    return reduce(lambda a, b: a + b, columns)


def dot(a: Column, b: Column, n: int = 3) -> Column:
    return total(a.getItem(i) * b.getItem(i) for i in range(n))


def norm(a: Column, n: int = 3) -> Column:
    return F.sqrt(dot(a, a, n))


def add(a: Column, b: Column, n: int = 3) -> Column:
    return F.array(*[a.getItem(i) + b.getItem(i) for i in range(n)])


def sub(a: Column, b: Column, n: int = 3) -> Column:
    return F.array(*[a.getItem(i) - b.getItem(i) for i in range(n)])


def scaled(a: Column, k, n: int = 3) -> Column:
    return F.array(*[a.getItem(i) * k for i in range(n)])


def lerp(a: Column, b: Column, alpha: Column, n: int = 3) -> Column:
    """Linear blend with weight ``alpha`` on ``b``; ``alpha`` 0 returns ``a`` exactly."""
    return F.array(*[(F.lit(1.0) - alpha) * a.getItem(i) + alpha * b.getItem(i) for i in range(n)])


def lerp_any(a: Column, b: Column, alpha: Column) -> Column:
    """Linear blend for arrays whose length is not known up front."""
    return F.zip_with(a, b, lambda x, y: (F.lit(1.0) - alpha) * x + alpha * y)


def cross(a: Column, b: Column) -> Column:
    (ax, ay, az), (bx, by, bz) = parts(a), parts(b)
    return F.array(ay * bz - az * by, az * bx - ax * bz, ax * by - ay * bx)


def mat_vec(m: Column, v: Column) -> Column:
    """Row-major 3x3 matrix (array of 9) times a 3-vector."""
    return F.array(*[total(m.getItem(3 * r + c) * v.getItem(c) for c in range(3)) for r in range(3)])


def mat_mul(a: Column, b: Column) -> Column:
    return F.array(*[
        total(a.getItem(3 * r + k) * b.getItem(3 * k + c) for k in range(3))
        for r in range(3) for c in range(3)
    ])


def transpose(m: Column) -> Column:
    return F.array(*[m.getItem(3 * c + r) for r in range(3) for c in range(3)])


def det3(m: Column) -> Column:
    g = m.getItem
    return (g(0) * (g(4) * g(8) - g(5) * g(7))
            - g(1) * (g(3) * g(8) - g(5) * g(6))
            + g(2) * (g(3) * g(7) - g(4) * g(6)))


def is_number(c: Column) -> Column:
    """True only for a present, finite number; null and NaN are not numbers."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def all_numbers(v: Column) -> Column:
    """Present array whose every element is a finite number."""
    return v.isNotNull() & F.forall(v, is_number)


def finite_items(v: Column) -> Column:
    """``all_numbers`` of an array of doubles that is not empty, without a lambda: false or null if one is not finite.

    A search that finds nothing is null rather than false if the array holds a null.
    """
    infinite = F.lit(float("inf"))
    return ~F.array_contains(v, F.lit(float("nan"))) & (F.array_min(v) > -infinite) & (F.array_max(v) < infinite)


def clip(c: Column, low, high) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))
