"""Column expressions shared by the operators; all stay inside codegen."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Degrees of freedom up to which the series of Student's t is written out.
SERIES_DOF = 200


def col(name: str) -> Column:
    """Column by exact name: spaces, dots and slashes in the name are allowed."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(name: str, columns: Sequence[str]) -> str:
    """The name, lengthened until no column has it (names do not differ by case alone)."""
    known = {c.lower() for c in columns}
    while name.lower() in known:
        name += "_"
    return name


def clamp_lower(value: Column, floor: float = 0.0) -> Column:
    """The value, or the floor where it lies below; NULL stays NULL."""
    return F.when(value < F.lit(floor), F.lit(floor)).otherwise(value)


def label_if(condition: Column, yes: str, no: str) -> Column:
    """Two-way label; an unknown condition gets the ``no`` label."""
    return F.when(condition, F.lit(yes)).otherwise(F.lit(no))


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation over complete pairs; NULL where either side is constant."""
    x, y = x.cast("double"), y.cast("double")
    both = x.isNotNull() & y.isNotNull()
    px, py = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(px, py), F.stddev_pop(px) * F.stddev_pop(py))


def seeded_hash(keys: Sequence[str], seed: int) -> Column:
    """Order-giving hash of a row key: the same text gives the same digest in any engine."""
    return F.md5(F.concat_ws("|", *[col(k).cast("string") for k in keys], F.lit(str(seed))))


def hash_number(digest: Column) -> Column:
    """First 32 bits of a hex digest as a BIGINT."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def two_sided_p(t: Column, dof: Column) -> Column:
    """P(|T| > |t|) for Student's t with a whole number of degrees of freedom.

    Up to ``SERIES_DOF`` the finite trigonometric series (Abramowitz and Stegun 26.7.3,
    26.7.4), its terms folded over a sequence so that the degrees of freedom may differ
    between rows; beyond, a normal deviate of Hill's expansion and the error function, so
    that no row ever holds more than a fixed number of terms.
    """
    short = _series_p(t, F.least(dof, F.lit(SERIES_DOF)))
    return F.when(dof <= SERIES_DOF, short).otherwise(_normal_p(t, dof))


def _normal_p(t: Column, dof: Column) -> Column:
    """P(|T| > |t|) for many degrees of freedom (Hill 1970, relative error below 1e-7 at 200)."""
    n = dof.cast("double")
    a, b = n - 0.5, 48.0 * (n - 0.5) * (n - 0.5)
    z = F.sqrt(a * F.log1p(t * t / n))
    z2 = z * z
    deviate = z + z * (z2 + 3.0) / b - z * (((0.4 * z2 + 3.3) * z2 + 24.0) * z2 + 85.5) / (
        10.0 * b * (b + 0.8 * z2 * z2 + 100.0)
    )
    return _erfc(deviate / F.lit(2.0**0.5))


def _erfc(x: Column) -> Column:
    """Complementary error function of x >= 0: its power series below 2, a continued fraction above."""
    total = F.lit(0.0)
    for k in range(40, -1, -1):
        total = total * x * x + F.lit((-1.0) ** k / (math.factorial(k) * (2 * k + 1)))
    near = 1.0 - total * x * F.lit(2.0 / math.pi**0.5)
    tail = x
    for k in range(40, 0, -1):
        tail = x + F.lit(k / 2.0) / tail
    far = F.exp(-x * x) / (tail * F.lit(math.pi**0.5))
    return F.when(x < 2.0, near).otherwise(far)


def _series_p(t: Column, dof: Column) -> Column:
    theta = F.atan(F.abs(t) / F.sqrt(dof.cast("double")))
    cos2 = F.cos(theta) * F.cos(theta)
    even = dof % 2 == 0
    start = F.when(even, F.lit(2)).otherwise(F.lit(3)).cast("bigint")
    steps = F.when(
        dof - 2 >= start, F.sequence(start, (dof - 2).cast("bigint"), F.lit(2).cast("bigint"))
    ).otherwise(F.array().cast("array<bigint>"))
    zero = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def fold(acc: Column, k: Column) -> Column:
        term = acc["term"] * cos2 * (k - 1) / k
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    series = F.aggregate(steps, zero, fold, lambda acc: acc["total"])
    inside_even = F.sin(theta) * series
    inside_odd = (
        F.when(dof == 1, theta).otherwise(theta + F.sin(theta) * F.cos(theta) * series)
        * 2.0
        / F.pi()
    )
    return F.lit(1.0) - F.when(even, inside_even).otherwise(inside_odd)
