"""Two-sided p-values of z and t, on columns.

Each series has a fixed number of steps, so one row costs the same at any sample size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ERF_STEPS = 60


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0.

    Below 3 the power series of erf, above it the continued fraction, which keeps its
    relative precision far into the tail.
    """
    steps = F.sequence(F.lit(1), F.lit(ERF_STEPS))
    start = F.struct(x.alias("term"), x.alias("total"))

    def add_term(acc: Column, n: Column) -> Column:
        term = acc["term"] * (2 * x * x) / (2 * n + 1)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    series = F.aggregate(steps, start, add_term)["total"]
    near = 1 - F.exp(-x * x) * series * (2 / math.sqrt(math.pi))
    fraction = F.aggregate(F.reverse(steps), x, lambda f, n: x + (n / 2) / f)
    far = F.exp(-x * x) / (fraction * math.sqrt(math.pi))
    return F.when(x < 3, near).otherwise(far)


def two_sided_normal(z: Column) -> Column:
    return erfc(F.abs(z) / math.sqrt(2))


def _exp_sinh(step: float = 0.09, reach: int = 45) -> list[tuple[float, float]]:
    """Places y > 0 and weights of the exp-sinh rule for integrals from 0 to infinity."""
    rows = []
    for k in range(-reach, reach + 1):
        y = math.exp(math.pi / 2 * math.sinh(k * step))
        rows.append((y, y * math.pi / 2 * math.cosh(k * step) * step))
    return rows


def two_sided_t(t: Column, df: Column) -> Column:
    """p-value of Student's t, by one formula for all degrees of freedom.

    With sinh(w) = t / sqrt(df) the density is a power of 1 / cosh(w), so the p-value is the
    integral of cosh(w) ** -df beyond w over that beyond 0. Both are taken by a fixed rule, in
    steps of 1 / sqrt(df), in which the integrand has much the same width at any sample size.
    """
    df = F.nullif(df.cast("double"), F.lit(0.0))
    root = F.sqrt(df)
    places = F.array(*[F.struct(F.lit(y).alias("y"), F.lit(w).alias("w")) for y, w in _exp_sinh()])

    def beyond(w: Column) -> Column:
        def add(total: Column, node: Column) -> Column:
            z = w + node["y"] / root
            log_cosh = z + F.log1p(F.exp(-2 * z)) - math.log(2)
            return total + node["w"] * F.exp(-df * log_cosh)

        return F.aggregate(places, F.lit(0.0), add)

    start = F.log(F.abs(t) / root + F.sqrt(1 + t * t / df))
    p = beyond(start) / beyond(F.lit(0.0))
    return F.when(p > 1, 1.0).otherwise(p)


def exact_rank_sum(least: Column, steps: Column) -> Column:
    """Two-sided p-value of a signed-rank sum, each difference having either sign with equal chance.

    ``steps`` are the ranks, doubled to whole numbers, with how often each occurs; ``least`` is the smaller
    rank sum. The chances of all sums build up rank by rank: a rank is added or not. Equal to the usual
    tables where there are no ties, and holds with ties as well. The work grows with the cube of the
    number of differences.
    """

    def add(chances: Column, step: Column) -> Column:
        gap = F.array_repeat(F.lit(0.0), step["step"])
        return F.zip_with(F.concat(chances, gap), F.concat(gap, chances), lambda out, into: (out + into) / 2)

    every = F.flatten(F.transform(steps, lambda s: F.array_repeat(s, s["times"].cast("int"))))
    chances = F.aggregate(every, F.array(F.lit(1.0)), add)
    tail = F.aggregate(F.slice(chances, 1, (2 * least).cast("int") + 1), F.lit(0.0), lambda total, x: total + x)
    return F.least(2 * tail, F.lit(1.0))
