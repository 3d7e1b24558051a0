"""Closed-form probabilities as Spark expressions (no lookup tables, no Python)."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

_SMALL = 16


def log_factorial(n: Column) -> Column:
    """ln(n!): exact values below 16, the Stirling series from there on (error below 1e-13)."""
    small = F.array(*[F.lit(math.lgamma(i + 1.0)) for i in range(_SMALL)])
    x = F.greatest(n.cast("double"), F.lit(float(_SMALL)))
    x2 = x * x
    series = (F.lit(1.0 / 12) - (F.lit(1.0 / 360) - (F.lit(1.0 / 1260) - F.lit(1.0 / 1680) / x2) / x2) / x2) / x
    stirling = x * F.ln(x) - x + F.lit(0.5) * F.ln(F.lit(2 * math.pi) * x) + series
    index = F.least(n, F.lit(_SMALL - 1)).cast("int") + 1
    return F.when(n < _SMALL, F.element_at(small, index)).otherwise(stirling)


def log_choose(n: Column, k: Column) -> Column:
    return log_factorial(n) - log_factorial(k) - log_factorial(n - k)


def hypergeometric_tail(x: Column, universe: Column, marked: Column, drawn: Column) -> Column:
    """P(at least x marked) when ``drawn`` of ``universe`` are taken; 1 if nothing is marked or drawn.

    The log of the first term is computed once; the others follow by their ratio, kept relative to it.
    """
    low = F.greatest(x, drawn - (universe - marked), F.lit(0)).cast("bigint")
    high = F.least(marked, drawn).cast("bigint")
    first = log_choose(marked, low) + log_choose(universe - marked, drawn - low) - log_choose(universe, drawn)
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def step(acc: Column, j: Column) -> Column:
        ratio = (
            (marked - j + 1).cast("double") * (drawn - j + 1)
            / (j.cast("double") * (universe - marked - drawn + j))
        )
        term = acc["term"] * ratio
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    later = F.when(high > low, F.sequence(low + 1, high)).otherwise(F.array().cast("array<bigint>"))
    total = F.aggregate(later, start, step, lambda acc: acc["total"])
    p = F.exp(first + F.ln(total))
    return (
        F.when((marked <= 0) | (drawn <= 0) | (low <= F.greatest(drawn - (universe - marked), F.lit(0))), F.lit(1.0))
        .when(high < low, F.lit(0.0))
        .otherwise(F.least(p, F.lit(1.0)))
    )


def kolmogorov_tail(distance: Column, n1: Column, n2: Column, terms: int = 100) -> Column:
    """Limit law of the two-sample Kolmogorov-Smirnov distance, two-sided."""
    n1, n2 = n1.cast("double"), n2.cast("double")
    lam = distance * F.sqrt(F.try_divide(n1 * n2, n1 + n2))
    signed = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.lit(0.0),
        lambda acc, j: acc + F.when(j % 2 == 1, 1.0).otherwise(-1.0) * F.exp(F.lit(-2.0) * j * j * lam * lam),
    )
    p = F.when(lam < 0.2, F.lit(1.0)).otherwise(F.least(F.greatest(F.lit(2.0) * signed, F.lit(0.0)), F.lit(1.0)))
    return F.when((n1 > 0) & (n2 > 0), p)


def neg_log10(p: Column, floor: float = 1e-300) -> Column:
    return -F.log10(F.greatest(p, F.lit(floor)))
