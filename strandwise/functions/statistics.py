"""Probabilities that Spark has no function for, as expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def ln_factorial(n: Column) -> Column:
    """The logarithm of n!: exact up to 20, then Stirling's series, whose error is under 1e-13."""
    known = F.array(*[F.lit(math.lgamma(k + 1)) for k in range(21)])
    x = (n + 1).cast("double")
    series = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0))) - 1 / (1680 * F.pow(x, F.lit(7.0)))
    return F.when(n <= 20, F.get(known, F.greatest(F.least(n, F.lit(20)), F.lit(0)).cast("int"))).otherwise(series)


def two_tailed(z: Column) -> Column:
    """The chance of a standard normal value at least as far from 0 as z; 0 beyond 8."""
    a = F.least(F.abs(z), F.lit(8.0))
    # erf(a / sqrt 2) = sqrt(2 / pi) exp(-a a / 2) sum of a^(2n+1) / (1 3 5 ... (2n+1)), all terms positive.
    step = lambda s, n: F.struct((s["term"] * a * a / (2 * n + 1)).alias("term"), (s["total"] + s["term"] * a * a / (2 * n + 1)).alias("total"))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(120)), F.struct(a.alias("term"), a.alias("total")), step, lambda s: s["total"])
    erf = math.sqrt(2 / math.pi) * F.exp(-a * a / 2) * total
    return F.when(F.abs(z) >= 8, 0.0).when(z.isNotNull(), F.greatest(1 - erf, F.lit(0.0)))


def hypergeometric_tail(hits: Column, drawn: Column, marked: Column, population: Column) -> Column:
    """The chance of at least ``hits`` marked ones among ``drawn`` of a population with ``marked``; 1 for no hits.

    All whole numbers; the terms, at most as many as are marked or drawn, are added up one by one.
    """
    ways = lambda n, k: ln_factorial(n) - ln_factorial(k) - ln_factorial(n - k)
    last = F.least(marked, drawn)
    whole = ways(population, drawn)
    terms = F.transform(F.sequence(hits, F.greatest(last, hits)), lambda k: F.when((k <= last) & (drawn - k <= population - marked), F.exp(ways(marked, k) + ways(population - marked, drawn - k) - whole)).otherwise(0.0))
    return F.when(hits <= 0, 1.0).otherwise(F.least(F.lit(1.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)))
