"""Intervals and exact tests as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Fixed value: the normal quantile of a 95 % interval.
Z = 1.959963984540054


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """Lower and upper bound of the 95 % Wilson interval of k of n; null where n is 0."""
    p, z2 = k / n, Z * Z
    mid, half, den = p + z2 / (2 * n), Z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)), 1 + z2 / n
    bound = lambda x: F.when(n > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), x / den)))
    return bound(mid - half), bound(mid + half)


def mcnemar(b: Column, c: Column) -> Column:
    """Exact two-sided p of b against c discordant pairs: 1 where there are none.  Terms are summed by their logarithms."""
    n, m = (b + c).cast("int"), F.least(b, c).cast("int")
    # log C(n, i) grows by log((n - i + 1) / i)
    start = F.struct((n * F.log(F.lit(0.5))).alias("term"), F.exp(n * F.log(F.lit(0.5))).alias("sum"))
    step = lambda a, i: F.struct((a.term + F.log((n - i + 1) / i)).alias("term"), (a["sum"] + F.exp(a.term + F.log((n - i + 1) / i))).alias("sum"))
    tail = F.when(m > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(m, F.lit(1))), start, step)["sum"]).otherwise(F.exp(n * F.log(F.lit(0.5))))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail))
