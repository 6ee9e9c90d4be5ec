"""Numbers as Columns: truncating division, quantiles, intervals, folds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Standard normal quantile for two-sided 95 %.
Z95 = 1.959963984540054


def c_div(a: Column, b: Column) -> Column:
    """P5: quotient cut towards zero; null for a zero divisor."""
    return F.call_function("div", a, F.nullif(b, F.lit(0)))


def c_mod(a: Column, b: Column) -> Column:
    return F.try_mod(a, b)


def ratio(a: Column, b: Column) -> Column:
    """a / b as double; null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def wilson(successes: Column, n: Column, upper: bool, z: float = Z95) -> Column:
    """A bound of the Wilson interval; null for no trials."""
    n = n.cast("double")
    p = F.try_divide(successes.cast("double"), n)
    centre, spread = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.when(n > 0, ((centre + spread) if upper else (centre - spread)) / (1 + z * z / n))


def pass_at_k(n: Column, c: Column, k: Column) -> Column:
    """Chance that one of k of n samples, c of them right, is right."""
    miss = F.aggregate(F.sequence(n - c + 1, n), F.lit(1.0), lambda a, i: a * (1 - k.cast("double") / i.cast("double")))
    return F.when(c == 0, 0.0).when(n - c < k, 1.0).otherwise(1 - miss)


def nearest_rank(values: Column, p: float) -> Column:
    """The value at index min(n - 1, floor(p * n)) of an array, sorted; null for none."""
    n = F.size(values)
    return F.when(n > 0, F.get(F.array_sort(values), F.least(n - 1, F.floor(F.lit(p) * n).cast("int"))))


def fold(key: Column, k: int) -> Column:
    """Fold of a key by the first eight bytes of its SHA-256."""
    return (F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("decimal(20,0)") % k).cast("int")


def correlation(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Pearson's r from sums; null below two rows or without variance."""
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    return F.when((n >= 2) & (vx > 0) & (vy > 0), F.try_divide(n * sxy - sx * sy, F.sqrt(F.greatest(vx, F.lit(0.0))) * F.sqrt(F.greatest(vy, F.lit(0.0)))))


def evenly_spaced(pos: Column, n: Column, most: int) -> Column:
    """Is position pos (from 0) of n one of `most` evenly spaced ones, (i * (n - 1)) div (most - 1)?"""
    if most < 2:
        return pos == 0
    chosen = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.floor(i * (n - 1) / (most - 1)).cast("long"))
    return F.when(n <= most, F.lit(True)).otherwise(F.array_contains(chosen, pos.cast("long")))
