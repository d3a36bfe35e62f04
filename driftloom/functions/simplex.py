"""Composition functions over long tables: shares, centred logs, softmax and divergences."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

EPSILON = 1e-12


def over(*keys: str) -> WindowSpec:
    return Window.partitionBy(*keys)


def share(value: Column, part: WindowSpec) -> Column:
    """Share of the partition's total, 0 where that is 0."""
    return F.coalesce(F.try_divide(value.cast("double"), F.sum(value).over(part)), F.lit(0.0))


def normalised(value: Column, fallback: Column, part: WindowSpec) -> Column:
    """Negative values as 0, then shares; ``fallback`` where nothing is left."""
    clipped = F.greatest(value, F.lit(0.0))
    total = F.sum(clipped).over(part)
    return F.when(total > 0, clipped / F.when(total > 0, total)).otherwise(fallback)


def centred(value: Column, part: WindowSpec) -> Column:
    return value - F.avg(value).over(part)


def softmax(logit: Column, part: WindowSpec) -> Column:
    raised = F.exp(logit - F.max(logit).over(part))
    return raised / F.sum(raised).over(part)


def divergence_term(observed: Column, predicted: Column) -> Column:
    """A branch's part of the Jensen-Shannon divergence in nats."""
    middle = (observed + predicted) / 2 + EPSILON
    return 0.5 * (observed * F.log((observed + EPSILON) / middle) + predicted * F.log((predicted + EPSILON) / middle))


def spaced(first: float, last: float, index: Column, count: Column) -> Column:
    """Equally spaced values; the first if there is just one."""
    return F.when(count > 1, first + (last - first) * index / F.when(count > 1, count - 1)).otherwise(F.lit(first))


def log_factorial(y: Column) -> Column:
    """ln y! of a number from 0, by Stirling's series above y + 9."""
    z = y + 9.0
    series = (z - 0.5) * F.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * F.pow(z, F.lit(3.0))) + 1 / (1260 * F.pow(z, F.lit(5.0)))
    product = F.lit(1.0)
    for i in range(1, 9):
        product = product * (y + i)
    return series - F.log(product)
