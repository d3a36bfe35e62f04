"""Exact quantiles of groups of any size, by selection instead of a list of a group's values.

The wanted ranks of a large group are bracketed by a sketch, the values below and inside the brackets
are counted, and brackets that still hold many values are drawn closer around the rank. Only the few
values inside the last brackets are sorted. All groups go through the same passes at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

#: Values that are sorted in one place at most, and the relative accuracy of the sketch.
SORTED = 10_000
ACCURACY = 10_000
#: Steps of the grid by which brackets are drawn closer.
GRID = 256
ROUNDS = 12


def _joined(rows: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join by ``keys`` in which nulls are equal; the other side's keys go."""
    named = other.withColumnsRenamed({k: f"__k{i}" for i, k in enumerate(keys)})
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    both = rows.join(named, reduce(lambda a, b: a & b, same), how) if keys else rows.crossJoin(named)  # without keys one group, a row for each quantile
    return both.drop(*[f"__k{i}" for i in range(len(keys))])


def _between(values: Column, place: Column, last: Column, part: Column) -> Column:
    """The value at a place of a sorted list, moved by ``part`` of the way to the next one."""
    at = place.cast("int")
    low, high = F.get(values, at), F.get(values, F.least(at + 1, last.cast("int")))
    return F.when(low == high, low).otherwise((1 - part) * low + part * high)


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """``keys``, ``n`` and a column for each of ``shares`` (name to share), interpolated between neighbours.

    Null values don't count; groups without others are left out. NaN is larger than all numbers.
    """
    given, keys = keys, [f"__key{i}" for i in range(len(keys))]
    found = _found(rows.select(*[F.col(g).alias(k) for g, k in zip(given, keys)], F.col(value).cast("double").alias("__v")).where("__v is not null"), keys, shares)
    return found.withColumnsRenamed(dict(zip(keys, given)))


def _found(base: DataFrame, keys: list[str], shares: dict[str, float]) -> DataFrame:
    sizes = base.groupBy(*keys).agg(F.count("*").alias("n"))
    if sizes.where(f"n > {SORTED}").isEmpty():
        grouped = base.groupBy(*keys).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("__v")).alias("__s"))
        found = []
        for name, share in shares.items():
            rank = share * (F.col("n") - 1)
            found.append(_between(F.col("__s"), F.floor(rank), F.col("n") - 1, rank - F.floor(rank)).alias(name))
        return grouped.where("n > 0").select(*keys, "n", *found)
    names = list(shares)
    base = written(base, "quantiles")
    slack, margin = 4 / ACCURACY, 2 * GRID // ACCURACY + 1
    asked = [min(1.0, max(0.0, p + d)) for p in shares.values() for d in (-slack, slack)]
    sketch = base.groupBy(*keys).agg(F.count("*").alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi"), F.percentile_approx("__v", asked, ACCURACY).alias("a"))
    brackets = []
    for i, p in enumerate(shares.values()):
        rank = F.lit(p) * (F.col("n") - 1)
        low = F.col("lo") if p <= slack else F.least(F.get("a", F.lit(2 * i)), F.get("a", F.lit(2 * i + 1)))
        high = F.col("hi") if p >= 1 - slack else F.get("a", F.lit(2 * i + 1))
        brackets.append(F.struct(F.lit(i).alias("i"), F.floor(rank).alias("k"), (rank - F.floor(rank)).alias("part"), low.alias("low"), high.alias("high")))
    # a row for each group and quantile
    state = written(sketch.select(*keys, "n", "lo", "hi", F.explode(F.array(*brackets)).alias("b")).select(*keys, "n", "lo", "hi", "b.*"), "brackets")
    point = [*keys, "i"]
    v, low, high, k = F.col("__v"), F.col("low"), F.col("high"), F.col("k")
    needed = F.least(k + 2, F.col("n"))
    for _ in range(ROUNDS):
        inside, between = (v >= low) & (v <= high), (v > low) & (v < high)
        counts = _joined(base, state.select(*point, "low", "high"), keys).groupBy(*point).agg(
            F.count_if(v < low).alias("below"), F.count_if(v == low).alias("at_low"), F.count_if(between).alias("between"), F.count_if(v <= high).alias("upto")
        )
        # ends that many values are equal to need no list
        missed_low, missed_high = F.col("below") > k, F.col("upto") < needed
        wide = (F.col("between") > SORTED) | missed_low | missed_high
        counted = written(_joined(state, counts, point).withColumn("wide", wide), "brackets")
        if counted.where("wide").isEmpty():
            break
        own = _joined(base, counted.where("wide").select(*point, "low", "high"), keys).where(inside)
        grid = own.groupBy(*point).agg(F.percentile_approx("__v", [j / GRID for j in range(GRID + 1)], ACCURACY).alias("g"))
        place = (k - F.col("below")) / F.greatest(F.col("upto") - F.col("below"), F.lit(1)) * GRID
        nearer_low = F.get("g", F.greatest(F.floor(place) - margin, F.lit(0)).cast("int"))
        nearer_high = F.get("g", F.least(F.ceil(place) + margin + 1, F.lit(GRID)).cast("int"))
        # lo and hi are sure to hold the rank and the next one; a bracket that missed one is opened up to them, and has moved them itself
        lo = F.when(~missed_low, F.greatest("lo", "low")).when(F.col("upto") <= k, F.greatest("lo", "high")).otherwise(F.col("lo"))
        hi = F.when(~missed_high, F.least("hi", "high")).when(F.col("below") >= needed, F.least("hi", "low")).otherwise(F.col("hi"))
        closer = counted.where("wide").withColumns({"lo": lo, "hi": hi, "missed": missed_low | missed_high})
        closer = _joined(closer, grid, point, "left").select(
            *point, "n", "lo", "hi", "k", "part",
            F.when(F.col("missed"), F.col("lo")).otherwise(nearer_low).alias("low"),
            F.when(F.col("missed"), F.col("hi")).otherwise(nearer_high).alias("high"),
        )
        state = written(closer.unionByName(counted.where("not wide").select(*closer.columns)), "brackets")
    else:
        raise RuntimeError(f"brackets are not small after {ROUNDS} rounds")
    own = _joined(base, counted.where("between > 0").select(*point, "low", "high"), keys).where((v > low) & (v < high))
    lists = own.groupBy(*point).agg(F.sort_array(F.collect_list("__v")).alias("__s"))
    first = F.col("below") + F.col("at_low")
    value = lambda r: F.when(r < first, low).when(r >= first + F.col("between"), high).otherwise(F.get("__s", (r - first).cast("int")))
    one, two = value(k), value(F.least(k + 1, F.col("n") - 1))
    several = _joined(counted, lists, point, "left")
    every = several.select(*point, "n", F.when(one == two, one).otherwise((1 - F.col("part")) * one + F.col("part") * two).alias("q"))
    return every.groupBy(*keys).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("i") == i, F.col("q"))).alias(name) for i, name in enumerate(names)])
