"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

MAX_ROUNDS = 60


def _large_star(scratch: Scratch, links: DataFrame, name: str) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # as a table of its own, so that the join below may split a node with very many links
    least = scratch.keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), name)
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(scratch: Scratch, links: DataFrame, name: str) -> DataFrame:
    links = scratch.keep(links, f"{name}-in")
    least = scratch.keep(links.groupBy("u").agg(F.min("v").alias("m")), name)
    moved = links.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def connected(scratch: Scratch, links: DataFrame, label: str) -> DataFrame:
    """``node``, ``component`` (smallest node reachable) of every node with a link.

    ``links`` has two long columns, ``a`` and ``b``; loops and repeated links don't matter, nulls are
    left out. Every round is written to the shared folder, so no plan grows with the rounds.
    """
    ends = links.where("a is not null and b is not null and a <> b")
    state = scratch.keep(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{label}-0")
    for i in range(1, MAX_ROUNDS + 1):
        names = [f"{label}-{i}-{part}" for part in ("large", "small")]
        state = scratch.keep(_small_star(scratch, _large_star(scratch, state, names[0]), names[1]).distinct(), f"{label}-{i}")
        scratch.drop(f"{label}-{i - 1}", *names, f"{names[1]}-in")
        # over when every node has one parent, and no parent has one
        both = state.unionByName(state.select(F.col("v").alias("u"), F.lit(None).cast("long").alias("v")))
        roles = both.groupBy("u").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count_if(F.col("v").isNull()).alias("children"))
        if roles.where("low < high or (low is not null and children > 0)").isEmpty():
            break
    else:
        raise RuntimeError(f"components are not settled after {MAX_ROUNDS} rounds")
    nodes = state.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
