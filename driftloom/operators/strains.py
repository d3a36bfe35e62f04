"""Isolates, candidate strains, and how far each is from a whole later population, without pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

#: Letters of the strains that meet a profile in one task at a time.
LETTERS = 1 << 22


def isolates(records: DataFrame, quality: str, last: str) -> DataFrame:
    """The best record of each accession: the highest ``quality``, nulls after all, then the smallest ``last``.

    Records without an accession are isolates of their own.
    """
    order = F.struct(F.col(quality).isNotNull(), F.col(quality), -F.col(last))
    others = [c for c in records.columns if c != "accession"]
    best = records.where("accession is not null").groupBy("accession").agg(F.max_by(F.struct(*others), order).alias("r")).select("accession", "r.*").select(*records.columns)
    return best.unionByName(records.where("accession is null").select(*best.columns))


def position_counts(rows: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """``keys``, ``pos`` (0 up), ``letter`` and ``n``: how often each letter stands at each place.

    Every batch is counted in a table of places and letters, so what is summed up are cells, not letters.
    """
    types = dict(rows.select(*keys).dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "pos int, letter string, n long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keys)).to_pylist()
            groups: dict[tuple, list[str]] = {}
            for key, text in zip(zip(*(batch.column(i).to_pylist() for i in range(len(keys)))) if keys else [()] * len(texts), texts):
                if text:
                    groups.setdefault(key, []).append(text)
            for key, own in groups.items():
                letters = np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
                sizes = np.array([len(t) for t in own])
                place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                base = int(letters.max()) + 1
                if int(sizes.max()) * base <= 4 * len(letters):
                    table = np.bincount(place * base + letters)
                    cells = np.flatnonzero(table)
                    n = table[cells]
                else:
                    cells, n = np.unique(place * base + letters, return_counts=True)
                fixed = [pa.array([k] * len(cells), batch.schema.field(i).type) for i, k in enumerate(key)]
                made = [pa.array((cells // base).astype(np.int32)), pa.array([chr(c) for c in (cells % base).tolist()], pa.string()), pa.array(n.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(fixed + made, [*keys, "pos", "letter", "n"])

    return rows.select(*keys, sequence).mapInArrow(run, schema).groupBy(*keys, "pos", "letter").agg(F.sum("n").alias("n"))


def _distances(asked: pa.Table, profile: pa.Table) -> pa.Table:
    """The strains of a block with their mean distance to the population that the profile counts."""
    rest = asked.drop_columns(["sequence", "size", "block"])
    if not asked.num_rows:
        return rest.append_column("mean_distance", pa.array([], pa.float64()))
    size, compared = asked["size"][0].as_py(), asked["compared"][0].as_py()
    same = np.zeros(asked.num_rows, np.int64)
    if size:
        letter = np.array([ord(x) for x in profile["letter"].to_pylist()], np.int64)
        known = np.unique(letter)
        # counts by place and letter, the last column for letters that the population hasn't
        table = np.zeros((size, len(known) + 1), np.int64)
        table[profile["pos"].to_numpy(), np.searchsorted(known, letter)] = profile["n"].to_numpy()
        column = np.full(known[-1] + 2, len(known))
        column[known] = np.arange(len(known))
        some = max(1, (1 << 20) // size)
        for first in range(0, asked.num_rows, some):
            text = "".join(asked["sequence"].slice(first, some).to_pylist())
            codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, size)
            same[first : first + some] = table[np.arange(size), column[np.minimum(codes, known[-1] + 1)]].sum(1)
    return rest.append_column("mean_distance", pa.array((size * compared - same) / compared))


def later_distance(candidates: DataFrame, population: DataFrame) -> DataFrame:
    """``window_id``, ``strain_id``, other columns of ``candidates``, ``compared`` and ``mean_distance``: the mean number of places at which a candidate differs from the later population.

    ``candidates`` has window_id, strain_id and sequence, each strain of a window once; ``population`` has
    window_id and a sequence of every isolate. A strain is compared with all isolates of its length in its
    window; without any it has no row. The population is a profile of its letters by place: a strain's
    distance to all of it is the number of isolates with another letter, summed over its places. Strains
    meet the profile in blocks of LETTERS letters, so no row is made for a letter of a strain.
    """
    sized = population.where("sequence is not null").withColumn("size", F.length("sequence"))
    totals = sized.groupBy("window_id", "size").agg(F.count("*").alias("compared"))
    profile = position_counts(sized, ["window_id", "size"], "sequence")
    asked = candidates.where("sequence is not null").withColumn("size", F.length("sequence"))
    blocks = F.ceil(F.count("*") * F.greatest(F.col("size"), F.lit(1)) / LETTERS).cast("int").alias("blocks")
    # a row for each window and length
    met = written(asked.groupBy("window_id", "size").agg(blocks).join(totals, ["window_id", "size"]), "lengths")
    block = F.pmod(F.xxhash64("strain_id"), F.col("blocks")).cast("int")
    asked = asked.join(F.broadcast(met), ["window_id", "size"]).withColumn("block", block).drop("blocks")
    profile = profile.join(F.broadcast(met.select("window_id", "size", "blocks")), ["window_id", "size"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    types = [f"`{c}` {t}" for c, t in asked.drop("sequence", "size", "block").dtypes]
    keys = ["window_id", "size", "block"]
    found = asked.groupBy(*keys).cogroup(profile.groupBy(*keys)).applyInArrow(_distances, ", ".join([*types, "mean_distance double"]))
    return found.select("window_id", "strain_id", *[c for c in candidates.columns if c not in ("window_id", "strain_id", "sequence")], "compared", "mean_distance")
