"""A log-structured index of window hashes, for de-duplication batch by batch (operator 3).

Each batch becomes an immutable run: a bucketed table of (hash, document key, how often), sorted by hash
within its buckets. A new batch is merge-joined with every run (runs are bucketed alike, so only the
batch itself is shuffled); what meets, on either side, are the candidates that the caller verifies. When
``FAN`` runs of a level are there, they are compacted to one of the next level, so a history of n
batches has about FAN * log(n) runs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, cleaned

FAN = 3
_COLUMNS = ("hash", "k", "t", "n")


class FingerprintIndex:
    """Runs of (hash, k, t, n) over all batches added so far; as a context manager it drops them at the end.

    Runs are tables of the session's catalog, since only these are joined by bucket; their names start
    with ``name``.
    """

    def __init__(self, spark: SparkSession, scratch: Scratch, buckets: int | None = None, name: str | None = None):
        self.spark, self.scratch = spark, scratch
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[tuple[int, str]] = []
        self.name = name or f"driftloom_run_{uuid.uuid4().hex[:10]}"
        self.made = 0

    def __enter__(self) -> FingerprintIndex:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def _write(self, rows: DataFrame, level: int) -> str:
        name = f"{self.name}_{self.made}"
        self.made += 1
        self.runs.append((level, name))
        dealt = rows.select(*_COLUMNS).repartition(self.buckets, "hash")
        with cleaned(self.spark):
            dealt.write.bucketBy(self.buckets, "hash").sortBy("hash").option("path", self.scratch.path(name)).saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"drop table if exists {name}")
        self.scratch.drop(name)

    def add(self, rows: DataFrame) -> DataFrame:
        """Add a batch (hash, k, t and n, how often document (k, t) has it); the candidates it makes: hash, k, t.

        Candidates are the rows of the batch whose hash it has twice or an earlier run has, and the
        rows of earlier runs whose hash it has. Null hashes are left out. Without ``k`` and ``t`` the
        document is null, without ``n`` each row counts once; all batches have the same columns.
        """
        absent = {"k": F.lit(None).cast("long"), "t": F.lit(None).cast("long"), "n": F.lit(1).cast("long")}
        rows = rows.withColumns({c: v for c, v in absent.items() if c not in rows.columns})
        older = [name for _, name in self.runs]
        batch = self.spark.table(self._write(rows.where("hash is not null"), 0))
        own = batch.groupBy("hash").agg(F.sum("n").alias("met"))
        known = own.where("met > 1").select("hash")
        found = None
        for name in older:
            run = self.spark.table(name)
            known = known.unionByName(own.join(run, "hash", "left_semi").select("hash"))
            met = run.join(own, "hash", "left_semi").select("hash", "k", "t")
            found = met if found is None else found.unionByName(met)
        known = self.scratch.keep(known.distinct(), f"known-{self.made}")
        met = batch.join(known, "hash", "left_semi").select("hash", "k", "t")
        found = self.scratch.keep(met if found is None else found.unionByName(met), f"candidates-{self.made}")
        self.scratch.drop(f"known-{self.made}")
        self._compact()
        return found

    def _compact(self) -> None:
        level = 0
        while len(own := [name for at, name in self.runs if at == level]) >= FAN:
            merged = self.spark.table(own[0])
            for name in own[1:]:
                merged = merged.unionByName(self.spark.table(name))
            self._write(merged, level + 1)
            for name in own:
                self._drop(name)
            self.runs = [r for r in self.runs if r[1] not in own]
            level += 1

    def close(self) -> None:
        """Drop all runs."""
        for _, name in self.runs:
            self._drop(name)
        self.runs = []
