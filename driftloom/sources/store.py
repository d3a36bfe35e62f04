"""A score table on shared storage that grows by key: merges are versions, published one after another.

The rows of a version lie in folders by a hash of their key. A merge reads and writes just the folders
that its rows fall into; a small numbered file then names the folders of the new version. A file of
that number is there once or not at all, so a writer that comes second merges again with what the first
one published, and one that is killed before leaves the version before it as it was.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.simplex import over
from .shared import folder

BUCKETS = 64
TRIES = 20


class Moved(RuntimeError):
    """Another writer published a version of this number first."""


class ScoreStore:
    """Rows by ``keys``; of two rows of a key the one with the larger ``newest`` counts, null before all.

    ``parameters`` are kept with the table: opening it with others is an error.
    """

    def __init__(self, spark: SparkSession, root: str, keys: list[str], newest: str, parameters: dict | None = None, buckets: int = BUCKETS):
        self.spark, self.root, self.keys, self.newest = spark, root.rstrip("/"), keys, newest
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._own = {"keys": keys, "newest": newest, "parameters": json.loads(json.dumps(parameters or {}))}
        self.buckets = buckets
        held = self._pointer(self.version())
        if held:
            self.buckets = held["buckets"]
            if changed := sorted(k for k in self._own if held[k] != self._own[k]):
                names = {p for p in {*held["parameters"], *self._own["parameters"]} if held["parameters"].get(p) != self._own["parameters"].get(p)}
                raise ValueError(f"the table was made with other values of {', '.join(sorted(names) or changed)}")

    def version(self) -> int:
        """The number of the last version; 0 before the first."""
        folder = self._hadoop.Path(f"{self.root}/versions")
        if not self._fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max((int(n[:-5]) for n in names if n.endswith(".json")), default=0)

    def _pointer(self, version: int) -> dict | None:
        if not version:
            return None
        stream = self._fs.open(self._hadoop.Path(f"{self.root}/versions/{version:09d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the last one if none is named."""
        held = self._pointer(self.version() if version is None else version)
        if not held:
            raise ValueError("the table has no version yet")
        return self._folders(held, list(held["folders"].values()))

    def _folders(self, held: dict, folders: list[str]) -> DataFrame:
        schema = StructType.fromJson(held["schema"])
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{f}" for f in folders])

    def _publish(self, version: int, pointer: dict) -> None:
        """The file of ``version``, written elsewhere and renamed, which fails if it is there already."""
        jvm, sc = self.spark._jvm, self.spark.sparkContext
        beside = self._hadoop.Path(f"{self.root}/versions/.{uuid.uuid4().hex}")
        out = self._fs.create(beside, False)
        out.write(bytearray(json.dumps(pointer).encode()))
        out.close()
        context = self._hadoop.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        named = self._hadoop.Path(f"{self.root}/versions/{version:09d}.json")
        try:
            context.rename(beside, named, sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as error:
            self._fs.delete(beside, False)
            if "FileAlreadyExists" in str(error):
                raise Moved(f"version {version} is there") from error
            raise

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _merge(self, rows: DataFrame, choose: Callable[[Column, Column], Column]) -> int:
        """``choose`` takes the old and the new row of a key, null where there is none, and returns the one to keep, or null."""
        if bad := rows.where(" or ".join(f"`{k}` is null" for k in self.keys)).limit(1).count():
            raise ValueError(f"{bad} rows have no key")
        rank = F.row_number().over(over(*self.keys).orderBy(F.col(self.newest).desc_nulls_last(), F.xxhash64(*rows.columns)))
        new = rows.withColumn("__rank", rank).where("__rank = 1").drop("__rank")
        new_rows = new.select(*self.keys, F.struct(*rows.columns).alias("__new"))
        names = [r[0] for r in rows.select(self._bucket()).distinct().collect()]  # BUCKETS numbers at most
        for _ in range(TRIES):
            version = self.version()
            held = self._pointer(version) or {**self._own, "buckets": self.buckets, "schema": rows.schema.jsonValue(), "folders": {}}
            if not names:
                return version
            columns = StructType.fromJson(held["schema"]).names
            if sorted(columns) != sorted(rows.columns):
                raise ValueError(f"the table has the columns {', '.join(columns)}")
            old = self._folders(held, [held["folders"][str(b)] for b in names if str(b) in held["folders"]])
            both = old.select(*self.keys, F.struct(*columns).alias("__old")).join(new_rows, self.keys, "full_outer")
            kept = both.select(choose(F.col("__old"), F.col("__new").cast(old.select(F.struct(*columns)).schema[0].dataType)).alias("r")).where("r is not null").select("r.*")
            folder = f"data/{uuid.uuid4().hex}"
            kept.withColumn("__bucket", self._bucket()).repartition("__bucket").write.partitionBy("__bucket").parquet(f"{self.root}/{folder}")
            try:
                self._publish(version + 1, {**held, "folders": {**held["folders"], **{str(b): f"{folder}/__bucket={b}" for b in names}}})
                return version + 1
            except Moved:
                self._fs.delete(self._hadoop.Path(f"{self.root}/{folder}"), True)
        raise Moved(f"{TRIES} merges met another writer")

    def upsert(self, rows: DataFrame) -> int:
        """Rows of new keys come in, those of known keys where they are newer; a repeated batch changes nothing."""
        newer = lambda old, new: old[self.newest].isNull() | (new[self.newest] > old[self.newest])
        return self._merge(rows, lambda old, new: F.when(old.isNull() | (new.isNotNull() & newer(old, new)), new).otherwise(old))

    def seed(self, rows: DataFrame) -> int:
        """Rows of new keys come in; known keys stay as they are."""
        return self._merge(rows, lambda old, new: F.coalesce(old, new))

    def update(self, rows: DataFrame, guard: Callable[[Column, Column], Column]) -> int:
        """Known keys take the new row where ``guard`` (old row, new row) holds; rows of unknown keys are left out."""
        return self._merge(rows, lambda old, new: F.when(old.isNotNull() & new.isNotNull() & guard(old, new), new).otherwise(old))


def striped(pending: DataFrame, order: list[str], workers: int) -> DataFrame:
    """Pending work by place in ``order``, a unique key, and by the worker whose turn it is.

    Ranges of the order are written, numbered apart and moved by the counts of the ranges before, a row for each range.
    """
    spark = pending.sparkSession
    ranged = pending.repartitionByRange(*order).withColumn("__range", F.spark_partition_id())
    path = folder(spark, "striped")
    ranged.write.parquet(path)
    ranged = spark.read.schema(ranged.schema).parquet(path)
    own = F.row_number().over(over("__range").orderBy(*order)) - 1
    counts = ranged.groupBy("__range").agg(F.count("*").alias("__n"))
    earlier = over().orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(F.col("__range").alias("__at"), F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    placed = ranged.withColumn("place", own).join(before, F.col("__range") == F.col("__at")).withColumn("place", F.col("place") + F.col("__before"))
    return placed.withColumn("worker", (F.col("place") % workers).cast("int")).drop("__range", "__at", "__before")
