"""WARC archives: writing from a page table, and reading by boundary-chain verification (operator 9).

Reading splits files at every magic ``WARC/1.0``, also at those inside payloads. Each task emits, for
every candidate record, its offset and the offset where its successor must begin. Inside a split, chains
are followed to where they leave it; pointer jumping from the start of each file over these few ways
out finds where the chain enters each split, and from there it keeps just the candidates that it
reaches, so a magic inside a payload is no record. Offsets need no scan of their own: a task knows the bytes its split
held, and sums over the splits of a file place them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch, cleaned

# The format.
MAGIC = "WARC/1.0\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"

#: Payloads from this size are kept once; smaller ones are always written.
LEAST_REVISIT = 1000
DATE = "1970-01-01T00:00:00Z"
_URN = "urn:x-page:"
MAX_ROUNDS = 64


def write(pages: DataFrame, path: str, least: int = LEAST_REVISIT, date: str = DATE) -> None:
    """Write one record per row of ``pages`` (``page_id``, ``url``, ``html``) to archives under ``path``.

    A null html is an empty payload. Of rows with equal payloads of at least ``least`` bytes, those
    with the largest page_id are responses, the others revisits of it. A null page_id makes a response
    without number; line ends are taken out of urls, and a null url leaves the field out. Repeated
    rows make a record each; other columns are not read.
    """
    url = F.regexp_replace(F.col("url"), "[\r\n]+", "") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    rows = rows.withColumns({"n": F.octet_length("html"), "digest": F.sha1(F.col("html").cast("binary"))})
    keepers = rows.where(f"n >= {least}").groupBy("digest", "n").agg(F.max("page_id").alias("keeper"), F.count("*").alias("met")).where("met > 1").drop("met")
    scratch = Scratch(pages.sparkSession, "warc-write")
    # as tables of their own, so that the joins may split a payload with very many copies
    keepers = scratch.keep(keepers, "keepers")
    revisits = rows.select("page_id", "digest", "n").join(keepers, ["digest", "n"]).where("page_id < keeper").select("page_id", "digest", "keeper").distinct()
    revisits = scratch.keep(revisits, "revisits")
    rows = rows.join(revisits, ["page_id", "digest"], "left")
    again = F.col("keeper").isNotNull()
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    urn = lambda c: F.concat(F.lit(f"<{_URN}"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    record = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", F.col("url")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(again, F.concat(line("WARC-Refers-To", urn(F.col("keeper"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        line("X-Payload-Length", F.col("n").cast("string")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(again, "0").otherwise(F.col("n").cast("string"))),
        F.lit("\r\n"),
        F.when(again, "").otherwise(F.col("html")),
        F.lit("\r\n\r"),  # the text writer ends each row with the line feed that is still missing
    )
    with cleaned(pages.sparkSession):
        rows.select(record.alias("value")).write.option("lineSep", "\n").option("compression", "none").text(path)
    scratch.drop("keepers", "revisits")


def _fields(head: bytes) -> dict[str, str]:
    out = {}
    for row in head.decode("utf-8", "replace").split("\r\n"):
        name, colon, value = row.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


def _number(value: str | None) -> int | None:
    digits = (value or "").removeprefix(f"<{_URN}").removesuffix(">")
    return int(digits) if digits.removeprefix("-").isascii() and digits.removeprefix("-").isdigit() else None


_PARSED = "page_id long, type string, refers long, bytes long, digest string"
_CANDIDATE = f"file string, block long, at long, size long, total long, whole boolean, {_PARSED}"


def _parse(chunk: bytes) -> tuple:
    """(length of the record, is it whole, and its parsed fields) of what follows a magic; Nones if no header."""
    cut = chunk.find(END)
    fields = _fields(chunk[:cut]) if cut >= 0 else {}
    length = fields.get("content-length", "")
    if not (length.isascii() and length.isdigit()) or "warc-type" not in fields:
        return None, False, None, None, None, None, None
    begin = cut + len(END)
    stop = begin + int(length)
    whole = chunk[stop : stop + len(END)] == END
    kind, digest, n = fields["warc-type"], None, None
    if kind == "revisit":
        digest, n = fields.get("warc-payload-digest", "").removeprefix("sha1:"), int(fields.get("x-payload-length") or 0)
    elif whole:
        digest, n = hashlib.sha1(chunk[begin:stop]).hexdigest(), stop - begin
    return len(MAGIC) + stop + len(END), whole, _number(fields.get("warc-record-id")), kind, _number(fields.get("warc-refers-to")), n, digest


def _lines(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("chunk"))


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, bytes]]:
    """File, split, bytes of the split before it, and bytes of every line."""
    split, at = None, 0
    for batch in batches:
        for file, block, chunk in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if (file, block) != split:
                split, at = (file, block), 0
            yield file, block, at, chunk
            at += len(chunk) + len(MAGIC)


def _rows(found: Iterator[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in found:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in held], schema)
            held = []
    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in held], schema)


def _candidates(lines: DataFrame) -> DataFrame:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in _CANDIDATE.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for file, block, at, chunk in _places(batches):
                # what stands before a file's first magic follows none
                parsed = _parse(chunk) if block or at else (None, False, None, None, None, None, None)
                yield (file, block, at, len(chunk) + len(MAGIC), *parsed)

        yield from _rows(found(), schema)

    return lines.mapInArrow(run, _CANDIDATE)


def _ways_out(chain: DataFrame) -> DataFrame:
    """Of every candidate, the offset where the chain from it leaves its split: file, offset, out."""

    def run(split: pa.Table) -> pa.Table:
        split = split.sort_by("offset")
        offset = split["offset"].to_numpy()
        out = offset + split["total"].to_numpy()
        at = np.minimum(np.searchsorted(offset, out), len(offset) - 1)
        to = np.where(offset[at] == out, at, -1)
        while (to >= 0).any():
            inside = to >= 0
            out, to = np.where(inside, out[to], out), np.where(inside, to[to], -1)
        return pa.table({"file": split["file"], "offset": offset, "out": out})

    return chain.groupBy("file", "block").applyInArrow(run, "file string, offset long, out long")


def _followed(chain: DataFrame) -> DataFrame:
    """Candidates on the chain from the first ``entered`` one of each split: file, offset."""

    def run(split: pa.Table) -> pa.Table:
        split = split.sort_by("offset")
        offset = split["offset"].to_numpy()
        after = offset + split["total"].to_numpy()
        at = np.minimum(np.searchsorted(offset, after), len(offset) - 1)
        to = np.where(offset[at] == after, at, -1).tolist()
        i, reached = split["entered"].to_pylist().index(True), []
        while i >= 0:
            reached.append(i)
            i = to[i]
        return split.select(["file", "offset"]).take(pa.array(reached))

    some = chain.where("entered").select("file", "block").distinct()
    return chain.join(some, ["file", "block"], "left_semi").groupBy("file", "block").applyInArrow(run, "file string, offset long")


def _reached(scratch: Scratch, candidates: DataFrame) -> DataFrame:
    """(file, offset) of the candidates (file, block, offset, total) on the chain from each file's start."""
    chain = candidates.where("total is not null")
    ways = scratch.keep(_ways_out(chain), "ways")
    # only a file's start and where ways lead to can be entered: a few places of each split
    doors = ways.select("file", F.col("out").alias("offset")).unionByName(ways.select("file", F.lit(0).cast("long").alias("offset"))).distinct()
    jumps = scratch.keep(ways.join(doors, ["file", "offset"]).select("file", "offset", F.col("out").alias("next")), "jump-0")
    scratch.drop("ways")
    reached = scratch.keep(jumps.where("offset = 0").select("file", "offset"), "reach-0")
    n = reached.count()
    for i in range(1, MAX_ROUNDS + 1):
        ahead = reached.join(jumps, ["file", "offset"]).select("file", F.col("next").alias("offset"))
        reached = scratch.keep(reached.unionByName(ahead).distinct(), f"reach-{i}")
        now = reached.count()
        scratch.drop(f"reach-{i - 1}")
        if now == n:
            break
        n = now
        second = jumps.select("file", F.col("offset").alias("next"), F.col("next").alias("after"))
        jumps = scratch.keep(jumps.join(second, ["file", "next"]).select("file", "offset", F.col("after").alias("next")), f"jump-{i}")
        scratch.drop(f"jump-{i - 1}")
    else:
        raise RuntimeError(f"chains are not followed to their ends after {MAX_ROUNDS} rounds")
    entered = chain.join(reached.withColumn("entered", F.lit(True)), ["file", "offset"], "left").withColumn("entered", F.coalesce("entered", F.lit(False)))
    return scratch.keep(_followed(entered), "reached")


def _assembled(lines: DataFrame, places: DataFrame) -> DataFrame:
    """Fields of records whose payload holds a magic: their lines are put together again."""

    def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("at", pa.int64()), ("chunk", pa.binary())])
        yield from _rows(_places(batches), schema, 64)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("type", pa.string()), ("refers", pa.int64()), ("bytes", pa.int64()), ("digest", pa.string())])
        for batch in batches:
            rows = [_parse(MAGIC.encode().join(p["chunk"] for p in parts))[2:] for parts in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)

    chunks = lines.mapInArrow(located, "file string, block long, at long, chunk binary").join(places, ["file", "block", "at"])
    parts = chunks.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("offset", "chunk"))).alias("parts"))
    return parts.select("parts").mapInArrow(join, _PARSED)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of all archives under ``path``: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Bytes and digest are those of the full payload: counted and hashed from a response's content, for
    a revisit as its header has them. Bytes after the last record that the chain reaches are left out.
    """
    scratch = Scratch(spark, "warc")
    lines = _lines(spark, path)
    found = scratch.keep(_candidates(lines), "candidates")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = found.groupBy("file", "block").agg(F.sum("size").alias("held"))
    sizes = sizes.select("file", "block", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))
    placed = found.join(sizes, ["file", "block"]).withColumn("offset", F.col("base") + F.col("at") - len(MAGIC)).where("offset >= 0")
    placed = scratch.keep(placed, "placed")
    scratch.drop("candidates")
    reached = _reached(scratch, placed.select("file", "block", "offset", "total"))
    records = placed.join(reached, ["file", "offset"]).where("total is not null")
    out = records.where("whole").select("page_id", "type", "refers", "bytes", "digest")
    broken = records.where("not whole").select("file", F.col("offset").alias("record"))
    if not broken.isEmpty():
        files = placed.join(broken.select("file").distinct(), "file", "left_semi").join(reached.withColumn("record", F.col("offset")), ["file", "offset"], "left")
        up_to = Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
        owned = files.select("file", "block", "at", "offset", F.last("record", ignorenulls=True).over(up_to).alias("record"))
        out = out.unionByName(_assembled(lines, owned.join(broken, ["file", "record"], "left_semi")))
    return out.select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.col("refers").alias("refers_to"))


def round_trip(spark: SparkSession, pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``pages`` to archives and read them back."""
    where = path or Scratch(spark, "archive").path("warc")
    write(pages, where)
    return read(spark, where)
