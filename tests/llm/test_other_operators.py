"""Archives, embeddings, components and the pipeline on small tables."""

import collections
import hashlib
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom.llm import components, fingerprints, neighbours, warc
from driftloom.llm.scratch import Scratch

FAKE = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:999>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


@pytest.mark.parametrize("split", ["128m", "4k"])
def test_archives_round_trip(spark, split):
    rows = [(i, f"http://x/{i}", f"<p>{i % 7}</p>" * (300 if i % 2 else 20)) for i in range(40)]
    rows += [(100, None, FAKE), (101, "a\r\nb", "x" * 1500 + FAKE + "WARC/1.0\r\n"), (102, "u", "x" * 1500 + FAKE + "WARC/1.0\r\n"), (103, "u", None), (104, "u", "WARC/1.0\r\n" * 50), (None, "u", "é" * 700), (105, "u", "")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, value int")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = collections.Counter(tuple(r) for r in warc.round_trip(spark, pages).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    most = collections.defaultdict(lambda: -1)
    for i, _, h in rows:
        most[h or ""] = max(most[h or ""], -1 if i is None else i)
    expected = collections.Counter()
    for i, _, h in rows:
        data = (h or "").encode()
        again = i is not None and len(data) >= 1000 and i < most[h or ""]
        expected[(i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", most[h or ""] if again else None)] += 1
    assert got == expected


def test_neighbours_match_brute_force(spark):
    r = np.random.default_rng(2)
    centre = r.normal(size=16)
    v = [*r.normal(size=(60, 16)), *(centre + r.normal(scale=0.12, size=(60, 16))), *[centre] * 5]
    rows = [(i, [float(x) for x in v[i]], i % 3) for i in range(len(v))]
    rows += [(900, [0.0] * 16, 1), (901, None, 1), (902, [1.0] * 16, None), (903, [float("nan")] * 16, 1), (904, [None] + [1.0] * 15, 1), (905, [], 1), (None, [1.0] * 16, 1), (906, [1.0] * 8, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {x["vec_id"]: x for x in neighbours.groups(spark, df).collect()}
    n = len(v)
    m = np.array(v).astype(np.float32).astype(float)
    m /= np.linalg.norm(m, axis=1)[:, None]
    hit = (m @ m.T >= 0.98) & (np.arange(n)[:, None] % 3 == np.arange(n)[None] % 3)
    np.fill_diagonal(hit, False)
    comp = list(range(n))
    for _ in range(n):
        comp = [min([comp[i], *(comp[j] for j in np.flatnonzero(hit[i]))]) for i in range(n)]
    assert [got[i]["n_links"] for i in range(n)] == hit.sum(1).tolist()
    assert [got[i]["component_id"] for i in range(n)] == comp and got[None]["kept"]
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i for i in range(900, 907))
    assert neighbours.groups(spark, df.where("false")).count() == 0


def test_components_of_a_chain(spark):
    scratch = Scratch(spark, "test")
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.connected(scratch, links, "c").collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_index_finds_repeats_in_any_order(spark):
    scratch = Scratch(spark, "test")
    index = fingerprints.FingerprintIndex(spark, scratch, 2)
    batches = [[1, 2, 2, None], [3, 1], [4], [5, 3], [6, 6], [2, 7], [8], [4]]
    found, seen = [], collections.Counter()
    for b in batches:
        hits = {r["hash"] for r in index.add(spark.createDataFrame([(x,) for x in b], "hash long")).collect()}
        own = collections.Counter(x for x in b if x is not None)
        assert hits == {x for x, n in own.items() if n > 1 or x in seen}
        seen += own
        found.append(len(index.runs))
    assert max(found) <= 2 * fingerprints.FAN
    index.close()


def test_pipeline_on_a_small_folder(spark, tmp_path):
    sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
    import corpus_pipeline

    r = np.random.default_rng(4)
    words = [f"word{i}" for i in range(500)]
    text = lambda n: " ".join(r.choice(words, n))
    same = text(80)
    rows = [(i, text(60), "en", "s", 0) for i in range(40)] + [(40, same, "en", "s", 0), (41, same, "en", "s", 0), (42, None, "en", "s", 0), (43, "12 34", None, "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "toxicity", "minhash", "suffix", "packing"] and corpus_pipeline.ORACLE_SQL is None
    ids = {x["doc_id"] for x in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().collect()}
    assert ids == set(range(41))
    named = docs.withColumns({"__kept_id": F.lit(1), "kept_id": F.lit(2), "_kept_id": F.lit(3)})
    assert corpus_pipeline.distinct(spark, named.where(F.col("doc_id") >= 40), str(tmp_path)).columns == named.columns
    out = corpus_pipeline.distinct(spark, docs.where(F.col("doc_id") >= 40), str(tmp_path))
    assert out.columns == docs.columns and {x["doc_id"] for x in out.collect()} == {40, 42, 43}
