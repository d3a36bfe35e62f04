"""Convolutions and language models against plain loops and dictionaries."""

import collections
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftloom.llm import langid, queries, toxicity
from driftloom.llm.textkernel import blocks

FOLDER = os.environ.get("TEST_BIG_SF_DIR", "/root/testdata/sf0.01")


def net_of(seed):
    r = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(30)]
    net = toxicity.fit_texts([(" ".join(r.choice(words, 12)), int(i % 2), "en") for i in range(40)])
    net.embedding = r.normal(size=net.embedding.shape).astype(np.float32)
    net.embedding[0] = 0
    net.last = r.normal(size=net.last.shape).astype(np.float32)
    return net, words


def scored(net, texts):
    out, tables = [], net.tables()
    for _, _, own in blocks(pa.array(texts, pa.string())):
        out += net.logits(*toxicity.word_rows(own, net.known), tables).tolist()
    return out


def looped(net, text):
    own = next(blocks(pa.array([text], pa.string())))[2]
    rows = toxicity.word_rows(own, net.known)[0].tolist()
    words = len(rows) - max(toxicity.WIDTHS)
    total = float(net.offset)
    for k, w in enumerate(toxicity.WIDTHS):
        for f in range(toxicity.FILTERS):
            best = max(sum(float(net.embedding[rows[i + j]] @ net.filters[w][j][:, f]) for j in range(w)) for i in range(max(words, 1)))
            total += max(best + float(net.bias[k, f]), 0.0) * float(net.last[k, f])
    return total


def test_convolutions_equal_loops_beside_any_text():
    net, words = net_of(1)
    r = np.random.default_rng(2)
    texts = [" ".join(r.choice(words, n)) for n in (1, 2, 3, 9, 40)] + ["", None, "  ", "unknown words only"]
    want = [looped(net, t) for t in texts]
    for order in (list(range(len(texts))), list(range(len(texts)))[::-1], [3, 5, 0, 6, 4, 8, 1, 7, 2]):
        assert np.allclose(scored(net, [texts[i] for i in order]), [want[i] for i in order], atol=1e-4)


def test_scores_do_not_depend_on_the_rows_beside_a_text(spark):
    net, words = net_of(3)
    r = np.random.default_rng(4)
    rows = [(i, " ".join(r.choice(words, int(r.integers(0, 5))))) for i in range(60)]
    df = spark.createDataFrame([*rows, *rows[:20], (None, None)], "doc_id long, text string")
    found = lambda n: sorted((-1 if r["doc_id"] is None else r["doc_id"], r["score"]) for r in toxicity.score(spark, df.repartition(n), net).collect())
    once, again = found(1), found(7)
    assert [i for i, _ in once] == [i for i, _ in again] and len(once) == 81
    assert np.allclose([x for _, x in once], [x for _, x in again], atol=1e-6)


def test_long_texts_are_learned_from_where_there_are_no_others(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 10)
    rows = [(i, f"{'bad awful' if i % 2 else 'good fine'} words again and again {i % 5}", "en") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    net = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(spark, docs, net).collect()}
    assert min(got[i] for i in range(1, 40, 2)) > max(got[i] for i in range(0, 40, 2))


def test_kneser_ney_equals_dictionaries_and_sums_to_one():
    r = np.random.default_rng(5)
    texts = ["".join(r.choice(list("abc "), 60)) for _ in range(6)] + ["über Äpfel", ""]
    code, begin = langid.normalised(texts)
    key, _ = langid.grams(code, begin)
    model = langid.KneserNey(key)
    split = lambda k: tuple(int(k >> np.uint64(16 * i)) & 0xFFFF for i in range(langid.ORDER))[::-1]
    levels, counts = {}, collections.Counter(map(split, key))
    for order in range(langid.ORDER, 0, -1):
        levels[order] = counts
        counts = collections.Counter(g[1:] for g in counts)

    def probability(gram):
        if not gram:
            return 1 / 65536
        own = levels[len(gram)]
        once, twice = (sum(c == n for c in own.values()) for n in (1, 2))
        discount = once / (once + 2 * twice) if once and twice else 0.5
        same = [c for g, c in own.items() if g[:-1] == gram[:-1]]
        lower = probability(gram[1:])
        return (max(own.get(gram, 0) - discount, 0) + discount * len(same) * lower) / sum(same) if same else lower

    asked = [*sorted({split(k) for k in key})[:80], (97, 98, 99, 100), (1, 2, 3, 4), (0, 0, 0, 97)]
    packed = np.array([sum(c << 16 * (langid.ORDER - 1 - i) for i, c in enumerate(g)) for g in asked], np.uint64)
    assert np.allclose(model.probability(packed), [probability(g) for g in asked], rtol=1e-9)
    for context in {k >> np.uint64(16) for k in key[:20]} | {np.uint64(0x5555)}:
        assert abs(model.probability((context << np.uint64(16)) | np.arange(65536, dtype=np.uint64)).sum() - 1) < 1e-9


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
def test_languages_and_toxicity_of_documents_that_were_held_out(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found = queries.op7_language(spark, FOLDER).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").where("lang is not null and lang_pred <> 'und'")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    both = queries.op2_toxicity(spark, FOLDER).where("held_out").join(labels, "doc_id")
    right = both.groupBy("toxic").agg(F.avg((F.col("toxic") == F.col("predicted")).cast("int")).alias("right"), F.count("*").alias("n")).collect()
    assert {r["toxic"]: r["right"] for r in right}[0] > 0.9
