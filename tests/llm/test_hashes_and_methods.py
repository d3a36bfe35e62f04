"""Texts made to defeat polynomial hashes, and what the dealt methods promise beyond their results."""

import collections
import hashlib
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from driftloom.llm import bpe, fingerprints, langid, minhash, neighbours, packing, quality, substring, suffix, textkernel, toxicity, warc
from driftloom.llm.scratch import Scratch

PATH = public_tokenizers.path("byte_bpe_50k.json")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def morse(n, letters="ab"):
    """The Thue-Morse word of n letters, and its complement."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join(letters[b] for b in bits), "".join(letters[1 - b] for b in bits)


@pytest.mark.parametrize("n", [1024, 2048])
def test_regular_words_do_not_meet(spark, n):
    one, two = morse(n)
    r = np.random.default_rng(n)
    rest = [f"w{i}" for i in r.integers(1000, size=34)]
    rows = [(1, " ".join([*rest[:17], one, *rest[17:]])), (2, " ".join([*rest[:17], two, *rest[17:]])), (3, one), (4, two)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    groups = {r["doc_id"]: r["component_id"] for r in minhash.groups(spark, df, 85, 100).collect()}
    assert groups == {i: i for i, _ in rows}
    assert all(r["n_removed"] == 0 for r in substring.remove_repeats(spark, df).collect())
    t, v = Tokenizer.from_file(PATH), bpe.BytePairs(PATH)
    found = list(v.encode_all([one, two]))
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == [t.encode(x, add_special_tokens=False).ids for x in (one, two)]
    assert [v.decode(x) for x in found] == [one, two]
    texts = [t.encode() for _, t in rows]
    seen = collections.Counter(t[i : i + 400] for t in texts for i in range(len(t) - 399))
    got = {r["doc_id"]: r["n_removed"] for r in suffix.remove_repeats(spark, df, keep="none").collect()}
    for (i, _), t in zip(rows, texts):
        gone = np.zeros(len(t) + 1, int)
        for k in range(len(t) - 399):
            if seen[t[k : k + 400]] > 1:
                gone[k] += 1
                gone[k + 400] -= 1
        assert got[i] == int((np.cumsum(gone)[:-1] > 0).sum())


def test_memory_of_words_survives_equal_hashes(monkeypatch):
    t, v = Tokenizer.from_file(PATH), bpe.BytePairs(PATH)
    real = textkernel.stretch_hashes
    # the first hash tells words apart by their length alone
    monkeypatch.setattr(bpe, "stretch_hashes", lambda data, start, length, seed: real(data, start, length, seed) if seed else length.astype(np.uint64))
    texts = ["the cat sat on the mat", "dog ran", "cat the"]
    assert [np.frombuffer(x, "<u4").tolist() for x in v.encode_all(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert v.seed == 1


def test_hashes_are_those_of_their_stretch():
    r = np.random.default_rng(0)
    for size in (1, 2, 5, 12, 35):
        h = r.integers(0, 3, 400).astype(np.uint64)
        pairs = {(h[i : i + size].tobytes(), int(w)) for i, w in enumerate(textkernel.windows(h, size))}
        assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
    for size in (8, 24, 400):
        d = r.integers(0, 2, 1500).astype(np.uint8)
        d[700:1400] = d[:700]
        pairs = {(d[i : i + size].tobytes(), int(w)) for i, w in enumerate(textkernel.byte_windows(d, size))}
        assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


@pytest.mark.parametrize("window", [8, 9, 16, 50])
def test_longest_previous_factors(window):
    r = np.random.default_rng(window)
    for trial in range(12):
        data = r.integers(0, 2 + trial % 3, 150).astype(np.uint8)
        if trial % 2:
            data = np.tile(data[:40], 4)
        starts, b = np.arange(len(data) - window + 1), data.tobytes()
        factors, later = suffix.previous_factors(data, starts, window)
        for p in starts:
            shared = lambda q, p=p: next((k for k in range(window) if b[p + k] != b[q + k]), window)
            assert factors[p] == max(map(shared, range(p)), default=0)
            assert later[p] == any(shared(q) == window for q in range(p + 1, len(starts)))


def test_only_windows_with_a_shared_core_are_put_in_order(monkeypatch):
    window, gram, r = 40, 8, np.random.default_rng(3)
    common, regions = r.integers(0, 256, 200).astype(np.uint8), {}
    for i in range(80):
        # bytes of its own around a stretch of common ones
        text, (a, b) = r.integers(0, 256, 200).astype(np.uint8), 100 + r.integers(4, 50, 2) * (-1, 1)
        text[a:b] = common[a:b]
        start, at, values = suffix._selected(textkernel.Texts(text, np.array([0, 200])), window, gram)
        for p in np.unique(at).tolist():
            lo, hi = start[at == p][[0, -1]].tolist()
            content, hash_ = text[lo : hi + window].tobytes(), int(values[p].view(np.int64))
            regions.setdefault((hash_, content), {"hash": hash_, "r1": len(regions), "r2": 0, "fk": i, "ft": 0, "fs": lo, "anchor": p - lo, "content": content})
    cut = lambda c: [c[i : i + window] for i in range(len(c) - window + 1)]
    seen = collections.Counter(w for x in regions.values() for w in cut(x["content"]))
    ordered, real = [], suffix.previous_factors
    monkeypatch.setattr(suffix, "previous_factors", lambda data, starts, window: ordered.append(len(starts)) or real(data, starts, window))
    for keep in ("none", "first"):
        got, first = suffix._matches(pa.Table.from_pylist(list(regions.values())), window, gram, keep).to_pylist(), set()
        by_number = {x["r1"]: x for x in regions.values()}
        for x in got:
            windows = cut(by_number[x["r1"]]["content"])
            hit = [i for a, b in zip(x["runs"][::2], x["runs"][1::2]) for i in range(a, b)]
            assert hit == [i for i, w in enumerate(windows) if seen[w] > 1 and (keep == "none" or w in first)]
            first.update(windows)
    hits = sum(n for n in seen.values() if n > 1)
    assert 0 < hits <= ordered[0] == ordered[1] < (hits + sum(seen.values())) / 2
    alone = pa.Table.from_pylist([x for x in regions.values() if x["fk"] == 0])
    assert suffix._matches(alone, window, gram, "none")["runs"].to_pylist() == [[]] * len(alone)
    assert len(ordered) == 2


def test_a_later_batch_is_held_against_the_index(spark):
    r = np.random.default_rng(8)
    text = lambda n: " ".join(f"w{i}" for i in r.integers(5000, size=n))
    passage = text(60)
    batches = [[(1, text(50) + " " + passage), (2, text(80))], [(3, passage + " " + text(20)), (4, text(90))], [(5, text(40)), (6, None)], [(7, text(10) + " " + passage)], [(2, "")]]
    batches[3].append((8, batches[0][1][1]))
    schema = "doc_id long, text string"
    with fingerprints.FingerprintIndex(spark, Scratch(spark, "test"), 2) as index:
        history: list[tuple] = []
        for rows in batches:
            before = spark.createDataFrame(history, schema) if history else None
            got = {x["doc_id"]: x["n_removed"] for x in substring.remove_known(spark, index, spark.createDataFrame(rows, schema), before).collect()}
            history += rows
            words = [WORDS.findall(t or "") for _, t in history]
            seen = collections.Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
            for i, t in rows:
                w = WORDS.findall(t or "")
                assert got[i] == len({k + j for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for j in range(35)})
        assert len(index.runs) < len(batches) and got == {2: 0}
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(index.name)]


def test_one_bucket_of_many_near_texts(spark):
    """Rows of a step grow with the members of a group, and no link is lost."""
    r = np.random.default_rng(11)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(90):
        w = list(base)
        for k in r.choice(200, 1 + i % 3, replace=False):
            w[k] = f"x{i}y{k}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(196)} for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    assert {x["doc_id"]: x["component_id"] for x in minhash.groups(spark, df, 85, 100).collect()} == {i: root(i) for i in sets}


def test_quality_rejects_what_is_no_language(spark):
    r = np.random.default_rng(3)
    common, rare = ["the", "of", "and", "to", "in", "is"], [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    prose = lambda n: " ".join(r.choice(common) if r.random() < 0.4 else r.choice(rare) for _ in range(n))
    rows = [(i, prose(150), "en") for i in range(120)]
    rows += [(500, " ".join(r.choice(rare, 150)), "en"), (501, "#$% 12 " * 80 + prose(60), "en"), (502, prose(150), "en"), (503, None, None), (504, "", "en")]
    rows += [(600 + i, prose(150), "fr") for i in range(20)]
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, lang string, bits int")
    got = {x["doc_id"]: x for x in quality.judge(spark, df).collect()}
    assert not got[500]["kept"] and not got[500]["base_failed"] and not got[501]["kept"]
    assert sum(got[i]["kept"] for i in range(120)) == 120 and got[502]["kept"] and not got[503]["kept"] and not got[504]["kept"]
    assert all(got[600 + i]["kept"] for i in range(20))


def test_archive_chains_over_many_splits(spark):
    rows = [(i, f"http://x/{i}", "z" * int(n)) for i, n in enumerate(np.random.default_rng(1).integers(0, 900, 300))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        got = {x["page_id"]: x["payload_digest"] for x in warc.round_trip(spark, pages).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {i: hashlib.sha1(h.encode()).hexdigest() for i, _, h in rows}


def test_empty_tables_and_clashing_names(spark):
    docs = spark.createDataFrame([(i, f"some plain words number {i} of a text", "en", 1.0, "x", "y") for i in range(12)], "doc_id long, text string, lang string, score double, label string, node string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, toxic int")
    none = docs.where("false")
    models, net = langid.fit(docs), toxicity.fit(docs, labels)
    assert langid.predict(spark, none, models).count() == 0 and toxicity.score(spark, none, net).count() == 0
    assert langid.predict(spark, docs, models).count() == 12 and toxicity.score(spark, docs, net).count() == 12
    assert langid.accepted(spark, docs, models).columns == docs.columns
    assert warc.round_trip(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    vectors = spark.createDataFrame([(i, [1.0, float(i % 2)], 1, 5, "z") for i in range(4)] + [(9, [1e300, 1e300], 1, 5, "z"), (10, [1e-300, 1e-300], 1, 5, "z")], "vec_id long, embedding array<double>, label int, node int, links string")
    got = {x["vec_id"]: (x["n_links"], x["audited_recall"]) for x in neighbours.groups(spark, vectors).collect()}
    assert got == {0: (1, 1.0), 2: (1, 1.0), 1: (3, 1.0), 3: (3, 1.0), 9: (3, 1.0), 10: (3, 1.0)}


def test_very_long_texts(spark):
    r = np.random.default_rng(6)
    long = " ".join(f"w{i}" for i in r.integers(1 << 30, size=60_000))
    half = long[: len(long) // 2]
    df = spark.createDataFrame([(1, long), (2, "start " + half), (3, "a short one"), (4, "x" * 300_000)], "doc_id long, text string")
    assert {x["doc_id"]: x["component_id"] for x in minhash.groups(spark, df).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}
    n = len(half.split()) - 1
    got = {x["doc_id"]: x["n_removed"] for x in substring.remove_repeats(spark, df).collect()}
    assert n <= got[1] <= n + 1 and got[2] == got[1] and got[3] == got[4] == 0
    got = {x["doc_id"]: x["n_removed"] for x in suffix.remove_repeats(spark, df, keep="none").collect()}
    assert got[2] in (len(half), len(half) + 1) and got[3] == 0 and got[4] == 300_000
    pages = spark.createDataFrame([(1, "u", long), (2, "u", long), (3, "u", "x" * 300_000)], "page_id long, url string, html string")
    assert {x["page_id"]: (x["record_type"], x["payload_bytes"]) for x in warc.round_trip(spark, pages).collect()} == {1: ("revisit", len(long)), 2: ("response", len(long)), 3: ("response", 300_000)}
    models = langid.fit(df.withColumn("lang", F.lit("en")))
    assert models is not None and langid.predict(spark, df, models).where("lang_pred = 'en'").count() == 4


def test_bins_on_skewed_lengths():
    r = np.random.default_rng(5)
    sizes = np.concatenate([r.integers(1, 40, 3000), r.integers(1500, 2049, 300), np.full(500, 700), r.integers(200, 900, 700)])
    histogram = dict(zip(*(x.tolist() for x in np.unique(sizes, return_counts=True))))
    bins = packing.plan(histogram, 2048)
    dealt = collections.Counter()
    for times, used in bins:
        assert sum(s * n for s, n in used.items()) <= 2048
        for s, n in used.items():
            dealt[s] += n * times
    assert dict(dealt) == histogram
    room: list[int] = []  # first fit, longest first
    for size in sorted(sizes.tolist(), reverse=True):
        i = next((i for i, free in enumerate(room) if free >= size), None)
        if i is None:
            room.append(2048 - size)
        else:
            room[i] -= size
    assert sum(t for t, _ in bins) <= len(room)
