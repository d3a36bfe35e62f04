"""Text operators against brute force on small tables with nulls, empty and long texts, ties and odd columns."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from driftloom.llm import bpe, langid, minhash, packing, quality, substring, suffix, toxicity

PATH = public_tokenizers.path("byte_bpe_50k.json")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed, n, names=("alpha", "beta", "gamma", "delta", "eps")):
    r = np.random.default_rng(seed)
    return " ".join(f"{names[i % len(names)]}{r.integers(60)}" for i in r.integers(1000, size=n))


@pytest.fixture(scope="module")
def docs(spark):
    base = prose(1, 120)
    rows = [(i, prose(i, 50 + i), "en") for i in range(2, 12)]
    rows += [(20, base, "en"), (21, base, None), (22, base + " tail", "en"), (23, base.upper(), "en"), (24, prose(30, 60) + " " + base[:500] + " " + prose(31, 40), "de")]
    rows += [(30, None, None), (31, "", "en"), (32, "  \t\n", "en"), (33, "one two", "en"), (34, "one two", "en"), (35, "é漢 🎉 'll don't<|endoftext|> x", "en")]
    rows += [(40, "a b " * 3000, "en"), (41, "x" * 5000, "en"), (None, "no id here at all", "en"), (20, base, "en")]
    return spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, hash string")


def rows_of(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


def test_minhash_matches_brute_force(spark, docs):
    got = minhash.groups(spark, docs, 85, 100).collect()
    sets, parent = collections.defaultdict(list), {}
    for i, text in rows_of(docs):
        w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
        s = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        if i is not None:
            sets[i].append(s)
            parent[i] = i

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and any(s and t and 100 * len(s & t) >= 85 * len(s | t) for s in sets[a] for t in sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    assert len(got) == docs.count()
    for r in got:
        if r["doc_id"] is not None:
            assert r["n_shingles"] in {len(s) for s in sets[r["doc_id"]]}
            assert r["component_id"] == root(r["doc_id"]) and r["kept"] == (r["doc_id"] == r["component_id"])


@pytest.mark.parametrize(("block", "shingles"), [(3, 1 << 18), (256, 60)])
def test_minhash_blocks_of_large_buckets(spark, monkeypatch, block, shingles):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "SHINGLES", shingles)
    base = prose(5, 300).split()
    rows = []
    for i in range(24):
        w = list(base)
        for k in range(i % 12):
            w[(i * 13 + k * 25) % 300] = f"new{i}x{k}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.groups(spark, df, 85, 100).collect()}
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(296)} for i, t in rows}
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
    assert got == {i: root(i) for i in sets}


def test_posterior_bounds():
    need = minhash.least_matches(0.85, 64, 1e-5)
    assert list(need) == [16, 32, 48, 64] and all(0 < m < n for n, m in need.items())
    assert (1 - 0.85**minhash.ROWS) ** minhash.bands_for(0.85) <= minhash.MISS


def test_substring_matches_brute_force(spark, docs):
    got = collections.Counter(tuple(r) for r in substring.digest_rows(substring.remove_repeats(spark, docs, batches=3)).collect())
    words = [WORDS.findall(t) for _, t in rows_of(docs)]
    seen = collections.Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    expected = collections.Counter()
    for (i, _), w in zip(rows_of(docs), words):
        gone = {k + j for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for j in range(35)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        expected[(i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    assert got == expected


@pytest.mark.parametrize("hot", [4000, 1])
def test_suffix_matches_brute_force(spark, docs, hot):
    got = collections.Counter(tuple(r) for r in suffix.digest_rows(suffix.remove_repeats(spark, docs, keep="none", hot=hot)).collect())
    texts = [t.encode() for _, t in rows_of(docs)]
    seen = collections.Counter(t[i : i + 400] for t in texts for i in range(len(t) - 399))
    expected = collections.Counter()
    for (i, _), t in zip(rows_of(docs), texts):
        edge = np.zeros(len(t) + 1, int)
        for k in range(len(t) - 399):
            if seen[t[k : k + 400]] > 1:
                edge[k] += 1
                edge[k + 400] -= 1
        out = np.cumsum(edge)[:-1] > 0
        runs = int((out & ~np.r_[False, out[:-1]]).sum()) if len(out) else 0
        expected[(i, len(t), int(out.sum()), runs, hashlib.sha256(np.frombuffer(t, np.uint8)[~out].tobytes()).hexdigest())] += 1
    assert got == expected


def test_suffix_keeps_the_first_copy(spark):
    passage = prose(9, 120)
    df = spark.createDataFrame([(2, "late " + passage, 9), (1, passage + " first", 9), (3, "none", 4)], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: r for r in suffix.trimmed(spark, df).collect()}
    assert got[1]["text"] == passage + " first" and len(got[2]["text"]) < 10 and got[2]["n_chars"] == len(got[2]["text"]) and got[3]["text"] == "none"


def test_suffix_order_is_sorted():
    data = np.frombuffer(b"abracadabra abracadabra banana banana" * 3, np.uint8)
    starts = np.arange(len(data) - 20)
    order, same = suffix.suffix_order(data, starts, 20)
    keys = [data[i : i + 20].tobytes() for i in order]
    assert keys == sorted(keys) and [bool(x) for x in same[1:]] == [a == b for a, b in zip(keys, keys[1:])]
    assert all(a < b for a, b, s in zip(order, order[1:], same[1:]) if s)


def test_bpe_matches_the_library(spark, docs):
    t = Tokenizer.from_file(PATH)
    got = {r["doc_id"]: r for r in bpe.round_trip(docs, PATH).collect()}
    for i, text in rows_of(docs):
        ids = t.encode(text, add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_on_odd_strings():
    t, v, r = Tokenizer.from_file(PATH), bpe.vocabulary(PATH), np.random.default_rng(3)
    letters = list("ab'srtvemld  \n\t\xa0é1٣²!?.,漢🎉\x1c\x85")
    texts = ["".join(r.choice(letters, r.integers(40))) for _ in range(2000)] + ["ab" * 400, "'", " 's", "\n's 'll"]
    assert [np.frombuffer(x, "<u4").tolist() for x in v.encode_all(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_packing_is_whole_and_tight(spark, docs):
    got = [r.asDict() for r in packing.pack(spark, docs, PATH, capacity=64).collect()]
    t = Tokenizer.from_file(PATH)
    wanted = collections.Counter()
    for i, text in rows_of(docs):
        ids = t.encode(text, add_special_tokens=False).ids + [0]
        first = len(ids) % 64 or min(len(ids), 64)
        cuts = [0, *range(first, len(ids) + 1, 64)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            wanted[(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == wanted
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= -(-sum(r["length"] for r in got) // 64) + 2


def test_fullest_is_best():
    left = [0, 3, 0, 2, 0, 1, 0, 0, 1]
    used = packing.fullest(13, left, [8, 5, 3, 1])
    assert sum(s * n for s, n in used.items()) == 13 and all(n <= left[s] for s, n in used.items())
    assert packing.fullest(4, [0, 0, 1, 0, 0], [2]) == {2: 1}


def test_language_and_toxicity_learn(spark):
    a, b = ("the", "and", "of", "this"), ("der", "und", "nicht", "ich")
    rows = [(i, prose(i, 80, a if i % 2 else b) + (" vileword nastyword" if i % 5 == 0 else ""), "en" if i % 2 else "de") for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = langid.fit(df.where("doc_id < 80"))
    odd = spark.createDataFrame([(500, None, None), (501, "12 34", None)], df.schema)
    got = {r["doc_id"]: r for r in langid.predict(spark, df.union(odd), models).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows) and got[500]["lang_pred"] == got[501]["lang_pred"] == "und"
    assert langid.accepted(spark, df.union(odd), models).count() == 120
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(80)], "doc_id long, toxic int")
    net = toxicity.fit(df, labels)
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(spark, df.union(odd), net).collect()}
    assert all((scores[i] >= 0.3) == (i % 5 == 0) for i in range(80, 120)) and 0 <= scores[500] <= 1
    empty = df.where("false")
    assert langid.fit(empty) is None and toxicity.fit(empty, labels.where("false")) is None
    assert toxicity.score(spark, df, None).where("score = 0").count() == 120


def test_quality_counts(spark, docs):
    got = [r.asDict() for r in quality.judge(spark, docs).collect()]
    expected = collections.Counter()
    for i, x in rows_of(docs):
        w = WORDS.findall(x)
        lines = [s for s in x.split("\n") if WORDS.search(s)]
        c = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {k + j for k in range(len(w) - 7) if c[tuple(w[k : k + 8])] > 1 for j in range(8)}
        failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        expected[(i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), len(lines) - len(set(lines)), len(covered), failed)] += 1
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert collections.Counter(tuple(r[c] for c in names) for r in got) == expected
    assert not any(r["kept"] and r["base_failed"] for r in got)


def test_empty_tables(spark, docs):
    none = docs.where("false")
    assert minhash.groups(spark, none).count() == 0 and packing.pack(spark, none, PATH).count() == 0
    assert substring.remove_repeats(spark, none).count() == 0 and suffix.remove_repeats(spark, none).count() == 0
    assert quality.judge(spark, none).count() == 0 and bpe.round_trip(none, PATH).count() == 0
