"""Language ID by interpolated Kneser-Ney character models (operator 7).

One model of four characters per language, each order kept as sorted key arrays. A key packs the
characters' 16-bit codes, so it is exact for the basic plane. For scoring, the sequences that any
language has seen stand in one sorted array with their log probability in every language; others go
down the orders. The language with the lowest cross-entropy per character wins. A text whose
cross-entropy lies beyond what held-back learning documents of that language show, given its length,
is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UNKNOWN = "und"
ORDER = 4
#: Learning documents per language, at most about. Longer ones than this many characters are learned from
#: only, about LONG_DOCS of them, where a language has no others.
SAMPLE_DOCS = 400
SAMPLE_CHARS = 40_000
LONG_DOCS = 4
#: The most languages, since the table of probabilities grows with their number; more are an error.
MAX_LANGUAGES = 256
BLOCK_CHARS = 1_000_000
#: Length from which more characters don't make the score surer.
SURE_CHARS = 100
REJECT_FACTOR = 2.0
_CODE = np.uint64(16)


@lru_cache(maxsize=1)
def _folded() -> np.ndarray:
    """16-bit code of every code point: of its lower-case letter, 0 if it is no letter."""
    def one(c: int) -> int:
        if not (s := chr(c)).isalpha():
            return 0
        low = ord(s.lower()[0])
        return (low ^ low >> 16 if low > 0xFFFF else low) & 0xFFFF or 1

    return np.fromiter((one(c) for c in range(0x110000)), np.uint16, 0x110000)


def normalised(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all texts, three zeros before each, runs of other signs as one zero; where each begins."""
    size = np.array([len(t or "") + ORDER - 1 for t in texts], dtype=np.int64)
    points = np.frombuffer("".join("\n" * (ORDER - 1) + (t or "") for t in texts).encode("utf-32-le"), "<u4")
    code = _folded()[points]
    begin = np.cumsum(size) - size
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 0) | (code[:-1] != 0)
    for i in range(ORDER - 1):
        keep[begin + i] = True
    return code[keep], np.concatenate([[0], np.cumsum(keep)])[begin]


def grams(code: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sequences that end at each character of a text, and where each text's begin."""
    wide = code.astype(np.uint64)
    key = wide.copy()
    for i in range(1, ORDER):
        key[i:] |= wide[:-i] << np.uint64(16 * i)
    own = np.ones(len(code), bool)
    for i in range(ORDER - 1):
        own[begin + i] = False
    return key[own], begin - (ORDER - 1) * np.arange(len(begin))


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class KneserNey:
    """Interpolated Kneser-Ney over packed sequences: raw counts at the top, continuation counts below."""

    def __init__(self, seen: np.ndarray):
        self.levels = []
        keys, counts = np.unique(seen, return_counts=True)
        for order in range(ORDER, 0, -1):
            once, twice = int((counts == 1).sum()), int((counts == 2).sum())
            discount = once / (once + 2 * twice) if once and twice else 0.5
            context = keys >> _CODE
            own, first, kinds = np.unique(context, return_index=True, return_counts=True)
            self.levels.append((keys, counts.astype(np.float64), discount, own, np.add.reduceat(counts, first).astype(np.float64), kinds.astype(np.float64)))
            keys, counts = np.unique(keys & np.uint64((1 << 16 * (order - 1)) - 1), return_counts=True)

    def probability(self, wanted: np.ndarray) -> np.ndarray:
        p = np.full(len(wanted), 1.0 / (1 << 16))
        for order in range(1, ORDER + 1):
            keys, counts, discount, contexts, totals, kinds = self.levels[ORDER - order]
            key = wanted & np.uint64((1 << 16 * order) - 1)
            at, hit = _found(keys, key)
            up = np.where(hit, np.maximum(counts[at] - discount, 0), 0)
            at, known = _found(contexts, key >> _CODE)
            p = np.where(known, (up + discount * kinds[at] * p) / totals[at], p)
        return p


@dataclass
class LanguageModels:
    languages: list[str]
    models: list[KneserNey]
    keys: np.ndarray
    logs: np.ndarray
    centre: np.ndarray
    spread: np.ndarray

    def cross_entropy(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Nats per character of each text under each language, and how many characters were scored."""
        key, begin = grams(*normalised(texts))
        n = np.diff(begin, append=len(key))
        at, hit = _found(self.keys, key)
        logs = self.logs[at]
        if not hit.all():
            other, which = np.unique(key[~hit], return_inverse=True)
            logs[~hit] = np.stack([np.log(m.probability(other)) for m in self.models], 1).astype(np.float32)[which]
        sums = np.zeros((len(n), len(self.languages)))
        if (n > 0).any():
            sums[n > 0] = np.add.reduceat(logs, begin[n > 0], axis=0, dtype=np.float64)
        return -sums / np.maximum(n, 1)[:, None], n


def fit_texts(learned: dict[str, list[str]]) -> LanguageModels | None:
    """Models from texts by language. Every fifth text only calibrates the rejection."""
    learned = {k: v for k, v in sorted(learned.items()) if any(c.isalpha() for t in v for c in t)}
    if not learned:
        return None
    models, held = [], []
    for texts in learned.values():
        held.append(texts[::5])
        fit = [t for i, t in enumerate(texts) if i % 5] or texts
        models.append(KneserNey(grams(*normalised(fit))[0]))
    keys = np.unique(np.concatenate([m.levels[0][0] for m in models]))
    logs = np.stack([np.log(m.probability(keys)) for m in models], 1).astype(np.float32)
    found = LanguageModels(list(learned), models, keys, logs, np.zeros(len(models)), np.zeros(len(models)))
    for i, texts in enumerate(held):
        entropy, n = found.cross_entropy(texts)
        entropy, n = entropy[n > 20, i], n[n > 20]
        found.centre[i] = np.median(entropy) if len(n) else np.log(1 << 16)
        found.spread[i] = REJECT_FACTOR * np.max(np.abs(entropy - found.centre[i]) * np.sqrt(n), initial=10.0)
    return found


def fit(docs: DataFrame, sample: int = SAMPLE_DOCS) -> LanguageModels | None:
    """Learn from ``text`` by ``lang`` (nulls left out): about ``sample`` documents of each language, taken by a hash of doc_id."""
    rows = docs.where("text is not null and lang is not null").withColumn("long", F.length("text") > SAMPLE_CHARS)
    counts = rows.groupBy("lang").agg(F.count_if(~F.col("long")).alias("short"), F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if not counts:
        return None
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"there are more than {MAX_LANGUAGES} languages")
    share = {r["lang"]: min(1.0, sample / r["short"]) if r["short"] else min(1.0, LONG_DOCS / r["n"]) for r in counts}
    no_other = [r["lang"] for r in counts if not r["short"]]
    wanted = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    rows = rows.where((~F.col("long")) | F.col("lang").isin(no_other))
    learned: dict[str, list[str]] = {}
    taken = rows.where(place < F.try_element_at(wanted, F.col("lang"))).select("doc_id", "lang", "text")
    for r in sorted(taken.collect(), key=lambda r: (r["doc_id"] or 0, r["text"])):
        learned.setdefault(r["lang"], []).append(r["text"])
    return fit_texts(learned)


PREDICTED = "doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean"


def _judged(m: LanguageModels | None, texts: list[str | None]) -> Iterator[tuple]:
    """(language, score, cross-entropy, rejected) of each text."""
    at = 0
    while at < len(texts):
        block, held = [], 0
        while at + len(block) < len(texts) and (not block or held < BLOCK_CHARS):
            block.append(texts[at + len(block)])
            held += len(block[-1] or "")
        at += len(block)
        if m is None:
            yield from [(UNKNOWN, 0.0, None, True)] * len(block)
            continue
        code, begin = normalised(block)
        letters = np.add.reduceat(code != 0, begin)
        entropy, n = m.cross_entropy(block)
        best = entropy.argmin(1)
        least = entropy.min(1)
        share = 1 / np.exp((least[:, None] - entropy) * np.minimum(n, SURE_CHARS)[:, None]).sum(1)
        far = least - m.centre[best] > m.spread[best] / np.sqrt(np.maximum(n, 1))
        for i in range(len(block)):
            yield (m.languages[best[i]], float(share[i]), float(least[i]), bool(far[i])) if letters[i] else (UNKNOWN, 0.0, None, True)


def predict(spark: SparkSession, docs: DataFrame, models: LanguageModels | None) -> DataFrame:
    """The language of every whole text.

    ``und`` with score 0 where the text is null or has no letter, or nothing was learned; such rows
    count as rejected. Otherwise the best learned language, its share of the likelihood (characters
    beyond SURE_CHARS add no certainty), the cross-entropy in nats, and whether calibration rejects it.
    Equal languages go to the first by name. Repeated rows are scored each; other columns are not read.
    """
    shared = spark.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(zip(*_judged(shared.value, batch.column(1).to_pylist()))) or [[]] * 4
            kinds = [pa.string(), pa.float64(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(cols, kinds))], ["doc_id", "lang_pred", "score", "cross_entropy", "rejected"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, PREDICTED)


def accepted(spark: SparkSession, docs: DataFrame, models: LanguageModels | None) -> DataFrame:
    """Whole rows of ``docs`` whose language is recognised (``predict`` doesn't reject them)."""
    shared = spark.sparkContext.broadcast(models)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([not x[3] for x in _judged(shared.value, batch.column(at).to_pylist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
