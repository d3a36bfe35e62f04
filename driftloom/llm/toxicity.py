"""Toxicity by a convolutional text classifier trained in numpy (operator 2).

Words are hashed to rows of an embedding table: the hash of a word met in enough learning documents has
a row of its own, found in a sorted array, all other words share hashed rows. Filters of several widths slide over them, the largest
response of each filter in the whole text is kept, and a logistic layer makes the score. The first
dimension of the embeddings starts as the shrunk log odds of a word's presence in either class, so that
rare telling words stand out from the start; gradients do the rest. Response i of
a filter is a sum of one table row per word, so scoring is a few gathers per word. The score is
calibrated on documents held back from the fit, and thresholds are chosen for each language there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkernel import Texts, Words, blocks

#: Rows that words without a row of their own share, and learning documents a word needs for its own.
SHARED = 1 << 12
OWN_ROW = 3
DIMENSION = 12
FILTERS = 12
WIDTHS = (1, 2, 3)
EPOCHS = 4
BATCH = 32
RATE = 0.05
#: Learning documents of each class, at most about; texts longer than this are learned from only where a
#: class has no others, LONG_DOCS of them.
SAMPLE_DOCS = 3000
SAMPLE_CHARS = 30_000
LONG_DOCS = 32
SCORE_THRESHOLD = 0.3
#: Positive calibration documents that a language needs for a threshold of its own, and its range.
OWN_THRESHOLD = 15
THRESHOLD_RANGE = (0.25, 0.6)

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[b for b in range(128) if not chr(b).isalnum()]] = 32
_PLAIN[65:91] += 32


def word_rows(texts: Texts, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of the words of each text in turn, and each text's first; row 0, the pad, ends every text."""
    words = Words(Texts(_PLAIN[texts.data], texts.offsets))
    hashes = words.hashes()
    rows = (hashes % np.uint64(SHARED)).astype(np.int32) + 1
    if len(known):
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        rows = np.where(known[at] == hashes, at.astype(np.int32) + (SHARED + 1), rows)
    per = words.per_text()
    pad = max(WIDTHS)
    first = words.first[:-1] + pad * np.arange(len(per))
    out = np.zeros(len(rows) + pad * len(per), np.int32)
    out[np.arange(len(rows)) + pad * np.repeat(np.arange(len(per)), per)] = rows
    return out, first


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Convolutions:
    """Parameters: embeddings, one matrix per width and place, biases, and the last layer."""

    known: np.ndarray
    seed: int = 7
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        r = np.random.default_rng(self.seed)
        self.embedding = r.normal(0, 0.02, (SHARED + 1 + len(self.known), DIMENSION)).astype(np.float32)
        self.embedding[0] = 0
        self.filters = {w: r.normal(0, 0.2, (w, DIMENSION, FILTERS)).astype(np.float32) for w in WIDTHS}
        for w, own in self.filters.items():
            own[:, 0] = r.uniform(0.5, 1, (w, FILTERS)) / w
        self.bias = np.zeros((len(WIDTHS), FILTERS), np.float32)
        self.last = r.uniform(0, 0.15, (len(WIDTHS), FILTERS)).astype(np.float32)
        self.offset = np.float32(0)

    def tables(self) -> dict[int, np.ndarray]:
        return {w: np.stack([self.embedding @ f for f in own]) for w, own in self.filters.items()}

    def responses(self, rows: np.ndarray, tables: dict[int, np.ndarray], width: int) -> np.ndarray:
        n = len(rows) - max(WIDTHS) + 1
        out = tables[width][0][rows[:n]]
        for j in range(1, width):
            out += tables[width][j][rows[j : j + n]]
        return out

    def logits(self, rows: np.ndarray, first: np.ndarray, tables: dict[int, np.ndarray]) -> np.ndarray:
        """Of each text, from the places at which its words begin (one, if it has none); the pad keeps the next text's words out."""
        total = np.full(len(first), self.offset, np.float64)
        last = np.maximum(np.append(first[1:], len(rows)) - max(WIDTHS), first + 1)
        edges = np.stack([first, last], 1).ravel()
        edges = edges[edges <= len(rows) - max(WIDTHS)]
        for k, w in enumerate(WIDTHS):
            most = np.maximum.reduceat(self.responses(rows, tables, w), edges, axis=0)[::2]
            total += np.maximum(most + self.bias[k], 0) @ self.last[k]
        return total

    def scores(self, logits: np.ndarray) -> np.ndarray:
        return _sigmoid(self.scale * logits + self.shift)

    def train(self, docs: list[np.ndarray], labels: np.ndarray, weights: np.ndarray) -> None:
        """Adagrad over shuffled batches; only each filter's best place in a text has a gradient."""
        r = np.random.default_rng(self.seed)
        pad = max(WIDTHS)
        has = np.zeros((2, len(self.embedding)))
        for d, y in zip(docs, labels):
            has[int(y), np.unique(d)] += 1
        size = [max(int((labels == y).sum()), 1) for y in (0, 1)]
        odds = np.log((has[1] + 0.5) / (size[1] + 1)) - np.log((has[0] + 0.5) / (size[0] + 1))
        self.embedding[:, 0] = odds * has.sum(0) / (has.sum(0) + 3)
        self.embedding[: SHARED + 1, 0] = 0
        seen = {"e": np.full_like(self.embedding, 0.05), "b": np.full_like(self.bias, 0.05), "l": np.full_like(self.last, 0.05), "o": 0.05} | {w: np.full_like(f, 0.05) for w, f in self.filters.items()}
        for epoch in range(EPOCHS):
            rate = RATE / (1 + epoch)
            order = r.permutation(len(docs))
            for at in range(0, len(order), BATCH):
                batch = order[at : at + BATCH]
                rows = np.concatenate([np.append(docs[i], np.zeros(pad, np.int32)) for i in batch])
                size = np.array([len(docs[i]) + pad for i in batch])
                first = np.cumsum(size) - size
                pooled = np.zeros((len(WIDTHS), len(batch), FILTERS), np.float32)
                places = np.zeros((len(WIDTHS), len(batch), FILTERS), np.int64)
                for k, w in enumerate(WIDTHS):
                    words = np.unique(rows)
                    near = np.searchsorted(words, rows)
                    emb = self.embedding[words]
                    n = len(rows) - pad + 1
                    held = (emb @ self.filters[w][0])[near[:n]]
                    for j in range(1, w):
                        held += (emb @ self.filters[w][j])[near[j : j + n]]
                    for b, (a, m) in enumerate(zip(first, size)):
                        own = held[a : a + max(m - pad, 1)]
                        best = own.argmax(0)
                        places[k, b] = a + best
                        pooled[k, b] = own[best, np.arange(FILTERS)]
                act = np.maximum(pooled + self.bias[:, None], 0)
                logit = np.einsum("kbf,kf->b", act, self.last) + self.offset
                error = ((_sigmoid(logit) - labels[batch]) * weights[batch] / len(batch)).astype(np.float32)
                grad_last = np.einsum("b,kbf->kf", error, act)
                back = error[None, :, None] * self.last[:, None] * (act > 0)
                touched, pushed = [], []
                for k, w in enumerate(WIDTHS):
                    for j in range(w):
                        own = rows[places[k] + j]
                        grad = np.einsum("bf,bfd->df", back[k], self.embedding[own])
                        touched.append(own.ravel())
                        pushed.append((back[k][:, :, None] * self.filters[w][j].T[None]).reshape(-1, DIMENSION))
                        seen[w][j] += grad**2
                        self.filters[w][j] -= rate * grad / np.sqrt(seen[w][j])
                bias = back.sum(1)
                seen["b"] += bias**2
                self.bias -= rate * bias / np.sqrt(seen["b"])
                seen["l"] += grad_last**2
                self.last -= rate * grad_last / np.sqrt(seen["l"])
                seen["o"] += float(error.sum()) ** 2
                self.offset = np.float32(self.offset - rate * error.sum() / np.sqrt(seen["o"]))
                own, which = np.unique(np.concatenate(touched), return_inverse=True)
                grad = np.zeros((len(own), DIMENSION), np.float32)
                np.add.at(grad, which, np.concatenate(pushed))
                grad[own == 0] = 0
                seen["e"][own] += grad**2
                self.embedding[own] -= rate * grad / np.sqrt(seen["e"][own])

    def calibrate(self, logits: np.ndarray, labels: np.ndarray, weights: np.ndarray, languages: list[str | None]) -> None:
        """Scale and shift by weighted logistic regression; a threshold for each language by its best F1."""
        a, b = 1.0, 0.0
        aim = np.where(labels == 1, (labels.sum() + 1) / (labels.sum() + 2), 1 / (len(labels) - labels.sum() + 2))
        for _ in range(50):
            p = _sigmoid(a * logits + b)
            g = weights * (p - aim)
            h = weights * p * (1 - p)
            x = np.stack([logits, np.ones_like(logits)])
            step = np.linalg.solve((x * h) @ x.T + 1e-3 * np.eye(2), x @ g + 1e-3 * np.array([a - 1, b]))
            a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -2, 2)
        self.scale, self.shift = (float(a), float(b)) if a > 0 else (1.0, 0.0)
        scores = self.scores(logits)
        where = np.array([x or "" for x in languages])
        for name in sorted({*where} - {""}):
            own = where == name
            if labels[own].sum() >= OWN_THRESHOLD:
                grid = np.linspace(*THRESHOLD_RANGE, 36)
                hit = scores[own][:, None] >= grid
                good = (weights[own][:, None] * hit * labels[own][:, None]).sum(0)
                f1 = 2 * good / ((weights[own][:, None] * hit).sum(0) + (weights[own] * labels[own]).sum())
                self.thresholds[str(name)] = float(np.median(grid[f1 >= f1.max() - 1e-9]))


def fit_texts(rows: list[tuple[str | None, int, str | None]], weight: dict[int, float] | None = None) -> Convolutions | None:
    """Learn from (text, label, language). Every fourth text only calibrates."""
    rows = [r for r in rows if r[1] in (0, 1)]
    if not rows:
        return None
    labels = np.array([r[1] for r in rows], dtype=np.float64)
    weights = np.array([(weight or {}).get(r[1], 1.0) for r in rows])
    column = pa.array([r[0] for r in rows], pa.string())
    met = [np.zeros(0, np.uint64)]
    for _, _, texts in blocks(column):
        words = Words(Texts(_PLAIN[texts.data], texts.offsets))
        hashes = words.hashes()
        met += [np.unique(hashes[a:b]) for a, b in zip(words.first, words.first[1:])]
    known, times = np.unique(np.concatenate(met), return_counts=True)
    net = Convolutions(known[times >= OWN_ROW])
    docs: list[np.ndarray] = []
    for _, _, texts in blocks(column):
        ids, first = word_rows(texts, net.known)
        docs += [x[: len(x) - max(WIDTHS)] for x in np.split(ids, first[1:])]
    back = np.arange(len(docs)) % 4 == 3
    fitted = [d for d, b in zip(docs, back) if not b]
    balanced = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9))
    net.train(fitted, labels[~back], balanced[~back])
    if back.any():
        tables, pad = net.tables(), np.zeros(max(WIDTHS), np.int32)
        logits = np.concatenate([net.logits(np.append(d, pad), np.zeros(1, np.int64), tables) for d, b in zip(docs, back) if b])
        net.calibrate(logits, labels[back], weights[back], [r[2] for r, b in zip(rows, back) if b])
    return net


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS) -> Convolutions | None:
    """Learn from ``docs.text`` by ``labels.toxic`` (rows whose label is null or neither 0 nor 1 are left out).

    About ``sample`` documents of each class are taken by a hash of doc_id, texts above SAMPLE_CHARS
    left out unless a class has no others. A document whose labels disagree counts as toxic. ``lang`` only serves the thresholds.
    """
    marked = labels.where("toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("label"))
    counts = {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, sample / n))])
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    taken = marked.where(place < F.try_element_at(share, F.col("label")))
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    texts = docs.where(f"length(text) <= {SAMPLE_CHARS}").select(F.col("doc_id").cast("long").alias("doc_id"), "text", lang.alias("lang"))
    # ids of the sample, about two times ``sample`` rows whatever the input: the texts stay where they are
    rows = texts.join(F.broadcast(taken), "doc_id").select(F.xxhash64("doc_id", F.lit(3)).alias("order"), "text", "label", "lang")
    held = rows.collect()
    if lacking := [k for k in counts if not any(r["label"] == k for r in held)]:
        wanted = ["order", "text", "label", "lang"]
        long = docs.where(f"length(text) > {SAMPLE_CHARS}").select(F.col("doc_id").cast("long").alias("doc_id"), "text", lang.alias("lang"))
        for k in lacking:
            own = long.join(marked.where(F.col("label") == k), "doc_id").withColumn("order", F.xxhash64("doc_id", F.lit(3)))
            held += own.select(*wanted).orderBy("order", "text").limit(LONG_DOCS).collect()
    got = [tuple(r)[1:] for r in sorted(held, key=lambda r: (r["order"], r["text"]))]
    kept = {k: sum(r[1] == k for r in got) for k in counts}
    return fit_texts(got, {k: n / max(kept[k], 1) for k, n in counts.items()})


def _shared(spark: SparkSession, net: Convolutions | None):
    """The net's tables for all tasks; their size depends on the learning sample alone."""
    if not net:
        return spark.sparkContext.broadcast(None)
    light = Convolutions.__new__(Convolutions)
    light.__dict__ |= net.__dict__ | {"embedding": None, "filters": None}
    return spark.sparkContext.broadcast((light, net.tables()))


def _scores(held: tuple | None, column: pa.Array) -> np.ndarray:
    out = np.zeros(len(column))
    if held:
        net, tables = held
        for a, b, texts in blocks(column):
            out[a:b] = net.scores(net.logits(*word_rows(texts, net.known), tables))
    return out


SCORED = "doc_id long, score double"


def score(spark: SparkSession, docs: DataFrame, net: Convolutions | None) -> DataFrame:
    """``doc_id`` and the score of every whole text, 0 to 1; null and empty texts get that of no words.

    Without a learned net all scores are 0. Repeated rows are scored each; other columns aren't read.
    """
    shared = _shared(spark, net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(shared.value, batch.column(1)))], ["doc_id", "score"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCORED)


def accepted(spark: SparkSession, docs: DataFrame, net: Convolutions | None) -> DataFrame:
    """Whole rows of ``docs`` whose score is below the threshold of their ``lang`` (SCORE_THRESHOLD if it has none)."""
    shared = _shared(spark, net)
    at = docs.columns.index("text")
    lang = docs.columns.index("lang") if "lang" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = _scores(shared.value, batch.column(at))
            own = shared.value[0].thresholds if shared.value else {}
            names = batch.column(lang).to_pylist() if lang is not None else [None] * len(scores)
            limit = np.array([own.get(x, SCORE_THRESHOLD) for x in names])
            yield batch.filter(pa.array(scores < limit))

    return docs.mapInArrow(run, docs.schema)
