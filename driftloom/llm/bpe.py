"""Byte-pair encoding and decoding with a public vocabulary (operator 6).

Short pre-tokens are merged over contiguous arrays: one holds the parts between the boundaries left,
a second one the rank of every adjacent pair. The smallest rank is found by scanning, its boundary
deleted and the two neighbouring ranks refreshed. Many words of like length stand in the rows of one
pair of arrays, so a round of numpy calls does one merge of each. Scanning is quadratic, so
pre-tokens above ``SCAN_LIMIT`` bytes keep the same ranks in a heap over linked parts; the order of
merging is the same. Texts are cut into pre-tokens in numpy as well, a block of texts at a time, and
each worker remembers the ids of the words it has met. Words are found by a hash and compared letter by
letter; should two of one hash differ, the memory starts anew with another one.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .textkernel import stretch_hashes

SCAN_LIMIT = 192
#: Words and their letters remembered by each Python worker (about 50 and 4 bytes each); when full, the memory starts anew.
MEMORY_WORDS = 1_500_000
MEMORY_LETTERS = 24_000_000
#: Words merged together, and characters of text cut together.
ROWS = 4096
BLOCK_CHARS = 1_000_000
NONE = np.iinfo(np.int64).max

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
# The characters with the Unicode property White_Space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[[ord(c) for c in WHITE_SPACE]] = SPACE
    return out


def word_starts(points: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """Where pre-tokens start among code points; ``opens`` marks the first one of each text.

    A pre-token is a run of letters, of numbers or of other signs with at most one blank before it, or
    a run of white space without the last character before a word. An apostrophe with s, t, m, d, re,
    ve or ll after it, not led by a blank or another sign, is one by itself.
    """
    kind = _classes()[points]
    start = opens.copy()
    start[1:] |= kind[1:] != kind[:-1]
    inside = ~opens[1:]
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & inside)
    start[last] = True
    start[last + 1] = points[last] != 32
    quote = np.flatnonzero((points[:-1] == 39) & start[:-1] & (kind[1:] == LETTER) & inside)
    if len(quote):
        end = np.zeros(len(quote), np.int64)
        one = points[quote + 1]
        end[np.isin(one, [ord(c) for c in "stmd"])] = 2
        two = np.minimum(quote + 2, len(points) - 1)
        joined = (quote + 2 < len(points)) & ~opens[two]
        for pair in ("re", "ve", "ll"):
            end[(one == ord(pair[0])) & (points[two] == ord(pair[1])) & joined] = 3
        quote, end = quote[end > 0], end[end > 0]
        start[quote + 1] = False
        after = quote + end
        start[after[after < len(points)]] = True
    return np.flatnonzero(start)


def _spread(offset: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices of all members of the runs that begin at ``offset``."""
    before = np.cumsum(length) - length
    return np.repeat(offset - before, length) + np.arange(int(length.sum()))


def _byte_alphabet() -> dict[str, int]:
    """Printable stand-in of every byte, as byte-level vocabularies write them."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class BytePairs:
    """A vocabulary with its merges; ``encode`` gives ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = _byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        vocab = {raw(k): v for k, v in spec["model"]["vocab"].items()}
        self.byte_ids = np.array([vocab[bytes([b])] for b in range(256)], dtype=np.int64)
        self.pairs: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = map(raw, merge if isinstance(merge, list) else merge.split(" "))
            self.pairs.setdefault(vocab[a] << 32 | vocab[b], (rank, vocab[a + b]))
        self.keys = np.array(sorted(self.pairs), dtype=np.int64)
        self.key_ranks = np.array([self.pairs[k][0] for k in self.keys.tolist()], dtype=np.int64)
        self.merged = np.zeros(max([r for r, _ in self.pairs.values()], default=0) + 1, dtype=np.int64)
        for rank, i in self.pairs.values():
            self.merged[rank] = i
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.specials.values()]) + 1
        self.token_bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = token
        for text, i in self.specials.items():
            self.token_bytes[i] = text.encode()
        self.token_length = np.array([len(t) for t in self.token_bytes], dtype=np.int64)
        self.token_offset = np.cumsum(self.token_length) - self.token_length
        self.token_flat = np.frombuffer(b"".join(self.token_bytes), np.uint8)
        self.seed = 0
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.where = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.flat = np.zeros(1 << 16, np.uint32)
        self.filled = 0
        self.letters = np.zeros(1 << 16, np.uint32)
        self.letters_filled = 0
        self.letter_at = np.zeros(0, np.int64)
        self.letter_count = np.zeros(0, np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of parts, NONE where there is no merge (or a part is missing, -1)."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (right >= 0), self.key_ranks[at], NONE)

    def merge_scanned(self, data: np.ndarray, offset: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of short words of like length, one row of the arrays each: how many, and all in turn."""
        n, width = len(size), int(size.max())
        cell = np.arange(width)
        held = data[np.minimum(offset[:, None] + cell, len(data) - 1)]
        parts = np.where(cell < size[:, None], self.byte_ids[held], -1)
        ranks = self._ranks(parts[:, :-1], parts[:, 1:])
        rows, done = np.arange(n), []
        while len(rows):
            here = np.arange(len(rows))
            if ranks.shape[1]:
                at = ranks.argmin(1)
                best = ranks[here, at]
            else:
                at, best = here * 0, np.full(len(rows), NONE)
            go = best != NONE
            if not go.all():
                whole = parts[~go]
                done.append((rows[~go], (whole >= 0).sum(1), whole[whole >= 0]))
                rows, parts, ranks, at, best = rows[go], parts[go], ranks[go], at[go], best[go]
                here = here[: len(rows)]
            if not len(rows):
                break
            parts[here, at] = self.merged[best]
            stay = np.ones(parts.shape, bool)
            stay[here, at + 1] = False
            parts = parts[stay].reshape(len(rows), -1)
            stay = np.ones(ranks.shape, bool)
            stay[here, at] = False
            ranks = ranks[stay].reshape(len(rows), -1)
            if r := ranks.shape[1]:
                own = np.flatnonzero(at < r)
                ranks[own, at[own]] = self._ranks(parts[own, at[own]], parts[own, at[own] + 1])
                own = np.flatnonzero(at > 0)
                ranks[own, at[own] - 1] = self._ranks(parts[own, at[own] - 1], parts[own, at[own]])
        rows, counts, ids = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(rows)
        return counts[order], ids[_spread((np.cumsum(counts) - counts)[order], counts[order])]

    def merge_heaped(self, word: bytes) -> bytes:
        """Ids of a long word: the same merges, leftmost smallest rank first, taken from a heap."""
        n = len(word)
        ids = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and (j := after[i]) < n and (found := self.pairs.get(ids[i] << 32 | ids[j])):
                heapq.heappush(heap, (found[0], i, ids[i], ids[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue  # a part has changed since
            ids[i], ids[j], after[i] = int(self.merged[rank]), -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            offer(before[i])
        return np.array([i for i in ids if i >= 0], dtype="<u4").tobytes()

    def _learn(self, keys: np.ndarray, points: np.ndarray, offset: np.ndarray, length: np.ndarray) -> None:
        """Add new words to the memory: their keys in order, and where they stand among code points."""
        chars = points[_spread(offset, length)]
        data = np.frombuffer(chars.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
        width = 1 + (chars > 0x7F).astype(np.int64) + (chars > 0x7FF) + (chars > 0xFFFF)
        size = np.add.reduceat(width, np.cumsum(length) - length)
        at = np.cumsum(size) - size
        count, ids = np.zeros(len(size), np.int64), []
        order = np.argsort(size, kind="stable")
        short = int(np.searchsorted(size[order], SCAN_LIMIT, "right"))
        for i in range(0, short, ROWS):
            rows = order[i : min(i + ROWS, short)]
            count[rows], got = self.merge_scanned(data, at[rows], size[rows])
            ids.append(got)
        for row in order[short:].tolist():
            got = np.frombuffer(self.merge_heaped(data[at[row] : at[row] + size[row]].tobytes()), "<u4")
            count[row] = len(got)
            ids.append(got)
        new = np.concatenate(ids)
        if self.filled + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.filled], np.zeros(2 * (self.filled + len(new)), np.uint32)])
        self.flat[self.filled : self.filled + len(new)] = new
        where = np.empty(len(size), np.int64)
        where[order] = self.filled + np.cumsum(count[order]) - count[order]
        self.filled += len(new)
        if self.letters_filled + len(chars) > len(self.letters):
            self.letters = np.concatenate([self.letters[: self.letters_filled], np.zeros(2 * (self.letters_filled + len(chars)), np.uint32)])
        self.letters[self.letters_filled : self.letters_filled + len(chars)] = chars
        letter_at = self.letters_filled + np.cumsum(length) - length
        self.letters_filled += len(chars)
        into = np.searchsorted(self.known, keys)
        self.known, self.where, self.count = np.insert(self.known, into, keys), np.insert(self.where, into, where), np.insert(self.count, into, count)
        self.letter_at, self.letter_count = np.insert(self.letter_at, into, letter_at), np.insert(self.letter_count, into, length)

    def _remembered(self, points: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray | None:
        """Where each word stands in the memory, new ones added; None if two words of one hash differ."""
        keys = stretch_hashes(points.view(np.uint8), 4 * start, 4 * length, self.seed)
        keys, first, which = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.known) + len(keys) > MEMORY_WORDS or self.letters_filled > MEMORY_LETTERS:
            self.forget()
        at = np.minimum(np.searchsorted(self.known, keys), max(len(self.known) - 1, 0))
        new = self.known[at] != keys if len(self.known) else np.ones(len(keys), bool)
        if new.any():
            self._learn(keys[new], points, start[first[new]], length[first[new]])
            at = np.searchsorted(self.known, keys)
        at = at[which]
        if (self.letter_count[at] != length).any() or (self.letters[_spread(self.letter_at[at], length)] != points).any():
            return None
        return at

    def _words(self, segments: list[str]) -> list[bytes]:
        """Ids of texts without special tokens."""
        size = np.fromiter(map(len, segments), np.int64, len(segments))
        points = np.frombuffer("".join(segments).encode("utf-32-le"), "<u4")
        if not len(points):
            return [b""] * len(segments)
        edge = np.cumsum(size) - size
        opens = np.zeros(len(points), bool)
        opens[edge[size > 0]] = True
        start = word_starts(points, opens)
        length = np.diff(start, append=len(points))
        while (at := self._remembered(points, start, length)) is None:
            self.seed += 1
            self.forget()
        count = self.count[at]
        ids = self.flat[_spread(self.where[at], count)].astype("<u4").tobytes()
        so_far = np.concatenate([[0], np.cumsum(count)])[np.searchsorted(start, np.append(edge, len(points)))] * 4
        return [ids[a:b] for a, b in zip(so_far[:-1].tolist(), so_far[1:].tolist())]

    def encode_all(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of every text in turn; the strings of added tokens become those tokens."""
        block: list[list[str | int]] = []
        held = 0
        for text in texts:
            block.append(self._split(text or ""))
            held += len(text or "")
            if held > BLOCK_CHARS:
                yield from self._joined(block)
                block, held = [], 0
        yield from self._joined(block)

    def _split(self, text: str) -> list[str | int]:
        """Stretches of plain text, and ids of special tokens between them."""
        parts: list[str | int] = [text]
        for name in sorted(self.specials, key=len, reverse=True):
            if name in text:
                cut: list[str | int] = []
                for part in parts:
                    pieces = part.split(name) if isinstance(part, str) else [part]
                    for i, piece in enumerate(pieces):
                        cut += [self.specials[name], piece] if i else [piece]
                parts = cut
        return parts

    def _joined(self, block: list[list[str | int]]) -> Iterator[bytes]:
        found = iter(self._words([p for doc in block for p in doc if isinstance(p, str)]))
        for doc in block:
            yield b"".join([next(found) if isinstance(p, str) else np.uint32(p).tobytes() for p in doc])

    def encode(self, text: str) -> bytes:
        """Ids of one text."""
        return next(self.encode_all([text]))

    def decode(self, ids: bytes) -> str:
        """Text of ids, special tokens kept, incomplete characters replaced."""
        i = np.frombuffer(ids, "<u4")
        return self.token_flat[_spread(self.token_offset[i], self.token_length[i])].tobytes().decode("utf-8", errors="replace")


@lru_cache(maxsize=4)
def vocabulary(path: str) -> BytePairs:
    """The vocabulary at ``path``, loaded once for each Python worker."""
    return BytePairs(path)


ENCODED = "doc_id long, n_tokens long, ids binary"


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens`` and the ids of every whole text (little-endian unsigned 32-bit).

    A null or empty text has no ids. Repeated rows are encoded each; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            ids = list(v.encode_all(batch.column(1).to_pylist()))
            counts = pa.array([len(i) // 4 for i in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), counts, pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return docs.selectExpr("cast(doc_id as long) doc_id", f"`{text}` text").mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and the text of each row's ids; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            texts = [v.decode(i or b"") for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Digests of the ids and of the text decoded from them, in one pass: no ids leave the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            n, a, b = [], [], []
            for ids in v.encode_all(batch.column(1).to_pylist()):
                n.append(len(ids) // 4)
                a.append(sha(ids))
                b.append(sha(v.decode(ids).encode()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.selectExpr("cast(doc_id as long) doc_id", f"`{text}` text").mapInArrow(run, schema)


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int, text: str = "text") -> DataFrame:
    """Pieces of at most ``capacity`` ids of each document, its ids followed by ``end_id``.

    Only documents longer than ``capacity`` are cut; their first piece takes the remainder, so that
    all others are full. Columns: doc_id, piece, start, length, ids_crc32; ``part`` and ``nth`` number
    the pieces of a length within the task that made them. A null text counts as an empty one.
    """
    last = np.uint32(end_id).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        part = TaskContext.get().partitionId()
        met = [0] * (capacity + 1)
        for batch in batches:
            rows: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), v.encode_all(batch.column(1).to_pylist())):
                ids += last
                n = len(ids) // 4
                first = n % capacity or min(n, capacity)
                cuts = [0, *range(first, n + 1, capacity)]
                for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    rows.append((doc, i, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), part, met[b - a]))
                    met[b - a] += 1
            cols = list(zip(*rows)) or [[]] * 7
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
    return docs.selectExpr("cast(doc_id as long) doc_id", f"`{text}` text").mapInArrow(run, schema)
