"""Sequence columns: translation, identity, owners, distances and residue counts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# The genetic code with bases in the order TCAG, and the residue alphabets.
BASES = "TCAG"
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
RESIDUES = "ACDEFGHIKLMNPQRSTVWY"
RESIDUES_WIDE = "ACDEFGHIKLMNPQRSTVWYXBZUOJ"

#: The place of each letter in BASES, 4 for others; and the amino acid of three places as digits to base 5.
_BASE_OF = np.full(128, 4, np.uint8)
for _letters in (BASES, BASES.lower(), "U", "u"):
    _BASE_OF[list(_letters.encode())] = range(len(_letters))
_CODONS = np.full(125, ord("X"), np.uint8)
for _i, _acid in enumerate(AMINO_ACIDS):
    _CODONS[_i // 16 * 25 + _i // 4 % 4 * 5 + _i % 4] = ord(_acid)


def upper(sequence: Column) -> Column:
    """Letters a to z in upper case; others as they are, so that lengths stay."""
    return F.translate(sequence, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _proteins(texts: pa.Array, frame: int, strip: str) -> pa.Array:
    """The proteins of an array of texts, all letters of all texts at once; a text without a codon has the empty one."""
    texts = texts.cast(pa.string()).fill_null("")
    sizes = pc.utf8_length(texts).to_numpy().astype(np.int64)
    joined = "".join(texts.to_pylist())
    letters = np.frombuffer(joined.encode() if joined.isascii() else joined.encode("utf-32-le"), np.uint8 if joined.isascii() else "<u4")
    base = _BASE_OF[np.minimum(letters, 127)]
    at_each = _CODONS[base[:-2] * 25 + base[1:-1] * 5 + base[2:]] if len(base) > 2 else np.zeros(0, np.uint8)
    counts = np.maximum((sizes - frame) // 3, 0)
    first, ends = np.cumsum(sizes) - sizes + frame, np.cumsum(counts)
    found = at_each[np.repeat(first - 3 * (ends - counts), counts) + 3 * np.arange(counts.sum())]
    keep, left = np.ones(len(found), bool), counts.copy()
    at = np.flatnonzero(left) if strip != "none" else np.zeros(0, np.int64)
    while len(at):
        last = (ends - counts + left - 1)[at]
        stops = found[last] == ord("*")
        keep[last[stops]] = False
        left[at[stops]] -= 1
        at = at[stops & (left[at] > 0)] if strip == "all" else at[:0]
    offsets = np.append(0, np.cumsum(left)).astype(np.int32)
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets), pa.py_buffer(found[keep]))


def translate(sequence: Column, frame: int = 0, strip: str = "one") -> Column:
    """Amino acids of a nucleotide sequence; unknown codons are X. ``strip`` takes one, all or no stops off the end. A null is without codons."""
    if strip not in ("one", "all", "none"):
        raise KeyError(strip)

    @F.arrow_udf("string")
    def protein(texts: pa.Array) -> pa.Array:
        return _proteins(texts, frame, strip)

    return protein(sequence)


def hash_owner(key: Column, workers: int) -> Column:
    """The 256-bit hash of a key modulo ``workers``, worked out 16 bits at a time."""
    digits = F.sha2(key.cast("binary"), 256)
    parts = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.conv(F.substring(digits, i * 4 + 1, F.lit(4)), 16, 10).cast("long"))
    return F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: (a * 65536 + x) % workers)


def derived_key(sequence: Column, prefix: str, digits: int = 20) -> Column:
    """A key from the hash of a sequence."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(sequence.cast("binary"), 256), 1, digits))


def hamming(one: Column, two: Column) -> Column:
    """Places where two sequences of one length differ; null for different lengths."""
    differ = F.zip_with(F.split(one, ""), F.split(two, ""), lambda a, b: F.when(a != b, 1).otherwise(0))
    return F.when(F.length(one) == F.length(two), F.aggregate(differ, F.lit(0), lambda s, x: s + x))


def valid_residues(sequence: Column) -> Column:
    """Letters of the plain alphabet."""
    return F.length(F.regexp_replace(upper(sequence), f"[^{RESIDUES}]", ""))


def is_protein(sequence: Column) -> Column:
    """Only letters of the wide alphabet, at least one."""
    return sequence.rlike(f"^[{RESIDUES_WIDE}]+$")


def fixed_slice(sequence: Column, start: int = 17, length: int = 327) -> Column:
    """The stretch from ``start`` (from 0)."""
    return F.substring(sequence, start + 1, length)


def frame_candidates(sequence: Column, least: int = 1) -> Column:
    """Different proteins of the three frames, without those shorter than ``least`` or with an inner stop, in order."""
    proteins = F.array(*[translate(sequence, f) for f in range(3)])
    return F.array_sort(F.array_distinct(F.filter(proteins, lambda p: (F.length(p) >= least) & ~p.contains("*"))))


def ambiguous_letters(sequence: Column) -> Column:
    """Letters that are no residue of the plain alphabet."""
    return F.filter(F.split(upper(sequence), ""), lambda x: ~x.rlike(f"^[{RESIDUES}]?$"))
