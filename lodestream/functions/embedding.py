"""Vectors in bytes, and vectors of texts by hashed words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words without a meaning of their own, and the constants of the words' hash.
STOP_WORDS = (
    "the", "by", "and", "of", "an", "to", "in", "on", "for", "with", "about", "that", "it", "is", "at", "from", "this", "its", "plus", "some", "can", "we", "my", "just",
    "genres", "mood", "themes", "topics", "tone", "author", "channel", "poster",
)
HASH_SEED, HASH_A, HASH_B, HASH_ADD, MIX_A, MIX_B, SIGN_BIT = 0x9747B28C, 0xCC9E2D51, 0x1B873593, 0xE6546B64, 0x85EBCA6B, 0xC2B2AE35, 0x40000000
PROJECTIONS = 4


def encoded(vector: Column, bits: int = 16) -> Column:
    """A vector's numbers as little-endian halves (or floats, of 32 bits), one after the other; null for null."""
    kind = {16: "<f2", 32: "<f4"}[bits]

    @F.arrow_udf("binary")
    def code(vectors: pa.Array) -> pa.Array:
        values = vectors.flatten().to_numpy(zero_copy_only=False).astype(kind).tobytes()
        width, ends = bits // 8, np.cumsum(np.r_[0, vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)])
        return pa.array([values[a * width : b * width] if v.is_valid else None for v, a, b in zip(vectors, ends, ends[1:])], pa.binary())

    return code(vector.cast("array<float>"))


def decoded(blob: Column, bits: int = 16) -> Column:
    """The vector of `encoded`; a rest that is no whole number is left out."""
    kind = {16: "<f2", 32: "<f4"}[bits]

    @F.arrow_udf("array<float>")
    def read(blobs: pa.Array) -> pa.Array:
        rows = [b if b is None else b[: len(b) - len(b) % (bits // 8)] for b in blobs.to_pylist()]
        ends = np.cumsum([0, *(len(b or b"") // (bits // 8) for b in rows)])
        values = np.frombuffer(b"".join(b or b"" for b in rows), kind).astype(np.float32)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values), mask=pa.array([b is None for b in rows]))

    return read(blob)


def of_version(vector: Column, version: Column, current: str) -> Column:
    """The vector, if it comes from the current version of the index; else null."""
    return F.when(version == current, vector)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A signed 32-bit hash of each word: all words take a byte at a time."""
    lengths = np.array([len(w) for w in words], np.uint32)
    width = int(lengths.max()) if len(words) else 0
    letters = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)
    turned = lambda x, n: (x << np.uint32(n)) | (x >> np.uint32(32 - n))
    h = np.full(len(words), HASH_SEED, np.uint32)
    with np.errstate(over="ignore"):
        for i in range(width):
            k = turned(letters[:, i].astype(np.uint32) * np.uint32(HASH_A), 15) * np.uint32(HASH_B)
            h = np.where(lengths > i, turned(h ^ k, 13) * np.uint32(5) + np.uint32(HASH_ADD), h)
        h ^= lengths
        h = (h ^ (h >> np.uint32(16))) * np.uint32(MIX_A)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(MIX_B)
        return (h ^ (h >> np.uint32(16))).view(np.int32)


def telling_words(text: Column) -> Column:
    """The words of a text that count: runs of letters and digits in lower case, of two UTF-16 units or more, no stop words."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(words, lambda w: ((F.char_length(w) >= 2) | (F.octet_length(w) == 4)) & ~w.isin(*STOP_WORDS))


def hashed_text(text: Column, dimension: int) -> Column:
    """A text's vector of unit length: each word adds or takes one at PROJECTIONS places that its hashes give.

    A text without words that count, or whose words cancel out, has the first unit vector.
    """

    @F.arrow_udf("array<float>")
    def embed(lists: pa.Array) -> pa.Array:
        codes = lists.flatten().dictionary_encode()
        known = [f"{w}#{p}".encode() for w in codes.dictionary.to_pylist() for p in range(PROJECTIONS)]
        out = np.zeros((len(lists), dimension))
        if known:
            h = word_hashes(known).reshape(-1, PROJECTIONS)
            place, sign = np.mod(h, dimension), np.where(h & SIGN_BIT, 1.0, -1.0)
            rows = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
            at = codes.indices.to_numpy(zero_copy_only=False)
            for p in range(PROJECTIONS):
                np.add.at(out, (rows, place[at, p]), sign[at, p])
        n = np.sqrt((out * out).sum(axis=1, keepdims=True))
        out = np.divide(out, n, out=np.zeros_like(out), where=n >= 1e-9)
        out[n[:, 0] < 1e-9, 0] = 1.0
        return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * dimension, pa.int32()), pa.array(out.ravel().astype(np.float32)))

    return embed(telling_words(text))
