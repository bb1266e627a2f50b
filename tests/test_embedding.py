"""Hashed texts against a plain version, and vectors through bytes."""

from __future__ import annotations

import math
import struct

import pytest
import regex
from pyspark.sql import functions as F

from lodestream.functions import embedding, texts

MASK = 0xFFFFFFFF


def word_hash(word):
    h, data = embedding.HASH_SEED, word.encode()
    turned = lambda x, n: (x << n | x >> (32 - n)) & MASK
    for b in data:
        h = (turned(h ^ turned(b * embedding.HASH_A & MASK, 15) * embedding.HASH_B & MASK, 13) * 5 + embedding.HASH_ADD) & MASK
    h ^= len(data)
    h = (h ^ h >> 16) * embedding.MIX_A & MASK
    h = (h ^ h >> 13) * embedding.MIX_B & MASK
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def plain(text, n):
    out = [0.0] * n
    for w in regex.split(r"[^\p{L}\p{N}]+", (text or "").lower()):
        if len(w.encode("utf-16-le")) // 2 >= 2 and w not in embedding.STOP_WORDS:
            for p in range(embedding.PROJECTIONS):
                h = word_hash(f"{w}#{p}")
                out[h % n] += 1 if h & embedding.SIGN_BIT else -1
    size = math.sqrt(sum(x * x for x in out))
    return [x / size for x in out] if size else [1.0] + [0.0] * (n - 1)


def test_hashed_texts(spark):
    rows = ["A calm song about the SEA", "", None, "the and of", "naïve Größe 東京 9 x 42", "word " * 3000, "\U00020000 a", "a,b;c--dd"]
    df = spark.createDataFrame(list(enumerate(rows)), "id int, text string").repartition(3)
    got = {r.id: r.v for r in df.select("id", embedding.hashed_text(F.col("text"), 16).alias("v")).collect()}
    for i, text in enumerate(rows):
        assert got[i] == pytest.approx(plain(text, 16), abs=1e-6), text
    words = ["", "a", "abc", "é", "a" * 300]
    assert embedding.word_hashes([w.encode() for w in words]).tolist() == [word_hash(w) for w in words]


def test_vectors_in_bytes(spark):
    rows = [[1.0, -0.5, 65504.0, 1e-8, 0.1], [], None, [float("inf")], [3.14159]]
    df = spark.createDataFrame(list(enumerate(rows)), "id int, v array<float>").repartition(2)
    for bits, letter in ((16, "e"), (32, "f")):
        coded = df.select("id", embedding.encoded(F.col("v"), bits).alias("c")).select("*", embedding.decoded(F.col("c"), bits).alias("back")).collect()
        for r in coded:
            want = rows[r.id]
            assert r.c == (None if want is None else b"".join(struct.pack(f"<{letter}", x) for x in want))
            assert r.back == (None if want is None else [struct.unpack(f"<{letter}", struct.pack(f"<{letter}", x))[0] for x in want])
    cut = spark.createDataFrame([(bytearray(b"\0<\1"),)], "c binary").select(embedding.decoded(F.col("c")).alias("v")).first()
    assert cut.v == [1.0]
    kept = spark.createDataFrame([([1.0], "a"), ([1.0], "b"), ([1.0], None)], "v array<double>, at string").select(embedding.of_version(F.col("v"), F.col("at"), "b").alias("v")).collect()
    assert [r.v for r in kept] == [None, [1.0], None]


def test_string_hash_counts_utf16_units(spark):
    rows = ["", "a", "recsys", "ü", "\U0001f600", "x\U0001f600y"]

    def plain_hash(s):
        h = 0
        for (unit,) in struct.iter_unpack("<H", s.encode("utf-16-le")):
            h = (h * 31 + unit) & MASK
        return h - (1 << 32) if h >> 31 else h

    got = spark.createDataFrame([(r,) for r in rows], "t string").select(texts.java_hash(F.col("t")).alias("h")).collect()
    assert [r.h for r in got] == [plain_hash(r) for r in rows] and plain_hash("\U0001f600") == 1772899
