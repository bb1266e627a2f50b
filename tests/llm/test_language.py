"""Held-out accuracy, odd rows, and the n-grams against a plain version."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from odd import documents, nothing, stored

from lodestream.llm import language

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def found(spark):
    docs = stored(spark, SF)
    rows = {r.doc_id: r for r in docs.collect()}
    return rows, language.languages(docs).collect(), docs


def test_accuracy_on_held_out_rows(found):
    rows, out, _ = found
    assert len(out) == len(rows) and {r.lang_pred for r in out} <= {r.lang for r in rows.values()} | {"und"}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    held = [(rows[r.doc_id].lang, r.lang_pred) for r in out if r.held_out and rows[r.doc_id].lang]
    assert len(held) > 200 and sum(a == b for a, b in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in out)


def test_labels_of_held_out_rows_are_not_looked_at(spark, found):
    from pyspark.sql import functions as F

    rows, out, docs = found
    other = docs.withColumn("lang", F.when(language.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("s")).repartition(5)
    again = {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in language.languages(other).collect()}
    assert again == {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in out}


def test_grams_against_plain(monkeypatch):
    text = "Hi, naïve\tworlds -- 42 ß end" * 3

    def plain(text):
        words, out = "".join(c if c.isalpha() else " " for c in text.lower()).split(), Counter()
        line = " " + " ".join(words) + " "
        for n in range(1, language.LONGEST + 1):
            for i in range(len(line) - n + 1):
                gram = line[i : i + n]
                if gram.strip() and " " not in gram[1:-1]:
                    out[gram] += 1
        return out

    # all n-grams are counted, and texts cut into pieces give what whole ones give
    codes = np.concatenate([[0], [ord(c) if c.isalpha() else 0 for c in text.lower()], [0]])
    codes = codes[np.append(True, (codes[1:] != 0) | (codes[:-1] != 0))].astype(np.uint64)
    assert language._grams(codes, 1 << 20).sum() == sum(plain(text).values())
    whole = language.profile(text)
    monkeypatch.setattr(language, "PIECE", 7)
    assert np.allclose(language.profile(text), whole) and math.isclose(np.linalg.norm(whole), 1)
    assert language.profile("  12 !?") is None and language.profile("") is None and language.profile(None) is None


def test_families_merge_the_nearest():
    e = np.eye(6)
    centres = {"a": e[0] + 0.1 * e[1], "b": e[0] + 0.1 * e[2], "c": e[3] + 0.1 * e[4], "d": e[3] + 0.1 * e[5]}
    assert language.families(centres) == [["a", "b"], ["c", "d"]]
    assert language.families({"a": e[0]}) == [["a"]] and language.families({}) == []


def test_machine_is_the_minimum():
    rng = np.random.default_rng(1)
    x, side = rng.normal(size=(60, 5)), np.repeat([0, 1], 30)
    x[side > 0, 0] += 1.5
    w, (_, slope) = language.separate(x, side, cost=1.0)
    rows, y = np.hstack([x, np.ones((60, 1))]), np.where(side > 0, 1.0, -1.0)
    loss = lambda v: 0.5 * v @ v + (np.maximum(0, 1 - y * (rows @ v)) ** 2).sum()
    assert slope > 0 and all(loss(w) <= loss(w + 1e-3 * d) for d in rng.normal(size=(50, 6)))


def test_odd_rows(spark):
    out = sorted(map(tuple, language.languages(documents(spark)).select("doc_id", "lang_pred").collect()), key=str)
    assert len(out) == 10
    assert [x for x in out if x[0] in (2, 3, 4)] == [(2, "und"), (3, "und"), (4, "und")]
    assert {x[1] for x in out if x[0] not in (2, 3, 4)} == {"en"}
    assert language.languages(nothing(spark)).count() == 0
    one = documents(spark, [(1, "text that nobody learned", "a")]).drop("lang").selectExpr("*", "cast(null as string) lang")
    assert [tuple(r) for r in language.languages(one).select("lang_pred", "score").collect()] == [("und", 0.0)]
