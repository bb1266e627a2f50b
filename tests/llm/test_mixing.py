from __future__ import annotations

import re
from collections import Counter, defaultdict

from lodestream.llm import mixing
from odd import documents, nothing, stored


def targets(sizes, weights=(3, 1, 2), most=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in full]
        share = {s: (total - sum(full.values())) * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > most * sizes[s] + 1e-9]
        if not over:
            return full | share
        full |= {s: most * sizes[s] for s in over}


def check(docs, near):
    out = mixing.mix(docs).collect()
    rows = docs.collect()
    assert len(out) == len(rows)
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    sizes = Counter()
    for r in rows:
        sizes[r.source] += size(r)
    want = targets(dict(sizes))
    assert Counter((r.doc_id, size(r)) for r in rows) == Counter((r.doc_id, r.size) for r in out)
    taken = Counter()
    for r in out:
        assert abs(r.target - want[r.source]) <= 1e-6 * max(1, want[r.source]) and r.source_size == sizes[r.source]
        assert r.taken % max(r.size, 1) == 0 and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= near * want[s] + 2, s
    return out


def test_words_come_near_the_targets(spark, sf_dir):
    docs = stored(spark, sf_dir)
    out = check(docs, 0.02)  # ten documents a source
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted((r.doc_id, r.copies) for r in out) == sorted((r.doc_id, r.copies) for r in again)


def test_rates_are_tilted_by_size(spark):
    rows = [(i, "w " * (1 + i % 50), "a" if i % 3 else "b") for i in range(3000)]
    out = check(documents(spark, rows), 0.002)
    for source in "ab":
        by_size = defaultdict(list)
        for r in out:
            if r.source == source:
                by_size[r.size > 25].append(r.copies)
        small, large = (sum(v) / len(v) for v in (by_size[False], by_size[True]))
        ratio = out[0].target and next(r.target / r.source_size for r in out if r.source == source)
        assert (large >= small - 0.05) if ratio > 1 else (large <= small + 0.05)


def test_odd_rows(spark):
    rows = [(i, "one two three", None if i % 2 else "x") for i in range(400)] + [(1000, None, "empty"), (1001, " ", "empty"), (None, "no id", "x"), (5, "one two three", "x"), (5, "one two three", "x")]
    out = check(documents(spark, rows), 0.02)
    assert {r.taken for r in out if r.source == "empty"} == {0}
    assert mixing.mix(nothing(spark)).count() == 0


def test_copies(spark):
    rows = [(i, "one two three", "a" if i % 5 else "b") for i in range(500)]
    docs = documents(spark, rows)
    copies = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    out = mixing.materialise(docs)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter({d: c for d, c in copies.items() if c})
    assert mixing.materialise(nothing(spark)).count() == 0


def test_one_source_alone(spark):
    check(documents(spark, [(i, "a b " * (i + 1), "only") for i in range(30)]), 0.02)


def test_rows_without_or_with_one_id_come_near_the_target(spark):
    rows = [(None, "w " * (1 + i % 9), "a") for i in range(1000)] + [(7, "one two three", "b") for _ in range(1000)] + [(10_000 + i, "x " * (1 + i % 7), "c") for i in range(900)]
    docs = documents(spark, rows)
    out = check(docs, 0.01)
    mixed = Counter(r.source for r in mixing.materialise(docs).collect() for _ in r.text.split())
    for s in "abc":
        target = next(r.target for r in out if r.source == s)
        assert abs(mixed[s] - target) <= 0.01 * target + 9


def test_one_large_group_of_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 64)
    rows = [(3, "one two", "a")] * 1000 + [(i + 10, "one two three", "b") for i in range(500)]
    docs = documents(spark, rows)
    out = check(docs, 0.01)
    words = sum(r.taken for r in out if r.source == "a")
    assert abs(2 * mixing.materialise(docs).where("source = 'a'").count() - words) <= 0.02 * words


def test_many_sources(spark):
    check(documents(spark, [(i, "w " * (1 + i % 5), f"s{i % 37}" if i % 37 else None) for i in range(4000)]), 0.01)


def test_materialise_is_the_same_in_any_partitions(spark):
    from pyspark.sql import functions as F

    rows = spark.range(1001).select(F.lit(1).cast("long").alias("doc_id"), F.lit("three words here").alias("text"), F.lit("a").alias("source"), F.concat(F.lit("l"), F.col("id") % 7).alias("lang"))
    more = spark.range(40).selectExpr("id + 10 AS doc_id", "repeat('w ', cast(id AS int)) AS text", "if(id % 2 = 0, 'a', 'b') AS source", "'x' AS lang")
    docs = rows.unionByName(more)
    first = sorted(map(tuple, mixing.materialise(docs.repartition(3)).collect()))
    assert first == sorted(map(tuple, mixing.materialise(docs.repartition(5, "lang")).collect()))
    want = sum(r.copies for r in mixing.mix(docs, extra=("mark",)).where("doc_id = 1").collect())
    assert abs(sum(r[0] == 1 for r in first) - want) <= 5


def test_materialise_many_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 64)
    docs = spark.range(500).selectExpr("cast(1 AS long) AS doc_id", "'same words' AS text", "'a' AS source").unionByName(spark.range(20).selectExpr("id + 5 AS doc_id", "'others here too' AS text", "'b' AS source"))
    counts = {r.doc_id: r["count"] for r in mixing.materialise(docs).groupBy("doc_id").count().collect()}
    taken = {r.doc_id: r.n for r in mixing.mix(docs, extra=("mark",)).groupBy("doc_id").agg({"copies": "sum"}).withColumnRenamed("sum(copies)", "n").collect()}
    assert counts[1] == taken[1] and sum(counts.values()) == sum(taken.values())
