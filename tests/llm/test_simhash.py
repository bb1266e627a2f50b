from __future__ import annotations

import re
from collections import Counter

import numpy as np
import xxhash

from lodestream.llm import simhash
from lodestream.llm.components import connected_components
from odd import documents, nothing, stored


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    votes = Counter()
    for p in parts:
        h = xxhash.xxh64_intdigest(p.encode(), seed=42)
        votes.update(b for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(parts))


def roots(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    return {i: find(i) for i in ids}


def brute(docs):
    rows = [(r.doc_id, fingerprint(r.text)) for r in docs.collect()]
    codes = sorted({f for _, f in rows})
    near = [(a, b) for i, a in enumerate(codes) for b in codes[i + 1 :] if (a ^ b).bit_count() <= 2]
    group = roots(codes, near)
    least = {}
    for d, f in rows:
        if d is not None:
            least[group[f]] = min(d, least.get(group[f], d))
    return sorted((d is None, d or 0, f"{f:016x}", least.get(group[f])) for d, f in rows)


def found(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint, r.component_id) for r in df.collect())


def test_against_all_pairs(spark, sf_dir):
    docs = stored(spark, sf_dir)
    assert found(simhash.simhash_components(docs)) == brute(docs)


def test_odd_rows(spark):
    docs = documents(spark)
    assert found(simhash.simhash_components(docs)) == brute(docs)
    assert simhash.simhash_components(nothing(spark)).count() == 0


def test_index_equals_all_pairs():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = codes[rng.integers(0, 40, 400)] ^ (np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64))
    every = np.unique(np.concatenate([codes, near]))
    every = every[np.argsort(simhash.gray_rank(every))]
    pairs = {(int(x), int(y)) for a, b in simhash.close_pairs(every[:, None], 2) for x, y in zip(a, b)}
    assert pairs == {(i, j) for i in range(len(every)) for j in range(i + 1, len(every)) if int(every[i] ^ every[j]).bit_count() <= 2}


def test_the_index_prunes():
    rng = np.random.default_rng(3)
    codes = np.unique(rng.integers(0, 1 << 63, 4096, dtype=np.uint64))
    codes = codes[np.argsort(simhash.gray_rank(codes))]
    seen = {}
    list(simhash.close_pairs(codes[:, None], 2, seen))
    assert seen["pairs"] < 0.2 * len(codes) * (len(codes) - 1) / 2


def test_masks_meet_all_near_codes():
    rng = np.random.default_rng(4)
    for bits in (0, 3, 11, 64):
        kept = simhash.masks(3, 2, bits)
        assert all(m.bit_count() <= min(bits, 22) for m in kept)
        for _ in range(200):
            x = int(rng.integers(0, 1 << 63))
            y = x ^ (1 << int(rng.integers(0, 64))) ^ (1 << int(rng.integers(0, 64)))
            assert any(x & m == y & m for m in kept)


def test_a_hub(spark):
    n = 100_000
    edges = spark.range(1, n).selectExpr(f"{n} as a", "id as b")
    out = connected_components(edges)
    assert out.count() == n and out.where("root != 1").count() == 0


def test_crowded_nodes_are_refined(spark):
    rng = np.random.default_rng(2)
    codes = sorted({int(x) for x in rng.integers(0, 1 << 20, 600)})  # agree on the high bits: one crowded node
    edges = simhash.close_links(spark.createDataFrame([(c,) for c in codes], "fp long"), 2, node=32).collect()
    near = [(a, b) for i, a in enumerate(codes) for b in codes[i + 1 :] if (a ^ b).bit_count() <= 2]
    assert all((r.a ^ r.b).bit_count() <= 2 for r in edges)
    assert roots(codes, [(r.a, r.b) for r in edges]) == roots(codes, near)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(7, 7), (None, 3), (1, 2)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def sets(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_duplicates_by_similarity(spark, sf_dir):
    docs = stored(spark, sf_dir)
    of = {r.doc_id: r.component_id for r in simhash.similar_components(docs).collect()}
    shingles = {r.doc_id: sets(r.text) for r in docs.collect()}
    ids = sorted(shingles)
    near, alike = [], {}
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            j = len(shingles[a] & shingles[b]) / max(1, len(shingles[a] | shingles[b]))
            alike[a, b] = j
            if j >= 0.8:
                near.append((a, b))
    assert near
    assert sum(of[a] == of[b] for a, b in near) >= 0.95 * len(near)
    joined = {a for (a, b), j in alike.items() if of[a] == of[b]} | {b for (a, b), j in alike.items() if of[a] == of[b]}
    fine = [d for d in joined if max(j for pair, j in alike.items() if d in pair) < 0.7]
    assert not fine, "documents without anything alike"


def test_one_of_each_group_stays(spark):
    docs = documents(spark)
    kept = simhash.drop_near_duplicates(docs, 5, 0.8)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is None, x or 0))
    assert ids == [1, 2, 6, 8, None]  # as sets of shingles 6 and 7 are alike
    assert simhash.drop_near_duplicates(nothing(spark)).count() == 0


def test_hot_bands_lose_nothing(spark):
    base = " ".join(f"w{i}" for i in range(200))
    rows = [(i, base + f" tail{i}", "a") for i in range(120)]
    got = simhash.similar_components(documents(spark, rows), node=16).collect()
    assert {r.component_id for r in got} == {0}


def test_a_crowd_around_the_threshold_is_split_as_by_all_pairs(spark):
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(240):  # copies with up to 12 words changed: about half of all pairs are below 0.8
        words = list(base)
        for at in rng.choice(300, int(rng.integers(3, 13)), replace=False):
            words[at] = f"x{i}-{at}"
        rows.append((i, " ".join(words), "a"))
    of = [sets(text) for _, text, _ in rows]
    links = [(a, b) for a in range(len(of)) for b in range(a) if len(of[a] & of[b]) >= 0.8 * len(of[a] | of[b])]
    want = roots(list(range(len(of))), links)
    assert 1 < len(set(want.values())) < len(of)
    for node in (16, 1024):
        got = {r.doc_id: r.component_id for r in simhash.similar_components(documents(spark, rows), node=node).collect()}
        assert got == want


def test_appended_and_cut_texts_are_found_and_links_are_exact(spark):
    rng = np.random.default_rng(5)
    rows, of = [], {}
    for n in range(150):  # mostly distinct words; the first copy is appended to, down to a similarity of 0.8
        size = int(rng.integers(60, 400))
        words = [f"w{x}" for x in rng.integers(0, 1 << 40, 2 * size)]
        for similarity in (1.0, rng.uniform(0.8, 0.95), rng.uniform(0.68, 0.78)):
            whole = size - 4
            longer = int(whole / similarity) if similarity >= 0.8 else -int(-whole / similarity)
            text = " ".join(words[: longer + 4]) if similarity >= 0.8 else " ".join(words[:size] + [f"x{x}" for x in rng.integers(0, 1 << 40, longer - whole)])
            of[len(rows)] = sets(text)
            rows.append((len(rows), text, "a"))
    got = {r.doc_id: r.component_id for r in simhash.similar_components(documents(spark, rows)).collect()}
    links = []
    for n in range(0, len(rows), 3):
        for a, b in ((n, n + 1), (n, n + 2), (n + 1, n + 2)):
            if len(of[a] & of[b]) >= 0.8 * len(of[a] | of[b]):
                links.append((a, b))
    assert len(links) >= 150 and len({b for a, b in links if b % 3 == 2}) < 20
    want = roots(list(of), links)
    assert got == {d: want[d] for d in of}


def test_rows_of_one_id_go_or_stay_by_their_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a, "s"), (2, a, "s"), (2, b, "s"), (3, c, "s"), (3, c, "s"), (3, c, "t"), (None, a, "s"), (None, a, "s")]
    for parts in (1, 5):
        kept = simhash.drop_near_duplicates(documents(spark, rows).repartition(parts)).collect()
        assert sorted((str(r.doc_id), r.text) for r in kept) == sorted([("1", a), ("2", b), ("3", c), ("None", a), ("None", a)])
        assert len({r.source for r in kept if r.doc_id == 3}) == 1
    got = {(r.doc_id, r.component_id, r.first) for r in simhash.similar_components(documents(spark, rows)).collect()}
    assert got == {(1, 1, True), (2, 1, False), (2, 2, True), (3, 3, True)}
    assert simhash.drop_near_duplicates(nothing(spark)).count() == 0
