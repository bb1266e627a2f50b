"""SimHash near-duplicates through a hierarchical index in Gray order.

A fingerprint bit is the majority vote of that bit over the hashes of a text's word shingles. The index has
nodes that are masked bit patterns. Its upper nodes are dealt out by Spark: a mask keeps the first bits of one of three
blocks, just as many as leave about FILL codes under a node, and all codes that agree on them lie under it; two codes
within two bits agree on a block. Below such a node the codes stand in Gray order, where neighbours differ in few
bits; runs of them form nodes, and runs of nodes form nodes, each with the bits that all its codes share. A search
walks two nodes at a time from the top, adds up the shared bits in which they differ, and drops the pair, with
everything below it, once they exceed the distance allowed.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SMALL_IDS, Scratch, broadcast_if_small, cache_of, cut, fresh, text_batches
from .components import connected_components

SEED = 42
#: Codes that an upper node holds on average, and codes that it may hold; a larger one gets more mask bits.
FILL, NODE = 1024, 16_384
#: Codes in a leaf and children of a node.
FAN = 8
#: Hot nodes, or codes, up to which their keys are broadcast (about 24 bytes each).
SMALL_KEYS = 100_000
#: An odd constant: the golden ratio times 2**64.
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes, size: int) -> list[bytes]:
    """Runs of `size` words, lower-cased in A-Z, joined by a space; the whole text if it has fewer words."""
    words = text.lower().split()
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(size)))))


def hashes(parts: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, parts, itertools.repeat(SEED)), np.uint64, len(parts))


def spread(h: np.ndarray, words: int) -> np.ndarray:
    """`words` 64-bit values for each hash: the hash itself, then mixes of it."""
    out = np.empty((len(h), words), np.uint64)
    out[:, 0] = h
    with np.errstate(over="ignore"):
        for j in range(1, words):
            x = h + GOLDEN * np.uint64(j)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            out[:, j] = x ^ (x >> np.uint64(31))
    return out


BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def majority(h: np.ndarray, words: int = 1) -> np.ndarray:
    """The fingerprint, as `words` 64-bit values: a bit is 1 if it is set in over half of the hashes."""
    if not len(h):
        return np.zeros(words, np.uint64)
    octets = spread(h, words).view(np.uint8)
    if len(h) <= 256:
        votes = np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    else:
        votes = np.concatenate([np.bincount(octets[:, i], minlength=256) @ BITS for i in range(octets.shape[1])])
    return np.packbits(votes * 2 > len(h), bitorder="little").view(np.uint64)


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id and fp, the 64-bit fingerprint as a signed long. A null text counts as empty: fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            codes = np.array([majority(hashes(shingles(t or b"", size)))[0] for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


# The index below an upper node.


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Ranks in Gray order of the first 64 bits: the prefix parity of a code's bits."""
    rank = codes.copy()
    for k in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(k)
    return rank


def close_pairs(codes: np.ndarray, most: int, seen: dict | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j of the rows of `codes` (n x words, in Gray order) that differ in at most `most` bits.

    `seen` counts the pairs of codes that were compared, under "pairs".
    """
    levels = [(codes, np.full_like(codes, ~np.uint64(0)))]  # bits, and which of them the whole node shares
    while len(levels[-1][0]) > FAN:
        bits, mask = levels[-1]
        at = np.arange(0, len(bits), FAN)
        ones, some = np.bitwise_and.reduceat(bits & mask, at, axis=0), np.bitwise_or.reduceat(bits, at, axis=0)
        mask = np.bitwise_and.reduceat(mask, at, axis=0) & ~(ones ^ some)
        levels.append((ones & mask, mask))
    top = len(levels[-1][0])
    i, j = (x.astype(np.int64) for x in np.triu_indices(top))
    yield from _walk(levels, len(levels) - 1, i, j, np.zeros((len(i), codes.shape[1]), np.uint64), np.zeros(len(i), np.int64), most, seen)


def _walk(levels: list, k: int, i: np.ndarray, j: np.ndarray, known: np.ndarray, differ: np.ndarray, most: int, seen: dict | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """`known`: the bits that the pairs' upper nodes both shared; `differ`: in how many of them they differ."""
    bits, mask = levels[k]
    for s in range(0, len(i), 65_536):
        part = slice(s, s + 65_536)
        a, b = i[part], j[part]
        both = mask[a] & mask[b]
        total = differ[part] + np.bitwise_count((bits[a] ^ bits[b]) & both & ~known[part]).sum(axis=1)
        near = total <= most
        if seen is not None and not k:
            seen["pairs"] = seen.get("pairs", 0) + int((a != b).sum())
        a, b = a[near], b[near]
        if not k:
            yield a[a != b], b[a != b]
        elif len(a):
            below = len(levels[k - 1][0])
            step = np.arange(FAN)
            x = np.repeat((a[:, None] * FAN + step), FAN, axis=1).ravel()
            y = np.tile((b[:, None] * FAN + step), (1, FAN)).ravel()
            fine = (x < below) & (y < below) & (x <= y)
            above = np.repeat(np.arange(len(a)), FAN * FAN)[fine]
            yield from _walk(levels, k - 1, x[fine], y[fine], both[near][above], total[near][above], most, seen)


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """A spanning forest of the pairs: at most n - 1 links that connect what the pairs connect."""
    root, links = list(range(n)), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        for x, y in zip(a.tolist(), b.tolist()):
            p, q = find(x), find(y)
            if p != q:
                root[max(p, q)] = min(p, q)
                links.append((x, y))
    return links


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Regroups sorted batches so that none ends inside a run of equal values in its first `keys` columns."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(keys)]
        new = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1
        first = [c[0] for c in cols]
        if held and any(held[-1].column(c)[-1].as_py() != f for c, f in enumerate(first)):
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
        if len(new):
            last = int(new[-1])
            held.append(batch.slice(0, last))
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
            batch = batch.slice(last)
        held.append(batch)
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def runs(*cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal rows in sorted columns."""
    new = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1
    return np.r_[0, new], np.r_[new, len(cols[0])]


def masks(blocks: int, most: int, bits: int = 64) -> list[int]:
    """All masks that keep all but `most` of `blocks` blocks of 64 bits: codes within `most` bits agree on one.

    Each keeps `bits` bits at most, those of its first block first.
    """
    edges = [64 * i // blocks for i in range(blocks + 1)]
    block = [range(a, b) for a, b in zip(edges, edges[1:])]
    kept = [[63 - x for part in parts for x in part][:bits] for parts in itertools.combinations(block, blocks - most)]
    return sorted({sum(1 << x for x in places) for places in kept})


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _rank(code: Column) -> Column:
    for k in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, k))
    return code


def close_links(codes: DataFrame, most: int = 2, node: int = NODE, fill: int = FILL) -> DataFrame:
    """Edges (a, b) that connect what codes within `most` bits of each other connect; `codes` has distinct longs fp.

    Level by level: codes go under the nodes of masks over `most` + 1 blocks, of as many bits as leave `fill` codes to
    a node on average; nodes of more than `node` codes, which one task should not hold, hand theirs on to the masks
    of 4 blocks, then 8, and then 16, under which at most 2 ** (4 * most) codes agree. So every pair is met, no node is
    unbounded, and only crowded regions are refined.
    """
    bits = max(0, math.ceil(math.log2(max(codes.count(), 1) / fill)))
    levels = [masks(most + 1, most, bits), *(masks(blocks, most) for blocks in (4, 8, 16) if blocks > most + 1)]
    out = []
    for level, kept in enumerate(levels):
        kept = [_signed(m) for m in kept]
        keyed = codes.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("m"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(kept)])).alias("k")).select("k.m", "k.bits", "fp")
        hot = None
        if level + 1 < len(levels):
            hot = cut(keyed.groupBy("m", "bits").agg(F.count("*").alias("n")).where(F.col("n") > node).select("m", "bits"))
            many = hot.count()
            if not many:
                hot = None
        cold = keyed if hot is None else keyed.join(broadcast_if_small(hot, many, SMALL_KEYS), ["m", "bits"], "left_anti")
        cold = cold.repartition("m", "bits").sortWithinPartitions("m", "bits", _rank(F.col("fp")))
        out.append(cut(cold.mapInArrow(lambda b, d=most: _search(b, d), "a long, b long").distinct()))
        if hot is None:
            break
        codes = cut(keyed.join(broadcast_if_small(hot, many, SMALL_KEYS), ["m", "bits"], "left_semi").select("fp").distinct())
    edges = out[0]
    for more in out[1:]:
        edges = edges.unionByName(more)
    return edges


def _search(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for batch in grouped(batches, 2):
        m, bits, fp = (batch.column(c).to_numpy() for c in range(3))
        starts, ends = runs(m, bits)
        size = ends - starts
        codes = fp.view(np.uint64)
        a, b = [], []
        two = starts[size == 2]
        near = two[np.bitwise_count(codes[two] ^ codes[two + 1]) <= most]
        a.append(fp[near])
        b.append(fp[near + 1])
        for s, e in zip(starts[size > 2].tolist(), ends[size > 2].tolist()):
            if links := forest(e - s, close_pairs(codes[s:e, None], most)):
                x, y = np.array(links).T
                a.append(fp[s + x])
                b.append(fp[s + y])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])


def simhash_components(docs: DataFrame, size: int = 3, most: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id that links lead to.

    Texts with equal fingerprints and those within `most` bits are linked. docs: doc_id, text; other columns
    are ignored. A null or blank text has the fingerprint zero, linked like any other. Repeated rows stay
    repeated. A row with a null doc_id gets a row but lends its group no id. An empty table gives no rows.
    """
    text_batches(docs.sparkSession)
    of = cut(fingerprints(docs, size))
    codes = of.groupBy("fp").agg(F.min("doc_id").alias("first"))
    # a code's node: nodes stand in the order of their smallest doc_id, so the root of a component is its name
    codes = cut(codes.select("fp", F.struct(F.col("first").isNull().alias("none"), "first", "fp").alias("node")))
    many = codes.count()
    links = close_links(codes.select("fp"), most)
    number = lambda x: broadcast_if_small(codes.select(F.col("fp").alias(x), F.col("node").alias(f"node_{x}")), many, SMALL_KEYS)
    edges = links.join(number("a"), "a").join(number("b"), "b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    roots = connected_components(edges)
    names = cut(codes.join(roots, "node", "left").select("fp", F.coalesce("root.first", "node.first").alias("component_id")))
    return of.join(broadcast_if_small(names, many, SMALL_KEYS), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Near-duplicates by similarity.

#: 64-bit words of the SimHash code.
CODE_WORDS = 8
#: Bands of min-hashes that find candidates, and min-hashes in one: a pair at 0.8 shares none of them with a chance of 3e-6.
BANDS, ROWS = 32, 5
#: Rounds in which a band's texts are compared with one of them only, before all pairs left are.
ROUNDS = 2
#: Shingles that the sets of a block of texts hold on average at most, unless one text has more.
SET_MASS = 1 << 20
_DRAWN = np.random.default_rng(SEED).integers(0, 1 << 63, (3, BANDS * ROWS), dtype=np.uint64)
FLIPS, FACTORS = _DRAWN[0] << np.uint64(1), _DRAWN[1] << np.uint64(1) | np.uint64(1)
JOINS = (_DRAWN[2] << np.uint64(1) | np.uint64(1)).reshape(BANDS, ROWS)


def bits_apart(similarity: float, bits: int = 64 * CODE_WORDS, slack: float = 8.0) -> int:
    """Differing bits up to which two codes may belong to sets of that Jaccard similarity: as many as sets of equal
    size, which differ most, have on average, and `slack` standard deviations more."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(bits * share + slack * math.sqrt(bits * share * (1 - share)))


def min_bands(h: np.ndarray) -> np.ndarray:
    """The bands of a set of hashes, none for the empty set."""
    if not len(h):
        return np.empty(0, np.int64)
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    with np.errstate(over="ignore"):
        for s in range(0, len(h), 256):
            np.minimum(least, ((h[s : s + 256, None] ^ FLIPS) * FACTORS).min(axis=0), out=least)
        keys = (least.reshape(BANDS, ROWS) * JOINS).sum(axis=1) + GOLDEN * np.arange(BANDS, dtype=np.uint64)
        keys = (keys ^ (keys >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return (keys ^ (keys >> np.uint64(31))).view(np.int64)


def _codes(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """For each text the set of its shingles' hashes, a hash of that set, its code and its bands."""
    cache_of("simhash")
    for batch in batches:
        for s in range(0, batch.num_rows, 256):
            part = batch.slice(s, 256)
            sets = [np.unique(hashes(shingles(t or b"", size))) for t in part.column(1).cast(pa.binary()).to_pylist()]
            same = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64)
            codes = [majority(x, CODE_WORDS).tobytes() for x in sets]
            lists = [_lists(x) for x in ([min_bands(x) for x in sets], [x.view(np.int64) for x in sets])]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(same), pa.array(codes, pa.binary()), *lists], ["doc_id", "mark", "same", "code", "bands", "shingles"])


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(np.concatenate(rows)))


def _shared(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many values the sorted, non-empty sets a[k] and b[k] share; a set is values[start:end]."""
    out = np.empty(len(a), np.int64)
    order = np.argsort(a, kind="stable")
    for s, e in zip(*(x.tolist() for x in runs(a[order]))):
        at = order[s:e]
        one = values[starts[a[at[0]]] : ends[a[at[0]]]]
        size = ends[b[at]] - starts[b[at]]
        first = np.cumsum(size) - size
        others = values[np.repeat(starts[b[at]] - first, size) + np.arange(size.sum())]
        same = one[np.minimum(np.searchsorted(one, others), len(one) - 1)] == others
        out[at] = np.add.reduceat(same, first, dtype=np.int64)
    return out


def _similar(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Under each node a spanning forest of its links: texts of different roots whose sets are that similar.

    Pairs of codes within reach are found in Gray order and decided by the sets; those that links have already joined
    are passed over.
    """
    most = bits_apart(similarity)
    for batch in grouped(batches, 3):
        keys = [batch.column(c).to_numpy() for c in range(3)]
        ids, sets = batch.column(3).to_numpy(), batch.column(6)
        codes = np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint64).reshape(len(ids), CODE_WORDS)
        root = np.unique(batch.column(4).to_numpy(), return_inverse=True)[1]
        offsets, values = sets.offsets.to_numpy(), sets.values.to_numpy().view(np.uint64)
        starts, ends = offsets[:-1].astype(np.int64), offsets[1:].astype(np.int64)
        size = ends - starts
        for s, e in zip(*(x.tolist() for x in runs(*keys))):
            at = s + np.argsort(gray_rank(codes[s:e, 0]), kind="stable")
            for i, j in close_pairs(codes[at], most):
                a, b = at[i], at[j]
                fits = (root[a] != root[b]) & (np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b]) - 1e-9)
                if not fits.any():
                    continue
                a, b = a[fits], b[fits]
                link = _shared(values, starts, ends, a, b) * (1 + similarity) >= similarity * (size[a] + size[b]) - 1e-9
                found = []
                for x, y in zip(a[link].tolist(), b[link].tolist()):
                    if root[x] != root[y]:
                        root[s:e][root[s:e] == root[y]] = root[x]
                        found.append((min(ids[x], ids[y]), max(ids[x], ids[y])))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["a", "b"])


def similar_components(docs: DataFrame, size: int = 5, similarity: float = 0.8, node: int = 1024) -> DataFrame:
    """doc_id, mark, component_id and first for near-duplicates: texts whose sets of `size`-word shingles are that similar.

    Every link is decided by the Jaccard similarity of the sets themselves (of 64-bit hashes). A pair is a candidate
    if any band of min-hashes of the shingles agrees. Texts of one set are one node. In the first rounds a band's
    texts are compared with one of them, so large groups of copies join without all their pairs; then all pairs of
    a band that are not joined yet and whose SimHash codes allow the similarity, searched in Gray order, and decided
    where they are found, so only links leave the task. A band of more than `node` codes, or `SET_MASS` shingles, is
    searched by pairs of blocks. mark is a hash of the text, which tells rows of one id apart; a component is named by its
    smallest doc_id, and first says that a row has the smallest id and mark of its component. Null and empty texts are
    alike; rows with a null doc_id take no part; repeated rows stay; an empty table gives no rows.
    """
    with Scratch(docs.sparkSession) as scratch:
        texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64(F.col("text").cast("string")).alias("mark"))
        of = scratch.table(texts.mapInArrow(lambda b: _codes(b, size), "doc_id long, mark long, same long, code binary, bands array<long>, shingles array<long>"), "codes")
        groups = scratch.table(of.groupBy("same").agg(F.min(F.struct("doc_id", "mark")).alias("id"), F.first("bands").alias("bands"), F.first("code").alias("code"), F.first(F.size("shingles")).alias("size")), "groups")
        keyed = groups.select(F.explode("bands").alias("band"), "same", "size")
        blocks = F.ceil(F.greatest(F.count("*") / node, F.sum("size") / SET_MASS)).cast("int").alias("blocks")
        shared = keyed.groupBy("band").agg(F.count("*").alias("n"), blocks).where("n > 1").drop("n")
        keyed = scratch.table(keyed.join(shared, "band"), "keyed")
        met = cut(keyed.select("same").distinct())
        met = broadcast_if_small(met, met.count(), SMALL_IDS)  # before the sets are shuffled
        sets = scratch.table(of.select("same", "shingles").join(met, "same", "left_semi").groupBy("same").agg(F.first("shingles").alias("shingles")), "sets")

        def alike(pairs: DataFrame) -> DataFrame:
            both = pairs.join(sets.select(F.col("same").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("same").alias("b"), F.col("shingles").alias("y")), "b")
            small, large = F.least(F.size("x"), F.size("y")), F.greatest(F.size("x"), F.size("y"))
            fits = both.where(small >= similarity * large - 1e-9)
            return fits.where(F.size(F.array_intersect("x", "y")) * (1 + similarity) >= similarity * (small + large) - 1e-9).select("a", "b")

        tried = docs.sparkSession.createDataFrame([], "a long, b long")
        roots = docs.sparkSession.createDataFrame([], "node long, root long")
        for k in range(ROUNDS + 1):
            now = keyed.join(roots, F.col("same") == F.col("node"), "left").select("band", "blocks", "same", F.coalesce("root", "same").alias("root"))
            first = F.min(F.struct(F.xxhash64("same", F.lit(k)).alias("h"), "same", "root")).alias("c")
            open_ = now.groupBy("band").agg(first, F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("band", "c")
            if k < ROUNDS:
                found = now.join(open_, "band").where("root != c.root").select(F.least("same", "c.same").alias("a"), F.greatest("same", "c.same").alias("b"))
                found = cut(found.distinct().join(tried, ["a", "b"], "left_anti"))
                if found.isEmpty():
                    continue
                tried = tried.unionByName(found)
                more = cut(alike(found))
            else:
                left = now.join(open_.select("band"), "band", "left_semi").join(groups.select("same", "code"), "same").join(sets, "same")
                left = left.withColumn("own", F.pmod(F.xxhash64("same"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
                left = left.select("band", F.least("own", "other").cast("int").alias("low"), F.greatest("own", "other").cast("int").alias("high"), "same", "root", "code", "shingles")
                left = left.repartition("band", "low", "high").sortWithinPartitions("band", "low", "high")
                more = cut(left.mapInArrow(lambda b: _similar(b, similarity), "a long, b long").distinct())
            if not more.isEmpty():  # the stars found so far stand for the links that made them
                roots = connected_components(more.unionByName(roots.select(F.col("root").alias("a"), F.col("node").alias("b"))))
        names = groups.join(roots, F.col("same") == F.col("node"), "left").select("same", "id", F.coalesce("root", "same").alias("root"))
        least = names.groupBy("root").agg(F.min("id").alias("least"))
        names = names.join(least, "root").select("same", "least")
        named = of.select("doc_id", "mark", "same").join(names, "same")
        return scratch.result(named.select("doc_id", "mark", F.col("least.doc_id").alias("component_id"), (F.struct("doc_id", "mark") == F.col("least")).alias("first")))


def drop_near_duplicates(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """`docs` with one row of each group of near-duplicates: one with the smallest doc_id, and its smallest hash of a text.

    Rows that repeat an id are told apart by their texts: each goes or stays for its own text's sake. Of rows
    with one id and text one stays, that with the smallest hash of all columns. Rows with a null doc_id stay; an empty table
    gives no rows. Few dropped rows' ids are broadcast, many are joined.
    """
    found = similar_components(docs, size, similarity)
    own, mark = fresh(docs, "id"), fresh(docs, "mark")
    key = [F.col("doc_id").alias(own), F.col("mark").alias(mark)]
    fits = (F.col("doc_id").cast("long") == F.col(own)) & (F.xxhash64(F.col("text").cast("string")) == F.col(mark))
    gone = cut(found.where("not first").select(*key).distinct())
    left = docs.join(broadcast_if_small(gone, gone.count(), SMALL_IDS), fits, "left_anti")
    twice = cut(found.where("first").groupBy("doc_id", "mark").count().where("count > 1").select(*key))
    many = twice.count()
    if not many:
        return left
    twice = broadcast_if_small(twice, many, SMALL_IDS)
    row = F.struct(*(docs[c] for c in docs.columns))
    several = left.join(twice, fits).groupBy(own, mark).agg(F.min_by(row, F.xxhash64(row)).alias("row")).select("row.*")
    return left.join(twice, fits, "left_anti").unionByName(several)
