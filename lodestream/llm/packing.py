"""Packing documents into training sequences by lexical retrieval.

A document's full windows are sequences of their own. What is left of it, its tail, seeds a window that the
tails most like it fill: shards of tails each have an inverted index of token ids with BM25 weights, whose
document frequencies come from all documents; the seed is the query, and the best neighbours not used yet go
into its window until it is full. The last one is cut; its rest seeds the next window. Tails are dealt to
shards in the order of a min-hash of their telling ids, so similar ones meet in one shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .tokens import id_encoder, together

#: Tails in a shard, each shorter than a window: that bounds a shard's index.
SHARD = 4096
K1, B = 1.2, 0.75
#: An id of one tail in so many has a whole row in a shard's index: at most OFTEN * window rows of 4 * SHARD bytes.
OFTEN = 8
#: Neighbours that are sorted at first.
FIRST = 32
#: Share of the documents from which on an id tells little.
COMMON = 0.1
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
FIELDS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def _numbers() -> Iterator[int]:
    """Sequence ids that no other task gives out."""
    first = (TaskContext.get().partitionId() + 1) << 36
    yield from range(first, first + (1 << 36))


def _pieces(rows: list[tuple], payload: bool) -> pa.RecordBatch:
    """Rows (doc_id, start, ids, doc_tokens, sequence_id, offset) as a batch, with the ids if asked for."""
    ids = [r[2].astype("<u4").tobytes() for r in rows]
    cols = [[r[0] for r in rows], [r[1] for r in rows], [len(r[2]) for r in rows], [zlib.crc32(x) for x in ids], [r[3] for r in rows], [r[4] for r in rows], [r[5] for r in rows]]
    arrays = [pa.array(c, pa.int64()) for c in cols]
    return pa.RecordBatch.from_arrays(arrays + ([pa.array(ids, pa.binary())] if payload else []), FIELDS + ["ids"] * payload)


def _tokenise(batches: Iterator[pa.RecordBatch], path: str, window: int, payload: bool) -> Iterator[pa.RecordBatch]:
    """Pieces of full windows, tails with their ids, and at the end this task's document frequencies."""
    encoder, number = id_encoder(path), _numbers()
    df = np.zeros(encoder.size, np.int64)
    docs = words = 0
    for batch in together(batches):
        full, tails = [], []
        for doc, ids in zip(batch.column(0).to_pylist(), encoder.many(batch.column(1))):
            ids = np.append(ids, np.uint32(0))
            n = len(ids)
            docs, words = docs + 1, words + n
            df[ids] += 1  # once for an id, however often it is there
            cut = n - n % window
            full.extend((doc, at, ids[at : at + window], n, next(number), 0) for at in range(0, cut, window))
            if cut < n:
                tail = ids[cut:]
                tails.append((doc, cut, tail.astype("<u4").tobytes(), n))
        yield _kinds(_pieces(full, payload), tails, None)
    yield _kinds(None, [], (df, docs, words))


def _kinds(full: pa.RecordBatch | None, tails: list[tuple], stats: tuple | None) -> pa.RecordBatch:
    """One batch of the three kinds of rows: kind, piece, tail, payload of statistics."""
    n, m, k = full.num_rows if full else 0, len(tails), stats is not None
    total = n + m + k
    nulls = lambda kind, size: pa.nulls(size, kind)
    cols = [pa.array([0] * n + [1] * m + [2] * k, pa.int32())]
    for i, name in enumerate(FIELDS):
        own = [full.column(i)] if n else []
        if name in ("doc_id", "start", "doc_tokens"):
            at = {"doc_id": 0, "start": 1, "doc_tokens": 3}[name]
            rest = pa.array([t[at] for t in tails] + [stats[1] if name == "doc_id" else stats[2] if name == "start" else None] * k, pa.int64()) if k else pa.array([t[at] for t in tails], pa.int64())
        else:
            rest = nulls(pa.int64(), m + k)
        cols.append(pa.concat_arrays([*own, rest]))
    ids = [full.column(len(FIELDS))] if n and full.num_columns > len(FIELDS) else [nulls(pa.binary(), n)]
    cols.append(pa.concat_arrays([*ids, pa.array([t[2] for t in tails] + ([stats[0].astype("<i8").tobytes()] if k else []), pa.binary())]))
    assert all(len(c) == total for c in cols)
    return pa.RecordBatch.from_arrays(cols, ["kind", *FIELDS, "ids"])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob in batch.column(0).to_pylist():
            df = np.frombuffer(blob, "<i8")
            term = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(df[term])], ["term", "df"])


def ranks(df: np.ndarray, many: int) -> np.ndarray:
    """A place for each id in a random order that favours rare ones, by the square of their idf.

    Behind them stand the ids of more than COMMON of the documents and those of one alone, which tell no two
    tails apart or bring none together, and last id 0, which ends every tail.
    """
    x = np.arange(1, len(df) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    drawn = -np.log(((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2**53)
    telling = (df > 1) & (df <= COMMON * many)
    telling[0] = False
    key = drawn / np.where(telling, np.log1p((many - df + 0.5) / (df + 0.5)), 1.0) ** 2
    order = np.lexsort((key, np.where(telling, 0, 1) + (np.arange(len(df)) == 0)))
    place = np.empty(len(df), np.int64)
    place[order] = np.arange(len(df))
    return place


def _marked(batches: Iterator[pa.RecordBatch], place) -> Iterator[pa.RecordBatch]:
    """Adds the mark: the first three places among a tail's ids, as one number."""
    size = len(place.value)
    for batch in batches:
        blobs = batch.column(2).to_pylist()
        many = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
        places, at = place.value[np.frombuffer(b"".join(blobs), "<u4")], np.cumsum(many) - many
        a = np.minimum.reduceat(places, at)
        b = np.minimum.reduceat(np.where(places > np.repeat(a, many), places, size), at)
        c = np.minimum.reduceat(np.where(places > np.repeat(b, many), places, size), at)
        b = np.where(b == size, a, b)
        c = np.where(c == size, b, c)
        marks = (a * size + b) * size + c
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks, pa.int64())], ["doc_id", "start", "ids", "doc_tokens", "mark"])


class Shard:
    """The inverted index of some tails.

    The list of an id that one tail in OFTEN has, or more, is a row with a weight for every tail: such rows are added
    up as they stand. The other lists hold only the tails that have the id.
    """

    def __init__(self, tails: list[np.ndarray], idf: np.ndarray, mean: float):
        terms, weights = [], []
        for ids in tails:
            term, tf = np.unique(ids, return_counts=True)
            terms.append(term)
            weights.append(idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ids) / mean)))
        self.own, self.n = terms, len(tails)
        term, weight = np.concatenate(terms), np.concatenate(weights).astype(np.float32)
        of = np.repeat(np.arange(self.n), [len(t) for t in terms])
        often = np.flatnonzero(np.bincount(term) * OFTEN >= self.n)
        self.row = np.full(len(idf), -1)
        self.row[often] = np.arange(len(often))
        whole = self.row[term] >= 0
        self.rows = np.zeros((len(often), self.n), np.float32)
        self.rows[self.row[term[whole]], of[whole]] = weight[whole]
        term, weight, of = term[~whole], weight[~whole], of[~whole]
        order = np.argsort(term, kind="stable")
        self.of, self.weight = of[order], weight[order]
        self.at = np.searchsorted(term[order], np.arange(len(idf) + 1))

    def scores(self, query: np.ndarray) -> np.ndarray:
        """The BM25 score of every tail for the terms of `query`."""
        row = self.row[query]
        query = query[row < 0]
        start, size = self.at[query], self.at[query + 1] - self.at[query]
        where = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return self.rows[row[row >= 0]].sum(axis=0) + np.bincount(self.of[where], self.weight[where], self.n)

    def ranked(self, query: np.ndarray, unused: np.ndarray) -> Iterator[int]:
        """The unused tails by score for the terms of `query`, best first, ties in their order."""
        left = np.flatnonzero(unused)
        score = self.scores(query)[left]
        low = np.partition(score, len(left) - FIRST)[-FIRST] if len(left) > FIRST else -np.inf
        for some in (score >= low, score < low):  # few are needed as a rule: the others are sorted only if they are
            some = np.flatnonzero(some)
            yield from left[some[np.argsort(-score[some], kind="stable")]].tolist()


def _pack(batches: Iterator[pa.RecordBatch], window: int, idf, mean: float, payload: bool) -> Iterator[pa.RecordBatch]:
    """Fills windows from the tails of this partition, shard by shard; an open window goes on in the next shard."""
    weights = idf.value
    number = (x | 1 << 35 for x in _numbers())
    state = {"seq": next(number), "fill": 0, "query": None}
    rows: list[tuple] = []
    open_rows: list[tuple] = []

    def place(doc, start, ids, n):
        """Puts ids into the open window; gives back what does not fit."""
        take = min(len(ids), window - state["fill"])
        open_rows.append((doc, start, ids[:take], n, state["seq"], state["fill"]))
        state["fill"] += take
        if state["fill"] == window:
            rows.extend(open_rows)
            open_rows.clear()
            state.update(seq=next(number), fill=0, query=None)
        return start + take, ids[take:]

    def shard(tails):
        index = Shard([t[2] for t in tails], weights, mean)
        unused = np.ones(len(tails), bool)
        first = 0
        while True:
            if state["query"] is None:
                while first < len(tails) and not unused[first]:
                    first += 1
                if first == len(tails):
                    return
                unused[first] = False
                state["query"] = index.own[first]
                doc, start, ids, n = tails[first]
                place(doc, start, ids, n)  # a tail is shorter than a window: it fits
                continue
            if not unused.any():
                return
            for i in index.ranked(state["query"], unused):
                unused[i] = False
                doc, start, ids, n = tails[i]
                start, rest = place(doc, start, ids, n)
                if state["query"] is None:  # the window is full
                    if len(rest):
                        state["query"] = index.own[i]
                        place(doc, start, rest, n)
                    break

    held: list[tuple] = []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in range(4)]
        held.extend((d, s, np.frombuffer(x, "<u4"), n) for d, s, x, n in zip(*columns))
        while len(held) >= SHARD:
            shard(held[:SHARD])
            held = held[SHARD:]
            if rows:
                yield _pieces(rows, payload)
                rows.clear()
    if held:
        shard(held)
    # the open window ends as sequences whose lengths are powers of two, which need no padding
    left, fill = state["fill"], 0
    limits = [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1]
    for doc, start, ids, n, seq, _ in open_rows:
        while len(ids):
            take = min(len(ids), limits[0] - fill)
            rows.append((doc, start, ids[:take], n, seq if len(limits) == left.bit_count() else state["seq"], fill))
            start, ids, fill = start + take, ids[take:], fill + take
            if fill == limits[0]:
                limits, fill = limits[1:], 0
                state["seq"] = next(number)
    if rows:
        yield _pieces(rows, payload)


def pack(docs: DataFrame, path: str, window: int = 1024, ids: bool = False) -> DataFrame:
    """Every piece of every document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    docs: doc_id, text; other columns are ignored. A document's ids are the tokenizer's for its text, then id
    0; a null text is empty and has that id alone. Every row of docs is a document, repeated ones too; a null
    doc_id is kept. `start` counts the document's ids before the piece, `offset` the sequence's. A sequence is
    full, or has a power of two of ids: nothing is padded. `ids` adds the ids themselves (little-endian,
    32 bits). An empty table gives no rows. Broadcast: one weight and one place a vocabulary entry.
    """
    spark = docs.sparkSession
    table = f"kind int, {PIECE}, ids binary"
    with Scratch(spark) as scratch:
        raw = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lambda b: _tokenise(b, path, window, ids), table)
        cut = scratch.table(raw, "cut")
        stats = cut.where("kind = 2")
        many, total = stats.agg(F.sum("doc_id"), F.sum("start")).first()
        many, total = many or 0, total or 0
        size = id_encoder(path).size
        df = np.zeros(size, np.int64)
        for term, count in stats.select("ids").mapInArrow(_frequencies, "term long, df long").groupBy("term").agg(F.sum("df")).collect():
            df[term] = count  # at most one row a vocabulary entry
        idf = spark.sparkContext.broadcast(np.log1p((many - df + 0.5) / (df + 0.5)))
        mean = total / many if many else 1.0
        place = spark.sparkContext.broadcast(ranks(df, many))
        tails = cut.where("kind = 1").select("doc_id", "start", "ids", "doc_tokens")
        tails = tails.mapInArrow(lambda b: _marked(b, place), "doc_id long, start long, ids binary, doc_tokens long, mark long")
        tails = tails.repartitionByRange("mark", "doc_id", "start").sortWithinPartitions("mark", "doc_id", "start").drop("mark")
        fields = PIECE + ", ids binary" * ids
        packed = tails.mapInArrow(lambda b: _pack(b, window, idf, mean, ids), fields)
        full = cut.where("kind = 0").select(*FIELDS, *["ids"] * ids)
        return scratch.result(full.unionByName(packed))
