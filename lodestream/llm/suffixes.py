"""Passages that repeat across documents, found through sparse suffix arrays.

Of the suffixes of a document (its words from some word on) only those at minimisers are kept: in every run of
`least` words, the place whose next PREFIX words hash lowest. Equal runs select the same place, so a suffix owns the
runs that selected it, and they reach from some words to its left to some words to its right.

1. Suffixes are range-sorted by a hash of their first PREFIX words; one whose neighbours are all of its own document
   is dropped.
2. What is left gets its words, to the right and, backwards, to the left, as far as the runs that it owns. They are
   range-sorted by those words (a byte below all others stands between two): the suffix array. Equal ones stand together, their smallest document first, and
   the others repeat it. Distinct neighbours are compared word by word: the match is extended to the right and to the
   left, and decides the runs that it covers. Words that a suffix shares with neither neighbour it shares
   with none: runs that would need more of them are dropped.
3. Runs still open, which may match a suffix further off, are range-sorted by a 128-bit hash of their words; the
   first document of a run keeps it, the others repeat it.

Each sort deals by ranges that end with the document, so that a passage or line that very many documents share is
spread over tasks; what the ends of a range cannot see is kept for the next step, or settled by a join of the ranges'
ends. The result is exact: a word is repeated if it lies in a run of `least` words that a document with a smaller id
has, too. A passage is remembered by the id and a hash of the text that it stands in, so that rows which repeat an id count as one
document, but each text loses its own passages only. Only two runs with one 128-bit hash would be confused: among 1e13 runs with a chance below 2e-13.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SMALL_IDS, Scratch, broadcast_if_small, cache_of, fresh, text_batches

#: Words by which suffixes are first sorted.
PREFIX = 16
#: Words in a passage that counts as repeated.
LEAST = 50
#: An odd base of polynomial hashes modulo 2**64, and its inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Words whose hashes a worker remembers.
REMEMBERED = 200_000
#: Rows in a batch that goes back to Spark.
BATCH = 4096

_words: dict[bytes, int] = {}
_powers = {"down": np.ones(1, np.uint64), "up": np.ones(1, np.uint64)}


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash for each word."""
    if len(_words) > REMEMBERED:
        _words.clear()
    for w in [w for w in set(words) if w not in _words]:
        _words[w] = xxhash.xxh64_intdigest(w)
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def _power(base: int, kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        steps = np.full(max(n, 4096), base, np.uint64)
        steps[0] = 1
        _powers[kind] = np.multiply.accumulate(steps)
    return _powers[kind][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def starts_of(words: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the runs of `length` words from every place, from one running sum."""
    n = len(words)
    total = np.r_[np.uint64(0), np.cumsum(words * _power(INVERSE, "down", n), dtype=np.uint64)]
    at = np.arange(n - length + 1)
    return mixed((total[at + length] - total[at]) * _power(BASE, "up", n)[at])


def selected(words: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The kept places, the first and last start of the runs that each owns, and the hash of its first words."""
    prefix = min(PREFIX, least)
    hashes = starts_of(word_hashes(words), prefix)
    window = np.lib.stride_tricks.sliding_window_view(hashes, least - prefix + 1)
    place, first = np.unique(np.arange(len(window)) + window.argmin(axis=1), return_index=True)
    return place, first, np.r_[first[1:], len(window)] - 1, hashes[place]


#: What stands between the words of a key: no word has a smaller byte, so keys are in the order of their words.
GAP = b"\0"


def split_words(text: bytes | None) -> list[bytes]:
    """The words of a text, with A-Z in lower case. Byte 0 becomes 9, which no word has."""
    words = (text or b"").lower().split()
    return [w.replace(b"\0", b"\t") for w in words] if text and b"\0" in text else words


def joined(words: list[bytes]) -> bytes:
    return GAP.join(words)


def parted(key: bytes) -> list[bytes]:
    return key.split(GAP) if key else []


def _suffixes(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    cache_of("suffixes")
    for batch in batches:
        for s in range(0, batch.num_rows, 512):
            part = batch.slice(s, 512)
            keys, docs, marks, places = [], [], [], []
            for doc, mark, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).cast(pa.binary()).to_pylist()):
                words = split_words(text)
                if len(words) >= least:
                    at, _, _, hashes = selected(words, least)
                    keys.append(hashes)
                    places.append(at)
                    docs.append(np.full(len(at), doc))
                    marks.append(np.full(len(at), mark))
            if docs:
                columns = [np.concatenate(keys).view(np.int64), np.concatenate(docs), np.concatenate(marks), np.concatenate(places).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "doc_id", "mark", "place"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key and document those whose key another document has, too.

    The first and the last key of a range stay whatever they are: the range before or after may have them.
    """
    held: list[np.ndarray] = []
    first = True

    def kept(cols: list[np.ndarray], all_of_last: bool) -> pa.RecordBatch:
        nonlocal first
        key, doc, mark, place = cols
        new = np.r_[True, key[1:] != key[:-1]]
        group = np.cumsum(new) - 1
        start = np.flatnonzero(new)
        many = np.maximum.reduceat(doc, start) > np.minimum.reduceat(doc, start)
        many[0] |= first
        many[-1] |= all_of_last
        first = False
        keep = many[group]
        return pa.RecordBatch.from_arrays([pa.array(doc[keep]), pa.array(mark[keep]), pa.array(place[keep])], ["doc_id", "mark", "place"])

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(c).to_numpy() for c in range(4)]
        held = [np.concatenate([a, b]) for a, b in zip(held, cols)] if held else cols
        key, doc = held[:2]
        last = int(np.searchsorted(key, key[-1]))
        if last:
            yield kept([c[:last] for c in held], False)
            held = [c[last:] for c in held]
        elif len(key) > BATCH and doc[-1] > doc[0]:  # a long run of one key is known to be shared, by the row that stays held
            yield kept([c[:-1] for c in held], True)
            held, first = [c[-1:] for c in held], True
    if held:
        yield kept(held, True)


CONTEXT = "right binary, left binary, doc_id long, mark long, place int, before int, after int"


def _contexts(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The words to the right of each kept suffix and, backwards, to its left, as far as the runs that it owns.

    Runs begin `after` to `before` words to the left of the place.
    """
    kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
    names = ["right", "left", "doc_id", "mark", "place", "before", "after"]
    for batch in batches:
        for s in range(0, batch.num_rows, 64):
            part = batch.slice(s, 64)
            rows = []
            for doc, mark, text, kept in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).cast(pa.binary()).to_pylist(), part.column(3)):
                words = split_words(text)
                if len(words) < least:
                    continue
                place, low, high, _ = selected(words, least)
                own = np.isin(place, kept.values.to_numpy())
                for p, a, b in zip(place[own].tolist(), low[own].tolist(), high[own].tolist()):
                    rows.append((joined(words[p : b + least]), joined(words[a:p][::-1]), doc, mark, p, p - a, p - b))
            for at in range(0, len(rows), BATCH):
                some = rows[at : at + BATCH]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in some], k) for i, k in enumerate(kinds)], names)


def common_words(a: bytes, b: bytes) -> int:
    """How many whole words two texts have in common at their beginnings."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    same = n - -(-differ.bit_length() // 8)
    if same == n and n and (len(a) == n or a[n : n + 1] == GAP) and (len(b) == n or b[n : n + 1] == GAP):
        return a.count(GAP, 0, n) + 1
    return a.count(GAP, 0, same)


FOUND = "kind int, doc_id long, mark long, first int, last int, h1 long, h2 long"
FOUND_NAMES = ["kind", "doc_id", "mark", "first", "last", "h1", "h2"]
#: Kinds of rows: repeated runs from the starts first to last; an open run at first; the end of a range of runs.
REPEATED, OPEN, END = 0, 1, 2


def _found(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], FOUND_NAMES)


def _matched(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Decides runs by the neighbours in the suffix array; hashes those that are left open."""
    out: list[tuple] = []

    def close(group: dict, next_words: int) -> None:
        """The suffixes of the group's first document: what no neighbour decided is open."""
        widest = max(group["words"], next_words)
        for mark, place, before, after in group["places"]:
            done = np.zeros(before - after + 1, bool)  # by words between the run's start and the place, from `after`
            for low, high in group["decided"]:
                low, high = max(low, after), min(high, before)
                if low <= high:
                    done[low - after : high - after + 1] = True
                    out.append((REPEATED, group["doc"], mark, place - high, place - low, None, None))
            left = [a for a in range(max(after, least - widest), before + 1) if not done[a - after]]
            if not left:
                continue
            words = parted(group["left"])[::-1] + parted(group["right"])
            text = joined(words)
            ends = np.cumsum([len(w) + 1 for w in words])
            begins = ends - [len(w) + 1 for w in words]
            for a in left:
                s = before - a
                digest = xxhash.xxh3_128_digest(text[begins[s] : ends[s + least - 1] - 1])
                out.append((OPEN, group["doc"], mark, place - a, None, int.from_bytes(digest[:8], signed=True), int.from_bytes(digest[8:], signed=True)))

    group = None
    for batch in batches:
        for right, left, doc, mark, place, before, after in zip(*(batch.column(c).to_pylist() for c in range(7))):
            if group is not None and right == group["right"] and left == group["left"]:
                if doc == group["doc"]:
                    group["places"].append((mark, place, before, after))
                else:
                    out.append((REPEATED, doc, mark, place - before, place - after, None, None))
                continue
            new = {"right": right, "left": left, "doc": doc, "places": [(mark, place, before, after)], "decided": [], "words": least}
            if group is not None:
                r, l = common_words(right, group["right"]), common_words(left, group["left"])  # noqa: E741
                new["words"] = r
                if r + l >= least and doc != group["doc"]:
                    (new if doc > group["doc"] else group)["decided"].append((least - r, l))
                close(group, r)
            group = new
        if len(out) >= BATCH:
            yield _found(out)
            out.clear()
    if group is not None:
        close(group, least)  # what comes in the next range is not known
    if out:
        yield _found(out)


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of runs sorted by hash, document and start those that a smaller document of the same range has, too.

    The smallest document of the range's first run may have a smaller one in a range before: it stays open. The
    first and last run of the range, with their smallest document here, are its ends.
    """
    run = least = None
    in_first = True
    for batch in batches:
        out: list[tuple] = []
        for h1, h2, doc, mark, start in zip(*(batch.column(c).to_pylist() for c in range(5))):
            if (h1, h2) != run:
                if run is None:
                    out.append((END, doc, mark, TaskContext.get().partitionId(), None, h1, h2))
                else:
                    in_first = False
                run, least = (h1, h2), doc
            if doc > least:
                out.append((REPEATED, doc, mark, start, start, None, None))
            elif in_first:
                out.append((OPEN, doc, mark, start, TaskContext.get().partitionId(), h1, h2))
        if out:
            yield _found(out)
    if run is not None and not in_first:
        yield _found([(END, least, None, TaskContext.get().partitionId(), None, *run)])


def _spans(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Joins the starts of each document's repeated runs to spans of words."""
    kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        rows = []
        for runs in batch.column(2).to_pylist():
            spans: list[dict] = []
            for r in sorted(runs, key=lambda r: r["first"]):
                if spans and r["first"] <= spans[-1]["end"]:
                    spans[-1]["end"] = max(spans[-1]["end"], r["last"] + least)
                else:
                    spans.append({"first": r["first"], "end": r["last"] + least})
            rows.append(spans)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, kind)], ["doc_id", "mark", "spans"])


def text_mark(text: Column) -> Column:
    """Tells the texts of one id from each other."""
    return F.xxhash64(text.cast("string"))


def repeated_passages(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, mark and spans (first word, end) of what documents with a smaller id have, too; no row without any.

    docs: doc_id, text; other columns are ignored. Words are separated by spaces and the controls 9-13, and
    compared with A-Z in lower case. mark is a hash of the text, and the spans are those of this text. Null and short texts have
    no passage, rows with a null doc_id take no part. Rows that repeat a doc_id count as one document: what they share
    among themselves is no repetition. An empty table gives no rows.
    """
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), text_mark(F.col("text")).alias("mark"), F.col("text").cast("string"))
    with Scratch(docs.sparkSession) as scratch:
        suffixes = scratch.table(texts.mapInArrow(lambda b: _suffixes(b, least), "key long, doc_id long, mark long, place int"), "suffixes")
        order = ["key", "doc_id", "mark", "place"]
        kept = suffixes.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_shared, "doc_id long, mark long, place int")
        kept = scratch.table(kept.groupBy("doc_id", "mark").agg(F.collect_list("place").alias("places")), "kept")
        scratch.drop("suffixes")
        both = texts.join(kept, ["doc_id", "mark"]).select("doc_id", "mark", "text", "places")
        array = scratch.table(both.mapInArrow(lambda b: _contexts(b, least), CONTEXT), "array")
        order = ["right", "left", "doc_id", "mark", "place"]
        ordered = array.repartitionByRange(*order).sortWithinPartitions(*order)
        matched = scratch.table(ordered.mapInArrow(lambda b: _matched(b, least), FOUND), "matched")
        scratch.drop("array")
        order = ["h1", "h2", "doc_id", "mark", "first"]
        runs = matched.where(F.col("kind") == OPEN).select(*order)
        decided = scratch.table(runs.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_later, FOUND), "decided")
        ends = decided.where(F.col("kind") == END).groupBy("h1", "h2").agg(F.min("doc_id").alias("least"))
        late = decided.where(F.col("kind") == OPEN).join(ends, ["h1", "h2"]).where("doc_id > least").select("doc_id", "mark", "first", F.col("first").alias("last"))
        every = late
        for part in (matched, decided):
            every = every.unionByName(part.where(F.col("kind") == REPEATED).select("doc_id", "mark", "first", "last"))
        spans = every.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
        return scratch.result(spans.mapInArrow(lambda b: _spans(b, least), "doc_id long, mark long, spans array<struct<first:int,end:int>>"))


WORDS = regex.compile(rb"[^\x20\x09-\x0D]+")


def without(text: bytes, spans: list[dict]) -> bytes:
    """The text without those words and the space after them."""
    begins = [m.start() for m in WORDS.finditer(text)] + [len(text)]
    out, at = [], 0
    for s in spans:
        if s["first"] < len(begins):
            out.append(text[at : begins[s["first"]]])
            at = begins[min(s["end"], len(begins) - 1)]
    return b"".join([*out, text[at:]])


def remove_repeats(docs: DataFrame, least: int = LEAST, names: tuple[str, str] = ("spans", "removed")) -> DataFrame:
    """`docs` with the repeated passages cut from the texts, and the columns spans and removed (words).

    Documents without any stay as they are, with no spans and 0, as do rows without an id; of rows that repeat an id each loses
    the passages of its own text. Further columns stay; those called like `names` are replaced.
    """
    text_batches(docs.sparkSession)
    doc, mark, cuts = fresh(docs, "doc"), fresh(docs, "mark"), fresh(docs, "cuts")
    spans = repeated_passages(docs, least).select(F.col("doc_id").alias(doc), F.col("mark").alias(mark), F.col("spans").alias(cuts))

    @F.arrow_udf("string")
    def cleaned(texts: pa.Array, cuts: pa.Array) -> pa.Array:
        found = []
        for s in range(0, len(texts), 256):  # few texts at a time are Python objects
            some = zip(texts.slice(s, 256).cast(pa.binary()).to_pylist(), cuts.slice(s, 256).to_pylist())
            found.append(pa.array([t if t is None or not c else without(t, c) for t, c in some], pa.binary()).cast(pa.string()))
        return pa.concat_arrays(found) if found else pa.array([], pa.string())

    numbers = spans.agg(F.sum(F.size(cuts) + 2)).first()[0] or 0  # spans, and two numbers a row
    spans = broadcast_if_small(spans, numbers, SMALL_IDS // 4)
    both = docs.join(spans, (F.col("doc_id").cast("long") == F.col(doc)) & (text_mark(F.col("text")) == F.col(mark)), "left")
    removed = F.aggregate(cuts, F.lit(0), lambda n, s: n + s["end"] - s["first"])
    text = cleaned(F.col("text").cast("string"), F.col(cuts))
    found = F.coalesce(cuts, F.array().cast("array<struct<first:int,end:int>>"))
    return both.withColumns({"text": text, names[0]: found, names[1]: F.coalesce(removed, F.lit(0))}).drop(doc, mark, cuts)
