"""Token ids in training order, as binary shards of a fixed stride.

The documents' ids are cut into sequences. A keyed Feistel network over the smallest even number of bits that
holds all of them, walked until it falls among them, gives each sequence its slot of the training order: a
permutation that needs no table, and that its key inverts. Shards are ranges of slots. Every record has the
same size, so a reader finds slot s at (s mod sequences) * stride of shard s div sequences, and a run that
stopped goes on from any slot by seeking.

A shard is written by Spark's text sink, whose commit survives lost tasks: a record is its raw bytes and a line
feed, which belongs to the stride.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if_small
from .tokens import id_encoder, together

ROUNDS = 6
#: Documents from which the compression of sequences learns, and bytes that it may take.
SAMPLE, DICTIONARY = 2000, 112_640
#: Sequences taken from the beginning of each of these.
BEGINNING = 8
#: Input partitions up to which their table of offsets is broadcast (16 bytes each).
SMALL_PARTS = 1_000_000


def _half(x: np.ndarray, key: int, mask: np.uint64) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (x ^ (x >> np.uint64(29))) & mask


def _keys(key: int) -> list[int]:
    return [zlib.crc32(f"{key}:{r}".encode()) | zlib.crc32(f"{r}:{key}".encode()) << 32 for r in range(ROUNDS)]


def permute(index: np.ndarray, total: int, key: int, inverse: bool = False) -> np.ndarray:
    """The slot of each index below `total`, or the index of each slot."""
    bits = max(1, -(-(total - 1).bit_length() // 2)) if total > 1 else 1
    mask, shift = np.uint64((1 << bits) - 1), np.uint64(bits)
    keys = _keys(key)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for k in reversed(keys) if inverse else keys:
            if inverse:
                left, right = right ^ _half(left, k, mask), left
            else:
                left, right = right, left ^ _half(right, k, mask)
        return left << shift | right

    out = once(index.astype(np.uint64))
    while (beyond := out >= total).any():  # cycle-walking
        out[beyond] = once(out[beyond])
    return out.astype(np.int64)


def _dictionary(shared: bytes | None) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(shared) if shared else None


def slot_of(index: Column, total: int, key: int, inverse: bool = False) -> Column:
    @F.arrow_udf("long")
    def permuted(values: pa.Array) -> pa.Array:
        return pa.array(permute(values.to_numpy(zero_copy_only=False), total, key, inverse))

    return permuted(index)


def compression(docs: DataFrame, path: str, length: int, width: int) -> zstandard.ZstdCompressionDict | None:
    """What sequences have in common, learned from the beginnings of some documents: it makes what is shuffled smaller, nothing else.

    Tasks cut the documents; at most SAMPLE * BEGINNING sequences reach the driver.
    """

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = id_encoder(path)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                ids = encoder.ids(text)[: BEGINNING * length].astype(f"<u{width}")
                yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary())], ["ids"])

    # the limit comes after the tasks' work: it takes rows of the first partitions, where one before it would shuffle texts of all
    rows = docs.select(F.col("text").cast("string")).mapInArrow(begin, "ids binary").limit(SAMPLE).collect()
    ids, step = b"".join(bytes(r[0]) for r in rows), length * width
    samples = [ids[i : i + step] for i in range(0, len(ids) - step + 1, step)]
    return zstandard.train_dictionary(DICTIONARY, samples) if len(samples) * step > 8 * DICTIONARY else None


def _sequences(batches: Iterator[pa.RecordBatch], path: str, length: int, width: int, shared) -> Iterator[pa.RecordBatch]:
    """This task's documents, one after the other, cut into sequences; the last is filled with id 0."""
    encoder, part = id_encoder(path), TaskContext.get().partitionId()
    pack = zstandard.ZstdCompressor(level=6, dict_data=_dictionary(shared))
    # what no full sequence has yet, and the document and place that it begins with
    rest, begin, n = np.empty(0, np.uint32), (None, 0), 0
    end = np.zeros(1, np.uint32)

    def rows(stream: np.ndarray, tokens: int, docs: pa.Array, starts: pa.Array) -> pa.RecordBatch:
        nonlocal n
        many = len(docs)
        cuts = stream[: many * length].reshape(many, length)
        crcs = [zlib.crc32(x) for x in cuts.astype("<u4")]
        blobs = [pack.compress(x) for x in cuts.astype(f"<u{width}")]
        numbers = pa.array(np.arange(n, n + many), pa.int64())
        n += many
        columns = [pa.array([part] * many, pa.int32()), numbers, pa.array([tokens] * many, pa.int32()), docs, starts, pa.array(crcs, pa.int64()), pa.array(blobs, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["part", "n", "tokens", "first_doc", "first_start", "ids_crc32", "blob"])

    for batch in together(batches):
        ids = [x for own in encoder.many(batch.column(1)) for x in (own, end)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)).reshape(-1, 2).sum(axis=1)
        # the batch's documents behind the one that `rest` begins with
        docs = pa.concat_arrays([pa.array(begin[:1], pa.int64()), batch.column(0)])
        at = np.concatenate([[0], len(rest) + np.cumsum(sizes) - sizes])
        skipped = np.zeros(len(at), np.int64)
        skipped[0] = begin[1]
        rest = np.concatenate([rest, *ids])
        many = len(rest) // length
        cut = np.arange(many + 1) * length
        of = np.searchsorted(at, cut, side="right") - 1
        starts = cut - at[of] + skipped[of]
        if many:
            yield rows(rest, length, docs.take(pa.array(of[:-1])), pa.array(starts[:-1]))
        begin, rest = (docs[int(of[-1])].as_py(), int(starts[-1])), rest[many * length :].copy()
    if len(rest):
        yield rows(np.concatenate([rest, np.zeros(length - len(rest), np.uint32)]), len(rest), pa.array(begin[:1], pa.int64()), pa.array(begin[1:], pa.int64()))


def write_shards(docs: DataFrame, tokenizer: str, target: str, length: int = 1024, per_shard: int = 4096, key: int = 7) -> DataFrame:
    """Writes `target`/shard=N and `target`.manifest; returns what each slot should hold.

    docs: doc_id, text; other columns are ignored. A document is its ids, then id 0; a null text is empty,
    repeated rows count each. Returned: slot, index (before the permutation), shard, offset (bytes), tokens (the
    rest of a task's last sequence is filled with id 0), first_doc and first_start (where it begins), ids_crc32.
    An empty table writes no shard. Each sequence is shuffled once; nothing is collected but a count a partition.
    """
    spark = docs.sparkSession
    width = 2 if id_encoder(tokenizer).size <= 1 << 16 else 4
    stride = length * width + 1
    learned = compression(docs, tokenizer, length, width)
    shared = learned.as_bytes() if learned else None
    with Scratch(spark) as scratch:
        raw = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
            lambda b: _sequences(b, tokenizer, length, width, shared), "part int, n long, tokens int, first_doc long, first_start long, ids_crc32 long, blob binary"
        )
        cut = scratch.table(raw, "sequences")
        counts = sorted(cut.groupBy("part").count().collect())
        total, offsets = 0, []
        for part, count in counts:
            offsets.append((part, total))
            total += count
        spark.createDataFrame([(total, length, width, stride, per_shard, key)], "sequences long, length int, width int, stride int, per_shard int, key long").coalesce(1).write.json(target + ".manifest")
        if not total:
            return spark.createDataFrame([], "slot long, index long, shard int, offset long, tokens int, first_doc long, first_start long, ids_crc32 long")
        at = broadcast_if_small(spark.createDataFrame(offsets, "part int, base long"), len(offsets), SMALL_PARTS)
        placed = cut.join(at, "part").withColumn("index", F.col("base") + F.col("n"))
        placed = placed.withColumn("slot", slot_of(F.col("index"), total, key)).withColumn("shard", F.floor(F.col("slot") / per_shard).cast("int"))

        @F.arrow_udf("binary")
        def unpacked(blobs: pa.Array) -> pa.Array:
            d = zstandard.ZstdDecompressor(dict_data=_dictionary(shared))
            return pa.array([d.decompress(x) for x in blobs.to_pylist()], pa.binary())

        dealt = placed.select("shard", "slot", "blob").repartitionById(-(-total // per_shard), F.col("shard"))
        # the sort comes last, so that the sink, which wants the rows by shard, doesn't sort them again
        ordered = dealt.select("shard", "slot", unpacked("blob").cast("string").alias("value")).sortWithinPartitions("shard", "slot")
        ordered.select("value", "shard").write.partitionBy("shard").text(target)
        offset = F.pmod(F.col("slot"), F.lit(per_shard)) * stride
        return scratch.result(placed.select("slot", "index", "shard", offset.alias("offset"), "tokens", "first_doc", "first_start", "ids_crc32"))


def _read(spark: SparkSession, target: str, first: int, end: int | None, column: str, of: Callable[[memoryview], object]) -> DataFrame:
    """slot, shard, offset and, as `column`, what `of` makes of the slot's bytes in the task that reads them."""
    plan = spark.read.schema("sequences long, length int, width int, stride int, per_shard int, key long").json(target + ".manifest").first()
    end = plan.sequences if end is None else min(end, plan.sequences)
    kind = f"slot long, shard int, offset long, {column}"
    if first >= end:
        return spark.createDataFrame([], kind)
    stride, per, size = plan.stride, plan.per_shard, plan.stride - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = memoryview(content.as_buffer())
                if len(data) % stride:
                    raise ValueError(f"shard {shard}: {len(data)} bytes are no multiple of {stride}")
                have = [s for s in range(shard * per, shard * per + len(data) // stride) if first <= s < end]
                for i in range(0, len(have), 1024):
                    some = have[i : i + 1024]
                    at = [(s - shard * per) * stride for s in some]
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([shard] * len(some), pa.int32()), pa.array(at, pa.int64()), pa.array([of(data[a : a + size]) for a in at])], ["slot", "shard", "offset", column.split()[0]])

    files = spark.read.format("binaryFile").load(target).where((F.col("shard") >= first // per) & (F.col("shard") <= (end - 1) // per))
    return files.select(F.col("shard").cast("int"), "content").mapInArrow(run, kind)


def read_slots(spark: SparkSession, target: str, first: int = 0, end: int | None = None) -> DataFrame:
    """slot, shard, offset and ids of the slots from `first` to before `end`, from the shards that hold them.

    Slots beyond the last are passed over; none left, and a target written from an empty table, give no rows. A shard
    that is no multiple of the stride, one cut short, is an error.
    """
    return _read(spark, target, first, end, "ids binary", bytes)


def training_order(docs: DataFrame, tokenizer: str, target: str, **options) -> DataFrame:
    """Writes the shards, reads them back, and returns each slot with `intact`: its ids are those that were cut.

    Nulls, empty texts, repeated rows and an empty table as in `write_shards`.
    """
    planned = write_shards(docs, tokenizer, target, **options)
    width = 2 if id_encoder(tokenizer).size <= 1 << 16 else 4

    if planned.isEmpty():
        return planned.withColumn("intact", F.lit(True))
    # the ids stay in the task that reads them: rows of theirs, and a second Python worker for their sums, take memory
    crc = lambda raw: zlib.crc32(np.frombuffer(raw, f"<u{width}").astype("<u4"))
    back = _read(docs.sparkSession, target, 0, None, "crc long", crc).select("slot", F.col("offset").alias("found"), "crc")
    joined = planned.join(back, "slot", "left")
    return joined.withColumn("intact", F.coalesce((F.col("crc") == F.col("ids_crc32")) & (F.col("found") == F.col("offset")), F.lit(False))).drop("crc", "found")
