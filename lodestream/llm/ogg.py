"""Media columns as Ogg: physical bitstreams of pages that carry the packets of several logical streams.

A page has a header, a table of lacing values and up to 255 segments. Its checksum is a CRC-32 with the
polynomial 0x04C11DB7, no reflection, and zero at start and end. A packet is the segments up to the first lacing
value below 255; it may run on over pages of its stream. The granule position of a page counts the samples up
to the last packet that ends in it, and so gives the packets' times.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_batches

# Fixed values of the format.
CAPTURE = b"OggS"
HEADER = struct.Struct("<4sBBqIIIB")  # capture, version, flags, granule, serial, page number, checksum, segments
CONTINUED, FIRST, LAST = 1, 2, 4
#: This module's own codec header: name, samples a second, number of the stream, streams.
CODEC = struct.Struct("<8sIHH")
NAME = b"pcm8mono"
RATE = 8000
#: Samples of a data packet, and streams that take packets in turn.
PACKET = 4096
STREAMS = 2

_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def checksum(page: bytes) -> int:
    """The page's CRC, by the reflected CRC of zlib over bytes with their bits reversed."""
    reflected = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(reflected.to_bytes(4, "little").translate(_REVERSED), "big")


def page(serial: int, number: int, granule: int, flags: int, lacing: bytes, body: bytes) -> bytes:
    head = HEADER.pack(CAPTURE, 0, flags, granule, serial, number, 0, len(lacing))
    whole = head + lacing + body
    return whole[:22] + struct.pack("<I", checksum(whole)) + whole[26:]


class Writer:
    """Pages of one logical stream."""

    def __init__(self, serial: int):
        self.serial, self.number = serial, 0

    def pages(self, packets: list[tuple[bytes, int]], flags: int = 0) -> Iterator[bytes]:
        """Pages of packets (bytes, granule at their end); the last page gets `flags` besides."""
        lacing, body, granule, begun = bytearray(), [], -1, False
        out = []
        for data, end in packets:
            values = b"\xff" * (len(data) // 255) + bytes([len(data) % 255])
            at = 0
            while values:
                room = 255 - len(lacing)
                part, values = values[:room], values[room:]
                lacing += part
                size = sum(part)
                body.append(data[at : at + size])
                at += size
                if not values:
                    granule = end
                if len(lacing) == 255:
                    out.append((bytes(lacing), b"".join(body), granule, begun))
                    lacing, body, granule, begun = bytearray(), [], -1, bool(values)
        if lacing:
            out.append((bytes(lacing), b"".join(body), granule, begun))
        for i, (values, data, at, cont) in enumerate(out):
            yield page(self.serial, self.number, at, cont * CONTINUED | (flags if i == len(out) - 1 else 0), values, data)
            self.number += 1


def encode(payload: bytes) -> bytes:
    """The payload's bytes as 8-bit samples, in packets that the streams take in turn.

    Serial numbers come from the payload's hash: equal payloads give equal files.
    """
    seed = zlib.crc32(payload)
    writers = [Writer((seed + i) & 0xFFFFFFFF) for i in range(STREAMS)]
    out = [x for i, w in enumerate(writers) for x in w.pages([(CODEC.pack(NAME, RATE, i, STREAMS), 0)], FIRST)]
    packets: list[list[tuple[bytes, int]]] = [[] for _ in writers]
    for n, at in enumerate(range(0, len(payload), PACKET)):
        data = payload[at : at + PACKET]
        packets[n % STREAMS].append((data, at + len(data)))  # a granule is the end in the whole recording
    bodies = [list(w.pages(p or [(b"", 0)], LAST)) for w, p in zip(writers, packets)]
    for i in range(max(map(len, bodies))):  # pages of the streams alternate
        out.extend(b[i] for b in bodies if i < len(b))
    return b"".join(out)


@dataclass
class Stream:
    """What was read of one logical stream. packets: bytes, end granule or None, and the page each ended in."""

    serial: int
    packets: list[tuple[bytes, int | None, int]] = field(default_factory=list)
    pages: int = 0
    lost: int = 0
    ended: bool = False
    rest: bytes | None = None
    expected: int | None = None


def decode(media: bytes) -> tuple[dict[int, Stream], int]:
    """The logical streams by serial number, and how many pages failed.

    A page with a wrong checksum, or cut off, is passed over and the next capture pattern sought; packets that
    lack a page are dropped whole.
    """
    streams: dict[int, Stream] = {}
    at, bad = media.find(CAPTURE), 0
    while at >= 0:
        good = False
        if at + HEADER.size <= len(media):
            _, version, flags, granule, serial, number, crc, count = HEADER.unpack_from(media, at)
            lacing = media[at + HEADER.size : at + HEADER.size + count]
            end = at + HEADER.size + count + sum(lacing)
            good = version == 0 and len(lacing) == count and end <= len(media) and checksum(media[at : at + 22] + bytes(4) + media[at + 26 : end]) == crc
        if not good:
            bad += 1
            at = media.find(CAPTURE, at + 1)
            continue
        s = streams.setdefault(serial, Stream(serial))
        gap = s.expected is not None and number != s.expected
        s.expected, s.pages, s.ended = number + 1, s.pages + 1, bool(flags & LAST)
        if gap or (s.rest is not None and not flags & CONTINUED):
            s.lost += s.rest is not None or gap
            s.rest = None
        part, skip = s.rest, bool(flags & CONTINUED) and s.rest is None
        pos, size, done = end - sum(lacing), 0, []
        for v in lacing:
            size += v
            if v < 255:
                if not skip:
                    done.append((part or b"") + media[pos : pos + size])
                part, skip = None, False
                pos, size = pos + size, 0
        s.rest = ((part or b"") + media[pos : pos + size] if not skip else None) if lacing and lacing[-1] == 255 else None
        s.packets.extend((d, granule if i == len(done) - 1 else None, number) for i, d in enumerate(done))
        at = end if media.startswith(CAPTURE, end) else media.find(CAPTURE, end)
    return streams, bad


def timed(stream: Stream) -> list[tuple[int, int, bytes]]:
    """(first sample, end sample, bytes) of the data packets of a stream written by `encode`.

    A page tells the end of its last packet; those before it are full and lie `streams` packets apart.
    """
    _, rate, _, streams = CODEC.unpack(stream.packets[0][0])
    out: list[tuple[int, int, bytes]] = []
    waiting: list[bytes] = []
    for data, granule, _ in stream.packets[1:]:
        waiting.append(data)
        if granule is not None:
            end = granule
            ends = []
            for d in reversed(waiting):
                ends.append((end - len(d), end, d))
                end -= len(d) + (streams - 1) * PACKET
            out.extend(x for x in reversed(ends) if x[2])
            waiting = []
    return out


def samples(media: bytes) -> bytes:
    """The recording: all streams' packets in the order of their times."""
    streams, bad = decode(media)
    if bad or any(s.lost for s in streams.values()):
        raise ValueError(f"{bad} pages failed")
    parts = sorted((x for s in streams.values() for x in timed(s)), key=lambda x: x[:2])
    return b"".join(x[2] for x in parts)


def payload_of(text: bytes) -> bytes:
    """The bytes, filled with bytes 0 up to a positive multiple of 64."""
    return text + bytes(-len(text) % 64 or (0 if text else 64))


def describe(media: bytes) -> str:
    """Features: streams, pages, packets, seconds, mean level, root mean square and crossings of the middle."""
    streams, _ = decode(media)
    x = np.frombuffer(samples(media), np.uint8).astype(np.int64) - 128
    packets = sum(len(s.packets) for s in streams.values())
    pages = sum(s.pages for s in streams.values())
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"streams={len(streams)} pages={pages} packets={packets} seconds={len(x) / RATE:.4f} mean={x.mean():.3f} rms={np.sqrt((x * x).mean()):.3f} crossings={crossings}"


# DataFrame operators.


def to_ogg(df: DataFrame, payload: Column, name: str = "media") -> DataFrame:
    """`df` with a binary column `name`: the Ogg file of the payload (binary; null counts as empty)."""

    text_batches(df.sparkSession)

    @F.arrow_udf("binary")
    def write(values: pa.Array) -> pa.Array:
        return pa.array([encode(v) for v in values.to_pylist()], pa.binary())

    return df.withColumn(name, write(F.coalesce(payload, F.lit(b""))))


def media_features(docs: DataFrame) -> DataFrame:
    """Whole texts stored as Ogg and read back; one row for each row of docs (doc_id, text).

    Columns: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32 (of the last 64 bytes), media_bytes,
    media_sha256, feature. Values of the payload are those of the bytes read back. A null text is empty: its
    payload is 64 bytes 0. Other columns are ignored, repeated rows and null ids keep their rows, an empty
    table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                rows = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()):
                    text = text or b""
                    media = encode(payload_of(text))
                    back = samples(media)
                    rows.append((doc, len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), describe(media)))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    text_batches(docs.sparkSession)
    kind = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, kind)


def packets(df: DataFrame, key: str, media: str = "media") -> DataFrame:
    """One row a data packet of every Ogg file: key, serial, number, first_sample, seconds, data.

    Damaged pages are passed over; a row with serial null tells how many (`number`). A null file has no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if blob is None:
                    continue
                streams, bad = decode(blob)
                if bad:
                    rows.append((k, None, bad, None, None, None))
                for s in streams.values():
                    rows.extend((k, s.serial, n, first, first / RATE, data) for n, (first, _, data) in enumerate(timed(s)))
            kinds = [batch.column(0).type, pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["key", "serial", "number", "first_sample", "seconds", "data"])

    text_batches(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    return df.select(key, media).mapInArrow(run, f"key {kind}, serial long, number long, first_sample long, seconds double, data binary").withColumnRenamed("key", key)
