from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestream.llm import chat, ogg
from odd import documents, nothing, stored


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=3000), st.integers(0, 60_000))
def test_round_trip(data, more):
    payload = ogg.payload_of(data + bytes(more))
    assert ogg.samples(ogg.encode(payload)) == payload


def slow_checksum(page):
    crc = 0
    for byte in page:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc >> 31 else 0)) & 0xFFFFFFFF
    return crc


def test_checksum():
    for size in (0, 1, 27, 4000):
        data = np.random.default_rng(size).bytes(size)
        assert ogg.checksum(data) == slow_checksum(data)


def test_long_packets_run_over_pages():
    writer = ogg.Writer(9)
    packets = [(bytes([i]) * n, i + 1) for i, n in enumerate((255, 0, 70_000, 255 * 255, 3))]
    streams, bad = ogg.decode(b"".join(writer.pages(packets, ogg.LAST)))
    assert not bad and [p[0] for p in streams[9].packets] == [p[0] for p in packets]
    assert streams[9].packets[-1][1] == 5 and streams[9].ended


def test_times_come_from_granules():
    payload = np.random.default_rng(1).bytes(ogg.PACKET * 9 + 64)
    streams, _ = ogg.decode(ogg.encode(payload))
    assert len(streams) == ogg.STREAMS
    for s in streams.values():
        for first, end, data in ogg.timed(s):
            assert payload[first:end] == data


def test_damaged_pages_are_found():
    payload = np.random.default_rng(2).bytes(300_000)
    media = bytearray(ogg.encode(payload))
    media[len(media) // 2] ^= 1
    streams, bad = ogg.decode(bytes(media))
    assert bad >= 1 and sum(s.lost for s in streams.values()) >= 1
    for s in streams.values():
        for first, end, data in ogg.timed(s):
            assert payload[first:end] == data or len(data) != end - first
    with pytest.raises(ValueError):
        ogg.samples(bytes(media))
    assert ogg.decode(b"no page at all") == ({}, 0)


def test_media_features(spark, sf_dir):
    for docs in (stored(spark, sf_dir), documents(spark)):
        got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in ogg.media_features(docs).collect())
        want = []
        for r in docs.collect():
            raw = (r.text or "").encode()
            p = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
            want.append((r.doc_id is None, r.doc_id or 0, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
        assert got == sorted(want)
    assert ogg.media_features(nothing(spark)).count() == 0


def test_columns(spark):
    df = spark.createDataFrame([("a", b"abc" * 5000), ("b", None)], "key string, data binary")
    out = ogg.packets(ogg.to_ogg(df, F.col("data")), "key").collect()
    parts = sorted((r.first_sample, bytes(r.data)) for r in out if r.key == "a")
    assert b"".join(p[1] for p in parts) == b"abc" * 5000
    assert all(r.seconds == r.first_sample / ogg.RATE for r in out)


MESSAGES = [
    (1, 0, "user", "How do I sort a list?\n\nAnd keep it stable?"),
    (1, 1, "assistant", "Use sorted()."),
    (1, 2, "user", "> Use sorted().\nThanks, and in reverse?"),
    (1, 3, "assistant", ">> Use sorted().\n> thanks,  and in REVERSE?\nPass reverse=True."),
    (1, 4, "user", "> And keep it stable?\nIs it?"),
    (1, 5, "user", "> nobody said this\nhm"),
    (2, 0, None, None),
    (2, 0, None, None),
    (2, 1, "user", "> Use sorted().\nfrom another conversation"),
    (None, 3, "user", "> x\nlost"),
    (3, None, "user", "no turn"),
    (4, 0, "user", "> > nested\n> outer\n"),
]


def messages(spark, rows=MESSAGES):
    return spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, thread string").repartition(3)


def test_quotes_are_linked(spark):
    out = chat.reply_ordered(messages(spark)).collect()
    assert len(out) == len(MESSAGES)
    first = {r.turn: r for r in out if r.conv_id == 1}
    assert {t: r.reply_to for t, r in first.items()} == {0: None, 1: None, 2: 1, 3: 2, 4: 0, 5: None}
    assert first[3].text == "Pass reverse=True." and first[4].text == "Is it?"
    order = [r.turn for r in sorted(first.values(), key=lambda r: r.position)]
    assert order == [0, 4, 1, 2, 3, 5] and [first[t].position for t in order] == list(range(6))
    other = [r for r in out if r.conv_id == 2]
    assert sorted(r.position for r in other) == [0, 1, 2] and all(r.reply_to is None for r in other)
    assert {r.role for r in other} == {"user"}
    assert chat.reply_ordered(messages(spark, [])).count() == 0


def test_levels():
    assert chat.levels("> > a\n>b\nc\n  > d") == [(2, "a"), (1, "b"), (0, "c"), (1, "d")]
    assert chat.own_text("> q\n\nmine\n> r") == "mine"


def test_assembled(spark):
    parts = chat.assemble(chat.reply_ordered(messages(spark)), chunk=4).where("conv_id = 1").orderBy("part").collect()
    assert [p.messages for p in parts] == [4, 2]
    assert parts[0].text.startswith("<|user|>\nHow do I sort")


def test_against_plain_python(spark, sf_dir):
    table = stored(spark, sf_dir, "conversations")
    got = {(r.conv_id, r.turn): r.reply_to for r in chat.reply_ordered(table).collect()}
    own, want = {}, {}
    for r in table.orderBy("conv_id", "turn").collect():
        found = []
        for level, part in set(chat.passages(r.text or "")):
            if level == 0:
                own.setdefault((r.conv_id, part), r.turn)
            elif (t := own.get((r.conv_id, part))) is not None and t < r.turn:
                found.append((level, t, len(part)))
        sums = {}
        for level, t, n in found:
            sums[level, t] = sums.get((level, t), 0) + n
        want[r.conv_id, r.turn] = max(((-level, n, t) for (level, t), n in sums.items()), default=(0, 0, None))[2]
    assert got == want


def plainly(rows):
    """reply_to of each message by its own reading of quotes, message against message."""

    def depth(line):
        n = 0
        while (line := line.lstrip(" ")).startswith(">"):
            n, line = n + 1, line[1:]
        return n, line

    def parts(lines):
        """The whole, its paragraphs and its lines, without case and blanks."""
        out, paragraph = [lines, *([x] for x in lines)], []
        for line in [*lines, ""]:
            if line.split():
                paragraph.append(line)
            elif paragraph:
                out.append(paragraph)
                paragraph = []
        return {" ".join(" ".join(p).lower().split()) for p in out} - {""}

    said, quoted = {}, {}
    for conv, turn, text in rows:
        lines = [depth(x) for x in text.split("\n")]
        said.setdefault((conv, turn), set()).update(parts([x for n, x in lines if not n]))
        now = []
        for n, x in [*lines, (-1, "")]:
            if now and n != now[0][0]:
                if now[0][0]:
                    quoted.setdefault((conv, turn), set()).update((now[0][0], p) for p in parts([x for _, x in now]))
                now = []
            now.append((n, x))
    turns = {}
    for conv, turn in sorted(said):
        turns.setdefault(conv, []).append(turn)
    out = {}
    for conv, turn in said:
        sums = {}
        for level, part in quoted.get((conv, turn), ()):
            first = next((t for t in turns[conv] if part in said[conv, t]), None)
            if first is not None and first < turn:
                sums[level, first] = sums.get((level, first), 0) + len(part)
        out[conv, turn] = max(((-level, n, t) for (level, t), n in sums.items()), default=(0, 0, None))[2]
    return out


def test_quoting_conversations_against_plain_python(spark, sf_dir):
    table = stored(spark, sf_dir, "conversations")
    quoting = chat.quoting(table)
    before = {(r.conv_id, r.turn): r.text for r in table.collect()}
    out = chat.reply_ordered(quoting).collect()
    assert len(out) == table.count() and {(r.conv_id, r.turn): r.text for r in out} == before  # quotes are gone again
    want = plainly([(r.conv_id, r.turn, r.text) for r in quoting.collect()])
    assert {(r.conv_id, r.turn): r.reply_to for r in out} == want
    assert sum(t is not None for t in want.values()) > 0.9 * sum(turn > 0 for _, turn in want)


def test_quoting_odd_rows(spark):
    rows = [(1, 0, "user", "a\r\nb"), (1, 1, None, None), (1, 2, "user", "c"), (None, 1, "user", "d"), (2, None, None, "e"), (1, 2, "user", "c")]
    out = sorted((r.text for r in chat.quoting(messages(spark, rows)).collect()))
    assert out == sorted(["a\r\nb", "> a\r\n> b\n", "> > a\r\n> > b\n> \nc", "> > a\r\n> > b\n> \nc", "d", "e"])
    assert chat.quoting(messages(spark, [])).count() == 0


def test_a_wrapped_part_of_a_message_is_found(spark):
    original = "first words\n\nthe second paragraph of it is one long line\n\nthe third one\n\nlast"
    rows = [(1, 0, "user", original), (1, 1, "user", "> the second paragraph\n> of it is one long line\n>\n> the third\n> one\nyes")]
    assert [(r.turn, r.reply_to) for r in chat.replies(messages(spark, rows)).collect()] == [(1, 0)]


def test_one_long_conversation_and_one_long_text(spark):
    rows = [(1, i, "user", f"> m{i - 1}\nm{i}") for i in range(300)] + [(2, 0, "user", "line\n" * 50_000), (2, 1, "user", "> line\n" * 50_000 + "end")]
    rows += [(None, None, "user", "> who")] * 500
    out = chat.reply_ordered(messages(spark, rows))
    one = {r.turn: r for r in out.where("conv_id = 1").collect()}
    assert all(one[i].reply_to == i - 1 and one[i].position == i and one[i].text == f"m{i}" for i in range(1, 300))
    assert {r.turn: (r.reply_to, r.text[:3]) for r in out.where("conv_id = 2").collect()} == {0: (None, "lin"), 1: (0, "end")}
    assert sorted(r.position for r in out.where("conv_id is null").collect()) == list(range(500))
