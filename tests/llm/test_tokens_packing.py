from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestream.llm import packing, shards, tokens
from odd import PATH, documents, nothing, stored

LIBRARY = Tokenizer.from_file(PATH)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_counts(spark, sf_dir):
    for docs in (stored(spark, sf_dir), documents(spark)):
        got = sorted(((r.n_bytes, r.n_tokens, r.over_limit, r.doc_id is None, r.doc_id or 0) for r in tokens.token_counts(docs, PATH).collect()))
        want = sorted((len((r.text or "").encode()), n := len(ids_of(r.text)), n > 512, r.doc_id is None, r.doc_id or 0) for r in docs.collect())
        assert got == want
    assert tokens.token_counts(nothing(spark), PATH).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_ids_and_counts_of_any_text(text):
    assert ENGINE.ids(text).tolist() == ids_of(text)
    assert COUNTER.count([text]) == [len(ids_of(text))]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.none() | st.text() | st.text(st.sampled_from(" \n\t\xa0\u3000ab'é1.\x1c͸")) | st.sampled_from(["a <|endoftext|> b", " a", "a ", "a b\n\n", "it's it's"])))
def test_ids_of_many_texts(texts):
    assert [x.tolist() for x in ENGINE.many(pa.array(texts, pa.string()))] == [ids_of(t) for t in texts]


def test_packing_merges_a_word_once(monkeypatch):
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcdefgh"), 9)) for _ in range(50)]
    texts = [" ".join(rng.choice(words, 60)) for _ in range(400)]
    given = []

    class Engine:
        def encode_to_numpy(self, text, **options):
            given.append(text)
            return engine.encode_to_numpy(text, **options)

    engine, encoder = ENGINE.engine, tokens.Ids(PATH)
    encoder.engine = Engine()
    monkeypatch.setattr(packing, "id_encoder", lambda path: encoder)
    monkeypatch.setattr(packing, "_numbers", lambda: iter(range(10**6)))
    batches = [pa.RecordBatch.from_arrays([pa.array(range(s, s + 50)), pa.array(texts[s : s + 50])], ["doc_id", "text"]) for s in range(0, 400, 50)]
    cut = [r for b in packing._tokenise(iter(batches), PATH, 1024, False) for r in b.to_pylist()]
    assert {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in cut if r["kind"] == 1} == {i: [*ids_of(t), 0] for i, t in enumerate(texts)}
    assert sum(map(len, given)) < sum(map(len, texts)) / 10


def test_marks_are_the_first_three_places():
    rng = np.random.default_rng(7)
    tails = [rng.integers(0, 40, n).astype("<u4") for n in (1, 2, 3, 60, 500)] + [np.array([5, 5, 9], "<u4"), np.array([0], "<u4")]
    place = rng.permutation(40)
    columns = [pa.array(range(len(tails))), pa.array([0] * len(tails)), pa.array([t.tobytes() for t in tails]), pa.array([9] * len(tails))]
    batch = pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "ids", "doc_tokens"])
    got = [m for b in packing._marked(iter([batch, batch.slice(0, 0)]), type("Shared", (), {"value": place})) for m in b.column("mark").to_pylist()]
    firsts = [sorted({int(x) for x in place[t]})[:3] for t in tails]
    assert got == [(a[0] * 40 + a[min(1, len(a) - 1)]) * 40 + a[-1] for a in firsts]


ENGINE, COUNTER = tokens.Ids(PATH), tokens.Counter(PATH, tokens.whole_tokens(PATH))


def test_whole_tokens_are_proved():
    whole = tokens.whole_tokens(PATH)
    assert len(whole) > 40_000
    some = list(whole)[::997]
    assert all(ids_of(t) == [whole[t]] for t in some)


def test_remembers_a_bounded_number(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 5)
    texts = [f"zq{i}x vvk{i}" for i in range(300)]
    assert tokens.Counter(PATH, tokens.whole_tokens(PATH)).count(texts) == [len(ids_of(t)) for t in texts]


def check_pieces(docs, pieces, window=1024):
    want = defaultdict(list)
    for r in docs.collect():
        want[r.doc_id].append(tuple([*ids_of(r.text), 0]))
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4")
        assert len(ids) == p.length > 0 and zlib.crc32(p.ids) == p.ids_crc32
        by_sequence[p.sequence_id].append((p.offset, p.length))
        by_doc[p.doc_id].append((p.start, tuple(ids.tolist()), p.doc_tokens))
    padding = 0
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    assert padding == 0
    for doc, texts in want.items():
        assert sum(len(p[1]) for p in by_doc[doc]) == sum(map(len, texts))
        for text in set(texts):
            for start, ids, total in by_doc[doc]:
                if len(set(texts)) == 1:
                    assert total == len(text) and text[start : start + len(ids)] == ids
        if len(texts) == 1:
            assert sorted(p[0] for p in by_doc[doc]) == list(np.cumsum([0] + [len(p[1]) for p in sorted(by_doc[doc])])[:-1])


def test_packing_keeps_every_id(spark, sf_dir):
    for docs in (stored(spark, sf_dir), documents(spark)):
        check_pieces(docs, packing.pack(docs, PATH, ids=True).collect())
    assert packing.pack(nothing(spark), PATH).count() == 0


def test_a_shard_ranks_by_bm25():
    rng = np.random.default_rng(5)
    tails = [np.append(rng.zipf(1.3, rng.integers(1, 60)) % 300 + 1, 0).astype("<u4") for _ in range(120)] + [np.array([0], "<u4")] * 3
    idf, mean = rng.random(301), 30.0
    shard = packing.Shard(tails, idf, mean)
    assert (shard.row >= 0).any() and len(shard.of)  # lists of both kinds
    unused = rng.random(len(tails)) < 0.8
    for query in shard.own:
        score = []
        for ids in tails:
            tf = [np.count_nonzero(ids == t) for t in query]
            score.append(sum(idf[t] * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(ids) / mean)) for t, n in zip(query, tf) if n))
        got = list(shard.ranked(query, unused))
        assert sorted(got) == np.flatnonzero(unused).tolist() and np.allclose(shard.scores(query), score, rtol=1e-4)
        assert (np.diff(np.array(score)[got]) <= 1e-3).all()


def test_neighbours_share_windows(spark):
    topics = [[f"{t}{i}" for i in range(60)] for t in ("alpha", "beta", "gamma", "delta")]
    rng = np.random.default_rng(3)
    rows = [(n, " ".join(rng.choice(topics[n % 4], 70)), "a") for n in range(80)]
    pieces = packing.pack(documents(spark, rows).coalesce(1), PATH, window=1024).collect()
    windows = defaultdict(list)
    for p in pieces:
        windows[p.sequence_id].append(p.doc_id % 4)
    same = sum(max(map(w.count, set(w))) for w in windows.values()) / sum(map(len, windows.values()))
    assert same > 0.7


def test_neighbours_of_far_ids_share_windows(spark):
    rng = np.random.default_rng(4)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    topics = [["".join(rng.choice(letters, 7)) for _ in range(40)] for _ in range(200)]
    rows = [(n, " ".join(rng.choice(topics[n % 200], 50)), "a") for n in range(3000)]  # several shards; a topic's ids are 200 apart
    pieces = packing.pack(documents(spark, rows).coalesce(1), PATH, window=1024).collect()
    windows = defaultdict(list)
    for p in pieces:
        windows[p.sequence_id].append(p.doc_id % 200)
    same = sum(max(map(w.count, set(w))) for w in windows.values()) / sum(map(len, windows.values()))
    assert same > 0.75


@pytest.mark.parametrize("total", [1, 2, 3, 10, 257, 1000])
def test_feistel_is_a_permutation(total):
    index = np.arange(total)
    slots = shards.permute(index, total, 7)
    assert sorted(slots.tolist()) == index.tolist()
    assert shards.permute(slots, total, 7, inverse=True).tolist() == index.tolist()
    if total > 100:
        assert slots.tolist() != index.tolist() and shards.permute(index, total, 8).tolist() != slots.tolist()


def test_shards_hold_every_sequence(spark, sf_dir, tmp_path):
    docs = stored(spark, sf_dir)
    target = f"{tmp_path}/shards"
    rows = shards.training_order(docs, PATH, target, length=256, per_shard=100).collect()
    assert rows and all(r.intact for r in rows)
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    assert sum(r.tokens for r in rows) == sum(len(ids_of(r.text)) + 1 for r in docs.collect())
    some = shards.read_slots(spark, target, 90, 210).collect()
    assert sorted(r.slot for r in some) == list(range(90, 210))
    crc = {r.slot: r.ids_crc32 for r in rows}
    assert all(zlib.crc32(np.frombuffer(r.ids, "<u2").astype("<u4").tobytes()) == crc[r.slot] for r in some)


def test_shards_of_odd_rows(spark, tmp_path):
    rows = shards.training_order(documents(spark), PATH, f"{tmp_path}/odd", length=64, per_shard=10).collect()
    assert rows and all(r.intact for r in rows)
    assert shards.training_order(nothing(spark), PATH, f"{tmp_path}/none").count() == 0


def test_sequences_merge_a_word_once(monkeypatch):
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdefgh"), 9)) for _ in range(50)]
    texts = [" ".join(rng.choice(words, 60)) for _ in range(400)]
    texts[7:12], docs = [None, "", "a\n\n b ", "<|endoftext|> x", "\u0378"], [None, *range(1, 400)]
    given = []

    class Engine:
        def encode_to_numpy(self, text, **options):
            given.append(text)
            return engine.encode_to_numpy(text, **options)

    engine, encoder = ENGINE.engine, tokens.Ids(PATH)
    encoder.engine = Engine()
    monkeypatch.setattr(shards, "id_encoder", lambda path: encoder)
    monkeypatch.setattr(shards, "TaskContext", type("Task", (), {"get": classmethod(lambda cls: cls), "partitionId": staticmethod(lambda: 5)}))
    whole = pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(texts)], ["doc_id", "text"])
    stream = [(doc, at, i) for doc, text in zip(docs, texts) for at, i in enumerate([*ids_of(text), 0])]
    for together, length in ((1 << 20, 100), (1, 100), (1, 100_000), (1 << 20, len(stream)), (1, len(stream) // 2)):
        monkeypatch.setattr(tokens, "TOGETHER", together)
        monkeypatch.setattr(tokens, "ROWS", 3 if together == 1 else 256)
        given.clear()
        got = [r for b in shards._sequences(iter([whole.slice(0, 150), whole.slice(150)]), PATH, length, 2, None) for r in b.to_pylist()]
        assert together == 1 or sum(map(len, given)) < sum(len(t or "") for t in texts) / 10
        assert [r["n"] for r in got] == list(range(-(-len(stream) // length))) and {r["part"] for r in got} == {5}
        for r in got:
            own = stream[r["n"] * length :][:length]
            ids = np.array([i for *_, i in own] + [0] * (length - len(own)), "<u4")
            assert (r["first_doc"], r["first_start"], r["tokens"], r["ids_crc32"]) == (*own[0][:2], len(own), zlib.crc32(ids))
            assert shards.zstandard.ZstdDecompressor().decompress(r["blob"]) == ids.astype("<u2").tobytes()


def test_what_a_shard_holds_is_summed_where_it_is_read(spark, tmp_path):
    rows = shards.training_order(documents(spark), PATH, f"{tmp_path}/summed", length=64, per_shard=10)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan and "ids#" not in plan
    part = next((tmp_path / "summed").glob("shard=0/part-*"))
    held = bytearray(part.read_bytes())
    held[3 * (64 * 2 + 1)] ^= 1  # an id of slot 3
    part.write_bytes(held)
    next((tmp_path / "summed").glob("shard=0/.part-*.crc")).unlink()
    assert [r.slot for r in rows.collect() if not r.intact] == [3]


def slots_of(target, length, width):
    """What the shards hold, read byte by byte."""
    import json
    from pathlib import Path

    plan = json.loads(next(Path(target + ".manifest").glob("part-*.json")).read_text())
    out = {}
    for folder in Path(target).glob("shard=*"):
        data = b"".join(f.read_bytes() for f in sorted(folder.glob("part-*")))
        assert len(data) % plan["stride"] == 0
        for i in range(len(data) // plan["stride"]):
            raw = data[i * plan["stride"] : i * plan["stride"] + length * width]
            out[int(folder.name[6:]) * plan["per_shard"] + i] = [int.from_bytes(raw[j : j + width], "little") for j in range(0, len(raw), width)]
    return out


def test_training_order_against_the_library(spark, sf_dir, tmp_path):
    own = lambda t: [*ids_of(t), 0]
    docs = stored(spark, sf_dir).coalesce(1)
    rows = docs.collect()
    stream = [i for r in rows for i in own(r.text)]
    planned = {r.slot: r for r in shards.write_shards(docs, PATH, f"{tmp_path}/one", length=128, per_shard=32).collect()}
    held = slots_of(f"{tmp_path}/one", 128, 2)
    assert sorted(planned) == sorted(held) == list(range(-(-len(stream) // 128))) and sorted(r["index"] for r in planned.values()) == sorted(planned)
    starts, at = {}, 0
    for r in rows:
        starts.update((at + i, (r.doc_id, i)) for i in range(len(own(r.text))))
        at += len(own(r.text))
    for slot, r in planned.items():
        part = stream[r["index"] * 128 : r["index"] * 128 + 128]
        assert held[slot] == part + [0] * (128 - len(part)) and r.tokens == len(part)
        assert (r.first_doc, r.first_start) == starts[r["index"] * 128] and (r.shard, r.offset) == (slot // 32, slot % 32 * (128 * 2 + 1))
    assert [r["index"] for _, r in sorted(planned.items())] != sorted(r["index"] for r in planned.values())
    many = stored(spark, sf_dir).repartition(5)
    planned = shards.write_shards(many, PATH, f"{tmp_path}/many", length=128, per_shard=32).collect()
    held = slots_of(f"{tmp_path}/many", 128, 2)
    ids = {r.doc_id: own(r.text) for r in rows}
    left = sorted(i for x in ids.values() for i in x)
    assert sorted(i for r in planned for i in held[r.slot][: r.tokens]) == left
    for r in planned:
        begin = ids[r.first_doc][r.first_start :][: r.tokens]
        assert held[r.slot][: len(begin)] == begin
