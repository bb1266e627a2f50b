from __future__ import annotations

import random
import re

from lodestream.llm import suffixes
from odd import PASSAGE, documents, nothing, stored


def brute(docs, least):
    """Of each id and text the words in a run of `least` words that a document with a smaller id has, too."""
    first, out = {}, {}
    rows = sorted({(r.doc_id, r.text or "") for r in docs.collect() if r.doc_id is not None})
    split = lambda text: [w for w in re.split("[\x20\x09-\x0d]+", text.lower()) if w]
    for doc, text in rows:
        words = split(text)
        for i in range(len(words) - least + 1):
            first.setdefault(tuple(words[i : i + least]), doc)
    for doc, text in rows:
        words = split(text)
        hit = {j for i in range(len(words) - least + 1) if first[tuple(words[i : i + least])] < doc for j in range(i, i + least)}
        if hit:
            out[doc, text] = hit
    return out


def found(df, docs):
    marked = docs.where("doc_id is not null").select("doc_id", "text", suffixes.text_mark(docs["text"]).alias("mark")).distinct()
    rows = df.join(marked, ["doc_id", "mark"]).collect()
    return {(r.doc_id, r.text): {j for s in r.spans for j in range(s.first, s.end)} for r in rows}


def test_against_every_run(spark, sf_dir):
    for least in (50, 20, 7):
        docs = stored(spark, sf_dir)
        assert found(suffixes.repeated_passages(docs, least), docs) == brute(docs, least)


def test_odd_rows(spark):
    docs = documents(spark)
    assert found(suffixes.repeated_passages(docs), docs) == brute(docs, 50) != {}
    out = {r.doc_id: r for r in suffixes.remove_repeats(docs).where("doc_id = 7 or doc_id = 1").collect()}
    assert out[7].text == "before after" and out[7].removed == 80 and out[1].removed == 0 and out[1].spans == []
    every = suffixes.remove_repeats(docs)
    assert every.count() == docs.count() and set(every.columns) == set(docs.columns)
    assert suffixes.remove_repeats(nothing(spark)).count() == 0


def test_clean_texts_stay_byte_for_byte(spark):
    texts = ["a\x0bb  c\n", "ü " + PASSAGE + "\n\n", None, ""]
    docs = documents(spark, [(i, t, "a") for i, t in enumerate(texts)])
    assert {r.doc_id: r.text for r in suffixes.remove_repeats(docs).collect()} == dict(enumerate(texts))


def test_a_match_is_extended_both_ways(spark):
    words = [f"x{i}" for i in range(300)]
    rows = [(1, " ".join(words), "a"), (2, " ".join(["p"] * 9 + words[40:200] + ["q"] * 9), "a"), (3, " ".join(words[100:149] + ["r"]), "a")]
    spans = {r.doc_id: [tuple(s) for s in r.spans] for r in suffixes.repeated_passages(documents(spark, rows)).collect()}
    assert spans == {2: [(9, 169)]}  # 49 words in common are too few


def test_periodic_texts(spark):
    rows = [(i, " ".join(["tick tock"] * (40 + i)), "a") for i in range(5)]
    docs = documents(spark, rows)
    assert found(suffixes.repeated_passages(docs), docs) == brute(docs, 50)


def test_words_with_control_characters(spark):
    """The order of the suffix array is one of words: a word may hold bytes below the space that parts words."""
    for seed in range(4):
        rnd = random.Random(seed)
        passage = [rnd.choice("abcdefgh") * rnd.randint(1, 3) + str(i) for i in range(50)]
        other = passage[:-1] + [passage[-1] + chr(rnd.choice([1, 2, 8, 14, 31]))]
        rows = [(1, " ".join([f"p{i}" for i in range(30)] + passage + [f"q{i}" for i in range(9)]), "a"), (2, " ".join(["r"] + passage + ["s"]), "a"), (3, " ".join(other * 2), "a"), (4, " ".join(["\x00"] + passage[:30] + ["\x00", "\x01\x00"] + passage[30:]), "a")]
        docs = documents(spark, rows)
        want = brute(docs, 50)
        assert found(suffixes.repeated_passages(docs), docs) == want and (2, rows[1][1]) in want


def test_random_words_of_few_letters(spark):
    rnd = random.Random(5)
    rows = [(rnd.randint(0, 60), " ".join(rnd.choice(["a", "a\x01", "\x00", "\x00\x02", "b", "\x1fa"]) for _ in range(rnd.randint(0, 60))), "a") for _ in range(150)]
    docs = documents(spark, rows)
    for least in (3, 6, 9):
        assert found(suffixes.repeated_passages(docs, least), docs) == brute(docs, least)


def test_texts_that_share_an_id_lose_their_own_passages_only(spark):
    unlike = " ".join(f"other{i}" for i in range(80))
    rows = [(1, PASSAGE, "a"), (2, PASSAGE, "a"), (2, unlike, "a"), (2, unlike, "b"), (None, PASSAGE, "a")]
    out = sorted((str(r.doc_id), r.text, r.removed) for r in suffixes.remove_repeats(documents(spark, rows), names=("spans", "removed")).collect())
    assert out == sorted([("1", PASSAGE, 0), ("2", "", 80), ("2", unlike, 0), ("2", unlike, 0), ("None", PASSAGE, 0)])
