from __future__ import annotations

import random
import zlib

import pytest
from pyspark.sql import functions as F

from lodestream.llm import toxicity
from odd import documents, nothing, stored


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_against_distances():
    terms = {"idiot": 2.0, "moron": 1.0, "imbecile": 3.0, "rat": 0.5}
    lexicon = toxicity.Lexicon(terms)
    words = ["idiot", "idiiot", "idot", "idi0t", "ixxot", "imbecil", "imbezile", "mbecle", "moronic", "rat", "rats", "brat", "", "a", "morons", "nothing", "imbeciless"]
    for w in words:
        near = [(distance(w, t), -x) for t, x in terms.items() if distance(w, t) <= toxicity.edits(len(t))]
        best = min(near, default=None)
        assert lexicon.match(w) == (best and (-best[1], best[0])), w


def test_stems():
    lexicon = toxicity.Lexicon({"stupid*": 1.5})
    assert lexicon.match("stupidity") == lexicon.match("stupid") == (1.5, 0)
    assert lexicon.match("stupd") is None and lexicon.match("unstupid") is None


def test_quotation_is_told_from_abuse():
    lexicon = toxicity.Lexicon({"idiot": 2.0})
    plain, quoted, said, directed = (toxicity.features(t, lexicon) for t in ("an idiot here", 'wrote "what an idiot" then', "she said idiot", "you are an idiot"))
    assert plain[3] == plain[4] == 0 and quoted[3] > 0 and said[3] > 0 and directed[4] > 0 and directed[3] == 0


def planted(spark, insults, toxic, calm):
    """Documents of invented words, `toxic` of them with one insult each, and their labels."""
    rng = random.Random(6)
    plain = ["".join(rng.choices("aeioulnst", k=rng.randint(3, 9))) for _ in range(300)]
    rows = [(n, " ".join([*rng.choices(plain, k=20), insults[n % len(insults)] if n < toxic else "", *rng.choices(plain, k=10)]), int(n < toxic)) for n in range(toxic + calm)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), plain


def test_misspelled_learned_terms_are_found(spark):
    insults = ["grumbkopf", "vermhund", "drexwurm", "blorg"]
    training = [*insults * 6, "grumbkpof", "vermhnud", "drexwrum", "blxorg"]
    docs, labels, plain = planted(spark, training, 560, 840)
    terms, model = toxicity.train(docs, labels)
    assert {*insults, "grum*", "verm*", "drex*"} <= set(terms) and "grumb*" not in terms
    lexicon = toxicity.Lexicon(terms)
    wrong = ["rgumbkopf", "gumbkopf", "gxumbkopf", "evrmhund", "vrmhund", "vexmhund", "rdexwurm", "dexwurm", "dxexwurm", "borg", "bloxg"]
    for w in wrong:
        assert lexicon.match(w)[1] > 0, w
    texts = spark.createDataFrame([(i, " ".join([*plain[i : i + 20], w])) for i, w in enumerate([*wrong, ""])], "doc_id long, text string")
    got = [r.score for r in texts.orderBy("doc_id").select(toxicity.score(F.col("text"), terms, model).alias("score")).collect()]
    assert min(got[:-1]) >= toxicity.THRESHOLD > got[-1]


def test_no_term_that_passes_is_lost(spark):
    rng = random.Random(8)
    insults = ["".join(rng.choices("bcdfghjkmpqvwxz", k=9)) for _ in range(500)]
    rows = [(int(n < 200), " ".join(insults[(30 * n + i) % 500] for i in range(30)) if n < 200 else "aeio ulna stein") for n in range(1000)]
    terms = toxicity.learn_terms(spark.createDataFrame(rows, "label long, text string"))
    assert set(insults) <= set(terms)


@pytest.fixture(scope="module")
def scored(spark):
    d = "/root/testdata/sf0.1"
    return toxicity.toxicity_by_labels(stored(spark, d), stored(spark, d, "labels")).join(stored(spark, d, "labels"), "doc_id").toPandas()


def test_held_out_accuracy(scored):
    out = scored[scored.held_out & scored.toxic.notna()]
    assert out.score.between(0, 1).all()
    pos, neg = out[out.toxic == 1].score, out[out.toxic == 0].score
    area = sum((p > neg).sum() + 0.5 * (p == neg).sum() for p in pos) / (len(pos) * len(neg))
    assert area > 0.95
    assert (out.predicted == (out.score >= 0.3)).all()
    recall, false = (out[out.toxic == 1].predicted == 1).mean(), (out[out.toxic == 0].predicted == 1).mean()
    assert recall > 0.8 and false < 0.03


def test_held_out_rows_are_no_input(spark, sf_dir):
    docs, labels = stored(spark, sf_dir), stored(spark, sf_dir, "labels")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")).cast("int"))
    one, two = (sorted(map(tuple, toxicity.toxicity_by_labels(docs, x).collect())) for x in (labels, turned))
    assert one == two
    assert all(held == (zlib.crc32(str(d).encode()) % 4 == 2) for d, held, *_ in one)


def test_odd_rows(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(1, 1), (1, 0), (7, 0), (None, 1), (6, None), (99, 1)], "doc_id long, toxic int")
    out = toxicity.toxicity_by_labels(docs, labels).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.held_out is not None for r in out)
    none = toxicity.toxicity_by_labels(docs, labels.limit(0)).collect()
    assert len({r.score for r in none}) == 1
    assert toxicity.toxicity_by_labels(nothing(spark), labels).count() == 0
    kept = toxicity.drop_toxic(docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() == docs.count()
