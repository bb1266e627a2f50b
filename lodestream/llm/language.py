"""Language identification by hierarchical discrimination: the family first, then the language within it.

Texts are counts of hashed character n-grams of their words, damped and of unit length. Families are found in the data:
the languages' mean vectors are merged, nearest first, until about the square root of their number is left. Linear
support vector machines, one for each pair of families and one for each pair of languages of a family, are each
trained by a Spark task; a text is given to the family with the best chances against the others, then to the
language with the best chances within it.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SMALL_IDS, broadcast_if_small, cache_of, cut, text_batches
from .toxicity import fit, held_out

#: Entries of a text's vector, and the length of the longest n-grams that are hashed into it.
BUCKETS, LONGEST = 4096, 4
#: Labelled texts of a language that are learned from: those with the smallest hash of their id.
PER_LANGUAGE = 400
#: What errors weigh against the length of a classifier's weights.
COST = 10.0
#: n-grams that are hashed at a time.
PIECE = 1 << 20
#: What a text without letters is given.
UNKNOWN = "und"


def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    known = cache_of("language")
    if "letters" not in known:
        known["letters"] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return known["letters"]


def profile(text: str | None) -> np.ndarray | None:
    """The vector of a whole text; None without a letter.

    Letters count in lower case, and each run of anything else as one border between words, as do the text's two ends.
    n-grams of up to LONGEST characters may begin or end at a border, but don't cross one.
    """
    codes = np.frombuffer((text or "").lower().encode("utf-32-le"), np.uint32)
    codes = np.where(_letters()[codes], codes, 0) if len(codes) else codes
    if not codes.any():
        return None
    codes = np.concatenate([[0], codes, [0]])
    codes = codes[np.append(True, (codes[1:] != 0) | (codes[:-1] != 0))].astype(np.uint64)
    counts = np.zeros(BUCKETS)
    for at in range(0, len(codes), PIECE):
        counts += _grams(codes[at : at + PIECE + LONGEST - 1], PIECE)
    damped = np.sqrt(counts)
    return damped / np.linalg.norm(damped)


def _grams(codes: np.ndarray, starts: int) -> np.ndarray:
    """Counts of the n-grams that begin at the first `starts` codes."""
    hashes = codes * np.uint64(0x9E3779B97F4A7C15)
    gram, inside, out = hashes, codes != 0, np.zeros(BUCKETS, np.int64)
    for n in range(1, LONGEST + 1):
        if n > 1:
            gram = ((gram[:-1] ^ (gram[:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) + hashes[n - 1 :]
            inside = np.ones(len(gram), bool) if n == 2 else inside[:-1] & (codes[n - 2 : -1] != 0)
        some = gram[:starts][inside[:starts]]
        out += np.bincount(((some ^ (some >> np.uint64(32))) * np.uint64(0x94D049BB133111EB) >> np.uint64(52)).astype(np.int64) % BUCKETS, minlength=BUCKETS)
    return out


def separate(x: np.ndarray, side: np.ndarray, cost: float = COST) -> tuple[np.ndarray, np.ndarray]:
    """Weights, the constant last, of a linear machine with squared hinge loss, and what turns its margins into chances.

    side: 1 or 0. Both sides weigh the same. Newton steps in the primal, each solved by conjugate gradients.
    """
    x = np.hstack([x, np.ones((len(x), 1))])
    y = np.where(side > 0, 1.0, -1.0)
    weight = cost * len(y) / (2 * np.where(y > 0, (y > 0).sum(), (y < 0).sum()))
    w = np.zeros(x.shape[1])

    def loss(w: np.ndarray) -> float:
        return 0.5 * w @ w + (weight * np.maximum(0, 1 - y * (x @ w)) ** 2).sum()

    now = loss(w)
    for _ in range(30):
        slack = 1 - y * (x @ w)
        active = slack > 0
        rows, scaled = x[active], 2 * weight[active]
        g = w - rows.T @ (scaled * y[active] * slack[active])
        step, r = np.zeros_like(w), -g
        p, rr = r.copy(), r @ r
        if rr < 1e-12:
            break
        for _ in range(50):
            hp = p + rows.T @ (scaled * (rows @ p))
            a = rr / (p @ hp)
            step, r = step + a * p, r - a * hp
            before, rr = rr, r @ r
            if rr < 1e-6 * (g @ g):
                break
            p = r + (rr / before) * p
        rate = 1.0
        while (then := loss(w + rate * step)) > now and rate > 1e-6:
            rate /= 2
        if then >= now - 1e-9 * abs(now):
            break
        w, now = w + rate * step, then
    margins = x @ w
    return w, fit(np.column_stack([np.ones(len(y)), margins]), (y > 0).astype(float))


def families(centres: dict[str, np.ndarray]) -> list[list[str]]:
    """Languages in about the square root of their number of groups: the two groups with the nearest means merge first."""
    groups = [[name] for name in sorted(centres)]
    middle = np.mean(list(centres.values()), axis=0) if centres else 0.0  # what all languages share tells nothing
    unit = lambda names: (m := np.mean([centres[x] for x in names], axis=0) - middle) / (np.linalg.norm(m) or 1.0)
    while len(groups) > max(1, round(math.sqrt(len(centres)))):
        means = np.array([unit(g) for g in groups])
        near = np.triu(means @ means.T + 2, 1)
        i, j = np.unravel_index(near.argmax(), near.shape)
        groups[i] += groups.pop(j)
    return [sorted(g) for g in groups]


@dataclass
class Model:
    """families: languages by family; machines: of two names of families' numbers or languages, weights and chances."""

    families: list[list[str]]
    machines: dict[tuple, tuple[np.ndarray, np.ndarray]]

    def best(self, x: np.ndarray, names: list) -> tuple[np.ndarray, np.ndarray]:
        """For each row which of the names has the best chances against the others, on average, and those chances."""
        if len(names) == 1:
            return np.zeros(len(x), np.int64), np.ones(len(x))
        total = np.zeros((len(x), len(names)))
        for i, j in itertools.combinations(range(len(names)), 2):
            w, (b, a) = self.machines[names[i], names[j]]
            chance = 1 / (1 + np.exp(-np.clip(a * (x @ w[:-1] + w[-1]) + b, -30, 30)))
            total[:, i] += chance
            total[:, j] += 1 - chance
        winner = total.argmax(axis=1)
        return winner, total[np.arange(len(x)), winner] / (len(names) - 1)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        found, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.families:
            return found, scores
        vectors = [(i, v) for i, v in enumerate(map(profile, texts)) if v is not None]
        if not vectors:
            return found, scores
        at, x = np.array([i for i, _ in vectors]), np.array([v for _, v in vectors])
        family, sure = self.best(x, list(range(len(self.families))))
        for f, names in enumerate(self.families):
            mine = np.flatnonzero(family == f)
            if len(mine):
                winner, chance = self.best(x[mine], names)
                for i, k in zip(at[mine], winner):
                    found[i] = names[k]
                scores[at[mine]] = sure[mine] * chance
        return found, scores


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """lang, place, text: of each language the documents with the smallest hashes of their ids, that aren't held out.

    Ids are chosen before texts are read, and before they are ranked those go whose hash is beyond where three times as
    many are expected: a ranking sees about as many ids of a frequent language as of a rare one. Of several
    texts of an id and language the smallest counts.
    """
    labelled = docs.where("doc_id is not null and lang is not null and text is not null").where(~held_out(F.col("doc_id")))
    labelled = labelled.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string"))
    ids = labelled.select("lang", "doc_id").distinct().withColumn("hash", F.xxhash64("doc_id"))
    sizes = cut(ids.groupBy("lang").agg(F.count("*").alias("n")))
    near = F.col("hash") / 2.0**64 + 0.5 < 3.0 * per_language / F.col("n")
    near = ids.join(broadcast_if_small(sizes, sizes.count(), SMALL_IDS), "lang").where(near)
    order = Window.partitionBy("lang").orderBy("hash", "doc_id")
    chosen = cut(near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_language).select("lang", "doc_id", "place"))
    texts = labelled.join(broadcast_if_small(chosen, chosen.count(), SMALL_IDS), ["doc_id", "lang"])
    return texts.groupBy("lang", "place").agg(F.min("text").alias("text"))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """The model of the languages of documents that aren't held out; without any letters to learn from, of no language.

    The driver gets a mean vector a language, and the weights of the machines.
    """
    spark = docs.sparkSession
    text_batches(spark)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [v if v is None else v.astype(np.float32).tobytes() for v in map(profile, batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["lang", "place", "vector"])

    known = cut(sample(docs, per_language).mapInArrow(vectors, "lang string, place int, vector binary").where("vector is not null"))

    def ordered(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
        table = table.sort_by([("lang", "ascending"), ("place", "ascending")])  # sums don't depend on how rows arrive
        return table, np.array([np.frombuffer(v, np.float32) for v in table.column("vector").to_pylist()], np.float64)

    def centre(table: pa.Table) -> pa.Table:
        table, x = ordered(table)
        return pa.table({"lang": table.column("lang").slice(0, 1), "centre": pa.array([x.mean(axis=0).tobytes()], pa.binary())})

    centres = {r.lang: np.frombuffer(r.centre) for r in known.groupBy("lang").applyInArrow(centre, "lang string, centre binary").collect()}
    groups = families(centres)
    names, parts = [], []
    for members, key in [(list(range(len(groups))), lambda f: groups[f])] + [(g, lambda x: [x]) for g in groups]:
        for a, b in itertools.combinations(members, 2):
            parts += [(len(names), lang, side) for side, one in ((1, a), (0, b)) for lang in key(one)]
            names.append((a, b))
    if not names:
        return Model(groups, {})

    def machine(table: pa.Table) -> pa.Table:
        table, x = ordered(table)
        w, chances = separate(x, table.column("side").to_numpy())
        return pa.table({"machine": table.column("machine").slice(0, 1), "weights": pa.array([w.tobytes()], pa.binary()), "chances": pa.array([chances.tobytes()], pa.binary())})

    parts = spark.createDataFrame(parts, "machine int, lang string, side int")
    dealt = known.join(broadcast_if_small(parts, parts.count(), SMALL_IDS), "lang")
    trained = dealt.groupBy("machine").applyInArrow(machine, "machine int, weights binary, chances binary").collect()
    return Model(groups, {names[r.machine]: (np.frombuffer(r.weights), np.frombuffer(r.chances)) for r in trained})


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; nothing is shuffled."""
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, scores = model.predict(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(scores)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def languages(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the rows that aren't held out, applied to every one.

    docs: doc_id, text, lang; other columns are ignored. A text that is null or has no letter is `und`, with the score 0, as is
    every text where there is nothing to learn from. Repeated rows and null ids keep their rows, but a null id is
    not learned from; an empty table gives no rows. A score is the chance of the family against the others times that
    of the language within it.
    """
    return predict(docs, train(docs, per_language))
