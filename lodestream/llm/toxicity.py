"""Toxicity of texts by a lexicon that also catches misspelled terms.

The lexicon is a trie of terms and stems. A Levenshtein automaton walks it: a state is a set of (trie node,
edits so far), and the sets are made into the states of one deterministic automaton as words need them, so a
word costs a table look-up a character however many terms there are. Each hit is weighed by the window of words
around it: inside quotation marks or near a word of reporting it counts as quoted, near a word of address as
directed at somebody. A logistic model turns the sums into a score. Terms and model are learned from labels.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cache_of, cut, fresh, text_batches

#: At most so many labelled rows are learned from, those with the smallest hash of their id.
LABELLED = 20_000
#: Words on either side that make a hit's context.
WINDOW = 6
#: Lengths of the stems considered besides whole words.
STEMS = (4, 5, 6, 7)
# Marks of quotation, and words that report or address, by language (en, de, fr, es).
QUOTES = "\"“”„«»‹›‘"
REPORTING = frozenset("said says wrote quote quoted called sagte schrieb zitat zitiert nannte dit écrit cité appelé dijo escribió cita citado llamó".split())
ADDRESS = frozenset("you your you're du dein ihr euch tu ton vous votre tú usted ustedes".split())
#: Tokens whose match a worker remembers.
REMEMBERED = 100_000
#: More than the edits of any state.
EDITS = 4
#: States of the automaton that a worker keeps (about 1 kB each); beyond, it begins anew.
STATES = 200_000
#: Scores from which a text is predicted toxic.
THRESHOLD = 0.3
#: Features: constant, exact, misspelled, quoted, directed, share of words, distinct terms.
FEATURES = 7


def edits(length: int) -> int:
    """Edits allowed to a term of that many letters: none up to 4, one up to 7, two beyond."""
    return 0 if length <= 4 else 1 if length <= 7 else 2


class Lexicon:
    """A trie of terms (a trailing * marks a stem: any ending may follow) and its edit automaton.

    `match` gives (weight, edits) of the best term for a word, or None. A stem must match without edits: what
    follows it is free, so an edit would say little.
    """

    def __init__(self, terms: dict[str, float]):
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[dict[bool, tuple[float, int]]] = [{}]
        self.most: list[int] = [0]  # edits that any term below allows
        for term, weight in sorted(terms.items()):
            stem = term.endswith("*")
            letters = term[:-1] if stem else term
            limit, node = 0 if stem else edits(len(letters)), 0
            self.most[0] = max(self.most[0], limit)
            for c in letters:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append({})
                    self.most.append(0)
                node = self.children[node][c]
                self.most[node] = max(self.most[node], limit)
            self.ends[node][stem] = (weight, limit)
        self.alphabet = {c for kids in self.children for c in kids}
        self.known: dict[str, tuple[float, int] | None] = {}
        self._begin()

    def _begin(self) -> None:
        """An automaton of the start state alone; the others are made as words need them."""
        self.sets: list[tuple[int, ...]] = []  # node * EDITS + edits
        self.number: dict[tuple[int, ...], int] = {}
        self.steps: list[dict[str, int]] = []
        self.found: list[tuple[float, int] | None] = []
        self.free: list[tuple[float, int] | None] = []
        self.start = self._state(self._closed({(0, 0)}))

    def _closed(self, states: set[tuple[int, int]]) -> tuple[int, ...]:
        """With the letters that the word leaves out; of a node's states the one with fewest edits."""
        least: dict[int, int] = {}
        todo = list(states)
        while todo:
            node, e = todo.pop()
            if e > self.most[node] or least.get(node, 99) <= e:
                continue
            least[node] = e
            todo.extend((kid, e + 1) for kid in self.children[node].values())
        return tuple(sorted(node * EDITS + e for node, e in least.items()))

    def _state(self, states: tuple[int, ...]) -> int:
        if states not in self.number:
            self.number[states] = len(self.sets)
            self.sets.append(states)
            self.steps.append({})
            pairs = [divmod(x, EDITS) for x in states]
            ends = [(w, e) for node, e in pairs for stem, (w, limit) in self.ends[node].items() if e <= limit and not stem]
            stems = [(self.ends[node][True][0], 0) for node, e in pairs if e == 0 and True in self.ends[node]]
            self.found.append(min(ends + stems, key=lambda x: (x[1], -x[0]), default=None))
            self.free.append(max(stems, default=None))
        return self.number[states]

    def _step(self, at: int, c: str) -> int:
        """The state after a letter; letters of no term share one step."""
        c = c if c in self.alphabet else ""
        if c not in self.steps[at]:
            after = set()
            for node, e in (divmod(x, EDITS) for x in self.sets[at]):
                if c in self.children[node]:
                    after.add((self.children[node][c], e))
                after.add((node, e + 1))
                after.update((kid, e + 1) for kid in self.children[node].values())
            self.steps[at][c] = self._state(self._closed(after))
        return self.steps[at][c]

    def match(self, word: str) -> tuple[float, int] | None:
        at, stem, dead = self.start, None, self._dead()
        for c in word:
            step = self.steps[at].get(c)
            at = self._step(at, c) if step is None else step
            stem = self.free[at] or stem
            if at == dead:
                return stem
        found = self.found[at]
        return max((x for x in (found, stem) if x), key=lambda x: (-x[1], x[0]), default=None)

    def _dead(self) -> int:
        return self._state(())

    def of(self, token: str) -> tuple[float, int] | None:
        """`match` of a token of lower-cased text, without the marks around it; remembered up to a bound."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        if len(self.sets) > STATES:
            self._begin()
        word = token.strip(PUNCTUATION)
        hit = self.known[token] = self.match(word) if word else None
        return hit


PUNCTUATION = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + QUOTES + "…–—¿¡’"


def features(text: str | None, lexicon: Lexicon) -> np.ndarray:
    """Sums over the hits of a whole text."""
    out = np.zeros(FEATURES)
    out[0] = 1
    tokens = (text or "").lower().split()
    known, missing = lexicon.known, object()
    hits = []
    for i, token in enumerate(tokens):
        hit = known.get(token, missing)
        if hit is missing:
            hit = lexicon.of(token)
        if hit is not None:
            hits.append((i, hit))
    if not hits:
        return out
    for i, (weight, e) in hits:
        around = tokens[max(0, i - WINDOW) : i + WINDOW + 1]
        before = " ".join(tokens[max(0, i - WINDOW) : i])
        opened = tokens[i][0] in QUOTES or sum(before.count(q) for q in QUOTES) % 2 == 1
        words = {t.strip(PUNCTUATION) for t in around}
        if opened or not words.isdisjoint(REPORTING):
            out[3] += weight
        elif not words.isdisjoint(ADDRESS):
            out[4] += weight
        out[1 + (e > 0)] += weight
    out[1:5] = np.log1p(out[1:5])
    out[5] = math.log1p(100 * len(hits) / len(tokens))
    out[6] = math.log1p(len({tokens[i] for i, _ in hits}))
    return out


def learn_terms(labelled: DataFrame, least: int = 5, ratio: float = 1.5) -> dict[str, float]:
    """Terms whose documents are far more often toxic, with the logarithm of how much more.

    labelled: text, label. Words and stems are counted once a document. A term needs `least` toxic documents, a
    log ratio of `ratio`, and a likelihood ratio that chance over so many terms would not give. Stems that
    explain as much replace longer stems. Words stay beside their stems, which allow no edits.
    """
    words = F.array_distinct(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}]+"), lambda w: F.length(w) >= 3))

    def stems(n: int) -> Column:  # a second parameter of the lambdas would be the index in the array
        return F.transform(F.filter(F.col("words"), lambda w: F.length(w) > n), lambda w: F.concat(F.substring(w, 1, n), F.lit("*")))

    terms = labelled.select("label", words.alias("words")).select("label", F.explode(F.array_distinct(F.concat("words", *map(stems, STEMS)))).alias("term"))
    n, p = labelled.agg(F.count("*"), F.sum("label")).first()
    p, n = float(p or 0), float(n)
    if not p or p == n:
        return {}
    counts = terms.groupBy("term").agg(F.sum("label").alias("pos"), F.count("*").alias("all"))
    up = F.log((F.col("pos") + 0.5) / (p + 1)) - F.log((F.col("all") - F.col("pos") + 0.5) / (n - p + 1))
    share = F.col("pos") / F.col("all")
    gain = 2 * (F.col("pos") * F.log(share / (p / n)) + F.when(F.col("all") > F.col("pos"), (F.col("all") - F.col("pos")) * F.log((1 - share) / (1 - p / n))).otherwise(0.0))
    best = counts.where(F.col("pos") >= least).select("term", "pos", "all", up.alias("up"), gain.alias("gain")).where((F.col("up") >= ratio) & (F.col("gain") >= 25))
    rows = best.collect()  # bounded by LABELLED: each term is in `least` labelled texts or more
    out: dict[str, float] = {}
    for r in sorted(rows, key=lambda r: (len(r.term.rstrip("*")), not r.term.endswith("*"), r.term)):
        letters = r.term.rstrip("*")
        if not r.term.endswith("*") or not any(out.get(letters[:k] + "*", -1.0) > r.up - 0.7 for k in STEMS if k <= len(letters)):
            out[r.term] = float(r.up)
    return out


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton's method with a ridge penalty on all but the constant."""
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _lexicon(terms: dict[str, float]) -> Lexicon:
    """This worker's automaton for the terms."""
    key, known = tuple(sorted(terms.items())), cache_of("toxicity")
    if key not in known:
        known.clear()
        known[key] = Lexicon(terms)
    return known[key]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], np.ndarray]:
    """Terms and model from the labels of rows that aren't held out; labels that are null are passed over.

    A document with several labels counts as toxic if one says so. Without labels of both kinds the model
    knows no terms and gives every text the share of toxic labels.
    """
    text_batches(docs.sparkSession)
    some = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("long").alias("label"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
    texts = docs.where("doc_id is not null").select("doc_id", "text")
    known = cut(texts.join(F.broadcast(some), "doc_id").select("label", "text"))  # at most LABELLED rows of two numbers
    terms = learn_terms(known)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = _lexicon(terms)
        for batch in batches:
            x = np.array([features(t, lexicon) for t in batch.column(1).to_pylist()]).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, x.T)], ["label", *(f"f{i}" for i in range(FEATURES))])

    rows = known.mapInArrow(measure, "label long, " + ", ".join(f"f{i} double" for i in range(FEATURES))).toPandas()
    if not len(rows):
        return terms, np.array([-2.0] + [0.0] * (FEATURES - 1))
    x, y = rows.iloc[:, 1:].to_numpy(np.float64), rows["label"].to_numpy(np.float64)
    return terms, fit(x, y)


def score(text: Column, terms: dict[str, float], model: np.ndarray) -> Column:
    """The score of a whole text, 0 to 1. A null or empty text has no hits and the score of such a text."""

    @F.arrow_udf("double")
    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lexicon = _lexicon(terms)
        for some in texts:
            x = np.array([features(t.as_py(), lexicon) for t in some]).reshape(-1, FEATURES)
            yield pa.array(1 / (1 + np.exp(-np.clip(x @ model, -30, 30))))

    return scored(F.coalesce(text.cast("string"), F.lit("")))


def toxicity_by_labels(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted: learned from the labels that aren't held out, applied to every row.

    docs: doc_id, text; labels: doc_id, toxic; other columns are ignored. Repeated rows and null ids keep their
    rows, an empty table gives none. Nothing is shuffled to score.
    """
    terms, model = train(docs, labels)
    scored = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), score(F.col("text"), terms, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` without those that score `threshold` or more; all their columns stay, a null text is empty."""
    terms, model = train(docs, labels)
    name = fresh(docs, "score")
    return docs.withColumn(name, score(F.col("text"), terms, model)).where(F.col(name) < threshold).drop(name)
