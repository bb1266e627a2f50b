"""Exact token counts and ids through whole pre-tokens.

A byte-level BPE never merges across pre-tokens, so a text's tokens are its pre-tokens' tokens. Which strings
of the vocabulary encode alone as one token is proved once, on the driver, by encoding each of them. In the
texts a pre-token of that table counts as one token outright; only the others are merged by the tokenizer,
each distinct one once per batch and remembered up to a bound.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches

#: The pre-tokens of a byte-level BPE; a fixed value, from the tokenizer libraries' documentation. Its runs never give back what
#: they took, which changes no pre-token: what follows a run never begins with what it holds.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Merged pre-tokens that a worker remembers before it forgets them all.
REMEMBERED = 500_000
#: Texts handled at a time.
SLICE = 128
#: Bytes of text whose words are merged together, and rows of it taken at a time.
TOGETHER, ROWS = 1 << 20, 256
#: White space beside a space, and a space at the end: elsewhere each space begins a pre-token.
_WHITE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
RUN = rf"{_WHITE} | (?:{_WHITE}|\z)"
#: Characters from U+0378, the first that is unassigned.
BEYOND = re.compile("[^\x00-\u0377]").findall


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def whole_tokens(path: str) -> dict[str, int]:
    """Every vocabulary string that encodes alone as the one token it names, with its id."""
    tokenizer = load(path)
    plain = json.loads(tokenizer.to_str())
    kind = plain["pre_tokenizer"] or {}
    if plain["model"]["type"] != "BPE" or kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or not kind.get("use_regex", True) or plain["normalizer"]:
        raise ValueError(f"{path}: whole pre-tokens need a byte-level BPE without prefix space or normalizer")
    ids = sorted(tokenizer.get_vocab(with_added_tokens=False).values())
    texts = tokenizer.decode_batch([[i] for i in ids], skip_special_tokens=False)
    found = {}
    for i, text, code in zip(ids, texts, tokenizer.encode_batch(texts, add_special_tokens=False)):
        if code.ids == [i] and len(regex.findall(PATTERN, text)) == 1:
            found[text] = i
    return found


def unassigned(text: str) -> bool:
    """Whether it has characters that are new or free in this Unicode version: two regex libraries may differ in them."""
    return not text.isascii() and any(unicodedata.category(c) == "Cn" for c in BEYOND(text))


class Counter:
    """Token counts of whole texts. A text with a special token's string, or with an unassigned character, is
    left to the tokenizer as a whole."""

    def __init__(self, path: str, whole: dict[str, int]):
        self.tokenizer = load(path)
        self.whole = dict.fromkeys(whole, 1)
        self.known = dict(self.whole)
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.split = regex.compile(PATTERN).findall

    def _value(self, code):
        return len(code.ids)

    def _learn(self, new: set[str]) -> set[str]:
        """Merges pre-tokens that aren't known; returns those that can't be judged alone."""
        odd = {x for x in new if unassigned(x)}
        rest = list(new - odd)
        for part, code in zip(rest, self.tokenizer.encode_batch(rest, add_special_tokens=False)):
            self.known[part] = self._value(code)
        return odd

    def count(self, texts: list[str | None]) -> list[int]:
        """For each text the number of tokens. A null text is empty."""
        out: list[int] = []
        for s in range(0, len(texts), SLICE):
            some = [t or "" for t in texts[s : s + SLICE]]
            parts = [self.split(t) for t in some]
            if len(self.known) > len(self.whole) + REMEMBERED:
                self.known = dict(self.whole)
            new = {x for x in set().union(*parts) if x not in self.known}
            odd = self._learn(new) if new else set()
            for text, pre in zip(some, parts):
                if any(x in text for x in self.special) or (odd and not odd.isdisjoint(pre)):
                    out.append(self._value(self.tokenizer.encode(text, add_special_tokens=False)))
                else:
                    out.append(sum(map(self.known.__getitem__, pre)))
        return out


class Ids:
    """Token ids of whole texts, as arrays.

    The merges run in tiktoken's engine, several times faster than the tokenizer's own and equal to it where
    each merge of the tokenizer's list makes a higher id than the one before, which is proved when it is built.
    Texts with a special token's string or an unassigned character go to the tokenizer itself.

    Of many texts each distinct word (what stands between two spaces) is merged once. That needs each space to
    begin a pre-token: a text where one stands in a run of white space or at the end is merged as a whole.
    """

    def __init__(self, path: str):
        import tiktoken

        self.tokenizer = load(path)
        plain = json.loads(self.tokenizer.to_str())
        model = plain["model"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        made = [model["vocab"][a + b] for a, b in pairs]
        if model["type"] != "BPE" or any(a >= b for a, b in zip(made, made[1:])):
            raise ValueError(f"{path}: the order of the merges is not that of the ids")
        of = {c: b for b, c in byte_alphabet().items()}
        ranks = {bytes(of[c] for c in token): i for token, i in model["vocab"].items()}
        self.engine = tiktoken.Encoding("merges", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.size = self.tokenizer.get_vocab_size()
        self.width = np.zeros(self.size, np.int64)
        self.width[list(ranks.values())] = list(map(len, ranks))

    def ids(self, text: str | None) -> np.ndarray:
        text = text or ""
        if any(x in text for x in self.special) or unassigned(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.engine.encode_to_numpy(text, disallowed_special=())

    def many(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text. A null text is empty."""
        texts = pc.fill_null(texts, "")
        rows, run = texts.to_pylist(), pc.match_substring_regex(texts, RUN).to_pylist()
        whole = np.array([r or any(x in t for x in self.special) or unassigned(t) for t, r in zip(rows, run)], bool)
        by_words = iter(self._by_words(texts.filter(pa.array(~whole))))
        return [self.ids(t) if w else next(by_words) for t, w in zip(rows, whole)]

    def _by_words(self, texts: pa.Array) -> list[np.ndarray]:
        if not len(texts):
            return []
        parts = pc.split_pattern(texts, " ")
        at, flat = parts.offsets.to_numpy(), parts.values
        first = np.zeros(len(flat), bool)  # a text's first word has no space before it
        first[at[:-1]] = True
        words = flat.filter(pa.array(~first)).dictionary_encode()
        known = words.dictionary
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(known)], pa.int32()), known), " ")[0].as_py()
        merged = self.engine.encode_to_numpy(" " + joined, disallowed_special=()) if len(known) else np.empty(0, np.uint32)
        heads = [self.engine.encode_to_numpy(x, disallowed_special=()) for x in flat.filter(pa.array(first)).to_pylist()]
        ends, bounds = np.cumsum(self.width[merged]), np.cumsum(pc.binary_length(known).to_numpy().astype(np.int64) + 1)
        upto = np.searchsorted(ends, bounds) + 1
        if not np.array_equal(ends[upto - 1], bounds):
            raise ValueError("a token crosses a word's end")
        size = np.concatenate([np.diff(upto, prepend=0), [len(x) for x in heads]])
        begin = np.cumsum(size) - size
        code = np.empty(len(flat), np.int64)
        code[~first], code[first] = words.indices.to_numpy(), len(known) + np.arange(len(heads))
        size, begin = size[code], begin[code]
        stop = np.cumsum(size)
        ids = np.concatenate([merged, *heads])[np.repeat(begin - (stop - size), size) + np.arange(stop[-1])]
        return np.split(ids, stop[at[1:-1] - 1])


def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about TOGETHER bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for s in range(0, batch.num_rows, ROWS):
            held.append(batch.slice(s, ROWS))
            if sum(x.nbytes for x in held) >= TOGETHER:
                yield pa.concat_batches(held)
                held = []
    if held:
        yield pa.concat_batches(held)


def byte_alphabet() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the
    others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(rest)}


_workers: dict = {}


def counter(path: str, whole) -> Counter:
    """This worker's counter; `whole` is the broadcast table."""
    if ("count", path) not in _workers:
        _workers["count", path] = Counter(path, whole.value)
    return _workers["count", path]


def id_encoder(path: str) -> Ids:
    if ("ids", path) not in _workers:
        _workers["ids", path] = Ids(path)
    return _workers["ids", path]


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) for each row of docs (doc_id, text).

    Other columns are ignored; a null or empty text has 0 bytes and tokens; repeated rows and null ids keep
    their rows; an empty table gives none. Nothing is shuffled. Broadcast: one entry a vocabulary string.
    """
    text_batches(docs.sparkSession)
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path, whole).count
        for batch in batches:
            for s in range(0, batch.num_rows, SLICE):
                part = batch.slice(s, SLICE)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(count(part.column(1).to_pylist()), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
