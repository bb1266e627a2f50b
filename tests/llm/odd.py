"""Small tables with everything that a real one may hold, and helpers."""

from __future__ import annotations

import public_tokenizers

PATH = public_tokenizers.path("byte_bpe_50k.json")
PASSAGE = " ".join(f"word{i}" for i in range(80))
#: Names that operators use inside.
CLASHING = ["n", "key", "size", "band", "fp", "id", "mark", "gone", "score", "copies", "copy", "spans", "removed", "doc", "cuts", "text_", "target"]
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog", "a"),
    (2, None, "a"),
    (3, "", "b"),
    (4, "   \t ", None),
    (5, "the quick brown fox jumps over the lazy dog", "a"),
    (5, "the quick brown fox jumps over the lazy dog", "a"),
    (6, "it " * 30_000 + PASSAGE, "b"),
    (None, "a row without an id " + PASSAGE, "b"),
    (7, "before " + PASSAGE + " after", "c"),
    (8, "<|endoftext|> naïve \U0001f600 ͸ it's  don't\n\n1234", "c"),
]


def documents(spark, rows=None):
    rows = ROWS if rows is None else rows
    kind = "doc_id long, text string, source string, lang string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
    full = [(*r, "en", len(r[1] or ""), *(["x"] * len(CLASHING))) for r in rows]
    return spark.createDataFrame(full, kind).repartition(3)


def nothing(spark):
    return documents(spark, [])


def stored(spark, sf_dir, name="documents"):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
