"""Audit of how filters interact, by a subset-zeta transform of the counts of failure masks.

A document's mask has a bit for each filter that it fails. All that an audit asks follows from how many documents of a
part have each mask: the zeta transform turns those counts, one filter at a time, into how many documents have no bit
outside a set, so that the survivors of any subset of filters are the entry of its complement. A step of an order of
filters is the difference between two neighbouring subsets, for documents and for labelled ones alike.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, Scratch

LETTERS = "ABCDE"
#: The bit of filter E; the other filters look at a text alone.
REPEATED = 1 << LETTERS.index("E")
#: What is counted of a mask: documents, those of good quality, toxic ones.
COUNTED = ("docs", "good", "toxic")


def text_masks(docs: DataFrame) -> DataFrame:
    """doc_id, part, text's hash, mask of the filters A to D: under 200 words, under half of them distinct, over 2 %
    capitals, a character of #$%&*|."""
    text, words = F.col("text"), F.col("words")
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    sized = rows.select("doc_id", "part", "text", F.size(words).cast("long").alias("n"), F.size(F.array_distinct(words)).cast("long").alias("different"))
    failed = [F.col("n") < 200, 100 * F.col("different") < 50 * F.col("n"), 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 2 * F.char_length(text).cast("long"), text.rlike(r"[#$%&*|]")]
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(failed)), F.lit(0))
    return sized.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("hash"), mask.alias("mask"))


def mask_counts(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """part, mask, docs, good, toxic of the five filters, with as many rows as there are masks in a part at most.

    Filter E fails a document whose text a smaller doc_id has. So all rows of a text fail but those with its
    smallest id, which are found by that id and the text's hash: no join has a frequent text or source as its key.
    A row without an id neither fails E nor makes others fail, and has no labels. Of several labels of a document one
    that says 1 is enough.
    """
    rows = scratch.table(text_masks(docs), "masks")
    firsts = rows.where("doc_id is not null").groupBy("hash").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.where("doc_id is not null").select(F.col("doc_id").cast("long"), *[F.coalesce(F.col(c) == 1, F.lit(False)).cast("long").alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))])
    marks = marks.groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    # equal rows are counted before they are joined
    known = rows.where("doc_id is not null").groupBy("doc_id", "hash", "part").agg(F.first("mask").alias("mask"), F.count("*").alias("n"))
    known = known.join(firsts, ["doc_id", "hash"], "left").join(marks, "doc_id", "left")
    mask = F.col("mask") + F.when(F.col("first"), 0).otherwise(REPEATED)
    known = known.select("part", mask.alias("mask"), "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    nameless = rows.where("doc_id is null").select("part", "mask", F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    return known.unionByName(nameless).groupBy("part", "mask").agg(F.sum("n").alias("docs"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def _one_bit(counts: Column, bit: int) -> Column:
    """A step of the zeta transform: to each mask with the bit, add the entry of the mask without it."""
    below = lambda x, i: F.when(i.bitwiseAND(bit) != 0, F.get(counts, i - bit)).otherwise(0)
    return F.transform(counts, lambda x, i: x + below(x, i))


def survivors(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """part and an array of 2^filters for each of COUNTED: how many documents pass all filters of each subset."""
    filters = len(letters)
    everything = (1 << filters) - 1
    entry = F.struct(*(F.col(c) for c in COUNTED))
    found = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", entry))).alias("by_mask"))  # 2^filters entries at most
    masks = F.sequence(F.lit(0), F.lit(everything))

    def of_mask(c: str) -> Column:
        return F.transform(masks, lambda m: F.coalesce(F.try_element_at("by_mask", m)[c], F.lit(0).cast("long")))

    def of_complement(c: str) -> Column:
        return F.transform(masks, lambda s: F.get(c, F.lit(everything) - s))

    found = found.select("part", *(of_mask(c).alias(c) for c in COUNTED))
    for bit in (1 << i for i in range(filters)):
        found = found.select("part", *(_one_bit(F.col(c), bit).alias(c) for c in COUNTED))
    return found.select("part", *(of_complement(c).alias(c) for c in COUNTED))


def _shapley(bit: int, filters: int) -> Column:
    """Documents that a filter removes, summed over all orders: each subset before it comes in k! (f - 1 - k)! of them."""
    subsets = [s for s in range(1 << filters) if not s & bit]
    orders = lambda s: math.factorial(s.bit_count()) * math.factorial(filters - 1 - s.bit_count())
    return sum((orders(s) * (F.get("docs", F.lit(s)) - F.get("docs", F.lit(s | bit))) for s in subsets), F.lit(0).cast("long"))


def order_steps(passed: DataFrame, letters: str = LETTERS) -> DataFrame:
    """A row for each part, order of the filters and step: what the step keeps and removes, as differences of subsets."""
    filters = len(letters)
    bits = {x: 1 << i for i, x in enumerate(letters)}
    everything = (1 << filters) - 1
    orders = F.array(*(F.lit("".join(p)) for p in itertools.permutations(letters)))
    shapley = F.array(*(_shapley(b, filters) for b in bits.values()))
    rows = passed.select("*", shapley.alias("shapley"))
    rows = rows.select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(filters))).alias("step"))
    place = {x: F.instr("filter_order", x) for x in letters}
    before = sum((F.when(place[x] < F.col("step"), b).otherwise(0) for x, b in bits.items()), F.lit(0))
    number = sum((F.when(place[x] == F.col("step"), i).otherwise(0) for i, x in enumerate(letters)), F.lit(0))
    rows = rows.withColumn("before", before).withColumn("number", number).withColumn("bit", F.expr("shiftleft(1, number)"))
    at = lambda c, s: F.get(c, s)
    now = F.col("before").bitwiseOR(F.col("bit"))
    removed = lambda c: at(c, F.col("before")) - at(c, now)
    failing = at("docs", F.lit(0)) - at("docs", F.col("bit"))
    return rows.select(
        "part", "filter_order", "step", at("docs", now).alias("kept"), removed("docs").alias("removed"), (failing - removed("docs")).alias("redundant"),
        (at("docs", F.lit(everything) - F.col("bit")) - at("docs", F.lit(everything))).alias("unique_fails"), removed("good").alias("good_lost"), removed("toxic").alias("toxic_lost"), F.get("shapley", F.col("number")).alias("shapley"),
    )


def interaction_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    docs: doc_id, text, source; labels: doc_id, quality, toxic; other columns are ignored. A null text is empty; a null
    source is the part of the empty string. Repeated rows count each, and equal rows under one id don't
    make each other fail E. An empty table has no parts and so no rows; a part has 600, zeros included. What is shuffled is
    an id, a hash and a mask for each document, twice, by id and by hash; the audit itself works on the parts' counts.
    """
    with Scratch(docs.sparkSession) as scratch:
        return scratch.result(order_steps(survivors(mask_counts(docs, labels, scratch))))
