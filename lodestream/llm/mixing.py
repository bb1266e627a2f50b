"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Each source has a target of words. Among all document rates with that many expected words, the one that
minimises the relative entropy to one copy a document is an exponential tilt, rate = exp(lambda * size / scale),
held at `most_copies` where it would exceed it. lambda solves the dual of that convex problem. The dual
separates by source, so one aggregation gives the gradient and the curvature of all sources, and a Newton
iteration updates every lambda at once. A rate depends on source and size alone: the iterations run on the
counts of (source, size), not on the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SMALL_IDS, WORD, broadcast_if_small, cut, fresh

#: Documents of one source are rounded in random subgroups of about this many.
SUBGROUP = 256
#: Equal rows that one task numbers.
CHUNK = 65_536
#: Sources up to which their table is broadcast (under 100 bytes each).
SMALL_SOURCES = 50_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ordered_sources(totals: DataFrame) -> DataFrame:
    """Adds `place`, from 0: sources by code point, null last.

    Ranges of sources are counted first, so no task orders them all.
    """
    order = [F.col("source").isNull(), F.col("source")]
    ranged = cut(totals.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n")).collect()  # one row a partition
    before, at = [], 0
    for r in sorted(counts):
        before.append((r["_range"], at))
        at += r["_n"]
    if not before:
        return ranged.drop("_range").withColumn("place", F.lit(0).cast("long"))
    base = F.broadcast(totals.sparkSession.createDataFrame(before, "_range int, _base long"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.join(base, "_range").withColumn("place", (F.col("_base") + inside - 1).cast("long")).drop("_range", "_base")


def source_targets(totals: DataFrame, weights: tuple[int, ...], budget: tuple[int, int], most_copies: int) -> DataFrame:
    """Adds `target` to one row a source (columns source, source_size).

    Sources by code point, null last, take the weights in turn. They share budget[0] / budget[1] of all words
    by weight; a target stops at most_copies times its source, and the excess is shared anew among those below.
    Each round of sharing is one aggregation; a source that is full stays full, so rounds end.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("place", F.lit(len(weights))) + 1).cast("int")).cast("long")
    full = cut(ordered_sources(totals).withColumns({"_weight": weight, "_limit": F.col("source_size") * most_copies}).drop("place"))
    words = (full.agg(F.sum("source_size")).first()[0] or 0) * budget[0] / budget[1]
    level, filled = 0.0, -1
    while True:
        done = F.col("_limit") <= F.col("_weight") * F.lit(level) if filled >= 0 else F.lit(False)
        r = full.agg(F.sum(F.when(done, F.col("_limit")).otherwise(0)).alias("given"), F.sum(F.when(done, 0).otherwise(F.col("_weight"))).alias("open"), F.sum(done.cast("long")).alias("filled")).first()
        if not r["open"] or r["filled"] == filled:
            break
        level, filled = (words - r["given"]) / r["open"], r["filled"]
    return full.withColumn("target", F.least(F.col("_limit").cast("double"), F.col("_weight") * F.lit(float(level)))).drop("_limit", "_weight")


def tilts(sizes: DataFrame, sources: DataFrame, most_copies: int, tolerance: float, iterations: int) -> DataFrame:
    """Newton iterations on the dual: a `tilt` for each source.

    sizes: key, size, n. sources: key, target, source_size, scale. A source whose target is all it may give has
    the tilt infinity. A step that leaves the interval known to hold the root is replaced by its middle.
    """
    at = sources.select(
        "key", "target", "scale",
        F.when(F.col("target") >= F.col("source_size") * most_copies * (1 - 1e-12), F.lit(float("inf"))).otherwise(F.lit(0.0)).alias("tilt"),
        F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"),
    )
    at = cut(at)
    many = at.count()
    for _ in range(iterations):
        rate = F.exp(F.col("tilt") * F.col("size") / F.col("scale"))
        words = F.col("n") * F.col("size")
        step = sizes.join(broadcast_if_small(at, many, SMALL_SOURCES), "key").groupBy("key").agg(
            F.sum(words * F.least(rate, F.lit(float(most_copies)))).alias("got"),
            F.sum(F.when(rate < most_copies, words * rate * F.col("size") / F.col("scale")).otherwise(0.0)).alias("slope"),
            F.first("target").alias("target"), F.first("scale").alias("scale"), F.first("tilt").alias("tilt"), F.first("low").alias("low"), F.first("high").alias("high"),
        )
        over = F.col("got") - F.col("target")
        low, high = F.when(over < 0, F.col("tilt")).otherwise(F.col("low")), F.when(over > 0, F.col("tilt")).otherwise(F.col("high"))
        step = step.withColumn("off", F.when(F.col("tilt") == float("inf"), 0.0).otherwise(F.abs(over) / F.greatest(F.col("target"), F.lit(1.0)))).withColumns({"low": low, "high": high})
        newton = F.when(F.col("slope") > 0, F.col("tilt") - (F.col("got") - F.col("target")) / F.col("slope"))
        middle = (
            F.when(F.col("low") == float("-inf"), F.least(F.col("high") * 2, F.col("high") - 1))
            .when(F.col("high") == float("inf"), F.greatest(F.col("low") * 2, F.col("low") + 1))
            .otherwise((F.col("low") + F.col("high")) / 2)
        )
        # no step may more than double its distance: the exponential flattens on one side
        limited = F.greatest(F.least(newton, F.col("tilt") + 4 + 2 * F.abs("tilt")), F.col("tilt") - 4 - 2 * F.abs("tilt"))
        moved = F.when((limited > F.col("low")) & (limited < F.col("high")), limited).otherwise(middle)
        at = cut(step.select("key", "target", "scale", F.when(F.col("off") <= tolerance, F.col("tilt")).otherwise(moved).alias("tilt"), "low", "high", "off"))
        if (at.agg(F.max("off")).first()[0] or 0.0) <= tolerance:
            break
    return at.select("key", "tilt")


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), budget: tuple[int, int] = (3, 2), most_copies: int = 2,
    tolerance: float = 1e-7, iterations: int = 60, keep: tuple[str, ...] = ("doc_id",), settle: int = 3, extra: tuple[str, ...] = (),
) -> DataFrame:
    """One row a document row: the columns `keep`, source, size, source_size, target, copies and taken = copies * size.

    docs: doc_id, text, source; other columns are ignored. A null text has no words, a document without words
    takes no copies beyond what rounding gives it (taken is 0 either way), a null source is a source of its
    own, an empty table gives no rows. Ties fall by a hash of doc_id and text, so reruns agree. Rows that repeat a
    doc_id, or have none, count each by their text; those equal in text, too, are counted as one group, of which some
    get a copy more than the others.

    Rates become whole copies by systematic rounding: in random subgroups of a source, ordered by size, the
    running sum of the fractional rates hands out a copy whenever it passes a whole number. What is then left
    to a source's target is settled by `settle` rounds in which the one row whose size is closest to the
    rest gains or loses a copy. Large sources make many subgroups, so no task holds one whole.
    """
    named = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    held = [*keep, *([] if "doc_id" in keep else ["doc_id"])]
    sized = docs.select(*held, "source", word_count(F.col("text")).alias("size"), named.alias("key"), text_mark().alias("mark"))
    same = cut(sized.groupBy("key", "source", "size", "mark", *held).agg(F.count("*").alias("n")))
    sizes = cut(same.groupBy("key", "source", "size").agg(F.sum("n").alias("n")))
    totals = sizes.groupBy("key", "source").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"),
        F.greatest(F.sum(F.col("n").cast("double") * F.col("size") * F.col("size")) / F.greatest(F.sum(F.col("size") * F.col("n")), F.lit(1)), F.lit(1.0)).alias("scale"),
    )
    sources = cut(source_targets(totals, weights, budget, most_copies))
    many = sources.count()
    tilt = tilts(sizes, sources, most_copies, tolerance, iterations)
    sources = cut(sources.join(tilt, "key", "left"))
    small = broadcast_if_small(sources.drop("source"), many, SMALL_SOURCES)
    full = one_by_one(same).join(small, "key")
    rate = F.when(F.col("tilt") == float("inf"), float(most_copies)).otherwise(F.least(F.exp(F.col("tilt") * F.col("size") / F.col("scale")), F.lit(float(most_copies))))
    full = full.withColumn("rate", rate).withColumn("whole", F.floor("rate")).withColumn("part", F.col("rate") - F.col("whole"))
    full = full.withColumn("sub", F.pmod(F.xxhash64("mark", F.floor(F.col("nth") / SUBGROUP)), F.ceil(F.col("docs") / SUBGROUP)))
    inside = Window.partitionBy("key", "sub").orderBy(F.col("size").desc(), "mark", "nth", *held)
    start = F.pmod(F.xxhash64("key", "sub"), F.lit(1 << 20)) / float(1 << 20)
    run = F.round(F.sum("part").over(inside.rowsBetween(Window.unboundedPreceding, 0)) + start, 9)
    full = full.withColumn("run", run).withColumn("last", F.lag("run", 1).over(inside))
    full = full.withColumn("copies", (F.col("whole") + F.floor("run") - F.floor(F.coalesce(F.col("last"), start))).cast("long"))
    full = full.withColumn("copies", F.least(F.greatest(F.col("copies"), F.lit(0)), F.lit(most_copies)).cast("long"))
    full = cut(full.select("key", *held, "source", "size", "source_size", "target", "mark", "nth", "copies"))
    row = F.struct("mark", "nth", *held)
    for _ in range(settle):
        left = full.groupBy("key").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("left"))
        left = F.broadcast(cut(left)) if many <= SMALL_SOURCES else cut(left)
        known = full.join(left, "key")
        may = (F.col("size") > 0) & F.when(F.col("left") > 0, F.col("copies") < most_copies).otherwise(F.col("copies") > 0)
        gap = F.abs(F.abs("left") - F.col("size"))
        best = known.where(may & (gap < F.abs("left"))).groupBy("key").agg(F.min(F.struct(gap.alias("gap"), row.alias("row"), F.signum("left").cast("long").alias("step"))).alias("best"))
        best = best.select("key", F.col("best.row").alias("chosen"), F.col("best.step").alias("step"))
        best = F.broadcast(cut(best)) if many <= SMALL_SOURCES else cut(best)
        changed = full.join(best, "key", "left")
        step = F.when(F.col("chosen").eqNullSafe(row), F.col("step")).otherwise(0)
        full = changed.withColumn("copies", F.least(F.greatest(F.col("copies") + step, F.lit(0)), F.lit(most_copies)).cast("long")).drop("chosen", "step")
    return full.select(*(c for c in held if c in (*keep, *extra)), *(c for c in ("mark",) if c in extra), "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def text_mark() -> Column:
    """A hash of a row's id and text."""
    return F.xxhash64("doc_id", "text")


def one_by_one(same: DataFrame) -> DataFrame:
    """Each row as often as its `n` says, with `nth` from 0. Large groups are dealt out in chunks first."""
    zero, last = F.lit(0).cast("long"), F.col("n") - 1
    many = same.where(F.col("n") > CHUNK).withColumn("_from", F.explode(F.sequence(zero, last, F.lit(CHUNK).cast("long"))))
    many = many.repartition("mark", "_from").withColumn("nth", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + (CHUNK - 1), last)))).drop("_from")
    few = same.where((F.col("n") > 1) & (F.col("n") <= CHUNK)).withColumn("nth", F.explode(F.sequence(zero, last)))
    return same.where("n = 1").withColumn("nth", F.lit(0).cast("long")).unionByName(few).unionByName(many)


def materialise(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: every document row as often as its copies say, with the columns of `docs`.

    Copies are joined by doc_id, source and text. Rows equal in these share the copies of their group evenly: those
    that are equal in all columns are counted, a hash of the columns deals them to chunks of about SUBGROUP
    rows and orders them there, and the running sum of their mean hands out the copies. So the result depends neither on
    partitions nor on the order of rows. Nulls, empty texts and an empty table as in `mix`.
    """
    own, mark, named, many, rows, copy, chunk, equal, at = (fresh(docs, x) for x in ("id", "mark", "named", "copies", "rows", "copy", "chunk", "equal", "at"))
    mixed = mix(docs, extra=("mark",), **options)
    groups = mixed.groupBy("doc_id", "mark", "source").agg(F.sum("copies").alias(many), F.count("*").alias(rows)).where(F.col(many) > 0)
    groups = cut(groups.select(F.col("doc_id").alias(own), F.col("mark").alias(mark), F.col("source").alias(named), many, rows))
    count = groups.count()
    single, repeated = groups.where(F.col(rows) == 1), groups.where(F.col(rows) > 1)
    fits = docs["doc_id"].eqNullSafe(F.col(own)) & (text_mark() == F.col(mark)) & docs["source"].eqNullSafe(F.col(named))
    columns = [F.col(f"d.`{c}`") for c in docs.columns]
    once = docs.alias("d").join(broadcast_if_small(single, count, SMALL_IDS), fits).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(many).cast("int")))).select(*columns)
    if repeated.isEmpty():
        return once
    joined = docs.alias("d").join(broadcast_if_small(repeated, count, SMALL_IDS), fits)
    counted = joined.groupBy(own, mark, named, many, rows, *columns).agg(F.count("*").alias(equal))
    drawn = F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns))
    dealt = counted.withColumn(chunk, F.pmod(drawn, F.ceil(F.col(rows) / SUBGROUP))).withColumn(at, drawn)
    upto = F.sum(equal).over(Window.partitionBy(own, mark, named, chunk).orderBy(at).rowsBetween(Window.unboundedPreceding, 0))
    mean, start = F.col(many) / F.col(rows), F.when(F.col(rows) <= SUBGROUP, 0.0).otherwise(F.pmod(F.xxhash64(mark, chunk), F.lit(1 << 20)) / float(1 << 20))
    share = F.floor(F.round(upto * mean + start, 9)) - F.floor(F.round((upto - F.col(equal)) * mean + start, 9))
    dealt = dealt.withColumn(copy, share).where(F.col(copy) > 0)
    # a row with very many copies is written by several tasks
    dealt = dealt.withColumn(at, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copy), F.lit(CHUNK).cast("long"))))
    spread = dealt.where(F.col(copy) > CHUNK).repartition(own, mark, at)
    dealt = dealt.where(F.col(copy) <= CHUNK).unionByName(spread)
    dealt = dealt.withColumn(at, F.explode(F.sequence(F.col(at), F.least(F.col(at) + (CHUNK - 1), F.col(copy)))))
    return once.unionByName(dealt.select(*docs.columns))
