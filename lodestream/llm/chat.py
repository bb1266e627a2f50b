"""Chat formatting by quotation linking.

Messages may quote others in lines that begin with `>` marks, one a level. A message's own passages (its text,
paragraphs and lines at level 0) and those that it quotes (blocks, their paragraphs and lines) are normalised and
hashed; a quoted passage is linked to the first message of its conversation that has it as its own. Links make threads; a conversation is put into
reply order, thread by thread, without the quotes.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, cut

MARKS = re.compile(r"^\s{0,3}((?:>\s?)+)")
#: What ends a line.
BREAK = r"\r\n|\n|\r"
#: Messages of a conversation that `assemble` joins into one text.
CHUNK = 64


def levels(text: str) -> list[tuple[int, str]]:
    """Each line's quote level and what follows the marks. A level is one `>`, with or without spaces between."""
    out = []
    for line in re.split(BREAK, text):
        m = MARKS.match(line)
        out.append((m.group(1).count(">"), line[m.end() :]) if m else (0, line))
    return out


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def own_text(text: str) -> str:
    """The text without quoted lines, and without the blank lines that they leave at its ends."""
    lines = levels(text)
    if not any(level for level, _ in lines):
        return text
    return "\n".join(line for level, line in lines if not level).strip("\n")


def passages(text: str) -> Iterator[tuple[int, str]]:
    """(level, normalised passage): level 0 are the message's own, with their paragraphs and lines."""
    lines = levels(text)
    own = [line for level, line in lines if not level]
    blocks = [(0, own)]
    blocks += [(0, list(g)) for blank, g in itertools.groupby(own, lambda x: not x.strip()) if not blank]
    for level, quote in ((level, [line for _, line in g]) for level, g in itertools.groupby(lines, lambda x: x[0]) if level):
        blocks.append((level, quote))
        blocks += [(level, list(g)) for blank, g in itertools.groupby(quote, lambda x: not x.strip()) if not blank]
    seen = set()
    for level, block in blocks:
        for part in ["\n".join(block), *block]:
            key = (level, normal(part))
            if key[1] and key not in seen:
                seen.add(key)
                yield key


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "turn", "level", "hash", "size"]
    for batch in batches:
        rows = []
        for conv, turn, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            rows.extend((conv, turn, level, xxhash.xxh3_128_digest(part.encode("utf-8", "surrogatepass")), len(part)) for level, part in passages(text))
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def quoting(messages: DataFrame) -> DataFrame:
    """`messages` as a mail client would keep them: each quotes the turn before it, and every second one also the turn
    before that, a level deeper.

    messages: conv_id, turn, role, text. A conversation's messages that share a turn are quoted by the first of their
    texts; first turns, and rows without conv_id or turn, quote nothing. Nulls count as empty. No rows are added or lost.
    """
    known = messages.where("conv_id is not null and turn is not null")
    text = F.coalesce(F.col("text"), F.lit(""))
    one = known.groupBy("conv_id", "turn").agg(F.min(text).alias("said"))
    mark = lambda said, level: F.concat(F.lit("> " * level), F.regexp_replace(said, f"({BREAK})", "$1" + "> " * level), F.lit("\n"))
    back = lambda n, name: one.select("conv_id", (F.col("turn") + n).alias("turn"), F.col("said").alias(name))
    joined = known.join(back(1, "before"), ["conv_id", "turn"], "left").join(back(2, "earlier"), ["conv_id", "turn"], "left")
    deep = F.when((F.col("turn") % 2 == 0) & F.col("earlier").isNotNull(), mark(F.col("earlier"), 2)).otherwise("")
    quoted = F.when(F.col("before").isNotNull(), F.concat(deep, mark(F.col("before"), 1))).otherwise("")
    columns = ["conv_id", "turn", "role"]
    rest = messages.where("conv_id is null or turn is null").select(*columns, text.alias("text"))
    return joined.select(*columns, F.concat(quoted, text).alias("text")).unionByName(rest)


def replies(messages: DataFrame) -> DataFrame:
    """conv_id, turn, reply_to for messages with a quotation that is found.

    messages: conv_id, turn, text; rows without conv_id or turn take no part, a null text is empty, repeated rows are
    one message, an empty table gives no rows. Of the earlier messages that a message quotes, it replies to the one at
    the outermost level, then with the most quoted letters, then the latest. A passage's original is the first turn
    that has it as its own.
    """
    keyed = messages.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    quotes_any = keyed.where(F.col("text").contains(">"))
    if quotes_any.isEmpty():
        return messages.sparkSession.createDataFrame([], "conv_id long, turn long, reply_to long")
    kind = "conv_id long, turn long, level int, hash binary, size int"
    quotes = quotes_any.mapInArrow(_passages, kind).where("level > 0").distinct()
    # only conversations with quotes need their originals
    own = keyed.join(quotes_any.select("conv_id").distinct(), "conv_id", "left_semi").mapInArrow(_passages, kind).where("level = 0")
    first = own.groupBy("conv_id", "hash").agg(F.min("turn").alias("reply_to"))
    found = quotes.join(first, ["conv_id", "hash"]).where("reply_to < turn")
    weights = found.groupBy("conv_id", "turn", "level", "reply_to").agg(F.sum("size").alias("size"))
    best = weights.groupBy("conv_id", "turn").agg(F.max(F.struct(-F.col("level"), "size", "reply_to")).alias("best"))
    return best.select("conv_id", "turn", F.col("best.reply_to").alias("reply_to"))


def threads(links: DataFrame) -> DataFrame:
    """conv_id, turn, root for each reply (conv_id, turn, reply_to): where the links lead in the end.

    A reply has one earlier message above it, so paths double in length with each round. No links give no rows.
    """
    at = cut(links.select("conv_id", "turn", F.col("reply_to").alias("root")))
    while True:
        up = at.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("above"))
        after = cut(at.join(up, ["conv_id", "root"], "left").select("conv_id", "turn", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")))
        at = after.drop("moved")
        if after.where("moved").isEmpty():
            return at


def reply_ordered(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, reply_to, thread, position, text, rendered: one row a message.

    messages: conv_id, turn, role, text; other columns are ignored. `thread` is the first turn that the links
    lead to, `position` counts a conversation's messages from 0 by thread, then turn (then role and text, for
    repeated turns): a reply comes after what it replies to. `text` is without quotes, `rendered` has the role's
    tag before it. A null text is empty, a null role "user"; rows without conv_id or turn link to nothing and
    are ordered among themselves. An empty table gives none. A very long conversation is cut into ranges, whose
    counts are added up: no task holds it.
    """

    @F.arrow_udf("string")
    def own_texts(texts: pa.Array) -> pa.Array:
        return pa.array([own_text(t) for t in texts.to_pylist()], pa.string())

    text = F.coalesce(F.col("text"), F.lit(""))
    with Scratch(messages.sparkSession) as scratch:
        plain = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("user")).alias("role"), text.alias("text"))
        links = scratch.table(replies(plain), "links")
        roots = threads(links)
        whole = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
        full = plain.where(whole).join(links, ["conv_id", "turn"], "left").join(roots, ["conv_id", "turn"], "left")
        # rows without a key would all wait in one task of the joins
        full = full.unionByName(plain.where(~whole).withColumns({"reply_to": F.lit(None).cast("long"), "root": F.lit(None).cast("long")}))
        full = full.withColumn("thread", F.coalesce("root", "turn")).drop("root")
        full = full.withColumn("text", F.when(F.col("text").contains(">"), own_texts("text")).otherwise(F.col("text")))
        full = full.withColumn("mark", F.xxhash64("role", "text"))
        order = ["conv_id", "thread", "turn", "mark"]
        ranged = scratch.table(full.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranged")
        counts = ranged.groupBy("conv_id", "range").agg(F.count("*").alias("n"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        counts = counts.select(F.col("conv_id").alias("_conv"), F.col("range").alias("_range"), before.alias("before"))
        inside = F.row_number().over(Window.partitionBy("range", "conv_id").orderBy("thread", "turn", "mark", "text"))
        placed = ranged.withColumn("inside", inside).join(counts, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("range") == F.col("_range")))
        position = (F.col("before") + F.col("inside") - 1).cast("long")
        rendered = F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text")
        return scratch.result(placed.select("conv_id", "turn", "role", "reply_to", "thread", position.alias("position"), "text", rendered.alias("rendered")))


def assemble(ordered: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """conv_id, part, messages, text: each conversation's rendered messages, `chunk` to a part.

    ordered: what `reply_ordered` gives. Rows without conv_id are one conversation; an empty table gives no rows.
    """
    parts = ordered.groupBy("conv_id", F.floor(F.col("position") / chunk).alias("part"))
    lines = F.array_sort(F.collect_list(F.struct("position", "rendered")))
    return parts.agg(F.count("*").alias("messages"), lines.alias("lines")).select("conv_id", "part", "messages", F.array_join(F.col("lines.rendered"), "\n").alias("text"))
