"""Mixing sources to target weights by a low-discrepancy schedule.

The slots of the mix are the points of a golden-ratio sequence, mapped through the sources' cumulative shares: at any length the
mix is within a few slots of its targets. A source's slots are ranked in schedule order; its documents, shuffled by a keyed hash,
lie end to end on a line of words that repeats, and the r-th slot takes the r-th block of that line. A source gets the slots that
points fell on, no more and no fewer, and the mix is read in the order of its slots. Ranks and places on the line are running sums
over many small ranges, never over a whole source in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.shared import small_side, stored, tasks

#: The fractional part of the golden ratio.
GOLDEN = 0.6180339887498949
#: Words of a slot's block, and the slots that a small mix has at least: the schedule grows with the corpus, blocks do not.
BLOCK, LEAST_SLOTS = 256, 1 << 16
#: Cells of [0, 1) by which points meet the sources whose share reaches into theirs.
CELLS = 1024
#: Rows of a range whose running sums one task makes.
RANGE_ROWS = 20_000


def sizes(docs: DataFrame) -> DataFrame:
    """``docs`` with ``size``, the words of its text (runs of other characters than 0x20 and 0x09 to 0x0D; null: 0)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumn("size", F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"))


def targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size, weight, target): sources by code point, null last, weigh ``weights`` over and over.

    Targets share all words by weight, but stop at ``most`` times a source's size; the excess goes to the others by weight. The
    source with the least ``most * size / weight`` stops first, so the level of the others follows from running sums.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(place - 1, F.lit(len(weights))).cast("int") + 1)
    by = by.withColumn("weight", weight.cast("double")).withColumn("cap", (most * F.col("source_size")).cast("double"))
    by = by.withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
    by = by.withColumn("level", level).withColumn("free", F.col("level") <= F.col("ratio"))
    level = F.min(F.when(F.col("free"), F.struct("ratio", "level"))).over(everything)["level"]
    target = F.when(F.col("ratio") < F.coalesce(level, F.col("ratio")), F.col("cap")).otherwise(F.coalesce(level, F.lit(0.0)) * F.col("weight"))
    return by.select("source", "source_size", "weight", F.least(target, F.col("cap")).alias("target"))


def running(df: DataFrame, by: str, order: list[str], value: str, out: str, ranges: str) -> DataFrame:
    """Adds the sum of ``value`` over the rows before, within ``by``; ``ranges`` numbers ranges that follow ``order``."""
    parts = df.groupBy(by, ranges).agg(F.sum(value).alias("_part"))
    before = Window.partitionBy(by).orderBy(ranges).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col(by).alias("_by"), F.col(ranges).alias("_range"), F.coalesce(F.sum("_part").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(by, ranges).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (df.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
            .join(parts, (F.col(by) == F.col("_by")) & (F.col(ranges) == F.col("_range")))
            .withColumn(out, F.col("_base") + F.col("_inside")).drop("_by", "_range", "_base", "_inside"))


def slots(goals: DataFrame, count: int) -> DataFrame:
    """(slot, place, rank): the schedule. ``goals``: place, and the source's share of [0, 1), from ``low`` to ``high``."""
    points = goals.sparkSession.range(count).withColumn("point", F.col("id") * GOLDEN - F.floor(F.col("id") * GOLDEN))
    points = points.withColumn("cell", F.floor(F.col("point") * CELLS).cast("long"))
    cells = F.sequence(F.floor(F.col("low") * CELLS).cast("long"), F.floor(F.col("high") * CELLS).cast("long"))
    spread = stored(goals.where("high > low").select("place", "low", "high", F.explode(cells).alias("cell")), "cells")
    points = points.join(small_side(spread), "cell").where("point >= low and point < high")
    points = points.withColumn("one", F.lit(1)).withColumn("range", F.floor(F.col("id") / RANGE_ROWS))
    ranked = running(points, "place", ["id"], "one", "rank", "range")
    return stored(ranked.select(F.col("id").alias("slot"), "place", F.col("rank").cast("long").alias("rank")), "slots")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 11, block: int | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, slot, first, taken): what each slot takes of each document.

    ``first`` is the first word taken, ``taken`` their number; a document that no slot takes has one row with a null slot and
    0 taken. A source's words taken are those of the slots that the schedule gives it, a few blocks of ``block`` words from its
    target; a document is taken at most ``most`` times. Null texts have no words, null sources are one source, repeated rows lie
    on the line one after the other; an empty table gives an empty table. The same rows give the same mix, whatever their order
    and partitions.
    """
    sized = stored(sizes(docs.select("doc_id", "source", "text")).select(
        "doc_id", "source", "size", F.xxhash64("text").alias("text_hash")), "sizes")
    goals = stored(targets(sized, weights, most), "targets")
    total = goals.agg(F.sum("source_size")).first()[0] or 0
    block = block or max(1, min(BLOCK, total // LEAST_SLOTS))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    goals = goals.withColumn("place", F.row_number().over(order) - 1)
    goals = goals.withColumn("high", F.sum("target").over(order.rowsBetween(Window.unboundedPreceding, 0)) / max(total, 1))
    goals = stored(goals.withColumn("low", F.lag("high", 1, 0.0).over(order)), "shares")
    plan = slots(goals, -(-total // block))
    given = plan.groupBy("place").agg((F.count("*") * block).alias("given"))
    goals = goals.join(F.broadcast(given), "place", "left")  # a row per source
    goals = stored(goals.withColumn("words", F.least(F.coalesce("given", F.lit(0)), most * F.col("source_size"))), "goals")
    ranges = max(1, sized.count() // RANGE_ROWS)
    named = small_side(goals.select(F.col("source").alias("_source"), "place", "source_size", "target", "words"))
    lined = sized.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    lined = lined.withColumn("shuffled", F.xxhash64(F.lit(seed), "doc_id", "text_hash"))
    lined = lined.withColumn("range", F.floor((F.col("shuffled").cast("double") / 2.0**64 + 0.5) * ranges))
    keys = ["shuffled", F.col("doc_id").asc_nulls_last(), "text_hash", "size"]
    lined = stored(running(lined, "place", keys, "size", "start", "range"), "lines")
    whole = lined.where("size > 0 and words > 0").withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    whole = whole.withColumn("from", F.col("turn") * F.col("source_size") + F.col("start")).where(F.col("from") < F.col("words"))
    whole = whole.withColumn("until", F.least(F.col("from") + F.col("size"), F.col("words")))
    pieces = whole.withColumn("rank", F.explode(F.sequence(F.expr(f"`from` div {block}"), F.expr(f"(until - 1) div {block}"))))
    pieces = pieces.join(plan, ["place", "rank"])
    low, high = F.greatest(F.col("from"), F.col("rank") * block), F.least(F.col("until"), (F.col("rank") + 1) * block)
    columns = ["doc_id", "text_hash", "source", "size", "source_size", "target", "start", "turn"]
    pieces = pieces.select(*columns, "slot", (low - F.col("from")).alias("first"), (high - low).alias("taken"))
    none = lined.where((F.col("size") == 0) | (F.col("words") == 0) | (F.col("start") >= F.col("words"))).withColumn("turn", F.lit(0))
    return pieces.unionByName(none.select(*columns, F.lit(None).cast("long").alias("slot"), F.lit(0).cast("long").alias("first"),
                                          F.lit(0).cast("long").alias("taken")))


def taken(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 11) -> DataFrame:
    """(doc_id, size, source_size, target, taken, slot), one row per row of ``docs``; ``slot`` is the first one that takes it."""
    found = mix(docs, weights, most, seed)
    columns = ["doc_id", "size", "source_size", "target", "taken", "slot"]
    own = found.where("slot is not null").groupBy("doc_id", "text_hash", "source", "start").agg(
        F.first("size").alias("size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"),
        F.sum("taken").alias("taken"), F.min("slot").alias("slot"))
    return own.select(columns).unionByName(found.where("slot is null").select(columns))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 11) -> DataFrame:
    """The mix as documents: a row of ``docs`` for each turn in which slots take it, in the order of the first such slot.

    A text that the last slot cuts holds its first words, joined by spaces, and ``n_chars`` is set anew if there is one. Rows are
    carried whole, so columns of any name keep their values.
    """
    found = mix(docs, weights, most, seed).where("slot is not null").groupBy("doc_id", "text_hash", "source", "start", "turn").agg(
        F.sum("taken").alias("taken"), F.first("size").alias("size"), F.min("slot").alias("slot"))
    # equal rows: each has its own place on the line, and any of them may stand for any other
    same = Window.partitionBy("doc_id", "text_hash", "source").orderBy("start")
    found = found.withColumn("copy", F.dense_rank().over(same)).drop("start", "turn").withColumnsRenamed(
        {"doc_id": "id", "source": "from", "text_hash": "hash"})
    found = stored(found, "taken")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.withColumn("row_hash", F.xxhash64("row.text"))
    met = F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.col("row_hash") == F.col("hash")) & F.col("row.source").eqNullSafe(F.col("from"))
    if not found.where("copy > 1").isEmpty():  # only then are equal rows to be told apart, which deals out all texts once more
        rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("row.doc_id", "row_hash", "row.source").orderBy(F.lit(0))))
        met = met & (F.col("n") == F.col("copy"))
    rows = rows.join(found, met)
    whole = F.col("taken") == F.col("size")
    cut = F.array_join(F.slice(F.regexp_extract_all("row.text", F.lit(r"([^\x20\x09-\x0D]+)")), F.lit(1), F.col("taken").cast("int")), " ")
    text = F.when(whole, F.col("row.text")).otherwise(cut)
    values = {c: F.col(f"row.`{c}`") for c in docs.columns} | {"text": text}
    if "n_chars" in docs.columns:
        values["n_chars"] = F.when(whole, F.col("row.n_chars")).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType))
    ordered = rows.repartitionByRange(tasks(docs.sparkSession), "slot").sortWithinPartitions("slot")
    return ordered.select([v.alias(c) for c, v in values.items()])
