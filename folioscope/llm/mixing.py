"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every document of a source is a packet of as many words as it has. Packets of a source are
served in a shuffled order that depends on the document alone (an MD5 of id and seed), each
source at a rate in proportion to its target; a packet's virtual finish time is what its
source has sent by then, divided by the target. Packets of all sources are range-sorted by
that time and taken until the budget is used up. A source whose target is above its size
sends its documents twice, in the same order.

No source or bucket is gathered in one task: running sums are taken inside buckets (of the
shuffled order, then of virtual time), and over a table of bucket totals that has a bounded
number of rows for each source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of the sources in code point order (null last), repeating.
WEIGHTS = (3, 1, 2)
#: What the mix takes, as a share of all words, and how often it may take a document.
BUDGET, REPEATS = 1.5, 2
#: Documents that a range of running sums should have at most, and the bits of the least and
#: the largest number of ranges.
RANGE_ROWS, RANGE_BITS = 20_000, (8, 16)
#: Tasks that the packets of a step may be dealt to.
SALTS = 256
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS) -> DataFrame:
    """For a table (source, source_size) of one row a source: source_weight and target.

    Sharing the budget by weight, and what is above a cap again among the rest, ends where
    each target is min(cap, weight * level). The level is found by one sort on cap / weight:
    the sources that stop at their caps are a prefix of that order. The table has a row for
    each source, so the two windows without a partition key are over that many rows.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.select("source", "source_size", pick.cast("long").alias("source_weight")).withColumn("cap", F.col("source_size") * F.lit(repeats))
    order = Window.orderBy(F.col("cap") / F.col("source_weight"), F.col("source").isNull(), "source")
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    t = t.withColumns(
        {
            "capped": F.coalesce(F.sum("cap").over(before), F.lit(0)),
            "open_weight": F.sum("source_weight").over(whole) - F.coalesce(F.sum("source_weight").over(before), F.lit(0)),
            "words": F.sum("source_size").over(whole),
        }
    )
    level = (F.col("words") * F.lit(float(budget)) - F.col("capped")) / F.col("open_weight")
    #: The first source in order whose cap holds its share sets the level for all after it.
    t = t.withColumn("level", F.when(F.col("source_weight") * level <= F.col("cap"), level))
    t = t.withColumn("level", F.first("level", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return t.select("source", "source_size", "source_weight", F.coalesce(F.col("source_weight") * F.col("level"), F.col("cap").cast("double")).alias("target"))


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS, seed: int = 17) -> DataFrame:
    """One row for each row of docs: doc_id, size, source, source_size, target, copies, taken.

    copies is how often the mix has the document (0 to `repeats`), taken its words in it.
    Null text: size 0. Null source: a source of its own, last. Empty documents cost nothing;
    they go with the packet they follow. Rows that are alike in all of doc_id, source and size
    are interchangeable and are queued one after the other. An empty table gives an empty one.
    """
    base = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").cast("string").alias("source"), word_count(F.col(f"`{text}`")).alias("size"))
    bits = min(RANGE_BITS[1], max(RANGE_BITS[0], math.ceil(math.log2(max(1, docs.count()) / RANGE_ROWS))))
    #: Slots of the shuffled order: each has about a 256th or less of even the largest source.
    base = base.withColumn("tag", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}"))))
    base = base.withColumn("slot", F.shiftright(F.conv(F.substring("tag", 1, 4), 16, 10).cast("int"), 16 - bits))
    totals = base.groupBy("source", "slot").agg(F.sum("size").alias("slot_size"), F.count("*").alias("slot_rows"))
    sizes = targets(totals.groupBy("source").agg(F.sum("slot_size").alias("source_size")), weights, budget, repeats)
    by_source = Window.partitionBy("source").orderBy("slot")
    starts = totals.withColumn("slot_start", F.sum("slot_size").over(by_source) - F.col("slot_size"))
    starts = starts.join(sizes, starts["source"].eqNullSafe(sizes["source"])).select(starts["source"].alias("s"), F.col("slot").alias("k"), "slot_start", "source_size", "source_weight", "target")
    placed = base.join(starts, base["source"].eqNullSafe(F.col("s")) & (base["slot"] == F.col("k"))).drop("s", "k")
    within = Window.partitionBy("source", "slot").orderBy("tag", "doc_id", "size")
    placed = placed.withColumn("n", F.row_number().over(within)).withColumn("sent", F.col("slot_start") + F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    packets = placed.withColumn("copy", F.explode(F.array(*[F.lit(i) for i in range(repeats)])))
    packets = packets.withColumn("finish", F.when(F.col("target") > 0, (F.col("sent") + F.col("copy") * F.col("source_size")) / F.col("target")).otherwise(F.lit(0.0)))
    #: Virtual time runs evenly in words, so equal steps of it are even ranges. Packets that end
    #: well before the budget can be used up, or well after, need no exact place in line.
    steps = 4 << bits
    packets = packets.withColumn("step", F.least(F.floor(F.col("finish") * steps), F.lit(steps * repeats * 2)).cast("int"))
    line = Window.orderBy("step")
    ranges = packets.groupBy("step").agg(F.sum("size").alias("step_size"))
    goal = sizes.agg(F.floor(F.sum("source_size") * F.lit(float(budget))).alias("goal"))
    ranges = ranges.withColumn("step_start", F.sum("step_size").over(line) - F.col("step_size")).crossJoin(F.broadcast(goal)).select(F.col("step").alias("q"), "step_start", "step_size", "goal")
    #: A step that ends before the budget does goes in whole, one that begins after it not at all; only
    #: in the one where it ends does a packet's place in line matter. The packets of all others are
    #: dealt out by a salt, so a step that very many late or empty packets share is no single task.
    line_up = packets.join(F.broadcast(ranges), packets["step"] == F.col("q"))
    edge = (F.col("step_start") <= F.col("goal")) & (F.col("step_start") + F.col("step_size") > F.col("goal"))
    line_up = line_up.withColumn("edge", edge).withColumn("salt", F.when(F.col("edge"), 0).otherwise(1 + F.pmod(F.xxhash64("tag", "n", "copy"), F.lit(SALTS))))
    ahead = Window.partitionBy("step", "salt").orderBy("finish", "tag", "doc_id", "source", "size", "n", "copy").rowsBetween(Window.unboundedPreceding, 0)
    used = F.when(F.col("edge"), F.col("step_start") + F.sum("size").over(ahead)).otherwise(F.col("step_start"))
    kept = line_up.withColumn("in", (used <= F.col("goal")).cast("int"))
    out = kept.groupBy("doc_id", "source", "size", "slot", "n").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.sum("in").cast("int").alias("copies"))
    return out.select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("size") * F.col("copies")).cast("long").alias("taken"))
