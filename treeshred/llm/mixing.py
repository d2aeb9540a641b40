"""Mixing sources to target weights by weighted fair queueing; DataFrame functions only.

Every source serves its documents in a shuffled order, again from the start when it has served them all, and stops after
the last repeat. Documents are served in packets of PACKET words. A packet's virtual finish time is the words its source
has served when it ends, divided by the source's weight. Range-sorted by that time, the packets of all sources form one
queue in which each source is served in proportion to its weight; a running sum over the queue's ranges finds the place
at which the budget is served, and the queue is cut there. A source that has served all its repeats has left the queue,
and the others share what follows by weight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, partitions, prefix_sums, small, written

WEIGHTS = (5.0, 2.0, 1.0)
BUDGET, REPEATS = 1.5, 2
PACKET = 64  # words; a source ends within one packet of its target


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def targets(totals: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS) -> DataFrame:
    """Adds weight, rank and target to (source, source_size).

    Sources by code point, null last, take the weights in turn. The budget is ``budget`` times all sizes. Let a source
    be full at virtual time cap / weight: in that order the full ones are a prefix, and the cut is the time at which
    full caps and running weights together make the budget. One row a source goes through the windows.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    ranked = totals.withColumn("rank", F.row_number().over(by_name)).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") - 1) % len(weights) + 1))
    capped = ranked.withColumn("_cap", F.col("source_size") * F.lit(float(repeats))).withColumn("_full", F.col("_cap") / F.col("weight"))
    by_time = Window.orderBy("_full", F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    timed = (
        capped.withColumn("_caps", F.coalesce(F.sum("_cap").over(by_time.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_running", F.sum("weight").over(by_time.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("_all", F.sum("source_size").over(everything) * F.lit(float(budget)))
        .withColumn("_time", (F.col("_all") - F.col("_caps")) / F.col("_running"))
    )
    cut = F.max(F.when(F.col("_time") < F.col("_full"), F.col("_time"))).over(everything)
    return timed.withColumn("target", F.least("_cap", F.coalesce(F.col("weight") * cut, F.col("_cap")))).select("source", "source_size", "weight", "rank", "target")


def shuffle_key(doc_id: Column, text: Column, seed: int) -> Column:
    """A hash that any engine can repeat, of the row and the seed."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null")), F.coalesce(F.md5(text.cast("binary")), F.lit("null"))).cast("binary"))


def _served(docs: DataFrame, weights: tuple[float, ...], budget: float, repeats: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Every row with its place in its source's service, ``before``, and the queue's turns up to the cut: (rank, before, turn, words)."""
    base = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), shuffle_key(F.col("doc_id"), F.col("text"), seed).alias("h"))
    base = written(base.withColumn("place", F.conv(F.substring("h", 1, 13), 16, 10).cast("double") / float(1 << 52)), "mix")
    totals = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    shares = small(written(targets(totals, weights, budget, repeats), "targets"))
    s = shares.withColumnRenamed("source", "_s")
    queued = prefix_sums(base, "source", ["place", "h"], "size", "before")
    rows = written(queued.join(s, queued["source"].eqNullSafe(s["_s"])).drop("_s", "place"), "timed")

    # The queue: a row a packet, in ranges of virtual finish time.
    turns = rows.where("size > 0").select("rank", "before", "size", "source_size", "weight", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("turn"))
    packet = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(PACKET).cast("long")))
    packets = turns.withColumn("_p", packet).withColumn("words", F.least(F.lit(PACKET).cast("long"), F.col("size") - F.col("_p")))
    finish = (F.col("source_size") * F.col("turn") + F.col("before") + F.col("_p") + F.col("words")) / F.col("weight")
    queue = packets.select(finish.alias("finish"), "rank", "before", "turn", "words")
    ranges = partitions(docs.sparkSession)
    queue = written(queue.repartitionByRange(ranges, "finish", "rank").withColumn("range", F.spark_partition_id()), "queue")

    # Running sums: of the ranges (a row each), and inside the one range in which the budget is reached.
    along = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = queue.groupBy("range").agg(F.sum("words").alias("_in")).withColumn("_until", F.coalesce(F.sum("_in").over(along), F.lit(0)))
    total = F.floor(F.lit(float(budget)) * (totals.agg(F.sum("source_size")).first()[0] or 0)).cast("long")
    cut = F.broadcast(sums.where(F.col("_until") < total))  # a row a range
    within = queue.join(cut, "range")
    whole = within.where(F.col("_until") + F.col("_in") <= total).select("rank", "before", "turn", "words")
    order = Window.partitionBy("range").orderBy("finish", "rank").rowsBetween(Window.unboundedPreceding, -1)
    last = within.where(F.col("_until") + F.col("_in") > total).withColumn("_left", total - F.col("_until") - F.coalesce(F.sum("words").over(order), F.lit(0)))
    last = last.where("_left > 0").select("rank", "before", "turn", F.least("words", "_left").alias("words"))
    taken = whole.unionByName(last).groupBy("rank", "before", "turn").agg(F.sum("words").alias("words"))
    return rows, written(taken, "turns")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS, seed: int = 7) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, virtual_finish), a row for each row of (doc_id, text, source, ...).

    size: words, 0 for a null text. taken: words the queue serves of this document, over all its turns, before it is cut,
    in 0..repeats*size; what is in service at the cut is taken in part, by whole packets. virtual_finish: that of its
    first turn. Null and empty sources are sources of their own; repeated rows are rows of their own; without rows or
    words nothing is taken. The order within a source is a hash of doc_id, text and seed, and ties in time go by source,
    so that runs agree whatever the partitions.
    """
    rows, turns = _served(docs, weights, budget, repeats, seed)
    taken = turns.groupBy(F.col("rank").alias("_r"), F.col("before").alias("_b")).agg(F.sum("words").alias("_taken"))
    j = rows.join(taken, (F.col("rank") == F.col("_r")) & (F.when(F.col("size") > 0, F.col("before")) == F.col("_b")), "left")
    finish = (F.col("before") + F.col("size")) / F.col("weight")
    return j.select("doc_id", "source", "size", "source_size", "target", F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"), finish.alias("virtual_finish"))


def queue(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS, seed: int = 7) -> DataFrame:
    """The turns that the queue serves, a row each, globally range-sorted by virtual finish time: (doc_id, source, h,
    before, turn, size, words, virtual_finish); words may be fewer than size where the queue is cut."""
    rows, turns = _served(docs, weights, budget, repeats, seed)
    j = turns.join(rows.where("size > 0"), ["rank", "before"])
    finish = (F.col("source_size") * F.col("turn") + F.col("before") + F.col("size")) / F.col("weight")
    return j.select("doc_id", "source", "h", "before", "turn", "size", "words", finish.alias("virtual_finish"), "rank").orderBy("virtual_finish", "rank").drop("rank")
