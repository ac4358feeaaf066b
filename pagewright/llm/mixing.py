"""Mixing sources to target weights by weighted fair queueing (DataFrame functions only).

Each source's documents are shuffled by a hash of their id and queued; after
the last one the queue starts again, as often as ``max_repeats`` allows.  A
queue entry's virtual finish time is the cumulative size of its source's
queue, that entry included, over the source's target.  All entries are then
sorted by finish time and taken until the total budget (the sum of targets)
is used up.  A source's queue reaches time 1 exactly at its target, so each
source ends within about one document of it.

Scale.  Cumulative sums never gather a source: rows are range-sorted by source,
hash and row, each task adds up its own, and one row per source and task gives
the offsets, so neither a hot source nor an id that repeats is in one task.  The
global sort is cut into slices of virtual time, which is uniform over
entries by construction; slices entirely before the cut are taken, those
after it are not, and only the slice that holds the cut is sorted row by row.
The text is read once, for its size.

Per-source tables hold one row per source, a number that the mix's own list of
weights bounds; they are joined as ordinary tables that AQE broadcasts by
measured size.

Nulls: a null source is a source of its own, last in order; a null text has
size 0; a null id hashes as a value of its own.  Documents of size 0 are never
taken (they add no word).  Rows that repeat are separate entries.  A table
without any word takes nothing and has targets of 0.  An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.common import WORD, materialize, text_of, with_row_key
from pagewright.operators.ranking import running_total

WEIGHTS = (3, 1, 2)  # by position of the source, repeating
SHARE = 1.5  # of all sizes
MAX_REPEATS = 2
FINISH_SLICE = 65_536  # entries of a range of virtual time


def word_count(col: Column) -> Column:
    """Number of words in a text, null as 0."""
    return F.regexp_count(text_of(col), F.lit(WORD)).cast("long")


def source_targets(totals: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
                   max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Adds ``_rank`` and ``target`` to one row per source (``source, source_size``).

    Targets share ``share`` of all sizes by weight; each stops at
    ``max_repeats`` times its source's size, and what that cuts off is shared
    again by weight.  The fixed point is ``min(cap, level * weight)`` with one
    level for all: sorted by ``cap / weight`` the capped sources are a prefix.
    """
    so_far = (Window.unboundedPreceding, -1)
    onwards = (Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    t = totals.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    listed = F.array(*[F.lit(float(w)) for w in weights])
    t = t.withColumn("_weight", F.element_at(listed, ((F.col("_rank") - 1) % len(weights) + 1).cast("int")))
    t = t.withColumn("_cap", F.col("source_size").cast("double") * float(max_repeats))
    fill = Window.orderBy(F.col("_cap") / F.col("_weight"), "_rank")
    t = t.withColumn("_budget", F.sum("source_size").over(everything) * F.lit(min(float(share), float(max_repeats))))
    t = t.withColumn("_capped", F.coalesce(F.sum("_cap").over(fill.rowsBetween(*so_far)), F.lit(0.0)))
    t = t.withColumn("_rest", F.sum("_weight").over(fill.rowsBetween(*onwards)))
    t = t.withColumn("_level", (F.col("_budget") - F.col("_capped")) / F.col("_rest"))
    # The level holds at the first source in fill order that its cap does not stop.
    fits = F.col("_level") * F.col("_weight") <= F.col("_cap")
    first = F.min(F.when(fits, F.struct((F.col("_cap") / F.col("_weight")).alias("at"), F.col("_rank"), F.col("_level"))))
    t = t.withColumn("_free", first.over(everything))
    target = F.when(F.col("_free").isNull(), F.col("_cap")).otherwise(
        F.least("_cap", F.col("_free._level") * F.col("_weight"))
    )
    return t.select("source", "source_size", "_rows", "_rank", target.alias("target"))


def _queued(sized: DataFrame, totals: DataFrame) -> DataFrame:
    """Adds ``_cum``: the source's cumulative size in shuffled order, the row included.

    A distributed prefix sum: rows are range-sorted by source, hash and row, so
    neither a hot source nor ids that repeat (one hash) are in one task.
    """
    per_source = totals.withColumnRenamed("source", "_s")
    rows = sized.join(per_source, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    return running_total(rows, ["_hash", "_id", "size", "_key"], "size", "_cum", group_cols=["_rank"])


def _cut(queue: DataFrame, totals: DataFrame, share: float, max_repeats: int):
    """``(finish, rank, cum)`` of the first entry beyond the budget; None if all entries fit."""
    words, rows = totals.agg(F.sum("source_size"), F.sum("_rows")).first()
    if not words:
        return None
    budget = words * min(float(share), float(max_repeats))
    turns = F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1)))
    entries = queue.select("_rank", "size", "source_size", "target", "_cum", turns.alias("_turn"))
    cum = F.col("_cum") + F.col("_turn") * F.col("source_size")
    entries = entries.select("_rank", "size", cum.alias("_cum"), (cum / F.col("target")).alias("_finish"))
    slices = -(-rows * max_repeats // FINISH_SLICE)
    entries = entries.withColumn("_slice", F.floor(F.col("_finish") * slices))
    upto = (Window.unboundedPreceding, Window.currentRow)
    sums = entries.groupBy("_slice").agg(F.sum("size").alias("_sum"))
    holding = (
        sums.withColumn("_upto", F.sum("_sum").over(Window.orderBy("_slice").rowsBetween(*upto)))
        .filter(F.col("_upto") > budget).orderBy("_slice").select("_slice", F.col("_upto") - F.col("_sum")).first()
    )
    if holding is None:
        return None
    order = ["_finish", "_rank", "_cum"]
    one = entries.filter(F.col("_slice") == holding[0])
    running = F.sum("size").over(Window.orderBy(*order).rowsBetween(*upto)) + F.lit(holding[1])
    return one.withColumn("_upto", running).filter(F.col("_upto") > budget).orderBy(*order).select(*order).first()


def _mixed(sized: DataFrame, weights, share: float, max_repeats: int) -> DataFrame:
    """``sized`` is a written table ``_id, _key, source, size, _hash``; adds ``source_size, target, copies``."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    totals = materialize(source_targets(totals, weights, share, max_repeats), "mix-sources")
    queue = materialize(_queued(sized.filter("size > 0"), totals), "mix-queue")
    cut = _cut(queue, totals, share, max_repeats)
    copies = F.lit(0)
    for turn in range(max_repeats):
        cum = F.col("_cum") + F.lit(turn) * F.col("source_size")
        taken = F.lit(True)
        if cut is not None:
            here = F.struct((cum / F.col("target")).alias("f"), F.col("_rank").alias("r"), cum.alias("c"))
            taken = here < F.struct(F.lit(cut[0]).alias("f"), F.lit(cut[1]).alias("r"), F.lit(cut[2]).alias("c"))
        copies = copies + F.when(taken, 1).otherwise(0)
    cols = ["_id", "_key", "source", "size", "source_size", "target"]
    none = sized.filter("size = 0").join(
        totals.select(F.col("source").alias("_s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("_s"))
    )
    return queue.select(*cols, copies.cast("int").alias("copies")).unionByName(
        none.select(*cols, F.lit(0).alias("copies"))
    )


def _sized(rows: DataFrame, id_col: Column, source: Column, text: Column, key: Column) -> DataFrame:
    name = F.coalesce(F.concat(F.lit("k"), id_col.cast("string")), F.lit("null"))
    return materialize(rows.select(
        id_col.alias("_id"), key.alias("_key"), source.cast("string").alias("source"),
        word_count(text).alias("size"), F.md5(name.cast("binary")).alias("_hash"),
    ), "mix-sizes")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_repeats: int = MAX_REPEATS,
        id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Per document: ``id_col, source, size, source_size, target, copies`` (times taken)."""
    c = lambda name: F.col(f"_row.`{name}`")
    sized = _sized(with_row_key(docs), c(id_col), c(source_col), c(text_col), F.col("_key"))
    return _mixed(sized, weights, share, max_repeats).drop("_key").withColumnRenamed("_id", id_col)


def mixed_rows(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_repeats: int = MAX_REPEATS,
               id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it takes them."""
    rows = with_row_key(docs)
    c = lambda name: F.col(f"_row.`{name}`")
    sized = _sized(rows, c(id_col), c(source_col), c(text_col), F.col("_key"))
    plan = _mixed(sized, weights, share, max_repeats).filter("copies > 0").select("_key", "copies")
    taken = rows.join(plan, "_key").withColumn("_turn", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return taken.select("_row.*")
