"""Token-budget batching: greedy fill of pages into requests.

Rule (stated as a TODO in the reference, built here): pages are taken in
order; a page joins the current batch while the batch's token sum stays within
``max_tokens`` and it holds fewer than ``max_pages`` pages; otherwise it opens
a new batch.  A page above the budget on its own forms a batch of one.

The fill is sequential within a document, but only the open batch crosses a
boundary, and it started at most ``max_pages - 1`` pages earlier.  So a
document's pages, ranked by page number, are cut into segments of ``SEGMENT``
pages.  Each segment works out, for every number of pages that the open batch
may already hold, how many batches it opens and how many pages its last one
holds.  Following these small tables is a composition, so they are composed in
a tree, ``FAN`` at a time, and the state at each segment's start comes back down
the tree; then every segment numbers its own pages.  One plan for documents of
every size; no row holds more than ``SEGMENT`` pages or ``FAN`` tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.jsonfn import compute_once
from pagewright.operators.ranking import rank_within
from pagewright.session import ensure_checkpoint_dir

SEGMENT = 128  # pages
FAN = 128  # tables composed into one


def _opens(acc: Column, t: Column, max_tokens: int, max_pages: int) -> Column:
    return (acc["cnt"] == 0) | (acc["used"] + t > max_tokens) | (acc["cnt"] >= max_pages)


def _segment_table(max_tokens: int, max_pages: int) -> Column:
    """``array<struct<cnt, used, opened>>``: entry ``j`` for an open batch of ``j`` pages before the segment."""

    def step(acc, x):
        new = _opens(acc, x["t"], max_tokens, max_pages)
        return F.struct(
            F.when(new, F.lit(1)).otherwise(acc["cnt"] + 1).cast("int").alias("cnt"),
            F.when(new, x["t"]).otherwise(acc["used"] + x["t"]).alias("used"),
            (acc["opened"] + F.when(new, 1).otherwise(0)).cast("bigint").alias("opened"),
        )

    zero = F.lit(0).cast("bigint")
    entries = []
    for j in range(max_pages + 1):
        used = _sum_of_last("_prev", j)
        init = F.struct(F.lit(j).alias("cnt"), used.alias("used"), zero.alias("opened"))
        end = F.aggregate("_cur", init, step)
        if j:  # a document's first segment starts without an open batch
            end = F.when(F.col("_seg") > 0, end)
        entries.append(end)  # the struct as it is: taking it apart would fold twice
    return F.array(*entries)


def _segment_starts(tables: DataFrame, max_pages: int) -> DataFrame:
    """``(_d, _i, _start)``: pages in the open batch and batches opened before each table of ``_d, _i, _table``.

    Following tables one after another is a composition, so ``FAN`` neighbours
    are composed into one table, those again, until a document has one.  Then
    the starts go back down: a composed table's start is that of its first
    part, and gives the starts of the others.  A row holds ``FAN`` tables at
    most, however many a document has; a level divides them by ``FAN``.
    """
    def composed(kids: Column, j: int) -> Column:
        def step(acc, k):
            e = F.get(k["t"], acc["cnt"])
            return F.struct(e["cnt"].alias("cnt"), e["used"].alias("used"), (acc["opened"] + e["opened"]).alias("opened"))

        zero = F.lit(0).cast("bigint")
        return F.aggregate(kids, F.struct(F.lit(j).alias("cnt"), zero.alias("used"), zero.alias("opened")), step)

    def walk(acc, k):
        e = F.get(k["t"], acc["cnt"])
        here = F.struct(k["i"].alias("i"), F.struct(acc["cnt"].alias("cnt"), acc["b"].alias("b")).alias("s"))
        return F.struct(e["cnt"].alias("cnt"), (acc["b"] + e["opened"]).alias("b"), F.concat(acc["out"], F.array(here)).alias("out"))

    last = tables.agg(F.max("_i")).first()[0]
    levels, level = [], tables
    while True:
        kids = F.array_sort(F.collect_list(F.struct(F.col("_i").alias("i"), F.col("_table").alias("t"))))
        level = level.groupBy("_d", F.floor(F.col("_i") / FAN).alias("_up")).agg(kids.alias("_kids"))
        levels.append(level)
        if last is None or last < FAN:
            break
        last //= FAN
        level = level.select("_d", F.col("_up").alias("_i"), F.array(*[composed(F.col("_kids"), j) for j in range(max_pages + 1)]).alias("_table"))
    begin = F.struct(F.lit(0).alias("cnt"), F.lit(0).cast("bigint").alias("b"))
    starts = levels[-1].select("_d", F.col("_up").alias("_i"), begin.alias("_start"))
    for level in reversed(levels):
        known = starts.select(F.col("_d").alias("_kd"), F.col("_i").alias("_ki"), "_start")
        both = level.join(known, F.col("_d").eqNullSafe(F.col("_kd")) & (F.col("_up") == F.col("_ki")))
        init = F.struct(F.col("_start.cnt").alias("cnt"), F.col("_start.b").alias("b"),
                        F.array().cast("array<struct<i:bigint,s:struct<cnt:int,b:bigint>>>").alias("out"))
        walked = compute_once(both, _walked=F.aggregate("_kids", init, walk)["out"])
        starts = walked.select("_d", F.explode("_walked").alias("_w")).select("_d", F.col("_w.i").alias("_i"), F.col("_w.s").alias("_start"))
    return starts


def _sum_of_last(col: str, j: Column | int) -> Column:
    """Tokens of the last ``j`` pages in ``col``."""
    j = F.lit(j) if isinstance(j, int) else j
    size = F.size(col)
    last = F.slice(F.col(col), F.greatest(size - j + 1, F.lit(1)), j)
    return F.aggregate(last, F.lit(0).cast("bigint"), lambda acc, x: acc + x["t"])


def budget_batches(pages: DataFrame, max_tokens: int, max_pages: int = 10, doc: str = "doc",
                   page: str = "page_no", tokens: str = "tokens") -> DataFrame:
    """Per page ``(doc, page, tokens, batch_no)`` by greedy token-budget fill.

    Pages are taken in the order of ``page``, whatever numbers are missing (a
    selection of pages is batched as it stands).  A NULL token count fills
    nothing; a NULL document is a document like any other.
    """
    src = pages.select(
        F.col(doc).alias("_d"), F.col(page).alias("_p"), F.col(tokens).cast("bigint").alias("_o"),
        F.coalesce(F.col(tokens).cast("bigint"), F.lit(0)).alias("_t"),
    )
    ranked = rank_within(src, ["_d"], ["_p", "_t"], "_k").withColumn("_seg", F.floor((F.col("_k") - 1) / SEGMENT))
    own = ranked.withColumn("_own", F.lit(True))
    # The last pages of a segment are what an open batch may hold at the next one's start.
    back = -(-max_pages // SEGMENT)
    tail = ranked.withColumn("_next", F.explode(F.sequence(F.lit(1), F.lit(back))))
    tail = tail.withColumn("_seg", F.col("_seg") + F.col("_next")).where(F.col("_seg") * SEGMENT - F.col("_k") < max_pages)
    rows = own.unionByName(tail.drop("_next").withColumn("_own", F.lit(False)))
    item = F.struct(F.col("_k").alias("k"), F.col("_p").alias("p"), F.col("_t").alias("t"), F.col("_o").alias("o"))
    segments = rows.groupBy("_d", "_seg").agg(
        F.array_sort(F.collect_list(F.when(F.col("_own"), item))).alias("_cur"),
        F.array_sort(F.collect_list(F.when(~F.col("_own"), item))).alias("_prev"),
    ).where(F.size("_cur") > 0).withColumn("_table", _segment_table(max_tokens, max_pages))
    ensure_checkpoint_dir(pages.sparkSession)
    segments = segments.checkpoint()

    starts = _segment_starts(segments.select("_d", F.col("_seg").alias("_i"), "_table"), max_pages)
    starts = starts.select(F.col("_d").alias("_d2"), F.col("_i").alias("_s2"), "_start")

    def number(acc, x):
        new = _opens(acc, x["t"], max_tokens, max_pages)
        b = acc["b"] + F.when(new, 1).otherwise(0)
        return F.struct(
            F.when(new, F.lit(1)).otherwise(acc["cnt"] + 1).cast("int").alias("cnt"),
            F.when(new, x["t"]).otherwise(acc["used"] + x["t"]).alias("used"), b.cast("bigint").alias("b"),
            F.concat(acc["bs"], F.array(b.cast("bigint"))).alias("bs"),
        )

    joined = segments.drop("_table").join(starts, F.col("_d").eqNullSafe(F.col("_d2")) & (F.col("_seg") == F.col("_s2")))
    init = F.struct(F.col("_start.cnt").alias("cnt"), _sum_of_last("_prev", F.col("_start.cnt")).alias("used"),
                    F.col("_start.b").alias("b"), F.array().cast("array<bigint>").alias("bs"))
    numbered = joined.select("_d", "_cur", F.aggregate("_cur", init, number)["bs"].alias("_bs"))
    z = numbered.select("_d", F.explode(F.arrays_zip(F.col("_cur").alias("x"), F.col("_bs").alias("b"))).alias("_z"))
    return z.select(F.col("_d").alias(doc), F.col("_z.x.p").alias(page), F.col("_z.x.o").alias(tokens), F.col("_z.b").alias("batch_no"))


def batch_totals(assigned: DataFrame, doc: str = "doc", page: str = "page_no", tokens: str = "tokens") -> DataFrame:
    """``(doc, batch_no, start_page, end_page, n_pages, tokens)`` per batch."""
    return assigned.groupBy(doc, "batch_no").agg(
        F.min(page).alias("start_page"),
        F.max(page).alias("end_page"),
        F.count(F.lit(1)).cast("bigint").alias("n_pages"),
        F.sum(tokens).cast("bigint").alias("tokens"),
    )
