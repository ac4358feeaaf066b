"""Row numbers within groups that stay parallel when one group is huge.

``Window.partitionBy(g).orderBy(o)`` sends every row of a group to one task;
if one document holds a third of all pages, that task holds a third of the
data.  ``rank_within`` instead sorts globally with range partitioning (the
sampled bounds cut a hot group into many tasks), numbers rows inside each
task, and adds the count of the group's rows held by earlier tasks.  The only
per-group window runs over one row per (group, task) pair.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.session import ensure_checkpoint_dir


def _num_partitions(df: DataFrame) -> int:
    spark = df.sparkSession
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_per_group(rows: DataFrame, per_group: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join one row per group (e.g. a ``groupBy(keys)`` aggregate) onto ``rows``.

    AQE splits a hot group's rows across tasks only when Spark itself
    shuffles both join sides for the join.  An aggregate on ``keys`` is
    already partitioned by them, so a plain equi-join would reuse that and
    the hot group would stay in one task.  Here the keys are matched
    null-safely (``<=>``, with NULL keys of ``rows`` matching nothing, as
    in an equi-join): the same matches, and a fresh shuffle on both sides.
    """
    side = per_group
    cond = None
    for k in keys:
        side = side.withColumnRenamed(k, f"_pg_{k}")
        c = F.col(k).isNotNull() & F.col(k).eqNullSafe(F.col(f"_pg_{k}"))
        cond = c if cond is None else cond & c
    return rows.join(side, cond, how).drop(*[f"_pg_{k}" for k in keys])


def rank_within(
    df: DataFrame,
    group_cols: Sequence[str],
    order_cols: Sequence[Column | str],
    out: str = "rank",
    num_partitions: int | None = None,
) -> DataFrame:
    """Add ``out`` = 1-based position of each row within its group by ``order_cols``.

    One plan for groups of every size: rows are range-partitioned by group and
    order, so a hot group is spread over many tasks; each task numbers its
    rows, and one row per (group, task) gives the offsets.  NULL groups are
    groups like any other.

    ``order_cols`` must make the order total (end them with a unique key) so
    that a task retry numbers rows the same way.  The sorted, numbered rows are
    written once with ``checkpoint()`` (to the session's checkpoint folder):
    the per-task counts and the rows themselves must come from the very same
    partitioning, and two separate evaluations of a range exchange may sample
    different bounds.
    """
    order = [F.col(o) if isinstance(o, str) else o for o in order_cols]
    keys = [F.col(g) for g in group_cols]
    ordered = (
        df.repartitionByRange(num_partitions or _num_partitions(df), *keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_pw_task", F.spark_partition_id())
        .withColumn("_pw_pos", F.monotonically_increasing_id())
    )
    ensure_checkpoint_dir(df.sparkSession)
    ordered = ordered.checkpoint(eager=True)
    segments = ordered.groupBy(*group_cols, "_pw_task").agg(
        F.min("_pw_pos").alias("_pw_first"), F.count(F.lit(1)).alias("_pw_n")
    )
    earlier = Window.partitionBy(*group_cols).orderBy("_pw_task").rowsBetween(
        Window.unboundedPreceding, -1
    )
    segments = segments.withColumn("_pw_offset", F.coalesce(F.sum("_pw_n").over(earlier), F.lit(0)))
    side = segments.select(
        *[F.col(g).alias(f"_pw_g{i}") for i, g in enumerate(group_cols)], F.col("_pw_task").alias("_pw_t"), "_pw_first", "_pw_offset"
    )
    match = F.col("_pw_task") == F.col("_pw_t")
    for i, g in enumerate(group_cols):
        match = match & F.col(g).eqNullSafe(F.col(f"_pw_g{i}"))
    ranked = ordered.join(side, match)
    position = F.col("_pw_pos") - F.col("_pw_first") + F.col("_pw_offset") + 1
    return ranked.select(*[c for c in df.columns if c != out], position.cast("bigint").alias(out))


def running_total(df: DataFrame, order_cols: Sequence[Column | str], value_col: str, out: str = "total",
                  num_partitions: int | None = None, group_cols: Sequence[str] = ()) -> DataFrame:
    """Add ``out`` = the sum of ``value_col`` over all rows up to and with each row, in the order of ``order_cols``.

    With ``group_cols`` every group has its own sums (NULL groups are groups).
    A prefix sum in two steps: rows are range-partitioned and sorted, each task
    adds up its own, and one row per (group, task) gives the sums of earlier
    tasks.  ``order_cols`` must make the order total; the sorted rows are
    written once with ``checkpoint()``, as in ``rank_within``.  NULL values
    count as 0.
    """
    order = [F.col(o) if isinstance(o, str) else o for o in order_cols]
    keys = [F.col(g) for g in group_cols]
    ordered = (
        df.repartitionByRange(num_partitions or _num_partitions(df), *keys, *order).sortWithinPartitions(*keys, *order)
        .withColumn("_pw_task", F.spark_partition_id()).withColumn("_pw_pos", F.monotonically_increasing_id())
    )
    ensure_checkpoint_dir(df.sparkSession)
    ordered = ordered.checkpoint(eager=True)
    value = F.coalesce(F.col(value_col), F.lit(0))
    sums = ordered.groupBy(*group_cols, "_pw_task").agg(F.sum(value).alias("_pw_sum"))
    # Without groups this window has one row per task.
    earlier = Window.partitionBy(*group_cols).orderBy("_pw_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *[F.col(g).alias(f"_pw_g{i}") for i, g in enumerate(group_cols)], F.col("_pw_task").alias("_pw_t"),
        F.coalesce(F.sum("_pw_sum").over(earlier), F.lit(0)).alias("_pw_offset"))
    here = Window.partitionBy(*group_cols, "_pw_task").orderBy("_pw_pos").rowsBetween(Window.unboundedPreceding, 0)
    local = ordered.withColumn("_pw_local", F.sum(value).over(here))
    match = F.col("_pw_task") == F.col("_pw_t")
    for i, g in enumerate(group_cols):
        match = match & F.col(g).eqNullSafe(F.col(f"_pw_g{i}"))
    return local.join(offsets, match).select(*[c for c in df.columns if c != out], (F.col("_pw_offset") + F.col("_pw_local")).alias(out))
