"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.operators.ranking import join_per_group
from pagewright.session import ensure_checkpoint_dir

# White space that separates words wherever a contract counts words.
WORD = r"[^\x20\x09-\x0D]+"


def ship() -> None:
    """Send this package's functions to Python workers by value."""
    from pyspark import cloudpickle

    import pagewright

    if pagewright.__name__ not in cloudpickle.list_registry_pickle_by_value():
        cloudpickle.register_pickle_by_value(pagewright)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the session's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there.

    Parquet in the folder that ``spark.checkpoint.dir`` names: compressed,
    columnar, and readable by every executor after one is lost.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed(df: DataFrame) -> DataFrame:
    """All columns inside one struct ``_row``: working columns can't clash with them."""
    return df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("_row"))


def text_of(col: str | Column) -> Column:
    """The text, null as empty."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.cast("string"), F.lit(""))


def with_row_key(df: DataFrame, key: str = "_key") -> DataFrame:
    """``_row`` (all columns) and ``key``, a text that names the row: its file and its place there.

    The key comes from the parquet scan itself, so every later read of the
    same files gives the same keys, whatever the task layout.  A frame that is
    not a plain file scan is written to the shared folder first.
    """
    from pyspark.errors import AnalysisException

    def keyed(x: DataFrame) -> DataFrame:
        at = x.metadataColumn("_metadata")
        name = F.concat(F.hex(F.xxhash64(at["file_path"])), F.lit(":"), at["row_index"].cast("string"))
        return x.select(F.struct(*[x[f"`{c}`"] for c in x.columns]).alias("_row"), name.alias(key))

    try:
        out = keyed(df)
        out.schema  # noqa: B018 - resolves the plan
        return out
    except AnalysisException:
        return keyed(materialize(df, "rows"))


def crc_bucket(id_col: Column, n: int) -> Column:
    """``crc32(id as text) mod n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def rank_by_position(table: DataFrame, groups: Sequence[str], out: str) -> DataFrame:
    """Gapless ranks from 0 within ``groups`` for a written ``table`` with ``_pid, _pos``.

    ``_pid`` (partition) and ``_pos`` (position) were stored when the table
    was written.  A row's rank is the number of rows of its group in earlier
    partitions plus its place in its own, so no task ever holds more of a
    group than one input partition had, however hot the group is.
    """
    keys = [*groups, "_pid"]
    counts = table.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    local = F.row_number().over(Window.partitionBy(*keys).orderBy("_pos"))
    ranked = table.withColumn("_local", local)
    return (
        ranked.join(offsets, keys)
        .withColumn(out, (F.col("_offset") + F.col("_local") - 1).cast("long"))
        .drop("_offset", "_local")
    )


def positions(df: DataFrame) -> DataFrame:
    """Adds ``_pid, _pos`` for ``rank_by_position``; write the result before using them."""
    return df.withColumn("_pid", F.spark_partition_id()).withColumn("_pos", F.monotonically_increasing_id())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node with an edge; ``root`` is its component's smallest node.

    Alternates the large-star and small-star steps: each node's neighbours are
    linked to the smallest of them, until nothing changes.  Both steps are a
    partial ``min`` and a join whose hot nodes AQE can split; every round is
    written to the shared folder, and the driver sees one count and checksum.
    """
    from pyspark.sql import Observation

    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    e = materialize(e, "cc")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = (
            join_per_group(both, low, ["u"]).filter("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = join_per_group(large, low, ["u"]).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        seen = Observation()
        small = small.observe(seen, F.count(F.lit(1)).alias("n"),
                              F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"))
        e = materialize(small, "cc")
        state = (seen.get["n"], seen.get["s"])
        if state == before:
            break
        before = state
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def plus(schema: T.StructType, ddl: str) -> T.StructType:
    """``schema`` with the fields of ``ddl`` after it."""
    return T.StructType([*schema.fields, *T.StructType.fromDDL(ddl).fields])
