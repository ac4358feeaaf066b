"""Parquet table access with column pruning at the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None,
               spread_by: str | None = None) -> DataFrame:
    """Read ``<sf_dir>/<name>.parquet``, selecting ``columns`` at the scan.

    ``spread_by`` names a unique key; when the scan yields fewer splits than
    the session has cores (one big file with one row group), rows are hashed
    on that key over all cores before CPU-heavy per-row work.  A cluster scan
    of many files already has enough splits and gets no extra shuffle.
    """
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if columns:
        df = df.select(*columns)
    if spread_by:
        df = spread(df, spread_by)
    return df


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-partition on a unique ``key`` if the input has too few partitions."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
