"""Rescans of a folder: what was added, changed or removed since the last listing.

A file stream only ever sees additions.  Here a listing (path, length, time and,
on request, a digest of the bytes) is kept for every run and compared with the
next one by a full outer join on the path.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions.textfn import file_stem
from pagewright.session import ensure_checkpoint_dir

LISTING = "path string, length bigint, modified timestamp, digest string"


def list_folder(spark: SparkSession, path: str, glob: str = "*", digest: bool = False) -> DataFrame:
    """``(path, length, modified, digest)`` of every file that is not empty; bytes are read only for a digest (else NULL)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    sha = F.sha2("content", 256) if digest else F.lit(None).cast("string")
    return files.select("path", "length", F.col("modificationTime").alias("modified"), sha.alias("digest"))


def diff_listings(before: DataFrame, now: DataFrame) -> DataFrame:
    """``(path, status)``, status ``added``, ``changed``, ``removed`` or ``same``.

    Where both listings have a digest it decides; else a file with another
    length or time has changed.
    """
    b = before.select(F.col("path").alias("_b"), F.col("length").alias("_bl"), F.col("modified").alias("_bm"), F.col("digest").alias("_bd"))
    same = F.when(F.col("digest").isNotNull() & F.col("_bd").isNotNull(), F.col("digest") == F.col("_bd")).otherwise(
        (F.col("length") == F.col("_bl")) & (F.col("modified") == F.col("_bm")))
    status = F.when(F.col("_b").isNull(), F.lit("added")).when(F.col("path").isNull(), F.lit("removed")).when(
        same, F.lit("same")).otherwise(F.lit("changed"))
    return now.join(b, F.col("path") == F.col("_b"), "full").select(F.coalesce("path", "_b").alias("path"), status.alias("status"))


def last_listing(spark: SparkSession, state_path: str) -> tuple[DataFrame, int]:
    """The listing of the last finished run and its number; an empty one and 0 before the first."""
    try:
        kept = spark.read.schema(LISTING + ", run bigint").parquet(state_path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LISTING), 0
    run = kept.agg(F.max("run")).first()[0] or 0
    return kept.where(F.col("run") == run).drop("run"), run


def run_changes(spark: SparkSession, path: str, flow: Callable[[DataFrame], DataFrame], out_path: str, state_path: str,
                glob: str = "*", digest: bool = False, fmt: str = "parquet") -> DataFrame:
    """Redo a batch ``flow`` for the files that were added or changed; returns ``(path, doc, status)`` of all that differ.

    ``flow`` gets ``(path, doc, text)`` of those files and returns rows with
    ``path``; they replace the file's earlier rows under
    ``out_path/source=<path>``.  Rows of removed files are replaced by none,
    and the report names them.  The new listing is kept last: a run that fails
    is done again as a whole, and finds its own output in place.
    """
    ensure_checkpoint_dir(spark)
    now = list_folder(spark, path, glob, digest).checkpoint(eager=True)
    before, run = last_listing(spark, state_path)
    report = diff_listings(before, now).where("status <> 'same'").checkpoint(eager=True)
    texts = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    redo = report.where(F.col("status").isin("added", "changed")).select("path")
    picked = texts.join(redo, "path", "left_semi").select("path", file_stem("path", url=False).alias("doc"), F.col("content").cast("string").alias("text"))
    made = flow(picked)
    # A removed or emptied source must lose its earlier rows: its partition is written with a marker row.
    gone = report.where("status <> 'added'").select("path")
    marks = gone.join(made.select("path").distinct(), "path", "left_anti").withColumn("_none", F.lit(True))
    rows = made.withColumn("_none", F.lit(False)).unionByName(marks, allowMissingColumns=True).withColumn("source", F.sha2("path", 256))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").format(fmt).save(out_path)
    now.write.mode("overwrite").parquet(f"{state_path.rstrip('/')}/run={run + 1}")
    return report.select("path", file_stem("path", url=False).alias("doc"), "status")


def read_results(spark: SparkSession, out_path: str, fmt: str = "parquet") -> DataFrame:
    """The rows that ``run_changes`` keeps, without its marks of files that give none."""
    return spark.read.format(fmt).load(out_path).where(~F.col("_none")).drop("_none", "source")
