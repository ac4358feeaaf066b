"""Pages of text files that need not fit into one row.

``files`` and ``paging.explode_pages`` take a document's text as one value.  A
text file of any size is read here line by line, in as many splits as Spark
makes of it; lines get their number in the file from a distributed rank, and
pages follow by arithmetic.  No row holds more than a page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions.textfn import decoded_path, file_stem
from pagewright.operators.ranking import join_per_group, rank_within


def read_lines(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``(path, line_no, line)``: every line of every file, numbered from 1 within its file.

    Lines end at ``\\n`` and hold everything else (``\\r`` too).  A file that
    ends with ``\\n`` has an empty last line, an empty file one empty line, as
    splitting its text at ``\\n`` would give.  The last line is told from the
    file's length: the bytes of its lines, and one for each line break.
    Uncompressed files only: a compressed one can't be split, nor its length compared.
    """
    at = F.col("_metadata")
    raw = spark.read.option("pathGlobFilter", glob).option("lineSep", "\n").text(path)
    rows = raw.select(
        at["file_path"].alias("_file"), at["file_block_start"].alias("_block"), at["file_size"].alias("_size"), F.col("value").alias("line"))
    # Within a split lines are read in order; splits of a file are ordered by where they begin.
    ranked = rank_within(rows.withColumn("_pos", F.monotonically_increasing_id()), ["_file"], ["_block", "_pos"], "line_no")
    per_file = ranked.groupBy("_file").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.octet_length("line").cast("bigint")).alias("_bytes"), F.max("_size").alias("_size"))
    ends = per_file.where(F.col("_bytes") + F.col("_n") == F.col("_size")).select(
        "_file", (F.col("_n") + 1).alias("line_no"), F.lit("").alias("line"))
    lines = ranked.select("_file", "line_no", "line").unionByName(ends)
    return lines.select(decoded_path("_file").alias("path"), "line_no", "line")


def read_line_pages(spark: SparkSession, path: str, glob: str = "*", lines_per_page: int = 10) -> DataFrame:
    """``(path, doc, page_no, num_pages, text)``: the pages that ``paging.explode_pages`` cuts from whole texts.

    A page's lines are gathered by (file, page), so a group is a page; the
    number of pages comes from one row per file.
    """
    n = int(lines_per_page)
    lines = read_lines(spark, path, glob).withColumn("page_no", (F.floor((F.col("line_no") - 1) / n) + 1).cast("bigint"))
    pages = lines.groupBy("path", "page_no").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("_l"))
    pages = pages.select("path", "page_no", F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("text"))
    counts = pages.groupBy("path").agg(F.max("page_no").alias("num_pages"))
    out = join_per_group(pages, counts, ["path"])
    return out.select("path", file_stem("path", url=False).alias("doc"), "page_no", "num_pages", "text")
