"""Sinks: batch files, final records, stitched markdown.

Outputs are partitioned by document so that a rerun with dynamic partition
overwrite replaces only the documents it wrote (the reference deleted the
whole intermediate folder for every document).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from pagewright.session import ensure_checkpoint_dir

BUCKET_COL = "doc_bucket"


def with_bucket(df: DataFrame, doc_col: str, buckets: int) -> DataFrame:
    """Adds ``doc_bucket = pmod(hash(doc), buckets)`` (stable across runs)."""
    return df.withColumn(BUCKET_COL, F.pmod(F.xxhash64(F.col(doc_col)), F.lit(buckets)))


def _keep_layout(spark, path: str, buckets: int | None) -> None:
    """Records the number of buckets of an output beside it; another number fails.

    A document's bucket depends on their number, so a rerun with another one
    would leave its old copy in the old bucket.
    """
    from pyspark.errors import AnalysisException

    parent, _, name = path.rstrip("/").rpartition("/")
    layout, want = f"{parent}/_layout_{name}", str(buckets or 0)  # readers of the parent skip names with "_"
    try:
        kept = [r.value for r in spark.read.text(layout).collect()]  # one line
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        spark.createDataFrame([(want,)], "value string").coalesce(1).write.text(layout)
        return
    if kept and kept[0] != want:
        raise ValueError(f"{path} was written with buckets={kept[0]}, not {want}; write to another folder")


def _writer(df: DataFrame, partition_col: str, mode: str, buckets: int | None = None):
    """Writer partitioned by document, or by a hash bucket of it when
    ``buckets`` is given (millions of documents would make millions of
    folders; the document stays a column)."""
    if buckets:
        df, partition_col = with_bucket(df, partition_col, buckets), BUCKET_COL
    return df.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(partition_col)


def _with_others(lines: DataFrame, path: str, doc_col: str, buckets: int, read) -> DataFrame:
    """``lines`` and, from the buckets they touch, what is stored of other documents.

    ``read(spark)`` gives the stored rows with ``doc_col`` and the bucket.  A
    rerun replaces whole buckets, so these rows are written again; they are
    checkpointed first, because the overwrite deletes the files they come from.
    """
    from pyspark.errors import AnalysisException

    spark = lines.sparkSession
    lines = with_bucket(lines, doc_col, buckets)
    try:
        stored = read(spark)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return lines
        raise
    touched, docs = lines.select(BUCKET_COL).distinct(), lines.select(F.col(doc_col).cast("string").alias("_d")).distinct()
    others = stored.join(touched, BUCKET_COL, "left_semi")
    others = others.join(docs, F.col(doc_col).cast("string").eqNullSafe(F.col("_d")), "left_anti")
    ensure_checkpoint_dir(spark)
    return lines.unionByName(others.checkpoint(), allowMissingColumns=True)


def write_batches(df: DataFrame, path: str, doc_col: str = "doc", batch_col: str = "batch_no",
                  mode: str = "overwrite", buckets: int | None = None) -> None:
    """One JSON line per batch (with its label and reply), partitioned by document.

    Rows are range-partitioned on ``(doc, batch)`` first: small documents
    share a writer task, a document with very many batches is split over
    several (each writes its own file in the document's folder).
    """
    _keep_layout(df.sparkSession, path, buckets)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if buckets and mode == "overwrite":
        merged = _with_others(df, path, doc_col, buckets, lambda spark: spark.read.schema(
            StructType([*df.schema.fields, StructField(BUCKET_COL, LongType())])).json(path)).checkpoint()
        df = merged.drop(BUCKET_COL)
    ordered = df.repartitionByRange(n, doc_col, batch_col).sortWithinPartitions(doc_col, batch_col)
    _writer(ordered, doc_col, mode, buckets).json(path)


def _json_lines(df: DataFrame, path: str, doc_col: str, value_key: str, value: Column, mode: str, buckets: int, *more: Column) -> None:
    """``{"doc": ..., <more>, <value_key>: ...}`` lines in one folder per bucket; other documents of a bucket are kept.

    ``more`` are JSON members, ``value`` is JSON.
    """
    line = F.concat_ws(",", F.concat(F.lit('{"doc":'), F.to_json(F.col(doc_col).cast("string").cast("variant"))), *more,
                       F.concat(F.lit(f'"{value_key}":'), value, F.lit("}")))
    lines = df.select(F.col(doc_col).cast("string").alias(doc_col), line.alias("value"))
    if mode == "overwrite":
        def stored(spark):
            old = spark.read.schema(StructType([StructField("value", StringType()), StructField(BUCKET_COL, LongType())])).text(path)
            return old.withColumn(doc_col, F.get_json_object("value", "$.doc"))

        lines = _with_others(lines, path, doc_col, buckets, stored)
    else:
        lines = with_bucket(lines, doc_col, buckets)
    lines.select(BUCKET_COL, "value").write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET_COL).text(path)


def write_final(df: DataFrame, path: str, doc_col: str = "doc", record_col: str = "record",
                ascii_only: bool = False, mode: str = "overwrite", buckets: int | None = None, indent: int | None = None) -> None:
    """One JSON record per document as text, in a folder per document.

    ``indent`` writes it over several lines, values as written.  With
    ``buckets`` the records go to one folder per hash bucket as JSON lines
    ``{"doc": ..., "record": {...}}`` instead (text files cannot hold the
    document name as a column); a record is one line there, so no ``indent``.
    """
    if buckets and indent:
        raise ValueError("records in buckets are lines; indent needs a folder per document")
    _keep_layout(df.sparkSession, path, buckets)
    rec = F.col(record_col)
    if ascii_only:
        rec = _ascii_json(rec)
    if buckets:
        _json_lines(df, path, doc_col, "record", rec, mode, buckets)
        return
    if indent:
        rec = indented_json(rec, indent)
    _writer(df.select(doc_col, rec.alias("value")), doc_col, mode).text(path)


def indented_json(json_text: Column, indent: int = 4) -> Column:
    """JSON text with one member or item a line; strings and numbers stay as written, empty ``{}`` and ``[]`` on their line.

    The text is cut into tokens, the depth of each is a running sum, and
    every bracket and comma gets its line break.  The depths are worked out in
    blocks of tokens, so a long record costs in proportion to its length.
    """
    token = r'"(?:[^"\\]++|\\.)*+"|[\[\]{}:,]|[^\s"\[\]{}:,]++'
    tokens = F.regexp_extract_all(json_text, F.lit(rf"(?s)({token})"), 1)

    def turn(t: Column) -> Column:
        return F.when(t.isin("{", "["), 1).when(t.isin("}", "]"), -1).otherwise(0)

    def laid_out(all_tokens: Column) -> Column:
        size, block = F.size(all_tokens), F.ceil(F.sqrt(F.size(all_tokens))).cast("int")
        first = F.transform(F.sequence(F.lit(0), block), lambda b: b * block)
        sums = F.transform(first, lambda b: F.aggregate(F.slice(all_tokens, b + 1, block), F.lit(0), lambda n, t: n + turn(t)))

        def of_block(b: Column, i: Column) -> Column:
            base = F.aggregate(F.slice(sums, 1, i), F.lit(0), lambda n, x: n + x)
            mine = F.slice(all_tokens, b + 1, block)

            def put(t: Column, k: Column) -> Column:
                before, after = F.get(all_tokens, b + k - 1), F.get(all_tokens, b + k + 1)
                depth = base + F.aggregate(F.slice(mine, 1, k + 1), F.lit(0), lambda n, x: n + turn(x))
                line = F.concat(F.lit("\n"), F.repeat(F.lit(" " * indent), depth))
                return (
                    F.when(t.isin("{", "["), F.when(after.isin("}", "]"), t).otherwise(F.concat(t, line)))
                    .when(t.isin("}", "]"), F.when(before.isin("{", "["), t).otherwise(F.concat(line, t)))
                    .when(t == ",", F.concat(t, line)).when(t == ":", F.lit(": ")).otherwise(t)
                )

            return F.array_join(F.transform(mine, put), "")

        return F.when(size > 0, F.array_join(F.transform(first, of_block), "")).otherwise(F.lit(""))

    return F.element_at(F.transform(F.array(tokens), laid_out), 1)


def _ascii_json(rec):
    """JSON text with every non-ASCII character written as ``\\uXXXX`` units.

    Characters beyond the basic plane encode to two UTF-16 units (eight hex
    digits) and are written as a surrogate pair.
    """
    def esc(ch):
        h = F.lower(F.hex(F.encode(ch, "UTF-16BE")))
        pair = F.concat(F.lit("\\u"), F.substring(h, 1, 4), F.lit("\\u"), F.substring(h, 5, 4))
        return F.when(F.ascii(ch) < 128, ch).when(F.length(h) == 8, pair).otherwise(F.concat(F.lit("\\u"), h))

    return F.array_join(F.transform(F.split(rec, "", -1), esc), "")


def write_markdown(df: DataFrame, path: str, doc_col: str = "doc", md_col: str = "markdown",
                   mode: str = "overwrite", buckets: int | None = None) -> None:
    """One stitched markdown file per document (line breaks kept as written).

    With ``buckets``: JSON lines ``{"doc": ..., "markdown": ...}``, one folder per hash bucket.
    """
    _keep_layout(df.sparkSession, path, buckets)
    if buckets:
        _json_lines(df, path, doc_col, "markdown", F.to_json(F.col(md_col).cast("variant")), mode, buckets)
        return
    _writer(df.select(doc_col, F.col(md_col).alias("value")), doc_col, mode).option("lineSep", "\n").text(path)


def write_markdown_parts(parts: DataFrame, path: str, doc_col: str = "doc", part_col: str = "part_no",
                         md_col: str = "markdown", mode: str = "overwrite", buckets: int | None = None) -> None:
    """Write ordered parts (``paging.stitch_parts``) as one folder per document.

    Rows are range-partitioned on ``(doc, part_no)`` and sorted within each
    task, so part files of a document follow the document order (a large
    document spans several tasks and files; read the folder's files in name
    order to concatenate).  Each part's final newline is written as the line
    separator (stitched parts end with one).

    With ``buckets``: JSON lines ``{"doc": ..., "part": n, "byte_start": n,
    "markdown": ...}``, one folder per hash bucket and in any order;
    ``byte_start`` is the part's place in its document (``paging.part_offsets``).
    """
    _keep_layout(parts.sparkSession, path, buckets)
    if buckets:
        from pagewright.operators.paging import part_offsets

        def member(name: str, col: str) -> Column:
            return F.concat(F.lit(f'"{name}":'), F.col(col).cast("string"))

        placed = part_offsets(parts, doc_col, part_col, md_col)
        _json_lines(placed, path, doc_col, "markdown", F.to_json(F.col(md_col).cast("variant")), mode, buckets,
                    member("part", part_col), member("byte_start", "byte_start"))
        return
    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = parts.repartitionByRange(n, doc_col, part_col).sortWithinPartitions(doc_col, part_col)
    value = F.regexp_replace(F.col(md_col), r"\n\z", "")
    _writer(ordered.select(doc_col, value.alias("value")), doc_col, mode).option("lineSep", "\n").text(path)
