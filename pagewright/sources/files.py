"""Folder sources: documents, page images, page files and text pages.

All are Spark file sources, so listing and reading are distributed; nothing
is listed on the driver beyond what the file index itself does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions.textfn import file_extension, file_stem, natural_key


def scan_documents(spark: SparkSession, path: str, glob: str = "*", recursive: bool = False) -> DataFrame:
    """Every file under ``path`` as ``(doc, path, modificationTime, length, content)``.

    ``doc`` is the base name without its last extension.  Like the reference,
    no extension filter is applied unless ``glob`` says so.
    """
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    df = reader.load(path)
    return df.select(file_stem(F.col("path"), url=False).alias("doc"), "path", "modificationTime", "length", "content")


def with_doc_name(df: DataFrame, path_col: str, out: str = "doc") -> DataFrame:
    """Adds the document key: base name of ``path_col`` without the last extension."""
    return df.withColumn(out, file_stem(F.col(path_col)))


def filter_extension(df: DataFrame, path_col: str, ext: str) -> DataFrame:
    """Rows whose path (query string and fragment removed) ends with ``ext``."""
    return df.where(file_extension(F.col(path_col)) == F.lit(ext))


def list_pages(spark: SparkSession, path: str, ext: str = ".jpeg") -> DataFrame:
    """Page files of one extension under ``path``: ``(path, name, page_no)``.

    ``page_no`` is the first number in the file name (``Page_007.jpeg`` -> 7).
    Only file metadata is read (the ``content`` column is never selected, so
    binaryFile does not read the bytes).
    """
    df = spark.read.format("binaryFile").option("pathGlobFilter", f"*{ext}").load(path)
    name = F.regexp_extract(F.col("path"), r"([^/]*)\z", 1)
    return df.select(
        "path",
        name.alias("name"),
        F.regexp_extract(name, r"([0-9]+)", 1).try_cast("bigint").alias("page_no"),
    )


def scan_page_images(spark: SparkSession, path: str, drop_invalid: bool = True) -> DataFrame:
    """Decoded page images: ``(origin, name, width, height, n_channels)``.

    Spark's ``image`` source decodes each file; undecodable files are dropped
    (or kept with width -1 when ``drop_invalid=False``).
    """
    df = spark.read.format("image").option("dropInvalid", str(drop_invalid).lower()).load(path)
    return df.select(
        F.col("image.origin").alias("origin"),
        F.regexp_extract(F.col("image.origin"), r"([^/]*)\z", 1).alias("name"),
        F.col("image.width").alias("width"),
        F.col("image.height").alias("height"),
        F.col("image.nChannels").alias("n_channels"),
    )


def scan_page_sizes(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Page image sizes from file headers: ``(path, name, width, height)``.

    Like opening an image for its size, only the header is parsed (PNG, JPEG;
    NULL for other files); no pixel is decoded, unlike the ``image`` source.
    """
    from pagewright.functions.imagefn import image_size

    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    size = image_size(F.col("content"))
    return df.select(
        "path", F.regexp_extract(F.col("path"), r"([^/]*)\z", 1).alias("name"),
        size["width"].alias("width"), size["height"].alias("height"),
    )


def read_text_pages(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Whole text files (markdown / JSON) as UTF-8: ``(name, sort_key, text)``."""
    df = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True)
    name = F.col("_metadata.file_name")
    return df.select(name.alias("name"), natural_key(name).alias("sort_key"), F.col("value").alias("text"))


def order_by_name(df: DataFrame, name_col: Column | str = "name") -> DataFrame:
    """Natural order of file names (for display or a single ordered sink)."""
    c = F.col(name_col) if isinstance(name_col, str) else name_col
    return df.orderBy(natural_key(c), c)


def image_folder_pages(spark: SparkSession, path: str, glob: str = "*.jpeg") -> DataFrame:
    """Page images laid out as ``<path>/<doc>/<Page_n>.<ext>``: one row per page.

    Output ``(doc, page_no, num_pages, name, payload, width, height, tokens)``:
    ``doc`` is the folder name, ``page_no`` the rank of the file name in
    natural order (skew-safe), ``payload`` the file bytes, size from the
    header, ``tokens`` the image-token estimate.  Ready for ``budget`` or
    fixed batching and ``requests.build_request(kind="image")``.
    """
    from pagewright.functions.imagefn import image_size
    from pagewright.functions.textfn import image_tokens
    from pagewright.operators.ranking import join_per_group, rank_within

    # Two documents may share a folder name: rows are matched by their whole path.
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob) \
        .option("recursiveFileLookup", "true").load(path)
    size = image_size(F.col("content"))
    pages = raw.select(
        "path", F.regexp_extract(F.col("path"), r"(.*)/[^/]*\z", 1).alias("_folder"),
        F.regexp_extract(F.col("path"), r"([^/]*)/[^/]*\z", 1).alias("doc"),
        F.regexp_extract(F.col("path"), r"([^/]*)\z", 1).alias("name"),
        F.col("content").alias("payload"),
        size["width"].alias("width"), size["height"].alias("height"),
    )
    keys = pages.select("path", "_folder", "name")
    ranked = rank_within(keys, ["_folder"], [natural_key(F.col("name")), F.col("name"), F.col("path")], "page_no").select("path", "page_no")
    counts = keys.groupBy("_folder").agg(F.count(F.lit(1)).alias("num_pages"))
    return join_per_group(ranked.join(pages, ["path"]), counts, ["_folder"]).select(
        "doc", "page_no", "num_pages", "name", "payload", "width", "height",
        image_tokens("width", "height").alias("tokens"),
    )
