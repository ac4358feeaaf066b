"""Pages: split, select, cap, count, order, batch, label and stitch.

Designed so that no step sends a whole document to one task unless the output
itself is one row per document (``stitch_pages``):

* splitting a document into pages is a narrow per-row expression;
* batch numbers come from page numbers by arithmetic, not from a window;
* per-document counts are partial aggregates joined back (AQE splits a hot
  document's partition in that join);
* ranks inside a document use ``ranking.rank_within`` (range-partitioned).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.textfn import batch_label, file_stem, natural_key
from pagewright.functions.jsonfn import compute_once
from pagewright.operators.ranking import join_per_group, rank_within, running_total

# Fixed values from the reference: the request limit of ten images, and the
# header the stitcher writes before each part.
MAX_IMAGES_PER_REQUEST = 10
STITCH_HEADER = "# Page "


def explode_pages(df: DataFrame, doc_col: str, text_col: str, lines_per_page: int = 10) -> DataFrame:
    """One row per page: ``(doc, page_no, num_pages, text)``, pages of ``lines_per_page`` lines.

    Re-aimed from PDF rendering to text: lines are split on ``\\n`` (empty
    trailing lines kept), page ``p`` holds lines ``(p-1)*n+1 .. p*n`` joined
    with ``\\n``.  An empty text gives one empty page; NULL text gives none.
    Narrow: no shuffle, the page list is built inside the row, and the
    document's page count comes from the same row (no count joined back).
    """
    n = int(lines_per_page)
    # The lines are computed once per row; each page only slices them.
    df = compute_once(df.select(doc_col, text_col), _pw_lines=F.split(F.col(text_col), "\n", -1))
    lines = F.col("_pw_lines")
    n_pages = F.ceil(F.size(lines) / F.lit(float(n))).cast("int")
    pages = F.transform(
        F.sequence(F.lit(0), n_pages - 1),
        lambda p: F.array_join(F.slice(lines, p * n + 1, F.lit(n)), "\n"),
    )
    return df.select(
        F.col(doc_col),
        n_pages.cast("bigint").alias("num_pages"),
        F.posexplode(F.when(F.col(text_col).isNotNull(), pages)).alias("_i", "text"),
    ).select(F.col(doc_col), (F.col("_i") + 1).cast("bigint").alias("page_no"), "num_pages", "text")


def number_within(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[Column | str],
                  out: str = "row_no", **rank_args) -> DataFrame:
    """1-based row number within each group (skew-safe, see ``ranking``).

    Pass rows without large payload columns: whole rows are sorted and written.
    """
    return rank_within(df, group_cols, order_cols, out, **rank_args)


def select_pages(df: DataFrame, first: int | None = None, last: int | None = None,
                 pages: Sequence[int] | None = None, page_col: str = "page_no") -> DataFrame:
    """Keep pages known to hold the answers: a range and/or an explicit list.

    A plain filter, pushed to the parquet scan when ``page_col`` is stored.
    """
    cond = F.lit(True)
    if first is not None:
        cond = cond & (F.col(page_col) >= first)
    if last is not None:
        cond = cond & (F.col(page_col) <= last)
    if pages is not None:
        cond = cond & F.col(page_col).isin(list(pages))
    return df.where(cond)


def page_count(df: DataFrame, doc_col: str = "doc", out: str = "num_pages") -> DataFrame:
    """Number of pages per document (partial aggregation, no hot task)."""
    return df.groupBy(doc_col).agg(F.count(F.lit(1)).cast("bigint").alias(out))


def assign_batches(df: DataFrame, size: int = 10, doc_col: str = "doc", page_col: str = "page_no") -> DataFrame:
    """Fixed-size batching of pages numbered 1..n per document.

    Adds ``batch_no = (page_no - 1) div size + 1``, ``num_pages`` (pages of the
    document), ``total_batches = ceil(num_pages / size)`` and
    ``pages_in_batch``.  A ``num_pages`` column already present (as
    ``explode_pages`` gives) is used as is; otherwise the per-document count
    is a partial aggregate joined back.  A page number outside 1..n fails the
    job: a selection of pages goes through ``batch_selection``.
    """
    size = int(size)
    with_batch = df.withColumn(
        "batch_no", (F.expr(f"(`{page_col}` - 1) div {size}") + 1).cast("bigint")
    )
    if "num_pages" in df.columns:
        out = with_batch
    else:
        out = join_per_group(with_batch, page_count(df, doc_col), [doc_col], "left")
    outside = (F.col(page_col) < 1) | (F.col(page_col) > F.col("num_pages"))
    out = out.withColumn("batch_no", F.when(outside, F.raise_error(F.concat(
        F.lit("page "), F.col(page_col).cast("string"), F.lit(" of a document with "), F.col("num_pages").cast("string"),
        F.lit(" pages: a selection goes through batch_selection"))).cast("bigint")).otherwise(F.col("batch_no")))
    return out.withColumn(
        "total_batches", F.ceil(F.col("num_pages") / F.lit(float(size))).cast("bigint")
    ).withColumn(
        "pages_in_batch",
        F.least(F.lit(size), F.col("num_pages") - (F.col("batch_no") - 1) * size).cast("bigint"),
    )


def batch_selection(df: DataFrame, size: int = 10, doc_col: str = "doc", page_col: str = "page_no") -> DataFrame:
    """Fixed-size batching of any selection of a document's pages.

    As ``assign_batches``, but pages are counted as they are listed: batches
    go by the page's rank within its document, and ``num_pages``,
    ``total_batches`` and ``pages_in_batch`` describe the selection (a
    ``num_pages`` column carried from before the selection is replaced).
    """
    listed = rank_within(df.drop("num_pages"), [doc_col], [page_col], "_place")
    out = assign_batches(join_null_group(listed, page_count(listed, doc_col), doc_col), size, doc_col, "_place")
    return out.drop("_place")


def join_null_group(rows: DataFrame, per_group: DataFrame, key: str) -> DataFrame:
    """Join one row per group onto ``rows``, a NULL group included."""
    side = per_group.withColumnRenamed(key, "_jg")
    return rows.join(side, F.col(key).eqNullSafe(F.col("_jg"))).drop("_jg")


def collect_batches(df: DataFrame, payload_col: str, doc_col: str = "doc", page_col: str = "page_no",
                    batch_col: str = "batch_no", extra_cols: Sequence[str] = ()) -> DataFrame:
    """Gather each batch's pages in page order.

    Output ``(doc, batch_no, extra..., start_page, end_page, pages)`` where
    ``pages`` is ``array<struct<page_no, payload>>`` sorted by page;
    ``extra_cols`` are per-document values carried along (e.g. ``num_pages``).
    A batch holds a bounded number of pages, so the grouped list is bounded.
    """
    return df.groupBy(doc_col, batch_col, *extra_cols).agg(
        F.min(page_col).alias("start_page"),
        F.max(page_col).alias("end_page"),
        F.array_sort(
            F.collect_list(F.struct(F.col(page_col).alias("page_no"), F.col(payload_col).alias("payload")))
        ).alias("pages"),
    )


def cap_pages(batches: DataFrame, n: int = MAX_IMAGES_PER_REQUEST, pages_col: str = "pages") -> DataFrame:
    """Send at most ``n`` pages per request, and show what is dropped.

    The reference slices silently; here ``sent_pages`` is the slice and
    ``dropped_pages`` counts what was cut so the loss is visible.
    """
    return batches.withColumn("dropped_pages", F.greatest(F.size(pages_col) - F.lit(n), F.lit(0)).cast("bigint")) \
        .withColumn(pages_col, F.slice(pages_col, 1, n))


def batch_labels(batched: DataFrame, doc_col: str = "doc", page_col: str = "page_no",
                 batch_col: str = "batch_no", total_col: str = "num_pages", ext: str = "") -> DataFrame:
    """``Pages_<start>_to_<end>`` per batch, padded to the digits of the page count."""
    g = batched.groupBy(doc_col, batch_col, total_col).agg(
        F.min(page_col).alias("start_page"), F.max(page_col).alias("end_page")
    )
    return g.withColumn("label", batch_label("start_page", "end_page", total_col, ext))


def natural_order(df: DataFrame, name_col: str, group_cols: Sequence[str], out: str = "natural_rank",
                  **rank_args) -> DataFrame:
    """Rank of each name within its group in natural order (digit runs as numbers).

    Equal keys (``Page_7`` and ``page_007``) are ordered by the raw name.
    """
    return rank_within(df, group_cols, [natural_key(name_col), F.col(name_col)], out, **rank_args)


def stem_order(df: DataFrame, name_col: str, group_cols: Sequence[str], out: str = "stem_rank",
               **rank_args) -> DataFrame:
    """Rank of each name within its group by plain comparison of the file stem.

    Right only for zero-padded names, as in the reference.
    """
    return rank_within(df, group_cols, [file_stem(name_col, url=False), F.col(name_col)], out, **rank_args)


def stitch_block(label_col: str, content_col: str, page_token_col: str | None = None) -> Column:
    """One stitched part: ``# Page <p>``, blank line, content, blank line."""
    token = (
        F.col(page_token_col)
        if page_token_col
        else F.split(F.split(F.col(label_col), "_", -1).getItem(1), r"\.", -1).getItem(0)
    )
    return F.concat(F.lit(STITCH_HEADER), token, F.lit("\n\n"), F.col(content_col), F.lit("\n\n"))


def stitch_parts(parts: DataFrame, doc_col: str, label_col: str, content_col: str, out: str = "markdown",
                 page_token_col: str | None = None, **rank_args) -> DataFrame:
    """The stitched document as ordered rows: ``(doc, part_no, markdown)``.

    ``part_no`` is the part's rank in natural label order (skew-safe rank), so
    a document of any size is never gathered into one row; concatenating the
    rows of a document by ``part_no`` gives ``stitch_pages``' text.  Use with
    ``sinks.write_markdown_parts``.
    """
    from pagewright.functions.textfn import natural_key as nk

    blocks = parts.select(doc_col, label_col, stitch_block(label_col, content_col, page_token_col).alias(out))
    # The rows themselves are ranked: a label may repeat within a document, so it can't serve as a join key.
    ranked = rank_within(blocks, [doc_col], [nk(label_col), F.col(label_col), F.col(out)], "part_no", **rank_args)
    return ranked.select(doc_col, "part_no", out)


def part_offsets(parts: DataFrame, doc_col: str = "doc", part_col: str = "part_no", md_col: str = "markdown") -> DataFrame:
    """Where each stitched part lies in its document: adds ``byte_start, byte_end`` (UTF-8, end exclusive).

    A distributed prefix sum over the parts' lengths, so every part can be
    written on its own and put into place by whoever reads it.
    """
    sized = parts.withColumn("_bytes", F.octet_length(md_col).cast("bigint"))
    summed = running_total(sized, [part_col], "_bytes", "byte_end", group_cols=[doc_col])
    return summed.select(*parts.columns, (F.col("byte_end") - F.col("_bytes")).alias("byte_start"), "byte_end")


def stitch_pages(parts: DataFrame, doc_col: str, label_col: str, content_col: str, out: str = "markdown",
                 page_token_col: str | None = None) -> DataFrame:
    """Concatenate a document's parts in natural order of their labels.

    Each part is written as ``# Page <p>``, a blank line, the content and a
    blank line, where ``<p>`` is the start page as written in the label
    (``Pages_01_to_10`` gives ``01``), or ``page_token_col`` when given.
    The output is one row per document, which the final group must hold:
    for documents too large for one row use ``stitch_parts``.
    """
    block = stitch_block(label_col, content_col, page_token_col)
    g = parts.groupBy(doc_col).agg(
        F.array_sort(
            F.collect_list(F.struct(natural_key(label_col).alias("k"), F.col(label_col).alias("l"), block.alias("b")))
        ).alias("_parts")
    )
    return g.select(doc_col, F.array_join(F.transform("_parts", lambda p: p["b"]), "").alias(out))
