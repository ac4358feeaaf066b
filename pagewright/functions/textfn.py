"""Scalar column functions for names, labels, encodings, costs and times.

Each returns a built-in Column expression; no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's output formats.
DATA_URL_PREFIX = "data:image/jpeg;base64,"
PAGE_NAME_PREFIX = "Page_"
PAGE_NAME_SUFFIX = ".jpeg"
BATCH_NAME_PREFIX = "Pages_"
BATCH_NAME_MIDDLE = "_to_"
# Image token rule: 85 base tokens plus 170 per 512 x 512 tile.
IMAGE_BASE_TOKENS = 85
IMAGE_TILE_TOKENS = 170
IMAGE_TILE_PX = 512


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def natural_key(col: Column | str) -> Column:
    """Sort key that orders digit runs as integers and the rest lower-cased.

    The text is cut at digit runs into text parts and numbers; pairing the
    i-th text part with the i-th number gives ``array<struct<t, n>>`` whose
    built-in ordering equals comparing the alternating Python list
    ``[text, int, text, int, ..., text]`` (a missing number sorts first, as a
    shorter list does).  Add the raw value as a tie-break where equal keys with
    different zero padding must keep a fixed order.
    """
    c = _c(col)
    texts = F.split(F.lower(c), "[0-9]+", -1)
    # A number of any length: without leading zeros, the longer is the larger.
    nums = F.transform(
        F.regexp_extract_all(c, F.lit("([0-9]+)"), 1),
        lambda x: F.struct(F.length(F.ltrim(x, F.lit("0"))).alias("size"), F.ltrim(x, F.lit("0")).alias("digits")),
    )
    return F.arrays_zip(texts.alias("t"), nums.alias("n"))


def file_stem(col: Column | str, url: bool = True) -> Column:
    """Base name without its last extension, like ``splitext(basename(p))[0]``.

    Query string and fragment of a URL are removed first; ``url=False`` takes a
    file path, where ``?`` and ``#`` belong to the name.  Leading dots do not
    start an extension (``.env`` keeps its name).
    """
    path = F.regexp_replace(_c(col), r"[?#].*\z", "") if url else _c(col)
    base = F.regexp_extract(path, r"([^/]*)\z", 1)
    return F.regexp_extract(base, r"^(\.*.*?)(\.[^.]*)?\z", 1)


def decoded_path(col: Column | str) -> Column:
    """The path of ``_metadata.file_path``, which is written as a URI (``%20`` for a space, a plus as it is)."""
    return F.url_decode(F.replace(_c(col), F.lit("+"), F.lit("%2B")))


def file_extension(col: Column | str) -> Column:
    """Last extension of the base name including the dot, or ''."""
    path = F.regexp_replace(_c(col), r"[?#].*\z", "")
    base = F.regexp_extract(path, r"([^/]*)\z", 1)
    return F.regexp_extract(base, r"^\.*.*?(\.[^.]*)?\z", 1)


def digits_of(n: Column | str) -> Column:
    """Number of decimal digits of a positive count (width of padded labels)."""
    return F.length(_c(n).cast("string"))


def page_label(page_no: Column | str, total: Column | str | None = None, padded: bool = True,
               prefix: str = PAGE_NAME_PREFIX, suffix: str = PAGE_NAME_SUFFIX) -> Column:
    """``Page_007.jpeg``: page number padded to the digits of the page count.

    With ``padded=False`` (or no total) the number is written as is, as the
    single-call variant does with ``page_7.jpg`` (pass prefix and suffix).
    """
    no = _c(page_no).cast("string")
    if padded and total is not None:
        no = F.lpad(no, digits_of(total), "0")
    return F.concat(F.lit(prefix), no, F.lit(suffix))


def batch_label(start_page: Column | str, end_page: Column | str, total: Column | str,
                ext: str = "") -> Column:
    """``Pages_<start>_to_<end>`` with both padded to the digits of the page count."""
    w = digits_of(total)
    return F.concat(
        F.lit(BATCH_NAME_PREFIX),
        F.lpad(_c(start_page).cast("string"), w, "0"),
        F.lit(BATCH_NAME_MIDDLE),
        F.lpad(_c(end_page).cast("string"), w, "0"),
        F.lit(ext),
    )


def b64(col: Column | str) -> Column:
    """Unbroken base64 of a binary column (line breaks Spark may add are removed)."""
    return F.regexp_replace(F.base64(_c(col)), r"[\r\n]", "")


def data_url(col: Column | str) -> Column:
    """``data:image/jpeg;base64,<b64>`` for a binary page."""
    return F.concat(F.lit(DATA_URL_PREFIX), b64(col))


def image_tokens(width: Column | str, height: Column | str) -> Column:
    """Estimated prompt tokens of one image: 85 + 170 * ceil(w/512) * ceil(h/512)."""
    tiles_w = F.ceil(_c(width) / F.lit(IMAGE_TILE_PX))
    tiles_h = F.ceil(_c(height) / F.lit(IMAGE_TILE_PX))
    return (F.lit(IMAGE_BASE_TOKENS) + F.lit(IMAGE_TILE_TOKENS) * tiles_w * tiles_h).cast("bigint")


def text_tokens(text: Column | str, chars_per_token: float = 4.0) -> Column:
    """Rough token estimate of a text: ceil(characters / 4)."""
    return F.ceil(F.length(_c(text)) / F.lit(chars_per_token)).cast("bigint")


def format_elapsed(seconds: Column | str) -> Column:
    """``M minutes S seconds`` with both parts floored."""
    s = _c(seconds)
    return F.format_string(
        "%d minutes %d seconds",
        F.floor(s / F.lit(60)).cast("bigint"),
        F.floor(s % F.lit(60)).cast("bigint"),
    )


def float_or_text(col: Column | str) -> tuple[Column, Column]:
    """(number, text): digits-only text becomes a double, other text stays text.

    Returns two columns because one column cannot hold both types; the number
    is NULL where the text is not all ASCII digits.
    """
    c = _c(col)
    return F.when(c.rlike(r"^[0-9]+\z"), c.cast("double")), c


def token_cost(tokens: Column | str, per_1k: Column | str) -> Column:
    """Cost in USD of a token count at a price per 1,000 tokens (unrounded)."""
    return _c(tokens) * _c(per_1k) / F.lit(1000.0)


def cents_exact(col: Column | str) -> Column:
    """Whole cents of a non-negative double, rounded as C / Python ``%.2f`` do.

    Those round the exact binary value (0.125 -> 0.12, 0.015 -> 0.01), while
    Java's formatter rounds the shortest decimal form half up (0.13, 0.02).
    ``x * 100`` is computed with its rounding error (Veltkamp split, exact
    because 100 is small), so a tie in the rounded product is settled by the
    sign of the error, and a true tie goes to the even cent.
    """
    x = _c(col).cast("double")
    p = x * F.lit(100.0)
    c = x * F.lit(134217729.0)
    hi = c - (c - x)
    lo = x - hi
    err = (hi * F.lit(100.0) - p) + lo * F.lit(100.0)
    f = F.floor(p)
    frac = p - f
    tie = (
        F.when(err > 0, f + 1)
        .when(err < 0, f)
        .when(f % 2 == 0, f)
        .otherwise(f + 1)
    )
    return F.when(frac > 0.5, f + 1).when(frac < 0.5, f).otherwise(tie).cast("bigint")


def money(col: Column | str) -> Column:
    """``$0.38``: two decimals for display only; keep cost columns unrounded."""
    cents = cents_exact(col)
    return F.concat(
        F.lit("$"),
        F.floor(cents / 100).cast("bigint").cast("string"),
        F.lit("."),
        F.lpad((cents % 100).cast("string"), 2, "0"),
    )
