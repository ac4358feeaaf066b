"""Image width and height from file bytes, without decoding pixels.

Reading a page image only for its size is what the image-token estimate
needs.  Spark's ``image`` source decodes every pixel; these expressions read
the header instead: PNG keeps the size at fixed offsets, and a JPEG's frame
header (SOFn marker) is found by walking the segment list from the start --
markers are followed by their lengths, so bytes inside other segments (an
EXIF thumbnail has its own frame header) are skipped.  Pure column
expressions (``aggregate`` over the header's segments).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the two formats.
PNG_SIGNATURE = "89504E470D0A1A0A"
JPEG_START = "FFD8"
# Start-of-frame markers carrying the size (not DHT C4, JPG C8, DAC CC).
JPEG_SOF_CODES = ["C0", "C1", "C2", "C3", "C5", "C6", "C7", "C9", "CA", "CB", "CD", "CE", "CF"]


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


FIRST_WALK = 64  # header segments of an ordinary file


def image_size(content: Column | str) -> Column:
    """``struct<width: bigint, height: bigint>`` of a PNG or JPEG; NULLs otherwise.

    A JPEG's segments are walked to the frame header.  Only a file with more
    than ``FIRST_WALK`` of them is walked further, at most to its last byte.
    """
    c = _c(content)

    def uint(pos: Column, n: int) -> Column:
        # substring on BINARY with column positions
        return F.conv(F.hex(F.call_function("substring", c, pos, F.lit(n))), 16, 10).cast("bigint")

    png = F.hex(F.substring(c, 1, 8)) == PNG_SIGNATURE
    png_size = F.struct(uint(F.lit(17), 4).alias("width"), uint(F.lit(21), 4).alias("height"))

    init = F.struct(
        F.lit(3).cast("bigint").alias("pos"),
        F.lit(None).cast("bigint").alias("width"),
        F.lit(None).cast("bigint").alias("height"),
        F.lit(False).alias("done"),
    )

    def step(acc, _):
        pos = acc["pos"]
        marker = F.hex(F.call_function("substring", c, pos.cast("int"), F.lit(2)))
        code = F.substring(marker, 3, 2)
        is_ff = F.substring(marker, 1, 2) == "FF"
        is_sof = is_ff & code.isin(*JPEG_SOF_CODES)
        seg_len = uint((pos + 2).cast("int"), 2)
        found = F.struct(
            pos.alias("pos"), uint((pos + 7).cast("int"), 2).alias("width"),
            uint((pos + 5).cast("int"), 2).alias("height"), F.lit(True).alias("done"),
        )
        stop = F.struct(pos.alias("pos"), acc["width"].alias("width"), acc["height"].alias("height"),
                        F.lit(True).alias("done"))
        nxt = F.struct((pos + 2 + seg_len).alias("pos"), acc["width"].alias("width"),
                       acc["height"].alias("height"), F.lit(False).alias("done"))
        fill = F.struct((pos + 1).alias("pos"), acc["width"].alias("width"), acc["height"].alias("height"),
                        F.lit(False).alias("done"))
        return (
            F.when(acc["done"], acc)
            .when(marker == "FFFF", fill)
            .when(is_sof, found)
            # end of image, start of scan, or not a marker: give up
            .when(~is_ff | code.isin("D9", "DA") | seg_len.isNull() | (seg_len < 2), stop)
            .otherwise(nxt)
        )

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(FIRST_WALK)), init, step)
    # As many steps as bytes, in root times root: a sequence of the file's length is never built.
    root = F.sequence(F.lit(1), F.ceil(F.sqrt(F.greatest(F.lit(1), F.octet_length(c)))).cast("int"))
    onwards = F.aggregate(root, walked, lambda acc, _: F.when(acc["done"], acc).otherwise(F.aggregate(root, acc, step)))
    walked = F.when(walked["done"], walked).otherwise(onwards)
    jpeg = F.hex(F.substring(c, 1, 2)) == JPEG_START
    jpeg_size = F.struct(walked["width"].alias("width"), walked["height"].alias("height"))
    none = F.struct(F.lit(None).cast("bigint").alias("width"), F.lit(None).cast("bigint").alias("height"))
    return F.when(png, png_size).when(jpeg, jpeg_size).otherwise(none)
