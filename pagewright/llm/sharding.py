"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Every (key, shard) pair has a hash; a record goes to the shard with the
largest ``-weight / ln(u)``, ``u`` being the hash as a number in (0, 1).  The
key and the shard list alone decide.  A new shard has its own hashes, so it
can only win records for itself, and the expected share moved is its share of
the weight.  All of it is one projection: no shuffle, no state.

The slot of a record inside its shard counts from 0 without gaps.  It is the
record's place among the shard's records in the order of the input's
partitions; ``rank_by_position`` numbers them without gathering a shard (or a
hot key) in one task.

Nulls: a null key hashes as a key of its own (all such rows share one shard);
a null text is empty.  Repeated rows get the same shard and slots of their
own.  Empty tables give empty results; only the named columns are used, so
others can't clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import materialize, packed, positions, rank_by_position, text_of

RECORD_BYTES = 16  # what a record takes besides its text


def rendezvous_shard(key: Column, weights: Sequence[float], salt: str = "shard") -> Column:
    """Index of the shard that ``key`` goes to; shards of weight 0 get nothing."""
    if not any(w > 0 for w in weights):
        raise ValueError("no shard has a positive weight")
    name = F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("null"))
    scores = []
    for shard, weight in enumerate(weights):
        if weight > 0:
            # 52 bits, moved half a step into the open interval (0, 1).
            u = (F.shiftrightunsigned(F.xxhash64(name, F.lit(f"{salt}:{shard}")), 12) + F.lit(0.5)) / F.lit(float(1 << 52))
            scores.append(F.struct((F.lit(-float(weight)) / F.log(u)).alias("score"), F.lit(-shard).alias("minus")))
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return (-best["minus"]).cast("int")


def assign_shards(docs: DataFrame, weights: Sequence[float], grown: Sequence[float] | None = None,
                  key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``key_col, size, text_crc32, shard, slot`` and ``grown_shard`` (null without ``grown``)."""
    raw = text_of(F.col(f"`{text_col}`")).cast("binary")
    key = F.col(f"`{key_col}`")
    shards = docs.select(
        key.alias("_key"),
        (F.octet_length(raw) + F.lit(RECORD_BYTES)).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        rendezvous_shard(key, weights).alias("shard"),
        (rendezvous_shard(key, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
    )
    numbered = rank_by_position(materialize(positions(shards), "shards"), ["shard"], "slot")
    return numbered.select(F.col("_key").alias(key_col), "size", "text_crc32", "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, weights: Sequence[float], key_col: str = "doc_id",
                 files_per_shard: int = 1) -> None:
    """Write the rows of ``docs`` under ``path/_shard=<n>/``, each shard in ``files_per_shard`` parts.

    Raise ``files_per_shard`` with the data so that one part stays a task's work.
    """
    rows = packed(docs).withColumn("_shard", rendezvous_shard(F.col(f"_row.`{key_col}`"), weights))
    part = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(files_per_shard))
    n = max(1, len(weights) * files_per_shard)
    rows = rows.withColumn("_part", part).repartition(n, "_shard", "_part")
    rows.select("_shard", "_row.*").write.partitionBy("_shard").parquet(path)
