"""Exact deduplication by distributed MSD radix partitioning.

Documents start in one group.  Each round reads the next digit of every
document that still has company, a run of successive UTF-8 bytes, and splits
its group by that digit.  A group of one is finished; so is a group whose
texts have ended, and its members are equal because every byte was compared.
No digest decides equality.

The digit starts at 256 bytes and grows eightfold a round (up to 16 MB), so
the number of rounds is logarithmic in the text length and long shared
prefixes cost few rounds.  A round is one partial aggregation (copies are
counted map-side before the shuffle) and one join with the written groups,
both on ``(group, digit, ended)``; both join sides are read from storage, so
AQE splits a hot group's rows over tasks.  Each round's rows are written to the
shared folder; only undecided rows go on, with what is left of their text.

Nulls: a null text counts as empty; a null id sorts below every id.  Empty
texts form one group.  Repeated rows (same id, same text) are one group and
exactly one of them stays.  Extra columns travel in a struct and can't clash.
An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from pagewright.llm.common import materialize, packed, text_of
from pagewright.operators.ranking import join_per_group

FIRST_DIGIT = 256
GROWTH = 8
LONGEST_DIGIT = 16 << 20


def _rounds(rows: DataFrame, carried: Column | None) -> list[DataFrame]:
    """Written tables, one per round, whose decided rows are ``alone`` or ``ended``.

    ``rows`` has ``_id`` and either ``_tail``, the text's bytes, or ``_row``
    with ``carried``, the text inside it.  Undecided rows take on to the next
    round what is left of ``_tail``, or ``_row``.
    """
    current = rows.withColumn("_gid", F.lit(0).cast("long"))
    tables: list[DataFrame] = []
    offset, width = 0, FIRST_DIGIT
    while True:
        if carried is None:
            digit, ended = F.substring("_tail", 1, width), F.octet_length("_tail") <= width
            keyed = current.withColumn("_digit", digit).withColumn("_ended", ended)
            keyed = keyed.withColumn("_tail", F.substring("_tail", width + 1, 2 ** 31 - 1 - width))
        else:
            raw = carried.cast("binary")
            keyed = current.withColumn("_digit", F.substring(raw, offset + 1, width))
            keyed = keyed.withColumn("_ended", F.octet_length(raw) <= offset + width)
        groups = (
            keyed.groupBy("_gid", "_digit", "_ended").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
            .select("_gid", "_digit", "_ended", F.monotonically_increasing_id().alias("_next"))
        )
        groups = materialize(groups, "radix-groups")
        joined = keyed.join(groups, ["_gid", "_digit", "_ended"], "left")
        state = F.when(F.col("_next").isNull(), "alone").when(F.col("_ended"), "ended").otherwise("open")
        pos = F.col("_pos") if tables else F.monotonically_increasing_id().alias("_pos")
        cols = ["_id", F.col("_next").alias("_gid"), state.alias("_state"), pos]
        if carried is None:
            cols.append(F.when(state == "open", F.col("_tail")).alias("_tail"))
            cols.append(F.col("_sha") if tables else F.sha2(F.concat("_digit", "_tail"), 256).alias("_sha"))
        else:
            cols.append(F.col("_row"))
        seen = Observation()
        out = joined.select(*cols).observe(seen, F.count(F.when(F.col("_state") == "open", 1)).alias("open"))
        table = materialize(out, "radix-rows").withColumn("_round", F.lit(len(tables)))
        tables.append(table)
        if not seen.get["open"]:
            return tables
        current = table.filter("_state = 'open'").drop("_state", "_round")
        offset += width
        width = min(width * GROWTH, LONGEST_DIGIT)


def _decided(tables: list[DataFrame]) -> DataFrame:
    """One row per document with ``_keep_id, _size, _kept``."""
    done = reduce(DataFrame.unionByName, [t.filter("_state <> 'open'").drop("_tail") for t in tables])
    ended = done.filter("_state = 'ended'")
    best = F.max(F.struct(F.col("_id").isNotNull().alias("known"), F.col("_id").alias("id"), F.col("_pos").alias("pos")))
    classes = (
        ended.groupBy("_round", "_gid").agg(F.count(F.lit(1)).alias("_size"), best.alias("_best"))
        .select("_round", "_gid", "_size", F.col("_best.id").alias("_keep_id"), F.col("_best.pos").alias("_keep_pos"))
    )
    grouped = (
        join_per_group(ended, classes, ["_round", "_gid"])
        .withColumn("_kept", F.col("_pos") == F.col("_keep_pos")).drop("_keep_pos")
    )
    alone = (
        done.filter("_state = 'alone'")
        .withColumn("_size", F.lit(1).cast("long")).withColumn("_keep_id", F.col("_id")).withColumn("_kept", F.lit(True))
    )
    return alone.unionByName(grouped)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col, keep_id, group_size, kept, text_sha256``.

    ``keep_id`` is the largest id among equal texts; ``text_sha256`` describes
    the text and takes no part in the comparison.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), text_of(F.col(f"`{text_col}`")).cast("binary").alias("_tail"))
    done = _decided(_rounds(rows, None))
    return done.select(
        F.col("_id").alias(id_col), F.col("_keep_id").alias("keep_id"),
        F.col("_size").alias("group_size"), F.col("_kept").alias("kept"), F.col("_sha").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns as they came."""
    rows = packed(docs).select(F.col(f"_row.`{id_col}`").alias("_id"), "_row")
    done = _decided(_rounds(rows, text_of(F.col(f"_row.`{text_col}`"))))
    return done.filter("_kept").select("_row.*")
