"""Best-fit packing of tokenized documents into fixed-length sequences.

A document is its token ids and one separator.  Only documents longer than a
sequence are cut, into full pieces; the first piece takes the remainder.
Pieces are then packed by bulk-synchronous best fit:

1. documents and gaps (open sequences) are range-sorted by size, descending;
2. a successor sweep of each range matches a document with the smallest free
   gap that holds it, one document per gap and round: in the sorted order gaps
   go on a stack and documents take from its top.  Ranges are always swept apart;
   what they leave over is swept once more across them;
3. conflicts for a gap are resolved by rank: the document earlier in the order
   takes it, the next one the next larger gap;
4. matched gaps shrink; the round ends.  Before the next one, as many new
   sequences are opened, with the largest documents left, as the tokens
   that fit in no gap need.

Documents of equal length are interchangeable, and so are sequences with equal
gaps.  They are held as runs (length, first rank, count), so a sweep works on
a few thousand rows whatever the corpus is: the counts come from one partial
aggregation, the plan (run of documents -> run of sequences, offset) is bounded
by the sequence length, and one broadcast look-up by length and rank places
every piece.  A length that a third of all pieces share is one run.  Ranks
within a length come from ``rank_by_position``, which gathers no length in a
task.  Lengths under ``capacity / SMALL`` travel in bundles, which bounds the
number of rounds.

Every round's runs are written to the shared folder; nothing is recomputed if
an executor is lost.

Nulls: a null text is empty (one separator); a null id is kept.  Repeated rows
are separate documents.  Texts of any length are encoded whole, piece by
piece.  An empty table gives an empty result; only the named columns are used.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.llm.common import materialize, positions, rank_by_position, ship, text_of
from pagewright.llm.tokens import shared_encoder

CAPACITY = 2048
SEPARATOR = 0
SMALL = 32
RANGES = 8  # of sizes, swept apart
RUNS = "is_doc int, size long, tokens long, per long, start long, n long, g_size long, g_start long"
PIECES = "piece int, start long, length long, ids_crc32 long"


def tokenize_pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
                    capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``id_col, piece, start, length, ids_crc32`` and, if asked for, ``ids``."""
    ship()
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), text_of(F.col(f"`{text_col}`")).alias("_text"))
    schema = T.StructType([
        T.StructField(id_col, rows.schema["_id"].dataType), *T.StructType.fromDDL(PIECES + (", ids array<int>" if with_ids else "")).fields
    ])

    def encode(batches: Iterator) -> Iterator:
        import zlib

        import numpy as np
        import pyarrow as pa

        encoder = shared_encoder(vocabulary)
        end = np.array([SEPARATOR], "<u4")

        def out(at, rows, ids):
            if not rows:
                return None
            cols = list(zip(*rows))
            arrays = [batch.column(0).take(pa.array(at))]
            arrays += [pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            if with_ids:
                arrays.append(pa.array(ids, pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(arrays, names=schema.names)

        for batch in batches:
            at, rows, ids, held = [], [], [], 0
            for i, text in enumerate(batch.column(1)):
                doc = np.concatenate([encoder.encode(text.as_py()), end]).astype("<u4", copy=False)
                start, length = 0, len(doc) % capacity if len(doc) > capacity else len(doc)
                length = length or capacity
                piece = 0
                while start < len(doc):
                    part = doc[start:start + length]
                    at.append(i)
                    rows.append((piece, start, length, zlib.crc32(part.tobytes())))
                    if with_ids:
                        ids.append(part.astype(np.int32))
                        held += length
                    start, piece, length = start + length, piece + 1, capacity
                if held > 1 << 22:
                    yield out(at, rows, ids)
                    at, rows, ids, held = [], [], [], 0
            if rows:
                yield out(at, rows, ids)

    return rows.mapInArrow(encode, schema)


# -------------------------------------------------------------------- rounds

def _open_runs(chosen: dict[tuple[int, int, int], tuple[int, int]], capacity: int):
    """Splits the document runs ``chosen`` (size, per, start) -> (count, first sequence) off into new sequences."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                count, first = chosen.get((r["size"], r["per"], r["start"]), (0, 0)) if r["is_doc"] == 1 else (0, 0)
                if count:
                    rows.append({**r, "is_doc": 2, "n": count, "g_size": capacity, "g_start": first})
                    if r["size"] < capacity:
                        rows.append({"is_doc": 0, "size": capacity - r["size"], "tokens": 0, "per": 1, "start": first, "n": count,
                                     "g_size": None, "g_start": None})
                if r["n"] > count:
                    rows.append({**r, "start": r["start"] + count * r["per"], "n": r["n"] - count})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=batch.schema)

    return run


def _sweep(batches: Iterator) -> Iterator:
    """Successor sweep of one size range, rows sorted by size (largest first), gaps before documents.

    A stack holds the free gaps, smallest on top; each document run takes from
    the top.  A run is cut where its partner changes.  Rows of sequences opened
    this round pass through.
    """
    import pyarrow as pa

    out, free, schema = [], [], None
    last = None

    def part(r, skip, n, gap=None, gap_skip=0):
        step = r["per"] if r["is_doc"] else 1
        out.append({**r, "start": r["start"] + skip * step, "n": n, "g_size": gap and gap["size"], "g_start": gap and gap["start"] + gap_skip})

    def take(r):
        if r["is_doc"] == 0:
            free.append([r, 0])
            return
        done = 0
        while done < r["n"] and free:
            gap, used = free[-1]
            n = min(r["n"] - done, gap["n"] - used)
            part(r, done, n, gap, used)
            done += n
            if used + n == gap["n"]:
                free.pop()
            else:
                free[-1][1] = used + n
        if done < r["n"]:
            part(r, done, r["n"] - done)

    for batch in batches:
        schema = batch.schema
        for r in batch.to_pylist():
            if r["is_doc"] == 2:
                out.append(r)
                continue
            same = last is not None and all(last[k] == r[k] for k in ("is_doc", "size", "tokens", "per"))
            if same and last["start"] + last["n"] * (last["per"] if last["is_doc"] else 1) == r["start"]:
                last["n"] += r["n"]  # neighbouring runs are one
                continue
            if last is not None:
                take(last)
            last = r
    if last is not None:
        take(last)
    for gap, used in free:
        part(gap, used, gap["n"] - used)
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def _swept(runs: DataFrame) -> list[DataFrame]:
    """Sweeps ``RANGES`` size ranges in parallel, then what they left over across the ranges; written tables."""
    order = [F.desc("size"), "is_doc", "tokens", "per", "start"]
    parts = materialize(
        runs.repartitionByRange(RANGES, F.desc("size")).sortWithinPartitions(*order).mapInArrow(_sweep, RUNS), "packing-parts"
    )
    left = parts.filter("g_size is null")
    rest = materialize(left.coalesce(1).sortWithinPartitions(*order).mapInArrow(_sweep, RUNS), "packing-parts")
    return [parts.filter("g_size is not null"), rest]


def plan_packing(lengths: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``tokens, per, rank, n, sequence, offset`` from the counts ``length, n`` of pieces up to ``capacity``.

    The pieces of length ``tokens`` with ranks from ``rank`` on go, ``per`` at
    a time, to ``n`` successive sequences from ``sequence`` on, at ``offset``.
    """
    ship()
    spark = lengths.sparkSession
    per = F.greatest(F.lit(1), F.floor(F.lit(capacity // SMALL) / F.col("length"))).cast("long")
    base = lengths.select(F.col("length").cast("long").alias("tokens"), F.col("n").cast("long").alias("all"), per.alias("per"))
    null, zero, one = F.lit(None).cast("long"), F.lit(0).cast("long"), F.lit(1).cast("long")
    doc = lambda per, start, n: base.select(
        F.lit(1).alias("is_doc"), (F.col("tokens") * per).alias("size"), "tokens", per.alias("per"), start.alias("start"), n.alias("n"),
        null.alias("g_size"), null.alias("g_start"))
    whole = F.floor(F.col("all") / F.col("per")).cast("long")
    rest = F.col("all") - whole * F.col("per")
    state = materialize(doc(F.col("per"), zero, whole).unionByName(doc(one, whole * F.col("per"), rest)).filter("n > 0"), "packing-runs")
    plans, first = [], 0
    while True:
        # Runs, not pieces: their number depends on the capacity, not on the corpus.
        runs = state.select("is_doc", "size", "per", "start", "n").collect()
        left = sorted((r for r in runs if r["is_doc"] == 1), key=lambda r: (-r["size"], r["per"], r["start"]))
        if not left:
            break
        gaps = [r for r in runs if r["is_doc"] == 0]
        small, big = left[-1]["size"], max((r["size"] for r in gaps), default=0)
        must = sum(r["n"] for r in left if r["size"] > max(big, capacity // 2))
        space = sum(r["size"] * r["n"] for r in gaps if r["size"] >= small)
        tokens = sum(r["size"] * r["n"] for r in left)
        want = max(must, -(-(tokens - space) // capacity), 1 if big < small else 0)
        chosen = {}
        for r in left:
            count = min(want, r["n"])
            if count > 0:
                chosen[(r["size"], r["per"], r["start"])] = (count, first)
                want, first = want - count, first + count
        usable = state.filter((F.col("is_doc") == 1) | (F.col("size") >= small))  # smaller gaps are finished
        swept = _swept(usable.mapInArrow(_open_runs(chosen, capacity), RUNS))
        parts = reduce(DataFrame.unionByName, swept)
        plans.append(parts.filter("is_doc > 0 and g_size is not null").select(
            "tokens", "per", F.col("start").alias("rank"), "n", F.col("g_start").alias("sequence"), (F.lit(capacity) - F.col("g_size")).alias("offset")
        ))
        shrunk = parts.filter("is_doc = 1 and g_size is not null").select(
            F.lit(0).alias("is_doc"), (F.col("g_size") - F.col("size")).alias("size"), zero.alias("tokens"), one.alias("per"),
            F.col("g_start").alias("start"), "n", null.alias("g_size"), null.alias("g_start"))
        state = parts.filter("g_size is null").unionByName(shrunk).filter("size > 0")
    if not plans:
        return spark.createDataFrame([], "tokens long, per long, rank long, n long, sequence long, offset long")
    return reduce(DataFrame.unionByName, plans)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id, offset`` to ``pieces`` (any columns, with ``length`` from 1 to ``capacity``)."""
    numbered = materialize(positions(pieces), "packing-pieces")
    plan = plan_packing(numbered.groupBy("length").agg(F.count(F.lit(1)).alias("n")), capacity)
    plan = materialize(plan, "packing-plan")
    ranked = rank_by_position(numbered, ["length"], "_rank")
    # The plan's size depends on the capacity, not on the corpus.
    step = F.col("_rank") - F.col("rank")
    here = (F.col("length") == F.col("tokens")) & (step >= 0) & (step < F.col("n") * F.col("per"))
    placed = ranked.join(F.broadcast(plan), here)
    return placed.select(
        *pieces.columns, (F.col("sequence") + F.floor(step / F.col("per"))).cast("long").alias("sequence_id"),
        (F.col("offset") + step % F.col("per") * F.col("tokens")).cast("long").alias("_offset"),
    ).withColumnRenamed("_offset", "offset")


def pack_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
                   capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Per piece: ``id_col, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``)."""
    return pack(tokenize_pieces(docs, vocabulary, id_col, text_col, capacity, with_ids), capacity)


def sequences(packed_pieces: DataFrame) -> DataFrame:
    """``sequence_id, ids``: the packed sequences of ``pack_documents(..., with_ids=True)``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed_pieces.groupBy("sequence_id").agg(parts.alias("_p")).select(
        "sequence_id", F.flatten(F.transform("_p", lambda p: p["ids"])).alias("ids")
    )
