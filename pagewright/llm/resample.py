"""Importance resampling towards a target: the documents that look most like it, drawn with noise.

Words are runs of letters and digits (A-Z in lower case), features all runs of
one to three consecutive words, hashed by CRC-32 into ``BUCKETS`` buckets.  A
bucket's gain is the logarithm of its share in the target over its share in
the documents, in thousandths; a document's weight is the sum of the gains of
its features.  Gumbel noise from its id makes the highest scores a weighted draw
without replacement.

Plan:

* Features are counted in numpy, straight on the text buffers of Arrow batches:
  words by a byte table, CRC-32 for all words of a slice at once, carried on from
  a word over the next two.  Each task sends at most ``BUCKETS`` counts.
* The gains, one number for each bucket, go back to the tasks as an array; a
  second pass over the texts adds them up and writes one narrow row a document.
* The draw is a distributed quickselect on the composite key (score, id, row):
  random pivots among the rows still open, exact counts of the rows below, at
  and above each, and the bounds close in until a pivot is the k-th key.  The
  driver sees the pivots and their counts, a few numbers a round; the number of
  rounds grows with the logarithm of the rows.  The winners alone are sorted,
  over many tasks, and ranked.

Defined cases: null and empty texts have no words, weight 0, and are never
drawn; a null id hashes as the empty text and comes after all others among
ties; repeated rows are rows of their own, their places in the files break the
tie; with an empty target every feature is new to it and gains follow the
formula; an empty table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import materialize, positions, rank_by_position, ship, text_of, with_row_key
from pagewright.operators.ranking import join_per_group

BUCKETS = 10_000
RUN_WORDS = 3  # a feature has at most so many words
MIN_WORDS = 20  # shorter documents are never drawn
PIVOTS = 15  # per round
SLICE = 1 << 17  # words hashed together
LONG_WORD = 128  # bytes; longer words are hashed one by one
TEXT_BYTES = 1 << 22  # of text looked at together


def _tables():
    import numpy as np

    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = np.where(crc & 1, (crc >> 1) ^ np.uint32(0xEDB88320), crc >> 1)
    fold = np.arange(256, dtype=np.uint8)
    fold[ord("A"):ord("Z") + 1] += 32
    inside = np.zeros(256, bool)
    inside[ord("0"):ord("9") + 1] = inside[ord("a"):ord("z") + 1] = inside[128:] = True
    return crc, fold, inside


def _carry_on(state, data, starts, lengths, crc):
    """CRC-32 of what ``state`` stands for, followed by the word ``data[start:start + length]`` (for all words)."""
    import zlib

    import numpy as np

    order = np.argsort(-lengths, kind="stable")
    s, at, length = ~state[order], starts[order], lengths[order]
    long = int(np.searchsorted(-length, -LONG_WORD, side="left"))
    for k in range(long):
        word = data[at[k]:at[k] + length[k]].tobytes()
        s[k] = ~np.uint32(zlib.crc32(word, int(~s[k])))
    most = int(length[long]) if long < len(length) else 0
    for i in range(most):
        n = int(np.searchsorted(-length, -i, side="left"))  # words longer than i
        s[long:n] = crc[(s[long:n] ^ data[at[long:n] + i]) & 0xFF] ^ (s[long:n] >> np.uint32(8))
    out = np.empty_like(s)
    out[order] = ~s
    return out


def _features(data, bounds) -> Iterator[tuple]:
    """``(document, bucket)`` arrays: all features of the texts ``data[bounds[i]:bounds[i + 1]]``; first, words per text."""
    import numpy as np

    crc, fold, inside = _tables()
    data = fold[data]
    word = inside[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    first = bounds[:-1][bounds[:-1] < bounds[1:]]  # a text's first byte follows nothing
    begins[first] = word[first]
    ends = word.copy()
    ends[:-1] &= ~word[1:]
    last = first[1:] - 1
    ends[last] = word[last]
    starts = np.flatnonzero(begins)
    lengths = np.flatnonzero(ends) + 1 - starts
    doc = np.searchsorted(bounds, starts, side="right") - 1
    yield np.bincount(doc, minlength=len(bounds) - 1), None
    for lo in range(0, len(starts), SLICE):
        hi = min(lo + SLICE, len(starts))
        here = np.arange(lo, hi)
        state = np.zeros(hi - lo, np.uint32)
        for k in range(RUN_WORDS):
            if k:  # the next word must be there, in the same text
                inner = here + 1 < len(starts)
                inner[inner] = doc[here[inner] + 1] == doc[here[inner]]
                here, state = here[inner] + 1, state[inner]
                s = ~state
                state = ~(crc[(s ^ np.uint32(0x20)) & 0xFF] ^ (s >> np.uint32(8)))
            state = _carry_on(state, data, starts[here], lengths[here], crc)
            yield doc[here], state % np.uint32(BUCKETS)


def _texts(column) -> Iterator[tuple]:
    """``(from, to, bytes, bounds)``: the rows of an Arrow string column in groups of about ``TEXT_BYTES``."""
    import numpy as np

    wide = column.cast("large_binary")
    _, offsets, data = wide.buffers()
    at = np.frombuffer(offsets, np.int64)[wide.offset:wide.offset + len(wide) + 1]
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(wide):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + TEXT_BYTES, side="right")) - 1)
        hi = min(hi, len(wide))
        yield lo, hi, raw[at[lo]:at[hi]], at[lo:hi + 1] - at[lo]
        lo = hi


def _count(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa

    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, _, data, bounds in _texts(batch.column(0)):
            for _, buckets in _features(data, bounds):
                if buckets is not None:
                    total += np.bincount(buckets, minlength=BUCKETS)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])


def feature_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """``bucket, n``: how often the features of all texts fall into each bucket in use."""
    ship()
    return texts.select(text_of(F.col(f"`{text_col}`")).alias("_text")).mapInArrow(_count, "bucket long, n long").groupBy("bucket").agg(
        F.sum("n").alias("n"))


def bucket_gains(raw: dict[int, int], target: dict[int, int]) -> list[int]:
    """Per bucket ``floor(1000 * ln((t + 1) * (S + B) / ((s + 1) * (T + B))))``, in doubles, ``B`` buckets."""
    all_raw, all_target = float(sum(raw.values()) + BUCKETS), float(sum(target.values()) + BUCKETS)
    return [
        math.floor(1000 * math.log((target.get(b, 0) + 1.0) * all_raw / ((raw.get(b, 0) + 1.0) * all_target)))
        for b in range(BUCKETS)
    ]


def _weigh(gains: list[int]):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        gain = np.array(gains, np.float64)  # sums of whole numbers below 2**53 are exact
        for batch in batches:
            n = batch.num_rows
            words, features, weight = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for lo, hi, data, bounds in _texts(batch.column(batch.num_columns - 1)):
                for doc, buckets in _features(data, bounds):
                    if buckets is None:
                        words[lo:hi] = doc
                        continue
                    features[lo:hi] += np.bincount(doc, minlength=hi - lo)
                    weight[lo:hi] += np.bincount(doc, gain[buckets], hi - lo).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(words), pa.array(features), pa.array(weight)],
                names=[*batch.schema.names[:-1], "n_words", "n_features", "weight"])

    return run


def noise(id_col: Column, seed: int) -> Column:
    """Gumbel noise in thousandths from SHA-256 of ``seed:id``."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), id_col.cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def score_documents(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text",
                    seed: int = 42) -> DataFrame:
    """Per document ``_key`` (names the row), ``id_col, n_words, n_features, weight, score``; a written table."""
    ship()
    raw = {r.bucket: r.n for r in feature_counts(docs, text_col).collect()}  # at most one row a bucket
    wanted = {r.bucket: r.n for r in feature_counts(target, target_text).collect()}
    rows = with_row_key(docs).select(
        "_key", F.col("_row")[id_col].alias(id_col), text_of(F.col("_row")[text_col]).alias("_text"))
    kind = rows.schema[1].dataType.simpleString()
    weighed = rows.mapInArrow(_weigh(bucket_gains(raw, wanted)), f"_key string, `{id_col}` {kind}, n_words long, n_features long, weight long")
    known = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    return materialize(weighed.withColumn("score", F.col("weight") + noise(known, seed)), "resample-scores")


def _order(id_col: str) -> list[tuple[str, Column]]:
    """The composite key, smaller is better: score falling, id rising (null last), then the row's name."""
    c = F.col(f"`{id_col}`")
    return [("_k1", -F.col("score")), ("_k2", c.isNull()), ("_k3", c), ("_k4", F.col("_key"))]


def _before(pivot: Column) -> Column:
    """The row's key is smaller than the pivot's; a null third part equals only another one."""
    out = F.lit(False)
    for name in ("_k4", "_k3", "_k2", "_k1"):
        out = (F.col(name) < pivot[name]) | (F.col(name).eqNullSafe(pivot[name]) & out)
    return F.coalesce(out, F.lit(False))


def _literal(row, like: DataFrame) -> Column:
    return F.struct(*[F.lit(row[f.name]).cast(f.dataType).alias(f.name) for f in like.schema if f.name.startswith("_k")])


def kth_key(rows: DataFrame, k: int, seed: int = 42):
    """The ``k``-th smallest composite key (1-based) of a written table ``_k1.._k4``, as a row.

    Each round draws ``PIVOTS`` random rows of those still open and counts, for
    every pivot at once, the rows before it and at it.  The rows between the
    two pivots around the ``k``-th stay open; keys are distinct, so a round
    without an answer leaves fewer rows than the last one.
    """
    low = high = None  # the open rows are after low and before high
    before_low = 0  # rows up to and with low
    for turn in range(10_000):
        still = rows
        if low is not None:
            here = _literal(low, rows)
            still = still.filter(~_before(here) & (F.col("_k4") != here["_k4"]))
        if high is not None:
            still = still.filter(_before(_literal(high, rows)))
        drawn = still.orderBy(F.xxhash64("_k4", F.lit(seed + turn)), "_k4").limit(PIVOTS).collect()
        if not drawn:
            raise ValueError(f"there are fewer than {k} rows")
        counts = []
        for i, p in enumerate(drawn):
            pivot = _literal(p, rows)
            counts += [F.count_if(_before(pivot)).alias(f"less{i}"), F.count_if(F.col("_k4") == pivot["_k4"]).alias(f"same{i}")]
        got = still.agg(*counts).first()
        for i, p in enumerate(drawn):
            less, same = before_low + got[f"less{i}"], got[f"same{i}"]
            if less < k <= less + same:
                return p
        below = [(got[f"less{i}"] + got[f"same{i}"], p) for i, p in enumerate(drawn) if before_low + got[f"less{i}"] + got[f"same{i}"] < k]
        above = [(got[f"less{i}"], p) for i, p in enumerate(drawn) if before_low + got[f"less{i}"] >= k]
        if below:
            passed, low = max(below, key=lambda x: x[0])
            before_low += passed
        if above:
            high = min(above, key=lambda x: x[0])[1]
    raise RuntimeError("the selection did not end")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, id_col: str = "doc_id", text_col: str = "text",
             target_text: str = "text", min_words: int = MIN_WORDS, seed: int = 42) -> DataFrame:
    """Per document ``id_col, n_features, weight, score, rank``; ``rank`` is null where it was not drawn.

    Of the ``N`` documents with at least ``min_words`` words the
    ``floor(percent * N / 100)`` highest scores are drawn, ties to the smaller id.
    """
    scored = score_documents(docs, target, id_col, text_col, target_text, seed)
    keys = scored.filter(F.col("n_words") >= min_words).select(*[c.alias(n) for n, c in _order(id_col)])
    take = percent * keys.count() // 100
    if take:
        last = _literal(kth_key(keys, take, seed), keys)
        won = keys.filter(_before(last) | (F.col("_k4") == last["_k4"]))
    else:
        won = keys.filter(F.lit(False))
    order = ["_k1", "_k2", "_k3", "_k4"]
    won = materialize(positions(won.repartitionByRange(*order).sortWithinPartitions(*order)), "resample-winners")
    ranked = rank_by_position(won, [], "_rank").select(F.col("_k4").alias("_key"), (F.col("_rank") + 1).alias("rank"))
    return join_per_group(scored, ranked, ["_key"], "left").select(id_col, "n_features", "weight", "score", "rank")
