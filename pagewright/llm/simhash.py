"""SimHash near-deduplication with Golay-code fuzzy hashing.

A document's 64-bit fingerprint: XXH64 of every word shingle, one majority
vote per bit.  Two fingerprints link when at most ``MAX_BITS`` (3) bits differ.

Candidate search.  The 64 bits are three segments of 22, 21 and 21 bits, each
zero-padded to a word of the perfect binary Golay code [23, 12, 7].  Decoding
maps a word to the index of its codeword; the indices of all codewords within
distance 4 of a word (one to six of them) contain the codeword that any word
at distance 0 or 1 decodes to.  So two segments that differ in at most one bit
always share a key: one side stores its decoded index, the other asks for all
its nearby indices.  Three differing bits fall on the segments in one of two
ways (pigeonhole):

* some segment has none; then one of the other two has at most one.  Keys:
  the error-free segment exactly (21-22 bits) with the other's codeword index
  (12 bits), for each ordered pair of segments;
* every segment has exactly one.  Then segment 0 matches by codeword index and
  segments 1 and 2 each have an error-free half.  Keys: index with one half of
  each, four combinations.

That covers every pair within 3 bits, and every key has 33 bits or more.

Every distinct fingerprint gives 10 stored and about 53 asked keys; equal
fingerprints are one row throughout, so copies cost nothing.  Rows are
shuffled by key and sorted, and each task sweeps its keys' rows with numpy,
verifies the distance exactly and emits only a spanning forest of the links it
found: never all pairs of a bucket, and no link is lost.  A key with more than
``HOT_BUCKET`` rows, estimated on a sample of fingerprints, is cut into blocks; every
pair of blocks is compared in a task of its own.  A wrong estimate changes
only the work per task.  The list of hot keys sent to tasks is bounded by
``MAX_HOT``.

Nulls: a null text is empty and has fingerprint zero, which links like any
other; a null id takes part but can't name a component unless all its ids are
null.  Texts of any length are hashed whole, in blocks of shingles.  An empty
table gives an empty result; extra columns can't clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import connected_components, materialize, packed, plus, ship, text_of
from pagewright.operators.ranking import join_per_group

SHINGLE = 3
MAX_BITS = 3
SEED = 42
SEGMENTS = ((42, 22), (21, 21), (0, 21))  # (shift, bits)
GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
HOT_BUCKET = 4096
SAMPLE = 64  # one fingerprint in so many estimates the hot keys
MAX_HOT = 100_000
BLOCK = 1 << 20  # bytes of a text hashed at a time


# ------------------------------------------------------------- fingerprints

def _word_blocks(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, lower-cased, some ``BLOCK`` bytes at a time."""
    space = re.compile(rb"[\x20\x09-\x0D]")
    at = 0
    while at < len(raw):
        cut = space.search(raw, min(len(raw), at + BLOCK))
        end = cut.start() if cut else len(raw)
        # bytes: lower() changes A-Z only, split() knows only ASCII white space
        yield raw[at:end].lower().split()
        at = end


def fingerprint_bytes(raw: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of a UTF-8 text as an unsigned 64-bit number."""
    import numpy as np
    import xxhash

    digest = xxhash.xxh64_intdigest
    ones, total, tail = np.zeros(64, np.int64), 0, []
    for words in _word_blocks(raw):
        words = tail + words
        k = len(words) - shingle + 1
        if k > 0:
            text = b" ".join(words)
            ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
            begins = [0, *[e + 1 for e in ends[:k - 1]]]
            hashes = np.array([digest(text[b:e], SEED) for b, e in zip(begins, ends[shingle - 1:])], np.uint64)
            ones += np.unpackbits(hashes.view(np.uint8).reshape(k, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            total += k
            words = words[k:]
        tail = words
    if not total:
        return digest(b" ".join(tail), SEED) if tail else 0
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0])


def with_fingerprint(rows: DataFrame, text_col: str, out: str, shingle: int = SHINGLE, keep_text: bool = True) -> DataFrame:
    """Adds ``out``, the fingerprint as a signed long; ``text_col`` must be a non-null string column."""
    ship()
    others = [c for c in rows.columns if keep_text or c != text_col]
    schema = plus(rows.select(*others).schema, f"{out} long")

    def hash_texts(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            fps = np.fromiter((fingerprint_bytes(t.as_buffer().to_pybytes(), shingle) for t in texts), np.uint64, batch.num_rows)
            cols = [batch.column(batch.schema.get_field_index(c)) for c in others]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(fps.view(np.int64))], names=[*others, out])

    return rows.mapInArrow(hash_texts, schema)


# --------------------------------------------------------------- Golay code

@lru_cache(maxsize=1)
def golay_tables():
    """``(syndrome parts, nearby)``: tables of the [23, 12, 7] code.

    The syndrome of a word is the remainder modulo the generator, the XOR of
    one entry per 8-bit part.  ``nearby[s]`` lists the error patterns of
    weight up to 4 with syndrome ``s``, lightest first, the first repeated to
    fill six places; ``word ^ pattern`` is a codeword within distance 4.
    """
    from itertools import combinations

    import numpy as np

    def remainder(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GENERATOR << (bit - 11)
        return word

    unit = [remainder(1 << i) for i in range(24)]
    parts = np.zeros((3, 256), np.int64)
    for p in range(3):
        for byte in range(256):
            for i in range(8):
                if byte >> i & 1 and 8 * p + i < 23:
                    parts[p, byte] ^= unit[8 * p + i]
    found: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for places in combinations(range(23), weight):
            s = 0
            for i in places:
                s ^= unit[i]
            found[s].append(sum(1 << i for i in places))
    nearby = np.array([(x + [x[0]] * 6)[:6] for x in found], np.int64)
    return parts, nearby


def codewords_near(words):
    """Indices (12 bits) of the codewords within distance 4 of each 23-bit word: an ``(n, 6)`` array.

    Column 0 is the word's own decoding; unused places repeat it.
    """
    parts, nearby = golay_tables()
    s = parts[0][words & 255] ^ parts[1][words >> 8 & 255] ^ parts[2][words >> 16 & 255]
    return (words[:, None] ^ nearby[s]) >> 11


def fuzzy_keys(fps):
    """``(stored, asked)``: key arrays of shape ``(n, 10)`` and ``(n, 60)`` for unsigned fingerprints.

    ``asked`` repeats a key where a word has fewer than six nearby codewords.
    """
    import numpy as np

    seg = [((fps >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64) for shift, bits in SEGMENTS]
    near = [codewords_near(s) for s in seg]
    kinds = []
    for i in range(3):
        for j in range(3):
            if i != j:
                kinds.append((seg[i], near[j]))
    cut = 11
    for a in range(2):
        for b in range(2):
            half1 = seg[1] & ((1 << cut) - 1) if a == 0 else seg[1] >> cut
            half2 = seg[2] & ((1 << cut) - 1) if b == 0 else seg[2] >> cut
            kinds.append(((half1 << cut) | half2, near[0]))
    stored = np.stack([(np.int64(k) << 40) | (exact << 12) | idx[:, 0] for k, (exact, idx) in enumerate(kinds)], axis=1)
    asked = np.concatenate([(np.int64(k) << 40) | (exact << 12)[:, None] | idx for k, (exact, idx) in enumerate(kinds)], axis=1)
    return stored, asked


# --------------------------------------------------------------- fuzzy join

def spanning_forest(a, b):
    """A spanning forest of the links ``a[i] - b[i]``: each node with the smallest of its tree."""
    import numpy as np

    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        # Hook the old labels' trees as well, then shorten the paths.
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while True:
            short = new[new]
            if np.array_equal(short, new):
                break
            new = short
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def links_in_buckets(bucket, fps, stored, max_bits: int = MAX_BITS):
    """Spanning links among rows sorted by ``bucket``: pairs with one ``stored`` side within ``max_bits``.

    Sweeps by distance in the sort order: step ``d`` compares each row with
    the one ``d`` places on, while both are in the same bucket.
    """
    import numpy as np

    n = len(bucket)
    out_a, out_b, held = [], [], 0
    at = np.arange(n)
    d = 1
    while len(at):
        at = at[at + d < n]
        at = at[bucket[at] == bucket[at + d]]
        if not len(at):
            break
        x, y = fps[at], fps[at + d]
        near = (np.bitwise_count(x ^ y) <= max_bits) & (x != y) & (stored[at] | stored[at + d])
        if near.any():
            out_a.append(x[near])
            out_b.append(y[near])
            held += len(out_a[-1])
            if held > 1 << 20:
                a, b = spanning_forest(np.concatenate(out_a), np.concatenate(out_b))
                out_a, out_b, held = [a], [b], len(a)
        d += 1
    if not out_a:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return spanning_forest(np.concatenate(out_a), np.concatenate(out_b))


def _key_rows(fps: DataFrame, hot: dict[int, int]) -> DataFrame:
    """``_bucket, fp, stored``: every key of every fingerprint, hot keys cut into pairs of blocks."""
    hot_keys = sorted(hot)
    hot_blocks = [hot[k] for k in hot_keys]

    def keys(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        many = np.array(hot_keys, np.int64)
        blocks = np.array(hot_blocks, np.int64)
        mix1, mix2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
        for batch in batches:
            whole = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for start in range(0, len(whole), 4096):
                fp = whole[start:start + 4096]
                stored, asked = fuzzy_keys(fp)
                asked = np.sort(asked, axis=1)
                fresh = np.ones(asked.shape, bool)
                fresh[:, 1:] = asked[:, 1:] != asked[:, :-1]
                own = (asked[:, :, None] == stored[:, None, :]).any(axis=2)[fresh]
                key = asked[fresh]
                rows = np.broadcast_to(np.arange(len(fp))[:, None], asked.shape)[fresh]
                x = fp[rows]
                bucket = (key.astype(np.uint64) * mix1)
                if len(many):
                    i = np.minimum(np.searchsorted(many, key), len(many) - 1)
                    is_hot = many[i] == key
                    if is_hot.any():
                        nb = blocks[i[is_hot]]
                        block = ((x[is_hot] * mix2) >> np.uint64(20)).astype(np.int64) % nb
                        copy = np.repeat(np.arange(len(nb)), nb)
                        other = np.arange(len(copy)) - np.repeat(np.cumsum(nb) - nb, nb)
                        lo, hi = np.minimum(block[copy], other), np.maximum(block[copy], other)
                        cell = bucket[is_hot][copy] ^ ((lo * (1 << 20) + hi + 1).astype(np.uint64) * mix2)
                        bucket = np.concatenate([bucket[~is_hot], cell])
                        own = np.concatenate([own[~is_hot], own[is_hot][copy]])
                        x = np.concatenate([x[~is_hot], x[is_hot][copy]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket.view(np.int64)), pa.array(x.view(np.int64)), pa.array(own)],
                    names=["_bucket", "fp", "stored"],
                )

    return fps.select("fp").mapInArrow(keys, "_bucket long, fp long, stored boolean")


def _distinct_by_row(keys):
    """The flat keys of each row, repeats within a row left out."""
    import numpy as np

    keys = np.sort(keys, axis=1)
    fresh = np.ones(keys.shape, bool)
    fresh[:, 1:] = keys[:, 1:] != keys[:, :-1]
    return keys[fresh]


def _hot_keys(fps: DataFrame) -> dict[int, int]:
    """Blocks for keys that hold more than ``HOT_BUCKET`` rows by a sampled estimate."""

    def keys(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(_distinct_by_row(fuzzy_keys(fp)[1]))], names=["key"])

    sample = fps.filter(F.pmod(F.xxhash64("fp"), F.lit(SAMPLE)) == 0).select("fp")
    counts = sample.mapInArrow(keys, "key long").groupBy("key").agg((F.count(F.lit(1)) * SAMPLE).alias("n"))
    rows = counts.filter(F.col("n") > HOT_BUCKET).orderBy(F.desc("n"), "key").limit(MAX_HOT).collect()
    return {r["key"]: min(1 << 19, -(-2 * r["n"] // HOT_BUCKET)) for r in rows}


def near_links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``a, b``: links between distinct fingerprints (column ``fp``) that span all links within ``max_bits``."""
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"the key scheme covers 0 to {MAX_BITS} differing bits")
    ship()
    rows = _key_rows(fps, _hot_keys(fps))

    def sweep(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        held: list = []
        rows_held = 0

        def flush(parts, last: bool):
            """Links of the complete buckets, and the rows of the bucket still open."""
            bucket, fp, own = (np.concatenate(x) for x in zip(*parts))
            end = len(bucket) if last else int(np.searchsorted(bucket, bucket[-1], "left"))
            a, b = links_in_buckets(bucket[:end], fp[:end], own[:end], max_bits)
            return (a, b), [(bucket[end:], fp[end:], own[end:])]

        def batch_of(a, b):
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append((
                batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64),
                batch.column(2).to_numpy(zero_copy_only=False),
            ))
            rows_held += batch.num_rows
            if rows_held >= 1 << 17:
                (a, b), held = flush(held, False)
                rows_held = len(held[0][0])
                if len(a):
                    yield batch_of(a, b)
        if held:
            (a, b), _ = flush(held, True)
            if len(a):
                yield batch_of(a, b)

    ordered = rows.repartition("_bucket").sortWithinPartitions("_bucket")
    return ordered.mapInArrow(sweep, "a long, b long").distinct()


def components(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``prints`` is a written table ``_id, _fp, _key``; ``_fp, component_id, _keep`` per distinct fingerprint.

    ``component_id`` is the smallest id reachable and ``_keep`` the key of a
    row that has it.
    """
    low = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_key").alias("key")))
    fps = materialize(prints.groupBy(F.col("_fp").alias("fp")).agg(low.alias("low")), "simhash-prints")
    found = connected_components(near_links(fps, max_bits))
    joined = fps.join(found, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp"))
    best = joined.groupBy("root").agg(F.min("low").alias("best"))
    return join_per_group(joined, best, ["root"]).select(
        F.col("fp").alias("_fp"), F.col("best.id").alias("component_id"), F.col("best.key").alias("_keep")
    )


def _prints(docs: DataFrame, id_col: str, text_col: str, carry_rows: bool, shingle: int) -> DataFrame:
    rows = packed(docs)
    cols = [F.col(f"_row.`{id_col}`").alias("_id"), text_of(F.col(f"_row.`{text_col}`")).alias("_text")]
    rows = rows.select(*cols, *(["_row"] if carry_rows else []))
    prints = with_fingerprint(rows, "_text", "_fp", shingle, keep_text=False)
    return materialize(prints.withColumn("_key", F.monotonically_increasing_id()), "simhash-rows")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS,
                shingle: int = SHINGLE) -> DataFrame:
    """Per document: ``id_col, fingerprint`` (16 hex digits)``, component_id, kept``."""
    prints = _prints(docs, id_col, text_col, False, shingle)
    out = join_per_group(prints, components(prints, max_bits), ["_fp"])
    return out.select(
        F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id",
        (F.col("_key") == F.col("_keep")).alias("kept"),
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS,
                     shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs``, one of each component: the one with the smallest id."""
    rows = _prints(docs, id_col, text_col, True, shingle)
    keep = components(rows.drop("_row"), max_bits).select(F.col("_keep").alias("_key")).distinct()
    return rows.join(keep, "_key").select("_row.*")
