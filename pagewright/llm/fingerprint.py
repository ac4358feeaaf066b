"""Document fingerprints: a bottom-k sketch of word shingles, in plain column expressions.

A sketch holds the ``K`` smallest distinct hashes of a text's shingles (five
words; fewer words: the whole sequence; none: no shingle).  A hash is the first
16 hex digits of the shingle's MD5, so hashes sort as texts.  The bottom ``K`` of
two sketches together is the sketch of both texts together, which makes
sketches mergeable; with the estimators below they give, without the texts,

* the number of distinct shingles: exact below ``K``, else ``(K - 1) / u`` with
  ``u`` the largest hash kept as a fraction of all hashes;
* resemblance (Jaccard): the share of the merged sketch that both hold;
* containment: how much of the first's shingles the second holds.

The method in a row: a text is cut into blocks of ``BLOCK_WORDS`` words, each
completed by the words its last shingles need from the next, and the blocks'
sketches are merged one after another.  Beside the text only one block's words
and ``K`` hashes are held, however long the text.

``fingerprint_edits`` puts each document beside the next one by id: ranks come
from a range sort of ids alone, and texts are shuffled once.  What a document
needs of the next one (the first characters and the sketch) is sent to it; the
keys are single rows, so no key is hot.  No Python, no UDF.

Defined cases: null counts as the empty text, which has the empty sketch; two
empty sketches are alike (1), an empty and another one are not (0); equal texts
have equal fingerprints.  Ids may repeat or be null: they are ordered by id, null
last, and by the row's place in its file.  The only document of a table is its
own next one.  An empty table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import WORD, materialize, positions, rank_by_position, text_of, with_row_key

K = 128  # hashes in a sketch
SHINGLE = 5  # words
BLOCK_WORDS = 512
DIGITS = 16  # hex digits of a hash


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def lowest(hashes: Column, k: int = K) -> Column:
    """The ``k`` smallest distinct hashes."""
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merge_sketches(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both texts' shingles together."""
    return lowest(F.concat(a, b), k)


def _hashes(words: Column, n: int, whole: Column) -> Column:
    """Hashes of all ``n``-word shingles of an array of words; fewer words are one shingle if they are the ``whole`` text."""
    def digest(shingle: Column) -> Column:
        return F.substring(F.md5(shingle.cast("binary")), 1, DIGITS)

    def one(i: Column) -> Column:  # plain concat: several times as fast as joining a slice
        return digest(F.concat(F.get(words, i), *[x for j in range(1, n) for x in (F.lit(" "), F.get(words, i + j))]))

    size = F.size(words)
    full = F.transform(F.sequence(F.lit(0), F.greatest(size - n, F.lit(0))), one)
    short = F.filter(F.array(digest(F.array_join(words, " "))), lambda _: whole & (size > 0))
    return F.when(size >= n, full).otherwise(short)


def sketch(text: Column, k: int = K, n: int = SHINGLE, block_words: int = BLOCK_WORDS) -> Column:
    """``array<string>``: the sketch of a text's shingles."""
    word, space = WORD + "+", WORD.replace("[^", "[") + "+"  # possessive: no backtracking in long texts
    block = rf"{word}(?:{space}{word}){{0,{block_words - 1}}}+"
    none = F.array().cast("array<string>")

    def fold(blocks: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            here = F.regexp_extract_all(F.get(blocks, i), F.lit(word), 0)
            ahead = F.regexp_extract(F.coalesce(F.get(blocks, i + 1), F.lit("")), rf"^{word}(?:{space}{word}){{0,{n - 2}}}+", 0)
            following = F.regexp_extract_all(ahead, F.lit(word), 0)
            found = _let(F.concat(here, following), lambda words: _hashes(words, n, i + F.size(blocks) == 1))
            full = F.coalesce(F.get(acc, F.lit(k - 1)), F.lit("g"))  # "g" is beyond every hash
            return _let(full, lambda last: lowest(F.concat(acc, F.filter(found, lambda h: h < last)), k))

        indexes = F.when(F.size(blocks) > 0, F.sequence(F.lit(0), F.size(blocks) - 1))
        return F.aggregate(F.coalesce(indexes, F.array().cast("array<int>")), none, step)

    if not 2 <= n <= block_words:
        raise ValueError("a shingle has at least two words, and no more than a block")
    return _let(F.regexp_extract_all(text, F.lit(block), 0), fold)


def as_text(hashes: Column) -> Column:
    """The fingerprint as one string: the hashes by size, 16 hex digits each."""
    return F.array_join(hashes, "")


def from_text(fingerprint: Column) -> Column:
    """The hashes of ``as_text``."""
    return F.regexp_extract_all(fingerprint, F.lit(rf"[0-9a-f]{{{DIGITS}}}"), 0)


def distinct_shingles(hashes: Column, k: int = K) -> Column:
    """The number of distinct shingles: exact below ``k`` hashes, an estimate from the largest of them beyond."""
    largest = F.conv(F.get(hashes, F.lit(k - 1)), 16, 10).cast("double")
    return F.when(F.size(hashes) < k, F.size(hashes).cast("double")).otherwise(
        F.lit(float(k - 1)) / ((largest + 1.0) / F.lit(2.0**64)))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the shingles of either text that both hold, 0 to 1."""
    def share(both: Column) -> Column:
        common = F.size(F.array_intersect(F.array_intersect(both, a), b))
        return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(common.cast("double") / F.size(both))

    return _let(merge_sketches(a, b, k), share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the first text's shingles that the second holds, 0 to 1."""
    either = distinct_shingles(merge_sketches(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(
        F.least(F.lit(1.0), resemblance(a, b, k) * either / distinct_shingles(a, k)))


def merge_fingerprints(rows: DataFrame, group: str, sketch_col: str, out: str = "sketch", k: int = K) -> DataFrame:
    """``group, out``: the sketch of all rows of a group (parts of a document, documents of a source).

    Hashes are made distinct and ranked per group; a group's rank is cut at
    ``k`` in every task before the shuffle, so a hot group sends ``k`` hashes a
    task, not its rows.
    """
    from pyspark.sql import Window

    hashes = rows.select(F.col(f"`{group}`").alias(group), F.explode_outer(F.col(f"`{sketch_col}`")).alias("_h")).distinct()
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.col("_h").asc_nulls_last()))
    least = hashes.withColumn("_n", rank).filter(F.col("_n") <= k)
    return least.groupBy(group).agg(F.sort_array(F.collect_list("_h")).alias(out))


def _ordered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_key, _before, _wanted``: each row's predecessor by id, and how many characters that one takes from it."""
    at = F.col("_row")
    narrow = with_row_key(docs).select("_key", at[id_col].alias("_id"), F.char_length(text_of(at[text_col])).cast("long").alias("_n"))
    order = [F.col("_id").asc_nulls_last(), F.col("_key")]
    placed = materialize(positions(narrow.repartitionByRange(*order).sortWithinPartitions(*order)), "fingerprint-order")
    ranked = materialize(rank_by_position(placed, [], "_rank").select("_key", "_rank", "_n"), "fingerprint-rank")
    total = F.lit(ranked.count())
    previous = ranked.select(F.col("_key").alias("_before"), F.floor(F.col("_n") / 4).cast("int").alias("_wanted"),
                             ((F.col("_rank") + 1) % total).alias("_rank"))
    return ranked.select("_key", "_rank").join(previous, "_rank").drop("_rank")


def _bytes(hashes: Column) -> Column:
    return F.unhex(as_text(hashes))


def _from_bytes(packed: Column) -> Column:
    return from_text(F.lower(F.hex(packed)))


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """Per document its sketch, that of its edited text and that of the next document.

    The edited text has its last quarter of characters (rounded down) replaced
    by as many of the first ones of the next document by id (or all it has).
    Columns: ``id_col, n_chars, edited, sketch, edited_sketch, next_id, next_sketch``.
    """
    at = F.col("_row")
    texts = with_row_key(docs).select("_key", at[id_col].alias("_id"), text_of(at[text_col]).alias("_text"))
    # Sketched before the shuffle: both sides of the last join read this one exchange.  Spark sees that
    # it is the same one as long as both ids are kept, so a caller keeps ``next_id``.
    texts = texts.withColumn("_sketch", _bytes(sketch(F.col("_text"), k)))
    sent = texts.join(_ordered(docs, id_col, text_col), "_key").select(
        F.col("_before").alias("_to"), F.col("_id").alias("next_id"), F.left("_text", F.col("_wanted")).alias("_tail"), F.col("_sketch").alias("_next"))
    both = texts.join(sent, F.col("_key") == F.col("_to"))
    n = F.char_length("_text")
    edited = F.concat(F.left("_text", n - F.floor(n / 4).cast("int")), F.col("_tail"))
    found = both.select("_id", n.cast("long").alias("n_chars"), edited.alias("edited"), _from_bytes(F.col("_sketch")).alias("sketch"),
                        "next_id", _from_bytes(F.col("_next")).alias("next_sketch"))
    return found.select(F.col("_id").alias(id_col), "n_chars", "edited", "sketch", sketch(F.col("edited"), k).alias("edited_sketch"),
                        "next_id", "next_sketch")
