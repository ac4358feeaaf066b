"""Language identification by prediction by partial matching (PPM).

Each language has a tree of byte contexts up to ``MAX_ORDER`` bytes long with
counts of the byte that followed (method C escapes: after ``t`` bytes of ``d``
different values, a seen byte costs ``-log2(n / (t + d))`` bits, the escape to
the next shorter context ``-log2(d / (t + d))``; below order 0 every byte
costs 8 bits).  The statistics are frozen after training, so a text's exact
code length under a language is a sum over its bytes.  The shortest code
names the language; the score is that language's posterior probability under
equal priors.

Training.  Counts come from all different labelled texts, whole (copies count
once), and are summed by Spark.  Sequences rarer than one threshold are
left out so that at most ``MAX_NODES`` of each length stay; a suffix or prefix
is at least as frequent as the sequence, so the trees stay closed.  The model
is that bounded table and is what tasks receive.

Scoring.  The trees of all languages are merged: a sequence has one number
and one row of costs, a column per language, escapes included.  Numbers follow
from the shorter sequence's number and the next byte by table look-up, so a
batch is scored with a few numpy look-ups per byte, in blocks, whatever the
length of a text.

Nulls and edge cases: a text that is null or has no letter is ``und`` with
score 0; so is every text if nothing could be learned.  Text in no learned
language still gets the closest one; ``bits_per_byte`` tells how badly it
fits.  Repeated rows get equal answers; extra columns can't clash; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import crc_bucket, materialize, packed, plus, ship

MAX_ORDER = 3
MAX_NODES = 200_000  # sequences of each length that the model keeps
MAX_CELLS = 8_000_000  # of them times languages: many labels share fewer sequences
FOLDS = 5
BLOCK = 1 << 18  # bytes scored at a time
COUNTED = 1 << 20  # sequences that a task counts at a time
REJECT_BITS = 12.0  # bits per letter that reject a text if no held-out text tells the limit
WORDS = (1, 2, 4, 8, 16, 32, 64)  # sizes of the held-out snippets that set the limits
QUANTILE, SLACK = 0.999, 1.5  # a limit is this multiple of that quantile of the snippets' bits per letter


@dataclass
class Model:
    """Merged context trees; see ``build_model``."""

    languages: list[str]
    order: int
    classes: object  # byte -> class: 0 never (boundary), 1 unseen, then seen bytes
    child: list  # child[k][number * n_classes + class] -> number of the longer sequence, 0 if absent
    cost: list  # cost[k][number] -> bits of its last byte after the rest, per language
    escape: list  # escape[k][number] -> bits to leave it as a context, per language


def count_sequences(texts: DataFrame, order: int = MAX_ORDER) -> DataFrame:
    """``lang, k, seq, n`` from ``lang, text``: counts of byte sequences of length 1 to ``order + 1``.

    Only sequences of the full length are sorted, as symbols of 9 bits with 256
    after a text's end; the shorter ones are their prefixes.  A task holds at
    most about ``COUNTED`` of them before it adds up or hands on what it has.
    """
    ship()

    def count(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def summed(s, n):
            """Sums of ``n`` over equal ``s``, which are sorted."""
            first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            return s[first], np.add.reduceat(n, first)

        def added(parts: list, new: list):
            s = np.sort(np.concatenate(new))
            parts = [*parts, summed(s, np.ones(len(s), np.int64))]
            s, n = (np.concatenate(x) for x in zip(*parts))
            at = np.argsort(s, kind="stable")
            return [summed(s[at], n[at])]

        def counted(found: dict) -> Iterator:
            for lang, parts in found.items():
                for k in range(1, order + 2):
                    s, n = parts[0]
                    s = s >> np.uint64(9 * (order + 1 - k))
                    inside = (s & np.uint64(511)) < 256  # ends within its text
                    if not inside.any():
                        break
                    s, n = summed(s[inside], n[inside])
                    seq = np.zeros(len(s), np.uint64)
                    for i in range(k):
                        seq |= ((s >> np.uint64(9 * i)) & np.uint64(255)) << np.uint64(8 * i)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([lang] * len(s), pa.string()), pa.array(np.full(len(s), k, np.int32)),
                        pa.array(seq.view(np.int64)), pa.array(n),
                    ], names=["lang", "k", "seq", "n"])

        found: dict = {}  # language: its sequences so far, added up
        new: dict = {}
        held = 0
        for batch in batches:
            for lang, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = np.frombuffer(t.as_buffer(), np.uint8)
                for start in range(0, len(raw), COUNTED):
                    part = raw[start:start + COUNTED + order]
                    symbols = np.full(len(part) + order, 256, np.uint64)
                    symbols[:len(part)] = part
                    seq = np.zeros(len(part), np.uint64)
                    for i in range(order + 1):
                        seq = (seq << np.uint64(9)) | symbols[i:i + len(part)]
                    new.setdefault(lang, []).append(seq[:COUNTED])
                    held += len(new[lang][-1])
                    if held >= COUNTED:
                        found |= {k: added(found.get(k, []), some) for k, some in new.items()}
                        new, held = {}, 0
                        if sum(len(parts[0][0]) for parts in found.values()) >= COUNTED:
                            yield from counted(found)
                            found = {}
        yield from counted(found | {k: added(found.get(k, []), some) for k, some in new.items()})

    counted = texts.select("lang", "text").mapInArrow(count, "lang string, k int, seq long, n long")
    return counted.groupBy("lang", "k", "seq").agg(F.sum("n").alias("n"))


def distinct_texts(labelled: DataFrame) -> dict[str, int]:
    """Different texts per language; only their hashes move."""
    hashed = labelled.select("lang", F.xxhash64("text").alias("h")).distinct()
    return {r["lang"]: r["n"] for r in hashed.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}


def draw(labelled: DataFrame, sizes: dict[str, int], max_docs: int) -> DataFrame:
    """About ``max_docs`` different texts of each language, by hash; all if it has no more."""
    share = F.create_map(*[x for k, n in sorted(sizes.items()) for x in (F.lit(k), F.lit(min(1.0, max_docs / n)))])
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return labelled.filter(place < share[F.col("lang")]).select("lang", "text").distinct()


def train(labelled: DataFrame, order: int = MAX_ORDER, max_docs: int | None = None, max_nodes: int = MAX_NODES) -> Model | None:
    """A model from all different ``lang, text`` (neither null); None if there is nothing to learn from.

    ``max_docs`` has it learn from about so many of each language instead.
    """
    if max_docs is None:
        texts = labelled.select("lang", "text").distinct()
    elif sizes := distinct_texts(labelled):
        texts = draw(labelled, sizes, max_docs)
    else:
        return None
    counts = materialize(count_sequences(texts, order), "langid-counts")
    languages = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    if not languages:
        return None
    total = counts.groupBy("k", "seq").agg(F.sum("n").alias("n"))
    # Counts to four digits: few different ones, however large they get.
    digits = F.greatest(F.lit(0), F.length(F.col("n").cast("string")) - 4)
    level = F.col("n") - F.col("n") % F.pow(F.lit(10.0), digits).cast("long")
    by_count = total.groupBy("k", level.alias("n")).agg(F.count(F.lit(1)).alias("seqs")).collect()
    max_nodes = min(max_nodes, max(1000, MAX_CELLS // len(languages)))
    least = 1  # the smallest count that leaves at most max_nodes sequences of any length
    for k in range(1, order + 2):
        kept = 0
        for r in sorted((r for r in by_count if r["k"] == k), key=lambda r: -r["n"]):
            kept += r["seqs"]
            if kept > max_nodes:
                least = max(least, r["n"] + 10 ** max(0, len(str(r["n"])) - 4))
                break
    keep = total.filter(F.col("n") >= least).select("k", "seq")
    # Arrow: as Python rows the counts would take many times their size.
    rows = counts.join(keep, ["k", "seq"]).select("lang", "k", "seq", "n").toArrow().to_pandas()
    return build_model(languages, rows, order)


def build_model(languages: list[str], rows, order: int) -> Model | None:
    """``rows`` (pandas): ``lang, k, seq, n``, closed under leaving out a sequence's first or last byte."""
    import numpy as np

    if not len(rows):
        return None
    n_lang = len(languages)
    col = {x: i for i, x in enumerate(languages)}
    seqs, counts = [], []  # by length - 1: sorted sequences, counts per language
    for k in range(1, order + 2):
        part = rows[rows["k"] == k]
        s, at = np.unique(part["seq"].to_numpy(np.int64), return_inverse=True)
        c = np.zeros((len(s), n_lang))
        np.add.at(c, (at, part["lang"].map(col).to_numpy(np.int64)), part["n"].to_numpy(np.float64))
        seqs.append(s)
        counts.append(c)
    classes = np.ones(256, np.uint16)
    classes[seqs[0]] = np.arange(2, 2 + len(seqs[0]))
    n_classes = 2 + len(seqs[0])
    # Number of a sequence: its place + 1, but the class for a single byte.
    number = [np.arange(2, 2 + len(seqs[0]))] + [np.arange(1, len(s) + 1) for s in seqs[1:]]
    rows_of = [n_classes] + [len(s) + 1 for s in seqs[1:]]

    def place(k: int, s):
        """Numbers of sequences of length k."""
        return number[k - 1][np.searchsorted(seqs[k - 1], s)]

    # Contexts: k = 0 is the empty one.
    totals = [counts[0].sum(axis=0, keepdims=True)]
    kinds = [(counts[0] > 0).sum(axis=0, keepdims=True).astype(float)]
    for k in range(1, order + 1):
        t, d = np.zeros((rows_of[k - 1], n_lang)), np.zeros((rows_of[k - 1], n_lang))
        if len(seqs[k]):
            context = place(k, seqs[k] >> 8)
            np.add.at(t, context, counts[k])
            np.add.at(d, context, counts[k] > 0)
        totals.append(t)
        kinds.append(d)
    escape = []
    for t, d in zip(totals, kinds):
        with np.errstate(divide="ignore", invalid="ignore"):
            escape.append(np.where(t > 0, -np.log2(d / (t + d)), 0.0))
    cost: list = []
    for k in range(1, order + 2):
        c = np.zeros((rows_of[k - 1], n_lang))
        if k == 1:
            context = np.zeros(len(seqs[0]), np.int64)
            below = np.full((len(seqs[0]), n_lang), 8.0)
        elif len(seqs[k - 1]):
            context = place(k - 1, seqs[k - 1] >> 8)
            below = cost[k - 2][place(k - 1, seqs[k - 1] & ((1 << (8 * (k - 1))) - 1))]
        if len(seqs[k - 1]):
            t, d, n = totals[k - 1][context], kinds[k - 1][context], counts[k - 1]
            with np.errstate(divide="ignore", invalid="ignore"):
                seen = -np.log2(n / (t + d))
            c[number[k - 1]] = np.where(n > 0, seen, escape[k - 1][context] + below)
        if k == 1:
            c[1] = escape[0][0] + 8.0  # a byte that training never saw
        cost.append(c)
    child = []
    for k in range(1, order + 1):
        table = np.zeros(rows_of[k - 1] * n_classes, np.int32)
        if len(seqs[k]):
            table[place(k, seqs[k] >> 8) * n_classes + classes[seqs[k] & 255]] = number[k]
        child.append(table)
    return Model(languages, order, classes, child, [c.astype(np.float32) for c in cost], [e.astype(np.float32) for e in escape])


def code_lengths(model: Model, raws: list[bytes]):
    """Bits of each text under each language: ``(len(raws), languages)``."""
    import numpy as np

    n_languages = len(model.languages)
    out = np.zeros((len(raws), n_languages))
    group: list[int] = []
    held = 0
    # A block's costs are as many as its bytes times the languages.
    block_bytes = min(BLOCK, max(1 << 10, 8 * BLOCK // n_languages))

    def score(at: list[int]) -> None:
        # One boundary byte before each text; its class leaves every context.
        parts = []
        for i in at:
            parts += [np.zeros(1, np.uint16), model.classes[np.frombuffer(raws[i], np.uint8)]]
        ends = np.cumsum([len(raws[i]) + 1 for i in at])
        bits = _bits(model, np.concatenate(parts))
        out[at] = np.add.reduceat(bits, np.concatenate([[0], ends[:-1]]), axis=0, dtype=np.float64)

    for i, raw in enumerate(raws):
        if len(raw) > block_bytes:  # in blocks, each with its preceding context
            symbols = np.frombuffer(raw, np.uint8)
            for start in range(0, len(raw), block_bytes):
                first = max(0, start - model.order)
                block = model.classes[symbols[first:start + block_bytes]]
                out[i] += _bits(model, block)[start - first:].sum(axis=0, dtype=np.float64)
            continue
        group.append(i)
        held += len(raw)
        if held >= block_bytes:
            score(group)
            group, held = [], 0
    if group:
        score(group)
    return out


def _bits(model: Model, c):
    """Bits of every symbol after the symbols before it."""
    import numpy as np

    width = len(model.cost[0])
    number = [c.astype(np.int32)]
    for k in range(model.order):
        longer = np.zeros(len(c), np.int32)
        longer[1:] = model.child[k][number[k][:-1] * width + number[0][1:]]
        number.append(longer)
    top = number[-1]
    bits = model.cost[-1][top]
    rest = np.nonzero(top == 0)[0]
    for k in range(model.order, 0, -1):
        if not len(rest):
            break
        # Leave the context of length k (number 0: it is in no tree, nothing to leave).
        context = np.where(rest > 0, number[k - 1][rest - 1], 0)
        bits[rest] += model.escape[k][context]
        here = number[k - 1][rest]
        found = here > 0
        bits[rest[found]] += model.cost[k - 1][here[found]]
        rest = rest[~found]
    bits[c == 0] = 0
    return bits


def shared_model(spark: SparkSession, model: Model) -> Broadcast:
    """Plain lists and arrays: the class travels with the function, workers need no package."""
    return spark.sparkContext.broadcast(dict(vars(model)))


def predict(rows: DataFrame, text: Column, model: Model | None, carry: list[str] | None = None, shared: Broadcast | None = None) -> DataFrame:
    """The columns ``carry`` of ``rows`` (all by default) with ``lang_pred, score, bits_per_byte`` of ``text``.

    ``shared`` is the model as ``shared_model`` sent it, if it was sent before.
    """
    names = carry or rows.columns
    if model is None:
        return rows.select(*names, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"),
                           F.lit(None).cast("double").alias("bits_per_byte"))
    ship()
    text = text.cast("string")
    known = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    schema = plus(rows.select(*names).schema, "lang_pred string, score double, bits_per_byte double")
    shared = shared or shared_model(rows.sparkSession, model)

    def score(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        model = Model(**shared.value)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            raws = [t.as_buffer() if t.is_valid else b"" for t in texts]
            bits = code_lengths(model, raws)
            best = bits.argmin(axis=1)
            gap = (bits - bits.min(axis=1, keepdims=True)) * np.log(2.0)
            odds = 1.0 / np.exp(-np.minimum(gap, 700.0)).sum(axis=1)
            size = np.array([len(r) for r in raws])
            none = size == 0
            rate = bits.min(axis=1) / np.maximum(size, 1)
            yield pa.RecordBatch.from_arrays([
                *[batch.column(i) for i in range(len(names))],
                pa.array(["und" if e else model.languages[b] for e, b in zip(none, best)], pa.string()),
                pa.array(np.where(none, 0.0, odds)), pa.array(rate, mask=none),
            ], names=[*names, "lang_pred", "score", "bits_per_byte"])

    return rows.select(*names, F.when(known, text).alias("_scored")).mapInArrow(score, schema)


def labelled_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                  held_out: bool = False) -> DataFrame:
    """``lang, text`` of the documents to learn from: labelled, not held out (or only those), with a letter."""
    text, lang = F.col(f"`{text_col}`").cast("string"), F.col(f"`{lang_col}`").cast("string")
    fold = (crc_bucket(F.col(f"`{id_col}`"), FOLDS) == 0) == F.lit(held_out)
    return docs.filter(fold & lang.isNotNull() & text.rlike(r"\p{L}")).select(lang.alias("lang"), text.alias("text"))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per document: ``id_col, held_out, lang_pred, score, bits_per_byte``; learns from ``docs`` itself."""
    model = train(labelled_rows(docs, id_col, text_col, lang_col))
    row = F.struct(F.col(f"`{id_col}`").alias("id")).alias("_row")
    rows = predict(docs.select(row, F.col(f"`{text_col}`").cast("string").alias("_text")), F.col("_text"), model, carry=["_row"])
    return rows.select(
        F.col("_row.id").alias(id_col), (crc_bucket(F.col("_row.id"), FOLDS) == 0).alias("held_out"),
        "lang_pred", "score", "bits_per_byte",
    )


def letters_of(text: Column) -> Column:
    """The words of a text, one space apart: no key (a run of key characters with a digit), digit, symbol or emoji."""
    key = r"(?<![A-Za-z0-9+/_=-])[A-Za-z+/_=-]*+[0-9][A-Za-z0-9+/_=-]*+"
    return F.trim(F.regexp_replace(F.regexp_replace(text.cast("string"), key, " "), r"[^\p{L}\p{M}]++", " "))


def bits_per_letter(letters: Column) -> Column:
    return F.col("bits_per_byte") * F.octet_length(letters) / F.char_length(letters)


def held_snippets(held: DataFrame) -> DataFrame:
    """``w, t``: the first and the middle ``w`` words of every different held-out ``lang, text``."""
    words = F.split(letters_of(F.col("text")), " ")
    rows = held.select("lang", "text").distinct().select(words.alias("_words"))
    middle = F.floor(F.size("_words") / 2).cast("int")
    cut = [F.struct(F.lit(w).alias("w"), F.array_join(F.slice("_words", at, w), " ").alias("t"), (F.size("_words") >= w - 1 + at).alias("whole"))
           for w in WORDS for at in (F.lit(1), F.greatest(F.lit(1), middle))]
    return rows.select(F.explode(F.array(*cut)).alias("s")).filter("s.whole and s.t <> ''").select("s.w", "s.t")


def rejection_limits(model: Model, snippets: DataFrame, shared: Broadcast | None = None) -> dict[int, float]:
    """Bits per letter beyond which a text of so many words is in no learned language, from all ``held_snippets``."""
    rated = predict(snippets, F.col("t"), model, shared=shared).withColumn("rate", bits_per_letter(F.col("t")))
    found = rated.groupBy("w").agg(F.percentile_approx("rate", QUANTILE, 100_000).alias("q")).collect()
    return {r["w"]: r["q"] * SLACK for r in found if r["q"] is not None}


def drop_rejected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                  reject_bits: float | None = None) -> DataFrame:
    """The rows of ``docs`` in some learned language: with a letter, and not far beyond every model.

    The text decides, whatever the label says.  Labelled texts are learned from
    in two halves by a hash of the text, and a document is judged by the model
    of the other half: foreign text under a learned label can't vouch for itself
    or its copies.  A label that only one half has keeps its rows.  Only words are judged (``letters_of``), in bits per letter: a text without
    any but with a letter stays.  The limit follows from snippets of about as many words
    of all held-out texts, so it moves with what the model learned;
    ``reject_bits`` sets a fixed one.  Without a single labelled document
    there is nothing to reject by, and every row stays.
    """
    def half(text: Column) -> Column:
        return F.shiftright(F.xxhash64(text), 40).bitwiseAND(F.lit(1))

    labelled = labelled_rows(docs, id_col, text_col, lang_col)
    held = labelled_rows(docs, id_col, text_col, lang_col, held_out=True)
    models = [train(labelled.filter(half(F.col("text")) == i)) for i in (0, 1)]
    if models == [None, None]:
        return docs
    row, text = packed(docs), F.col(f"_row.`{text_col}`").cast("string")
    rows = row.filter(text.rlike(r"\p{L}"))
    snippets = materialize(held_snippets(held), "langid-snippets") if reject_bits is None else None
    parts = []
    for i, model in enumerate(models):  # the other half's model judges, or the only one
        judge = models[1 - i] or model
        shared = shared_model(docs.sparkSession, judge)
        limits = rejection_limits(judge, snippets, shared) if reject_bits is None else {}
        limit = F.lit(REJECT_BITS if reject_bits is None else float(reject_bits))
        for k, (w, bits) in enumerate(sorted(limits.items())):
            limit = F.lit(bits) if k == 0 else F.when(F.col("_words") >= w, F.lit(bits)).otherwise(limit)
        lettered = rows.filter(half(text) == i).select("_row", letters_of(text).alias("_letters"))
        sized = lettered.select(
            "_row", "_letters", F.size(F.split("_letters", " ")).alias("_words"),
            F.octet_length("_letters").alias("_bytes"), F.char_length("_letters").alias("_chars"),
        )
        out = predict(sized, F.col("_letters"), judge, carry=["_row", "_words", "_bytes", "_chars"], shared=shared)
        # A label of too few texts for both halves can't be judged.
        alone = sorted(set(model.languages) - set(judge.languages)) if model else []
        rare = F.coalesce(F.col(f"_row.`{lang_col}`").cast("string").isin(alone), F.lit(False))
        rate = F.col("bits_per_byte") * F.col("_bytes") / F.col("_chars")
        parts.append(out.filter(rare | (F.col("_chars") == 0) | (rate < limit)).select("_row.*"))
    return parts[0].unionByName(parts[1])
