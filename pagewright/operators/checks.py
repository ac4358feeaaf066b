"""Quality checks the reference states as prompt rules, as Spark filters/joins.

* template conformance: every template key present, value of the template's kind;
* grounding: a found string value occurs in the document's source text;
* heading rule: no single-``#`` heading in page markdown;
* coverage: pages named by a batch but never sent.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.jsonfn import compute_once, json_kind, object_entries
from pagewright.operators.combine import template_keys
from pagewright.operators.ranking import join_per_group
from pagewright.session import ensure_checkpoint_dir

GRAM = 3  # characters of an index entry
WORD_CHAR = r"[\p{L}\p{N}]"
BITMAP_WORDS = 16  # longs of a document's bitmap of value grams


def check_template(replies: DataFrame, template, key_cols: Sequence[str], json_col: str = "j",
                   examples: dict | None = None) -> DataFrame:
    """Problems per reply: ``(keys..., key, problem)``.

    ``missing``: a template key absent from the reply; ``extra``: a key not in
    the template; ``kind``: value kind differs from the template example's
    (only when ``examples`` maps keys to example JSON texts; ``""`` values
    are not kind-checked, being the template's own default).  One narrow pass
    per reply (array functions on the reply's own entries): no join with the
    template and no shuffle.
    """
    keys = template_keys(template)
    tkeys = F.array(*[F.lit(k) for k in keys])
    entries = F.coalesce(
        object_entries(F.col(json_col)), F.array().cast("array<struct<key:string,value:string>>")
    )
    present = F.transform(entries, lambda e: e["key"])

    def problem(key, what):
        return F.struct(key.alias("key"), F.lit(what).alias("problem"))

    missing = F.transform(F.array_except(tkeys, present), lambda k: problem(k, "missing"))
    extra = F.transform(F.filter(present, lambda k: ~F.array_contains(tkeys, k)), lambda k: problem(k, "extra"))
    parts = [missing, extra]
    if examples:
        kinds = F.create_map(*[x for k, v in examples.items() for x in (F.lit(k), F.lit(v))])

        def bad_kind(e):
            v = e["value"]
            want = json_kind(F.try_element_at(kinds, e["key"]))
            return F.array_contains(tkeys, e["key"]) & (v != '""') & (json_kind(v) != want)

        parts.append(F.transform(F.filter(entries, bad_kind), lambda e: problem(e["key"], "kind")))
    out = replies.select(*key_cols, F.explode(F.concat(*parts)).alias("_p"))
    return out.select(*key_cols, F.col("_p.key").alias("key"), F.col("_p.problem").alias("problem"))


def _grams(text: Column) -> Column:
    """From every letter or digit on the next ``GRAM`` ones (fewer at a word's end), each once."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?=({WORD_CHAR}{{1,{GRAM}}}))"), 1))


def value_grams(value: Column) -> Column:
    """Hashes of the longest grams inside a value's words: a text with the value has them inside its own words.

    A value without letters and digits has the hash of the empty text, which every page has.
    """
    def longest(grams: Column) -> Column:
        top = F.array_max(F.transform(grams, F.length))
        return F.filter(grams, lambda g: F.length(g) == top)

    whole = F.flatten(F.transform(F.array(_grams(value)), longest))
    return F.transform(F.when(F.size(whole) > 0, whole).otherwise(F.array(F.lit(""))), lambda g: F.hash(g))


def page_grams(text: Column) -> Column:
    """Hashes of all grams inside a text's words, of ``GRAM`` characters and fewer."""
    vocabulary = F.array_join(F.array_distinct(F.split(text, rf"[^\p{{L}}\p{{N}}]+")), " ")

    def cut(grams: Column, n: int) -> Column:
        return F.transform(grams, lambda g: F.left(g, F.lit(n)))

    def all_lengths(grams: Column) -> Column:
        return F.concat(grams, *[cut(grams, n) for n in range(GRAM)])

    every = F.flatten(F.transform(F.array(_grams(vocabulary)), all_lengths))
    return F.array_distinct(F.transform(F.concat(every, F.array(F.lit(""))), lambda g: F.hash(g)))


def _place(gram: Column) -> tuple[Column, Column]:
    """Word and bit of a gram in a document's bitmap."""
    h = F.pmod(gram, F.lit(64 * BITMAP_WORDS))
    return F.shiftright(h, 6), F.call_function("shiftleft", F.lit(1).cast("bigint"), h.bitwiseAND(F.lit(63)))


def check_grounded(values: DataFrame, sources: DataFrame, doc_col: str = "doc", value_col: str = "value",
                   source_col: str = "text", key_cols: Sequence[str] = ("key",),
                   materialize: bool = True) -> DataFrame:
    """Is each found string value written somewhere in its document's source?

    ``values``: ``(doc, key..., value)`` plain strings; ``sources``: one or more
    rows of text per document (pages).  One row per distinct
    ``(doc, key..., value)``.  Values are matched case-insensitively; empty
    values are not checked, and a NULL document has no source.

    Plan, a rarest-gram index:

    * The words of values and pages are cut into grams of ``GRAM`` characters,
      hashed to integers.  Of a page's distinct hashes only those in the bitmap of its
      document's value grams (``BITMAP_WORDS`` longs, built by a partial
      ``bit_or``) become rows, so a page costs its own length, never its length
      times the number of values.
    * Grams are counted over the document's pages.  Each value keeps the one
      on fewest pages; a value with a gram on no page is not grounded.
    * A value meets only the pages that hold its rarest gram, and there the
      whole value is looked for.  Those meetings are about its real hits.

    Equal hashes of different grams only add a look.  Pages are known by a hash
    of their text: two pages with equal hashes are both looked at.  All keys are (document, gram) or (document, page), so a
    hot document spreads; the null-safe key of the bitmap join lets AQE split it.
    """
    v = values.where(F.col(value_col) != "").select(doc_col, *key_cols, value_col).distinct()
    v = v.withColumn("_lv", F.lower(F.col(value_col)))
    if materialize:  # found values (a few per document) feed three branches; write them once
        ensure_checkpoint_dir(v.sparkSession)
        v = v.checkpoint(eager=True)
    wanted = v.where(F.col(doc_col).isNotNull()).select(F.col(doc_col).alias("_d"), "_lv").distinct()
    grams = compute_once(wanted, _gs=value_grams(F.col("_lv"))).select("_d", "_lv", F.explode("_gs").alias("_g"))
    word, bit = _place(F.col("_g"))
    bitmaps = grams.withColumn("_w", word).withColumn("_b", bit).groupBy("_d").agg(
        F.array(*[F.coalesce(F.bit_or(F.when(F.col("_w") == i, F.col("_b"))), F.lit(0).cast("bigint")) for i in range(BITMAP_WORDS)]).alias("_bits"))
    text = F.lower(F.col(source_col))
    sources = sources.where(F.col(doc_col).isNotNull() & F.col(source_col).isNotNull()).select(F.col(doc_col).alias("_d"), text.alias("_src"))
    pages = sources.withColumn("_p", F.xxhash64("_src"))

    def in_bitmap(gram: Column) -> Column:
        w, b = _place(gram)
        return F.get(F.col("_bits"), w).bitwiseAND(b) != 0

    cut = pages.select("_d", "_p", page_grams(F.col("_src")).alias("_grams"))
    found = compute_once(join_per_group(cut, bitmaps, ["_d"]), _gs=F.filter("_grams", in_bitmap)).select("_d", "_p", F.explode("_gs").alias("_g"))
    counts = found.groupBy("_d", "_g").agg(F.count("_p").alias("_n"))  # _p: both uses of found read one exchange
    rarest = grams.join(counts, ["_d", "_g"], "left").groupBy("_d", "_lv").agg(
        F.min(F.struct(F.coalesce(F.col("_n"), F.lit(0)).alias("n"), F.col("_g").alias("g"))).alias("_r")
    ).where(F.col("_r.n") > 0).select("_d", "_lv", F.col("_r.g").alias("_g"))
    meet = found.join(rarest, ["_d", "_g"]).groupBy("_d", "_p").agg(F.collect_set("_lv").alias("_vals"))
    looked = compute_once(pages.join(meet, ["_d", "_p"]), _hits=F.filter("_vals", lambda x: F.instr(F.col("_src"), x) > 0))
    hits = looked.select("_d", F.explode("_hits").alias("_lv")).distinct()
    out = v.join(hits.withColumn("grounded", F.lit(True)), (F.col(doc_col) == F.col("_d")) & (v["_lv"] == hits["_lv"]), "left")
    return out.select(doc_col, *key_cols, value_col, F.coalesce(F.col("grounded"), F.lit(False)).alias("grounded"))


def check_headings(pages: DataFrame, md_col: str, key_cols: Sequence[str]) -> DataFrame:
    """Count of lines starting with a single ``# `` per page (should be 0)."""
    n = F.size(F.regexp_extract_all(F.col(md_col), F.lit(r"(?dm)^# "), 0))
    return pages.select(*key_cols, n.cast("bigint").alias("single_hash_lines"))


def check_coverage(pages: DataFrame, sent: DataFrame, keys: Sequence[str] = ("doc", "page_no")) -> DataFrame:
    """Pages never sent in any request: left anti join on the page key."""
    return pages.join(sent.select(*keys).distinct(), list(keys), "left_anti")
