"""Template handling and the batch combine: one record per document.

The reference keeps, per document and over its batch replies in natural file
order, the last non-empty value of every top-level key; template keys come
first in template order with ``""`` as default, other keys follow in order of
their first non-empty sighting; nested values are replaced whole.

Plan: explode each reply's entries (narrow), one partial aggregation on
``(doc, key)`` with ``max_by`` / ``min`` over ``(batch order, position)``,
then one aggregation on ``doc`` for the template's keys (bounded by the
template).  Keys outside the template stay one row each (``combine_entries``);
only the one-row record gathers them.  The template is a short literal list
folded into the expression: no cross join, no broadcast.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions.jsonfn import is_truthy_json, object_entries
from pagewright.operators.ranking import rank_within

# A template is a few dozen keys; guard against passing data as a template.
MAX_TEMPLATE_KEYS = 10_000
DEFAULT_VALUE = '""'


def _json_string(c: Column) -> Column:
    return F.to_json(c.cast("variant"))


def template_rows(df: DataFrame, json_col: str, key_cols: Sequence[str] = ()) -> DataFrame:
    """Top-level keys of JSON objects in order: ``(keys..., ord, key, example)``.

    ``ord`` is 1-based; ``example`` is the value's minified JSON text.  Used to
    load a template file, and to list the keys of any reply.
    """
    e = df.select(*key_cols, F.posexplode(object_entries(F.col(json_col))).alias("_p", "_kv"))
    return e.select(
        *key_cols,
        (F.col("_p") + 1).cast("bigint").alias("ord"),
        F.col("_kv.key").alias("key"),
        F.col("_kv.value").alias("example"),
    )


def load_template(spark: SparkSession, path: str) -> DataFrame:
    """Read template JSON file(s) whole: ``(file, ord, key, example)``."""
    raw = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("file"), F.col("value")
    )
    return template_rows(raw, "value", ["file"])


def template_from_pairs(spark: SparkSession, pairs: Iterable[tuple[str, object]]) -> DataFrame:
    """A template DataFrame ``(ord, key, example)`` from ``(key, example)`` pairs."""
    import json

    rows = [(i + 1, k, json.dumps(v, ensure_ascii=False, separators=(",", ":"))) for i, (k, v) in enumerate(pairs)]
    return spark.createDataFrame(rows, "ord bigint, key string, example string")


def template_keys(template) -> list[str]:
    """Template keys in order from a list of keys, ``(key, example)`` pairs, a
    dict, or a template DataFrame ``(ord, key, ...)`` (bounded, checked)."""
    if isinstance(template, DataFrame):
        rows = template.select("ord", "key").orderBy("ord").limit(MAX_TEMPLATE_KEYS + 1).collect()
        keys = [r["key"] for r in rows]
    elif isinstance(template, dict):
        keys = list(template)
    else:
        keys = [t[0] if isinstance(t, (tuple, list)) else t for t in template]
    if len(keys) > MAX_TEMPLATE_KEYS:
        raise ValueError(f"template has more than {MAX_TEMPLATE_KEYS} keys; it is data, not a template")
    seen: list[str] = []
    for k in keys:
        if k not in seen:
            seen.append(k)
    return seen


def reply_entries(df: DataFrame, json_col: str, key_cols: Sequence[str], outer: bool = False) -> DataFrame:
    """``(keys..., pos, key, value, truthy)`` for every top-level entry of each reply.

    With ``outer=True`` a reply without entries (``{}``, or not an object)
    still gives one row with NULL key, so its document is not lost.
    """
    explode = F.posexplode_outer if outer else F.posexplode
    e = df.select(*key_cols, explode(object_entries(F.col(json_col))).alias("pos", "_kv"))
    e = e.select(
        *key_cols,
        (F.col("pos") + 1).cast("bigint").alias("pos"),
        F.col("_kv.key").alias("key"),
        F.col("_kv.value").alias("value"),
    )
    return e.withColumn("truthy", is_truthy_json(F.col("value")))


def last_non_empty(entries: DataFrame, doc_col: str, order: Column, keep_zero: bool = False) -> DataFrame:
    """Per ``(doc, key)``: the last non-empty value and where it was first seen.

    Rows whose value is empty do not take part (their ordering is NULL, which
    ``max_by`` / ``min`` skip), but the key still gets a row with NULL value.
    ``keep_zero`` counts ``0`` and ``false`` as found values.
    """
    found = F.col("truthy")
    if keep_zero:
        found = found | F.col("value").isin("0", "false") | (F.col("value").try_cast("double") == 0)
    o = F.when(found, order)
    return entries.groupBy(doc_col, "key").agg(
        F.max_by("value", o).alias("value"), F.min(o).alias("first_seen")
    )


def _template_hits(found: DataFrame, keys: Sequence[str], doc_col: str) -> DataFrame:
    """``(doc, _filled)``: one entry per template key, in template order.

    The aggregate holds template keys only, so its rows are bounded by the
    template, whatever other keys a document has; every document gets a row.
    """
    tkeys = _literal_keys(keys)
    hit = F.col("value").isNotNull() & F.array_contains(tkeys, F.col("key"))
    per_doc = found.groupBy(doc_col).agg(
        F.map_from_entries(F.collect_list(F.when(hit, F.struct("key", "value")))).alias("_found")
    )
    return per_doc.select(doc_col, F.transform(tkeys, lambda k: F.struct(
        k.alias("key"),
        F.coalesce(F.try_element_at(F.col("_found"), k), F.lit(DEFAULT_VALUE)).alias("value"),
        F.when(F.try_element_at(F.col("_found"), k).isNull(), F.lit("default"))
        .otherwise(F.lit("found"))
        .alias("origin"),
    )).alias("_filled"))


def _literal_keys(keys: Sequence[str]) -> Column:
    return F.array(*[F.lit(k) for k in keys]) if keys else F.array().cast("array<string>")


def _is_extra(keys: Sequence[str]) -> Column:
    return F.col("value").isNotNull() & F.col("key").isNotNull() & ~F.array_contains(_literal_keys(keys), F.col("key"))


def with_defaults(found: DataFrame, template, doc_col: str = "doc") -> DataFrame:
    """Fill the template per document: ``(doc, ord, key, value, origin)``.

    Template keys first in template order, value ``""`` where nothing was
    found (origin ``default``); other found keys after, in order of first
    sighting (origin ``extra``).  Template entries come from one bounded row
    per document; the other keys, of which a document may have any number,
    stay one row each and are numbered by the skew-safe rank.
    """
    keys = template_keys(template)
    filled = _template_hits(found, keys, doc_col).select(doc_col, F.posexplode("_filled").alias("_o", "_e")).select(
        doc_col,
        (F.col("_o") + 1).cast("bigint").alias("ord"),
        F.col("_e.key").alias("key"),
        F.col("_e.value").alias("value"),
        F.col("_e.origin").alias("origin"),
    )
    extra = rank_within(found.where(_is_extra(keys)), [doc_col], ["first_seen", "key"], "_rank")
    extra = extra.select(
        doc_col, (F.col("_rank") + len(keys)).cast("bigint").alias("ord"), "key", "value", F.lit("extra").alias("origin")
    )
    return filled.unionByName(extra)


def combine_entries(batches: DataFrame, template, doc_col: str = "doc", batch_col: str = "batch_no",
                    json_col: str = "j", order_col: Column | str | None = None, keep_zero: bool = False) -> DataFrame:
    """Combined entries per document: ``(doc, ord, key, value, origin)``.

    ``order_col`` orders the batches (default ``batch_col``; pass a
    ``natural_key`` of a file name to order by names).
    """
    found = _found_values(batches, doc_col, batch_col, json_col, order_col, keep_zero)
    return with_defaults(found, template, doc_col)


def _found_values(batches: DataFrame, doc_col: str, batch_col: str, json_col: str,
                  order_col: Column | str | None, keep_zero: bool) -> DataFrame:
    order = F.col(batch_col) if order_col is None else F.col(order_col) if isinstance(order_col, str) else order_col
    e = reply_entries(batches.withColumn("_border", order), json_col, [doc_col, "_border"], outer=True)
    return last_non_empty(e, doc_col, F.struct(F.col("_border"), F.col("pos")), keep_zero)


def entries_to_record(entries: DataFrame, doc_col: str = "doc", out: str = "record") -> DataFrame:
    """Write ``(doc, ord, key, value)`` rows back as one JSON object per document."""
    g = entries.groupBy(doc_col).agg(
        F.array_sort(
            F.collect_list(F.struct("ord", F.concat(_json_string(F.col("key")), F.lit(":"), F.col("value")).alias("kv")))
        ).alias("_kv")
    )
    return g.select(
        doc_col, F.concat(F.lit("{"), F.array_join(F.transform("_kv", lambda x: x["kv"]), ","), F.lit("}")).alias(out)
    )


def combine_last_non_empty(batches: DataFrame, template, doc_col: str = "doc", batch_col: str = "batch_no",
                           json_col: str = "j", order_col: Column | str | None = None,
                           keep_zero: bool = False) -> DataFrame:
    """One JSON record per document from its batch replies: ``(doc, record)``.

    The record holds every key of its document in one row by definition, so
    it is built in one aggregate; ``combine_entries`` is the bounded form.
    """
    keys = template_keys(template)
    found = _found_values(batches, doc_col, batch_col, json_col, order_col, keep_zero)
    tkeys = _literal_keys(keys)
    hit = F.col("value").isNotNull() & F.array_contains(tkeys, F.col("key"))
    g = found.groupBy(doc_col).agg(
        F.map_from_entries(F.collect_list(F.when(hit, F.struct("key", "value")))).alias("_found"),
        F.array_sort(F.collect_list(F.when(_is_extra(keys), F.struct("first_seen", "key", "value")))).alias("_extra"),
    )
    parts = F.concat(
        F.transform(tkeys, lambda k: F.concat(
            _json_string(k), F.lit(":"), F.coalesce(F.try_element_at(F.col("_found"), k), F.lit(DEFAULT_VALUE)))),
        F.transform("_extra", lambda e: F.concat(_json_string(e["key"]), F.lit(":"), e["value"])),
    )
    return g.select(doc_col, F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}")).alias("record"))
