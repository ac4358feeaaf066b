"""Registered queries: one per operator of the survey inventory.

``QUERIES[name](spark, sf_dir) -> DataFrame`` runs over whole tables (or views
Spark derives from them); ``ORACLE[name]`` states the same result in DuckDB
SQL over the same parquet tables.  Column names match between the two.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import jsonfn, textfn
from pagewright.operators import combine, metrics, paging, replies
from pagewright.plans import views as V
from pagewright.plans.oracle_views import truthy_sql, with_views
from pagewright.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


# Parameters of the registered queries.
SELECT_FIRST, SELECT_LAST = 2, 4
OVERSIZED_BATCH = 12  # batch size above the request limit, to show the loss
TEMPLATE_SQL = "(VALUES (1, 'title'), (2, 'author'), (3, 'h1'), (4, 'lang'), (5, 'n_paragraphs')) t(ord, key)"
# One model of the log is left out of the price list on purpose: its rows are
# reported as unpriced.
QUERY_PRICES = [("vision", 0.01, 0.03)]
QUERY_PRICES_SQL = "(VALUES ('vision', 0.01::DOUBLE, 0.03::DOUBLE)) p(model, prompt_per_1k, completion_per_1k)"

# --------------------------------------------------------------- 2.1 sources


@register("scan_documents", """
    SELECT doc_id, lang, source, n_chars, CAST(length(text) AS BIGINT) AS text_chars,
           CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines
    FROM documents""")
def q_scan_documents(spark, sf):
    d = read_table(spark, sf, "documents", ["doc_id", "lang", "source", "n_chars", "text"])
    return d.select(
        "doc_id", "lang", "source", "n_chars",
        F.length("text").cast("bigint").alias("text_chars"),
        F.size(F.split("text", "\n", -1)).cast("bigint").alias("n_lines"),
    )


_STEM_SQL = (
    "regexp_extract(regexp_extract(regexp_replace(url, '[?#].*\\z', ''), '([^/]*)\\z', 1), "
    "'^(\\.*.*?)(\\.[^.]*)?\\z', 1)"
)
_EXT_SQL = (
    "regexp_extract(regexp_extract(regexp_replace(url, '[?#].*\\z', ''), '([^/]*)\\z', 1), "
    "'^\\.*.*?(\\.[^.]*)?\\z', 1)"
)


@register("document_name", f"SELECT page_id, {_STEM_SQL} AS doc_name, {_EXT_SQL} AS ext FROM pages")
def q_document_name(spark, sf):
    p = read_table(spark, sf, "pages", ["page_id", "url"])
    return p.select("page_id", textfn.file_stem("url").alias("doc_name"), textfn.file_extension("url").alias("ext"))


@register("list_pages", f"SELECT page_id, {_STEM_SQL} AS name FROM pages WHERE {_EXT_SQL} = '.html'")
def q_list_pages(spark, sf):
    from pagewright.sources.files import filter_extension

    p = read_table(spark, sf, "pages", ["page_id", "url"])
    return filter_extension(p, "url", ".html").select("page_id", textfn.file_stem("url").alias("name"))


# ------------------------------------------------------------ 2.2 paging


@register("explode_pages", with_views(["text_pages"], "SELECT doc_id, page_no, text FROM text_pages"))
def q_explode_pages(spark, sf):
    return V.text_pages(spark, sf).select("doc_id", "page_no", "text")


@register("select_pages", with_views(["text_pages"], f"""
    SELECT doc_id, page_no, text FROM text_pages WHERE page_no BETWEEN {SELECT_FIRST} AND {SELECT_LAST}"""))
def q_select_pages(spark, sf):
    return paging.select_pages(V.text_pages(spark, sf), SELECT_FIRST, SELECT_LAST).select("doc_id", "page_no", "text")


@register("cap_pages", with_views(["text_pages"], f"""
    SELECT doc_id, batch_no, CAST(least(count(*), 10) AS BIGINT) AS sent_pages,
           CAST(greatest(count(*) - 10, 0) AS BIGINT) AS dropped_pages,
           CAST(min(page_no) + least(count(*), 10) - 1 AS BIGINT) AS last_sent_page
    FROM (SELECT *, CAST((page_no - 1) // {OVERSIZED_BATCH} + 1 AS BIGINT) AS batch_no FROM text_pages)
    GROUP BY doc_id, batch_no"""))
def q_cap_pages(spark, sf):
    b = paging.assign_batches(V.text_pages(spark, sf), OVERSIZED_BATCH, "doc_id")
    c = paging.cap_pages(paging.collect_batches(b, "text", "doc_id"), 10)
    return c.select(
        "doc_id", "batch_no", F.size("pages").cast("bigint").alias("sent_pages"), "dropped_pages",
        F.get(F.col("pages"), F.size("pages") - 1)["page_no"].alias("last_sent_page"),
    )


@register("page_count", with_views(["text_pages"], """
    SELECT doc_id, CAST(count(*) AS BIGINT) AS num_pages FROM text_pages GROUP BY doc_id"""))
def q_page_count(spark, sf):
    return paging.page_count(V.text_pages(spark, sf), "doc_id")


@register("collect_batches", with_views(["text_pages"], """
    SELECT doc_id, batch_no, min(page_no) AS start_page, max(page_no) AS end_page,
           string_agg(CAST(page_no AS VARCHAR), ',' ORDER BY page_no) AS page_list,
           string_agg(text, chr(10) ORDER BY page_no) AS batch_text
    FROM (SELECT *, CAST((page_no - 1) // 10 + 1 AS BIGINT) AS batch_no FROM text_pages)
    GROUP BY doc_id, batch_no"""))
def q_collect_batches(spark, sf):
    b = paging.assign_batches(V.text_pages(spark, sf), 10, "doc_id")
    c = paging.collect_batches(b, "text", "doc_id")
    return c.select(
        "doc_id", "batch_no", "start_page", "end_page",
        F.array_join(F.transform("pages", lambda p: p["page_no"].cast("string")), ",").alias("page_list"),
        F.array_join(F.transform("pages", lambda p: p["payload"]), "\n").alias("batch_text"),
    )


@register("fixed_batches", with_views(["text_pages"], """
    SELECT doc_id, page_no, CAST((page_no - 1) // 10 + 1 AS BIGINT) AS batch_no,
           CAST(count(*) OVER (PARTITION BY doc_id) AS BIGINT) AS num_pages,
           CAST(ceil(count(*) OVER (PARTITION BY doc_id) / 10.0) AS BIGINT) AS total_batches,
           CAST(least(10, count(*) OVER (PARTITION BY doc_id) - ((page_no - 1) // 10) * 10) AS BIGINT) AS pages_in_batch
    FROM text_pages"""))
def q_fixed_batches(spark, sf):
    b = paging.assign_batches(V.text_pages(spark, sf), 10, "doc_id")
    return b.select("doc_id", "page_no", "batch_no", "num_pages", "total_batches", "pages_in_batch")


@register("batches_of_selection", with_views(["text_pages"], f"""
    SELECT doc_id, page_no, CAST((place - 1) // 2 + 1 AS BIGINT) AS batch_no, num_pages,
           CAST(ceil(num_pages / 2.0) AS BIGINT) AS total_batches,
           CAST(least(2, num_pages - (place - 1) // 2 * 2) AS BIGINT) AS pages_in_batch
    FROM (SELECT doc_id, page_no, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS place,
                 CAST(count(*) OVER (PARTITION BY doc_id) AS BIGINT) AS num_pages
          FROM text_pages WHERE page_no >= {SELECT_FIRST})"""))
def q_batches_of_selection(spark, sf):
    picked = paging.select_pages(V.text_pages(spark, sf).select("doc_id", "page_no", "num_pages"), first=SELECT_FIRST)
    return paging.batch_selection(picked, 2, "doc_id").select(
        "doc_id", "page_no", "batch_no", "num_pages", "total_batches", "pages_in_batch")


@register("batch_labels", with_views(["text_pages"], """
    SELECT doc_id, batch_no, start_page, end_page,
           'Pages_' || lpad(CAST(start_page AS VARCHAR), CAST(length(CAST(num_pages AS VARCHAR)) AS INTEGER), '0') || '_to_'
                    || lpad(CAST(end_page AS VARCHAR), CAST(length(CAST(num_pages AS VARCHAR)) AS INTEGER), '0') AS label
    FROM (SELECT doc_id, CAST((page_no - 1) // 10 + 1 AS BIGINT) AS batch_no, min(page_no) AS start_page,
                 max(page_no) AS end_page, max(num_pages) AS num_pages
          FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS num_pages FROM text_pages)
          GROUP BY doc_id, batch_no)"""))
def q_batch_labels(spark, sf):
    b = paging.assign_batches(V.text_pages(spark, sf), 10, "doc_id")
    return paging.batch_labels(b, "doc_id").select("doc_id", "batch_no", "start_page", "end_page", "label")


@register("page_labels", with_views(["text_pages"], """
    SELECT doc_id, page_no,
           'Page_' || lpad(CAST(page_no AS VARCHAR), CAST(length(CAST(count(*) OVER (PARTITION BY doc_id) AS VARCHAR)) AS INTEGER), '0') || '.jpeg' AS padded,
           'page_' || CAST(page_no AS VARCHAR) || '.jpg' AS unpadded
    FROM text_pages"""))
def q_page_labels(spark, sf):
    b = paging.assign_batches(V.text_pages(spark, sf), 10, "doc_id")
    return b.select(
        "doc_id", "page_no",
        textfn.page_label("page_no", "num_pages").alias("padded"),
        textfn.page_label("page_no", padded=False, prefix="page_", suffix=".jpg").alias("unpadded"),
    )


@register("natural_sort", with_views(["page_names"], """
    SELECT doc_id, name, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY
             lower(regexp_extract(name, '^[^0-9]*', 0)), CAST(regexp_extract(name, '[0-9]+', 0) AS BIGINT), name) AS BIGINT) AS natural_rank
    FROM page_names"""))
def q_natural_sort(spark, sf):
    return paging.natural_order(V.page_names(spark, sf), "name", ["doc_id"]).select("doc_id", "name", "natural_rank")


@register("stem_sort", with_views(["page_names"], """
    SELECT doc_id, name, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY
             regexp_extract(name, '^(.*?)(\\.[^.]*)?\\z', 1), name) AS BIGINT) AS stem_rank
    FROM page_names"""))
def q_stem_sort(spark, sf):
    return paging.stem_order(V.page_names(spark, sf), "name", ["doc_id"]).select("doc_id", "name", "stem_rank")


@register("stitch_pages", with_views(["text_pages"], """
    SELECT doc_id, string_agg('# Page ' || split_part(label, '_', 2) || chr(10) || chr(10) || content || chr(10) || chr(10), ''
                              ORDER BY start_page) AS markdown
    FROM (SELECT doc_id, min(page_no) AS start_page,
                 'Pages_' || lpad(CAST(min(page_no) AS VARCHAR), CAST(length(CAST(max(num_pages) AS VARCHAR)) AS INTEGER), '0') || '_to_'
                          || lpad(CAST(max(page_no) AS VARCHAR), CAST(length(CAST(max(num_pages) AS VARCHAR)) AS INTEGER), '0') AS label,
                 string_agg(text, chr(10) ORDER BY page_no) AS content
          FROM (SELECT *, CAST((page_no - 1) // 10 + 1 AS BIGINT) AS batch_no,
                       count(*) OVER (PARTITION BY doc_id) AS num_pages FROM text_pages)
          GROUP BY doc_id, batch_no)
    GROUP BY doc_id"""))
def q_stitch_pages(spark, sf):
    return paging.stitch_pages(_stitch_inputs(spark, sf), "doc_id", "label", "content")


def _stitch_inputs(spark, sf):
    """``(doc_id, label, content)``: one labelled part per batch of 10 text pages."""
    b = paging.assign_batches(V.text_pages(spark, sf), 10, "doc_id")
    return paging.collect_batches(b, "text", "doc_id", extra_cols=["num_pages"]).select(
        "doc_id",
        textfn.batch_label("start_page", "end_page", "num_pages").alias("label"),
        F.array_join(F.transform("pages", lambda p: p["payload"]), "\n").alias("content"),
    )


# The bounded form of stitch_pages: the same blocks as ordered rows, so a
# document of any size is never one row.
@register("stitch_parts", with_views(["text_pages"], """
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start_page) AS BIGINT) AS part_no,
           '# Page ' || split_part(label, '_', 2) || chr(10) || chr(10) || content || chr(10) || chr(10) AS markdown
    FROM (SELECT doc_id, min(page_no) AS start_page,
                 'Pages_' || lpad(CAST(min(page_no) AS VARCHAR), CAST(length(CAST(max(num_pages) AS VARCHAR)) AS INTEGER), '0') || '_to_'
                          || lpad(CAST(max(page_no) AS VARCHAR), CAST(length(CAST(max(num_pages) AS VARCHAR)) AS INTEGER), '0') AS label,
                 string_agg(text, chr(10) ORDER BY page_no) AS content
          FROM (SELECT *, CAST((page_no - 1) // 10 + 1 AS BIGINT) AS batch_no,
                       count(*) OVER (PARTITION BY doc_id) AS num_pages FROM text_pages)
          GROUP BY doc_id, batch_no)"""))
def q_stitch_parts(spark, sf):
    return paging.stitch_parts(_stitch_inputs(spark, sf), "doc_id", "label", "content")


# ----------------------------------------------------- 2.2 / 2.8 replies


@register("reply_text", with_views(["reply_envelopes"], """
    SELECT event_id, coalesce(json_extract_string(reply, '$.choices[0].message.content'), '') AS content
    FROM reply_envelopes"""))
def q_reply_text(spark, sf):
    return replies.reply_text(V.reply_envelopes(spark, sf)).select("event_id", "content")


@register("reply_usage", with_views(["reply_envelopes"], """
    SELECT event_id, CAST(json_extract(reply, '$.usage.prompt_tokens') AS BIGINT) AS prompt_tokens,
           CAST(json_extract(reply, '$.usage.completion_tokens') AS BIGINT) AS completion_tokens,
           CAST(json_extract(reply, '$.usage.prompt_tokens') AS BIGINT)
             + CAST(json_extract(reply, '$.usage.completion_tokens') AS BIGINT) AS total_tokens
    FROM reply_envelopes"""))
def q_reply_usage(spark, sf):
    return replies.reply_usage(V.reply_envelopes(spark, sf)).select(
        "event_id", "prompt_tokens", "completion_tokens", "total_tokens"
    )


_CLEAN_SQL = "regexp_replace(replace({c}, '```json' || chr(10), ''), '\\n```[^`]*\\z', '')"
_STRICT_SQL = "regexp_replace(replace({c}, '```json' || chr(10), ''), '\\n[^\\n]*\\z', '')"


@register("clean_json", with_views(["dirty_replies"], f"""
    SELECT event_id, cleaned, json_valid(cleaned) AS valid, strict_cleaned, json_valid(strict_cleaned) AS strict_valid,
           CASE WHEN json_valid(cleaned) THEN CAST(json_extract_string(cleaned, '$.k') AS BIGINT) END AS k
    FROM (SELECT event_id, {_CLEAN_SQL.format(c='r')} AS cleaned, {_STRICT_SQL.format(c='r')} AS strict_cleaned
          FROM dirty_replies)"""))
def q_clean_json(spark, sf):
    d = V.dirty_replies(spark, sf)
    cleaned = jsonfn.clean_json("r")
    strict = jsonfn.clean_json("r", strict=True)
    out = d.select("event_id", cleaned.alias("cleaned"), strict.alias("strict_cleaned"))
    out = out.withColumn("valid", jsonfn.is_valid_json("cleaned")).withColumn(
        "strict_valid", jsonfn.is_valid_json("strict_cleaned")
    )
    return out.withColumn("k", F.when(F.col("valid"), F.get_json_object("cleaned", "$.k").cast("bigint")))


@register("invalid_replies", with_views(["reply_envelopes"], f"""
    SELECT event_id, content FROM (
      SELECT event_id, content, {_CLEAN_SQL.format(c='content')} AS cleaned
      FROM (SELECT event_id, coalesce(json_extract_string(reply, '$.choices[0].message.content'), '') AS content
            FROM reply_envelopes))
    WHERE NOT json_valid(cleaned)"""))
def q_invalid_replies(spark, sf):
    r = replies.parse_reply_json(replies.reply_fields(V.reply_envelopes(spark, sf)))
    _, rejects = replies.split_valid(r)
    return rejects.select("event_id", "content")


@register("flag_truncated", with_views(["reply_envelopes"], f"""
    SELECT event_id, completion_tokens, CASE WHEN completion_tokens >= 4096 THEN 'cap' ELSE 'unparsed' END AS reason
    FROM (SELECT event_id, CAST(json_extract(reply, '$.usage.completion_tokens') AS BIGINT) AS completion_tokens,
                 {_CLEAN_SQL.format(c="coalesce(json_extract_string(reply, '$.choices[0].message.content'), '')")} AS cleaned
          FROM reply_envelopes)
    WHERE completion_tokens >= 4096 OR NOT json_valid(cleaned)"""))
def q_flag_truncated(spark, sf):
    r = replies.parse_reply_json(replies.reply_fields(V.reply_envelopes(spark, sf)))
    return replies.flag_truncated(r).select("event_id", "completion_tokens", "reason")


# --------------------------------------------------------- 2.3/2.4 combine

_KV_SQL = "SELECT doc, batch_no, key, CAST(pos AS BIGINT) AS pos, value FROM batch_kv"
_FLAT_KV_SQL = """
    SELECT doc, batch_no, key, CAST(pos AS BIGINT) AS pos, json_extract(j, '$."' || key || '"')::VARCHAR AS value
    FROM (SELECT doc, batch_no, j, unnest(json_keys(j)) AS key, generate_subscripts(json_keys(j), 1) AS pos
          FROM flat_batch_json)"""
_FOUND_SQL = f"""
    SELECT doc, key,
           arg_max(value, batch_no * 1000000 + pos) FILTER (WHERE {truthy_sql('value')}) AS value,
           min(batch_no * 1000000 + pos) FILTER (WHERE {truthy_sql('value')}) AS first_seen
    FROM kv GROUP BY doc, key"""
_FILLED_SQL = f"""
      SELECT d.doc, CAST(t.ord AS BIGINT) AS ord, t.key, coalesce(f.value, '""') AS value,
             CASE WHEN f.value IS NULL THEN 'default' ELSE 'found' END AS origin
      FROM (SELECT DISTINCT doc FROM found) d CROSS JOIN {TEMPLATE_SQL}
      LEFT JOIN found f ON f.doc = d.doc AND f.key = t.key
      UNION ALL
      SELECT doc, CAST(5 + row_number() OVER (PARTITION BY doc ORDER BY first_seen, key) AS BIGINT) AS ord,
             key, value, 'extra' AS origin
      FROM found WHERE value IS NOT NULL AND key NOT IN ('title', 'author', 'h1', 'lang', 'n_paragraphs')"""


def _combine_sql(body: str, extra=()) -> str:
    ctes = [("kv", _KV_SQL), ("found", _FOUND_SQL), ("filled", _FILLED_SQL), *extra]
    return with_views(["batch_kv"], body, ctes)


@register("template_keys", _combine_sql("SELECT doc, batch_no, pos AS ord, key, value AS example FROM kv"))
def q_template_keys(spark, sf):
    return combine.template_rows(V.batch_json(spark, sf), "j", ["doc", "batch_no"])


@register("truthy_fields", _combine_sql(f"SELECT doc, batch_no, pos, key, value, {truthy_sql('value')} AS truthy FROM kv"))
def q_truthy_fields(spark, sf):
    return combine.reply_entries(V.batch_json(spark, sf), "j", ["doc", "batch_no"])


@register("template_defaults", _combine_sql("SELECT doc, ord, key, value, origin FROM filled"))
def q_template_defaults(spark, sf):
    return combine.combine_entries(V.batch_json(spark, sf), V.BINDER_TEMPLATE)


@register("combine_last_non_empty", _combine_sql("""
    SELECT doc, '{' || string_agg(to_json(key)::VARCHAR || ':' || value, ',' ORDER BY ord) || '}' AS record
    FROM filled GROUP BY doc"""))
def q_combine(spark, sf):
    return combine.combine_last_non_empty(V.batch_json(spark, sf), V.BINDER_TEMPLATE)


# ------------------------------------------------------------- 2.4 metrics


@register("usage_by_request", with_views(["usage_log"], """
    SELECT doc, model, request_no, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens,
           CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,
           CAST(sum(prompt_tokens) + sum(completion_tokens) AS BIGINT) AS total_tokens
    FROM usage_log GROUP BY doc, model, request_no"""))
def q_usage_by_request(spark, sf):
    return metrics.usage_by_request(V.usage_log(spark, sf))


@register("usage_by_model", with_views(["usage_log"], """
    SELECT model, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens,
           CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,
           CAST(sum(prompt_tokens) + sum(completion_tokens) AS BIGINT) AS total_tokens,
           CAST(count(*) AS BIGINT) AS n_requests
    FROM usage_log GROUP BY model"""))
def q_usage_by_model(spark, sf):
    return metrics.usage_by_model(V.usage_log(spark, sf))


@register("usage_rollup", with_views(["usage_log"], """
    SELECT doc, model, request_no, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens,
           CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,
           CAST(sum(prompt_tokens) + sum(completion_tokens) AS BIGINT) AS total_tokens,
           CAST(grouping(doc, model, request_no) AS BIGINT) AS level
    FROM usage_log GROUP BY ROLLUP (doc, model, request_no)"""))
def q_usage_rollup(spark, sf):
    return metrics.usage_rollup(V.usage_log(spark, sf))


_COST_SQL = """
    SELECT u.doc, u.model, u.prompt_tokens, u.completion_tokens, u.total_tokens,
           p.model IS NULL AS unpriced,
           u.prompt_tokens * p.prompt_per_1k / 1000.0 AS prompt_cost,
           u.completion_tokens * p.completion_per_1k / 1000.0 AS completion_cost,
           u.prompt_tokens * p.prompt_per_1k / 1000.0 + u.completion_tokens * p.completion_per_1k / 1000.0 AS total_cost
    FROM (SELECT doc, model, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens,
                 CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,
                 CAST(sum(prompt_tokens) + sum(completion_tokens) AS BIGINT) AS total_tokens
          FROM usage_log GROUP BY doc, model) u
    LEFT JOIN {prices} ON p.model = u.model"""


@register("usage_cost", with_views(["usage_log"], f"""
    SELECT u.doc, u.model, u.request_no, u.prompt_tokens, u.completion_tokens, p.model IS NULL AS unpriced,
           u.prompt_tokens * p.prompt_per_1k / 1000.0 AS prompt_cost,
           u.completion_tokens * p.completion_per_1k / 1000.0 AS completion_cost,
           u.prompt_tokens * p.prompt_per_1k / 1000.0 + u.completion_tokens * p.completion_per_1k / 1000.0 AS total_cost
    FROM usage_log u LEFT JOIN {QUERY_PRICES_SQL} ON p.model = u.model"""))
def q_usage_cost(spark, sf):
    return metrics.with_cost(V.usage_log(spark, sf), metrics.price_table(spark, QUERY_PRICES))


@register("usage_by_doc_model", with_views(["usage_log"], _COST_SQL.format(prices=QUERY_PRICES_SQL)))
def q_usage_by_doc_model(spark, sf):
    return metrics.usage_by_doc_model(V.usage_log(spark, sf), metrics.price_table(spark, QUERY_PRICES))


@register("doc_report", with_views(["usage_log", "doc_stats"], """
    SELECT s.doc, s.processing_seconds, s.num_pages, t.prompt_tokens, t.completion_tokens, t.total_tokens,
           printf('%d minutes %d seconds', CAST(floor(s.processing_seconds / 60) AS BIGINT),
                  CAST(floor(s.processing_seconds % 60) AS BIGINT)) AS elapsed
    FROM doc_stats s LEFT JOIN (
      SELECT doc, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens,
             CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,
             CAST(sum(prompt_tokens) + sum(completion_tokens) AS BIGINT) AS total_tokens
      FROM usage_log GROUP BY doc) t ON t.doc = s.doc"""))
def q_doc_report(spark, sf):
    return metrics.doc_report(V.usage_log(spark, sf), V.doc_stats(spark, sf))


@register("format_elapsed", with_views(["doc_stats"], """
    SELECT doc, printf('%d minutes %d seconds', CAST(floor(processing_seconds / 60) AS BIGINT),
                       CAST(floor(processing_seconds % 60) AS BIGINT)) AS elapsed
    FROM doc_stats"""))
def q_format_elapsed(spark, sf):
    return V.doc_stats(spark, sf).select("doc", textfn.format_elapsed("processing_seconds").alias("elapsed"))


def _money_sql(x: str) -> str:
    return f"coalesce('$' || printf('%.2f', {x}), 'n/a')"


@register("usage_report", with_views(["usage_log", "doc_stats"], f"""
    SELECT c.doc, c.model,
      CAST(c.doc AS VARCHAR) || '  (' || CAST(coalesce(s.num_pages, 0) AS VARCHAR) || ' pages): '
        || coalesce(printf('%d minutes %d seconds', CAST(floor(s.processing_seconds / 60) AS BIGINT),
                           CAST(floor(s.processing_seconds % 60) AS BIGINT)), 'n/a') || chr(10)
        || '      Model: ' || c.model || chr(10)
        || '          Total prompt tokens: ' || CAST(c.prompt_tokens AS VARCHAR) || chr(10)
        || '          Total completion tokens: ' || CAST(c.completion_tokens AS VARCHAR) || chr(10)
        || '          Total token usage: ' || CAST(c.total_tokens AS VARCHAR) || ' tokens' || chr(10)
        || '          Prompt token cost: ' || {_money_sql('c.prompt_cost')} || chr(10)
        || '          Completion token cost: ' || {_money_sql('c.completion_cost')} || chr(10)
        || '          Total cost: ' || {_money_sql('c.total_cost')} AS text
    FROM ({_COST_SQL.format(prices=QUERY_PRICES_SQL)}) c LEFT JOIN doc_stats s ON s.doc = c.doc"""))
def q_usage_report(spark, sf):
    return metrics.usage_report(V.usage_log(spark, sf), V.doc_stats(spark, sf), metrics.price_table(spark, QUERY_PRICES))


# ------------------------------------------------------ 2.5 budget batching

BUDGET_TOKENS, BUDGET_PAGES = 4096, 10


_BUDGET_CTES = [
    ("tp", "SELECT doc_id, page_no, CAST(ceil(length(text) / 4.0) AS BIGINT) AS t FROM text_pages"),
    ("g(doc_id, page_no, t, batch_no, used, cnt)", f"""
      SELECT doc_id, page_no, t, 1, t, 1 FROM tp WHERE page_no = 1
      UNION ALL
      SELECT tp.doc_id, tp.page_no, tp.t,
             CASE WHEN g.used + tp.t > {BUDGET_TOKENS} OR g.cnt >= {BUDGET_PAGES} THEN g.batch_no + 1 ELSE g.batch_no END,
             CASE WHEN g.used + tp.t > {BUDGET_TOKENS} OR g.cnt >= {BUDGET_PAGES} THEN tp.t ELSE g.used + tp.t END,
             CASE WHEN g.used + tp.t > {BUDGET_TOKENS} OR g.cnt >= {BUDGET_PAGES} THEN 1 ELSE g.cnt + 1 END
      FROM g JOIN tp ON tp.doc_id = g.doc_id AND tp.page_no = g.page_no + 1"""),
]


def _budget_sql(body: str, first: int = 1) -> str:
    ctes = [(name, sql.replace("WHERE page_no = 1", f"WHERE page_no = {first}")) for name, sql in _BUDGET_CTES]
    return with_views(["text_pages"], body, ctes, recursive=True)


def budget_pages(spark, sf):
    tp = V.text_pages(spark, sf)
    return tp.select("doc_id", "page_no", "num_pages", textfn.text_tokens("text").alias("tokens"))


_BUDGET_TOTALS = """
    SELECT doc_id, CAST(batch_no AS BIGINT) AS batch_no, min(page_no) AS start_page, max(page_no) AS end_page,
           CAST(count(*) AS BIGINT) AS n_pages, CAST(sum(t) AS BIGINT) AS tokens
    FROM g GROUP BY doc_id, batch_no"""


@register("budget_selected_pages", _budget_sql(_BUDGET_TOTALS, SELECT_FIRST + 1))
def q_budget_selected_pages(spark, sf):
    from pagewright.operators import budget

    chosen = paging.select_pages(budget_pages(spark, sf), first=SELECT_FIRST + 1)
    a = budget.budget_batches(chosen, BUDGET_TOKENS, BUDGET_PAGES, doc="doc_id")
    return budget.batch_totals(a, doc="doc_id")


@register("budget_batches", _budget_sql(_BUDGET_TOTALS))
def q_budget_batches(spark, sf):
    from pagewright.operators import budget

    a = budget.budget_batches(budget_pages(spark, sf), BUDGET_TOKENS, BUDGET_PAGES, doc="doc_id")
    return budget.batch_totals(a, doc="doc_id")


@register("rank_hot_group", """
    WITH d AS (SELECT doc_id, n_chars, CASE WHEN doc_id % 3 = 0 THEN 'hot' WHEN doc_id % 3 = 1 THEN NULL ELSE source END AS grp
               FROM documents)
    SELECT doc_id, grp, CAST(row_number() OVER (PARTITION BY grp ORDER BY n_chars, doc_id) AS BIGINT) AS rank
    FROM d""")
def q_rank_hot_group(spark, sf):
    from pagewright.operators.ranking import rank_within

    d = read_table(spark, sf, "documents", ["doc_id", "n_chars", "source"])
    third = F.col("doc_id") % 3
    grp = F.when(third == 0, F.lit("hot")).when(third == 1, F.lit(None).cast("string")).otherwise(F.col("source"))
    keyed = d.select("doc_id", "n_chars", grp.alias("grp"))
    return rank_within(keyed, ["grp"], ["n_chars", "doc_id"]).select("doc_id", "grp", "rank")


@register("image_tokens", with_views(["image_dims"], """
    SELECT page_id, width, height,
           CAST(85 + 170 * ceil(width / 512.0) * ceil(height / 512.0) AS BIGINT) AS tokens
    FROM image_dims"""))
def q_image_tokens(spark, sf):
    d = V.image_dims(spark, sf)
    return d.select("page_id", "width", "height", textfn.image_tokens("width", "height").alias("tokens"))


@register("base64_pages", with_views(["text_pages"], """
    SELECT doc_id, page_no, to_base64(encode(text)) AS b64,
           'data:image/jpeg;base64,' || to_base64(encode(text)) AS url
    FROM text_pages"""))
def q_base64_pages(spark, sf):
    tp = V.text_pages(spark, sf)
    raw = F.encode("text", "UTF-8")
    return tp.select("doc_id", "page_no", textfn.b64(raw).alias("b64"), textfn.data_url(raw).alias("url"))


@register("float_or_text", f"""
    SELECT page_id, {_STEM_SQL} AS stem,
           CASE WHEN regexp_matches({_STEM_SQL}, '^[0-9]+$') THEN CAST({_STEM_SQL} AS DOUBLE) END AS number
    FROM pages""")
def q_float_or_text(spark, sf):
    p = read_table(spark, sf, "pages", ["page_id", "url"]).select("page_id", textfn.file_stem("url").alias("stem"))
    number, _ = textfn.float_or_text("stem")
    return p.select("page_id", "stem", number.alias("number"))


# ---------------------------------------------------- 2.8/2.9 requests, model


def _template_json() -> str:
    import json

    return json.dumps(dict(V.BINDER_TEMPLATE), separators=(",", ":"))


def _request_batches(spark, sf):
    b = paging.assign_batches(V.text_pages(spark, sf), 10, "doc_id")
    return paging.collect_batches(b, "text", "doc_id")


def _requests(spark, sf):
    from pagewright.operators import requests

    system, user = requests.fields_prompt(_template_json())
    return requests.build_request(_request_batches(spark, sf), system, user, kind="text")


def _request_sql(body: str) -> str:
    from pagewright.operators import requests
    from pagewright.plans.oracle_views import _sql_str

    system, user = requests.fields_prompt(_template_json())
    req = f"""
      SELECT doc_id, batch_no, count(*) AS n_pages, sum(length(text)) AS n_chars,
             json_object('messages', json_array(
                 json_object('role', 'system', 'content', json_array(json_object('type', 'text', 'text', {_sql_str(system)}))),
                 json_object('role', 'user', 'content', to_json(list_concat(
                     [json_object('type', 'text', 'text', {_sql_str(user)})],
                     list(json_object('type', 'text', 'text', text) ORDER BY page_no))))),
               'temperature', 0, 'top_p', 0, 'max_tokens', 4096)::VARCHAR AS payload
      FROM (SELECT *, CAST((page_no - 1) // 10 + 1 AS BIGINT) AS batch_no FROM text_pages)
      GROUP BY doc_id, batch_no"""
    return with_views(["text_pages"], body, [("req", req)])


@register("build_requests", _request_sql("SELECT doc_id, batch_no, payload FROM req"))
def q_build_requests(spark, sf):
    return _requests(spark, sf).select("doc_id", "batch_no", "payload")


# What a request holds, read back from its payload.
@register("request_contents", _request_sql("""
    SELECT doc_id, batch_no, n_pages, CAST(n_chars AS BIGINT) AS n_chars, CAST(ceil(length(payload) / 4.0) AS BIGINT) AS prompt_tokens
    FROM req"""))
def q_request_contents(spark, sf):
    from pagewright.operators import waves

    parts = F.from_json("payload", "messages array<struct<content:array<struct<text:string>>>>")["messages"][1]["content"]
    sent = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    chars = F.aggregate(sent, F.lit(0).cast("bigint"), lambda n, p: n + F.coalesce(F.length(p["text"]), F.lit(0)))
    return _requests(spark, sf).select(
        "doc_id", "batch_no", F.size(sent).cast("bigint").alias("n_pages"), chars.alias("n_chars"),
        waves.request_tokens("payload").alias("prompt_tokens"))


WAVE_TOKENS, WAVE_REQUESTS = 60_000, 25  # limits of a minute


@register("request_waves", _request_sql(f"""
    SELECT doc_id, batch_no, tokens, CAST(floor((upto - cost) / (1000000000 - max(cost) OVER ())) AS BIGINT) AS wave
    FROM (SELECT *, sum(cost) OVER (ORDER BY key, doc_id, batch_no ROWS UNBOUNDED PRECEDING) AS upto
          FROM (SELECT doc_id, batch_no, key, tokens,
                       greatest(CAST(ceil(CAST(tokens AS DECIMAL(38, 0)) * 1000000000 / {WAVE_TOKENS}) AS BIGINT), 1000000000 // {WAVE_REQUESTS}) AS cost
                FROM (SELECT doc_id, batch_no, sha256(payload) AS key, CAST(ceil(length(payload) / 4.0) AS BIGINT) AS tokens FROM req)))"""))
def q_request_waves(spark, sf):
    from pagewright.operators import model, waves

    sized = _requests(spark, sf).select("doc_id", "batch_no", model.payload_key("payload").alias("_key"), waves.request_tokens("payload").alias("tokens"))
    planned = waves.plan_waves(sized, "tokens", ["_key", "doc_id", "batch_no"], WAVE_TOKENS, WAVE_REQUESTS)
    return planned.select("doc_id", "batch_no", "tokens", "wave")


# -------------------------------------------------------- 2.9 extraction


@register("fill_template", """
    SELECT page_id, coalesce(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title,
           coalesce(regexp_extract(html, '<html lang="([^"]*)"', 1), '') AS lang,
           coalesce(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '') AS h1
    FROM pages""")
def q_fill_template(spark, sf):
    from pagewright.operators import extract

    p = read_table(spark, sf, "pages", ["page_id", "html"])
    return extract.fill_template(p, "html", V.BINDER_RULES).select("page_id", "title", "lang", "h1")


# The oracle knows the values that the forms were made from, not the labels.
@register("fill_from_labels", """
    SELECT c_custkey, '{"customer":{"name":' || to_json(c_name)::VARCHAR || ',"segment":' || to_json(c_mktsegment)::VARCHAR
           || '},"account":{"balance":' || printf('%.2f', c_acctbal) || ',"nation_key":' || c_nationkey
           || '},"tags":[' || to_json(c_mktsegment)::VARCHAR || ',"k' || c_custkey % 7 || '"]}' AS j, 5::BIGINT AS n_matches
    FROM customer""")
def q_fill_from_labels(spark, sf):
    from pagewright.operators import align

    filled = align.fill_from_labels(V.form_pages(spark, sf), "md", V.FORM_TEMPLATE, ["c_custkey"])
    return filled.select("c_custkey", "j", F.size("matches").cast("bigint").alias("n_matches"))


@register("to_markdown", with_views(["markdown_pages"], "SELECT doc, page_no, md FROM markdown_pages"))
def q_to_markdown(spark, sf):
    return V.markdown_pages(spark, sf)


def _clean_md_sql():
    from pagewright.plans.oracle_views import clean_markdown_sql

    return with_views(["markdown_pages"], f"SELECT doc, page_no, {clean_markdown_sql('md')} AS md FROM markdown_pages")


@register("clean_markdown", _clean_md_sql())
def q_clean_markdown(spark, sf):
    from pagewright.operators import extract

    m = V.markdown_pages(spark, sf)
    return m.select("doc", "page_no", extract.clean_markdown("md").alias("md"))


_LINES_SQL = """
      SELECT doc, page_no, line_no, line, kind,
             sum(CASE WHEN kind IN ('header', 'subheader') THEN 1 ELSE 0 END)
               OVER (PARTITION BY doc, page_no ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section_no
      FROM (SELECT doc, page_no, CAST(line_no AS BIGINT) AS line_no, line,
                   CASE WHEN regexp_matches(line, '^## ') THEN 'header'
                        WHEN regexp_matches(line, '^### ') THEN 'subheader'
                        WHEN regexp_matches(line, '^[-*] ') THEN 'list'
                        WHEN regexp_matches(line, '\\[[^\\]]*\\]\\([^)]*\\)') THEN 'link'
                        WHEN trim(line) = '' THEN 'blank'
                        WHEN regexp_matches(line, '^\\p{L}[^:]{0,59}:[ \\t]+(?s:.)') THEN 'field'
                        ELSE 'text' END AS kind
            FROM (SELECT doc, page_no, unnest(string_split(md, chr(10))) AS line,
                         generate_subscripts(string_split(md, chr(10)), 1) AS line_no
                  FROM markdown_pages))"""
_FIELDS_SQL = """
      SELECT doc, page_no, section_no,
             string_agg(to_json(label)::VARCHAR || ':' || CASE WHEN n = 1 THEN vals ELSE '[' || vals || ']' END, ','
                        ORDER BY first_line) AS fields
      FROM (SELECT doc, page_no, section_no, label, count(*) AS n, min(line_no) AS first_line,
                   string_agg(to_json(val)::VARCHAR, ',' ORDER BY line_no) AS vals
            FROM (SELECT *, regexp_extract(line, '^([^:]*):', 1) AS label,
                         regexp_extract(line, '^[^:]*:[ \\t]+((?s:.)+)$', 1) AS val
                  FROM lines WHERE kind = 'field')
            GROUP BY doc, page_no, section_no, label)
      GROUP BY doc, page_no, section_no"""
_SECTIONS_SQL = """
      SELECT doc, page_no, CAST(section_no AS BIGINT) AS section_no,
             coalesce(max(CASE WHEN kind IN ('header', 'subheader') THEN regexp_replace(line, '^#+ ', '') END), '') AS section,
             CAST(coalesce(max(CASE WHEN kind = 'header' THEN 2 WHEN kind = 'subheader' THEN 3 END), 0) AS BIGINT) AS level,
             CAST(sum(CASE WHEN kind = 'list' THEN 1 ELSE 0 END) AS BIGINT) AS n_lists,
             CAST(sum(CASE WHEN kind = 'link' THEN 1 ELSE 0 END) AS BIGINT) AS n_links,
             CAST(sum(CASE WHEN kind = 'field' THEN 1 ELSE 0 END) AS BIGINT) AS n_fields,
             CAST(sum(CASE WHEN kind = 'text' THEN 1 ELSE 0 END) AS BIGINT) AS n_text,
             CAST(sum(CASE WHEN kind IN ('list', 'link', 'field', 'text') THEN length(line) ELSE 0 END) AS BIGINT) AS n_chars,
             string_agg(CASE WHEN kind = 'list' THEN to_json(line[3:])::VARCHAR END, ',' ORDER BY line_no) AS lists,
             string_agg(CASE WHEN kind = 'text' THEN to_json(line)::VARCHAR END, ',' ORDER BY line_no) AS texts,
             string_agg(CASE WHEN links <> '' THEN links END, ',' ORDER BY line_no) AS links
      FROM (SELECT *, array_to_string(list_transform(
                   regexp_extract_all(line, '\\[[^\\]]*\\]\\([^)]*\\)'),
                   lambda l: '{"Text":' || to_json(regexp_extract(l, '^\\[([^\\]]*)', 1))::VARCHAR
                        || ',"Href":' || to_json(regexp_extract(l, '\\]\\(([^)]*)', 1))::VARCHAR || '}'), ',') AS links
            FROM lines)
      GROUP BY doc, page_no, section_no"""
_OUTLINE_SQL = """
      SELECT s.doc, s.page_no, s.section_no, section, level, n_lists, n_links, n_fields, n_text, n_chars,
             CASE WHEN level = 3 THEN above END AS parent_no,
             CASE WHEN level = 3 AND above IS NOT NULL THEN above_title || ' > ' || section ELSE section END AS path,
             CASE level WHEN 2 THEN 6::BIGINT WHEN 3 THEN 5::BIGINT ELSE 1::BIGINT END AS importance,
             '{"Section":' || to_json(section)::VARCHAR || ',"Importance":' || CASE level WHEN 2 THEN 6 WHEN 3 THEN 5 ELSE 1 END
             || ',"Fields":{' || coalesce(fields, '')
             || '},"Lists":[' || coalesce(lists, '') || '],"Links":[' || coalesce(links, '')
             || '],"Text":[' || coalesce(texts, '') || ']}' AS content
      FROM (SELECT *, max(CASE WHEN level = 2 THEN section_no END) OVER up AS above,
                   last_value(CASE WHEN level = 2 THEN section END IGNORE NULLS) OVER up AS above_title
            FROM sections WINDOW up AS (PARTITION BY doc, page_no ORDER BY section_no)) s
      LEFT JOIN fields f ON f.doc = s.doc AND f.page_no = s.page_no AND f.section_no = s.section_no"""
_ENTRY_SQL = """
      SELECT doc, page_no,
             '"Page ' || CAST(page_no AS VARCHAR) || '":{"Header":'
             || to_json(coalesce(max(CASE WHEN section_no = 1 THEN section END), ''))::VARCHAR
             || ',"Sections":[' || coalesce(string_agg(CASE WHEN parent_no IS NULL AND (section_no > 0 OR n_chars > 0)
                                                            THEN content[:-2] || ',"Sections":[' || coalesce(inside, '') || ']}' END, ','
                                                       ORDER BY section_no), '') || ']}' AS entry
      FROM (SELECT o.*, (SELECT string_agg(c.content[:-2] || ',"Sections":[]}', ',' ORDER BY c.section_no) FROM outline c
                         WHERE c.doc = o.doc AND c.page_no = o.page_no AND c.parent_no = o.section_no) AS inside
            FROM outline o)
      GROUP BY doc, page_no"""


def _outline_sql(body: str) -> str:
    ctes = [("lines", _LINES_SQL), ("fields", _FIELDS_SQL), ("sections", _SECTIONS_SQL),
            ("outline", _OUTLINE_SQL), ("entries", _ENTRY_SQL)]
    return with_views(["markdown_pages"], body, ctes)


@register("markdown_outline", _outline_sql("SELECT * FROM outline"))
def q_markdown_outline(spark, sf):
    from pagewright.operators import extract

    return extract.markdown_outline(V.markdown_pages(spark, sf), "md", ["doc", "page_no"])


@register("assemble_pages", _outline_sql(
    "SELECT doc, '{' || string_agg(entry, ',' ORDER BY page_no) || '}' AS record FROM entries GROUP BY doc"))
def q_assemble_pages(spark, sf):
    from pagewright.operators import extract

    return extract.assemble_pages(V.markdown_pages(spark, sf), "md", "doc")


# The bounded form of assemble_pages: one entry row per page.
@register("page_entries", _outline_sql("SELECT doc, page_no, entry FROM entries"))
def q_page_entries(spark, sf):
    from pagewright.operators import extract

    return extract.page_entries(V.markdown_pages(spark, sf), "md", "doc")


@register("outline_elements", _outline_sql("""
    SELECT l.doc, l.page_no, l.line_no, e.kind, e.weight AS importance, l.section_no, o.path,
           CASE WHEN e.kind = 'list' THEN CAST(n_items AS VARCHAR) WHEN e.kind = 'item' THEN line[3:]
                WHEN e.kind IN ('header', 'subheader') THEN regexp_replace(line, '^#+ ', '') ELSE line END AS text
    FROM (SELECT *, CASE WHEN kind = 'list' THEN count(*) OVER (PARTITION BY doc, page_no, section_no, kind, run) END AS n_items,
                 kind = 'list' AND row_number() OVER (PARTITION BY doc, page_no, section_no, kind, run ORDER BY line_no) = 1 AS starts
          FROM (SELECT *, line_no - row_number() OVER (PARTITION BY doc, page_no, section_no, kind ORDER BY line_no) AS run FROM lines)) l
    JOIN (VALUES ('header', 6::BIGINT), ('subheader', 5), ('list', 4), ('field', 3), ('link', 3), ('item', 2), ('text', 1)) e(kind, weight)
      ON e.kind = CASE WHEN l.kind = 'list' THEN 'item' ELSE l.kind END OR (e.kind = 'list' AND l.starts)
    JOIN outline o ON o.doc = l.doc AND o.page_no = l.page_no AND o.section_no = l.section_no"""))
def q_outline_elements(spark, sf):
    from pagewright.operators import extract

    return extract.markdown_elements(V.markdown_pages(spark, sf), "md", ["doc", "page_no"])


_TYPE_SQL = """CASE {t} WHEN 'VARCHAR' THEN 'STRING' WHEN 'UBIGINT' THEN 'BIGINT' WHEN 'BIGINT' THEN 'BIGINT'
                      WHEN 'BOOLEAN' THEN 'BOOLEAN' WHEN 'DOUBLE' THEN 'DOUBLE' WHEN 'NULL' THEN 'VOID' ELSE {t} END"""


@register("infer_shape", with_views(["flat_batch_json"], f"""
    SELECT doc, 'OBJECT<' || string_agg(key || ': ' || kind, ', ' ORDER BY key) || '>' AS shape,
           max(n_replies) AS n_replies
    FROM (SELECT k.doc, k.key, CASE WHEN count(DISTINCT k.kind) = 1 THEN any_value(k.kind) ELSE 'VARIANT' END AS kind,
                 max(n.n_replies) AS n_replies
          FROM (SELECT doc, key,
                       CASE WHEN json_type(value) = 'OBJECT' THEN
                         'OBJECT<' || (SELECT string_agg(ik || ': ' || {_TYPE_SQL.format(t="json_type(value, '$.\"' || ik || '\"')")}, ', ' ORDER BY ik)
                                       FROM (SELECT unnest(json_keys(value)) AS ik)) || '>'
                       ELSE {_TYPE_SQL.format(t='json_type(value)')} END AS kind
                FROM kv) k
          JOIN (SELECT doc, CAST(count(*) AS BIGINT) AS n_replies FROM flat_batch_json GROUP BY doc) n ON n.doc = k.doc
          GROUP BY k.doc, k.key)
    GROUP BY doc""", [("kv", _FLAT_KV_SQL)]))
def q_infer_shape(spark, sf):
    from pagewright.operators import extract

    return extract.infer_shape(V.flat_batch_json(spark, sf), "j", ["doc"]).select("doc", "shape", "n_replies")


# --------------------------------------------------------------- 2.10 checks

TEMPLATE_EXAMPLES = {"title": '""', "author": '""', "h1": '""', "lang": '""', "n_paragraphs": "0"}


@register("check_template", _combine_sql("""
    SELECT doc, batch_no, t.key, 'missing' AS problem
    FROM (SELECT doc, batch_no, list(key) AS keys FROM kv GROUP BY doc, batch_no)
    CROSS JOIN (VALUES ('title'), ('author'), ('h1'), ('lang'), ('n_paragraphs')) t(key)
    WHERE NOT list_contains(keys, t.key)
    UNION ALL
    SELECT doc, batch_no, key, 'extra' AS problem FROM kv
    WHERE key NOT IN ('title', 'author', 'h1', 'lang', 'n_paragraphs')
    UNION ALL
    SELECT doc, batch_no, key, 'kind' AS problem FROM kv
    WHERE key IN ('title', 'author', 'h1', 'lang', 'n_paragraphs') AND value <> '""'
      AND (CASE WHEN key = 'n_paragraphs' THEN left(value, 1) IN ('"', '{', '[', 't', 'f', 'n')
                ELSE left(value, 1) <> '"' END)"""))
def q_check_template(spark, sf):
    from pagewright.operators import checks

    return checks.check_template(V.batch_json(spark, sf), V.BINDER_TEMPLATE, ["doc", "batch_no"], "j", TEMPLATE_EXAMPLES)


# The nested template as the rows (path, kind, parent): stated here on its own.
_NESTED_SQL = """(VALUES ('$', 'object', NULL), ('document', 'object', '$'), ('document.title', 'string', 'document'),
    ('document.lang', 'string', 'document'), ('document.author', 'string', 'document'), ('stats', 'object', '$'),
    ('stats.pages', 'number', 'stats'), ('stats.mean', 'number', 'stats'), ('stats.range', 'object', 'stats'),
    ('stats.range.first', 'number', 'stats.range'), ('stats.range.last', 'number', 'stats.range'), ('sheets', 'array', '$'),
    ('sheets[]', 'object', 'sheets'), ('sheets[].id', 'number', 'sheets[]'), ('sheets[].heading', 'string', 'sheets[]'),
    ('notes', 'array', '$'), ('notes[]', 'string', 'notes')) t(path, kind, above)"""


@register("check_nested_template", with_views(["nested_nodes"], f"""
    SELECT doc, batch_no, path, problem, count(*) AS n FROM (
      SELECT p.doc, p.batch_no, t.path, 'missing' AS problem
      FROM nested_nodes p JOIN {_NESTED_SQL} ON t.above = p.path AND p.kind = 'object' AND NOT t.path LIKE '%[]'
      WHERE NOT EXISTS (SELECT 1 FROM nested_nodes c WHERE c.doc = p.doc AND c.batch_no = p.batch_no AND c.parent = p.id AND c.path = t.path)
      UNION ALL
      SELECT c.doc, c.batch_no, c.path, 'extra'
      FROM nested_nodes c JOIN nested_nodes p ON c.doc = p.doc AND c.batch_no = p.batch_no AND c.parent = p.id
      WHERE p.path IN (SELECT path FROM {_NESTED_SQL}) AND c.path NOT IN (SELECT path FROM {_NESTED_SQL})
      UNION ALL
      SELECT c.doc, c.batch_no, c.path, 'kind' FROM nested_nodes c JOIN {_NESTED_SQL} ON t.path = c.path
      WHERE c.kind <> t.kind AND c.value <> '""'
      UNION ALL
      SELECT doc, batch_no, path, 'repeated'
      FROM (SELECT doc, batch_no, path, row_number() OVER (PARTITION BY doc, batch_no, parent, path) AS k FROM nested_nodes
            WHERE path NOT LIKE '%[]')
      WHERE k > 1 AND path IN (SELECT path FROM {_NESTED_SQL}))
    GROUP BY doc, batch_no, path, problem"""))
def q_check_nested_template(spark, sf):
    from pagewright.operators import shape

    return shape.check_template_paths(V.nested_replies(spark, sf), V.NESTED_TEMPLATE, ["doc", "batch_no"])


_SHAPE_SQL = """
      SELECT c.doc, c.path, any_value(p.path) AS parent, any_value(CASE WHEN c.path LIKE '%[]' THEN NULL ELSE c.key END) AS key,
             list_filter(['object', 'array', 'string', 'number', 'boolean', 'null'], lambda k: list_contains(list(c.kind), k)) AS kinds,
             count(*) AS n_values,
             CASE WHEN c.path LIKE '%[]' OR c.path = '$' THEN count(*) ELSE count(DISTINCT (c.batch_no, c.parent)) END AS n_present
      FROM nested_nodes c LEFT JOIN nested_nodes p ON c.doc = p.doc AND c.batch_no = p.batch_no AND c.parent = p.id
      GROUP BY c.doc, c.path"""


@register("reply_shape", with_views(["nested_nodes"], """
    SELECT s.*, CASE WHEN s.key IS NOT NULL THEN o.n END AS n_parents, coalesce(s.key IS NOT NULL AND o.n = n_present, false) AS required
    FROM shapes s LEFT JOIN (SELECT doc, path, count(*) FILTER (WHERE kind = 'object') AS n FROM nested_nodes GROUP BY doc, path) o
      ON o.doc = s.doc AND o.path = s.parent""", [("shapes", _SHAPE_SQL)]))
def q_reply_shape(spark, sf):
    from pagewright.operators import shape

    return shape.shape_rows(V.nested_replies(spark, sf), "j", ["doc"])


# One schema object for all replies: the oracle states which schema the fixture's replies have.
@register("reply_schema", with_views(["nested_replies"], """
    SELECT '{"type":"object","properties":{"document":{"type":"object","properties":{"author":{"type":"string"},'
           || '"lang":{"type":' || CASE WHEN third > 0 THEN '["string","null"]' ELSE '"string"' END || '},"title":{"type":"string"}},"required":['
           || CASE WHEN authors = n THEN '"author",' ELSE '' END || '"lang","title"]},'
           || CASE WHEN third > 0 THEN '"extra.1":{"type":"object","properties":{"deep":{"type":"array","items":{"type":["object","number"],'
              || '"properties":{"x":{"type":"boolean"}},"required":["x"]}}},"required":["deep"]},' ELSE '' END
           || '"notes":{"type":"array","items":{"type":["string","number","null"]}},'
           || '"sheets":{"type":"array","items":{"type":"object","properties":{"heading":{"type":"string"},"id":{"type":"number"}},"required":["id"]}},'
           || '"stats":{"type":["object","string"],"properties":{"mean":{"type":"number"},"pages":{"type":["string","number"]},'
           || '"range":{"type":"object","properties":{"first":{"type":"number"},"last":{"type":"number"},"step":{"type":"number"}},'
           || '"required":["first","last"]}},"required":["mean","pages"]}},'
           || '"required":["document",' || CASE WHEN third = n THEN '"extra.1",' ELSE '' END || '"notes","sheets","stats"]}' AS shape
    FROM (SELECT count(*) AS n, count(*) FILTER (WHERE batch_no = 3) AS third, count(*) FILTER (WHERE doc % 3 = 0) AS authors
          FROM nested_replies)"""))
def q_reply_schema(spark, sf):
    from pagewright.operators import shape

    return shape.shape_json(shape.shape_rows(V.nested_replies(spark, sf), "j"))


@register("check_grounded", _combine_sql("""
    SELECT f.doc, f.key, f.value, bool_or(coalesce(instr(lower(b.html), lower(f.value)) > 0, false)) AS grounded
    FROM (SELECT doc, key, json_extract_string(value, '$') AS value FROM filled WHERE left(value, 1) = '"') f
    LEFT JOIN page_src b ON b.doc = f.doc
    WHERE f.value <> ''
    GROUP BY f.doc, f.key, f.value""", [("page_src", "SELECT CAST(page_id // 5 AS BIGINT) AS doc, html FROM pages")]))
def q_check_grounded(spark, sf):
    from pagewright.operators import checks

    entries = combine.combine_entries(V.batch_json(spark, sf), V.BINDER_TEMPLATE)
    strings = entries.where(F.substring("value", 1, 1) == '"').select(
        "doc", "key", F.try_parse_json("value").cast("string").alias("value")
    )
    src = V.binder_pages(spark, sf).select("doc", F.col("html").alias("text"))
    return checks.check_grounded(strings, src, "doc", "value", "text", ["key"])


@register("check_headings", with_views(["markdown_pages"], """
    SELECT doc, page_no, CAST(len(regexp_extract_all(md, '(?m)^# ')) AS BIGINT) AS single_hash_lines FROM markdown_pages"""))
def q_check_headings(spark, sf):
    from pagewright.operators import checks

    return checks.check_headings(V.markdown_pages(spark, sf), "md", ["doc", "page_no"])


@register("check_coverage", with_views(["text_pages"], f"""
    SELECT doc_id, page_no FROM text_pages WHERE (page_no - 1) % {OVERSIZED_BATCH} >= 10"""))
def q_check_coverage(spark, sf):
    from pagewright.operators import checks

    tp = V.text_pages(spark, sf)
    b = paging.cap_pages(paging.collect_batches(paging.assign_batches(tp, OVERSIZED_BATCH, "doc_id"), "text", "doc_id"), 10)
    sent = b.select("doc_id", F.explode("pages").alias("p")).select("doc_id", F.col("p.page_no").alias("page_no"))
    return checks.check_coverage(tp.select("doc_id", "page_no"), sent, ["doc_id", "page_no"])
