"""End-to-end flows of the reference's three variants, as one Spark job each.

The reference loops over documents one at a time; each flow here handles all
documents of a folder or table at once.  The model is a parameter: pass a
``fn(payload) -> reply`` to call one, or use the rule-based stand-ins of
``operators.extract`` (``fill_template`` / ``html_to_markdown``).

Variant 2, batches of pages -> one template reply per batch -> combine:
    ``pages_to_records``
Variant 3, batches -> markdown per batch -> stitch -> one reply per document:
    ``pages_to_markdown`` then ``markdown_to_records``
Variant 1, first ten pages -> one reply per document:
    ``single_call_records``
Every variant also returns the usage of its calls, ``(doc, model, request_no,
prompt_tokens, completion_tokens)``, which the usage reports take; unions of
them add up a document's calls.  ``call_args`` go to the model call
(partitions, concurrency, retries, delays; ``chunks`` with a reply store).
Without a model, rule-based fill per page -> combine:
    ``rule_records``
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.jsonfn import compute_once, object_entries
from pagewright.functions.textfn import batch_label
from pagewright.operators import combine, extract, model, paging, replies, requests
from pagewright.operators.ranking import join_per_group
from pagewright.session import ensure_checkpoint_dir

# Models as the usage reports name them.
VISION, TEXT = "vision", "text"


def _call(req: DataFrame, fn: Callable[[str], str], path: str | None, call_args: dict | None) -> DataFrame:
    """Call the model once per request and keep the replies.

    With ``path`` the replies go to a store keyed by payload hash, so a rerun
    sends only requests without a good reply; without it the replies are
    checkpointed, because later steps read them twice.
    """
    args = call_args or {}
    if path:
        return model.call_model_cached(req, fn, path, **args)
    ensure_checkpoint_dir(req.sparkSession)
    return model.call_model(req, fn, **args).checkpoint(eager=True)


def _usage(called: DataFrame, doc_col: str, model_name: str, request_no) -> DataFrame:
    return called.select(
        doc_col, F.lit(model_name).alias("model"), request_no.cast("bigint").alias("request_no"),
        "prompt_tokens", "completion_tokens",
    )


def _template_json(template) -> str:
    """The example template as the request shows it: nested examples whole, ``""`` for bare keys."""
    if isinstance(template, DataFrame):
        rows = template.select("ord", "key", "example").orderBy("ord").collect()  # one row per template key
        return "{" + ",".join(json.dumps(r["key"], ensure_ascii=False) + ":" + r["example"] for r in rows) + "}"
    if not isinstance(template, dict):
        template = dict(t if isinstance(t, (tuple, list)) else (t, "") for t in template)
    return json.dumps(template, separators=(",", ":"), ensure_ascii=False)


def page_batches(pages: DataFrame, size: int = 10, doc_col: str = "doc", payload_col: str = "payload",
                 extra_cols=()) -> DataFrame:
    """Pages of each document (all, or any selection) -> labelled batches of ``size`` pages, in page order."""
    b = paging.batch_selection(pages, size, doc_col)
    c = paging.collect_batches(b, payload_col, doc_col, extra_cols=["num_pages", *extra_cols])
    return c.withColumn("label", batch_label("start_page", "end_page", "num_pages"))


def pages_to_records(pages: DataFrame, template, fn: Callable[[str], str], kind: str = "image",
                     size: int = 10, doc_col: str = "doc", payload_col: str = "payload",
                     description: str = requests.DOC_DESCRIPTION, replies_path: str | None = None,
                     strict: bool = False, call_args: dict | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Variant 2.  Returns ``(records, rejects, usage_log)``.

    records: ``(doc, record)``; rejects: replies that did not parse, or are
    JSON but not an object; usage_log as above.
    """
    system, user = requests.fields_prompt(_template_json(template), description)
    batches = page_batches(pages, size, doc_col, payload_col)
    req = requests.build_request(batches, system, user, kind=kind)
    called = _call(req.drop("pages"), fn, replies_path, call_args)
    parsed = replies.parse_reply_json(replies.reply_fields(called), strict=strict)
    parsed = compute_once(parsed.drop("valid"), valid=object_entries("json").isNotNull())
    good, rejects = replies.split_valid(parsed)
    records = combine.combine_last_non_empty(good, template, doc_col, "batch_no", "json")
    return records, rejects, _usage(parsed, doc_col, VISION, F.col("batch_no"))


def markdown_parts(pages: DataFrame, fn: Callable[[str], str], kind: str = "image", size: int = 10,
                   doc_col: str = "doc", payload_col: str = "payload", replies_path: str | None = None,
                   call_args: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Variant 3, the vision calls: ``((doc, label, content), usage_log)``, one row per batch.

    ``paging.stitch_parts`` of the first gives a document of any size as
    ordered rows; ``pages_to_markdown`` puts each document in one row.
    """
    batches = page_batches(pages, size, doc_col, payload_col)
    req = requests.build_request(batches, requests.MARKDOWN_SYSTEM, requests.MARKDOWN_USER, kind=kind)
    called = replies.reply_fields(_call(req.drop("pages"), fn, replies_path, call_args))
    return called.select(doc_col, "label", "content"), _usage(called, doc_col, VISION, F.col("batch_no"))


def pages_to_markdown(pages: DataFrame, fn: Callable[[str], str], kind: str = "image", size: int = 10,
                      doc_col: str = "doc", payload_col: str = "payload", replies_path: str | None = None,
                      call_args: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Variant 3, first half: ``((doc, markdown), usage_log)``, stitched from batch replies.

    The next half sends a document's markdown in one request, so it is one row.
    """
    parts, usage = markdown_parts(pages, fn, kind, size, doc_col, payload_col, replies_path, call_args)
    return paging.stitch_pages(parts, doc_col, "label", "content"), usage


def markdown_to_records(markdown: DataFrame, fn: Callable[[str], str], template=None,
                        doc_col: str = "doc", md_col: str = "markdown",
                        description: str = requests.DOC_DESCRIPTION, replies_path: str | None = None,
                        call_args: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Variant 3, second half: one JSON-mode request per stitched document.

    Returns ``((doc, json, valid), usage_log)``; no token cap, as in the
    reference.  Without a template the model chooses the fields.
    """
    system = requests.text_fields_prompt(None if template is None else _template_json(template), description)
    req = requests.build_text_request(markdown.select(doc_col, md_col), system, md_col).drop(md_col)
    called = replies.reply_fields(_call(req, fn, replies_path, call_args))
    records = replies.parse_reply_json(called).select(doc_col, "json", "valid")
    return records, _usage(called, doc_col, TEXT, F.lit(1))


def single_call_records(pages: DataFrame, fn: Callable[[str], str], kind: str = "image",
                        doc_col: str = "doc", payload_col: str = "payload", page_col: str = "page_no",
                        replies_path: str | None = None, call_args: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Variant 1: the first ten pages of each document in one request.

    Returns ``((doc, json, valid, dropped_pages), usage_log)``; unlike the
    reference the pages are taken in page order and the dropped ones are
    counted.  The limit is applied before the payloads move: Spark keeps ten
    rows per document and task ahead of the shuffle (window group limit).
    """
    limit = requests.MAX_PAGES_PER_REQUEST
    place = F.row_number().over(Window.partitionBy(doc_col).orderBy(page_col))
    first = pages.withColumn("_place", place).where(F.col("_place") <= limit)
    one = paging.collect_batches(first.withColumn("batch_no", F.lit(1)), payload_col, doc_col, page_col)
    count = paging.page_count(pages, doc_col, "_pages")
    counted = join_per_group(one, count, [doc_col], "left").withColumn("dropped_pages", F.col("_pages") - F.size("pages"))
    req = requests.build_request(counted, requests.SINGLE_CALL_SYSTEM, requests.SINGLE_CALL_USER, kind=kind)
    called = replies.reply_fields(_call(req.drop("pages", "_pages"), fn, replies_path, call_args))
    records = replies.parse_reply_json(called).select(doc_col, "json", "valid", "dropped_pages")
    return records, _usage(called, doc_col, VISION, F.lit(1))


def rule_records(pages: DataFrame, rules, doc_col: str = "doc", page_col: str = "page_no",
                 text_col: str = "text", keep_zero: bool = False) -> DataFrame:
    """Variant 2 without a model: fill the template on every page by rule,
    then combine pages in page order (last non-empty value per key wins).

    ``rules`` as in ``extract.template_record``; their top-level keys are the
    template.  Returns ``(doc, record)``.
    """
    keys = []
    for rule in rules:
        top = rule[0].split(".")[0]
        if top not in keys:
            keys.append(top)
    per_page = extract.template_record(pages, text_col, rules, "j").select(doc_col, page_col, "j")
    return combine.combine_last_non_empty(per_page, keys, doc_col, page_col, "j", keep_zero=keep_zero)
