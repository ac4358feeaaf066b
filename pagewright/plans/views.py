"""Derived views over the driver tables (see FIXTURES.md section 3).

Each view is a DataFrame built from the tables by our operators, so every
query that uses them grows with the tables.  ``plans/oracle_views.py`` states
the same views in DuckDB SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions.textfn import page_label
from pagewright.operators import extract, paging
from pagewright.sources.tables import read_table

# Fixed parameters of the fixture views.
LINES_PER_PAGE = 10
PAGES_PER_BINDER = 5
PAGES_PER_REPLY = 2

# Rules that fill the binder template from page markup (patterns valid in
# Java and RE2 alike).
BINDER_RULES = [
    ("title", r"<title>([^<]*)</title>"),
    ("lang", r'<html lang="([^"]*)"'),
    ("h1", r"<h1>([^<]*)</h1>"),
]
# Template of the binder records: keys in order, example values.
BINDER_TEMPLATE = [("title", ""), ("author", ""), ("h1", ""), ("lang", ""), ("n_paragraphs", 0)]


def documents(spark: SparkSession, sf_dir: str, columns=("doc_id", "text")) -> DataFrame:
    return read_table(spark, sf_dir, "documents", list(columns), spread_by="doc_id")


def text_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page_no, num_pages, text): documents cut into pages of 10 lines."""
    return paging.explode_pages(documents(spark, sf_dir), "doc_id", "text", LINES_PER_PAGE)


def page_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page_no, name): ``Page_<n>.jpeg``, unpadded."""
    return text_pages(spark, sf_dir).select(
        "doc_id", "page_no", page_label("page_no", padded=False).alias("name")
    )


def binder_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, page_no, page_id, html, url): web pages bound five to a binder."""
    pages = read_table(spark, sf_dir, "pages", ["page_id", "url", "html"], spread_by="page_id")
    return pages.select(
        F.expr(f"page_id div {PAGES_PER_BINDER}").cast("bigint").alias("doc"),
        (F.col("page_id") % PAGES_PER_BINDER + 1).cast("bigint").alias("page_no"),
        "page_id",
        "html",
        "url",
    )


def binder_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, page_no, page_id, title, lang, h1, n_paragraphs) by rule from the markup.

    The title is blanked on every third page (page_id % 3 = 2) so that batches
    disagree and the combine step has empty values to skip.
    """
    filled = extract.fill_template(binder_pages(spark, sf_dir), "html", BINDER_RULES)
    return filled.select(
        "doc",
        "page_no",
        "page_id",
        F.when(F.col("page_id") % 3 == 2, F.lit("")).otherwise(F.col("title")).alias("title"),
        "lang",
        "h1",
        extract.count_occurrences(F.col("html"), "<p>").alias("n_paragraphs"),
    )


def flat_batch_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, batch_no, j): one JSON reply per two binder pages, the same keys in every reply.

    j = {"title": first page's title, "lang": last page's lang,
         "h1": first page's h1, "n_paragraphs": sum, "stats": {"pages": n}}.
    """
    return _batches(spark, sf_dir).select(
        "doc",
        "batch_no",
        F.to_json(
            F.struct("title", "lang", "h1", "n_paragraphs", F.struct("pages").alias("stats"))
        ).alias("j"),
    )


def batch_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, batch_no, j): replies with values a parser may change.

    As ``flat_batch_json``, but ``stats`` holds two keys that are not sorted and
    a decimal (``{"pages": n, "mean": paragraphs / 2}``, which may be ``1.0``),
    ``ids`` is an array, and ``part_<batch_no>`` a key of this batch alone.
    """
    g = _batches(spark, sf_dir)
    fixed = F.to_json(F.struct(
        "title", "lang", "h1", "n_paragraphs",
        F.struct("pages", (F.col("n_paragraphs") / F.lit(2.0)).alias("mean")).alias("stats"),
        F.array("first_id", "last_id").alias("ids"),
    ))
    own = F.concat(F.lit(',"part_'), F.col("batch_no").cast("string"), F.lit('":'),
                   F.col("n_paragraphs").cast("string"), F.lit(".50}"))
    return g.select("doc", "batch_no", F.concat(fixed.substr(F.lit(1), F.length(fixed) - 1), own).alias("j"))


# Template of the nested replies: two objects deep, an array of objects and one of strings.
NESTED_TEMPLATE = (
    '{"document":{"title":"","lang":"","author":""},"stats":{"pages":0,"mean":0,"range":{"first":0,"last":0}},'
    '"sheets":[{"id":0,"heading":""}],"notes":[""]}'
)


def nested_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, batch_no, j): nested replies that keep to ``NESTED_TEMPLATE`` in some batches and not in others.

    By ``doc % 4`` the statistics are whole, lack the range and hold a text,
    are "not found" (``""``), or have a key more; every third document names
    an author; the second sheet has no heading; odd batches mix kinds in
    ``notes`` and the third repeats a key and adds an object of its own.
    """
    b = _batches(spark, sf_dir)

    def text(*parts):
        return F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])

    def quoted(name):
        return F.to_json(F.col(name).cast("variant"))

    n, first, last = F.col("pages"), F.col("first_id"), F.col("last_id")
    third = F.col("batch_no") == 3
    author = F.when(F.col("doc") % 3 == 0, F.lit(',"author":"A"')).otherwise(F.lit(""))
    again = F.when(third, F.lit(',"lang":null')).otherwise(F.lit(""))
    span = text('"range":{"first":', first, ',"last":', last)
    stats = (
        F.when(F.col("doc") % 4 == 0, text('{"pages":', n, ',"mean":1.50,', span, "}}"))
        .when(F.col("doc") % 4 == 1, text('{"pages":"', n, '","mean":2}'))
        .when(F.col("doc") % 4 == 2, F.lit('""'))
        .otherwise(text('{"pages":', n, ',"mean":-1e2,', span, ',"step":1}}'))
    )
    notes = F.when(F.col("batch_no") % 2 == 1, F.lit('["a [b]",1,null]')).otherwise(F.lit("[]"))
    own = F.when(third, F.lit(',"extra.1":{"deep":[1,{"x":true}]}')).otherwise(F.lit(""))
    j = text('{"document":{"title":', quoted("title"), ',"lang":', quoted("lang"), author, again, '},"stats":', stats,
             ',"sheets":[{"id":', first, ',"heading":', quoted("h1"), '},{"id":', last, '}],"notes":', notes, own, "}")
    return b.select("doc", "batch_no", j.alias("j"))


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = binder_fields(spark, sf_dir).withColumn(
        "batch_no", (F.expr(f"(page_no - 1) div {PAGES_PER_REPLY}") + 1).cast("bigint")
    )
    return f.groupBy("doc", "batch_no").agg(
        F.min_by("title", "page_no").alias("title"),
        F.max_by("lang", "page_no").alias("lang"),
        F.min_by("h1", "page_no").alias("h1"),
        F.sum("n_paragraphs").alias("n_paragraphs"),
        F.count(F.lit(1)).alias("pages"),
        F.min("page_id").alias("first_id"),
        F.max("page_id").alias("last_id"),
    )


# Template that form pages are filled against.
FORM_TEMPLATE = '{"customer":{"name":"","segment":""},"account":{"balance":0,"nation_key":0},"tags":[""]}'
# Four ways to label a form's values: name, segment, balance, nation, tags.
FORM_LABELS = [
    ("Customer Name", "Segment", "Balance", "Nation key", "Tags"),
    ("customer-name", "Customer segment", "Account Balance", "NationKey", "tag"),
    ("**Name of customer**", "SEGMENT", "account_balance", "Account nation key", "Tags"),
    ("Custmer name", "Segmnt", "Acount balance", "Nation Kee", "Tagss"),
]


def form_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(c_custkey, md): a form per customer, labelled in one of four ways, with lines that belong to no key."""
    c = read_table(spark, sf_dir, "customer", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
                   spread_by="c_custkey")
    style = F.get(F.lit([list(x) for x in FORM_LABELS]), (F.col("c_custkey") % 4).cast("int"))

    def line(k: int, value: Column) -> Column:
        return F.concat(style[k], F.lit(": "), value)

    balance = F.format_number("c_acctbal", 2)
    tags = F.concat(F.col("c_mktsegment"), F.lit("; k"), (F.col("c_custkey") % 7).cast("string"))
    md = F.concat_ws(
        "\n", F.lit("Page 1\nRemark: paid on time"), line(0, F.col("c_name")), F.concat(F.lit("- "), line(1, F.col("c_mktsegment"))),
        F.lit("## Account"), line(2, F.concat(F.lit("EUR "), balance)), F.lit("10:30 sharp"), line(3, F.col("c_nationkey").cast("string")),
        F.lit("### Notes\nFax: 12 34"), line(4, tags))
    return c.select("c_custkey", md.alias("md"))


def dirty_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, r, prompt_tokens, completion_tokens): reply texts in five shapes.

    By event_id % 5: 0 fenced; 1 bare; 2 fenced with text after the fence;
    3 cut before the closing brace; 4 empty.
    """
    ev = read_table(spark, sf_dir, "events", ["event_id", "props", "user_id", "value"], spread_by="event_id")
    props = F.col("props")
    k = F.col("event_id") % 5
    fence = F.lit("```json\n")
    r = (
        F.when(k == 0, F.concat(fence, props, F.lit("\n```")))
        .when(k == 1, props)
        .when(k == 2, F.concat(fence, props, F.lit("\n```\nDone.")))
        .when(k == 3, F.concat(fence, F.expr("substring(props, 1, length(props) - 1)")))
        .otherwise(F.lit(""))
    )
    return ev.select(
        "event_id",
        r.alias("r"),
        (F.length(props) * 10 + F.col("user_id")).cast("bigint").alias("prompt_tokens"),
        F.round(F.col("value") * 100).cast("bigint").alias("completion_tokens"),
    )


def reply_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, reply): chat-completion style envelopes around dirty_replies.

    An empty reply text is sent as an envelope with no choices.
    """
    d = dirty_replies(spark, sf_dir)
    choice = F.struct(F.struct(F.col("r").alias("content")).alias("message"))
    choices = F.when(F.col("r") == "", F.array().cast("array<struct<message:struct<content:string>>>")) \
        .otherwise(F.array(choice))
    usage = F.struct(
        "prompt_tokens",
        "completion_tokens",
        (F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"),
    )
    return d.select("event_id", F.to_json(F.struct(choices.alias("choices"), usage.alias("usage"))).alias("reply"))


def usage_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, model, request_no, prompt_tokens, completion_tokens) from assistant turns.

    request_no numbers a conversation's assistant turns by turn; prompt tokens
    estimate the previous turn's text, completion tokens the reply's text
    (ceil(chars / 4)); model is ``vision`` where turn % 4 = 1, else ``text``.
    """
    conv = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    prev = conv.select(
        "conv_id", (F.col("turn") + 1).alias("turn"), F.length("text").alias("prev_len")
    )
    turns = conv.where(F.col("role") == "assistant").join(prev, ["conv_id", "turn"], "left") \
        .select("conv_id", "turn", "prev_len", F.length("text").alias("text_len"))
    ranked = paging.number_within(turns, ["conv_id"], ["turn"], "request_no")
    return ranked.select(
        F.col("conv_id").alias("doc"),
        F.when(F.col("turn") % 4 == 1, F.lit("vision")).otherwise(F.lit("text")).alias("model"),
        "request_no",
        F.ceil(F.coalesce(F.col("prev_len"), F.lit(0)) / F.lit(4.0)).cast("bigint").alias("prompt_tokens"),
        F.ceil(F.col("text_len") / F.lit(4.0)).cast("bigint").alias("completion_tokens"),
    )


def doc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, processing_seconds, num_pages) per conversation."""
    conv = read_table(spark, sf_dir, "conversations", ["conv_id", "text"])
    return conv.groupBy(F.col("conv_id").alias("doc")).agg(
        (F.sum(F.length("text")) / F.lit(10.0)).alias("processing_seconds"),
        F.count(F.lit(1)).alias("num_pages"),
    )


def image_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, doc, page_no, width, height) of the binder pages as if scanned,
    both sizes following from the length of the page's markup."""
    b = binder_pages(spark, sf_dir)
    return b.select(
        "page_id",
        "doc",
        "page_no",
        (F.lit(600) + (F.length("html") * 37) % 1500).cast("bigint").alias("width"),
        (F.lit(800) + (F.length("html") * 53) % 1700).cast("bigint").alias("height"),
    )


def markdown_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, page_no, md): binder pages turned to markdown by rule."""
    b = binder_pages(spark, sf_dir)
    return b.select("doc", "page_no", extract.html_to_markdown(F.col("html"), F.col("page_no")).alias("md"))
