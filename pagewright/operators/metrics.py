"""Token, cost and time metrics over a usage log and per-document stats.

``usage_log``: ``(doc, model, request_no, prompt_tokens, completion_tokens)``,
one row per model call.  ``doc_stats``: ``(doc, processing_seconds,
num_pages)``.  ``prices``: ``(model, prompt_per_1k, completion_per_1k)``.
All reports are aggregations with map-side partial combine; the price list is
a dimension joined by broadcast only after its size is checked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions.textfn import format_elapsed, money, token_cost

# Fixed values from the reference's price list: USD per 1,000 tokens.
REFERENCE_PRICES = [
    ("GPT-4-Vision Preview", 0.01, 0.03),
    ("GPT-4-Turbo", 0.01, 0.03),
]


def price_table(spark: SparkSession, rows=None) -> DataFrame:
    """A price list DataFrame (defaults to the reference's two models)."""
    return spark.createDataFrame(
        list(rows if rows is not None else REFERENCE_PRICES),
        "model string, prompt_per_1k double, completion_per_1k double",
    )


def _price_side(prices: DataFrame) -> DataFrame:
    """One row per model; two different prices for a model are an error, repeats of one are not.

    AQE broadcasts the list by its measured size.
    """
    rate = F.struct("prompt_per_1k", "completion_per_1k")
    p = prices.groupBy("model").agg(F.min(rate).alias("_low"), F.max(rate).alias("_high"))
    clash = F.raise_error(F.concat(F.lit("two prices for model "), F.col("model")))
    one = F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(clash.cast("struct<prompt_per_1k:double,completion_per_1k:double>"))
    return p.select("model", one.alias("_p")).select("model", "_p.prompt_per_1k", "_p.completion_per_1k")


def with_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Left join usage to prices by model; adds costs and ``unpriced``.

    A model missing from the list gives NULL costs and ``unpriced = true``
    (the reference stops with a key error).  Costs are unrounded.
    """
    j = usage.join(_price_side(prices), "model", "left")
    return (
        j.withColumn("unpriced", F.col("prompt_per_1k").isNull())
        .withColumn("prompt_cost", token_cost("prompt_tokens", "prompt_per_1k"))
        .withColumn("completion_cost", token_cost("completion_tokens", "completion_per_1k"))
        .withColumn("total_cost", F.col("prompt_cost") + F.col("completion_cost"))
        .drop("prompt_per_1k", "completion_per_1k")
    )


def _token_sums():
    return [
        F.sum("prompt_tokens").cast("bigint").alias("prompt_tokens"),
        F.sum("completion_tokens").cast("bigint").alias("completion_tokens"),
        (F.sum("prompt_tokens") + F.sum("completion_tokens")).cast("bigint").alias("total_tokens"),
    ]


def usage_by_request(log: DataFrame) -> DataFrame:
    """Tokens per (doc, model, request); repeated requests add up."""
    return log.groupBy("doc", "model", "request_no").agg(*_token_sums())


def usage_by_model(log: DataFrame) -> DataFrame:
    """Running totals per model over all documents (the reference's summary)."""
    return log.groupBy("model").agg(*_token_sums(), F.count(F.lit(1)).alias("n_requests"))


def usage_rollup(log: DataFrame) -> DataFrame:
    """Per document, model and request, with subtotals and the grand total.

    ``level`` is ``grouping_id()``: 0 request rows, 1 model subtotal, 3
    document total, 7 grand total.
    """
    return log.rollup("doc", "model", "request_no").agg(
        *_token_sums(), F.grouping_id().cast("bigint").alias("level")
    )


def usage_by_doc_model(log: DataFrame, prices: DataFrame) -> DataFrame:
    """Tokens and costs per (doc, model); the join runs after the aggregation,
    so it sees one row per (doc, model), not one per request."""
    agg = log.groupBy("doc", "model").agg(*_token_sums())
    return with_cost(agg, prices)


def doc_report(usage: DataFrame, stats: DataFrame) -> DataFrame:
    """Document stats next to their token totals: left join on ``doc``."""
    totals = usage.groupBy("doc").agg(*_token_sums())
    return stats.join(totals, "doc", "left").withColumn("elapsed", format_elapsed("processing_seconds"))


def usage_report(log: DataFrame, stats: DataFrame, prices: DataFrame) -> DataFrame:
    """Report lines per document and model, as the reference prints them.

    One row per (doc, model) with a ``text`` block: file line with pages and
    time, tokens, and costs (``n/a`` when unpriced).
    """
    per = usage_by_doc_model(log, prices).join(stats, "doc", "left")

    def cost(c):
        return F.coalesce(money(c), F.lit("n/a"))

    # Labels and indents of the report's lines.
    text = F.concat_ws(
        "\n",
        F.concat(
            F.col("doc").cast("string"), F.lit("  ("), F.coalesce(F.col("num_pages"), F.lit(0)).cast("string"),
            F.lit(" pages): "), F.coalesce(format_elapsed("processing_seconds"), F.lit("n/a")),
        ),
        F.concat(F.lit("      Model: "), F.col("model")),
        F.concat(F.lit("          Total prompt tokens: "), F.col("prompt_tokens").cast("string")),
        F.concat(F.lit("          Total completion tokens: "), F.col("completion_tokens").cast("string")),
        F.concat(F.lit("          Total token usage: "), F.col("total_tokens").cast("string"), F.lit(" tokens")),
        F.concat(F.lit("          Prompt token cost: "), cost(F.col("prompt_cost"))),
        F.concat(F.lit("          Completion token cost: "), cost(F.col("completion_cost"))),
        F.concat(F.lit("          Total cost: "), cost(F.col("total_cost"))),
    )
    return per.select("doc", "model", text.alias("text"))
