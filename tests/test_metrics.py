"""Metrics against the reference's published sample values."""

import pytest
from pyspark.sql import functions as F

from pagewright.functions import textfn
from pagewright.operators import metrics

# Sample log of the reference (document, model, request, prompt, completion).
SAMPLE_LOG = [
    ("convert-me-to-markdown", "GPT-4-Vision Preview", 1, 7053, 2064),
    ("convert-me-to-markdown", "GPT-4-Turbo 1106", 1, 2363, 284),
]
LOG_SCHEMA = "doc string, model string, request_no bigint, prompt_tokens bigint, completion_tokens bigint"


def test_request_and_doc_totals(spark):
    log = spark.createDataFrame(SAMPLE_LOG, LOG_SCHEMA)
    req = {r.model: r.total_tokens for r in metrics.usage_by_request(log).collect()}
    assert req == {"GPT-4-Vision Preview": 9117, "GPT-4-Turbo 1106": 2647}
    roll = metrics.usage_rollup(log)
    assert roll.where("level = 7").first().total_tokens == 11764
    assert roll.where("level = 3").first().total_tokens == 11764


def test_rollup_levels_add_up(spark):
    rows = [(f"d{i % 5}", ["a", "b"][i % 2], i % 3, i * 10, i) for i in range(40)]
    roll = metrics.usage_rollup(spark.createDataFrame(rows, LOG_SCHEMA))
    by_level = {r.level: r.t for r in roll.groupBy("level").agg(F.sum("total_tokens").alias("t")).collect()}
    assert by_level[0] == by_level[1] == by_level[3] == by_level[7]


def test_cost_of_published_report(spark):
    log = spark.createDataFrame([("Sample_Document", "GPT-4-Vision Preview", 1, 37542, 8014)], LOG_SCHEMA)
    r = metrics.usage_by_doc_model(log, metrics.price_table(spark)).select(
        textfn.money("prompt_cost").alias("p"), textfn.money("completion_cost").alias("c"),
        textfn.money("total_cost").alias("t"), "unpriced",
    ).first()
    assert (r.p, r.c, r.t, r.unpriced) == ("$0.38", "$0.24", "$0.62", False)


def test_unknown_model_is_unpriced(spark):
    log = spark.createDataFrame(SAMPLE_LOG, LOG_SCHEMA)
    r = {x.model: x for x in metrics.with_cost(log, metrics.price_table(spark)).collect()}
    assert r["GPT-4-Turbo 1106"].unpriced and r["GPT-4-Turbo 1106"].total_cost is None
    assert not r["GPT-4-Vision Preview"].unpriced


@pytest.mark.parametrize("x", [0.0, 0.125, 0.015, 0.005, 0.375, 0.625, 1.005, 2.675, 0.62, 123.455, 1e-9, 0.994999, 0.995])
def test_money_rounds_like_python(spark, x):
    got = spark.range(1).select(textfn.money(F.lit(x)).alias("m")).first().m
    assert got == "$" + ("%.2f" % x)


def test_zero_tokens_cost_zero(spark):
    log = spark.createDataFrame([("d", "GPT-4-Turbo", 1, 0, 0)], LOG_SCHEMA)
    r = metrics.with_cost(log, metrics.price_table(spark)).first()
    assert r.total_cost == 0.0


@pytest.mark.parametrize("s,text", [(276.9, "4 minutes 36 seconds"), (132.6, "2 minutes 12 seconds"), (0.0, "0 minutes 0 seconds"), (59.99, "0 minutes 59 seconds")])
def test_format_elapsed(spark, s, text):
    assert spark.range(1).select(textfn.format_elapsed(F.lit(s)).alias("e")).first().e == text


def test_image_tokens(spark):
    r = spark.range(1).select(textfn.image_tokens(F.lit(1700), F.lit(2200)).alias("t"), textfn.image_tokens(F.lit(512), F.lit(512)).alias("u")).first()
    assert (r.t, r.u) == (3485, 255)


def test_report_text(spark):
    log = spark.createDataFrame([("Sample_Document", "GPT-4-Vision Preview", 1, 37542, 8014)], LOG_SCHEMA)
    stats = spark.createDataFrame([("Sample_Document", 276.0, 4)], "doc string, processing_seconds double, num_pages bigint")
    text = metrics.usage_report(log, stats, metrics.price_table(spark)).first().text
    assert text.splitlines()[0] == "Sample_Document  (4 pages): 4 minutes 36 seconds"
    assert "Total token usage: 45556 tokens" in text and "Total cost: $0.62" in text
