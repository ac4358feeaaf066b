"""Model replies: text, usage, cleaning, validity and reject rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions.jsonfn import clean_json, compute_once, is_valid_json
from pagewright.functions.textfn import text_tokens

# Shape of a chat-completion reply (the fields the reference reads).
REPLY_SCHEMA = (
    "struct<choices:array<struct<message:struct<content:string>>>,"
    "usage:struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint>>"
)
# Fixed value: the completion limit of a vision request.
MAX_COMPLETION_TOKENS = 4096


def _parsed(reply_col: str):
    return F.from_json(F.col(reply_col), REPLY_SCHEMA)


def reply_fields(df: DataFrame, reply_col: str = "reply") -> DataFrame:
    """Content and usage of each reply, parsing the reply JSON once.

    Adds ``content`` (``""`` without choices), ``prompt_tokens``,
    ``completion_tokens`` and ``total_tokens``.
    """
    p = compute_once(df, _reply=_parsed(reply_col))
    u = F.col("_reply.usage")
    return p.select(
        *df.columns,
        F.coalesce(F.get(F.col("_reply.choices"), 0)["message"]["content"], F.lit("")).alias("content"),
        u["prompt_tokens"].alias("prompt_tokens"),
        u["completion_tokens"].alias("completion_tokens"),
        (u["prompt_tokens"] + u["completion_tokens"]).alias("total_tokens"),
    )


def reply_text(df: DataFrame, reply_col: str = "reply", out: str = "content") -> DataFrame:
    """``choices[0].message.content``; ``""`` when there is no choice."""
    p = _parsed(reply_col)
    return compute_once(df, **{out: F.coalesce(F.get(p["choices"], 0)["message"]["content"], F.lit(""))})


def reply_usage(df: DataFrame, reply_col: str = "reply") -> DataFrame:
    """Adds ``prompt_tokens`` and ``completion_tokens`` (and their sum) from ``usage``."""
    u = _parsed(reply_col)["usage"]
    return df.withColumn("prompt_tokens", u["prompt_tokens"]).withColumn(
        "completion_tokens", u["completion_tokens"]
    ).withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))


def parse_reply_json(df: DataFrame, text_col: str = "content", strict: bool = False,
                     out: str = "json") -> DataFrame:
    """Clean a reply's text and test it: adds ``out`` (cleaned text) and ``valid``."""
    with_clean = compute_once(df, **{out: clean_json(F.col(text_col), strict)})
    return compute_once(with_clean, valid=is_valid_json(F.col(out)))


def split_valid(df: DataFrame, valid_col: str = "valid") -> tuple[DataFrame, DataFrame]:
    """(good, rejects): a bad reply becomes a reject row instead of ending the job."""
    return df.where(F.col(valid_col)), df.where(~F.col(valid_col))


def flag_truncated(df: DataFrame, completion_col: str = "completion_tokens", valid_col: str = "valid",
                   cap: int = MAX_COMPLETION_TOKENS) -> DataFrame:
    """Replies that hit the completion cap or do not parse (likely cut off).

    Adds ``reason``: ``cap`` when the cap was reached, else ``unparsed``.
    """
    at_cap = F.col(completion_col) >= F.lit(cap)
    flagged = df.where(at_cap | ~F.col(valid_col))
    return flagged.withColumn("reason", F.when(at_cap, F.lit("cap")).otherwise(F.lit("unparsed")))


def flag_large_templates(df: DataFrame, template_col: str = "template", cap: int = MAX_COMPLETION_TOKENS) -> DataFrame:
    """Templates whose filled form may not fit a reply: estimated tokens at or above the completion cap.

    The reply repeats the template, so its size bounds the reply's from below.
    Adds ``template_tokens``.
    """
    sized = df.withColumn("template_tokens", text_tokens(template_col))
    return sized.where(F.col("template_tokens") >= F.lit(cap))
