"""Requests in waves: rate limits kept ahead of the call instead of run into.

A hosted model takes so many tokens and so many requests a minute.  Requests
are cut into waves that stay below both, by their estimated tokens, and one
wave is sent a minute.  Each wave is one job that commits its replies to the
reply store; a reply that was rate-limited all the same goes into a later wave.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.operators import model
from pagewright.operators.ranking import running_total

MINUTE_S = 60.0
UNIT = 1_000_000_000  # parts of a minute that costs are counted in


def request_tokens(payload: Column | str, completion: int = 0) -> Column:
    """Estimated tokens of a request: a quarter of its characters, and what the reply may take."""
    c = F.col(payload) if isinstance(payload, str) else payload
    return (F.ceil(F.length(c) / F.lit(4.0)) + completion).cast("bigint")


def plan_waves(requests: DataFrame, tokens_col: str, order_cols, tokens_per_minute: int, requests_per_minute: int,
               out: str = "wave") -> DataFrame:
    """Adds ``out``, the wave from 0 on: no wave holds more tokens or requests than a minute takes.

    A request costs the larger share of a minute of the two, in billionths
    rounded up; a wave is a stretch of the running total of costs, shortened by
    the largest single cost so that its last request still fits.  The total is
    a distributed prefix sum: waves of any number of requests need no task that
    holds them.  ``order_cols`` must make the order total.  A request that is
    larger than a minute takes fails the plan; NULL tokens count as 0.
    """
    tokens = F.coalesce(F.col(tokens_col).cast("decimal(38,0)"), F.lit(0))
    share = F.ceil(tokens * UNIT / F.lit(int(tokens_per_minute))).cast("bigint")
    cost = F.greatest(share, F.lit(-(-UNIT // int(requests_per_minute))).cast("bigint"))
    costed = requests.withColumn("_cost", cost)
    most = costed.agg(F.max("_cost")).first()[0] or 0
    if most > UNIT:
        raise ValueError(f"a request takes {most / UNIT:.2f} minutes of the limits; it can't be sent")
    summed = running_total(costed, order_cols, "_cost", "_upto")
    # Every wave spans at most UNIT - most, and one more request; one request alone may fill a minute.
    span = max(UNIT - most, 1)
    wave = F.floor((F.col("_upto") - F.col("_cost")) / F.lit(span)).cast("bigint")
    return summed.select(*requests.columns, wave.alias(out))


def call_model_in_waves(df: DataFrame, fn: Callable[[str], str], store_path: str, tokens_per_minute: int,
                        requests_per_minute: int, payload_col: str = "payload", completion_tokens: int = 0,
                        rounds: int = model.MAX_RETRIES, clock: Callable[[], float] = time.time,
                        sleep: Callable[[float], None] = time.sleep, **call_args) -> DataFrame:
    """``call_model`` under rate limits, through a reply store.

    Distinct payloads without an ``ok`` reply in the store are planned into
    waves.  A wave starts a minute after the one before and is one job: its
    replies are committed before the next, so a run that stops loses one wave
    at most and a rerun sends nothing again that was answered.  What came back
    rate-limited is planned anew behind all others, for up to ``rounds`` rounds;
    a failed request is not sent again in this run.  ``clock`` and ``sleep`` run
    on the driver.  Returns ``df`` with ``request_key`` and the reply columns.
    """
    from pagewright.session import ensure_checkpoint_dir

    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    req = df.withColumn("request_key", model.payload_key(payload_col))
    todo = req.select("request_key", payload_col).dropDuplicates(["request_key"])
    last_start = None
    for turn in range(rounds):
        store = model._read_store(spark, store_path)
        left = todo
        if store is not None:
            left = left.join(store.where(F.col("status") == "ok").select("request_key"), "request_key", "left_anti")
            if turn:  # only what was limited in the round before
                left = left.join(store.where(F.col("status") == "rate_limited").select("request_key").distinct(), "request_key", "left_semi")
        sized = left.withColumn("_tokens", request_tokens(payload_col, completion_tokens))
        planned = plan_waves(sized, "_tokens", ["request_key"], tokens_per_minute, requests_per_minute, "_wave").checkpoint(eager=True)
        waves = planned.agg(F.max("_wave")).first()[0]
        if waves is None:
            break
        for wave in range(waves + 1):
            if last_start is not None and clock() < last_start + MINUTE_S:
                sleep(last_start + MINUTE_S - clock())
            last_start = clock()
            part = planned.where(F.col("_wave") == wave).drop("_wave", "_tokens")
            new = model.call_model(part, fn, payload_col, max_retries=1, **call_args).drop(payload_col)
            new.withColumn("called_at", F.current_timestamp()).write.mode("append").parquet(store_path)
    return model.best_replies(req, spark, store_path)
