"""Calling a model on request payloads: ``mapInPandas`` with retry.

The reference posts one request at a time and sleeps 60, 120, 240 s after a
rate-limit reply.  Here the caller's function runs inside Python workers on
Arrow batches; parallelism is the number of partitions (``repartition(n)``
bounds concurrent calls).  A failing request becomes a row with a status and
an error instead of ending the job.

Task retries and recomputation would call the model again; write the replies
(``persist_replies``) before more than one consumer reads them.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the reference's retry rule.
MAX_RETRIES = 3
BASE_DELAY_S = 60.0
BACKOFF_FACTOR = 2

REPLY_COLUMNS = "reply string, status string, attempts int, elapsed double, error string"


class RateLimited(Exception):
    """Raise from the model function for a rate-limit reply (HTTP 429)."""


def call_model(df: DataFrame, fn: Callable[[str], str], payload_col: str = "payload",
               max_retries: int = MAX_RETRIES, base_delay: float = BASE_DELAY_S,
               factor: float = BACKOFF_FACTOR, sleep: Callable[[float], None] = time.sleep,
               partitions: int | None = None, concurrency: int = 1, batch_rows: int | None = None) -> DataFrame:
    """Adds ``reply, status, attempts, elapsed, error`` by calling ``fn(payload)``.

    ``status`` is ``ok``, ``rate_limited`` (all tries hit the limit) or
    ``error`` (any other exception; no retry, as in the reference).
    Calls are I/O bound: ``concurrency`` threads per task send requests of one
    Arrow batch at the same time (replies keep row order), so the number of
    requests in flight is ``partitions x concurrency``.

    A request with ten page images is megabytes; Arrow batches sent to the
    workers are bounded in bytes by ``spark.sql.execution.arrow.maxBytesPerBatch``
    (64 MB by default).  ``batch_rows`` additionally lowers the session's
    ``spark.sql.execution.arrow.maxRecordsPerBatch`` (never raises it), e.g.
    to keep slow model calls in small batches; the setting stays for later
    queries of the session.
    """
    from pyspark.sql.types import StructType

    _ship_by_value()
    if batch_rows:
        conf = df.sparkSession.conf
        current = int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000"))
        if current <= 0 or current > batch_rows:
            conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch_rows))
    in_fields = df.schema
    reply_schema = StructType.fromDDL(REPLY_COLUMNS)
    out_schema = StructType(list(in_fields.fields) + list(reply_schema.fields))

    def one(payload):
        t0 = time.time()
        for attempt in range(1, max_retries + 1):
            try:
                return fn(payload), "ok", attempt, time.time() - t0, None
            except RateLimited as e:
                if attempt == max_retries:
                    return None, "rate_limited", attempt, time.time() - t0, str(e)
                sleep(base_delay * factor ** (attempt - 1))
            except Exception as e:  # noqa: BLE001 - reported as a row
                return None, "error", attempt, time.time() - t0, f"{type(e).__name__}: {e}"
        return None, "error", max_retries, time.time() - t0, "no attempt"

    def run(batches):
        import pandas as pd

        pool = None
        if concurrency > 1:
            from concurrent.futures import ThreadPoolExecutor

            pool = ThreadPoolExecutor(max_workers=concurrency)
        for pdf in batches:
            payloads = list(pdf[payload_col])
            res = list(pool.map(one, payloads)) if pool else [one(p) for p in payloads]
            out = pdf.copy()
            out["reply"] = [r[0] for r in res]
            out["status"] = [r[1] for r in res]
            out["attempts"] = pd.array([r[2] for r in res], dtype="int32")
            out["elapsed"] = [float(r[3]) for r in res]
            out["error"] = [r[4] for r in res]
            yield out
        if pool:
            pool.shutdown()

    src = df.repartition(partitions) if partitions else df
    return src.mapInPandas(run, out_schema)


def _ship_by_value() -> None:
    """Pickle this package's functions by value, so Python workers need not
    have it on their path (only the caller's own modules must be importable)."""
    import sys

    from pyspark import cloudpickle

    pkg = sys.modules[__name__.split(".")[0]]
    try:
        cloudpickle.register_pickle_by_value(pkg)
    except ValueError:
        pass


def persist_replies(df: DataFrame, path: str, mode: str = "overwrite") -> DataFrame:
    """Write replies once and read them back, so later steps never call again."""
    df.write.mode(mode).parquet(path)
    return df.sparkSession.read.parquet(path)


def payload_key(payload_col: str = "payload"):
    """A stable key of a request payload (to match replies to requests)."""
    return F.sha2(F.col(payload_col), 256)


_STORE_SCHEMA = f"request_key string, {REPLY_COLUMNS}, called_at timestamp"


def _read_store(spark, path: str) -> DataFrame | None:
    """The reply store, or None where there is no such folder yet (any other failure is raised)."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(_STORE_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def call_model_cached(df: DataFrame, fn: Callable[[str], str], store_path: str, payload_col: str = "payload",
                      chunks: int = 1, **call_args) -> DataFrame:
    """``call_model`` through a reply store keyed by the payload's hash.

    Only payloads without an ``ok`` reply in ``store_path`` are sent, each
    distinct payload once; new replies are appended to the store (failed
    ones too, for the record; they are sent again next time).  Returns ``df``
    with ``request_key`` and the reply columns, read back from the store.

    The calls run in ``chunks`` jobs, cut by the payload's hash, and each job
    commits its replies.  A job that fails loses its own chunk only: a rerun
    sends nothing of the finished ones.
    """
    spark = df.sparkSession
    req = df.withColumn("request_key", payload_key(payload_col))
    todo = req.select("request_key", payload_col).dropDuplicates(["request_key"])
    for chunk in range(chunks):
        part = todo.where(F.pmod(F.xxhash64("request_key"), F.lit(chunks)) == chunk) if chunks > 1 else todo
        store = _read_store(spark, store_path)
        if store is not None:
            part = part.join(store.where(F.col("status") == "ok").select("request_key"), "request_key", "left_anti")
        new = call_model(part, fn, payload_col, **call_args).drop(payload_col)
        new.withColumn("called_at", F.current_timestamp()).write.mode("append").parquet(store_path)
    return best_replies(req, spark, store_path)


def best_replies(req: DataFrame, spark, store_path: str) -> DataFrame:
    """``req`` with one stored reply per ``request_key``: the ok one if any, else the latest failure."""
    store = _read_store(spark, store_path)
    if store is None:
        store = spark.createDataFrame([], _STORE_SCHEMA)
    best = store.groupBy("request_key").agg(
        F.max_by(F.struct("reply", "status", "attempts", "elapsed", "error"),
                 F.struct((F.col("status") == "ok").alias("ok"), F.col("called_at"), F.col("elapsed"))).alias("_r")
    ).select("request_key", "_r.*")
    return req.join(best, "request_key", "left")
