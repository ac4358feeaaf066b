"""Model calls with retry inside mapInPandas."""

import json

from pagewright.operators import model, replies


def test_retry_then_ok_and_errors(spark):
    calls = {}

    def fn(payload):
        calls[payload] = calls.get(payload, 0) + 1
        if payload.startswith("limit") and calls[payload] < 3:
            raise model.RateLimited("429")
        if payload == "always-limit":
            raise model.RateLimited("429")
        if payload == "boom":
            raise ValueError("bad request")
        return json.dumps({"choices": [{"message": {"content": payload.upper()}}], "usage": {"prompt_tokens": 1, "completion_tokens": 2}})

    slept = []
    df = spark.createDataFrame([("a",), ("limit-1",), ("always-limit",), ("boom",)], "payload string")
    out = model.call_model(df, fn, base_delay=0.0, sleep=slept.append)
    rows = {r.payload: r for r in replies.reply_text(out).collect()}
    assert (rows["a"].status, rows["a"].attempts, rows["a"].content) == ("ok", 1, "A")
    assert (rows["limit-1"].status, rows["limit-1"].attempts) == ("ok", 3)
    assert (rows["always-limit"].status, rows["always-limit"].attempts) == ("rate_limited", 3)
    assert rows["boom"].status == "error" and "bad request" in rows["boom"].error
    assert rows["boom"].content == ""


def test_backoff_delays():
    # the delays the reference waits after rate-limit replies: 60, 120, 240 s
    assert [model.BASE_DELAY_S * model.BACKOFF_FACTOR ** r for r in range(model.MAX_RETRIES)] == [60, 120, 240]


def test_concurrent_calls_keep_order(spark):
    import time as _t

    def fn(payload):
        _t.sleep(0.01 * (int(payload) % 3))
        return json.dumps({"choices": [{"message": {"content": payload}}], "usage": {"prompt_tokens": 1, "completion_tokens": 1}})

    df = spark.createDataFrame([(str(i),) for i in range(60)], "payload string").repartition(2)
    out = replies.reply_text(model.call_model(df, fn, concurrency=8)).collect()
    assert all(r.content == r.payload and r.status == "ok" for r in out) and len(out) == 60


def test_cached_calls_skip_done_requests(spark, tmp_path):
    store = str(tmp_path / "replies")
    acc = spark.sparkContext.accumulator(0)

    def fn(payload):
        acc.add(1)
        if payload == "bad":
            raise ValueError("nope")
        return json.dumps({"choices": [{"message": {"content": payload}}], "usage": {"prompt_tokens": 1, "completion_tokens": 1}})

    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "bad")], "id int, payload string")
    out = {r.id: (r.status, r.reply is not None) for r in model.call_model_cached(df, fn, store).collect()}
    assert out == {1: ("ok", True), 2: ("ok", True), 3: ("ok", True), 4: ("error", False)}
    assert acc.value == 3  # "a" once, "b", "bad"
    more = spark.createDataFrame([(5, "a"), (6, "c"), (7, "bad")], "id int, payload string")
    out2 = {r.id: r.status for r in model.call_model_cached(more, fn, store).collect()}
    assert out2 == {5: "ok", 6: "ok", 7: "error"}
    assert acc.value == 5  # only "c" and the failed "bad" are sent again
