"""Waves of requests under rate limits, with a fake clock."""

import json
import random

import pytest

from pagewright.operators import model, ranking, waves


def test_running_total(spark):
    rng = random.Random(0)
    rows = [(i, rng.choice([0, 1, 7, None, 100])) for i in rng.sample(range(10_000), 900)]
    got = ranking.running_total(spark.createDataFrame(rows, "id int, v int").repartition(6), ["id"], "v", "upto", 5).collect()
    total, want = 0, {}
    for i, v in sorted(rows):
        total += v or 0
        want[i] = total
    assert {r.id: r.upto for r in got} == want and got[0].asDict().keys() == {"id", "v", "upto"}


@pytest.mark.parametrize("tpm,rpm,sizes", [(1000, 7, [1, 50, 300]), (1000, 50, [10, 20]), (500, 3, [500, 1, None]), (10**9, 1, [5])])
def test_no_wave_is_beyond_a_minute(spark, tpm, rpm, sizes):
    rng = random.Random(tpm + rpm)
    rows = [(i, rng.choice(sizes)) for i in range(400)]
    got = waves.plan_waves(spark.createDataFrame(rows, "id int, tokens int").repartition(4), "tokens", ["id"], tpm, rpm).collect()
    assert len(got) == 400
    by_wave = {}
    for r in sorted(got, key=lambda r: r.id):
        by_wave.setdefault(r.wave, []).append(r.tokens or 0)
    assert [r.wave for r in sorted(got, key=lambda r: r.id)] == sorted(r.wave for r in got)
    assert all(sum(t) <= tpm and len(t) <= rpm for t in by_wave.values())
    # Not many more waves than the limits ask for.
    need = max(sum(map(sum, by_wave.values())) / tpm, 400 / rpm)
    largest = max(max((s or 0) / tpm for s in sizes), 1 / rpm)
    if largest <= 0.5:
        assert len(by_wave) <= 2 * need / (1 - largest) + 2


def test_a_request_beyond_a_minute_fails(spark):
    df = spark.createDataFrame([(1, 10), (2, 1001)], "id int, tokens int")
    with pytest.raises(ValueError, match="can't be sent"):
        waves.plan_waves(df, "tokens", ["id"], 1000, 5)


class Clock:
    """Time that only sleeping moves; ``stop_at`` ends the run in that sleep."""

    def __init__(self, stop_at=None):
        self.now, self.slept, self.stop_at = 1000.0, [], stop_at

    def __call__(self):
        return self.now

    def sleep(self, seconds):
        self.slept.append(seconds)
        if self.stop_at == len(self.slept):
            raise KeyboardInterrupt
        self.now += seconds


def replier():
    def reply(content):
        return json.dumps({"choices": [{"message": {"content": content}}], "usage": {"prompt_tokens": 1, "completion_tokens": 1}})

    return reply


def test_limited_replies_enter_a_later_wave(spark, tmp_path):
    sent, seen, reply, limited = spark.sparkContext.accumulator(0), str(tmp_path / "seen"), replier(), model.RateLimited

    def fn(payload):
        import os

        sent.add(1)
        if payload == "bad":
            raise ValueError("nope")
        mark = f"{seen}-{payload}"
        if payload.startswith("limited") and not os.path.exists(mark):
            open(mark, "w").close()
            raise limited("429")
        if payload == "always limited":
            raise limited("429")
        return reply(payload)

    payloads = [f"p{i}" for i in range(7)] + ["limited-a", "limited-b", "always limited", "bad", "p0"]
    df = spark.createDataFrame(list(enumerate(payloads)), "id int, payload string")
    clock = Clock()
    out = waves.call_model_in_waves(df, fn, str(tmp_path / "store"), 10**6, 4, rounds=3, clock=clock, sleep=clock.sleep).collect()
    assert len(out) == 12
    status = {r.payload: r.status for r in out}
    assert status == {p: "ok" for p in payloads} | {"always limited": "rate_limited", "bad": "error"}
    # 11 different payloads in waves of at most 3 or 4, then the three limited ones, then the last one.
    assert sent.value == 11 + 3 + 1 and len(clock.slept) >= 4 and all(s == 60.0 for s in clock.slept)


def test_a_stopped_run_sends_nothing_twice(spark, tmp_path):
    sent, reply = spark.sparkContext.accumulator(0), replier()

    def fn(payload):
        sent.add(1)
        return reply(payload)

    df = spark.createDataFrame([(i, f"p{i}") for i in range(20)], "id int, payload string")
    store = str(tmp_path / "store")
    clock = Clock(stop_at=3)
    with pytest.raises(KeyboardInterrupt):
        waves.call_model_in_waves(df, fn, store, 10**6, 5, clock=clock, sleep=clock.sleep)
    first = sent.value
    assert 0 < first < 20
    clock = Clock()
    out = waves.call_model_in_waves(df, fn, store, 10**6, 5, clock=clock, sleep=clock.sleep).collect()
    assert sent.value == 20 and {r.status for r in out} == {"ok"} and len(out) == 20
    none = waves.call_model_in_waves(df.limit(0), fn, str(tmp_path / "none"), 10**6, 5, clock=clock, sleep=clock.sleep)
    assert none.collect() == [] and sent.value == 20
