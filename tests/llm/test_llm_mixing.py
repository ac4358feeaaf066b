"""Mixing: targets, fairness, repeatability, plan."""

import math

from conftest import SF_ORACLE
from pagewright.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, _key int"


def targets(sizes):
    """sizes: source -> words; targets by sharing excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not over:
            out |= {s: level * weight[s] for s in open_}
            break
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def check(rows, got):
    assert len(got) == len(rows)
    sizes = {}
    for _, text, source, *_ in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert math.isclose(r["target"], want[r["source"]], rel_tol=1e-9, abs_tol=1e-9)
        assert r["source_size"] == sizes[r["source"]] and 0 <= r["copies"] <= 2
        taken[r["source"]] += r["size"] * r["copies"]
    largest = max((r["size"] for r in got), default=0)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * largest
    assert sum(taken.values()) <= sum(want.values()) + 1e-6


def sample():
    rows = []
    for i in range(600):
        source = ["b", "a", "c", None, "tiny"][i % 5 if i % 7 else 1]
        rows.append((i, " ".join(["w"] * (i * 37 % 90 if source != "tiny" else 1)), source, "x", i))
    rows += [(1, "same row", "a", "x", 1)] * 40 + [(None, None, "a", "x", 1), (None, "null id", None, "x", 1), (700, "", "empty", "x", 1)]
    return rows


def test_targets_and_fairness(spark, monkeypatch):
    for finish in (65_536, 50):
        monkeypatch.setattr(mixing, "FINISH_SLICE", finish)
        rows = sample()
        df = spark.createDataFrame(rows, SCHEMA)
        got = [r.asDict() for r in mixing.mix(df.repartition(7)).collect()]
        check(rows, got)
        if finish == 65_536:
            first = sorted(map(str, got))
    assert sorted(map(str, got)) == first  # slices and partitions change nothing


def test_rows_come_as_often_as_taken(spark):
    rows = sample()
    df = spark.createDataFrame(rows, SCHEMA)
    out = mixing.mixed_rows(df)
    assert out.columns == df.columns
    got = [tuple(r) for r in out.collect()]
    plan = mixing.mix(df).collect()
    assert len(got) == sum(r["copies"] for r in plan)
    assert sum(len(t[1].split()) for t in got) == sum(r["size"] * r["copies"] for r in plan)
    again = [tuple(r) for r in mixing.mixed_rows(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_no_words_and_no_rows(spark):
    df = spark.createDataFrame([(1, None, "a", "x", 1), (2, " \t", None, "x", 1)], SCHEMA)
    got = mixing.mix(df).collect()
    assert {(r["doc_id"], r["target"], r["copies"]) for r in got} == {(1, 0.0, 0), (2, 0.0, 0)}
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).collect() == []
    assert mixing.mixed_rows(spark.createDataFrame([], SCHEMA)).collect() == []


def test_plan_has_no_python(spark):
    out = mixing.mixed_rows(spark.read.parquet(f"{SF_ORACLE}/documents.parquet"))
    plan = out._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct"))
