"""Token-budget batching equals the greedy rule for any segment length."""

import random

import pytest

from pagewright.operators import budget


def py_greedy(tokens, max_tokens, max_pages):
    out, b, used, cnt = [], 0, 0, 0
    for t in tokens:
        if cnt == 0 or used + t > max_tokens or cnt >= max_pages:
            b, used, cnt = b + 1, t, 1
        else:
            used, cnt = used + t, cnt + 1
        out.append(b)
    return out


@pytest.mark.parametrize("segment", [128, 3])
def test_budget_matches_greedy(spark, monkeypatch, segment):
    monkeypatch.setattr(budget, "SEGMENT", segment)
    rnd = random.Random(11)
    rows, expected = [], {}
    for d in range(25):
        n = rnd.choice([1, 2, 9, 10, 11, rnd.randint(1, 90)])
        toks = [rnd.choice([50, 300, 900, 1500, 5000]) for _ in range(n)]
        for i, t in enumerate(toks):
            rows.append((d, i + 1, t))
        for i, b in enumerate(py_greedy(toks, 2000, 4)):
            expected[(d, i + 1)] = b
    df = spark.createDataFrame(rows, "doc int, page_no bigint, tokens bigint")
    got = budget.budget_batches(df, 2000, 4).collect()
    assert {(r.doc, r.page_no): r.batch_no for r in got} == expected


def test_single_page_above_budget_is_its_own_batch(spark):
    df = spark.createDataFrame([(1, 1, 10), (1, 2, 9999), (1, 3, 10)], "doc int, page_no bigint, tokens bigint")
    got = sorted((r.page_no, r.batch_no) for r in budget.budget_batches(df, 100, 10).collect())
    assert got == [(1, 1), (2, 2), (3, 3)]


@pytest.mark.parametrize("segment", [128, 2])
def test_selected_pages_null_tokens_and_null_document(spark, monkeypatch, segment):
    monkeypatch.setattr(budget, "SEGMENT", segment)
    rows = [(1, p, 5000, 400) for p in range(43, 48)] + [(None, p, 7, 900) for p in (2, 5, 9)] + [(3, p, 4, None) for p in range(1, 5)]
    df = spark.createDataFrame(rows, "doc int, page_no bigint, num_pages bigint, tokens bigint")
    got = {(r.doc, r.page_no): (r.tokens, r.batch_no) for r in budget.budget_batches(df, 1000, 3).collect()}
    assert len(got) == len(rows)
    assert [got[(1, p)][1] for p in range(43, 48)] == [1, 1, 2, 2, 3]
    assert [got[(None, p)][1] for p in (2, 5, 9)] == [1, 2, 3]
    assert [got[(3, p)] for p in range(1, 5)] == [(None, 1), (None, 1), (None, 1), (None, 2)]


@pytest.mark.parametrize("segment,fan", [(3, 2), (5, 3), (128, 2)])
def test_tree_of_tables_equals_greedy(spark, monkeypatch, segment, fan):
    """Several levels of composed tables, one document far longer than the rest, gaps in the numbers."""
    monkeypatch.setattr(budget, "SEGMENT", segment)
    monkeypatch.setattr(budget, "FAN", fan)
    rnd = random.Random(5)
    rows, expected = [], {}
    for d, n in ((1, 700), (2, 1), (None, 130), (4, 37)):
        pages = sorted(rnd.sample(range(10_000), n))
        toks = [rnd.choice([0, 50, 300, 900, 1500, 5000]) for _ in range(n)]
        rows += [(d, p, t) for p, t in zip(pages, toks)]
        expected |= {(d, p): b for p, b in zip(pages, py_greedy(toks, 2000, 7))}
    df = spark.createDataFrame(rows, "doc int, page_no bigint, tokens bigint").repartition(5)
    got = budget.budget_batches(df, 2000, 7).collect()
    assert {(r.doc, r.page_no): r.batch_no for r in got} == expected
    assert budget.budget_batches(df.limit(0), 2000, 7).collect() == []
