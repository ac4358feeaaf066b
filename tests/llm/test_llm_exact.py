"""Exact deduplication against grouping by text."""

import pytest

from pagewright.llm import exact_dedup
from pagewright.llm.exact_dedup import drop_exact_copies, exact_groups

SCHEMA = "doc_id long, text string, _row string, kept int, _text string"


def rows():
    long = "x" * 20_000
    texts = [
        "", None, "a", "a", "a" * 31, "a" * 32, "a" * 33, "a" * 32, "a" * 288, "a" * 289, "a" * 288, "b" * 256, "b" * 257, "b" * 256, long, long, long + "y", long[:-1],
        "é" * 16, "é" * 16, "é" * 15 + "e", "A", "a\x00", "a", "\x00", "\x00", long + "y", "bb", "bb",
    ]
    out = [(i, t, "r", i, None) for i, t in enumerate(texts)]
    out += [(7, "bb", "again", 1, "t"), (28, "bb", "tie", 1, "t"), (None, "null id", "r", 1, None), (None, "only null", "r", 1, None),
            (None, "only null", "r", 2, None), (99, "null id", "r", 1, None)]
    return out


@pytest.mark.parametrize("first", [1, 256])
def test_groups_match_grouping_by_text(spark, monkeypatch, first):
    monkeypatch.setattr(exact_dedup, "FIRST_DIGIT", first)
    data = rows()
    got = exact_groups(spark.createDataFrame(data, SCHEMA).repartition(5)).collect()
    assert len(got) == len(data)
    import hashlib

    by = {}
    for i, t, *_ in data:
        by.setdefault(hashlib.sha256((t or "").encode()).hexdigest(), []).append(i)
    for sha, ids in by.items():
        mine = [r for r in got if r["text_sha256"] == sha]
        assert sorted(str(r["doc_id"]) for r in mine) == sorted(map(str, ids))
        keep = max((i for i in ids if i is not None), default=None)
        assert {r["keep_id"] for r in mine} == {keep} and {r["group_size"] for r in mine} == {len(ids)}
        assert [r["doc_id"] for r in mine if r["kept"]] == [keep]  # one stays, ties included


def test_rows_that_stay_keep_their_columns(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    got = drop_exact_copies(df)
    assert got.columns == df.columns
    kept = [tuple(r) for r in got.collect()]
    assert len(kept) == len({t or "" for _, t, *_ in data})
    assert set(kept) <= set(data)


def test_empty_table(spark):
    assert exact_groups(spark.createDataFrame([], SCHEMA)).collect() == []
    assert drop_exact_copies(spark.createDataFrame([], SCHEMA)).collect() == []
