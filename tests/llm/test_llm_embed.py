"""The metric join against all pairs."""

import numpy as np
import pytest

from conftest import SF_ORACLE
from pagewright.llm import embed_join

SCHEMA = "vec_id long, embedding array<float>, label int, _ok string"


def brute(rows, threshold=0.93):
    ok = {}
    for k, (i, v, label) in enumerate(rows):
        if label is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[k] = np.array(v, float)
    links = {k: set() for k in range(len(rows))}
    for a in ok:
        for b in ok:
            if a != b and rows[a][2] == rows[b][2] and len(ok[a]) == len(ok[b]):
                x, y = ok[a], ok[b]
                if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= threshold:
                    links[a].add(b)
    out = []
    for k, (i, *_rest) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for n in links[todo.pop()] - seen:
                seen.add(n)
                todo.append(n)
        low = min((rows[s][0] for s in seen if rows[s][0] is not None), default=None)
        out.append((i, len(links[k]), low, low == i))
    return out


def compare(spark, rows, partitions=3):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(partitions)
    got = sorted(map(str, map(tuple, embed_join.near_vectors(df).collect())))
    assert got == sorted(map(str, brute(rows)))


def clustered(n=300, dim=6, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    rows = []
    for i in range(n):
        v = centres[rng.integers(12)] + rng.normal(size=dim) * rng.choice([0.05, 0.2, 0.6])
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(3))))
    return rows


def odd_rows():
    nan, inf = float("nan"), float("inf")
    v = [1.0, 2.0, 0.0]
    return [(1, v, 1), (2, v, 1), (2, v, 1), (3, [2.0, 4.0, 0.0], 1), (4, v, None), (5, None, 1), (6, [0.0, 0.0, 0.0], 1), (7, [nan, 1.0, 1.0], 1),
            (8, [inf, 1.0, 1.0], 1), (9, [1.0, None, 0.0], 1), (10, [], 1), (11, [1.0, 2.0], 1), (None, v, 1), (12, v, 2), (13, [-1.0, -2.0, 0.0], 1)]


def test_all_links_of_a_label(spark):
    compare(spark, clustered() + odd_rows())


def test_pivots_and_blocks_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(embed_join, "CELL", 8)
    monkeypatch.setattr(embed_join, "BLOCK", 7)
    compare(spark, clustered(seed=4) + odd_rows())


def test_table_and_empty_table(spark):
    df = spark.read.parquet(f"{SF_ORACLE}/embeddings.parquet")
    rows = [(r["vec_id"], list(r["embedding"]), r["label"]) for r in df.collect()]
    got = sorted(map(str, map(tuple, embed_join.near_vectors(df).collect())))
    assert got == sorted(map(str, brute(rows)))
    assert embed_join.near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("seed", range(2))
def test_spanning_forest(seed):
    from pagewright.llm.simhash import spanning_forest

    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 200, 150), rng.integers(0, 200, 150)
    x, y = spanning_forest(a, b)

    def parts(p, q):
        root = {int(n): int(n) for n in np.concatenate([a, b])}

        def find(n):
            while root[n] != n:
                n = root[n]
            return n

        for i, j in zip(p.tolist(), q.tolist()):
            i, j = find(i), find(j)
            root[max(i, j)] = min(i, j)
        return {n: find(n) for n in root}

    assert parts(a, b) == parts(x, y) and len(x) <= len(set(np.concatenate([a, b]).tolist()))
