"""Importance resampling against a plain version of its definition."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

from conftest import SF_ORACLE
from pagewright.llm import queries, resample

LOWER = {c: c + 32 for c in range(65, 91)}


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    runs = [" ".join(words[i:i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]
    return len(words), [zlib.crc32(r.encode()) % 10_000 for r in runs]


def plain(rows, target):
    found = [features(t) for _, t in rows]
    s = Counter(b for _, f in found for b in f)
    t = Counter(b for x in target for b in features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000)))) for b in range(10_000)]
    out = []
    for (i, _), (n, f) in zip(rows, found):
        weight = sum(gain[b] for b in f)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    drawn = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(drawn[:5 * len(drawn) // 100]):
        r[4] = k + 1
    return sorted(str(tuple(r[:5])) for r in out)


def sample(n=700):
    rng = random.Random(3)
    words = ["the", "The", "Über", "naïve", "x1", "don't", "a-b", "日本", "z" * 300, "É", "\x00", "ok", "A" * 40]
    rows = [(i, " ".join(rng.choice(words) + rng.choice(["", "", ".", "  ", "\n"]) for _ in range(rng.randrange(0, 90)))) for i in range(n)]
    return rows + [(None, None), (None, "one two three " * 9), (10_000, ""), (10_001, "--- !!"), (10_002, "q" * 5000 + " " + "r s t " * 30)]


def write(spark, folder, rows, target):
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, weight string, rank int")
    docs.repartition(5).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(str(i), t) for i, t in enumerate(target)], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")


def run(spark, folder):
    return sorted(str(tuple(r)) for r in queries.QUERIES["op13_resampling"](spark, str(folder)).collect())


def test_query_equals_plain_version(spark, tmp_path, monkeypatch):
    rows = sample()
    target = ["Über the naïve 日本 x1 ok", None, "", "the the the"] * 3
    write(spark, tmp_path, rows, target)
    want = plain(rows, target)
    assert run(spark, tmp_path) == want
    # Small slices and groups, words hashed one by one: nothing changes.
    monkeypatch.setattr(resample, "SLICE", 7)
    monkeypatch.setattr(resample, "LONG_WORD", 4)
    monkeypatch.setattr(resample, "TEXT_BYTES", 50)
    monkeypatch.setattr(resample, "PIVOTS", 2)
    assert run(spark, tmp_path) == want


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF_ORACLE}/documents.parquet").select("doc_id", "text").collect()
    target = [r.text for r in spark.read.parquet(f"{SF_ORACLE}/benchmark.parquet").collect()]
    assert run(spark, SF_ORACLE) == plain([tuple(r) for r in docs], target)


def test_repeated_rows_and_ties(spark, tmp_path):
    # Two thirds of the rows are one row: equal scores and ids, ranks stay gapless.
    rows = [(5, "same words here " * 10)] * 400 + [(i, f"other word{i} " * 12) for i in range(100, 300)] + [(None, "same words here " * 10)] * 5
    write(spark, tmp_path, rows, ["same words here"])
    got = queries.QUERIES["op13_resampling"](spark, str(tmp_path)).collect()
    assert len(got) == 605
    ranks = sorted(r["rank"] for r in got if r["rank"] is not None)
    assert ranks == list(range(1, 31))
    by_rank = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r.score for r in by_rank] == sorted((r.score for r in got), reverse=True)[:30]


def test_empty_tables(spark, tmp_path):
    write(spark, tmp_path, [], [])
    out = queries.QUERIES["op13_resampling"](spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"] and out.collect() == []
    write(spark, tmp_path / "b", [(1, "a b"), (2, None)], [])
    assert run(spark, tmp_path / "b") == plain([(1, "a b"), (2, None)], [])


def test_kth_key_everywhere(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(5), False, rng.randrange(4), f"r{i:03d}") for i in range(60)] + [(2, True, None, "n1"), (2, True, None, "n2")]
    table = spark.createDataFrame(rows, "_k1 long, _k2 boolean, _k3 long, _k4 string")
    want = sorted(rows, key=lambda r: (r[0], r[1], r[2] or 0, r[3]))
    for k in (1, 2, 17, 30, 31, 61, 62):
        assert tuple(resample.kth_key(table, k)) == want[k - 1]
