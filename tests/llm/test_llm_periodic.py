"""Periodic runs against a brute-force search by definition."""

import hashlib
import random
import zlib
from fractions import Fraction

from conftest import SF_SMALL
from pagewright.llm import periodic, queries


def brute(words):
    """All runs, by the definition: every period, every stretch; smallest periods only."""
    n, found = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            piece = words[start:i + q]
            if len(piece) >= max(24, 3 * q) and not any(
                    all(piece[k] == piece[k + d] for k in range(len(piece) - d)) for d in range(1, q)):
                found.append((start, len(piece), q))
    return sorted(found)


def random_texts(seed, count=60):
    rng = random.Random(seed)
    for _ in range(count):
        words = []
        while len(words) < rng.randrange(0, 400):
            base = [rng.choice("abcde") if rng.random() < 0.7 else f"w{rng.randrange(1000)}" for _ in range(rng.randrange(1, 60))]
            times = rng.choice([1, 1, 2, 3, 4, 9])
            words += base * times + base[:rng.randrange(0, len(base) + 1)]
        yield [w.encode() for w in words]


def test_runs_equal_brute_force():
    for seed in range(4):
        texts = list(random_texts(seed))
        got = periodic.find_runs(texts)
        assert got == [brute(t) for t in texts]
        assert sum(map(len, got)) > 20
        # The scales alone find what the direct scans find.
        assert periodic.find_runs(texts, lag=4) == got


def test_structured_words():
    fib = [b"a"], [b"a", b"b"]
    while len(fib[1]) < 700:
        fib = fib[1], fib[1] + fib[0]
    thue = [bytes([97 + bin(i).count("1") % 2]) for i in range(600)]
    nested = ([b"x"] * 30 + [b"y"]) * 5 + [b"z"]
    same = [b"s"] * 500
    texts = [fib[1], thue, nested, same, [], [b"one"], thue * 4]
    assert periodic.find_runs(texts) == [brute(t) for t in texts]
    assert periodic.find_runs([same]) == [[(0, 500, 1)]]


def test_long_text_is_fast_and_right():
    rng = random.Random(5)
    base = [str(rng.randrange(10**6)).encode() for _ in range(50_000)]
    words = base * 4 + [b"end"] + [b"a", b"b"] * 100_000
    assert periodic.find_runs([words]) == [[(0, 200_000, 50_000), (200_001, 200_000, 2)]]


def expected(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    return (
        len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2],
        digest("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()),
        digest(b" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


COLUMNS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_equals_brute_force(spark, tmp_path):
    rows = [(i, " ".join(w.decode() for w in words)) for i, words in enumerate(random_texts(9, 150))]
    rows += [(None, "x " * 40), (None, None), (7, ""), (500, " \t\n\x0b\f\r "), (501, "é" * 5 + " ü" * 30), (501, "é" * 5 + " ü" * 30),
             (502, "a b " * 30 + "\x1c" * 3)]
    table = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, runs string, collapsed int")
    table.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), *map(str, (r[c] for c in COLUMNS))) for r in got) == sorted(
        (str(i), *map(str, expected(i, t))) for i, t in rows)


def test_given_documents(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    got = queries.QUERIES["op11_periodic_runs"](spark, SF_SMALL).collect()
    assert len(got) == len(docs)
    short = [r for r in got if len((docs[r.doc_id] or "").split()) <= 300]
    assert len(short) > 50
    for r in short:
        assert tuple(r[c] for c in COLUMNS) == expected(r.doc_id, docs[r.doc_id])


def test_operator_keeps_real_outputs(spark):
    df = spark.createDataFrame([(1, "go " * 30 + "on"), (2, None)], "id int, body string")
    got = {r.id: r for r in periodic.periodic_runs(df, "id", "body").collect()}
    assert got[1].collapsed == "go on" and got[1].n_words == 31 and tuple(got[1].best) == (0, 30, 1)
    assert got[2].runs == [] and got[2].best is None and got[2].collapsed == ""
    assert periodic.periodic_runs(df.limit(0), "id", "body").collect() == []
