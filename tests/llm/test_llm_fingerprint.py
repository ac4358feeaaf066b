"""Bottom-k fingerprints: against a plain version, and the estimators against true counts."""

import hashlib
import math
import random
import re

from conftest import SF_ORACLE
from pagewright.llm import fingerprint as fp
from pagewright.llm import queries
from pyspark.sql import functions as F


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain(text, k=128):
    return sorted({hashlib.md5(s.encode()).hexdigest()[:16] for s in shingles(text)})[:k]


def like(a, b):
    both = sorted({*a, *b})[:128]
    return len({*a} & {*b} & {*both}) / len(both) if both else 1.0


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    out = []
    for (i, text), (after_id, after) in zip(rows, rows[1:] + rows[:1]):
        text, after = text or "", after or ""
        m = len(text) // 4
        edited = text[:len(text) - m] + after[:m]
        a, b, c = plain(text), plain(edited), plain(after)
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), "".join(a), "".join(b), like(a, b), like(a, c), after_id))
    return sorted(map(str, out))


def sample():
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["a", "b", "wé", "日本語", f"n{rng.randrange(99)}"]) for _ in range(rng.choice([0, 1, 4, 5, 6, 60, 900]))))
            for i in range(1, 120)]
    copy = " ".join(f"c{i}" for i in range(700))
    return rows + [(i, copy) for i in range(200, 260)] + [(300, None), (301, None), (302, "   \t\n"), (303, "one word"), (304, "x  y\tz \n"),
                                                         (-5, "first of all documents, by its id"), (None, "no id at all")]


def run(spark, folder):
    return sorted(str(tuple(r)) for r in queries.QUERIES["op12_fingerprints"](spark, str(folder)).collect())


def test_query_equals_plain_version(spark, tmp_path):
    rows = sample()
    table = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, fingerprint string, _key int")
    table.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    assert run(spark, tmp_path) == expected(rows)


def test_one_row_repeated_rows_and_empty_table(spark, tmp_path):
    for name, rows in (("one", [(3, "a b c d e f g h")]), ("none", []), ("same", [(7, "same text in all rows")] * 50)):
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        assert run(spark, tmp_path / name) == expected(rows)


def test_given_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_ORACLE}/documents.parquet").select("doc_id", "text").collect()]
    assert run(spark, SF_ORACLE) == expected(rows)


def test_blocks_change_nothing(spark):
    df = spark.createDataFrame([(t,) for _, t in sample()], "t string")
    text = F.coalesce("t", F.lit(""))
    for words in (5, 6, 64):
        other = fp.sketch(text, block_words=words)
        assert df.filter(fp.sketch(text) != other).count() == 0


def test_long_texts(spark):
    long = ["w " * 300_000 + " " * 1_000_000 + "q" * 1_000_000, "\n" * 3_000_000, " ".join(map(str, range(100_000)))]
    df = spark.createDataFrame([(t,) for t in long], "t string")
    got = [r.s for r in df.select(fp.sketch(F.col("t")).alias("s")).collect()]
    assert got == [plain(t) for t in long]


def test_estimators(spark):
    rng = random.Random(8)
    rows = []
    for share in (0.0, 0.1, 0.3, 0.5, 0.8, 0.95, 1.0):
        for _ in range(12):
            n = rng.choice([20, 300, 3000])
            one = [f"{rng.random()}" for _ in range(n)]
            cut = round(n * share)
            rows.append((" ".join(one), " ".join(one[:cut] + [f"{rng.random()}" for _ in range(rng.choice([0, n - cut]))])))
    a, b = F.col("a"), F.col("b")
    got = spark.createDataFrame(rows, "x string, y string").select("x", "y", fp.sketch(F.col("x")).alias("a"), fp.sketch(F.col("y")).alias("b")).select(
        "x", "y", fp.resemblance(a, b).alias("r"), fp.containment(a, b).alias("c"), fp.distinct_shingles(a).alias("n")).collect()
    bad = 0
    for g in got:
        x, y = shingles(g.x), shingles(g.y)
        true = len(x & y) / len(x | y)
        bad += abs(g.r - true) > 3 * math.sqrt(true * (1 - true) / 128) + 1e-9
        bad += abs(g.c - len(x & y) / len(x)) > 0.3
        bad += abs(g.n - len(x)) > 0.3 * len(x)
        if len(x | y) < 128:
            assert g.r == true and math.isclose(g.c, len(x & y) / len(x)) and g.n == len(x)
    assert bad <= 4


def test_sketches_merge(spark):
    parts = [("a", " ".join(f"w{i % 97}-{i}" for i in range(k, k + 300))) for k in range(0, 3000, 300)] + [("b", ""), (None, "x y z")]
    df = spark.createDataFrame(parts, "g string, t string").select("g", fp.sketch(F.col("t")).alias("s"))
    got = {r.g: r.sketch for r in fp.merge_fingerprints(df, "g", "s").collect()}
    want = sorted({h for g, t in parts if g == "a" for h in plain(t, 10**9)})[:128]
    assert got == {"a": want, "b": [], None: plain("x y z")}


def test_main_path_is_native(spark):
    plan = fp.fingerprint_edits(spark.read.parquet(f"{SF_ORACLE}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_texts_are_shuffled_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = queries.QUERIES["op12_fingerprints"](spark, SF_ORACLE)
        out.collect()
        final = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert final.count("ReusedExchange") == 1 and final.count("documents.parquet") == 1
