"""The pipeline: every stage against a brute-force version, on odd rows too."""

import corpus_pipeline
import __spark_entry__ as entry
from conftest import SF_SMALL
from test_llm_mixing import targets
from test_llm_simhash import slow_components, slow_fingerprint


def test_registered():
    queries = entry.queries()
    assert "pipeline" in queries
    for n in range(1, 11):
        assert len([q for q in queries if q.startswith(f"op{n}_")]) == 1
    assert [s for s, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_near_dedup", "mix_sources", "best_fit_packing"]


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    odd = spark.createDataFrame(
        [(9001, None, "en", "src1", 0), (9002, "123 456", None, "src1", 7), (None, "some words of the text that are here", "en", None, 30),
         (9003, "de la casa", None, None, 10), (9003, "de la casa", None, None, 10)], docs.schema)
    docs.unionByName(odd).repartition(2).write.parquet(str(tmp_path / "in"))
    docs = spark.read.parquet(str(tmp_path / "in"))
    rows = [tuple(r) for r in docs.collect()]
    stages = dict(corpus_pipeline.STAGES)

    def step(name, df):
        out = stages[name](spark, df, SF_SMALL)
        if name != "best_fit_packing":
            assert out.columns == df.columns and out.schema.simpleString() == df.schema.simpleString()
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        return out, [tuple(r) for r in out.collect()]

    df, after = step("language_id", docs)
    gone = sorted(str(r[0]) for r in set(rows) - set(after))
    assert gone == ["9001", "9002"]  # clean documents stay

    before = after
    df, after = step("exact_dedup", df)
    best = {}
    for r in before:
        best.setdefault(r[1], []).append(r[0])
    want = sorted(str((max((i for i in ids if i is not None), default=None), t)) for t, ids in best.items())
    assert sorted(str((r[0], r[1])) for r in after) == want

    before = after
    df, after = step("simhash_near_dedup", df)
    numbered = [(r[0] if r[0] is not None else 10 ** 9, slow_fingerprint(r[1])) for r in before]
    component = slow_components(numbered)
    keep = set(component.values())
    assert sorted(str(r[0]) for r in after) == sorted("None" if i == 10 ** 9 else str(i) for i in keep)

    before = after
    df, after = step("mix_sources", df)
    sizes = {}
    for r in before:
        sizes[r[3]] = sizes.get(r[3], 0) + len(r[1].split())
    goal, taken = targets(sizes), dict.fromkeys(sizes, 0)
    for r in after:
        taken[r[3]] += len(r[1].split())
    largest = max(len(r[1].split()) for r in before)
    assert all(abs(taken[s] - goal[s]) <= 2 * largest for s in sizes)
    assert set(after) <= set(before) and all(after.count(r) <= 2 for r in set(after))

    df, pieces = step("best_fit_packing", df)
    assert sum(r["piece"] == 0 for r in df.collect()) == len(after)


def test_run_writes_between_stages(spark):
    out = corpus_pipeline.run(spark, SF_SMALL)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert out.count() > 100
