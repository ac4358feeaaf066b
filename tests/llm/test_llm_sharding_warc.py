"""Sharding laws and WARC round trips."""

import zlib
from collections import Counter

from conftest import SF_ORACLE
from pagewright.llm import sharding, warc


def test_growth_moves_rows_only_into_the_new_shard(spark):
    docs = spark.read.parquet(f"{SF_ORACLE}/documents.parquet")
    got = sharding.assign_shards(docs, [1.0] * 40, [1.0] * 41).collect()
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(got) == len(text)
    for r in got:
        raw = text[r["doc_id"]].encode()
        assert r["size"] == len(raw) + 16 and r["text_crc32"] == zlib.crc32(raw)
        assert r["grown_shard"] in (r["shard"], 40)
    slots = Counter(r["shard"] for r in got)
    assert len(slots) == 40 and max(slots.values()) < 3 * min(slots.values())
    assert {(r["shard"], r["slot"]) for r in got} == {(s, i) for s, n in slots.items() for i in range(n)}


def test_weights(spark):
    df = spark.range(20_000).selectExpr("id as doc_id", "'t' as text")
    n = Counter(r["shard"] for r in sharding.assign_shards(df, [3.0, 1.0, 0.0, 2.0]).collect())
    assert 2 not in n and abs(n[0] - 10_000) < 400 and abs(n[3] - 6_667) < 400


def test_null_and_repeated_keys(spark, tmp_path):
    schema = "doc_id long, text string, shard string, _shard string"
    df = spark.createDataFrame([(None, None, "a", "b"), (None, "x", "a", "b"), (4, "x", "a", "b"), (4, "x", "a", "b")], schema)
    got = sharding.assign_shards(df, [1.0] * 5).collect()
    assert len({r["shard"] for r in got if r["doc_id"] == 4}) == 1 and len({r["shard"] for r in got if r["doc_id"] is None}) == 1
    assert len({(r["shard"], r["slot"]) for r in got}) == 4 and {r["grown_shard"] for r in got} == {None}
    assert sharding.assign_shards(spark.createDataFrame([], schema), [1.0]).collect() == []
    sharding.write_shards(df.drop("_shard"), str(tmp_path / "s"), [1.0] * 5, files_per_shard=2)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 4


PAGES = "page_id long, url string, html string, payload string, _key string"


def test_round_trip(spark, tmp_path):
    big, multi = "é" * 60, "<p>\r\nWARC/1.1\r\n\r\n" + "x" * 200
    data = [(3, "u", big), (1, "u v", big), (1, None, big), (7, "u", "short"), (8, "u", "short"), (9, "u", None), (10, "u", ""),
            (11, "u", multi), (None, "u", multi), (12, "u", multi), (13, "u", "a" * 100), (14, "u", "a" * 100), (15, "u", "a" * 99), (16, "u", "a" * 99)]
    df = spark.createDataFrame([(*r, "p", "k") for r in data], PAGES).repartition(3)
    manifest = warc.write_archives(warc.mark_revisits(df), str(tmp_path / "w"), roll_bytes=300)
    assert sum(r["records"] for r in manifest.collect()) == len(data) and manifest.count() > 3
    got = warc.resolve_revisits(warc.read_headers(manifest)).collect()
    import hashlib

    want = Counter()
    for i, _, h in data:
        raw = (h or "").encode()
        want[(str(i) if i is not None else None, len(raw), hashlib.sha256(raw).hexdigest())] += 1
    assert Counter((r["record_id"], r["payload_bytes"], r["payload_digest"]) for r in got) == want
    kinds = Counter((r["record_id"], r["record_type"], r["refers_to"]) for r in got)
    assert kinds[("1", "response", None)] == 1 and kinds[("1", "revisit", "1")] == 1 and kinds[("3", "revisit", "1")] == 1
    assert kinds[("11", "response", None)] == 1 and kinds[("12", "revisit", "11")] == 1 and kinds[(None, "revisit", "11")] == 1
    assert kinds[("14", "revisit", "13")] == 1 and kinds[("16", "response", None)] == 1 and kinds[("8", "response", None)] == 1


def test_no_pages(spark):
    manifest = warc.write_archives(warc.mark_revisits(spark.createDataFrame([], PAGES)))
    assert warc.resolve_revisits(warc.read_headers(manifest)).collect() == []
