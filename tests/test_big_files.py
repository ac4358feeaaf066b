"""Line-split reading, rescans, part offsets, bucketed and indented sinks, long headers, large templates."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from pagewright.functions.imagefn import image_size
from pagewright.operators import paging, replies
from pagewright.plans import flows
from pagewright.sources import files, lines, sinks, snapshot
from pagewright.streaming import folder

TEXTS = {"nl.txt": "\n", "one.txt": "one line", "end.txt": "a\nb\n", "cr.txt": "a\r\nb\rc\n\n", "Report #4 100%+.txt": "x\n" * 31,
         "wide é.txt": "\n".join("é€😀" * (i % 7) for i in range(95))}


def test_pages_of_a_split_file_equal_explode_pages(spark, tmp_path):
    rng = random.Random(3)
    texts = TEXTS | {"long.txt": "\n".join("w" * rng.randrange(60) for _ in range(4000))}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    whole = spark.createDataFrame([(n.rsplit(".", 1)[0], t) for n, t in texts.items()], "doc string, text string")
    want = sorted(map(tuple, paging.explode_pages(whole, "doc", "text", 10).select("doc", "page_no", "num_pages", "text").collect()))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert spark.read.text(str(tmp_path / "long.txt")).rdd.getNumPartitions() > 10
        got = lines.read_line_pages(spark, str(tmp_path)).select("doc", "page_no", "num_pages", "text").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(map(tuple, got)) == want


def test_stream_and_batch_give_one_name(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    names = ["Report #4", "a+b 100%", "50%25 é", "plain"]
    for n in names:
        (src / f"{n}.txt").write_text("x")
    batch = sorted(r.doc for r in files.scan_documents(spark, str(src)).select("doc").collect())
    q = folder.run_incremental(folder.document_stream(spark, str(src)), lambda b: b.select("doc"), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert sorted(r.doc for r in spark.read.parquet(str(tmp_path / "out")).collect()) == batch == sorted(names)


def test_rescan_redoes_changes_and_reports_removals(spark, tmp_path):
    src, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    src.mkdir()

    def flow(df):
        return df.select("path", "doc", F.length("text").alias("n")).where("n > 0")

    def run(**args):
        report = snapshot.run_changes(spark, str(src), flow, out, state, **args)
        kept = {r.doc: r.n for r in snapshot.read_results(spark, out).collect()}
        return {r.doc: r.status for r in report.collect()}, kept

    for n, t in (("a", "1"), ("b", "22"), ("c", "333")):
        (src / f"{n}.txt").write_text(t)
    assert run() == ({"a": "added", "b": "added", "c": "added"}, {"a": 1, "b": 2, "c": 3})
    assert run() == ({}, {"a": 1, "b": 2, "c": 3})
    (src / "a.txt").write_text("1111")
    (src / "c.txt").unlink()
    (src / "d.txt").write_text("4")
    assert run(digest=True) == ({"a": "changed", "c": "removed", "d": "added"}, {"a": 4, "b": 2, "d": 1})
    time.sleep(1.1)
    (src / "a.txt").write_text("1111")  # touched, not changed: both digests are known now
    (src / "b.txt").write_text("")  # an empty file is listed no more
    (src / "d.txt").write_text("none")
    none = snapshot.run_changes(spark, str(src), lambda df: flow(df).where("n < 0"), out, state, digest=True)
    assert {r.doc: r.status for r in none.collect()} == {"b": "removed", "d": "changed"}
    assert {r.doc: r.n for r in snapshot.read_results(spark, out).collect()} == {"a": 4}


def test_parts_put_into_place_by_offset(spark, tmp_path):
    rng = random.Random(1)
    rows = [(d, f"Pages_{p}_to_{p}", "é" * rng.randrange(9) + f"text {p}") for d in ("x", "y", None) for p in range(1, 60 if d == "x" else 4)]
    df = spark.createDataFrame(rows, "doc string, label string, content string").repartition(5)
    whole = {r.doc: r.markdown for r in paging.stitch_pages(df, "doc", "label", "content").collect()}
    parts = paging.part_offsets(paging.stitch_parts(df, "doc", "label", "content"))
    for doc, text in whole.items():
        mine = sorted((r for r in parts.collect() if r.doc == doc), key=lambda r: -r.byte_start)
        buffer = bytearray(len(text.encode()))
        for r in mine:
            assert r.byte_end - r.byte_start == len(r.markdown.encode())
            buffer[r.byte_start:r.byte_end] = r.markdown.encode()
        assert buffer.decode() == text
    out = str(tmp_path / "parts")
    sinks.write_markdown_parts(paging.stitch_parts(df.where("doc is not null"), "doc", "label", "content"), out, buckets=3)
    stored = [json.loads(r.value) for r in spark.read.text(out).collect()]
    for doc in ("x", "y"):
        ordered = sorted((s for s in stored if s["doc"] == doc), key=lambda s: s["byte_start"])
        assert "".join(s["markdown"] for s in ordered) == whole[doc]
        assert [s["part"] for s in ordered] == list(range(1, len(ordered) + 1))


def test_another_number_of_buckets_fails(spark, tmp_path):
    rows = [(f"d{i}", "1", f"# {i}\n") for i in range(20)]
    df = spark.createDataFrame(rows, "doc string, record string, markdown string")
    final, md = str(tmp_path / "f"), str(tmp_path / "m")
    sinks.write_final(df, final, buckets=2)
    sinks.write_markdown(df, md, buckets=2)
    for again in (5, None):
        with pytest.raises(ValueError, match="buckets=2"):
            sinks.write_final(df.limit(3), final, buckets=again)
        with pytest.raises(ValueError, match="buckets=2"):
            sinks.write_markdown(df.limit(3), md, buckets=again)
    sinks.write_markdown(df.where("doc = 'd3'").withColumn("markdown", F.lit("new\n\"q\"")), md, buckets=2)
    stored = {x["doc"]: x["markdown"] for x in (json.loads(r.value) for r in spark.read.text(md).collect())}
    assert len(stored) == 20 and stored["d3"] == 'new\n"q"' and stored["d4"] == "# 4\n"


def test_indented_records(spark, tmp_path):
    texts = ['{"a":{"b":[1,2.50,{"c":[]}],"d":{}},"e":"x, y: {z} \\"q\\" \\\\","f":null}', "[]", '"s"', "3", '[[[{"k":-1e5}]]]',
             json.dumps({f"k{i}": [i, {"v": "é"}] for i in range(400)}, ensure_ascii=False), ' { "a" : [ true , false ] } ']
    df = spark.createDataFrame(list(enumerate(texts)), "doc int, record string")
    got = {r.doc: r.j for r in df.select("doc", sinks.indented_json(F.col("record")).alias("j")).collect()}
    for i, t in enumerate(texts):
        want = json.dumps(json.loads(t, parse_float=str, parse_int=str), indent=4, ensure_ascii=False)
        assert got[i].replace("2.50", '"2.50"') == want or json.loads(got[i]) == json.loads(t)
        assert got[i].count("\n") == want.count("\n")
    assert got[4] == '[\n    [\n        [\n            {\n                "k": -1e5\n            }\n        ]\n    ]\n]'
    sinks.write_final(df, str(tmp_path / "i"), indent=4)
    assert spark.read.text(str(tmp_path / "i"), wholetext=True).where("doc = 0").first().value.startswith('{\n    "a": {\n        "b": [\n            1,\n            2.50,')


def test_a_selection_is_numbered_as_listed(spark):
    rows = [("d", p, 25, f"p{p}") for p in range(8, 14)]
    pages = spark.createDataFrame(rows, "doc string, page_no bigint, num_pages bigint, payload string")
    got = [(r.batch_no, r.start_page, r.end_page, r.num_pages, len(r.pages)) for r in flows.page_batches(pages, 4).orderBy("batch_no").collect()]
    assert got == [(1, 8, 11, 6, 4), (2, 12, 13, 6, 2)]
    with pytest.raises(Exception, match="batch_selection"):
        paging.assign_batches(pages.drop("num_pages"), 4).collect()


def test_a_jpeg_with_very_many_segments(spark):
    frame = b"\xff\xc0\x00\x11\x08\x01\x00\x02\x00\x03" + b"\x00" * 9
    data = b"\xff\xd8" + b"\xff\xe2\x00\x02" * 30_000 + frame + b"\x00" * 500_000
    cut = b"\xff\xd8" + b"\xff\xe2\x00\x02" * 30_000
    df = spark.createDataFrame([(0, data), (1, cut)], "i int, c binary")
    got = {r.i: (r.s.width, r.s.height) for r in df.select("i", image_size("c").alias("s")).collect()}
    assert got == {0: (512, 256), 1: (None, None)}


def test_large_templates_are_flagged(spark):
    df = spark.createDataFrame([(1, "{}"), (2, "x" * 16_381), (3, "x" * 16_380)], "id int, template string")
    assert [(r.id, r.template_tokens) for r in replies.flag_large_templates(df).collect()] == [(2, 4096)]
