"""Nothing is dropped or changed silently: ranks, requests, headers, names, prices, sinks."""

import time

import pytest
from pyspark.sql import functions as F

from pagewright.functions.imagefn import image_size
from pagewright.functions.textfn import file_stem, natural_key
from pagewright.operators import metrics, paging, requests
from pagewright.operators.ranking import rank_within
from pagewright.sources import files, sinks


def test_null_groups_are_ranked(spark):
    df = spark.createDataFrame([(None, 3), (None, 1), (1, 5), (None, 2)], "g int, v int")
    assert sorted((str(r.g), r.v, r["rank"]) for r in rank_within(df, ["g"], ["v"], num_partitions=3).collect()) == [
        ("1", 5, 1), ("None", 1, 1), ("None", 2, 2), ("None", 3, 3)]


def test_explode_pages_is_linear(spark):
    def seconds(lines):
        df = spark.range(1).select(F.lit(1).alias("doc"), F.expr(f"array_join(transform(sequence(1, {lines}), x -> 'line ' || x), '\\n')").alias("text"))
        start = time.perf_counter()
        assert paging.explode_pages(df, "doc", "text", 10).where(F.length("text") > 0).count() == lines // 10
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(80_000) < 8 * max(seconds(20_000), 0.5)


def test_a_request_never_loses_pages(spark):
    df = spark.createDataFrame([(1, [(i, f"p{i}") for i in range(12)])], "doc int, pages array<struct<page_no:int,payload:string>>")
    with pytest.raises(Exception, match="a batch holds 12 pages"):
        requests.build_request(df, "s", "u", kind="text").collect()
    sent = requests.build_request(paging.cap_pages(df), "s", "u", kind="text").first()
    assert sent.dropped_pages == 2 and "p9" in sent.payload


def test_jpeg_with_many_segments_and_fill_bytes(spark):
    frame = b"\xff\xc0\x00\x11\x08\x01\x00\x02\x00\x03" + b"\x00" * 9
    many = b"\xff\xd8" + b"\xff\xe2\x00\x04ab" * 200 + frame
    fill = b"\xff\xd8" + b"\xff\xff\xff\xe2\x00\x04ab" + b"\xff" + frame
    cut = b"\xff\xd8" + b"\xff\xe2\x00\x04ab" * 200
    df = spark.createDataFrame([(0, many), (1, fill), (2, cut)], "i int, c binary")
    got = {r.i: (r.s.width, r.s.height) for r in df.select("i", image_size("c").alias("s")).collect()}
    assert got == {0: (512, 256), 1: (512, 256), 2: (None, None)}


def test_names_keep_every_character_and_digit(spark):
    df = spark.createDataFrame([("/a/Report #3.pdf",), ("/a/Q?1.pdf",)], "p string")
    assert [r[0] for r in df.select(file_stem("p", url=False)).collect()] == ["Report #3", "Q?1"]
    names = ["p" + "9" * 40, "p1" + "0" * 40, "p0007", "p8", "p"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r.n for r in df.orderBy(natural_key("n")).collect()] == ["p", "p0007", "p8", "p" + "9" * 40, "p1" + "0" * 40]


def test_two_folders_of_one_name(spark, tmp_path):
    for parent in ("x", "y"):
        (tmp_path / parent / "docA").mkdir(parents=True)
        for n in (1, 2):
            (tmp_path / parent / "docA" / f"Page_{n}.jpeg").write_bytes(parent.encode())
    got = sorted((bytes(r.payload), r.page_no, r.num_pages) for r in files.image_folder_pages(spark, str(tmp_path)).collect())
    assert got == [(b"x", 1, 2), (b"x", 2, 2), (b"y", 1, 2), (b"y", 2, 2)]


def test_a_repeated_price_counts_once_and_two_prices_fail(spark):
    usage = spark.createDataFrame([("m", 1000, 1000)], "model string, prompt_tokens long, completion_tokens long")
    same = metrics.price_table(spark, [("m", 0.01, 0.03), ("m", 0.01, 0.03)])
    assert [round(r.total_cost, 6) for r in metrics.with_cost(usage, same).collect()] == [0.04]
    with pytest.raises(Exception, match="two prices for model m"):
        metrics.with_cost(usage, metrics.price_table(spark, [("m", 0.01, 0.03), ("m", 0.02, 0.03)])).collect()


@pytest.mark.parametrize("buckets", [None, 2])
def test_rerun_of_one_document_keeps_the_others(spark, tmp_path, buckets):
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    rows = [(f"d{i}", 1, f'{{"v":{i}}}') for i in range(20)]
    final = spark.createDataFrame([(d, r) for d, _, r in rows], "doc string, record string")
    batch = spark.createDataFrame(rows, "doc string, batch_no long, reply string")
    one = spark.createDataFrame([("d3", '{"v":300}')], "doc string, record string")
    one_batch = spark.createDataFrame([("d3", 1, '{"v":300}')], "doc string, batch_no long, reply string")
    a, b = str(tmp_path / "final"), str(tmp_path / "batches")
    for f, g in ((final, batch), (one, one_batch)):
        sinks.write_final(f, a, buckets=buckets)
        sinks.write_batches(g, b, buckets=buckets)
    lines = [r.value for r in spark.read.text(a).collect()]
    assert len(lines) == 20 and sum('{"v":300}' in x for x in lines) == 1 and not any('{"v":3}' in x for x in lines)
    replies = {r.doc: r.reply for r in spark.read.json(b).collect()}
    assert len(replies) == 20 and replies["d3"] == '{"v":300}'
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == before
