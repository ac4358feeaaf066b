"""Paging, natural order, labels, stitching, ranking."""

import random
import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from pagewright.functions import textfn
from pagewright.operators import paging
from pagewright.operators.ranking import rank_within


def docs(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc bigint, text string")


def test_explode_edge_cases(spark):
    ten = "\n".join(f"l{i}" for i in range(10))
    eleven = "\n".join(f"l{i}" for i in range(11))
    df = docs(spark, ["", ten, eleven, None, "a\n"])
    rows = sorted((r.doc, r.page_no, r.num_pages, r.text) for r in paging.explode_pages(df, "doc", "text", 10).collect())
    assert rows == [
        (0, 1, 1, ""),
        (1, 1, 1, ten),
        (2, 1, 2, "\n".join(f"l{i}" for i in range(10))),
        (2, 2, 2, "l10"),
        (4, 1, 1, "a\n"),
    ]


def test_explode_then_stitch_loses_no_line(spark):
    rnd = random.Random(1)
    texts = ["\n".join(f"line {d}-{i}" for i in range(rnd.randint(1, 45))) for d in range(20)]
    pages = paging.explode_pages(docs(spark, texts), "doc", "text", 10)
    back = pages.groupBy("doc").agg(F.array_join(F.array_sort(F.collect_list(F.struct("page_no", "text")))["text"], "\n").alias("t"))
    got = {r.doc: r.t for r in back.collect()}
    assert got == dict(enumerate(texts))


def py_natural(name):
    return [int(t) if t.isdigit() else t.lower() for t in re.split("([0-9]+)", name)]


NAMES = ["Page_10.jpeg", "page_9.jpeg", "Page_2.jpeg", "3x", "nodigits", "Page_007.jpeg", "Page_7.jpeg",
         "a10b2", "a10b10", "a9", "A1", "", "10", "9", "x1y", "x1"]


def test_natural_key_matches_python(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "name string")
    got = [r.name for r in df.orderBy(textfn.natural_key("name"), "name").collect()]
    expected = sorted(NAMES, key=lambda n: (py_natural(n), n))
    assert got == expected


def test_natural_order_rank(spark):
    df = spark.createDataFrame([(1, n) for n in NAMES], "doc int, name string")
    got = {r.name: r.natural_rank for r in paging.natural_order(df, "name", ["doc"]).collect()}
    expected = sorted(NAMES, key=lambda n: (py_natural(n), n))
    assert [n for n, _ in sorted(got.items(), key=lambda kv: kv[1])] == expected


def test_stem_and_extension(spark):
    paths = ["/a/b/report.final.pdf", "/a/.env", "http://h.example.com/en/12.html?x=1#top", "/a/b/", "noext"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = [(r.s, r.e) for r in df.select(textfn.file_stem("p").alias("s"), textfn.file_extension("p").alias("e")).collect()]
    assert got == [("report.final", ".pdf"), (".env", ""), ("12", ".html"), ("", ""), ("noext", "")]


def test_labels_and_batches(spark):
    df = spark.createDataFrame([(1, p, 23) for p in range(1, 24)], "doc int, page_no bigint, num_pages bigint")
    b = paging.assign_batches(df, 10)
    labels = sorted((r.batch_no, r.label) for r in paging.batch_labels(b).collect())
    assert labels == [(1, "Pages_01_to_10"), (2, "Pages_11_to_20"), (3, "Pages_21_to_23")]
    row = b.where("page_no = 23").first()
    assert (row.batch_no, row.total_batches, row.pages_in_batch) == (3, 3, 3)


def test_page_label_padding(spark):
    df = spark.createDataFrame([(7, 120), (7, 9)], "p int, n int")
    got = [r.l for r in df.select(textfn.page_label("p", "n").alias("l")).collect()]
    assert got == ["Page_007.jpeg", "Page_7.jpeg"]


def test_cap_pages_reports_loss(spark):
    df = spark.createDataFrame([(1, p, 12, f"t{p}") for p in range(1, 13)], "doc int, page_no bigint, num_pages bigint, text string")
    c = paging.cap_pages(paging.collect_batches(paging.assign_batches(df, 12), "text"), 10).first()
    assert (len(c.pages), c.dropped_pages, c.pages[-1].page_no) == (10, 2, 10)


def test_stitch_format(spark):
    parts = spark.createDataFrame(
        [(1, "Pages_10_to_11.md", "B"), (1, "Pages_01_to_09.md", "A")], "doc int, label string, content string"
    )
    got = paging.stitch_pages(parts, "doc", "label", "content").first().markdown
    assert got == "# Page 01\n\nA\n\n# Page 10\n\nB\n\n"


def test_rank_within_hot_group_matches_window(spark):
    rnd = random.Random(5)
    rows = [(0 if i % 3 == 0 else rnd.randint(1, 50), rnd.randint(0, 1000), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g int, v int, id int")
    got = {r.id: r.rank for r in rank_within(df, ["g"], ["v", "id"], "rank", num_partitions=7).collect()}
    small = {r.id: r.rank for r in rank_within(df, ["g"], ["v", "id"], "rank").collect()}
    w = Window.partitionBy("g").orderBy("v", "id")
    exp = {r.id: r.rank for r in df.withColumn("rank", F.row_number().over(w)).collect()}
    assert got == exp
    assert small == exp


def test_stitch_parts_equal_stitch_pages(spark):
    rows = [(d, f"Pages_{s:02d}_to_{s + 1:02d}", f"c{d}-{s}") for d in range(3) for s in (1, 3, 5, 7, 9, 11)]
    parts = spark.createDataFrame(rows, "doc int, label string, content string")
    whole = {r.doc: r.markdown for r in paging.stitch_pages(parts, "doc", "label", "content").collect()}
    ranked = paging.stitch_parts(parts, "doc", "label", "content").collect()
    joined = {}
    for r in sorted(ranked, key=lambda r: (r.doc, r.part_no)):
        joined[r.doc] = joined.get(r.doc, "") + r.markdown
    assert joined == whole


def test_markdown_parts_sink(spark, tmp_path):
    import glob
    import os

    from pagewright.sources import sinks

    rows = [(1, i, f"# Page {i}\n\nx\n\n") for i in range(1, 6)]
    parts = spark.createDataFrame(rows, "doc int, part_no bigint, markdown string")
    out = str(tmp_path / "mdparts")
    sinks.write_markdown_parts(parts, out)
    files = sorted(glob.glob(os.path.join(out, "doc=1", "part-*")))
    text = "".join(open(f).read() for f in files)
    assert text == "".join(r[2] for r in rows)


def test_size_for_input(spark):
    from pagewright.session import size_for_input

    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        cores = spark.sparkContext.defaultParallelism
        assert size_for_input(spark, 10) == 2 * cores
        assert size_for_input(spark, 100 << 40) == (100 << 40) // (256 << 20)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_count_join_back_is_split_for_a_hot_document(spark):
    """A per-document count joined back onto the pages: AQE must be able to
    split the hot document (skew join), and the result equals the plain join."""
    from pagewright.operators.ranking import join_per_group

    rows = [(0 if i % 3 == 0 else i, i) for i in range(3000)] + [(None, -1)]
    df = spark.createDataFrame(rows, "doc long, page long").repartition(8)
    counts = df.groupBy("doc").agg(F.count(F.lit(1)).alias("n"))
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1024",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4096",
    }
    saved = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        for how in ("inner", "left"):
            joined = join_per_group(df, counts, ["doc"], how)
            got = sorted(joined.collect(), key=lambda r: (r.page,))
            want = sorted(df.join(counts, "doc", how).select("doc", "page", "n").collect(), key=lambda r: (r.page,))
            assert [tuple(r) for r in got] == [tuple(r) for r in want]
            assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in saved.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_batches_of_a_selection_count_what_is_listed(spark):
    rows = [("d", p, 25) for p in range(3, 6)] + [("e", p, 30) for p in (1, 4, 9, 16, 25)] + [(None, 7, 9)]
    df = spark.createDataFrame(rows, "doc string, page_no bigint, num_pages bigint")
    got = {(r.doc, r.page_no): (r.batch_no, r.num_pages, r.total_batches, r.pages_in_batch)
           for r in paging.batch_selection(df, 3).collect()}
    assert got == {
        ("d", 3): (1, 3, 1, 3), ("d", 4): (1, 3, 1, 3), ("d", 5): (1, 3, 1, 3),
        ("e", 1): (1, 5, 2, 3), ("e", 4): (1, 5, 2, 3), ("e", 9): (1, 5, 2, 3),
        ("e", 16): (2, 5, 2, 2), ("e", 25): (2, 5, 2, 2), (None, 7): (1, 1, 1, 1),
    }


def test_stitch_parts_keeps_rows_with_equal_labels_apart(spark):
    rows = [("d", "Pages_2_to_2", "b"), ("d", "Pages_2_to_2", "a"), ("d", "Pages_10_to_10", "c"), ("e", "Pages_1_to_1", "x")]
    df = spark.createDataFrame(rows, "doc string, label string, content string")
    parts = paging.stitch_parts(df, "doc", "label", "content").orderBy("doc", "part_no").collect()
    assert [(r.doc, r.part_no, r.markdown.split()[-1]) for r in parts] == [
        ("d", 1, "a"), ("d", 2, "b"), ("d", 3, "c"), ("e", 1, "x")]
    whole = {r.doc: r.markdown for r in paging.stitch_pages(df, "doc", "label", "content").collect()}
    assert whole["d"] == "".join(r.markdown for r in parts if r.doc == "d")
