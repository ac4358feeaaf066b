"""Folder sources, image scan and sinks."""

import json
import os

from pyspark.sql import functions as F

from pagewright.functions import textfn
from pagewright.operators import combine, paging, requests
from pagewright.sources import files, sinks


def write_jpeg(spark, path, w, h):
    jvm = spark.sparkContext._jvm
    img = jvm.java.awt.image.BufferedImage(w, h, jvm.java.awt.image.BufferedImage.TYPE_INT_RGB)
    assert jvm.javax.imageio.ImageIO.write(img, "jpeg", jvm.java.io.File(path))


def test_image_scan_sizes_and_tokens(spark, tmp_path):
    d = tmp_path / "page_jpegs"
    d.mkdir()
    write_jpeg(spark, str(d / "Page_1.jpeg"), 700, 1100)
    write_jpeg(spark, str(d / "Page_2.jpeg"), 1700, 2200)
    (d / "broken.jpeg").write_bytes(b"not an image")
    imgs = files.scan_page_images(spark, str(d)).withColumn("tokens", textfn.image_tokens("width", "height"))
    got = sorted((r.name, r.width, r.height, r.tokens) for r in imgs.collect())
    assert got == [("Page_1.jpeg", 700, 1100, 85 + 170 * 2 * 3), ("Page_2.jpeg", 1700, 2200, 3485)]


def test_scan_documents_and_list_pages(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1")
    (tmp_path / "b.report.pdf").write_bytes(b"%PDF-2")
    (tmp_path / "Page_10.jpeg").write_bytes(b"x")
    (tmp_path / "Page_9.jpeg").write_bytes(b"y")
    docs = sorted(r.doc for r in files.scan_documents(spark, str(tmp_path), "*.pdf").collect())
    assert docs == ["a", "b.report"]
    pages = files.list_pages(spark, str(tmp_path), ".jpeg")
    assert sorted((r.name, r.page_no) for r in pages.collect()) == [("Page_10.jpeg", 10), ("Page_9.jpeg", 9)]


def test_base64_has_no_line_breaks(spark):
    r = spark.range(1).select(textfn.b64(F.lit(b"x" * 100)).alias("b"), textfn.data_url(F.lit(b"x" * 100)).alias("u")).first()
    import base64

    assert r.b == base64.b64encode(b"x" * 100).decode()
    assert r.u == "data:image/jpeg;base64," + r.b


def test_batch_sink_round_trip_and_text_pages(spark, tmp_path):
    rows = [("docA", 1, "Pages_01_to_10", '{"title":"x"}'), ("docA", 2, "Pages_11_to_12", '{"title":"y"}'),
            ("docB", 1, "Pages_1_to_3", '{"title":"z"}')]
    df = spark.createDataFrame(rows, "doc string, batch_no int, label string, j string")
    out = str(tmp_path / "batches")
    sinks.write_batches(df, out)
    back = spark.read.json(out)
    assert sorted((r.doc, r.batch_no, r.label) for r in back.collect()) == sorted((a, b, c) for a, b, c, _ in rows)
    # rerun for one document keeps the other (dynamic partition overwrite)
    sinks.write_batches(df.where("doc = 'docB'"), out)
    assert spark.read.json(out).count() == 3


def test_final_sink_ascii_escape(spark, tmp_path):
    df = spark.createDataFrame([("d", '{"t":"é€😀"}')], "doc string, record string")
    out = str(tmp_path / "final")
    sinks.write_final(df, out, ascii_only=True)
    text = spark.read.text(out).first().value
    assert text == json.dumps({"t": "é€😀"}, separators=(",", ":"))
    assert json.loads(text) == {"t": "é€😀"}


def test_markdown_sink_and_read_back(spark, tmp_path):
    df = spark.createDataFrame([("d", "# Page 1\n\nA\n\n")], "doc string, markdown string")
    out = str(tmp_path / "md")
    sinks.write_markdown(df, out)
    folder = os.path.join(out, "doc=d")
    back = files.read_text_pages(spark, folder).first()
    assert back.text.startswith("# Page 1\n\nA")


def test_read_template_and_request_shape(spark, tmp_path):
    p = tmp_path / "schema.json"
    p.write_text('{"title": "", "n": 0}')
    keys = combine.template_keys(combine.load_template(spark, str(p)))
    assert keys == ["title", "n"]
    pages = spark.createDataFrame([(1, 1, [(p, f"t{p}") for p in range(1, 13)])],
                                  "doc int, batch_no int, pages array<struct<page_no:int,payload:string>>")
    system, user = requests.fields_prompt('{"title":"","n":0}')
    req = json.loads(requests.build_request(paging.cap_pages(pages), system, user, kind="text").first().payload)
    assert [m["role"] for m in req["messages"]] == ["system", "user"]
    assert len(req["messages"][1]["content"]) == 11  # instruction + 10 pages, the rest capped
    assert req["max_tokens"] == 4096 and req["temperature"] == 0 and req["top_p"] == 0
    assert req["messages"][1]["content"][0]["text"].endswith('{"title":"","n":0}')


def test_image_request_parts(spark):
    import base64

    pages = spark.createDataFrame([(1, 1, [(p, bytes([p]) * 5) for p in range(1, 12)])],
                                  "doc int, batch_no int, pages array<struct<page_no:int,payload:binary>>")
    req = json.loads(requests.build_request(paging.cap_pages(pages), requests.MARKDOWN_SYSTEM, requests.MARKDOWN_USER, kind="image").first().payload)
    parts = req["messages"][1]["content"]
    assert parts[0] == {"type": "text", "text": requests.MARKDOWN_USER}
    assert len(parts) == 11 and all(p["type"] == "image_url" for p in parts[1:])
    assert parts[1]["image_url"]["url"] == "data:image/jpeg;base64," + base64.b64encode(bytes([1]) * 5).decode()
    assert req["messages"][0]["content"] == [{"type": "text", "text": requests.MARKDOWN_SYSTEM}]


def test_bucketed_sinks(spark, tmp_path):
    rows = [(f"doc{i}", b, f"L{b}", '{"t":1}') for i in range(20) for b in (1, 2)]
    df = spark.createDataFrame(rows, "doc string, batch_no int, label string, j string")
    out = str(tmp_path / "b")
    sinks.write_batches(df, out, buckets=4)
    back = spark.read.json(out)
    assert back.count() == 40 and back.select("doc_bucket").distinct().count() <= 4
    final = spark.createDataFrame([(f"doc{i}", '{"a":"é"}') for i in range(20)], "doc string, record string")
    out2 = str(tmp_path / "f")
    sinks.write_final(final, out2, ascii_only=True, buckets=4)
    lines = [json.loads(r.value) for r in spark.read.text(out2).collect()]
    assert sorted(x["doc"] for x in lines) == sorted(f"doc{i}" for i in range(20))
    assert all(x["record"] == {"a": "é"} for x in lines)


def write_image(spark, path, w, h, fmt):
    jvm = spark.sparkContext._jvm
    img = jvm.java.awt.image.BufferedImage(w, h, jvm.java.awt.image.BufferedImage.TYPE_INT_RGB)
    assert jvm.javax.imageio.ImageIO.write(img, fmt, jvm.java.io.File(path))


def test_page_sizes_from_headers(spark, tmp_path):
    d = tmp_path / "imgs"
    d.mkdir()
    write_image(spark, str(d / "a.jpeg"), 700, 1100, "jpeg")
    write_image(spark, str(d / "b.png"), 1700, 2200, "png")
    write_image(spark, str(d / "c.jpeg"), 640, 480, "jpeg")
    raw = (d / "c.jpeg").read_bytes()
    # an APP1 segment holding a fake frame header (like an EXIF thumbnail) must be skipped
    fake_sof = bytes.fromhex("FFC0001108000A000A03012200021101031101")
    app1 = b"\xff\xe1" + (2 + len(fake_sof)).to_bytes(2, "big") + fake_sof
    (d / "c.jpeg").write_bytes(raw[:2] + app1 + raw[2:])
    (d / "note.txt").write_text("not an image")
    got = {r.name: (r.width, r.height) for r in files.scan_page_sizes(spark, str(d)).collect()}
    assert got == {"a.jpeg": (700, 1100), "b.png": (1700, 2200), "c.jpeg": (640, 480), "note.txt": (None, None)}
    decoded = {r.name: (r.width, r.height) for r in files.scan_page_images(spark, str(d)).collect()}
    assert decoded == {k: v for k, v in got.items() if k != "note.txt"}


def test_image_folder_pages_to_budget_batches(spark, tmp_path):
    from pagewright.operators import budget

    for doc, n in (("docA", 12), ("docB", 3)):
        d = tmp_path / doc
        d.mkdir()
        for p in range(1, n + 1):
            write_image(spark, str(d / f"Page_{p}.jpeg"), 600 + 40 * p, 800, "jpeg")
    pages = files.image_folder_pages(spark, str(tmp_path))
    rows = sorted((r.doc, r.page_no, r.name, r.width) for r in pages.collect())
    assert [r[2] for r in rows if r[0] == "docA"][:3] == ["Page_1.jpeg", "Page_2.jpeg", "Page_3.jpeg"]
    assert all(w == 600 + 40 * p for _, p, _, w in rows)
    batches = budget.batch_totals(budget.budget_batches(pages, 3000, 10))
    got = sorted((r.doc, r.batch_no, r.n_pages) for r in batches.collect())
    # 2 x 2 tiles -> 765 tokens a page until width passes 1024 (page 11): 3 pages per 3000-token batch
    assert got[0] == ("docA", 1, 3) and ("docB", 1, 3) in got
    req = requests.build_request(
        budget.budget_batches(pages, 3000, 10).join(pages.select("doc", "page_no", "payload"), ["doc", "page_no"])
        .groupBy("doc", "batch_no").agg(F.array_sort(F.collect_list(F.struct("page_no", "payload"))).alias("pages")),
        requests.MARKDOWN_SYSTEM, requests.MARKDOWN_USER, kind="image")
    first = json.loads(req.where("doc = 'docB'").first().payload)
    assert first["messages"][1]["content"][1]["image_url"]["url"].startswith("data:image/jpeg;base64,/9j/")


class _StubConf(dict):
    def get(self, k, default=None):
        return super().get(k, default)

    def set(self, k, v):
        self[k] = v


class _StubContext:
    def __init__(self, master, ckpt=None):
        self.master, self._ckpt = master, ckpt

    def getCheckpointDir(self):
        return self._ckpt

    def setCheckpointDir(self, d):
        self._ckpt = d


class _StubSession:
    def __init__(self, master, conf=None, ckpt=None):
        self.conf, self.sparkContext = _StubConf(conf or {}), _StubContext(master, ckpt)


def test_checkpoint_dir_rule(tmp_path, monkeypatch):
    import pytest

    from pagewright.session import ensure_checkpoint_dir

    shared = "hdfs://nn/shared/ckpt"
    assert ensure_checkpoint_dir(_StubSession("yarn", {"spark.checkpoint.dir": shared})) == shared
    assert ensure_checkpoint_dir(_StubSession("k8s://api", ckpt=shared)) == shared
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(_StubSession("spark://master:7077"))
    monkeypatch.setenv("TMPDIR", str(tmp_path))
    s = _StubSession("local[2]")
    local = ensure_checkpoint_dir(s)
    assert local.startswith(str(tmp_path)) and s.conf["spark.checkpoint.dir"] == local
