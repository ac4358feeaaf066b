"""End-to-end flows with a stand-in model, and the incremental folder run."""

import json

import pytest
from pyspark.sql import functions as F

from pagewright.operators import combine, metrics, model, paging, requests
from pagewright.plans import flows
from pagewright.streaming import folder


def test_pages_to_records(spark):
    def fake_fields_model(payload):
        req = json.loads(payload)
        texts = [p["text"] for p in req["messages"][1]["content"][1:]]
        title = next((t.split(":", 1)[1] for t in texts if t.startswith("title:")), "")
        content = "```json\n" + json.dumps({"title": title, "pages": len(texts)}) + "\n```"
        return json.dumps({"choices": [{"message": {"content": content}}], "usage": {"prompt_tokens": 10, "completion_tokens": 3}})

    rows = [("d1", p, 12, "title:First" if p == 2 else ("title:Last" if p == 12 else f"x{p}")) for p in range(1, 13)]
    rows += [("d2", 1, 1, "nothing")]
    pages = spark.createDataFrame(rows, "doc string, page_no bigint, num_pages bigint, payload string")
    records, rejects, usage = flows.pages_to_records(pages, ["title", "author"], fake_fields_model, kind="text")
    got = {r.doc: json.loads(r.record) for r in records.collect()}
    assert got == {"d1": {"title": "Last", "author": "", "pages": 2}, "d2": {"title": "", "author": "", "pages": 1}}
    assert rejects.count() == 0
    assert usage.groupBy().sum("prompt_tokens").first()[0] == 30


def test_pages_to_markdown(spark):
    def fake_markdown_model(payload):
        req = json.loads(payload)
        n = len(req["messages"][1]["content"]) - 1
        return json.dumps({"choices": [{"message": {"content": f"## {n} pages"}}], "usage": {"prompt_tokens": 1, "completion_tokens": 1}})

    rows = [("d", p, 11, f"p{p}") for p in range(1, 12)]
    pages = spark.createDataFrame(rows, "doc string, page_no bigint, num_pages bigint, payload string")
    markdown, usage = flows.pages_to_markdown(pages, fake_markdown_model, kind="text")
    assert sorted((u.model, u.request_no, u.prompt_tokens) for u in usage.collect()) == [("vision", 1, 1), ("vision", 2, 1)]
    md = markdown.first().markdown
    assert md == "# Page 01\n\n## 10 pages\n\n# Page 11\n\n## 1 pages\n\n"


def test_incremental_folder_run(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text("l1\nl2")
    (src / "b.txt").write_text("\n".join(f"x{i}" for i in range(15)))
    stream = folder.document_stream(spark, str(src))

    def flow(batch):
        return paging.page_count(paging.explode_pages(batch, "doc", "text", 10), "doc")

    q = folder.run_incremental(stream, flow, str(tmp_path / "out"), str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    got = {r.doc: r.num_pages for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"a": 1, "b": 2}
    # a second run finds nothing new
    (src / "c.txt").write_text("only")
    q = folder.run_incremental(folder.document_stream(spark, str(src)), flow, str(tmp_path / "out"), str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    got = {r.doc: r.num_pages for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"a": 1, "b": 2, "c": 1}


def test_single_call_records(spark):
    def fake(payload):
        req = json.loads(payload)
        n = len(req["messages"][1]["content"]) - 1
        content = json.dumps({"Page 1": {"Header": "H", "images": n}})
        return json.dumps({"choices": [{"message": {"content": content}}], "usage": {"prompt_tokens": 1, "completion_tokens": 1}})

    rows = [("d", p, f"p{p}") for p in range(1, 14)]
    pages = spark.createDataFrame(rows, "doc string, page_no bigint, payload string")
    records, usage = flows.single_call_records(pages, fake, kind="text")
    assert [(u.doc, u.model, u.completion_tokens) for u in usage.collect()] == [("d", "vision", 1)]
    r = records.first()
    assert r.valid and json.loads(r.json)["Page 1"]["images"] == 10 and r.dropped_pages == 3


def test_markdown_to_records(spark):
    def fake(payload):
        req = json.loads(payload)
        assert req["response_format"] == {"type": "json_object"} and "max_tokens" not in req
        md = req["messages"][1]["content"]
        content = json.dumps({"title": md.splitlines()[0]})
        return json.dumps({"choices": [{"message": {"content": content}}], "usage": {"prompt_tokens": 1, "completion_tokens": 1}})

    md = spark.createDataFrame([("d", "# Page 1\n\nbody")], "doc string, markdown string")
    records, usage = flows.markdown_to_records(md, fake, template=["title"])
    assert [(u.doc, u.model) for u in usage.collect()] == [("d", "text")]
    r = records.first()
    assert r.valid and json.loads(r.json) == {"title": "# Page 1"}


def test_records_with_reply_store(spark, tmp_path):
    def fake(payload):
        req = json.loads(payload)
        n = len(req["messages"][1]["content"]) - 1
        content = json.dumps({"title": f"t{n}"})
        return json.dumps({"choices": [{"message": {"content": content}}], "usage": {"prompt_tokens": 2, "completion_tokens": 1}})

    rows = [("d", p, 3, f"p{p}") for p in range(1, 4)]
    pages = spark.createDataFrame(rows, "doc string, page_no bigint, num_pages bigint, payload string")
    store = str(tmp_path / "store")
    for _ in range(2):
        records, rejects, usage = flows.pages_to_records(pages, ["title"], fake, kind="text", replies_path=store)
        assert json.loads(records.first().record) == {"title": "t3"}
    assert spark.read.parquet(store).count() == 1


def test_rule_records(spark):
    rows = [("d", 1, "Title: First\nBy Ann Lee"), ("d", 2, "nothing here"), ("d", 3, "Title: Second\nTotal: 40"),
            ("e", 1, "Total: 0")]
    pages = spark.createDataFrame(rows, "doc string, page_no bigint, text string")
    rules = [("title", r"Title: ([^\n]*)"), ("authors", r"By ([A-Z][a-z]+ [A-Z][a-z]+)", "all"),
             ("stats.total", r"Total: ([0-9]+)", "int")]
    got = {r.doc: json.loads(r.record) for r in flows.rule_records(pages, rules).collect()}
    assert got["d"] == {"title": "Second", "authors": ["Ann Lee"], "stats": {"total": 40}}
    # nested values are replaced whole; {"total": 0} is a non-empty object
    assert got["e"] == {"title": "", "authors": "", "stats": {"total": 0}}


def _replier():
    """A nested function, so that it travels to the workers by value."""
    def reply(content):
        return json.dumps({"choices": [{"message": {"content": content}}],
                           "usage": {"prompt_tokens": 2, "completion_tokens": 1}})

    return reply


def test_reply_that_is_no_object_is_a_reject(spark):
    _reply = _replier()
    pages = spark.createDataFrame([("a", 1, 1, "x"), ("b", 1, 1, "y")],
                                  "doc string, page_no bigint, num_pages bigint, payload string")

    def fake(payload):
        text = json.loads(payload)["messages"][1]["content"][1]["text"]
        return _reply('["title"]' if text == "x" else '{"title":1.50}')

    records, rejects, usage = flows.pages_to_records(pages, ["title"], fake, kind="text")
    assert [(r.doc, r.record) for r in records.collect()] == [("b", '{"title":1.50}')]
    assert [r.doc for r in rejects.collect()] == ["a"] and usage.count() == 2


def test_requests_show_the_whole_example_template(spark):
    seen = '{"title":"x","survey":{"total":40,"by":["a"]}}'
    for template in [json.loads(seen), [("title", "x"), ("survey", {"total": 40, "by": ["a"]})]]:
        assert flows._template_json(template) == seen
    loaded = combine.template_rows(spark.createDataFrame([(seen,)], "t string"), "t")
    assert flows._template_json(loaded) == seen
    assert requests.text_fields_prompt(seen).endswith(requests.FIELDS_USER + seen)
    assert requests.text_fields_prompt().endswith(requests.NO_TEMPLATE)


def test_usage_of_all_calls_feeds_the_usage_report(spark):
    _reply = _replier()
    def fake(payload):
        return _reply('{"title":"t"}')

    pages = spark.createDataFrame([("d", p, 12, f"p{p}") for p in range(1, 13)],
                                  "doc string, page_no bigint, num_pages bigint, payload string")
    markdown, vision = flows.pages_to_markdown(pages, fake, kind="text", call_args={"partitions": 2, "concurrency": 2})
    _, text = flows.markdown_to_records(markdown, fake, template=["title"])
    prices = metrics.price_table(spark)
    usage = metrics.usage_by_doc_model(vision.unionByName(text), prices)
    got = {(r.doc, r.model): r.prompt_tokens for r in usage.collect()}
    assert got == {("d", "vision"): 4, ("d", "text"): 2}


def test_finished_chunks_are_not_sent_again(spark, tmp_path):
    _reply = _replier()
    log = tmp_path / "calls"
    log.mkdir()
    req = spark.createDataFrame([(i, f"p{i}") for i in range(40)], "i int, payload string")
    broken = tmp_path / "broken"
    broken.write_text("")

    def fake(payload):
        import os
        import uuid

        # The task itself dies on one request, as an executor would.
        if payload == "p7" and broken.exists():
            raise KeyboardInterrupt
        (log / f"{payload}-{uuid.uuid4().hex}").write_text(str(os.getpid()))
        return _reply("{}")

    store = str(tmp_path / "store")
    with pytest.raises(Exception):
        model.call_model_cached(req, fake, store, chunks=8)
    done = {r.request_key for r in spark.read.parquet(store).collect()} if (tmp_path / "store").exists() else set()
    before = len(list(log.iterdir()))
    broken.unlink()
    out = model.call_model_cached(req, fake, store, chunks=8)
    assert [r.status for r in out.collect()] == ["ok"] * 40
    assert len(list(log.iterdir())) - before == 40 - len(done)
    model.call_model_cached(req, fake, store, chunks=8).count()
    assert len(list(log.iterdir())) - before == 40 - len(done)
