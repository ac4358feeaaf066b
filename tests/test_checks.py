"""Template conformance, grounding, heading rule, coverage."""

from pagewright.operators import checks


def test_check_template_missing_extra_kind(spark):
    rows = [(1, 1, '{"title":"A","n":"x","other":1}'), (1, 2, '{"title":"","author":"B","n":3}')]
    df = spark.createDataFrame(rows, "doc int, batch_no int, j string")
    out = checks.check_template(df, ["title", "author", "n"], ["doc", "batch_no"], "j", {"title": '""', "author": '""', "n": "0"})
    got = sorted((r.batch_no, r.key, r.problem) for r in out.collect())
    assert got == [(1, "author", "missing"), (1, "n", "kind"), (1, "other", "extra")]


def test_check_grounded(spark):
    values = spark.createDataFrame([(1, "title", "Hello World"), (1, "h1", "absent"), (2, "title", "x"), (1, "e", "")],
                                   "doc int, key string, value string")
    sources = spark.createDataFrame([(1, "<h1>hello world</h1>"), (1, "page two")], "doc int, text string")
    got = sorted((r.doc, r.key, r.grounded) for r in checks.check_grounded(values, sources).collect())
    assert got == [(1, "h1", False), (1, "title", True), (2, "title", False)]


def test_check_headings(spark):
    df = spark.createDataFrame([(1, "# Bad\n## Good\n# Also bad"), (2, "## ok\n### ok")], "doc int, md string")
    got = sorted((r.doc, r.single_hash_lines) for r in checks.check_headings(df, "md", ["doc"]).collect())
    assert got == [(1, 2), (2, 0)]


def test_check_coverage(spark):
    pages = spark.createDataFrame([(1, p) for p in range(1, 13)], "doc int, page_no int")
    sent = spark.createDataFrame([(1, p) for p in range(1, 11)], "doc int, page_no int")
    got = sorted(r.page_no for r in checks.check_coverage(pages, sent).collect())
    assert got == [11, 12]


def test_check_grounded_against_brute_force(spark):
    import random

    rnd = random.Random(7)
    words = ["Alpha", "beta", "GAMMA", "delta", "alpha beta", "Zeta", ""]
    values = [(rnd.randint(1, 6), f"k{rnd.randint(1, 4)}", rnd.choice(words)) for _ in range(80)]
    values += values[:10]  # duplicate rows give one result row
    pages = [(d, " ".join(rnd.choice(["alpha", "Beta", "gamma", "x", "alpha beta"]) for _ in range(3)))
             for d in range(1, 5) for _ in range(rnd.randint(0, 3))]  # docs 5 and 6 have no pages
    want = {
        (d, k, v): any(v.lower() in t.lower() for dd, t in pages if dd == d)
        for d, k, v in values if v != ""
    }
    vdf = spark.createDataFrame(values, "doc int, key string, value string").repartition(5)
    sdf = spark.createDataFrame(pages, "doc int, text string").repartition(3)
    rows = checks.check_grounded(vdf, sdf).collect()
    got = {(r.doc, r.key, r.value): r.grounded for r in rows}
    assert len(rows) == len(got) and got == want


def test_check_grounded_splits_a_hot_document(spark):
    """The page join must stay splittable by AQE when one document holds most pages."""
    pages = spark.createDataFrame(
        [(0 if i % 3 else i, f"page {i} alpha") for i in range(3000)], "doc long, text string"
    ).repartition(8)
    values = spark.createDataFrame([(0, "k", "Alpha"), (0, "m", "zeta"), (3, "k", "page 3")],
                                   "doc long, key string, value string")
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
        out = checks.check_grounded(values, pages)
        got = sorted((r.doc, r.key, r.grounded) for r in out.collect())
        assert got == [(0, "k", True), (0, "m", False), (3, "k", True)]
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in saved.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_check_grounded_short_values_and_odd_characters(spark):
    """Values shorter than a gram, at the ends of a page, with wide characters, quotes and line breaks."""
    texts = ["ab", "xa b", "über\nGröße 日本語 😀 a.b*c", "", "Ω", "İstanbul ẞ"]
    values = ["a", "b", "ab", "xa", "b*c", "日本", "語", "😀", "größe", "R\ng", "zz", "ω", "x a", "ß", "İ", "本語 😀 a"]
    rows = [(d, "k", v) for d in range(len(texts)) for v in values] + [(None, "k", "ab")]
    vdf = spark.createDataFrame(rows, "doc int, key string, value string")
    sdf = spark.createDataFrame([*enumerate(texts), (0, "ab"), (None, "ab"), (1, None)], "doc int, text string")
    got = {(r.doc, r.value): r.grounded for r in checks.check_grounded(vdf, sdf).collect()}
    # Spark's own lower() on both sides is the rule; only where a text holds a value is tested here.
    low = {r.v: r.l for r in spark.sql("SELECT explode(array(%s)) AS v" % ",".join(
        "'" + x.replace("\n", "\\n") + "'" for x in [*values, *texts])).selectExpr("v", "lower(v) AS l").collect()}
    want = {(d, v): low[v] in low[texts[d]] for d in range(len(texts)) for v in values} | {(None, "ab"): False}
    assert got == want


def test_check_grounded_many_values_meet_only_their_pages(spark):
    """10,000 values on 2,000 pages of one document: meetings grow with the hits, not with values times pages."""
    n, pages = 10_000, 2_000
    values = spark.createDataFrame([(1, f"k{i}", f"<v{i:05d}>" if i % 2 else f"absent {i:05d}") for i in range(n)],
                                   "doc int, key string, value string")
    sources = spark.createDataFrame(
        [(1, " ".join(f"<V{i:05d}>" for i in range(p, n, pages))) for p in range(pages)], "doc int, text string")
    out = checks.check_grounded(values, sources)
    got = {r.value: r.grounded for r in out.collect()}
    assert len(got) == n and all(found == v.startswith("<") for v, found in got.items())
    # Rows that the gram index hands to the final look: about one page for each value that is there.
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
