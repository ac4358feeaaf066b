"""Rule-based extraction: nested template fill, markdown, outline."""

import json

from pyspark.sql import functions as F

from pagewright.operators import extract

PAGE = """Harbour Tide Report
By Vela Norn, Tarn Ombly
Date: day 9 of the count
Spring tide: 71%
Neap tide: 18%
Basins: north; south"""

RULES = [
    ("title", r"^([^\n]*)"),
    ("authors", r"(?:By |, )([A-Z][a-z]+ [A-Z][a-z]+)", "all"),
    ("date", r"Date: ([^\n]*)"),
    ("tide_levels.high_water.spring", r"Spring tide: ([0-9]+)%", "int"),
    ("tide_levels.high_water.neap", r"Neap tide: ([0-9]+)%", "int"),
    ("tide_levels.high_water.storm", r"Storm tide: ([0-9]+)%", "int"),
    ("summary", r"Summary: ([^\n]*)"),
]


def test_nested_template_record(spark):
    df = spark.createDataFrame([(1, PAGE)], "doc int, text string")
    rec = json.loads(extract.template_record(df, "text", RULES).first().j)
    assert list(rec) == ["title", "authors", "date", "tide_levels", "summary"]
    assert rec == {
        "title": "Harbour Tide Report",
        "authors": ["Vela Norn", "Tarn Ombly"],
        "date": "day 9 of the count",
        "tide_levels": {"high_water": {"spring": 71, "neap": 18, "storm": None}},
        "summary": "",
    }


def test_markdown_rules(spark):
    html = ('<html lang="en"><head><title>T</title><script>var x="</p>";</script></head><body>'
            '<nav><ul><li><a href="/a">A</a></li></ul></nav><!-- c --><h1>Head</h1><p>One &amp; two</p>'
            '<h3>Sub</h3><p>Three<br>four</p></body></html>')
    df = spark.createDataFrame([(html,)], "html string")
    md = df.select(extract.html_to_markdown(F.col("html"), F.lit(2)).alias("md")).first().md
    assert md == "Page 2\n\n- [A](/a)\n\n## Head\n\nOne & two\n\n### Sub\n\nThree\nfour"
    elements = extract.markdown_elements(spark.createDataFrame([(1, md)], "doc int, md string"), "md", ["doc"])
    got = [(r.line_no, r.kind, r.importance, r.section_no, r.path, r.text) for r in elements.collect()]
    assert got == [
        (1, "text", 1, 0, "", "Page 2"), (3, "list", 4, 0, "", "1"), (3, "item", 2, 0, "", "[A](/a)"), (5, "header", 6, 1, "Head", "Head"),
        (7, "text", 1, 1, "Head", "One & two"), (9, "subheader", 5, 2, "Head > Sub", "Sub"),
        (11, "text", 1, 2, "Head > Sub", "Three"), (12, "text", 1, 2, "Head > Sub", "four"),
    ]


def test_clean_markdown(spark):
    md = "## T\n![logo](x.png)\nClick here to read\n12\nPage 3\nListen to this article\nkeep"
    df = spark.createDataFrame([(md,)], "md string")
    got = df.select(extract.clean_markdown("md").alias("c")).first().c
    assert got == "## T\n\n to read\n\nkeep"


def test_page_entries_rebuild_the_assembled_record(spark):
    """The bounded form: a document's entries joined in page order give its record."""
    md = spark.createDataFrame(
        [(1, 2, "# B\n## b1"), (1, 1, "# A\n## a1\n## a2"), (1, 10, "no headings"), (2, 1, "## only sub")],
        "doc int, page_no int, md string",
    )
    entries = extract.page_entries(md, "md", "doc").collect()
    rebuilt = {}
    for r in sorted(entries, key=lambda r: (r.doc, r.page_no)):
        rebuilt.setdefault(r.doc, []).append(r.entry)
    records = {r.doc: r.record for r in extract.assemble_pages(md, "md", "doc").collect()}
    assert {d: "{" + ",".join(es) + "}" for d, es in rebuilt.items()} == records
    page = json.loads(records[1])["Page 1"]
    assert page["Header"] == "a1"
    assert [(x["Section"], x["Text"]) for x in page["Sections"]] == [("", ["# A"]), ("a1", []), ("a2", [])]
    assert json.loads(records[1])["Page 10"]["Sections"][0]["Text"] == ["no headings"]


def test_sections_carry_fields_lists_links_and_text(spark):
    md = ("Page 1\n\n## Bill of lading\nDate: 9 May\n\n### Goods\nKind: rope\nKind: tar\nSee the list:\n"
          '- two "coils"\n- [map](/m)\nAt [quay](/q) or [dock](/d)\n10:30 sharp')
    df = spark.createDataFrame([(1, 1, md)], "doc int, page_no int, md string")
    outline = extract.markdown_outline(df, "md", ["doc", "page_no"])
    got = json.loads("{" + extract.page_entries(df, "md", "doc").first().entry + "}")
    assert got == {"Page 1": {"Header": "Bill of lading", "Sections": [
        {"Section": "", "Importance": 1, "Fields": {}, "Lists": [], "Links": [], "Text": ["Page 1"], "Sections": []},
        {"Section": "Bill of lading", "Importance": 6, "Fields": {"Date": "9 May"}, "Lists": [], "Links": [], "Text": [], "Sections": [
            {"Section": "Goods", "Importance": 5, "Fields": {"Kind": ["rope", "tar"]}, "Lists": ['two "coils"', "[map](/m)"],
             "Links": [{"Text": "map", "Href": "/m"}, {"Text": "quay", "Href": "/q"}, {"Text": "dock", "Href": "/d"}],
             "Text": ["See the list:", "10:30 sharp"], "Sections": []}]},
    ]}}
    assert [(r.section_no, r.n_fields) for r in outline.orderBy("section_no").collect()] == [(0, 0), (1, 1), (2, 2)]


def plain_outline(md):
    """(section_no, level, section, parent_no, path, number of lines) by one walk over the lines."""
    out, open_no, open_title = [], None, None
    for line in md.split("\n"):
        level = 2 if line.startswith("## ") else 3 if line.startswith("### ") else 0
        if level or not out:
            no = (out[-1][0] if out else 0) + (level > 0)
            title = line.lstrip("#")[1:] if level else ""
            parent = open_no if level == 3 else None
            path = f"{open_title} > {title}" if parent is not None else title
            out.append([no, level, title, parent, path, 0])
            if level == 2:
                open_no, open_title = no, title
        out[-1][5] += 1
    return [tuple(x) for x in out]


def test_sections_nest_as_a_plain_walk_says(spark):
    import random

    rng = random.Random(6)
    lines = ["## A", "### b", "text", "", "- item", "## ", "### ", "#### deep", "# one", "##no", " ## indented", "x: y", "[l](/l)", "\r", "## C\r"]
    pages = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 25)))) for i in range(200)] + [(998, "## only"), (999, "")]
    df = spark.createDataFrame([*pages, (1000, None)], "id int, md string")
    got = {}
    for r in df.where("md is not null").select("id", F.inline(extract.markdown_sections(F.col("md")))).collect():
        got.setdefault(r.id, []).append((r.section_no, r.level, r.section, r.parent_no, r.path, len(r.lines)))
    assert got == {i: plain_outline(md) for i, md in pages}
    outline = extract.markdown_outline(df, "md", ["id"])
    assert outline.count() == sum(len(plain_outline(md)) for _, md in pages)
    assert "Exchange" not in outline._jdf.queryExecution().executedPlan().toString()


MARKUP_CASES = [
    ("<table><tr><th>Qty</th><th>Price</th></tr><tr><td>12</td> <td class=n>34</td></tr></table>", "Qty | Price\n\n12 | 34"),
    ("<H1>Up</H1>next<P>par</P><UL><LI>one</LI></UL>", "## Up\n\nnext\n\npar\n\n- one"),
    ('<a class="b" href="/x">go</a> <A HREF=\'/y\' id=1>on</A> <abbr href="/z">no</abbr>', "[go](/x) [on](/y) no"),
    ("&#233;&#xE9;&#x1F600; &#39;q&#39; &amp;#65; &#38;lt; &#0;&#xD800;", "\u00e9\u00e9\U0001f600 'q' &#65; &lt; &#0;&#xD800;"),
    ("<header>top</header><head><title>t</title></head>x", "top\n\nx"),
]


def test_markup_cases_in_spark_and_in_the_oracle(spark):
    import duckdb

    from pagewright.plans.oracle_views import html_to_markdown_sql

    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(MARKUP_CASES)], "i int, html string")
    got = {r.i: r.md for r in df.select("i", extract.html_to_markdown(F.col("html")).alias("md")).collect()}
    for i, (html, want) in enumerate(MARKUP_CASES):
        assert got[i] == want
        sql = f"SELECT {html_to_markdown_sql('html', None)} FROM (SELECT ?::VARCHAR AS html)"
        assert duckdb.execute(sql, [html]).fetchone()[0] == want
