"""Rule-based extraction steps that stand in for the hosted model.

The reference asks a vision or text model to fill a template, to turn page
images into markdown, to clean markdown, and to outline a document.  Here the
same data contracts are met by deterministic rules on page text or markup
(``regexp_*`` chains, all JVM-side).  These rules do not claim a model's
accuracy; a caller with a model passes it to ``model.call_model`` instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.jsonfn import compute_once

# The markdown rules say headings start with "##" or "###",
# never a single "#", and the page number is marked on top.
PAGE_MARK = "Page "
# Entities decoded by the markup-to-markdown rules, then numeric ones, then "&".
HTML_ENTITIES = [
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&nbsp;", " "),
    ("&copy;", "©"),
    ("&middot;", "·"),
]
AMPERSAND = r"&(amp|#38|#[xX]26);"
NUMERIC_ENTITY = r"&#([xX][0-9a-fA-F]{1,6}|[0-9]{1,7});"
# Markup-to-markdown rules, applied in order (Java replacement syntax).
MARKUP_RULES = [
    (r"(?si)<head>.*?</head>", ""),
    (r"(?si)<script[^>]*>.*?</script>", ""),
    (r"(?si)<style[^>]*>.*?</style>", ""),
    (r"(?s)<!--.*?-->", ""),
    (r"(?i)<h[12]( [^>]*)?>", "\n\n## "),
    (r"(?i)<h[3-6]( [^>]*)?>", "\n\n### "),
    (r"(?i)</h[1-6]>", "\n\n"),
    (r"(?i)<li( [^>]*)?>", "\n- "),
    (r'(?i)<a( [^>]*)? href="([^"]*)"[^>]*>([^<]*)</a>', "[$3]($2)"),
    (r"(?i)<a( [^>]*)? href='([^']*)'[^>]*>([^<]*)</a>", "[$3]($2)"),
    (r"(?i)<br */?>", "\n"),
    (r"(?i)</?p( [^>]*)?>", "\n\n"),
    (r"(?i)</t[dh]>\s*<t[dh]( [^>]*)?>", " | "),
    (r"(?i)</?tr( [^>]*)?>", "\n"),
    (r"(?i)</?(div|ul|ol|nav|article|section|header|footer|main|table|blockquote)( [^>]*)?>", "\n\n"),
    (r"<[^>]+>", ""),
]
# What the markdown cleaner removes (the reference lists images, "click
# here", "Listen to this article", page numbers and logos).  "(?d)" makes
# only "\n" end a line in Java, as in RE2 (the SQL twin drops the flag).
CLEAN_PATTERNS = [
    r"!\[[^\]]*\]\([^)]*\)",
    r"(?i)click here",
    r"(?i)listen to this article",
    r"(?dm)^[ \t]*(Page[ \t]+)?[0-9]+[ \t]*$",
]


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def count_occurrences(text: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a literal in a text."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / F.lit(len(needle))).cast("bigint")


def fill_template(df: DataFrame, source_col: str, rules: Sequence[tuple[str, str]],
                  missing: str = "") -> DataFrame:
    """Fill every template key from the source text by its rule.

    ``rules`` is ``[(key, regex with one group), ...]``; all keys are always
    present, a key whose rule finds nothing gets ``missing`` ("" as the
    reference's template defaults).  One projection, no shuffle.
    """
    cols = [
        F.coalesce(F.regexp_extract(F.col(source_col), pattern, 1), F.lit(missing)).alias(key)
        for key, pattern in rules
    ]
    return df.select("*", *cols)


def _rule_value(source: Column, pattern: str, kind: str) -> Column:
    if kind == "all":  # every match: a list value (e.g. authors)
        return F.regexp_extract_all(source, F.lit(pattern), 1)
    first = F.regexp_extract(source, pattern, 1)
    if kind == "int":  # a number, NULL (JSON null) when not found
        return first.try_cast("bigint")
    return F.coalesce(first, F.lit(""))


def template_record(df: DataFrame, source_col: str, rules: Sequence[tuple], out: str = "j") -> DataFrame:
    """Fill a nested template by rule and write it as one JSON object per row.

    ``rules``: ``(path, pattern)`` or ``(path, pattern, kind)`` in template
    order; ``path`` is dotted for nested objects (``survey.savings.total``);
    ``kind`` is ``one`` (string, ``""`` when not found), ``all`` (list of every
    match) or ``int``.  Keys keep template order at every level.
    """
    tree: dict = {}
    for rule in rules:
        path, pattern = rule[0], rule[1]
        kind = rule[2] if len(rule) > 2 else "one"
        node = tree
        *parents, leaf = path.split(".")
        for p in parents:
            node = node.setdefault(p, {})
        node[leaf] = _rule_value(F.col(source_col), pattern, kind)

    def build(node: dict) -> Column:
        return F.struct(*[(build(v) if isinstance(v, dict) else v).alias(k) for k, v in node.items()])

    return df.withColumn(out, F.to_json(build(tree), {"ignoreNullFields": "false"}))


def fields_to_json(df: DataFrame, keys: Sequence[str], out: str = "j") -> DataFrame:
    """One JSON object per row from the given columns, in the given order."""
    return df.withColumn(out, F.to_json(F.struct(*[F.col(k) for k in keys])))


def _replace_all(c: Column, rules: Sequence[tuple[str, str]]) -> Column:
    for pattern, repl in rules:
        c = F.regexp_replace(c, pattern, repl)
    return c


def _numeric_entities(text: Column) -> Column:
    """``&#n;`` and ``&#xh;`` decoded; what is no character, or "&", stays as it is."""
    def char(code: Column) -> Column:
        is_hex = F.lower(F.substring(code, 1, 1)) == "x"
        digits = F.when(is_hex, F.upper(code.substr(F.lit(2), F.length(code)))).otherwise(F.hex(code.try_cast("bigint")))
        point = F.conv(digits, 16, 10).cast("bigint")
        good = (point > 0) & (point < 0x110000) & ~point.between(0xD800, 0xDFFF) & (point != 38)
        return F.when(good, F.decode(F.unhex(F.lpad(digits, 8, "0")), "UTF-32"))

    def decode(t: Column) -> Column:
        codes = F.array_distinct(F.regexp_extract_all(t, F.lit(NUMERIC_ENTITY), 1))
        return F.aggregate(codes, t, lambda done, code: F.coalesce(
            F.replace(done, F.concat(F.lit("&#"), code, F.lit(";")), char(code)), done))

    # A one-element array computes the text once for both uses.
    return F.transform(F.array(text), decode)[0]


def html_to_markdown(html: Column, page_no: Column | None = None) -> Column:
    """Markdown of one page of markup, by rule.

    Head, scripts, styles and comments are dropped; h1/h2 become ``##``,
    h3-h6 ``###``; list items ``- ``; links ``[text](href)``; paragraphs and
    breaks become blank lines / newlines; a table row is a line, its cells
    parted by `` | ``; other tags are dropped, common and numeric entities
    decoded; runs of blank lines are squeezed.  Tags match in either case.
    ``Page <n>`` is put on top when ``page_no`` is given.
    """
    c = _replace_all(html, MARKUP_RULES)
    for entity, char in HTML_ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    c = F.regexp_replace(_numeric_entities(c), AMPERSAND, "&")
    c = _replace_all(c, [(r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n"), (r"\A\n+|\n+\z", "")])
    if page_no is not None:
        c = F.concat(F.lit(PAGE_MARK), page_no.cast("string"), F.lit("\n\n"), c)
    return c


def clean_markdown(md: Column | str) -> Column:
    """Remove image links (logos included), "click here", "Listen to this
    article" and page-number lines, then squeeze blank lines.

    Opt-in: the reference switched its model-based cleaner off because it
    removed too much.
    """
    c = _c(md)
    for pattern in CLEAN_PATTERNS:
        c = F.regexp_replace(c, pattern, "")
    return _replace_all(c, [(r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n"), (r"\A\n+|\n+\z", "")])


def json_string(col: Column | str) -> Column:
    """A string as a JSON string literal (quoted and escaped)."""
    return F.to_json(_c(col).cast("variant"))


# A "Label: value" line; patterns valid in Java and RE2 alike.
FIELD_LINE = r"(?s)^(\p{L}[^:]{0,59}):[ \t]+(.+)\z"
LINK = r"\[([^\]]*)\]\(([^)]*)\)"


def line_kind(line: Column) -> Column:
    """Kind of a markdown line: header, subheader, list, link, field (``Label: value``), text or blank."""
    return (
        F.when(line.rlike(r"^## "), F.lit("header"))
        .when(line.rlike(r"^### "), F.lit("subheader"))
        .when(line.rlike(r"^[-*] "), F.lit("list"))
        .when(line.rlike(r"\[[^\]]*\]\([^)]*\)"), F.lit("link"))
        .when(F.trim(line) == "", F.lit("blank"))
        .when(line.rlike(FIELD_LINE), F.lit("field"))
        .otherwise(F.lit("text"))
    )


def _json_list(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def _fields_json(fields: Column) -> Column:
    """``{"label": "value"}`` in order of first sighting; a repeated label holds the list of its values."""
    def entry(label: Column) -> Column:
        values = F.transform(F.filter(fields, lambda f: f["label"] == label), lambda f: json_string(f["value"]))
        text = F.when(F.size(values) == 1, F.element_at(values, 1)).otherwise(_json_list(values))
        return F.concat(json_string(label), F.lit(":"), text)

    labels = F.array_distinct(F.transform(fields, lambda f: f["label"]))
    return F.concat(F.lit("{"), F.array_join(F.transform(labels, entry), ","), F.lit("}"))


# How much an element of a page matters: headings before lists, a list before its items, all before plain text.
IMPORTANCE = {"header": 6, "subheader": 5, "list": 4, "field": 3, "link": 3, "item": 2, "text": 1}
SECTION_START = r"\n(?=###? )"


def markdown_sections(md: Column) -> Column:
    """The sections of a page in order: ``array<struct<section_no, level, section, parent_no, path, start, lines>>``.

    A section is a heading with the lines up to the next one; what stands
    before the first heading is section 0 (``level`` 0, no heading).  One
    ``aggregate`` over the sections keeps the open header: a subheader's
    ``parent_no`` is that header's number (NULL for headers, and for subheaders
    without a header above), and ``path`` the headings from the top down, parted
    by " > ".  ``start`` is the section's first line (from 1), ``lines`` its
    lines as ``struct<line, kind>``.  All inside the page's row.
    """
    def read(piece: Column) -> Column:
        def line(x: Column) -> Column:
            return F.struct(x.alias("line"), line_kind(x).alias("kind"))

        return F.transform(F.split(piece, "\n", -1), line)

    def heading(lines: Column) -> Column:
        return F.regexp_replace(lines[0]["line"], r"^#+ ", "")

    zero = F.struct(
        F.lit(1).cast("bigint").alias("line"), F.lit(0).cast("bigint").alias("no"), F.lit(None).cast("bigint").alias("open"),
        F.lit(None).cast("string").alias("title"),
        F.array().cast("array<struct<no:bigint,parent:bigint,path:string,start:bigint>>").alias("out"))

    def step(acc: Column, lines: Column) -> Column:
        kind = lines[0]["kind"]
        is_sub = kind == "subheader"
        no = acc["no"] + F.when(kind.isin("header", "subheader"), 1).otherwise(0)
        path = F.when(is_sub, F.concat_ws(" > ", acc["title"], heading(lines))).when(kind == "header", heading(lines)).otherwise(F.lit(""))
        here = F.struct(no.alias("no"), F.when(is_sub, acc["open"]).alias("parent"), path.alias("path"), acc["line"].alias("start"))
        return F.struct(
            (acc["line"] + F.size(lines)).alias("line"), no.alias("no"), F.when(kind == "header", no).otherwise(acc["open"]).alias("open"),
            F.when(kind == "header", heading(lines)).otherwise(acc["title"]).alias("title"), F.concat(acc["out"], F.array(here)).alias("out"))

    def number(pieces: Column) -> Column:
        placed = F.aggregate(pieces, zero, step, lambda acc: acc["out"])

        def joined(at: Column) -> Column:
            def one(lines: Column, i: Column) -> Column:
                kind = lines[0]["kind"]
                level = F.when(kind == "header", 2).when(kind == "subheader", 3).otherwise(0).cast("bigint")
                p = F.get(at, i)
                return F.struct(p["no"].alias("section_no"), level.alias("level"), F.when(level > 0, heading(lines)).otherwise(F.lit("")).alias("section"),
                                p["parent"].alias("parent_no"), p["path"].alias("path"), p["start"].alias("start"), lines.alias("lines"))

            return F.transform(pieces, one)

        return F.flatten(F.transform(F.array(placed), joined))

    pieces = F.transform(F.split(md, SECTION_START, -1), read)
    return F.flatten(F.transform(F.array(pieces), number))


def _links(line: Column) -> Column:
    return F.arrays_zip(
        F.regexp_extract_all(line, F.lit(LINK), 1).alias("t"), F.regexp_extract_all(line, F.lit(LINK), 2).alias("h"))


def _summary(s: Column) -> Column:
    """A section's counts and its content as JSON, up to the closing brace."""
    def of_kind(kind: str) -> Column:
        return F.transform(F.filter(s["lines"], lambda x: x["kind"] == kind), lambda x: x["line"])

    def field(line: Column) -> Column:
        return F.struct(F.regexp_extract(line, FIELD_LINE, 1).alias("label"), F.regexp_extract(line, FIELD_LINE, 2).alias("value"))

    def count(kind: str) -> Column:
        return F.size(of_kind(kind)).cast("bigint")

    lists = F.transform(of_kind("list"), lambda x: json_string(F.regexp_replace(x, r"^[-*] ", "")))
    links = F.transform(F.flatten(F.transform(s["lines"], lambda x: _links(x["line"]))), lambda x: F.concat(
        F.lit('{"Text":'), json_string(x["t"]), F.lit(',"Href":'), json_string(x["h"]), F.lit("}")))
    weight = F.when(s["level"] == 2, F.lit(IMPORTANCE["header"])).when(s["level"] == 3, F.lit(IMPORTANCE["subheader"])).otherwise(
        F.lit(IMPORTANCE["text"])).cast("bigint")
    content = F.concat(
        F.lit('{"Section":'), json_string(s["section"]), F.lit(',"Importance":'), weight.cast("string"),
        F.lit(',"Fields":'), _fields_json(F.transform(of_kind("field"), field)),
        F.lit(',"Lists":'), _json_list(lists), F.lit(',"Links":'), _json_list(links),
        F.lit(',"Text":'), _json_list(F.transform(of_kind("text"), json_string)))
    chars = F.aggregate(s["lines"], F.lit(0).cast("bigint"), lambda n, x: n + F.when(
        x["kind"].isin("list", "link", "field", "text"), F.length(x["line"])).otherwise(0))
    return F.struct(
        s["section_no"].alias("section_no"), s["section"].alias("section"), s["level"].alias("level"),
        s["parent_no"].alias("parent_no"), s["path"].alias("path"), weight.alias("importance"),
        count("list").alias("n_lists"), count("link").alias("n_links"), count("field").alias("n_fields"),
        count("text").alias("n_text"), chars.alias("n_chars"), content.alias("content"))


def _summaries(df: DataFrame, md_col: str, key_cols: Sequence[str]) -> DataFrame:
    """``(keys..., _s)``: the sections of a page as one array, put together in its row."""
    staged = df.select(*key_cols, markdown_sections(F.col(md_col)).alias("_sections"))
    return compute_once(staged, _s=F.transform("_sections", _summary)).drop("_sections")


def markdown_outline(df: DataFrame, md_col: str, key_cols: Sequence[str]) -> DataFrame:
    """Outline per page and section: its place, its content, and counts of lists, links, fields and text lines.

    Output ``(keys..., section_no, section, level, parent_no, path, importance,
    n_lists, n_links, n_fields, n_text, n_chars, content)``; headers rank above
    subheaders (``level`` 2 / 3, 0 before the first heading), ``parent_no`` and
    ``path`` as in ``markdown_sections``, ``importance`` from ``IMPORTANCE``.
    ``content`` is the section as JSON: ``{"Section": heading, "Importance": n,
    "Fields": {label: value}, "Lists": [...], "Links": [{"Text", "Href"}],
    "Text": [...]}``, in line order; ``Links`` holds the links of every line.
    The lines are folded inside the page's row: nothing is shuffled.
    """
    out = _summaries(df, md_col, key_cols).select(*key_cols, F.inline("_s"))
    return out.withColumn("content", F.concat("content", F.lit("}")))


def markdown_elements(df: DataFrame, md_col: str, key_cols: Sequence[str]) -> DataFrame:
    """Every element of a page with its weight: ``(keys..., line_no, kind, importance, section_no, path, text)``.

    Kinds are those of ``IMPORTANCE``: a run of list lines is a ``list`` (its
    text is the number of items) followed by its items.  Blank lines are no
    elements.  Inside the page's row, as the outline.
    """
    weights = F.create_map(*[F.lit(x) for kv in IMPORTANCE.items() for x in kv])

    def element(s: Column, i: Column, kind: Column, text: Column) -> Column:
        return F.struct((s["start"] + i).alias("line_no"), kind.alias("kind"), F.try_element_at(weights, kind).cast("bigint").alias("importance"),
                        s["section_no"].alias("section_no"), s["path"].alias("path"), text.alias("text"))

    def of_section(s: Column) -> Column:
        lines = s["lines"]
        listed = F.transform(lines, lambda x: x["kind"] == "list")

        def of_line(x: Column, i: Column) -> Column:
            is_item = x["kind"] == "list"
            first = is_item & ~F.coalesce(F.get(listed, i - 1), F.lit(False))
            after = F.slice(listed, i + 1, F.size(listed))
            run = F.when(F.array_position(after, False) > 0, F.array_position(after, False) - 1).otherwise(F.size(after))
            kind = F.when(is_item, F.lit("item")).otherwise(x["kind"])
            text = F.when(is_item, F.regexp_replace(x["line"], r"^[-*] ", "")).when(
                kind.isin("header", "subheader"), F.regexp_replace(x["line"], r"^#+ ", "")).otherwise(x["line"])
            one = F.array(element(s, i, kind, text))
            return F.when(first, F.concat(F.array(element(s, i, F.lit("list"), run.cast("string"))), one)).when(x["kind"] != "blank", one)

        return F.flatten(F.filter(F.transform(lines, of_line), lambda e: e.isNotNull()))

    staged = df.select(*key_cols, markdown_sections(F.col(md_col)).alias("_sections"))
    staged = compute_once(staged, _e=F.flatten(F.transform("_sections", of_section)))
    return staged.select(*key_cols, F.inline("_e"))


def page_entries(df: DataFrame, md_col: str, doc_col: str, page_col: str = "page_no", out: str = "entry") -> DataFrame:
    """One ``"Page n": {"Header": h, "Sections": [...]}`` entry per page of markdown.

    ``Header`` is the page's first heading (``""`` if none).  ``Sections`` lists
    the page's sections with their content, the lines before the first heading
    (section 0) first when there is anything in them; a header's subheaders
    stand in its own ``"Sections"``.  Built inside the page's row.
    """
    def nested(all_sections: Column) -> Column:
        def children(s: Column) -> Column:
            below = F.filter(all_sections, lambda c: c["parent_no"] == s["section_no"])
            return _json_list(F.transform(below, lambda c: F.concat(c["content"], F.lit(',"Sections":[]}'))))

        top = F.filter(all_sections, lambda s: s["parent_no"].isNull() & ((s["section_no"] > 0) | (s["n_chars"] > 0)))
        return _json_list(F.transform(top, lambda s: F.concat(s["content"], F.lit(',"Sections":'), children(s), F.lit("}"))))

    first = F.filter("_s", lambda s: s["section_no"] == 1)
    header = F.coalesce(F.get(F.transform(first, lambda s: s["section"]), F.lit(0)), F.lit(""))
    body = F.concat(F.lit('{"Header":'), json_string(header), F.lit(',"Sections":'), nested(F.col("_s")), F.lit("}"))
    entry = F.concat(F.lit('"Page '), F.col(page_col).cast("string"), F.lit('":'), body)
    return _summaries(df, md_col, [doc_col, page_col]).where(F.col("_s").isNotNull()).select(doc_col, page_col, entry.alias(out))


def assemble_pages(df: DataFrame, md_col: str, doc_col: str, page_col: str = "page_no", out: str = "record") -> DataFrame:
    """One JSON object per document: ``{"Page n": {...}, ...}`` in page order, from its pages of markdown.

    The record is one row per document by definition; for documents too large
    for one row keep ``page_entries`` (one row per page) instead.
    """
    e = page_entries(df, md_col, doc_col, page_col, "_entry")
    g = e.groupBy(doc_col).agg(
        F.array_sort(F.collect_list(F.struct(F.col(page_col).alias("p"), F.col("_entry").alias("e")))).alias("_e")
    )
    return g.select(doc_col, F.concat(F.lit("{"), F.array_join(F.transform("_e", lambda x: x["e"]), ","), F.lit("}")).alias(out))


def infer_shape(df: DataFrame, json_col: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """Common shape of JSON replies (the "generate a schema" step without a template).

    ``schema_of_variant_agg`` over the parsed replies, per group or overall.
    """
    parsed = F.try_parse_json(F.col(json_col))
    agg = F.schema_of_variant_agg(parsed).alias("shape")
    return df.groupBy(*group_cols).agg(agg, F.count(F.lit(1)).alias("n_replies"))
