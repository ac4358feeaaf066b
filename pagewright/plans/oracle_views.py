"""The derived views of ``plans/views.py`` stated in DuckDB SQL.

Used by ``oracle_sql()``: each oracle query is ``WITH <views it needs> <body>``
over the driver's pre-registered tables.  Patterns are valid in Java and RE2;
DuckDB writes back-references as ``\\1`` and needs the ``'g'`` flag.
"""

from __future__ import annotations

NL = "chr(10)"


def _sql_str(s: str) -> str:
    """A SQL string expression for a Python string (newlines via chr(10))."""
    parts = s.split("\n")
    quoted = ["'" + p.replace("'", "''") + "'" for p in parts]
    return f" || {NL} || ".join(quoted)


# The markup rules, stated here on their own (nothing is imported from the
# operators): each step is (pattern, replacement) for a global regexp_replace.
_DROPPED = [r"(?is)<head>.*?</head>", r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>",
            r"(?s)<!--.*?-->"]
_BLOCKS = ["div", "ul", "ol", "nav", "article", "section", "header", "footer", "main", "table", "blockquote"]
_ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "nbsp": " ", "copy": "©", "middot": "·"}
_SQUEEZE = [("[ \\t]+\\n", "\n"), ("\\n{3,}", "\n\n"), ("\\A\\n+|\\n+\\z", "")]
_MARKUP = (
    [(p, "") for p in _DROPPED]
    + [(f"(?i)<h{n}( [^>]*)?>", "\n\n" + ("##" if n < 3 else "###") + " ") for n in range(1, 7)]
    + [("(?i)</h[1-6]>", "\n\n"), ("(?i)<li( [^>]*)?>", "\n- ")]
    + [(f"(?i)<a( [^>]*)? href={q}([^{q}]*){q}[^>]*>([^<]*)</a>", "[\\3](\\2)") for q in "\"'"]
    + [("(?i)<br */?>", "\n"), ("(?i)</?p( [^>]*)?>", "\n\n"),
       ("(?i)</t[dh]>[\\s]*<t[dh]( [^>]*)?>", " | "), ("(?i)</?tr( [^>]*)?>", "\n")]
    + [(f"(?i)</?{tag}( [^>]*)?>", "\n\n") for tag in _BLOCKS]
    + [("<[^>]+>", "")]
)


def regex_chain(expr: str, rules) -> str:
    for pattern, repl in rules:
        expr = f"regexp_replace({expr}, {_sql_str(pattern)}, {_sql_str(repl)}, 'g')"
    return expr


def html_to_markdown_sql(html: str, page_no: str | None) -> str:
    """The markup-to-markdown rules in SQL."""
    e = regex_chain(html, _MARKUP)
    for name, char in _ENTITIES.items():
        e = f"replace({e}, '&{name};', {_sql_str(char)})"
    # Numeric entities: every distinct one replaced by its character.
    number = ("CASE WHEN lower(n[1]) = 'x' THEN CAST('0x' || n[2:] AS BIGINT) ELSE CAST(n AS BIGINT) END")
    e = (f"(SELECT list_reduce(list_prepend(t, list_distinct(regexp_extract_all(t, '&#([xX][0-9a-fA-F]{{1,6}}|[0-9]{{1,7}});', 1))), "
         f"lambda acc, n: CASE WHEN {number} IN (0, 38) OR {number} > 1114111 OR {number} BETWEEN 55296 AND 57343 THEN acc "
         f"ELSE replace(acc, '&#' || n || ';', chr(CAST({number} AS INTEGER))) END) FROM (SELECT {e} AS t))")
    e = regex_chain(e, [("&(amp|#38|#[xX]26);", "&"), *_SQUEEZE])
    if page_no is not None:
        e = f"'Page ' || CAST({page_no} AS VARCHAR) || {NL} || {NL} || {e}"
    return e


def clean_markdown_sql(md: str) -> str:
    """The markdown cleaner's rules in SQL: image links, two phrases, lines that are a page number."""
    removed = [r"!\[[^\]]*\]\([^)]*\)", "(?i)click here", "(?i)listen to this article",
               r"(?m)^[ \t]*(Page[ \t]+)?[0-9]+[ \t]*$"]
    return regex_chain(md, [(p, "") for p in removed] + _SQUEEZE)


def truthy_sql(v: str) -> str:
    """SQL twin of ``jsonfn.is_truthy_json`` on minified JSON text."""
    return (
        f"({v} IS NOT NULL AND {v} NOT IN ('null', '\"\"', 'false', '[]', '{{}}') "
        f"AND coalesce(try_cast({v} AS DOUBLE) <> 0, true))"
    )


VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "text_pages": ((), f"""
        SELECT doc_id, CAST(p + 1 AS BIGINT) AS page_no,
               array_to_string(list_slice(lines, p * 10 + 1, p * 10 + 10), {NL}) AS text
        FROM (SELECT doc_id, lines, unnest(range(0, CAST(ceil(len(lines) / 10.0) AS BIGINT))) AS p
              FROM (SELECT doc_id, string_split(text, {NL}) AS lines FROM documents WHERE text IS NOT NULL))"""),
    "page_names": (("text_pages",), """
        SELECT doc_id, page_no, 'Page_' || CAST(page_no AS VARCHAR) || '.jpeg' AS name FROM text_pages"""),
    "binder_pages": ((), """
        SELECT CAST(page_id // 5 AS BIGINT) AS doc, CAST(page_id % 5 + 1 AS BIGINT) AS page_no,
               page_id, html, url FROM pages"""),
    "binder_fields": (("binder_pages",), """
        SELECT doc, page_no, page_id,
               CASE WHEN page_id % 3 = 2 THEN '' ELSE coalesce(regexp_extract(html, '<title>([^<]*)</title>', 1), '') END AS title,
               coalesce(regexp_extract(html, '<html lang="([^"]*)"', 1), '') AS lang,
               coalesce(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '') AS h1,
               CAST((length(html) - length(replace(html, '<p>', ''))) // 3 AS BIGINT) AS n_paragraphs
        FROM binder_pages"""),
    "flat_batch_json": (("binder_fields",), """
        SELECT doc, batch_no,
               json_object('title', arg_min(title, page_no), 'lang', arg_max(lang, page_no),
                           'h1', arg_min(h1, page_no), 'n_paragraphs', sum(n_paragraphs),
                           'stats', json_object('pages', count(*)))::VARCHAR AS j
        FROM (SELECT *, CAST((page_no - 1) // 2 + 1 AS BIGINT) AS batch_no FROM binder_fields)
        GROUP BY doc, batch_no"""),
    # Entries as (key, text of the value); "j" is put together from the same texts.
    "batch_kv": (("binder_fields",), """
        SELECT doc, batch_no, unnest([1, 2, 3, 4, 5, 6, 7]) AS pos,
               unnest(['title', 'lang', 'h1', 'n_paragraphs', 'stats', 'ids', 'part_' || batch_no]) AS key,
               unnest([to_json(title)::VARCHAR, to_json(lang)::VARCHAR, to_json(h1)::VARCHAR, n::VARCHAR,
                       '{"pages":' || pages || ',"mean":' || CAST(n / 2.0 AS DECIMAL(18, 1)) || '}',
                       '[' || first_id || ',' || last_id || ']', n || '.50']) AS value
        FROM (SELECT doc, batch_no, arg_min(title, page_no) AS title, arg_max(lang, page_no) AS lang,
                     arg_min(h1, page_no) AS h1, sum(n_paragraphs) AS n, count(*) AS pages,
                     min(page_id) AS first_id, max(page_id) AS last_id
              FROM (SELECT *, CAST((page_no - 1) // 2 + 1 AS BIGINT) AS batch_no FROM binder_fields)
              GROUP BY doc, batch_no)"""),
    "nested_replies": (("binder_fields",), """
        SELECT doc, batch_no,
               '{"document":{"title":' || to_json(title)::VARCHAR || ',"lang":' || to_json(lang)::VARCHAR
               || CASE WHEN doc % 3 = 0 THEN ',"author":"A"' ELSE '' END || CASE WHEN batch_no = 3 THEN ',"lang":null' ELSE '' END
               || '},"stats":' || CASE doc % 4
                    WHEN 0 THEN '{"pages":' || pages || ',"mean":1.50,"range":{"first":' || first_id || ',"last":' || last_id || '}}'
                    WHEN 1 THEN '{"pages":"' || pages || '","mean":2}'
                    WHEN 2 THEN '""'
                    ELSE '{"pages":' || pages || ',"mean":-1e2,"range":{"first":' || first_id || ',"last":' || last_id || ',"step":1}}' END
               || ',"sheets":[{"id":' || first_id || ',"heading":' || to_json(h1)::VARCHAR || '},{"id":' || last_id || '}],"notes":'
               || CASE WHEN batch_no % 2 = 1 THEN '["a [b]",1,null]' ELSE '[]' END
               || CASE WHEN batch_no = 3 THEN ',"extra.1":{"deep":[1,{"x":true}]}' ELSE '' END || '}' AS j
        FROM (SELECT doc, batch_no, arg_min(title, page_no) AS title, arg_max(lang, page_no) AS lang, arg_min(h1, page_no) AS h1,
                     count(*) AS pages, min(page_id) AS first_id, max(page_id) AS last_id
              FROM (SELECT *, CAST((page_no - 1) // 2 + 1 AS BIGINT) AS batch_no FROM binder_fields)
              GROUP BY doc, batch_no)"""),
    # All values of the nested replies: path without array positions, the object or array above, the kind.
    "nested_nodes": (("nested_replies",), r"""
        SELECT r.doc, r.batch_no, t.id, t.parent,
               CASE WHEN t.parent IS NULL THEN '$' ELSE regexp_replace(substr(t.fullkey, 3), '\[[0-9]+\]', '[]', 'g') END AS path,
               t.key, CASE t.type WHEN 'VARCHAR' THEN 'string' WHEN 'UBIGINT' THEN 'number' WHEN 'BIGINT' THEN 'number'
                                  WHEN 'DOUBLE' THEN 'number' ELSE lower(t.type) END AS kind, t.value::VARCHAR AS value
        FROM nested_replies r, json_tree(r.j) t"""),
    "dirty_replies": ((), f"""
        SELECT event_id,
               CASE event_id % 5
                 WHEN 0 THEN '```json' || {NL} || props || {NL} || '```'
                 WHEN 1 THEN props
                 WHEN 2 THEN '```json' || {NL} || props || {NL} || '```' || {NL} || 'Done.'
                 WHEN 3 THEN '```json' || {NL} || substring(props, 1, length(props) - 1)
                 ELSE '' END AS r,
               CAST(length(props) * 10 + user_id AS BIGINT) AS prompt_tokens,
               CAST(round(value * 100) AS BIGINT) AS completion_tokens
        FROM events"""),
    "reply_envelopes": (("dirty_replies",), """
        SELECT event_id,
               json_object('choices', CASE WHEN r = '' THEN json('[]')
                                           ELSE json_array(json_object('message', json_object('content', r))) END,
                           'usage', json_object('prompt_tokens', prompt_tokens,
                                                'completion_tokens', completion_tokens,
                                                'total_tokens', prompt_tokens + completion_tokens))::VARCHAR AS reply
        FROM dirty_replies"""),
    "usage_log": ((), """
        SELECT c.conv_id AS doc, CASE WHEN c.turn % 4 = 1 THEN 'vision' ELSE 'text' END AS model,
               CAST(row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn) AS BIGINT) AS request_no,
               CAST(ceil(coalesce(length(p.text), 0) / 4.0) AS BIGINT) AS prompt_tokens,
               CAST(ceil(length(c.text) / 4.0) AS BIGINT) AS completion_tokens
        FROM conversations c
        LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1
        WHERE c.role = 'assistant'"""),
    "doc_stats": ((), """
        SELECT conv_id AS doc, CAST(sum(length(text)) AS DOUBLE) / 10.0 AS processing_seconds,
               CAST(count(*) AS BIGINT) AS num_pages
        FROM conversations GROUP BY conv_id"""),
    "image_dims": (("binder_pages",), """
        SELECT page_id, doc, page_no, CAST(600 + (length(html) * 37) % 1500 AS BIGINT) AS width,
               CAST(800 + (length(html) * 53) % 1700 AS BIGINT) AS height FROM binder_pages"""),
    "markdown_pages": (("binder_pages",), f"""
        SELECT doc, page_no, {html_to_markdown_sql('html', 'page_no')} AS md FROM binder_pages"""),
}


def with_views(names, body: str, extra=(), recursive: bool = False) -> str:
    """``WITH`` clause holding the named views (and what they use), then the
    query-specific CTEs ``extra`` (``[(name, sql), ...]``), then ``body``."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for dep in VIEWS[n][0]:
            visit(dep)
        order.append(n)

    for n in names:
        visit(n)
    ctes = [f"{n} AS ({VIEWS[n][1]}\n)" for n in order] + [f"{n} AS ({sql}\n)" for n, sql in extra]
    if not ctes:
        return body.strip()
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(ctes) + "\n" + body.strip()
