"""Filling a template from the template alone: its keys are matched to the labels of a page.

A page's ``Label: value`` lines (``Label | value`` too; list marks and ``**`` do
not count) are aligned with the template's leaves.  Labels and keys are brought
to one form: words of letters and digits in lower case, ``camelCase`` and
``snake_case`` taken apart, words sorted.  A leaf may be named by its key alone or
with the keys above it; a label may stand for itself or for itself under its
heading.

* Blocking: a name is scored only against labels it shares a padded bigram
  with.  Names that differ in at most a quarter of their characters always
  share one, so nothing above the threshold is lost.
* Score: one minus the edit distance over the longer length.
* Assignment: pairs are taken from the best down, each leaf and each line once
  (a pair is taken when it is the best that both still have).  Ties go to the
  name with more words, then to the earlier line, then to the earlier key.

The template is a literal, a page is one row: no join and no shuffle.  Records
of a document's pages are merged by ``combine.combine_last_non_empty``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.jsonfn import compute_once
from pagewright.operators.extract import json_string, markdown_sections

THRESHOLD = 0.75  # of similarity; the blocking is lossless down to this
LABEL_LINE = r"(?s)^(\p{L}[^:|]{0,59}?)\s*(?::[ \t]+|\|)\s*(.*?)\s*\|?\s*\z"


def _name(words: str) -> str:
    parts = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", words)
    return " ".join(sorted(re.findall(r"[^\W_]+", parts.lower())))


def _bigrams(name: str) -> list[str]:
    padded = f"^{name}$"
    return sorted({padded[i:i + 2] for i in range(len(padded) - 1)})


def label_name(label: Column) -> Column:
    """The form that labels and keys are compared in."""
    parts = F.lower(F.regexp_replace(label, r"([\p{Ll}0-9])(\p{Lu})", "$1 $2"))
    return F.array_join(F.array_sort(F.regexp_extract_all(parts, F.lit(r"[\p{L}\p{N}]+"), 0)), " ")


def label_bigrams(name: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.concat(F.lit("^"), name, F.lit("$")), F.lit("(?s)(?=(..))"), 1))


def template_leaves(template: str | dict) -> list[tuple[tuple[str, ...], str]]:
    """``(keys, kind)`` of what can be filled: scalars (``string``, ``number``, ``boolean``) and lists (``strings``, ``numbers``)."""
    out: list[tuple[tuple[str, ...], str]] = []

    def kind_of(v) -> str:
        if isinstance(v, bool):
            return "boolean"
        return "number" if isinstance(v, (int, float)) else "string"

    def visit(keys, value):
        if isinstance(value, dict):
            for k, v in value.items():
                visit((*keys, k), v)
        elif isinstance(value, list):
            out.append((keys, "numbers" if value and kind_of(value[0]) == "number" else "strings"))
        else:
            out.append((keys, kind_of(value)))

    visit((), json.loads(template) if isinstance(template, str) else template)
    return out


def page_labels(md: Column) -> Column:
    """``array<struct<line_no, name, under, value>>``: the label lines of a page; ``under`` is the name below its heading."""
    def of_section(s: Column) -> Column:
        def of_line(x: Column, i: Column) -> Column:
            bare = F.trim(F.regexp_replace(F.regexp_replace(x["line"], r"^[ \t]*[-*|>][ \t]+|^[ \t]*\|", ""), r"\*\*", ""))
            label, value = F.regexp_extract(bare, LABEL_LINE, 1), F.regexp_extract(bare, LABEL_LINE, 2)
            under = F.when(s["level"] > 0, label_name(F.concat(s["section"], F.lit(" "), label))).otherwise(F.lit(""))
            return F.struct((s["start"] + i).alias("line_no"), label_name(label).alias("name"), under.alias("under"), value.alias("value"))

        return F.filter(F.transform(s["lines"], of_line), lambda x: (x["name"] != "") & (x["value"] != ""))

    return F.flatten(F.transform(markdown_sections(md), of_section))


def _pairs(labels: Column, leaves) -> Column:
    """All pairs of a label line and a leaf at or above the threshold: ``array<struct<score, words, line, ord, value>>``."""
    names = []
    for ord_, (keys, _) in enumerate(leaves):
        seen = set()
        for k in range(len(keys)):
            name = _name(" ".join(keys[len(keys) - 1 - k:]))
            if name and name not in seen:
                seen.add(name)
                names.append((ord_, name, name.count(" ") + 1))
    known = F.array(*[F.struct(F.lit(o).alias("ord"), F.lit(n).alias("name"), F.lit(w).alias("words"),
                               F.array(*[F.lit(g) for g in _bigrams(n)]).alias("grams")) for o, n, w in names])

    def score(a: Column, b: Column) -> Column:
        return 1 - F.levenshtein(a, b).cast("double") / F.greatest(F.length(a), F.length(b), F.lit(1))

    def of_form(label: Column, form: Column) -> Column:
        def near(grams: Column) -> Column:
            block = F.filter(known, lambda n: F.arrays_overlap(n["grams"], grams))
            return F.transform(block, lambda n: F.struct(
                score(form, n["name"]).alias("score"), n["words"].alias("words"), (-label["line_no"]).alias("line"),
                (-n["ord"]).alias("ord"), label["value"].alias("value")))

        return F.flatten(F.transform(F.array(label_bigrams(form)), near))

    def of_label(x: Column) -> Column:
        forms = F.filter(F.array_distinct(F.array(x["name"], x["under"])), lambda form: form != "")
        return F.flatten(F.transform(forms, lambda form: of_form(x, form)))

    return F.filter(F.flatten(F.transform(labels, of_label)), lambda p: p["score"] >= THRESHOLD)


def _assign(pairs: Column) -> Column:
    """Pairs from the best down, each leaf and each line once: ``array<struct<ord, line, score, value>>``."""
    chosen = "array<struct<ord:int,line:bigint,score:double,value:string>>"

    def step(acc: Column, p: Column) -> Column:
        taken = F.exists(acc, lambda c: (c["ord"] == -p["ord"]) | (c["line"] == -p["line"]))
        one = F.array(F.struct((-p["ord"]).alias("ord"), (-p["line"]).alias("line"), p["score"].alias("score"), p["value"].alias("value")))
        return F.when(taken, acc).otherwise(F.concat(acc, one))

    return F.aggregate(F.sort_array(pairs, asc=False), F.array().cast(chosen), step)


def _number(text: Column) -> Column:
    digits = F.replace(F.regexp_extract(text, r"-?[0-9][0-9,]*(?:\.[0-9]+)?", 0), F.lit(","), F.lit(""))
    return F.regexp_replace(digits, r"^(-?)0+(?=[0-9])", "$1")


def _value_json(value: Column, kind: str) -> Column:
    """A label's value as JSON of the leaf's kind; ``""`` (or ``[]``) where there is none."""
    none = F.lit("[]" if kind in ("strings", "numbers") else '""')
    if kind == "string":
        found = json_string(value)
    elif kind == "number":
        found = F.when(_number(value) != "", _number(value))
    elif kind == "boolean":
        found = F.when(F.lower(value).isin("yes", "true", "y"), F.lit("true")).when(F.lower(value).isin("no", "false", "n"), F.lit("false"))
    else:
        items = F.filter(F.split(value, r"\s*[;,]\s*"), lambda x: x != "")
        texts = F.transform(items, json_string if kind == "strings" else _number)
        found = F.concat(F.lit("["), F.array_join(F.filter(texts, lambda x: x != ""), ","), F.lit("]"))
    return F.coalesce(F.when(value != "", found), none)


def fill_from_labels(df: DataFrame, text_col: str, template: str | dict, key_cols: Sequence[str], out: str = "j") -> DataFrame:
    """``(keys..., out, matches)``: the template filled from each page's labels, as JSON in template order.

    All keys are always there; what no label names is ``""`` (``[]`` for
    lists).  Numbers are read out of their text (``1,250.50 kg`` gives
    ``1250.50``), lists are cut at commas and semicolons.  ``matches`` tells
    which line filled which leaf: ``array<struct<path, line_no, score>>``.
    """
    leaves = template_leaves(template)
    staged = df.select(*key_cols, page_labels(F.coalesce(F.col(text_col), F.lit(""))).alias("_labels"))
    staged = compute_once(staged, _pairs=_pairs(F.col("_labels"), leaves)).drop("_labels")
    staged = compute_once(staged, _chosen=_assign(F.col("_pairs"))).drop("_pairs")

    def value_of(ord_: int) -> Column:
        mine = F.filter("_chosen", lambda c: c["ord"] == ord_)
        return F.coalesce(F.get(F.transform(mine, lambda c: c["value"]), F.lit(0)), F.lit(""))

    tree: dict = {}
    for ord_, (keys, kind) in enumerate(leaves):
        node = tree
        for k in keys[:-1]:
            node = node.setdefault(k, {})
        node[keys[-1]] = _value_json(value_of(ord_), kind)

    def build(node: dict) -> Column:
        parts = []
        for i, (k, v) in enumerate(node.items()):
            parts += [F.lit(("," if i else "{") + json.dumps(k, ensure_ascii=False) + ":"), build(v) if isinstance(v, dict) else v]
        return F.concat(*parts, F.lit("}")) if parts else F.lit("{}")

    paths = F.array(*[F.lit(".".join(keys)) for keys, _ in leaves])
    matches = F.transform("_chosen", lambda c: F.struct(
        F.get(paths, c["ord"]).alias("path"), c["line"].alias("line_no"), c["score"].alias("score")))
    return staged.select(*key_cols, build(tree).alias(out), matches.alias("matches"))
