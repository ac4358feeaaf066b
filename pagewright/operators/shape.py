"""Shapes of nested JSON: all values by path, conformance to a nested template, the common shape of replies.

A path names a value by the keys above it, with array positions left out:
``survey.savings.total``, ``authors[]``, ``pages[].id``; ``$`` is the reply itself.
A key that holds one of ``. [ ] "`` is written as a JSON string.

A reply is taken apart inside its own row, level by level, so nothing is
shuffled before the (small) results are counted.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.jsonfn import compute_once, is_valid_json, json_children, json_depth, json_kind

ROOT = "$"
KINDS = ["object", "array", "string", "number", "boolean", "null"]


def _segment(key: Column) -> Column:
    return F.when(key.rlike(r'[.\[\]"]'), F.to_json(key.cast("variant"))).otherwise(key)


def _child_path(parent: Column, key: Column) -> Column:
    below = F.when(parent == ROOT, _segment(key)).otherwise(F.concat(parent, F.lit("."), _segment(key)))
    return F.when(key.isNull(), F.concat(parent, F.lit("[]"))).otherwise(below)


def _levels(json_text: Column, depth: int, descend) -> list[tuple[str, Column]]:
    """Columns ``_n0 .. _n<depth>``: the values of each level as ``array<struct<path, parent, key, repeated, value>>``.

    ``descend(node)`` says which values are taken apart.
    """
    def node(path, parent, key, repeated, value):
        return F.struct(path.alias("path"), parent.cast("string").alias("parent"), key.cast("string").alias("key"),
                        repeated.alias("repeated"), value.alias("value"))

    def below(n: Column) -> Column:
        def of(children: Column) -> Column:
            keys = F.transform(children, lambda c: c["key"])

            def child(c: Column, i: Column) -> Column:
                again = F.coalesce(F.array_position(keys, c["key"]) <= i, F.lit(False))
                return node(_child_path(n["path"], c["key"]), n["path"], c["key"], again, c["value"])

            return F.transform(children, child)

        return F.flatten(F.transform(F.array(json_children(n["value"])), of))

    null = F.lit(None).cast("string")
    out = [("_n0", F.array(node(F.lit(ROOT), null, null, F.lit(False), json_text)))]
    for k in range(depth):
        out.append((f"_n{k + 1}", F.flatten(F.transform(F.filter(F.col(f"_n{k}"), descend), below))))
    return out


def json_nodes(df: DataFrame, json_col: str, key_cols: Sequence[str], depth: int | None = None) -> DataFrame:
    """Every value of every reply: ``(keys..., path, parent, key, kind, repeated)``, one row each.

    ``repeated``: the key came before in the same object.  Text that is not
    one JSON value is a single row of kind ``invalid``.  Without ``depth`` one
    aggregate looks how deep the replies go.
    """
    text = F.col(json_col)
    if depth is None:
        depth = df.agg(F.max(F.when(is_valid_json(text), json_depth(text)))).first()[0] or 0
    whole = df.select(*key_cols, text.alias("_j"))
    for name, level in _levels(F.col("_j"), depth, lambda n: F.substring(n["value"], 1, 1).isin("{", "[")):
        whole = whole.withColumn(name, level)
    every = F.concat(*[F.col(f"_n{k}") for k in range(depth + 1)])
    rows = compute_once(whole.select(*key_cols, "_j", every.alias("_all")), _every=F.col("_all"))
    rows = rows.where(F.col("_j").isNotNull()).select(*key_cols, F.explode("_every").alias("_v"))
    kind = F.when((F.col("_v.path") == ROOT) & ~is_valid_json(F.col("_v.value")), F.lit("invalid")).otherwise(json_kind(F.col("_v.value")))
    return rows.select(*key_cols, "_v.path", "_v.parent", "_v.key", kind.alias("kind"), "_v.repeated")


# ------------------------------------------------------------ conformance


def _path(parent: str, key: str | None) -> str:
    if key is None:
        return f"{parent}[]"
    segment = json.dumps(key, ensure_ascii=False) if any(c in key for c in '.[]"') else key
    return segment if parent == ROOT else f"{parent}.{segment}"


def _kind_of(value) -> str:
    if isinstance(value, bool):
        return "boolean"
    return {dict: "object", list: "array", str: "string", type(None): "null"}.get(type(value), "number")


def template_paths(template: str | dict) -> list[tuple[str, str, list[str]]]:
    """``(path, kind, keys)`` of every value of a template; an array's items are taken together."""
    out: dict[str, tuple[str, dict]] = {}

    def visit(path: str, value) -> None:
        kind, keys = out.setdefault(path, (_kind_of(value), {}))
        if kind == "object" and isinstance(value, dict):
            for k, v in value.items():
                keys[k] = None
                visit(_path(path, k), v)
        elif kind == "array" and isinstance(value, list):
            for v in value:
                visit(_path(path, None), v)

    visit(ROOT, json.loads(template) if isinstance(template, str) else template)
    return [(p, kind, list(keys)) for p, (kind, keys) in out.items()]


def check_template_paths(replies: DataFrame, template: str | dict, key_cols: Sequence[str], json_col: str = "j") -> DataFrame:
    """Problems per reply at every depth of a nested template: ``(keys..., path, problem, n)``.

    * ``missing``: an object of the template lacks one of its keys.
    * ``extra``: such an object has a key that the template's lacks; what is
      below it is not looked at.
    * ``kind``: the value is of another kind than the template's.  ``""`` (the
      template's own "not found") and, where the template has ``null``, any
      kind are no problem; what is below a value of another kind is not looked at.
    * ``repeated``: a key stands more than once in an object.
    * ``invalid``: the reply is no JSON (path ``$``).

    ``n`` counts the places, several in arrays.  The template is a literal, so
    there is no join; only levels and paths of the template are taken apart,
    in the reply's own row, and nothing is shuffled.
    """
    paths = template_paths(template)
    depth = max(p.count(".") + p.count("[]") + 1 for p, _, _ in paths)
    kinds = F.create_map(*[F.lit(x) for p, kind, _ in paths for x in (p, kind)])
    keys_of = F.create_map(*[x for p, kind, keys in paths if kind == "object" or p == ROOT
                             for x in (F.lit(p), F.array(*[F.lit(k) for k in keys]).cast("array<string>"))])

    def wanted(n: Column) -> Column:
        return F.try_element_at(kinds, n["path"])

    def fits(n: Column) -> Column:
        return F.coalesce(wanted(n) == json_kind(n["value"]), F.lit(False))

    def problem(path: Column, what: str) -> Column:
        return F.struct(path.alias("path"), F.lit(what).alias("problem"))

    def of_object(n: Column) -> Column:
        def missing(keys: Column) -> Column:
            absent = F.array_except(F.try_element_at(keys_of, n["path"]), keys)
            return F.transform(absent, lambda k: problem(_child_path(n["path"], k), "missing"))

        keys = F.transform(json_children(n["value"]), lambda c: c["key"])
        return F.flatten(F.transform(F.array(keys), missing))

    def of_value(n: Column) -> Column:
        none = F.array().cast("array<struct<path:string,problem:string>>")
        known = wanted(n).isNotNull()
        same = fits(n) | (n["value"] == '""') | (wanted(n) == "null")
        return F.concat(
            F.when(~known & ~n["repeated"], F.array(problem(n["path"], "extra"))).otherwise(none),
            F.when(known & n["repeated"], F.array(problem(n["path"], "repeated"))).otherwise(none),
            F.when(known & ~same, F.array(problem(n["path"], "kind"))).otherwise(none),
            F.when((wanted(n) == "object") & fits(n), of_object(n)).otherwise(none),
        )

    df = replies.select(*key_cols, F.col(json_col).alias("_j")).withColumn("_ok", is_valid_json(F.col("_j")))
    for name, level in _levels(F.col("_j"), depth, lambda n: fits(n) & wanted(n).isin("object", "array")):
        df = df.withColumn(name, level)
    every = F.concat(*[F.col(f"_n{k}") for k in range(depth + 1)])
    # An item of an array that the template leaves empty is of no known kind, and no problem.
    open_items = [f"{p}[]" for p, kind, _ in paths if kind == "array"]
    known_paths = {p for p, _, _ in paths}
    free = [p for p in open_items if p not in known_paths]
    looked_at = F.filter(every, lambda n: ~n["path"].isin(*free)) if free else every
    found = F.when(F.col("_ok"), F.flatten(F.transform(looked_at, of_value))).otherwise(F.array(problem(F.lit(ROOT), "invalid")))
    df = compute_once(df, _all=found)
    counted = F.transform(F.array_distinct("_all"), lambda p: F.struct(
        p["path"].alias("path"), p["problem"].alias("problem"),
        F.size(F.filter("_all", lambda x: x == p)).cast("bigint").alias("n")))
    return compute_once(df, _counted=counted).select(*key_cols, F.inline("_counted"))


# ------------------------------------------------------------ common shape


def shape_rows(df: DataFrame, json_col: str, group_cols: Sequence[str] = (), depth: int | None = None) -> DataFrame:
    """The common shape of JSON replies, one row per path: ``(groups..., path, parent, key, kinds, n_values, n_present, n_parents, required)``.

    ``kinds``: which kinds occur, in the order of ``KINDS``; ``n_values``: values
    at the path; ``n_present``: objects above it that have the key (a key
    repeated in one object counts once), for items of arrays the values;
    ``n_parents``: the objects above it; ``required``: all of them have the key.
    Replies that are no JSON are rows of kind ``invalid`` at ``$``.

    All columns come from sums and sets over single values, so tasks aggregate
    first and only one row a path and task is shuffled: shapes of parts merge
    into the shape of the whole.
    """
    g = list(group_cols)
    kinds = [*KINDS, "invalid"]
    counts = json_nodes(df, json_col, g, depth).groupBy(*g, "path", "parent", "key").agg(
        F.count(F.lit(1)).alias("n_values"), F.count_if(~F.col("repeated")).alias("n_present"),
        *[F.count_if(F.col("kind") == k).alias(f"_{k}") for k in kinds],
    )
    held = F.array_compact(F.array(*[F.when(F.col(f"_{k}") > 0, F.lit(k)) for k in kinds]))
    rows = counts.select(*g, "path", "parent", "key", held.alias("kinds"), "n_values", "n_present", "_object")
    above = counts.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(g)], F.col("path").alias("_above"), F.col("_object").alias("n_parents"))
    match = F.col("parent") == F.col("_above")
    for i, c in enumerate(g):
        match = match & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    joined = rows.join(above, match, "left")
    n_parents = F.when(F.col("key").isNotNull(), F.col("n_parents"))
    return joined.select(*g, "path", "parent", "key", "kinds", "n_values", "n_present", n_parents.alias("n_parents"),
                         F.coalesce(F.col("n_present") == n_parents, F.lit(False)).alias("required"))


def shape_json(shape: DataFrame, group_cols: Sequence[str] = (), out: str = "shape") -> DataFrame:
    """``shape_rows`` as one JSON object per group: ``{"type":..., "properties":{...}, "required":[...], "items":...}``.

    Keys stand in alphabetical order; ``type`` is a list where kinds differ.
    Put together from the deepest level up, one aggregate a level; a group's
    object holds its distinct paths only.
    """
    g = list(group_cols)
    level = F.size(F.regexp_extract_all(F.regexp_replace("path", r'(?s)"(?:[^"\\]|\\.)*"', "q"), F.lit(r"\.|\[\]"), 0))
    rows = shape.withColumn("_level", F.when(F.col("path") == ROOT, 0).otherwise(level + F.when(F.col("path").startswith(ROOT), 0).otherwise(1)))
    depth = rows.agg(F.max("_level")).first()[0]
    if depth is None:
        return shape.select(*g, F.lit("").alias(out)).limit(0)
    quoted = F.transform("kinds", lambda k: F.concat(F.lit('"'), k, F.lit('"')))
    types = F.when(F.size("kinds") == 1, F.element_at(quoted, 1)).otherwise(F.concat(F.lit("["), F.array_join(quoted, ","), F.lit("]")))
    name = F.to_json(F.col("key").cast("variant"))
    below = None
    for k in range(depth, -1, -1):
        at = rows.where(F.col("_level") == k)
        text = F.concat(F.lit('{"type":'), types)
        if below is not None:
            match = F.col("path") == F.col("_above")
            for i, c in enumerate(g):
                match = match & F.col(c).eqNullSafe(F.col(f"_g{i}"))
            at = at.join(below, match, "left")
            text = F.concat(text, F.coalesce(F.col("_inside"), F.lit("")))
        at = at.select(*g, "path", "parent", "key", "required", F.concat(text, F.lit("}")).alias("_text"))
        if k == 0:
            return at.select(*g, F.col("_text").alias(out))
        entry = F.when(F.col("key").isNotNull(), F.struct("key", F.concat(name, F.lit(":"), F.col("_text")).alias("t")))
        must = F.when(F.col("required"), F.struct("key", name.alias("t")))

        def listed(col: str) -> Column:
            return F.array_join(F.transform(F.col(col), lambda e: e["t"]), ",")

        per = at.groupBy(*g, "parent").agg(
            F.array_sort(F.collect_list(entry)).alias("_e"), F.array_sort(F.collect_list(must)).alias("_m"),
            F.max(F.when(F.col("key").isNull(), F.col("_text"))).alias("_items"))
        inside = F.concat(
            F.when(F.size("_e") > 0, F.concat(F.lit(',"properties":{'), listed("_e"), F.lit("}"))).otherwise(F.lit("")),
            F.when(F.size("_m") > 0, F.concat(F.lit(',"required":['), listed("_m"), F.lit("]"))).otherwise(F.lit("")),
            F.coalesce(F.concat(F.lit(',"items":'), F.col("_items")), F.lit("")))
        below = per.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(g)], F.col("parent").alias("_above"), inside.alias("_inside"))
    return at
