"""Nested JSON: values by path, conformance at depth, common shape; held against plain Python."""

import json
import random
from collections import Counter, defaultdict

from pagewright.operators import shape


def path_of(parent, key):
    if key is None:
        return f"{parent}[]"
    segment = json.dumps(key, ensure_ascii=False) if any(c in key for c in '.[]"') else key
    return segment if parent == "$" else f"{parent}.{segment}"


KIND = {dict: "object", list: "array", str: "string", bool: "boolean", int: "number", float: "number", type(None): "null"}


class Pairs(list):
    """An object's entries in order, repeated keys included."""


def walk(value, path="$", parent=None, key=None, repeated=False):
    kind = "object" if isinstance(value, Pairs) else KIND[type(value)]
    yield path, parent, key, kind, repeated
    if isinstance(value, Pairs):
        seen = set()
        for k, v in value:
            yield from walk(v, path_of(path, k), path, k, k in seen)
            seen.add(k)
    elif isinstance(value, list):
        for v in value:
            yield from walk(v, path_of(path, None), path)


def parsed(text):
    return json.loads(text, object_pairs_hook=Pairs)


def random_json(rng, depth=0):
    pick = rng.random()
    if depth < 4 and pick < 0.45:
        keys = [rng.choice(["a", "b", "c", "x.y", 'q"', "é", "l[0]", ""]) for _ in range(rng.randrange(4))]
        return "{" + ", ".join(f"{json.dumps(k, ensure_ascii=False)} : {random_json(rng, depth + 1)}" for k in keys) + "}"
    if depth < 4 and pick < 0.6:
        return "[" + ",".join(random_json(rng, depth + 1) for _ in range(rng.randrange(3))) + "]"
    return rng.choice(['""', '"text"', '"{\\"no\\":1}"', '"a [b] }"', "0", "-1.50", "1e5", "true", "false", "null"])


REPLIES = [random_json(random.Random(i)) for i in range(300)]


def test_nodes_equal_a_plain_walk(spark):
    rows = list(enumerate(REPLIES)) + [(1000, "{not json"), (1001, ""), (1002, None)]
    got = Counter(tuple(r) for r in shape.json_nodes(spark.createDataFrame(rows, "id int, j string"), "j", ["id"]).collect())
    want = Counter((i, *node) for i, text in enumerate(REPLIES) for node in walk(parsed(text)))
    want += Counter([(1000, "$", None, None, "invalid", False), (1001, "$", None, None, "invalid", False)])
    assert got == want


def test_shape_rows_and_parts(spark):
    rows = [(i % 3, t) for i, t in enumerate(REPLIES)]
    got = {(r.g, r.path, r.key): (r.kinds, r.n_values, r.n_present, r.n_parents, r.required)
           for r in shape.shape_rows(spark.createDataFrame(rows, "g int, j string").repartition(7), "j", ["g"]).collect()}
    values, present, kinds, objects = Counter(), Counter(), defaultdict(set), Counter()
    up = {}
    for g, text in rows:
        for path, parent, key, kind, repeated in walk(parsed(text)):
            at = (g, path, key)
            values[at] += 1
            present[at] += not repeated
            kinds[at].add(kind)
            objects[(g, path)] += kind == "object"
            up[at] = parent
    assert got.keys() == values.keys()
    for at, (k, n, p, above, required) in got.items():
        want = objects[(at[0], up[at])] if at[2] is not None else None
        assert k == [x for x in shape.KINDS if x in kinds[at]] and (n, p, above) == (values[at], present[at], want)
        assert required == (want == p)


def test_shape_as_one_object(spark):
    rows = [(1, '{"b":[{"n":1},{"n":"x","m":null}],"a":{"k":{"z":true}}}'), (1, '{"a":"", "b":[]}'), (None, '[1,[2]]'), (2, '"s"')]
    rows_of = shape.shape_rows(spark.createDataFrame(rows, "g int, j string"), "j", ["g"])
    got = {r.g: json.loads(r["shape"]) for r in shape.shape_json(rows_of, ["g"]).collect()}
    assert got[1] == {
        "type": "object", "required": ["a", "b"], "properties": {
            "a": {"type": ["object", "string"], "required": ["k"], "properties": {
                "k": {"type": "object", "required": ["z"], "properties": {"z": {"type": "boolean"}}}}},
            "b": {"type": "array", "items": {"type": "object", "required": ["n"], "properties": {
                "m": {"type": "null"}, "n": {"type": ["string", "number"]}}}}}}
    assert got[None] == {"type": "array", "items": {"type": ["array", "number"], "items": {"type": "number"}}}
    assert got[2] == {"type": "string"}
    whole = shape.shape_json(shape.shape_rows(spark.createDataFrame(rows[:2], "g int, j string"), "j")).collect()
    assert json.loads(whole[0]["shape"]) == got[1]
    none = shape.shape_rows(spark.createDataFrame([], "g int, j string"), "j", ["g"])
    assert none.collect() == [] and shape.shape_json(none, ["g"]).collect() == []


def problems(value, template):
    """The rules in plain Python."""
    paths = {p: (kind, keys) for p, kind, keys in shape.template_paths(template)}
    out = Counter()

    def visit(v, path, repeated):
        kind = "object" if isinstance(v, Pairs) else KIND[type(v)]
        if path not in paths:
            if not (path.endswith("[]") and paths.get(path[:-2], ("",))[0] == "array") and not repeated:
                out[path, "extra"] += 1
            return
        want, keys = paths[path]
        out[path, "repeated"] += repeated
        if want != kind:
            out[path, "kind"] += v != "" and want != "null"
            return
        if kind == "object":
            seen = set()
            for k, x in v:
                visit(x, path_of(path, k), k in seen)
                seen.add(k)
            for k in keys:
                out[path_of(path, k), "missing"] += k not in seen
        elif kind == "array":
            for x in v:
                visit(x, path_of(path, None), False)

    visit(value, "$", False)
    return {k: n for k, n in out.items() if n}


TEMPLATE = {"a": {"b": "", "c": {"a": 0, "x.y": ""}}, "b": [{"a": "", "b": [0]}], "c": [], "é": None, 'q"': True}


def check(spark, texts, template):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, j string")
    got = defaultdict(dict)
    for r in shape.check_template_paths(df, template, ["id"]).collect():
        assert (r.path, r.problem) not in got[r.id]
        got[r.id][r.path, r.problem] = r.n
    return got


def test_conformance_equals_plain_rules(spark):
    rng = random.Random(4)

    def like_template():
        a = rng.choice(['""', '{"b":"x"}', '{"b":1,"c":{"a":1}}', '{"c":{"a":"n","x.y":"v","z":[1]},"b":""}', "[]", "null"])
        b = rng.choice(["[]", '[{"a":"1","b":[1,"2",[3]]},{"a":2},""]', '{"a":1}', '[[{"a":1}]]'])
        rest = rng.choice(["", ',"c":[1,{"d":2}]', ',"c":{}', ',"é":[1],"q\\"":false', ',"a":{"b":"again"}', ',"new":{"deep":{"er":1}}'])
        return f'{{"a":{a},"b":{b}{rest}}}'

    texts = [like_template() for _ in range(150)] + REPLIES[:100]
    got = check(spark, texts, TEMPLATE)
    for i, t in enumerate(texts):
        assert got[i] == problems(parsed(t), TEMPLATE), t


def test_conformance_of_a_nested_key(spark):
    got = check(spark, ['{"a":{"b":"x"}}', "nope", None, '{"a":{"b":"","c":""}}'], json.dumps({"a": {"b": "", "c": ""}}))
    assert got == {0: {("a.c", "missing"): 1}, 1: {("$", "invalid"): 1}, 2: {("$", "invalid"): 1}}
