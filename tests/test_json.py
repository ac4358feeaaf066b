"""Reply cleaning, strict validity and truthiness against Python's json."""

import json
import random

import pytest
from pyspark.sql import functions as F

from pagewright.functions import jsonfn

FENCE = "```json\n"


def py_clean_strict(s):
    return s.replace(FENCE, "").rsplit("\n", 1)[0]


def py_valid(s):
    try:
        json.loads(s)
        return True
    except (json.JSONDecodeError, ValueError):
        return False


REPLIES = [
    FENCE + '{"a": 1}\n```',
    '{"a": 1}',
    FENCE + '{"a": 1}\n```\nDone.',
    FENCE + '{"a": 1',
    "",
    FENCE + '{"a": 1}\n```' + FENCE + "x\n```",  # two fences
    '{"a": 1}\n',  # trailing newline
    '{\n"a": 1\n}',  # multi-line, no fence
    '{"a": 1, "a": 2}',  # duplicate keys
    '{"a": NaN}',
    "[1]",
    '"x"',
    "{'a': 1}",
    '{"a": 1} trailing',
    '{"a": "é\\u00e9"}',
]


def test_clean_strict_matches_reference_rule(spark):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(REPLIES)], "i int, r string")
    got = {r.i: r.c for r in df.select("i", jsonfn.clean_json("r", strict=True).alias("c")).collect()}
    for i, r in enumerate(REPLIES):
        assert got[i] == py_clean_strict(r), (i, r)


def test_default_clean_drops_closing_fence_and_text_after(spark):
    df = spark.createDataFrame([(FENCE + '{"a": 1}\n```\nDone.',), ('{\n"a": 1\n}',)], "r string")
    got = [r.c for r in df.select(jsonfn.clean_json("r").alias("c")).collect()]
    assert got == ['{"a": 1}', '{\n"a": 1\n}']


def test_validity_matches_python(spark):
    texts = [t for t in REPLIES] + ["1", "true", "null", '{"a":[1,2,{"b":null}]}', "{", "}", '{"a":1}{"b":2}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.v for r in df.select("i", jsonfn.is_valid_json("t").alias("v")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == py_valid(t), (i, t)


def test_valid_null_is_false(spark):
    df = spark.createDataFrame([(None,)], "t string")
    assert df.select(jsonfn.is_valid_json("t").alias("v")).first().v is False


VALUES = [None, "", 0, 0.0, -0.0, False, [], {}, "0", "false", 1, 2.5, True, [0], {"a": None}, " ", "x", -1]


@pytest.mark.parametrize("v", VALUES, ids=[repr(v) for v in VALUES])
def test_truthiness_matches_python(spark, v):
    text = json.dumps({"k": v})
    df = spark.createDataFrame([(text,)], "j string")
    e = df.select(F.explode(jsonfn.object_entries("j")).alias("kv")).select(F.col("kv.value").alias("v"))
    got = e.select(jsonfn.is_truthy_json("v").alias("t")).first().t
    assert got == bool(v)


def test_entries_keep_values_as_written(spark):
    text = ('{"t": "x", "o": {"z": 1, "b": 2.50, "z": 3}, "f": 1.0, "g": 1e5, "h": 12.50, "n": null, "s": "1",'
            ' "a": [1, 2.0, "q\\"5, 6"], "big": 123456789012345678901234567890, "x": NaN, "t": "last"}')
    df = spark.createDataFrame([(text,)], "j string")
    got = [(e.key, e.value) for e in df.select(jsonfn.object_entries("j").alias("e")).first().e]
    assert got == [
        ("t", '"x"'), ("o", '{"z":1,"b":2.50,"z":3}'), ("f", "1.0"), ("g", "1e5"), ("h", "12.50"), ("n", "null"),
        ("s", '"1"'), ("a", '[1,2.0,"q\\"5, 6"]'), ("big", "123456789012345678901234567890"), ("x", "NaN"),
        ("t", '"last"'),
    ]


def test_entries_of_random_objects_match_python(spark):
    rnd = random.Random(5)

    def text():
        return "".join(rnd.choice('a"\\\x01\x02\x03 1:,{}[]\u00e9\n/u') for _ in range(rnd.randint(0, 6)))

    def value(depth=0):
        if depth < 3 and rnd.random() < 0.4:
            n = range(rnd.randint(0, 3))
            return {text(): value(depth + 1) for _ in n} if rnd.random() < 0.5 else [value(depth + 1) for _ in n]
        return rnd.choice([text(), rnd.randint(-9, 9), rnd.random(), None, True, 1.0, 1e30])

    objects = [{text(): value() for _ in range(rnd.randint(0, 4))} for _ in range(500)]
    rows = [(i, json.dumps(o, ensure_ascii=rnd.random() < 0.5, indent=rnd.choice([None, 2]))) for i, o in enumerate(objects)]
    df = spark.createDataFrame(rows, "i int, j string")
    for r in df.select("i", jsonfn.object_entries("j").alias("e")).collect():
        assert repr([(e.key, json.loads(e.value)) for e in r.e]) == repr(list(objects[r.i].items()))


def test_entries_of_bad_or_other_text_are_null(spark):
    texts = ['{"a":1 2}', '{"a":01}', "[1]", '"x"', '{"a"', "", '{"a":1} {"b":2}']
    df = spark.createDataFrame([(t,) for t in texts], "j string")
    assert [r.e for r in df.select(jsonfn.object_entries("j").alias("e")).collect()] == [None] * len(texts)
