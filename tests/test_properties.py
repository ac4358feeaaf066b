"""Property tests: column functions against plain-Python statements of the rules.

Each example is a list of inputs checked in one Spark job.
"""

import json
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagewright.functions import jsonfn, textfn

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))

names = st.text(alphabet="aAbB_-.09187 ", min_size=0, max_size=12)


def py_key(s):
    return [int(t) if t.isdigit() else t.lower() for t in re.split("([0-9]+)", s)]


@SETTINGS
@given(st.lists(names, min_size=1, max_size=60))
def test_natural_key_order(spark, xs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, name string")
    got = [r.name for r in df.orderBy(textfn.natural_key("name"), "name").collect()]
    assert got == sorted(xs, key=lambda s: (py_key(s), s))


replies = st.lists(st.sampled_from(["```json\n", "\n", "```", "{", "}", '"a"', ":", "1", ",", " ", "x"]), max_size=12).map("".join)


@SETTINGS
@given(st.lists(replies, min_size=1, max_size=60))
def test_strict_clean(spark, xs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, r string")
    got = {r.i: r.c for r in df.select("i", jsonfn.clean_json("r", strict=True).alias("c")).collect()}
    assert [got[i] for i in range(len(xs))] == [x.replace("```json\n", "").rsplit("\n", 1)[0] for x in xs]


json_values = st.recursive(
    st.none() | st.booleans() | st.integers(-10**6, 10**6) | st.text(alphabet="ab é\"\\/", max_size=5),
    lambda inner: st.lists(inner, max_size=3) | st.dictionaries(st.text(alphabet="kq", max_size=2), inner, max_size=3),
    max_leaves=8,
)


def py_valid(s):
    try:
        json.loads(s)
        return True
    except ValueError:
        return False


@st.composite
def json_texts(draw):
    text = json.dumps(draw(json_values), ensure_ascii=draw(st.booleans()))
    how = draw(st.sampled_from(["keep", "cut", "junk", "fence"]))
    if how == "cut" and text:
        text = text[: draw(st.integers(0, len(text) - 1))]
    elif how == "junk":
        text = text + draw(st.sampled_from(["x", " ]", "}", ",1", "\n```", " "]))
    elif how == "fence":
        text = "```json\n" + text
    return text


@SETTINGS
@given(st.lists(json_texts(), min_size=1, max_size=60))
def test_validity_against_python(spark, xs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, t string")
    got = {r.i: r.v for r in df.select("i", jsonfn.is_valid_json("t").alias("v")).collect()}
    assert [got[i] for i in range(len(xs))] == [py_valid(x) for x in xs]


@SETTINGS
@given(st.lists(st.floats(min_value=0, max_value=1000, allow_nan=False), min_size=1, max_size=60))
def test_money_against_python(spark, xs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    got = {r.i: r.m for r in df.select("i", textfn.money("x").alias("m")).collect()}
    assert [got[i] for i in range(len(xs))] == ["$%.2f" % x for x in xs]


@SETTINGS
@given(st.lists(st.text(alphabet="é€😀ab\"\\\n", max_size=6), min_size=1, max_size=30))
def test_ascii_escape_against_python(spark, xs):
    from pagewright.sources.sinks import _ascii_json

    recs = [json.dumps({"v": x}, ensure_ascii=False, separators=(",", ":")) for x in xs]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(recs)], "i int, r string")
    got = {r.i: r.a for r in df.select("i", _ascii_json(F.col("r")).alias("a")).collect()}
    assert [got[i] for i in range(len(xs))] == [json.dumps({"v": x}, separators=(",", ":")) for x in xs]


paths = st.text(alphabet="ab./", max_size=10)


@SETTINGS
@given(st.lists(paths, min_size=1, max_size=80))
def test_file_stem_against_python(spark, xs):
    import os

    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, p string")
    got = {r.i: (r.s, r.e) for r in df.select("i", textfn.file_stem("p").alias("s"), textfn.file_extension("p").alias("e")).collect()}
    assert [got[i] for i in range(len(xs))] == [os.path.splitext(os.path.basename(x)) for x in xs]


@SETTINGS
@given(st.lists(replies, min_size=1, max_size=60))
def test_default_clean(spark, xs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, r string")
    got = {r.i: r.c for r in df.select("i", jsonfn.clean_json("r").alias("c")).collect()}
    expected = [re.sub(r"\n```[^`]*\Z", "", x.replace("```json\n", "")) for x in xs]
    assert [got[i] for i in range(len(xs))] == expected
