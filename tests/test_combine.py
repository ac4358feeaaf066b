"""Combine batches: last non-empty wins, template first, extras by first sighting."""

import json
import random

from pyspark.sql import functions as F

from pagewright.operators import combine

TEMPLATE = ["title", "authors", "date"]


def py_combine(template, batches):
    """The reference rule, restated: batches in order, truthy values overwrite."""
    out = {k: "" for k in template}
    for b in batches:
        for k, v in b.items():
            if v:
                out[k] = v
    return out


def run(spark, rows, template=TEMPLATE, keep_zero=False):
    df = spark.createDataFrame(rows, "doc string, batch_no int, j string")
    rec = combine.combine_last_non_empty(df, template, keep_zero=keep_zero)
    return {r.doc: r.record for r in rec.collect()}


def dumps(d):
    return json.dumps(d, separators=(",", ":"), ensure_ascii=False)


def test_edge_values(spark):
    rows = [
        ("d", 1, dumps({"title": "A", "authors": ["x"], "n": 0, "f": False, "e": [], "o": {}})),
        ("d", 2, dumps({"title": "", "authors": [], "date": "0", "flag": "false", "x": None})),
        ("d", 3, dumps({"title": "B", "nested": {"a": 1}})),
        ("d", 4, dumps({"nested": {"b": 2}, "date": 0})),
    ]
    got = json.loads(run(spark, rows)["d"])
    assert list(got) == ["title", "authors", "date", "flag", "nested"]
    assert got == {"title": "B", "authors": ["x"], "date": "0", "flag": "false", "nested": {"b": 2}}


def test_keep_zero_option(spark):
    rows = [("d", 1, dumps({"title": "A", "n": 0, "f": False}))]
    got = json.loads(run(spark, rows, keep_zero=True)["d"])
    assert got == {"title": "A", "authors": "", "date": "", "n": 0, "f": False}


def test_batch_order_not_input_order(spark):
    rows = [("d", 10, dumps({"title": "ten"})), ("d", 9, dumps({"title": "nine"})), ("d", 2, dumps({"title": "two"}))]
    assert json.loads(run(spark, rows)["d"])["title"] == "ten"


def test_natural_file_order(spark):
    rows = [("d", 0, dumps({"title": "p10"}), "Pages_10_to_11.json"), ("d", 0, dumps({"title": "p9"}), "Pages_9_to_9.json")]
    df = spark.createDataFrame(rows, "doc string, batch_no int, j string, name string")
    from pagewright.functions.textfn import natural_key

    rec = combine.combine_last_non_empty(df, TEMPLATE, order_col=F.struct(natural_key("name"), F.col("name")))
    assert json.loads(rec.first().record)["title"] == "p10"


def test_document_with_only_empty_values_gets_defaults(spark):
    rows = [("d", 1, dumps({"title": "", "x": 0}))]
    assert json.loads(run(spark, rows)["d"]) == {"title": "", "authors": "", "date": ""}


def test_duplicate_keys_last_wins(spark):
    rows = [("d", 1, '{"title":"a","title":"b"}')]
    assert json.loads(run(spark, rows)["d"])["title"] == "b"


def random_value(rnd):
    return rnd.choice(["", "x", "y", 0, 1, 2.5, False, True, [], [1], {}, {"a": rnd.randint(0, 3)}, None, "0", "false"])


def test_random_against_python_rule(spark):
    rnd = random.Random(7)
    rows, expected = [], {}
    keys = TEMPLATE + ["k1", "k2", "k3"]
    for d in range(60):
        batches = []
        for b in range(rnd.randint(1, 6)):
            obj = {k: random_value(rnd) for k in rnd.sample(keys, rnd.randint(0, len(keys)))}
            batches.append(obj)
        order = list(range(len(batches)))
        rnd.shuffle(order)
        for b in order:
            rows.append((f"d{d}", b + 1, dumps(batches[b])))
        expected[f"d{d}"] = py_combine(TEMPLATE, batches)
    got = run(spark, rows)
    for doc, exp in expected.items():
        g = json.loads(got[doc])
        assert list(g) == list(exp), doc
        assert g == exp, doc


def test_partitioning_does_not_change_result(spark):
    rnd = random.Random(3)
    rows = [(f"d{d % 7}", d * 3 + b, dumps({"title": rnd.choice(["", "a", "b"]), "k": rnd.choice([0, 1])}))
            for d in range(70) for b in range(3)]
    df = spark.createDataFrame(rows, "doc string, batch_no int, j string")
    a = {r.doc: r.record for r in combine.combine_last_non_empty(df, TEMPLATE).collect()}
    b = {r.doc: r.record for r in combine.combine_last_non_empty(df.repartition(13).orderBy(F.rand(1)), TEMPLATE).collect()}
    assert a == b


def test_template_rows_and_load(spark, tmp_path):
    p = tmp_path / "schema.json"
    p.write_text(json.dumps({"title": "x", "authors": ["a"], "survey": {"total": 40}}, indent=4))
    t = combine.load_template(spark, str(p)).orderBy("ord").collect()
    assert [(r.ord, r.key) for r in t] == [(1, "title"), (2, "authors"), (3, "survey")]
    assert t[2].example == '{"total":40}'
    assert combine.template_keys(combine.load_template(spark, str(p))) == ["title", "authors", "survey"]


def test_entries_and_record_agree_with_open_keys(spark):
    """A document with many keys of its own: rows in order of first sighting, record the same."""
    rows = [("d", b, dumps({f"k{b * 7 % 40}_{i}": i + 1 for i in range(5)} | {"title": f"t{b}"})) for b in range(40)]
    rows += [(None, 1, dumps({"x": 1})), ("e", 1, "{}")]
    df = spark.createDataFrame(rows, "doc string, batch_no int, j string")
    entries = combine.combine_entries(df, TEMPLATE).collect()
    record = {r.doc: json.loads(r.record) for r in combine.combine_last_non_empty(df, TEMPLATE).collect()}
    for doc in ["d", "e", None]:
        mine = sorted([r for r in entries if r.doc == doc], key=lambda r: r.ord)
        assert [r.ord for r in mine] == list(range(1, len(mine) + 1))
        assert [r.key for r in mine] == list(record[doc])
        assert {r.key: json.loads(r.value) for r in mine} == record[doc]
    assert len(record["d"]) == 203 and list(record["d"])[3:8] == [f"k0_{i}" for i in range(5)]


def test_record_keeps_numbers_and_nested_order(spark):
    text = '{"title":"x","o":{"z":1,"b":{"y":2.50,"a":1.0}},"n":12.50,"e":1e5,"d":{"a":1,"a":2}}'
    assert run(spark, [("d", 1, text)])["d"] == (
        '{"title":"x","authors":"","date":"","o":{"z":1,"b":{"y":2.50,"a":1.0}},"n":12.50,"e":1e5,"d":{"a":1,"a":2}}')
