"""Personal data and secrets: the contract's patterns as they stand, disguises, the network."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import SF_ORACLE
from pagewright.llm import pii, secrets

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    double = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in double)) % 10 == 0


def slow_pii(text):
    only = lambda s: re.sub("[^0-9]", "", s)
    found = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    found += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(only(m.group())) <= 19 and luhn(only(m.group()))]
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(only(m.group())) <= 15]
    return sorted(found)


def slow_secrets(text):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m.group(2)) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 32]
    return sorted(found)


PIECES = ["@", ".", "a", "Z9", "-", " ", "+", "1", "25", "4111 1111 1111 1111", "(", ")", "10.0.0.255", "256", "x@y.z", "é", "+1 (555) 123-4567", "%", "\n", "٣"]
SECRET_PIECES = ["password", "PASSWD", "token", "api_key", "ApiKey", "ſecret", "secret", "=", ":", " ", '"', "'", "abcd1234", "AKIA", "ABCDEFGHIJKLMNOP", "0f" * 9, "é", "_", "K"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14))
def test_base_identifiers(parts):
    text = "".join(parts)
    assert pii.detect(text) == slow_pii(text)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(SECRET_PIECES), max_size=12))
def test_base_secrets(parts):
    text = "".join(parts)
    assert secrets.base_findings(text) == slow_secrets(text)


@pytest.mark.parametrize("text, kind, source", [
    ("mail john.doe [at] example (dot) com ok", "email", "john.doe [at] example (dot) com"),
    ("it's john at mail dot example dot org.", "email", "john at mail dot example dot org"),
    ("call plus one four five six five five five two one eight six now", "phone", "plus one four five six five five five two one eight six"),
    ("card four one one one 1111 1111 1111 then", "card", "four one one one 1111 1111 1111"),
    ("host 10[.]0[.]0[.]255!", "ip", "10[.]0[.]0[.]255"),
    ("to jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
    ("ｊohn＠example．com", "email", "ｊohn＠example．com"),
    ("no 4111​1111 1111 1111.", "card", "4111​1111 1111 1111"),
    ("plus vier neun drei null", None, None),
    ("look at example dot nothing is here", None, None),
    ("one two three and four of (at) home", None, None),
])
def test_disguises_map_back_to_the_source(text, kind, source):
    got = [(pii.KINDS[k], text[s:e]) for s, k, e in pii.hidden(text)]
    assert got == ([(kind, source)] if kind else [])


def test_layers_compose():
    text = "Ａ é ​ write to bоb [at] hоst (dot) example (dot) com, plus one five five five one two three four five six seven"
    got = [(pii.KINDS[k], text[s:e]) for s, k, e in pii.hidden(text)]
    assert got == [("email", "bоb [at] hоst (dot) example (dot) com"),
                   ("phone", "plus one five five five one two three four five six seven")]
    assert pii.redact("x a@b.co y") == "x [email] y"


def test_long_runs_are_linear():
    for unit in ("1", "a", "@", "+1", "1.", "[", " at ", "a@", "five ", "9 "):
        pii.detect(unit * 60_000)
        pii.hidden(unit * 60_000)
    for unit in ("a", "0", "token", "AKIA", "=", "_"):
        secrets.base_findings(unit * 60_000)
        secrets.candidates(unit * 60_000)


SCHEMA = "doc_id long, text string, spans string, _text int, _id int"


def test_pii_query_over_a_table(spark):
    docs = spark.read.parquet(f"{SF_ORACLE}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(None, "a@b.co", "", 1, 1), (-1, None, "", 1, 1), (-1, None, "", 1, 1), (-2, "é a [at] b.co", "", 1, 1)], SCHEMA)
    both = docs.unionByName(odd.select("doc_id", "text"))
    text = [(r["doc_id"], r["text"] or "") for r in both.collect()]
    got = pii.find_pii(both).collect()
    assert len(got) == len(text)
    want = []
    for i, t in text:
        base = slow_pii(t)
        sha = hashlib.sha256(",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base).encode()).hexdigest()
        want.append((i, *[sum(k == n for _, k, _ in base) for n in range(4)], sha))
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:6]) for r in got)
    assert {r["spans"] for r in got if r["doc_id"] == -2} == {"email:2:13"[:5] + ":2:13"}
    assert pii.find_pii(odd).columns[0] == "doc_id" and pii.find_pii(spark.createDataFrame([], SCHEMA)).collect() == []


def test_secret_query_over_a_table(spark):
    docs = spark.read.parquet(f"{SF_ORACLE}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(None, "token=abcdefgh1", "", 1, 1), (-1, None, "", 1, 1), (-1, None, "", 1, 1)], SCHEMA)
    both = docs.unionByName(odd.select("doc_id", "text"))
    got = secrets.find_secrets(both, secrets.train_model(docs)).collect()
    want = []
    for r in both.collect():
        base = slow_secrets(r["text"] or "")
        sha = hashlib.sha256(",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in base).encode()).hexdigest()
        want.append((r["doc_id"], *[sum(k == n for _, k, _ in base) for n in range(3)], sha))
        spans = {s for x in got if x["doc_id"] == r["doc_id"] for s in x["spans"].split(",")}
        assert {f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in base} <= spans | {""}
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:5]) for r in got)
    assert secrets.find_secrets(spark.createDataFrame([], SCHEMA), None).collect() == []
    assert secrets.train_model(spark.createDataFrame([], SCHEMA)) is None


def test_network_recalls_held_out_secrets_and_leaves_others():
    rng = np.random.default_rng(0)
    pick = lambda chars, n: "".join(rng.choice(list(chars), n))
    lower = "abcdefghijklmnopqrstuvwxyz"
    x, y, shapes = [], [], []
    for i in range(1500):
        if i % 2:
            token = pick("0123456789abcdef", 40) if i % 4 == 1 else "AKIA" + pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 16)
        else:
            token = pick(lower, 14) + "." + pick("0123456789", 3) if i % 4 else pick("0123456789", 16)
        text = " ".join(pick(lower, 6) for _ in range(4)) + " " + token + " " + pick(lower, 9)
        start = text.index(token)
        x.append(secrets.windows(text, start, start + len(token))[0])
        y.append(float(i % 2))
        shapes.append(secrets.shape_of(token))
    x, y, shapes = np.array(x), np.array(y), np.array(shapes)
    model = secrets.CharCnn()
    model.train(x[:900], y[:900])
    model.calibrate(x[900:1100], y[900:1100])
    model.set_thresholds(x[900:1100], y[900:1100], shapes[900:1100])
    p, limit = model.probability(x[1100:]), np.array(model.thresholds)[shapes[1100:]]
    found, truth = p >= limit, y[1100:] > 0
    assert found[truth].mean() >= 0.95 and found[~truth].mean() <= 0.05
    assert abs(p[truth].mean() - 1) < 0.1 and p[~truth].mean() < 0.1  # calibrated
    long = "x " + pick("0123456789abcdef", 200) + " y"
    assert len(secrets.windows(long, 2, 202)) == 5 and all(len(w) == 84 for w in secrets.windows(long, 2, 202))


def test_rare_secrets_train_the_network(spark, caplog):
    """One document in a thousand holds a secret: all of them are found for training, whatever the table's size."""
    rng = random.Random(3)
    key = lambda n: "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=n))
    rows = [(i, f"token={key(24)} end" if i % 1000 == 0 else f"see /docs/2024/{i:06d}/report-{i % 97}.html now") for i in range(60_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = secrets.labelled_findings(docs, max_findings=400)
    assert found.filter("y = 1").count() == 60 and found.filter("y = 0").count() <= 4 * 200
    assert secrets.train_model(docs, max_findings=400) is not None
    few = docs.filter("doc_id % 1000 <> 0 or doc_id = 0")
    with caplog.at_level("WARNING"):
        assert secrets.train_model(few, max_findings=400) is None
    assert "no secret network" in caplog.text and "1 labelled secrets" in caplog.text


@pytest.mark.parametrize("text, run", [
    ("set pwd=hunter2x now", "hunter2x"), ('"pass": "correcthorse",', "correcthorse"), ("credential: opensesame", "opensesame"),
    ("Authorization: Bearer abcdefgh", "abcdefgh"), ("use x9Kq21Lmzz there", "x9Kq21Lmzz"),
    ("and CORRECTHORSEBATTERYSTAPLE end", "CORRECTHORSEBATTERYSTAPLE"), ("pwd: p@ssW0rd!x now", "p@ssW0rd!x"),
    ("a note correcthorsebat here", "correcthorsebat"), ("code 8842190375 end", "8842190375"), ("login=a$b&c~9#z now", "a$b&c~9#z"),
])
def test_short_and_digit_free_runs_are_scored(text, run):
    assert run in [text[s:e] for s, e in secrets.candidates(text)]
    everything = secrets.CharCnn()
    everything.thresholds = [0.0] * len(everything.thresholds)
    assert run in [text[s:e] for s, _, e in secrets.added_findings([text], [secrets.base_findings(text)], everything)[0]]


def test_prose_words_have_shapes_of_their_own_and_names_are_no_values():
    text = "international understanding, otherwise. 2024-01-01 opensesame1 Well-known"
    shapes = [secrets.SHAPES[secrets.shape_of(text[s:e]) % 5] for s, e in secrets.candidates(text)]
    assert shapes == ["word", "word", "word", "digits", "mixed", "word"]
    text = "'password': 'abcd1234'"
    assert [text[s:e] for s, e in secrets.values(text, secrets.base_findings(text))] == ["abcd1234"]
    assert secrets.shape_of("abcdefgh") != secrets.shape_of("abcdefgh" * 2 + "x")


def test_network_finds_short_secrets_by_their_context(spark):
    rng = random.Random(5)
    key = lambda n: "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=n))
    word = lambda n: "".join(rng.choices("etaoinshrdlu", k=n))
    size = lambda: rng.randint(8, 15)
    rows = [(i, f"{word(5)} {f'token={key(size())}' if i % 2 else f'note: {word(size())}'} {word(4)} {word(6)}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = secrets.train_model(docs, max_findings=4000)
    new = [f"{word(5)} Bearer {key(12)} {word(4)} {word(6)}" for _ in range(100)]
    plain = [f"{word(5)} credential: {word(12)} {word(4)} {word(6)}" for _ in range(100)]
    hits = lambda texts: sum(map(bool, secrets.added_findings(texts, [secrets.base_findings(t) for t in texts], model)))
    assert hits(new) >= 80 and hits(plain) <= 10


def test_short_secrets_with_symbols_are_found_and_prose_is_left_alone(spark):
    rng = random.Random(9)
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    every = lower + lower.upper() + digits
    word = lambda low, high: "".join(rng.choices("etaoinshrdlucm", k=rng.randint(low, high)))
    prose = lambda n: " ".join(word(3, 12) + rng.choice(["", "", ",", "."]) for _ in range(n))
    number = lambda: f"{rng.randint(1, 99999999):08d}"
    rows = []
    for i in range(3000):
        key = "".join(rng.choices(every, k=rng.randint(8, 15))) if i % 3 else word(8, 12)
        said = rng.choice(["password", "secret", "api_key", "token"]) + rng.choice(["=", ": ", ' = "'])
        rows.append((i, f"{prose(8)} {said}{key} {prose(8)} {number()} {prose(3)}" if i % 2 else f"{prose(16)} see: {word(8, 12)} {number()}"))
    model = secrets.train_model(spark.createDataFrame(rows, "doc_id long, text string"), max_findings=4000)
    hits = lambda texts: secrets.added_findings(texts, [secrets.base_findings(t) for t in texts], model)
    planted = ["".join(rng.choices(every, k=n - 3)) + rng.choice("!@#$%") + rng.choice(digits) + rng.choice(lower) for n in range(8, 16) for _ in range(40)]
    texts = [f"{prose(6)} pwd: {key} {prose(6)}" for key in planted]
    found = sum(key in [t[s:e] for s, _, e in spans] for key, t, spans in zip(planted, texts, hits(texts)))
    assert found >= 0.9 * len(planted)
    clean = [f"{prose(60)} {number()} {prose(5)}" for _ in range(500)]
    words = sum(len(secrets.candidates(t)) for t in clean)
    assert words > 10_000 and sum(map(len, hits(clean))) <= 0.001 * words


def test_rows_of_any_width_score_alike():
    rng = random.Random(2)
    text = " ".join("".join(rng.choices("abcXYZ019!é", k=rng.randint(1, 16))) for _ in range(300)) + " lastrun12"
    spans = secrets.candidates(text)
    codes = secrets.text_codes(text)
    model = secrets.CharCnn(3)
    wide, narrow = secrets.window_rows(codes, spans), secrets.window_rows(codes, spans, secrets.NARROW)
    assert max(e - s for s, e in spans) <= 16 and np.abs(model.logits(wide) - model.logits(narrow)).max() < 1e-5
    assert np.abs(model.logits(wide) - model._forward(wide.astype(np.int64))[3]).max() < 1e-4
    for s, e in spans:
        before, after = text[max(0, s - 24):s], text[e:e + 12]
        want = "\0" * (24 - len(before)) + before + text[s:e] + "\0" * (48 - (e - s)) + after + "\0" * (12 - len(after))
        assert secrets.windows(text, s, e) == [[c if (c := ord(ch)) != 1 and c < 127 else 1 for ch in want]]


@pytest.mark.parametrize("text, kind, source", [
    ("to john [at] example dot com now", "email", "john [at] example dot com"),
    ("to john at example.com now", "email", "john at example.com"),
    ("to john at example [dot] com now", "email", "john at example [dot] com"),
    ("to john@example dot com now", "email", "john@example dot com"),
    ("to john at example dot dev.", "email", "john at example dot dev"),
    ("to john dot doe at example dot co dot nl.", "email", "john dot doe at example dot co dot nl"),
    ("host 192 dot 168 dot 1 dot 1!", "ip", "192 dot 168 dot 1 dot 1"),
    ("call plus one, five, five, five, two, one, two, three, four now", "phone", "plus one, five, five, five, two, one, two, three, four"),
    ("call +1 five five 5 123 4567 now", "phone", "+1 five five 5 123 4567"),
    ("arrive at this.Then go, at the dot", None, None),
    ("we met at example.com today", None, None),
    ("look at www.example.com for it", None, None),
    ("I am at home.now really", None, None),
    ("go to details at example.com", None, None),
    ("write to john at www dot example dot com", None, None),
    ("to \U0001d457\U0001d45cℎ\U0001d45b@example.com now", "email", "\U0001d457\U0001d45cℎ\U0001d45b@example.com"),
    ("to ⓙohn@example.com now", "email", "ⓙohn@example.com"),
    ("to john ＠ example.com now", "email", "john ＠ example.com"),
    ("to john_at_example_dot_com now", "email", "john_at_example_dot_com"),
    ("to john-dot-doe-at-example-dot-co-dot-uk.", "email", "john-dot-doe-at-example-dot-co-dot-uk"),
    ("john.doe at example.com", "email", "john.doe at example.com"),
    ("open look_at_example_dot_ and look_at_me.txt, up-at-dawn-dot-", None, None),
])
def test_mixed_disguises(text, kind, source):
    assert [(pii.KINDS[k], text[s:e]) for s, k, e in pii.hidden(text)] == ([(kind, source)] if kind else [])


def test_mixed_disguises_are_linear():
    for unit in (" dot ", "a at a dot ", "a dot ", "1 dot ", "one, ", "a at a.", " ", "[ ", "_at_", "a_at_b_dot_", "a_at_b_dot_co ", "-dot-", "a @ ",
                 "to a at b.co ", "ⓐ"):
        pii.hidden(unit * 60_000)


def planted_addresses(seed, n):
    """(text, source of the hidden address or None) of invented sentences: half with a disguise, half prose about places and sites."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("etaoinshrdlubcm", k=rng.randint(3, 8)))
    circled = lambda s: "".join(chr(ord(c) - 97 + 0x24D0) for c in s)
    styled = lambda s: "".join("ℎ" if c == "h" else chr(ord(c) - 97 + 0x1D44E) for c in s)
    wide = lambda s: "".join(chr(ord(c) + 0xFEE0) for c in s)
    forms = [
        lambda a, b, c: f"{a} [at] {b} [dot] {c}", lambda a, b, c: f"{a} (at) {b}.{c}", lambda a, b, c: f"{a} at {b} dot {c}",
        lambda a, b, c: f"{a}@{b} dot {c}", lambda a, b, c: f"{a}_at_{b}_dot_{c}", lambda a, b, c: f"{a}-at-{b}-dot-{c}",
        lambda a, b, c: f"{circled(a)}@{b}.{c}", lambda a, b, c: f"{styled(a)}@{styled(b)}.{c}", lambda a, b, c: f"{wide(a)}＠{b}.{c}",
        lambda a, b, c: f"{a} ＠ {b}.{c}", lambda a, b, c: f"{a} @ {b}.{c}", lambda a, b, c: f"{a}.{word()} at {b}.{c}",
        lambda a, b, c: f"{a} at {b} (dot) {c}", lambda a, b, c: f"{a}\u200b@{b}.{c}",
    ]
    prose = [
        lambda b, c: f"we met at {b}.{c} today", lambda b, c: f"look at www.{b}.{c} for it", lambda b, c: f"more is at {b}.{c} now",
        lambda b, c: f"they stayed at {b}.then {word()} left", lambda b, c: f"the {word()} at {b}.{c} was shut",
        lambda b, c: f"open up_at_{b}.{c} and {word()}_dot_{b}", lambda b, c: f"point at the dot {c} of {b}", lambda b, c: f"a {word()} ⓐ at {b}",
    ]
    out = []
    for i in range(n):
        end = rng.choice(["com", "org", "net", "de", "info"])
        if i % 2:
            source = rng.choice(forms)(word(), word(), end)
            out.append((f"{word()} {rng.choice(['mail', 'write to', 'reach'])} {source}, {word()}", source))
        else:
            out.append((f"{word()}, {rng.choice(prose)(word(), end)} {word()}", None))
    return out


def test_precision_and_recall_of_planted_addresses():
    truth, found, right = 0, 0, 0
    for text, source in planted_addresses(11, 4000):
        got = [text[s:e] for s, k, e in pii.hidden(text)]
        truth, found, right = truth + (source is not None), found + len(got), right + (source in got)
    assert right / truth >= 0.99 and right / found >= 0.99, (truth, found, right)


def test_dense_text_is_scanned_in_linear_time():
    """Candidates meet findings by search, not one by one: 4 MB of both."""
    import time

    def seconds(n):
        text = " ".join(f"token={i:012x}ab pwd: {i:010d}xyz" for i in range(n))
        start = time.perf_counter()
        base = secrets.base_findings(text)
        touching = secrets.Touching([(s, e) for s, _, e in base])
        hits = sum(touching(s, e) for s, e in secrets.candidates(text))
        assert len(base) == n and hits == n
        return time.perf_counter() - start, len(text)

    small, _ = seconds(10_000)
    large, size = seconds(110_000)
    assert size > 4_000_000 and large < 25 * max(small, 0.05)


def test_touching_equals_comparing_all():
    import random

    rng = random.Random(3)
    for _ in range(300):
        spans = [(s, s + rng.randrange(0, 9)) for s in (rng.randrange(60) for _ in range(rng.randrange(8)))]
        touching = secrets.Touching(spans)
        for start in range(60):
            end = start + rng.randrange(1, 9)
            assert touching(start, end) == any(s < end and start < e for s, e in spans if s < e) or any(s == e for s, e in spans)


def test_only_the_smallest_hashes_reach_the_driver(spark):
    rows = [(hash(("h", i)) * 1_000_003 % (1 << 64) - (1 << 63), bytes([i % 256]), 1, 0) for i in range(5000)]
    found = spark.createDataFrame(rows, "h long, x binary, y int, shape int").repartition(8)
    for size in (1, 50, 4000, 6000):
        assert [r["h"] for r in secrets._smallest(found, size)] == sorted(r[0] for r in rows)[:size]


def _keys_and_words(n):
    rng = random.Random(11)
    pick = lambda chars, k: "".join(rng.choices(chars, k=k))
    letters = "abcdefghijklmnopqrstuvwxyz"
    return [f"{pick(letters, 5)} token={pick(letters + '0123456789', 20)} end" if i % 3 == 0 else
            f"{pick(letters, 4)} see {pick(letters, 9)}{'' if i % 2 else '/' + pick('0123456789', 3) + pick(letters, 2)} now" for i in range(n)]


def test_every_candidate_trains_the_network_and_sets_its_thresholds(spark):
    """Documents that the first weights don't see still change the weights, the calibration and the thresholds."""
    texts, size = _keys_and_words(3000), 400
    of: dict = {}
    for t in texts:
        for _, h, sort, _ in secrets.labelled_windows(t, secrets.hash_factors()):
            for x, k in zip(h.tolist(), sort.tolist()):
                of.setdefault(k, []).append((x, t))
    drawn = sorted({t for some in of.values() for _, t in sorted(some)[:size // 4]})
    assert len(drawn) < len(texts) / 4
    rows = lambda some: spark.createDataFrame([(i, t) for i, t in enumerate(some)], "doc_id long, text string")
    a, b = (secrets.train_model(rows(some), max_findings=size) for some in (texts, drawn))
    assert np.abs(a.p["w2"] - b.p["w2"]).max() > 1e-6 and abs(a.scale - b.scale) > 1e-6 and a.thresholds != b.thresholds
    again = secrets.train_model(rows(texts[::-1]).repartition(3), max_findings=size)
    assert np.allclose(a.p["conv"], again.p["conv"], atol=1e-6) and np.allclose(a.thresholds, again.thresholds, atol=1e-4)


def test_table_gradient_is_the_slope_over_every_candidate(spark):
    texts, model = _keys_and_words(300), secrets.CharCnn(3)
    docs = spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string").repartition(3)
    dealt = np.array([0]), np.array([4])
    n, sums = secrets.table_gradient(docs, model, dealt)
    x, y = [], []
    for t in texts:
        for rows, h, sort, _ in secrets.labelled_windows(t, secrets.hash_factors()):
            rows[((h >> 40) & 1 == 1) & (sort != 3), :24] = 0
            x.append(rows[h % 5 < 3])
            y.append(sort[h % 5 < 3] >= 2)
    x, y = np.concatenate(x).astype(np.int64), np.concatenate(y).astype(float)
    assert n.sum() == len(x) and n[2:].sum() == y.sum()

    def loss():
        z = model._forward(x)[3]
        return (np.logaddexp(0, z) - y * z).sum()

    total, at = sums.sum(axis=0), 0
    for k, w in model.p.items():
        g = total[at:at + w.size]
        at += w.size
        i = int(np.abs(g).argmax())
        w.flat[i] += 1e-5
        up = loss()
        w.flat[i] -= 2e-5
        down = loss()
        w.flat[i] += 1e-5
        assert abs((up - down) / 2e-5 - g[i]) <= 1e-2 * max(1, abs(g[i])), k


def _odd_texts(n):
    rng = random.Random(17)
    pieces = [*"abzXY09.=-/!@# \0\x01é_\n", "password=", "token: ", "AKIA", "0f" * 17, "\ud800", "İ", "Word-", "UPPER", "name=", "2024"]
    texts = ["".join(rng.choices(pieces, k=rng.randrange(60))) for _ in range(n)]
    return texts + ["", *("é" * (k % 2) + "a" * k + x for k in range(110) for x in ("", " b", "é"))]


def test_candidates_of_many_texts_together_are_those_of_each():
    texts, run = _odd_texts(400), re.compile(f"[{secrets.KEY}]{{8,}}")
    found = secrets.Texts(texts)
    of = np.searchsorted(found.at, found.start, "right") - 1
    got = list(zip(of.tolist(), (found.start - found.at[of]).tolist(), (found.stop - found.at[of]).tolist()))
    want = []
    for i, text in enumerate(texts):
        for m in run.finditer(text):
            name = secrets.NAMED.match(text, *m.span())
            want.append((i, name.end() if name else m.start(), m.end()))
    assert got == want and found.shape.tolist() == [secrets.shape_of(texts[i][s:e]) for i, s, e in want]
    assert found.bases() == [secrets.base_findings(t) for t in texts]
    found.label()
    labels = [[*secrets.labelled_windows(t, secrets.hash_factors())] for t in texts]
    assert found.sort.tolist() == [k for some in labels for _, _, sort, _ in some for k in sort]
    (_, rows, h), = secrets.hashed_rows(found, secrets.hash_factors())
    assert (rows == np.concatenate([x for some in labels for x, *_ in some])).all() and h.tolist() == [x for some in labels for _, y, *_ in some for x in y]


def test_responses_along_the_text_are_those_of_each_window(monkeypatch):
    """Scores and slopes of every candidate, one convolution for all, as from its own row of codes."""
    monkeypatch.setattr(secrets, "CELL", 256)
    texts = _odd_texts(400) + _keys_and_words(200)
    found, model = secrets.Texts(texts), secrets.CharCnn(3)
    found.label()
    start, stop = found.start, np.minimum(found.stop, found.start + secrets.INSIDE)
    alone = np.arange(len(start)) % 3 == 0
    x, y = found.rows(start, stop), (found.sort >= 2).astype(float)
    x[alone, :secrets.BEFORE] = 0
    order = np.random.default_rng(2).permutation(len(start))  # in any order
    assert np.abs(model.span_logits(found, start[order], stop[order], alone[order]) - model.logits(x)[order]).max() < 1e-9
    got, want = model.span_gradients(found, start, stop, alone, y, found.sort), model.gradients(x, y, found.sort)
    assert np.abs(got - want).max() <= 1e-9 * np.abs(want).max() and set(found.sort.tolist()) == {0, 1, 2, 3}
