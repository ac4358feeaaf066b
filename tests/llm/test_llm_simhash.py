"""SimHash: fingerprints, the Golay keys and the fuzzy join against brute force."""

import itertools
import random

import numpy as np
import xxhash

from conftest import SF_SMALL
from pagewright.llm import simhash


def slow_fingerprint(text):
    import re

    low = "".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows, bits=3):
    """rows: (id, fingerprint); smallest id reachable per row."""
    fps = sorted({f for _, f in rows})
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= bits:
            root[find(a)] = find(b)
    low = {}
    for i, f in rows:
        low[find(f)] = min(i, low.get(find(f), i))
    return {i: low[find(f)] for i, f in rows}


def test_fingerprints(monkeypatch):
    texts = ["", "One", "one TWO", "a b c", "a b c d a b c d", "É é x y\x0bz\x0c w", "   ", " lead and trail  ", "z " * 50,
             " ".join(str(i * i % 97) for i in range(500))]
    want = [slow_fingerprint(t) for t in texts]
    assert [simhash.fingerprint_bytes(t.encode()) for t in texts] == want
    monkeypatch.setattr(simhash, "BLOCK", 5)  # texts in many blocks
    assert [simhash.fingerprint_bytes(t.encode()) for t in texts] == want


def test_golay_code_is_perfect():
    words = np.arange(1 << 12) << 11
    near = simhash.codewords_near(np.arange(0, 1 << 23, 37))
    assert near.min() >= 0 and near.max() < 1 << 12
    own = simhash.codewords_near(words)[:, 0]  # every word decodes within distance 3
    assert len(np.unique(own)) <= 1 << 12
    rng = random.Random(3)
    for _ in range(300):  # a word one bit away decodes to a codeword nearby
        w = rng.randrange(1 << 23)
        v = w ^ (1 << rng.randrange(23))
        a, b = simhash.codewords_near(np.array([w, v]))
        assert b[0] in a and a[0] in b


def test_keys_cover_every_pattern_of_three_bits():
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(4)] + [0, (1 << 64) - 1]
    flips = [c for k in (0, 1, 2) for c in itertools.combinations(range(64), k)]
    flips += rng.sample(list(itertools.combinations(range(64), 3)), 12_000)
    masks = np.array([sum(1 << i for i in c) for c in flips], np.uint64)
    for b in base:
        _, asked = simhash.fuzzy_keys(np.array([b], np.uint64))
        stored, _ = simhash.fuzzy_keys(np.uint64(b) ^ masks)
        assert np.isin(stored, asked[0]).any(axis=1).all()


def planted(n=400, seed=5):
    rng = random.Random(seed)
    fps = []
    for _ in range(n):
        f = rng.getrandbits(64)
        fps.append(f)
        for _ in range(rng.randrange(4)):
            for bit in rng.sample(range(64), rng.choice([1, 2, 3, 4, 5])):
                f ^= 1 << bit
            fps.append(f)
    centre = rng.getrandbits(64)  # a dense family
    fps += [centre ^ sum(1 << b for b in rng.sample(range(64), 2)) for _ in range(300)]
    return fps


def check_links(spark, fps):
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in sorted(set(fps))]
    links = simhash.near_links(spark.createDataFrame(signed, "fp long").repartition(4)).collect()
    rows = [(f, f) for f in sorted(set(fps))]
    want = slow_components(rows)
    root = {f: f for f, _ in rows}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for r in links:
        a, b = r["a"] % (1 << 64), r["b"] % (1 << 64)
        root[find(a)] = find(b)
    groups = {}
    for f, _ in rows:
        groups.setdefault(find(f), []).append(f)
    assert {f: min(g) for g in groups.values() for f in g} == want


def test_links_span_all_links(spark):
    check_links(spark, planted())


def test_hot_keys_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_BUCKET", 40)
    monkeypatch.setattr(simhash, "SAMPLE", 1)
    fps = planted(100, 9)
    assert simhash._hot_keys(spark.createDataFrame([((f - (1 << 64)) if f >> 63 else f,) for f in set(fps)], "fp long"))
    check_links(spark, fps)


SCHEMA = "doc_id long, text string, _fp int, _row string"


def test_groups_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = [(r["doc_id"], slow_fingerprint(r["text"])) for r in docs.collect()]
    want = slow_components(rows)
    got = {r["doc_id"]: r for r in simhash.near_groups(docs).collect()}
    assert len(got) == len(rows)
    for i, f in rows:
        assert got[i]["fingerprint"] == f"{f:016x}" and got[i]["component_id"] == want[i] and got[i]["kept"] == (want[i] == i)


def test_nulls_ties_repeats_and_clashes(spark):
    text = " ".join(f"w{i}" for i in range(60))
    data = [(5, text, 1, "a"), (5, text, 2, "b"), (3, text, 1, "c"), (None, text, 1, "d"), (8, None, 1, "e"), (9, "", 1, "f"),
            (None, "alone here", 1, "g")]
    df = spark.createDataFrame(data, SCHEMA)
    got = simhash.near_groups(df).collect()
    assert sorted(str((r["doc_id"], r["component_id"], r["kept"])) for r in got) == sorted(map(str, [
        (5, 3, False), (5, 3, False), (3, 3, True), (None, 3, False), (8, 8, True), (9, 8, False), (None, None, True)]))
    kept = simhash.drop_near_copies(df)
    assert kept.columns == df.columns
    assert sorted(r["_row"] for r in kept.collect()) == ["c", "e", "g"]
    assert simhash.drop_near_copies(spark.createDataFrame([], SCHEMA)).collect() == []
    assert simhash.near_groups(spark.createDataFrame([], SCHEMA)).collect() == []
