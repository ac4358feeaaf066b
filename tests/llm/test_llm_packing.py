"""Packing: token ids against the ``tokenizers`` library, placement, and how full sequences are."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from conftest import SF_ORACLE
from pagewright.llm import packing, tokens

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_ids_equal_the_library(library, monkeypatch):
    rng = random.Random(4)
    alphabet = [" ", "  ", "\n", "\t", "a", "bc", "'s", "12", "é", " ", "!", "<|endoftext|>", "\r\n", "中", "'ll", "　", "\x85", "\x1f", "²", "Ⅷ", "\u0301", "_", "٣", "\ua7ce", "\u1c89", "½", "ª", "\u200b", "\U0001f600", "İ"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(3000)]
    encoder = tokens.Encoder(VOCABULARY)
    for piece in (tokens.PIECE, 5):
        monkeypatch.setattr(tokens, "PIECE", piece)
        for t in texts:
            assert encoder.encode(t).tolist() == library(t)


def test_every_character_is_cut_as_the_library_cuts_it(library):
    """All characters, each in four neighbourhoods: looked-up pieces give the library's ids."""
    encoder = tokens.Encoder(VOCABULARY)
    for low in range(0, 0x30000, 64):
        for ch in map(chr, range(low, low + 64, 1 if low < 0x3100 else 16)):
            if not "\ud800" <= ch <= "\udfff":
                t = f"1{ch}!{ch}a{ch} {ch}"
                assert encoder.encode(t).tolist() == library(t), hex(ord(ch))


@pytest.mark.parametrize("run", [" ", "\n", "\t", " \n", "a", "1", "!", "é"])
def test_long_runs(library, run):
    text = f"start {run * (3_000_000 // len(run))}x end" if run.isspace() else f"start {run * 200_000} end"
    assert tokens.Encoder(VOCABULARY).encode(text).tolist() == library(text)


def test_what_is_remembered_is_bounded(library, monkeypatch):
    monkeypatch.setattr(tokens, "KEPT", 50)
    encoder = tokens.Encoder(VOCABULARY)
    text = " ".join(f"w{i}x {i}" for i in range(500)) + " " + "long" * 50
    assert encoder.encode(text).tolist() == library(text) and len(encoder.known) <= 51


def test_long_white_space_packs(spark, library):
    texts = [" " * 3_000_000, "\n" * 3_000_000 + "x", "a" + "\t" * 3_000_000]
    got = packing.pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), VOCABULARY).collect()
    for i, t in enumerate(texts):
        assert sum(r["length"] for r in got if r["doc_id"] == i) == len(library(t)) + 1
    check_places(got, 2048)


def check_places(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_documents_against_the_library(spark, library):
    docs = spark.read.parquet(f"{SF_ORACLE}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(None, "null id"), (-1, None), (-2, ""), (-3, "a b " * 5000)], "doc_id long, text string")
    docs = docs.unionByName(odd)
    got = packing.pack_documents(docs, VOCABULARY, with_ids=True).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    rows = docs.collect()
    assert set(by) == {r["doc_id"] for r in rows}
    for doc in rows:
        ids = [*library(doc["text"] or ""), 0]
        pieces = sorted(by[doc["doc_id"]], key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(-(-len(ids) // 2048)))
        at = 0
        for r in pieces:
            part = ids[at:at + r["length"]]
            assert r["start"] == at and r["ids"] == part and r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
            at += r["length"]
        assert at == len(ids) and all(r["length"] == 2048 for r in pieces[1:])
    used = check_places(got, 2048)
    assert used <= 1.02 * sum(r["length"] for r in got) / 2048 + 1
    some = packing.sequences(spark.createDataFrame(got[:0] or got).select("sequence_id", "offset", "ids"))
    assert some.count() == used


def plan_rows(spark, lengths, capacity):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id int, length long").repartition(3)
    return packing.pack(df, capacity).collect()


@pytest.mark.parametrize("lengths, capacity, most", [
    ([7] * 500, 20, 250), ([1] * 1000, 64, 16), ([64] * 9, 64, 9), ([33] * 10 + [31] * 10, 64, 10), ([5, 3, 8, 1], 8, 3), ([], 8, 0),
    ([i % 63 + 1 for i in range(1000)], 64, 510),
])
def test_plans(spark, lengths, capacity, most):
    got = plan_rows(spark, lengths, capacity)
    assert sorted(r["doc_id"] for r in got) == list(range(len(lengths)))
    assert check_places(got, capacity) <= most


def test_ranges_swept_apart_agree_on_the_rules(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANGES", 40)
    lengths = [i * 7 % 40 + 1 for i in range(300)]
    got = plan_rows(spark, lengths, 64)
    assert len(got) == 300 and check_places(got, 64) <= 1.06 * sum(lengths) / 64 + 1


def test_empty_table_and_clashes(spark):
    schema = "doc_id long, text string, piece string, _rank int, length string"
    assert packing.pack_documents(spark.createDataFrame([], schema), VOCABULARY).collect() == []
    got = packing.pack_documents(spark.createDataFrame([(1, "x", "p", 1, "l"), (1, "x", "p", 1, "l")], schema), VOCABULARY).collect()
    assert len(got) == 2 and check_places(got, 2048) == 1
