"""Packing: exact round trip of ids, capacity, padding, odd rows."""

import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from touchline.llm import packing

SF = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
PATH = packing.default_tokenizer()
SCHEMA = "doc_id long, text string, source string, length int"


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def check_pieces(rows, ids, capacity):
    """Every id of every document in exactly one piece; sequences gapless and padded only up to a power of two."""
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == ids.keys()
    for d, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids[d])
            assert bytes(r.ids) == ids[d][r.start : r.start + r.length].tobytes()
            at += r.length
        assert at == len(ids[d])
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == capacity or at & (at - 1) == 0
    return by_seq


def test_round_trip_of_the_table(spark, tokenizer):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r.doc_id: np.array(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4") for r in docs.collect()}
    check_pieces(packing.pack(docs, PATH).collect(), ids, 4096)
    crc = {(r.doc_id, r.start): r for r in packing.op1_cost_packing(spark, SF).collect()}
    for (d, s), r in crc.items():
        assert r.ids_crc32 == zlib.crc32(ids[d][s : s + r.length].tobytes())


def test_odd_rows(spark, tokenizer):
    texts = [None, "", " \n\t", "a" * 30_000, "word " * 20_000, "Ünïcode ÷×ß 你好 <|endoftext|> it's we'll", "x\x85y\xa0z\x1c1", "same", "same"]
    docs = spark.createDataFrame([(i, t, None, 7) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    ids = {i: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for i, t in enumerate(texts)}
    check_pieces(packing.pack(docs, PATH, capacity=256, group_sequences=8).collect(), ids, 256)
    nothing = packing.pack(docs.where("doc_id < 0"), PATH)
    assert nothing.count() == 0 and nothing.columns[0] == "doc_id"
    null_id = packing.pack(docs.withColumn("doc_id", F.lit(None).cast("long")), PATH)
    assert null_id.agg(F.sum("length")).first()[0] == sum(map(len, ids.values()))


def test_word_encoder_equals_the_tokenizer(tokenizer):
    encode, rnd = packing.WordEncoder(PATH), random.Random(5)
    letters = "abcDEFghijklmnopqrstuvwxyzéÈäßøÿµª²½0123'\"!?.,-_/\\<|> \n\t\r\x85\xa0\x0b\x00\x7f\x9f÷×"
    for _ in range(4000):
        text = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40)))
        assert encode(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


def test_costs_are_balanced():
    rnd = random.Random(3)
    lengths = [rnd.randint(1, 900) for _ in range(400)]
    pieces = packing.pack_group(lengths, 4096, 1.0, 1 / 1024)
    full = {}
    for d, s, n, k, o in pieces:
        full.setdefault(k, []).append(n)
    costs = [sum(n + n * n / 1024 for n in v) for v in full.values() if sum(v) == 4096]
    assert max(costs) < 1.15 * min(costs)
    assert sum(n for p in full.values() for n in p) == sum(lengths)
