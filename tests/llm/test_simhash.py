"""SimHash trie join and components against brute force."""

import os
import random

import numpy as np
import pytest
import xxhash

from touchline.llm import simhash
from touchline.llm.components import components, spanning_links

SF = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
SCHEMA = "doc_id long, text string, fp string, source string"


def plain_fingerprint(text):
    words = simhash_words(text)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def simhash_words(text):
    import re

    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def plain_components(keys, linked):
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {k: find(k) for k in keys}


def expected(texts):
    fp = {i: plain_fingerprint(t) for i, t in texts.items()}
    ids = sorted(fp)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if (fp[a] ^ fp[b]).bit_count() <= 2]
    return fp, plain_components(ids, links)


def test_table_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    fp, root = expected({r.doc_id: r.text for r in docs.collect()})
    out = simhash.op5_simhash_trie(spark, SF).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in out} == {i: (f"{fp[i]:016x}", root[i]) for i in fp}
    assert len(out) == len(fp)


def test_odd_rows(spark):
    texts = {0: None, 1: "", 2: " \n", 3: "One", 4: "one", 5: "a b", 6: "A B C", 7: "ÀB c d", 8: "word " * 150_000, 9: "word " * 150_000 + "x"}
    docs = spark.createDataFrame([(i, t, "clash", None) for i, t in texts.items()], SCHEMA)
    fp, root = expected(texts)
    out = simhash.near_duplicates(docs.unionByName(docs)).collect()
    assert len(out) == 2 * len(texts)
    assert {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in out} == {i: (fp[i], root[i]) for i in fp}
    assert simhash.near_duplicates(docs.where("doc_id < 0")).count() == 0
    nulls = simhash.near_duplicates(docs.selectExpr("cast(NULL AS long) AS doc_id", "text")).collect()
    assert len(nulls) == len(texts) and all(r.component_id is None for r in nulls)


@pytest.mark.parametrize("node_classes", [8, 60, 100_000])
def test_trie_join_finds_every_close_pair(spark, node_classes):
    """Dense groups, uneven prefixes and nodes of different depths."""
    rnd = random.Random(node_classes)
    prints = {0, (1 << 64) - 1}
    for _ in range(30):
        base = rnd.getrandbits(64) if rnd.random() < 0.6 else rnd.getrandbits(20)
        for _ in range(rnd.choice([1, 5, 20])):
            prints.add(base ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 3))))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    nodes = simhash.cut_trie(spark.createDataFrame([(p,) for p in signed], "fp long"), node_classes)
    assert nodes.groupBy("depth", "prefix").count().where(f"count > {node_classes}").count() == 0 and nodes.count() == len(prints)
    found = components(simhash.class_links(nodes)).collect()
    order = sorted(signed)
    links = [(a, b) for n, a in enumerate(order) for b in order[n + 1 :] if ((a ^ b) % (1 << 64)).bit_count() <= 2]
    want = plain_components(order, links)
    assert {r.node: r.root for r in found} == {k: v for k, v in want.items() if any(k in p for p in links)}


def test_close_pairs_in_small_fronts(monkeypatch):
    monkeypatch.setattr(simhash, "FRONTIER", 50)
    rnd = np.random.default_rng(2)
    u = np.unique(rnd.integers(0, 1 << 12, 300).astype(np.uint64) << np.uint64(20))
    got = {(int(a), int(b)) for i, j in simhash.close_pairs(u, u, 2, True) for a, b in zip(i, j)}
    assert got == {(i, j) for i in range(len(u)) for j in range(i + 1, len(u)) if int(u[i] ^ u[j]).bit_count() <= 2}


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(200, 260)]
    star = [(1000, i) for i in range(1001, 1100)]
    out = {r.node: r.root for r in components(spark.createDataFrame([*chain, *star, (7, 7), (-5, -9)], "a long, b long")).collect()}
    assert out == {**{i: 200 for i in range(200, 261)}, **{i: 1000 for i in range(1000, 1100)}, -5: -9, -9: -9}
    a, b = spanning_links(np.array([3, 5, 1]), np.array([1, 4, 0]), 7)
    assert sorted(zip(a.tolist(), b.tolist())) == [(1, 0), (3, 0), (5, 4)]
