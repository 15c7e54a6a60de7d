"""Shingle similarity joins against brute force."""

import os
import random

import numpy as np

import corpus_pipeline as cp
from touchline.llm import jaccard
from tests.llm.test_simhash import plain_components, simhash_words

SF = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")


def plain_set(text):
    words = simhash_words(text)
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def plain_roots(texts):
    sets = {i: plain_set(t) for i, t in texts.items()}
    ids = sorted(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    return plain_components(ids, links)


def copies(seed=1):
    """Texts with one to twenty changed words, at all similarities around the border, a chain and a dense group."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    texts = [None, "", " ", "a b", "A  b", "a b c d e"]
    for n in (12, 40, 100, 250):
        for _ in range(6):
            base = [word() for _ in range(n)]
            texts.append(" ".join(base))
            for changes in (1, 2, 3, 5, 8):
                other = list(base)
                for at in rng.sample(range(n), min(n, changes)):
                    other[at] = word()
                texts.append(" ".join(other))
    chain = [word() for _ in range(200)]
    for _ in range(30):
        chain = chain[4:] + [word() for _ in range(4)]
        texts.append(" ".join(chain))
    base = [word() for _ in range(120)]
    for _ in range(60):
        other = list(base)
        other[rng.randrange(120)] = word()
        texts.append(" ".join(other))
    return dict(enumerate(texts))


def found(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    return {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs).collect()}


def test_equals_brute_force(spark):
    texts = copies()
    assert found(spark, texts) == plain_roots(texts)


def test_result_does_not_hang_on_the_sample(spark, monkeypatch):
    texts = copies(2)
    monkeypatch.setattr(jaccard, "SAMPLE_DOCUMENTS", 20)
    monkeypatch.setattr(jaccard, "COMMON", 1)
    monkeypatch.setattr(jaccard, "BUCKET_ROWS", 300)
    assert found(spark, texts) == plain_roots(texts)


def test_stage_keeps_one_of_each_group(spark):
    texts = copies(3)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    root = plain_roots(texts)
    assert {r.doc_id for r in cp.without_near_duplicates(spark, docs, SF).collect()} == {i for i in texts if root[i] == i}


def test_table_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = jaccard.near_duplicates(docs).collect()
    assert {r.doc_id: r.component_id for r in out} == plain_roots({r.doc_id: r.text for r in docs.collect()})


def test_long_lists_give_the_pairs_of_short_ones():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    n = rng.integers(50, 90, 1200)
    rows = pa.table({"h": np.zeros(1200, np.int64), "cls": np.arange(1200), "n": n, "at": np.zeros(1200, np.int64), "root": np.arange(1200) // 3})
    got = {(a, b) for a, b in zip(*(c.to_pylist() for c in jaccard.close_lists(rows, False).columns))}
    want = {(a, b) for a in range(1200) for b in range(a + 1, 1200) if a // 3 != b // 3 and 5 * min(n[a], n[b]) >= 4 * max(n[a], n[b])}
    assert got == want
