"""The pipeline's stages against plain versions on the small table, and the whole run."""

import os
import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline as cp
from touchline.llm import curriculum, toxicity
from touchline.session import stored
from tests.llm.test_curriculum import plain_targets
from tests.llm.test_jaccard import plain_roots
from tests.llm.test_simhash import simhash_words

SF = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def results(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs)
    for _, stage in cp.STAGES:
        docs = stored(stage(spark, docs, SF))
        out.append(docs)
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns_stay(results):
    assert all(df.columns == ["doc_id", "text", "lang", "source", "n_chars"] for df in results[:-1])


def test_toxic_documents_go(spark, results):
    before, after = rows(results[0]), rows(results[1])
    model = toxicity.train(results[0], spark.read.parquet(f"{SF}/labels.parquet"))
    assert set(after) == {i for i, r in before.items() if toxicity.score_text(r.text, model, {}) < 0.5}
    assert all(after[i] == before[i] for i in after)


def test_repeated_lines_keep_the_first(results):
    before, after = rows(results[1]), rows(results[2])
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    found = defaultdict(set)
    for i, r in before.items():
        for line in (r.text or "").split("\n"):
            found[key(line)].add(i)
    for i in sorted(before):
        seen, kept = set(), []
        for line in (before[i].text or "").split("\n"):
            k = key(line)
            if not k or len(found[k]) < 10 or (i == min(found[k]) and k not in seen):
                kept.append(line)
            seen.add(k)
        assert after[i].text == "\n".join(kept) and after[i].n_chars == len(after[i].text)


def test_one_of_each_group_stays(results):
    """Groups over Jaccard similarities of five-word shingle sets of at least 0.8, by brute force."""
    before, after = rows(results[2]), rows(results[3])
    root = plain_roots({i: r.text for i, r in before.items()})
    assert set(after) == {i for i in before if root[i] == i} and len(after) < len(before)
    assert all(after[i] == before[i] for i in after)


def test_mix_meets_its_targets(results):
    before, after = rows(results[3]), results[4].collect()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for i, r in before.items()}
    by_source, taken, longest = Counter(), Counter(), Counter()
    for i, r in before.items():
        by_source[r.source] += size[i]
        longest[r.source] = max(longest[r.source], size[i])
    for r in after:
        taken[r.source] += size[r.doc_id]
    for source, target in plain_targets(by_source).items():
        assert abs(taken[source] - target) <= longest[source]
    assert max(Counter(r.doc_id for r in after).values()) <= 3


def test_all_of_the_mix_is_packed(results):
    copies = Counter(r.doc_id for r in results[4].collect())
    pieces = results[5].collect()
    total, tokens = Counter(), {}
    for r in pieces:
        total[r.doc_id] += r.length
        tokens[r.doc_id] = r.doc_tokens
    assert total == {i: n * tokens[i] for i, n in copies.items()}


def test_run_and_empty_table(spark, results, tmp_path):
    assert cp.run(spark, SF).count() == results[5].count()
    docs = results[0].where("doc_id < 0")
    for _, stage in cp.STAGES:
        docs = stored(stage(spark, docs, SF))
    assert docs.count() == 0


def test_odd_rows(spark):
    rows = [(None, None, None, None, None, 1), (1, "", "en", "a", 0, 2), (2, "x " * 9000, None, None, 18000, 3), (2, "x " * 9000, None, None, 18000, 3), (3, "A b\n c", "en", "b", 6, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size int")
    for _, stage in cp.STAGES:
        docs = stored(stage(spark, docs, SF))
    # equal rows have one id, so both stay
    assert {r.doc_id for r in docs.collect()} >= {2, 3} and simhash_words("A b") == ["a", "b"]
    assert curriculum.CAP == 3
