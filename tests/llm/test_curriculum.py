"""Mixing: targets, nearness, determinism, hot sources, odd rows."""

import os
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from touchline.llm import curriculum

SF = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
SCHEMA = "doc_id long, source string, size long"


def plain_targets(sizes, weights=(5, 2, 1), cap=3):
    """Share by weight, hold at the cap, reshare the excess until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, free = {}, set(order)
    while free:
        left = sum(sizes.values()) - sum(target.values())
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > cap * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in free}
        target |= {s: float(cap * sizes[s]) for s in over}
        free -= over
    return target


def check(rows):
    """Rows (doc_id, source, size, source_size, target, taken) keep the contract."""
    size, taken, longest = Counter(), Counter(), Counter()
    for r in rows:
        size[r.source] += r.size
        taken[r.source] += r.taken
        longest[r.source] = max(longest[r.source], r.size)
        assert 0 <= r.taken <= 3 * r.size
    want = plain_targets(size)
    for r in rows:
        assert r.source_size == size[r.source] and r.target == pytest.approx(want[r.source])
    for s in size:
        assert abs(taken[s] - want[s]) <= longest[s]


def test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = curriculum.op2_curriculum(spark, SF)
    assert out.count() == docs.count()
    check(out.join(docs.select("doc_id", "source"), "doc_id").collect())
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, curriculum.op2_curriculum(spark, SF).collect()))
    text = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.size == len(re.findall(r"[^\x20\x09-\x0D]+", text[r.doc_id])) for r in out.collect())


@pytest.mark.parametrize("bucket", [3, 20_000])
def test_hot_and_tiny_sources(spark, monkeypatch, bucket):
    monkeypatch.setattr(curriculum.stream_places, "__defaults__", (bucket,))
    rows = [(i, "hot", 10 + i % 7) for i in range(600)] + [(1000 + i, s, 5) for i, s in enumerate("abcdefg")] + [(2000, None, 40), (2001, None, 0), (2002, "", 3)]
    check(curriculum.positions(spark.createDataFrame(rows, SCHEMA)).collect())


def test_odd_rows(spark):
    rows = [(None, None, 0), (1, "a", 4), (1, "a", 4), (None, "a", 4), (2, "z", 0)]
    out = curriculum.positions(spark.createDataFrame(rows, SCHEMA).withColumn("times_seen", F.lit(1)))
    assert out.count() == 5 and "times_seen" in out.columns
    assert sum(r.taken for r in out.collect()) == 12
    assert curriculum.positions(spark.createDataFrame([], SCHEMA)).count() == 0
    assert spark.createDataFrame([(None,), ("",), (" a b \x0b c\x1fd ",)], "text string").select(curriculum.word_count("text")).collect() == [(0,), (0,), (2,)]


def test_training_order_follows_the_ramps(spark):
    rows = [(i, "abc"[i % 3], 10) for i in range(3000)]
    out = curriculum.in_training_order(curriculum.positions(spark.createDataFrame(rows, SCHEMA)))
    times = {s: [r.time for r in out.where(F.col("source") == s).collect()] for s in "abc"}
    early = {s: sum(t < 0.5 for t in v) / len(v) for s, v in times.items()}
    assert early["a"] == pytest.approx(0.6, abs=0.01) and early["b"] == pytest.approx(0.5, abs=0.01) and early["c"] == pytest.approx(0.4, abs=0.01)
    got = [r.time for r in out.collect()]
    assert got == sorted(got)


def test_columns_named_like_its_own(spark):
    """Scratch names pass through, names of outputs are replaced, and nothing else changes."""
    rows = [(i, "ab"[i % 2], 5 + i) for i in range(30)]
    plain = curriculum.positions(stored_frame(spark, rows, "doc_id long, source string, size long"))
    clash = "rows string, begins string, ramp_from string, target string, source_size string, weight string, taken string, time string, _copies string, `value.x` string"
    names = [c.split(" ")[0].strip("`") for c in clash.split(", ")]
    odd = curriculum.positions(stored_frame(spark, [(*r, *["kept"] * len(names)) for r in rows], f"doc_id long, source string, size long, {clash}"))
    own = ["source_size", "weight", "target", "times", "taken"]
    assert {r.doc_id: tuple(r[c] for c in own) for r in plain.collect()} == {r.doc_id: tuple(r[c] for c in own) for r in odd.collect()}
    assert len(odd.columns) == len(set(odd.columns)) and {r["value.x"] for r in odd.collect()} == {r["begins"] for r in odd.collect()} == {"kept"}
    assert curriculum.in_training_order(odd).count() == sum(r.taken // r["size"] for r in plain.collect())


def stored_frame(spark, rows, schema):
    from touchline.session import stored

    return stored(spark.createDataFrame(rows, schema))


def test_bitmap_columns_named_like_its_own(spark):
    from touchline.llm import lines

    rows = [(i, "same line\nown %d" % i, "x", "y", "z") for i in range(12)]
    out = lines.with_bitmaps(spark.createDataFrame(rows, "doc_id long, text string, keep string, n_lines string, text_h1 string"), 10)
    assert len(out.columns) == len(set(out.columns)) and {(r.n_lines, r.n_dropped) for r in out.collect()} == {(2, 1)}
