"""Sharding over virtual slots: balance, places, rebalancing; line bitmaps with both rules."""

import os
import zlib
from collections import Counter

import pytest

from touchline.llm import lines, slots

SF = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
DOCS = "doc_id long, text string, slot int, shard string"


def test_table(spark):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = slots.op9_virtual_slots(spark, SF).collect()
    assert len(out) == len(text)
    places, load = {}, Counter()
    for r in out:
        body = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(body) + 16, zlib.crc32(body), "bytes", None)
        places.setdefault(r.shard, []).append(r.slot)
        load[r.shard] += r.size
    assert set(places) <= set(range(40)) and all(sorted(p) == list(range(len(p))) for p in places.values())
    assert max(load.values()) - min(load.values()) <= max(r.size for r in out)
    # slots of the map stay whole
    assert all(len({r.shard for r in out if r.virtual_slot == s}) == 1 for s in {r.virtual_slot for r in out})


def test_rebalancing_edits_the_map(spark):
    docs = spark.createDataFrame([(i, "x" * (i % 50), 0, "") for i in range(5000)], DOCS)
    rows = slots.records(docs, slots=256).cache()
    loads = slots.slot_loads(rows, 256).cache()
    first = slots.first_map(loads, 4).cache()
    grown = slots.rebalanced(first, loads, 5).cache()
    old, new = ({r.virtual_slot: r.shard for r in m.collect()} for m in (first, grown))
    assert set(old) == set(new) == set(range(256)) and {r.version for r in grown.collect()} == {2}
    size = {r.virtual_slot: r.bytes for r in loads.collect()}
    load = Counter()
    for s, shard in new.items():
        load[shard] += size[s]
    assert len(load) == 5 and max(load.values()) < 1.06 * min(load.values())
    moved = [s for s in old if old[s] != new[s]]
    assert sum(size[s] for s in moved) < 1.3 * sum(size.values()) / 5
    again = slots.rebalanced(first.unionByName(grown), loads, 5)
    assert {r.virtual_slot: r.version for r in again.collect()} == dict.fromkeys(range(256), 3)


def test_odd_rows(spark):
    rows = [(None, None, 1, "a"), (None, None, 1, "a"), (1, "", 2, None), (2, "é" * 100_000, 3, "b"), (2, "é" * 100_000, 3, "b")]
    out = slots.shard_documents(spark.createDataFrame(rows, DOCS), 3).collect()
    assert len(out) == 5 and sorted(r.size for r in out) == [16, 16, 16, 200_016, 200_016]
    for shard in range(3):
        mine = sorted(r.slot for r in out if r.shard == shard)
        assert mine == list(range(len(mine)))
    assert slots.shard_documents(spark.createDataFrame([], DOCS), 3).count() == 0


LINES = [
    (1, "Same\nown one\n\n SAME \nsame"), (2, "same\t\nown two"), (3, "\x0bsame"), (None, "same"), (4, None), (5, ""), (6, "Éa\nÉA\néa"), (7, "x\n" * 70_000), (7, "x\n" * 70_000), (8, "X"),
]


@pytest.mark.parametrize("keep", ["none", "first"])
def test_line_rules(spark, keep):
    docs = spark.createDataFrame([(i, t, 1, "") for i, t in LINES], "doc_id long, text string, keep int, pos string").drop("keep")
    out = lines.with_bitmaps(docs, 2, 1, keep).withColumn("kept", lines.kept_text()).collect()
    assert len(out) == len(LINES)
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    distinct = {(i, t or "") for i, t in LINES}
    found = {}
    for d in distinct:
        for line in d[1].split("\n"):
            found.setdefault(key(line), set()).add(d)
    for r in out:
        d, kept, seen = (r.doc_id, r.text or ""), [], set()
        for line in d[1].split("\n"):
            k = key(line)
            first = keep == "first" and min(found[k], key=lambda x: (x[0] is not None, x[0] or 0)) == d and k not in seen
            if not k or len(found[k]) < 2 or first:
                kept.append(line)
            seen.add(k)
        assert r.kept == "\n".join(kept) and r.n_lines == len(d[1].split("\n")) and r.n_dropped == r.n_lines - (len(kept) if kept or not r.n_lines else 0), d[0]
    assert lines.with_bitmaps(docs.where("doc_id < 0")).count() == 0
