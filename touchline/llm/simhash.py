"""SimHash near-duplicates by a self-join of the binary trie of fingerprints.

Fingerprints are made where the texts are read; from there on only ids and 64-bit numbers move. Equal fingerprints are
one class with one place in the trie. The trie is cut at nodes of bounded size: prefixes that hold too many classes are
extended until they don't. Two nodes meet if their prefixes differ in no more bits than the budget; a task gets the
classes of one such pair of nodes and descends both subtries together, bit by bit, adding up differing bits and leaving
a pair of subtries as soon as the budget is exceeded. It returns spanning links of what it found, so a dense group gives
as many links as it has members, and lost no connection. Components are found on these links.

Defined results: null and empty texts have no words and fingerprint zero, texts of one or two words are one shingle, equal
rows share their class, an empty table gives no rows. Extra columns do not take part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import table
from touchline.llm.components import components, spanning_links
from touchline.session import stored

SHINGLE_WORDS = 3
BITS_APART = 2
NODE_CLASSES = 32_768
STEP_BITS = 4
FRONTIER = 100_000


def shingle_fingerprint(text: str, words: int = SHINGLE_WORDS) -> int:
    """Majority bits of the hashes of all shingles of ASCII-lower-cased words; 0 for a text without words."""
    from xxhash import xxh64_intdigest

    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) < words:
        return xxh64_intdigest(joined, 42)
    ends = list(accumulate(len(p) + 1 for p in parts))
    begins = [0, *ends]
    counts = np.zeros(64, dtype=np.int64)
    total = len(parts) - words + 1
    for at in range(0, total, 65_536):
        upto = min(total, at + 65_536)
        hashes = [xxh64_intdigest(joined[a : b - 1], 42) for a, b in zip(begins[at:upto], ends[at + words - 1 : upto + words - 1])]
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, key: str = "doc_id") -> DataFrame:
    """Key and signed 64-bit ``fp`` of every document."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([shingle_fingerprint(t.as_py() or "", words) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64), pa.int64())], names=[key, "fp"])

    return docs.select(key, "text").mapInArrow(run, f"{key} {kind}, fp long")


def _prefix(fp: "Column | str", depth: int) -> Column:
    """The first ``depth`` bits as a number."""
    return F.shiftrightunsigned(fp, 64 - depth) if depth else F.lit(0).cast("long")


def cut_trie(classes: DataFrame, node_classes: int = NODE_CLASSES, step: int = STEP_BITS) -> DataFrame:
    """Add ``depth`` and ``prefix``: the trie node of every class, none with more than ``node_classes`` classes."""
    depth, done, rest = 0, [], classes
    total = rest.count()
    while total > node_classes << depth:
        depth += step
    while True:
        at = rest.withColumns({"depth": F.lit(depth), "prefix": _prefix("fp", depth)})
        sizes = stored(at.groupBy("prefix").count())
        if depth >= 64 or not sizes.where(F.col("count") > node_classes).head(1):
            done.append(at)
            break
        large = sizes.where(F.col("count") > node_classes).select("prefix")
        done.append(at.join(large, "prefix", "left_anti").select(*at.columns))
        rest = stored(at.join(large, "prefix", "left_semi").select(*classes.columns))
        depth += step
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return stored(out)


def _within(depth: int, budget: int) -> list[int]:
    """All masks of ``depth`` bits with at most ``budget`` ones, as signed 64-bit numbers."""
    masks = {0}
    for _ in range(budget):
        masks |= {m ^ (1 << b) for m in masks for b in range(depth)}
    return sorted(m - (1 << 64) if m >> 63 else m for m in masks)


def node_pairs(nodes: DataFrame, budget: int = BITS_APART) -> DataFrame:
    """Pairs of trie nodes whose prefixes differ in at most ``budget`` of the bits they both have; each pair once."""
    found = stored(nodes.select("depth", "prefix").distinct())
    depths = sorted(r.depth for r in found.select("depth").distinct().collect())  # at most one per level of the trie
    out = found.selectExpr("depth AS du", "prefix AS pu", "depth AS dv", "prefix AS pv").where("false")
    for a in depths:
        for b in (d for d in depths if d >= a):
            shallow = found.where(F.col("depth") == a).select(F.col("depth").alias("du"), F.col("prefix").alias("pu"))
            near = F.explode(F.array(*[F.lit(m).cast("long") for m in _within(a, budget)]))
            deep = found.where(F.col("depth") == b).select(F.col("depth").alias("dv"), F.col("prefix").alias("pv"), near.alias("mask"))
            cut = F.shiftrightunsigned("pv", b - a) if b > a else F.col("pv")
            cut = F.lit(0).cast("long") if a == 0 else cut
            pairs = deep.withColumn("pu", cut.bitwiseXOR(F.col("mask"))).drop("mask").join(shallow, "pu").select("du", "pu", "dv", "pv")
            pairs = pairs.where("pu <= pv") if a == b else pairs
            out = out.unionByName(pairs)
    return out


def close_pairs(u: np.ndarray, v: np.ndarray, budget: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of the sorted unsigned arrays ``u`` and ``v`` at most ``budget`` bits apart; with ``same``, i < j.

    Subtries are ranges of the sorted arrays. A stack of bounded fronts of subtrie pairs goes down one bit at a time.
    """
    whole = np.array([[0, len(u), 0, len(v), 0]], dtype=np.int64).T
    stack = [(63, whole)]
    while stack:
        bit, front = stack.pop()
        if front.shape[1] > FRONTIER:
            half = front.shape[1] // 2
            stack += [(bit, front[:, :half]), (bit, front[:, half:])]
            continue
        a, b, c, d, apart = front
        small = ((b - a) * (d - c) <= 32) | (bit < 0)
        if small.any():
            a1, c1, n1, n2 = a[small], c[small], (b - a)[small], (d - c)[small]
            n = n1 * n2
            which = np.repeat(np.arange(len(n)), n)
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            i, j = a1[which] + place // n2[which], c1[which] + place % n2[which]
            near = (np.bitwise_count(u[i] ^ v[j]) <= budget) & ((i < j) if same else True)
            yield i[near], j[near]
            a, b, c, d, apart = front[:, ~small]
        if not len(a):
            continue
        one = np.uint64(1 << bit)
        high = ~np.uint64((1 << (bit + 1)) - 1)
        m, k = np.searchsorted(u, (u[a] & high) | one), np.searchsorted(v, (v[c] & high) | one)
        children = [
            np.stack([a, m, c, k, apart]),
            np.stack([m, b, k, d, apart]),
            np.stack([a, m, k, d, apart + 1]),
            np.stack([m, b, c, k, apart + 1])[:, (a != c) if same else slice(None)],
        ]
        front = np.concatenate(children, axis=1)
        stack.append((bit - 1, front[:, (front[0] < front[1]) & (front[2] < front[3]) & (front[4] <= budget)]))


def class_links(nodes: DataFrame, budget: int = BITS_APART) -> DataFrame:
    """Links ``a``, ``b`` between fingerprints at most ``budget`` bits apart that span all their components."""
    pairs = stored(node_pairs(nodes, budget))
    left = pairs.join(nodes, (F.col("du") == F.col("depth")) & (F.col("pu") == F.col("prefix"))).select("du", "pu", "dv", "pv", F.lit(0).alias("side"), "fp")
    other = pairs.where("du <> dv OR pu <> pv").join(nodes, (F.col("dv") == F.col("depth")) & (F.col("pv") == F.col("prefix")))
    met = left.unionByName(other.select("du", "pu", "dv", "pv", F.lit(1).alias("side"), "fp"))

    def run(rows: pa.Table) -> pa.Table:
        side, fp = rows.column("side").to_numpy(), rows.column("fp").to_numpy().view(np.uint64)
        same = not side.any()
        u = np.sort(fp[side == 0])
        v = u if same else np.sort(fp[side == 1])
        shift = 0 if same else len(u)
        both = u if same else np.concatenate([u, v])
        a = b = np.zeros(0, np.int64)
        for i, j in close_pairs(u, v, budget, same):
            if len(i):
                a, b = spanning_links(np.concatenate([a, i]), np.concatenate([b, j + shift]), len(both))
        return pa.table({"a": both[a].view(np.int64), "b": both[b].view(np.int64)})

    return met.groupBy("du", "pu", "dv", "pv").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, budget: int = BITS_APART, words: int = SHINGLE_WORDS, key: str = "doc_id") -> DataFrame:
    """Key, ``fp`` and ``component_id``: the smallest key reachable over fingerprints at most ``budget`` bits apart."""
    prints = stored(fingerprints(docs, words, key))
    classes = stored(prints.groupBy("fp").agg(F.min(key).alias("smallest")))
    links = stored(class_links(cut_trie(classes.select("fp")), budget))
    grouped = components(links).withColumnRenamed("node", "fp")
    roots = stored(classes.join(grouped, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    smallest = roots.groupBy("root").agg(F.min("smallest").alias("component_id"))
    of_class = stored(roots.join(smallest, "root").select("fp", "component_id"))
    return prints.join(of_class, "fp").select(key, "fp", "component_id")


def op5_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with fingerprint and component over links of at most 2 differing bits."""
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
