"""Approximate nearest neighbours by a forest of random-projection trees.

The split planes are fitted on a bounded sample: trees are as deep as the number of rows asks for, ``LEAF_ROWS`` a leaf, and
as the sample can fit, ``LEAF_SAMPLE`` a leaf. Every vector is routed to one leaf per tree. A query walks all trees through
one priority queue, ordered by how far it lies from the planes it would have to cross, and takes leaves until they hold a
number of rows. That number is measured, not set: ``PROBE_QUERIES`` queries are compared with all rows, and the walk is
taken so far that it meets a share of ``RECALL`` of their true neighbours. Clustered vectors need a small part of the rows,
vectors without any structure most of them. Leaves meet the queries that probe them: both sides are cut into bounded chunks,
vectors move only to the chunks that are asked for, a task scores one chunk exactly on the original vectors and returns its
best rows per query, and these are merged.

Defined results: null, zero and non-finite vectors and null ids take no part; vectors of several dimensions are compared
within each; ties go to the smaller id; equal rows are one candidate; rows with one id and different vectors are one
candidate at their smallest distance, and as queries one query with the nearest rows of both; an empty table gives no rows.
Extra columns do not take part.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.llm.common import table
from touchline.llm.vectors import dimensions, matrix, usable_vectors
from touchline.session import stored

SAMPLE_ROWS = 65_536
TREES = 8
LEAF_ROWS = 256
LEAF_SAMPLE = 16
PROBE_QUERIES = 64
RECALL = 0.95
CHUNK_ROWS = 4_096
CHUNK_QUERIES = 2_048


class Forest:
    """Planes of complete binary trees: node k has children 2k + 1 and 2k + 2; ``planes`` is (trees, nodes, dimension)."""

    def __init__(self, planes: np.ndarray, offsets: np.ndarray, depth: int):
        self.planes, self.offsets, self.depth = planes, offsets, depth


def fit_forest(sample: np.ndarray, total: int, trees: int = TREES, seed: int = 11) -> Forest:
    """Random directions, split at the sample's median in the node."""
    rng = np.random.default_rng(seed)
    depth = max(0, int(np.log2(max(min(len(sample) / LEAF_SAMPLE, total / LEAF_ROWS), 1))))
    nodes, dim = (1 << depth) - 1, sample.shape[1] if sample.size else 1
    planes = rng.normal(size=(trees, nodes, dim))
    planes /= np.linalg.norm(planes, axis=2, keepdims=True) if nodes else 1.0
    offsets = np.zeros((trees, nodes))
    for t in range(trees):
        at = np.zeros(len(sample), dtype=np.int64)
        for level in range(depth):
            side = np.zeros(len(sample), dtype=np.int64)
            for k in range((1 << level) - 1, (2 << level) - 1):
                inside = np.flatnonzero(at == k)
                if len(inside):
                    along = sample[inside] @ planes[t, k]
                    offsets[t, k] = np.median(along)
                    side[inside] = along > offsets[t, k]
            at = 2 * at + 1 + side
    return Forest(planes, offsets, depth)


def leaves_of(forest: Forest, m: np.ndarray) -> np.ndarray:
    """Leaf number per row and tree."""
    out = np.zeros((len(m), len(forest.planes)), dtype=np.int32)
    for t, (planes, offsets) in enumerate(zip(forest.planes, forest.offsets)):
        at = np.zeros(len(m), dtype=np.int64)
        if len(m) and forest.depth:
            along = m @ planes.T > offsets
            for _ in range(forest.depth):
                at = 2 * at + 1 + along[np.arange(len(m)), at]
        out[:, t] = at - (len(offsets) if forest.depth else 0)
    return out


def walk(forest: Forest, query: np.ndarray, sizes: dict[tuple[int, int], int]) -> Iterator[tuple[tuple[int, int], int]]:
    """((tree, leaf), rows taken with it) in the order of the shared queue."""
    inner = len(forest.offsets[0]) if forest.depth else 0
    margins = forest.planes @ query - forest.offsets
    queue = [(0.0, t, 0) for t in range(len(forest.planes))]
    rows = 0
    while queue:
        bound, t, k = heapq.heappop(queue)
        while k < inner:
            margin = margins[t, k]
            near, far = (2 * k + 2, 2 * k + 1) if margin > 0 else (2 * k + 1, 2 * k + 2)
            heapq.heappush(queue, (max(bound, abs(margin)), t, far))
            k = near
        size = sizes.get((t, k - inner), 0)
        if size:
            rows += size
            yield (t, k - inner), rows


def probes(forest: Forest, query: np.ndarray, sizes: dict[tuple[int, int], int], wanted: int) -> list[tuple[int, int]]:
    """Leaves until they hold ``wanted`` rows."""
    out = []
    for leaf, rows in walk(forest, query, sizes):
        out.append(leaf)
        if rows >= wanted:
            break
    return out


def best_rows(ids: np.ndarray, members: np.ndarray, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` nearest rows but the query's own, ties to the smaller id."""
    apart = members - query
    far = np.sqrt((apart * apart).sum(axis=1))
    other = np.flatnonzero(ids != query_id)
    if len(other) > k:
        edge = np.partition(far[other], k - 1)[k - 1]
        other = other[far[other] <= edge]
    order = other[np.lexsort((ids[other], far[other]))][:k]
    return ids[order], far[order]


def build_index(vectors: DataFrame) -> tuple[Forest, DataFrame, dict[tuple[int, int], int], int]:
    """Forest, indexed rows (``leaves`` per row), leaf sizes (one number per leaf) and the number of rows."""
    total = vectors.count()
    share = min(1.0, SAMPLE_ROWS / max(total, 1))
    chosen = vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int(share * (1 << 20))) if share < 1 else vectors
    sample = chosen.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("embedding").toArrow()
    forest = fit_forest(matrix(sample.column(0)), total)
    schema = vectors.select("vec_id", "embedding", F.array(F.lit(0)).alias("leaves")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = leaves_of(forest, matrix(batch.column(1)))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, found.shape[1], dtype=np.int32)), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, flat], names=["vec_id", "embedding", "leaves"])

    index = stored(vectors.mapInArrow(run, schema))
    sizes = index.select(F.posexplode("leaves").alias("tree", "leaf")).groupBy("tree", "leaf").count().collect()
    return forest, index, {(r.tree, r.leaf): r["count"] for r in sizes}, total


def rows_to_take(index: tuple[Forest, DataFrame, dict[tuple[int, int], int], int], queries: DataFrame, k: int, recall: float = RECALL) -> int:
    """Rows that a query's leaves must hold for a share ``recall`` of true neighbours, measured on a bounded set of queries
    against all rows."""
    forest, rows, sizes, _ = index
    chosen = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PROBE_QUERIES).select("vec_id", "embedding").toArrow()
    ids, points = chosen.column(0).to_numpy(), matrix(chosen.column(1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, members = batch.column(0).to_numpy(), matrix(batch.column(1))
            leaves = batch.column(2).to_pylist()
            out = []
            for q, (query_id, query) in enumerate(zip(ids, points)):
                apart = members - query
                far = np.where(own == query_id, np.inf, np.sqrt((apart * apart).sum(axis=1)))
                out += [(q, int(own[i]), float(far[i]), leaves[i]) for i in np.argsort(far, kind="stable")[:k] if far[i] < np.inf]
            kinds = (pa.int32(), pa.int64(), pa.float64(), pa.list_(pa.int32()))
            columns = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["q", "vec_id", "far", "leaves"])

    near = rows.select("vec_id", "embedding", "leaves").mapInArrow(run, "q int, vec_id long, far double, leaves array<int>")
    rank = F.row_number().over(Window.partitionBy("q").orderBy("far", "vec_id"))
    of: dict[int, list[list[int]]] = {}
    for r in near.withColumn("rank", rank).where(F.col("rank") <= k).collect():  # k rows a query
        of.setdefault(r.q, []).append(r.leaves)
    needed = []
    for q, found in of.items():
        taken = dict(walk(forest, points[q], sizes))
        needed += [min(taken[t, leaf] for t, leaf in enumerate(leaves)) for leaves in found]
    needed.sort()
    return needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)] if needed else 1


def nearest(index: tuple[Forest, DataFrame, dict[tuple[int, int], int], int], queries: DataFrame, k: int = 10, wanted: "int | None" = None) -> DataFrame:
    """The ``k`` nearest rows found of every query (``vec_id``, ``embedding``): query_id, rank, vec_id, score.

    ``wanted`` is the number of rows that a query's leaves hold; measured where it isn't given."""
    forest, rows, sizes, total = index
    wanted = rows_to_take(index, queries, k) if wanted is None else wanted
    width = 1 << forest.depth
    schema = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), F.array(F.struct(F.lit(0).alias("tree"), F.lit(0).alias("leaf"))).alias("probes")).schema
    item = pa.struct([("tree", pa.int32()), ("leaf", pa.int32())])

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"tree": t, "leaf": n} for t, n in probes(forest, q, sizes, wanted)] for q in matrix(batch.column(1))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(item))], names=schema.names)

    blocks = F.lit(max(1, -(-queries.count() // CHUNK_QUERIES)))
    chunked = F.create_map(*[x for (t, n), size in sizes.items() for x in (F.lit(t * width + n), F.lit(-(-size // CHUNK_ROWS)))]) if sizes else F.create_map(F.lit(0), F.lit(1))
    chunks = F.element_at(chunked, F.col("tree") * width + F.col("leaf"))
    counted = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1))
    planned = queries.select("vec_id", "embedding").mapInArrow(plan, schema).withColumn("block", F.pmod(F.xxhash64("query_id"), blocks))
    asked = planned.select("query_id", "query", "block", F.explode("probes").alias("p")).select("query_id", "query", "block", "p.tree", "p.leaf")
    asked = stored(asked.select("*", counted(chunks).alias("chunk")))
    keys = ["tree", "leaf", "chunk", "block"]
    members = rows.select("vec_id", "embedding", F.posexplode("leaves").alias("tree", "leaf"))
    members = members.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), chunks.cast("long"))).join(asked.select(*[F.col(c).alias(c) for c in keys]).distinct(), keys[:3])

    def score(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if mine.num_rows and theirs.num_rows:
            ids, points = mine.column("vec_id").to_numpy(), matrix(mine.column("embedding"))
            for query_id, query in zip(theirs.column("query_id").to_numpy(), matrix(theirs.column("query"))):
                near, far = best_rows(ids, points, query_id, query, k)
                for column, values in zip(out, (np.full(len(near), query_id), near, far)):
                    column.append(values)
        kinds = (np.int64, np.int64, np.float64)
        return pa.table({n: np.concatenate([np.zeros(0, t), *c]).astype(t) for n, c, t in zip(("query_id", "vec_id", "score"), out, kinds)})

    found = members.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(score, "query_id long, vec_id long, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_vectors(vectors: DataFrame, queries: Column, k: int = 10) -> DataFrame:
    """The ``k`` nearest rows of the vectors that ``queries`` selects, within each dimension."""
    good, out = stored(usable_vectors(vectors)), None
    for n in dimensions(good) or [0]:
        own = good.where(F.size("embedding") == n)
        found = nearest(build_index(own), own.where(queries), k)
        out = found if out is None else out.unionByName(found)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest rows found of every vector whose id is divisible by 100."""
    return nearest_vectors(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
