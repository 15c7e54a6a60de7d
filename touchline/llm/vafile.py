"""Exact k-means of integer vectors over a vector-approximation file.

Components become ``floor(SCALE * x)``. Each dimension is cut into ``2 ** BITS`` cells at the quantiles of a bounded
sample, the outer ones reaching to the extremes of all vectors, and a vector's cells are packed into one short binary value, its approximation. One table holds both, in buckets of the row
number: a scan of the approximations leaves the vectors on disk, and rows that must be fetched find their bucket in place.

A round turns every centroid into two lookup tables, the least and the most squared difference per dimension and cell, both
less that to the middle of the centroids, which no comparison needs. Their sums are an interval of distances for each
centroid. Where one centroid's interval lies below all others the row is decided by
its approximation. Sums of clusters are kept from round to round, so a round fetches only the vectors whose intervals
overlap, or whose decision differs from the round before; these are compared exactly, and what moved is added to the sums.
No assignment is stored between rounds: the one before is decided again from its centroids. Only ``k`` centroids and the
sums of what moved reach the driver.

Defined results: vectors of another dimension, or with null or non-finite components, are left out; equal rows are each
assigned; rows without an id take part but start no centroid, and without any id there are no centroids, so no rows; ids
that repeat start one centroid per row, ordered by their vectors; fewer vectors than centroids start as many as there are; an
empty table gives no rows. Components beyond ``LIMIT`` count as ``LIMIT``, so that distances fit 64 bits; a sum of distances
that does not is null. Extra columns do not take part.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import table
from touchline.session import compute_partitions, new_path, stored

DIMENSION = 64
SCALE = 1024
CENTROIDS = 8
ROUNDS = 10
SEED = 3
BITS = 8
LIMIT = 1 << 26
SAMPLE_ROWS = 16_384


def integer_vectors(rows: DataFrame, dimension: int = DIMENSION, scale: int = SCALE) -> DataFrame:
    """``vec_id`` and the vector ``v`` of integers of the rows that take part."""
    whole = (F.size("embedding") == dimension) & F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    limited = F.transform("embedding", lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(LIMIT))), F.lit(float(-LIMIT)))).cast("long"))
    return rows.where(F.col("embedding").isNotNull() & whole).select("vec_id", limited.alias("v"))


@dataclass(frozen=True)
class Cells:
    """Borders of each dimension's cells, ``(dimension, cells + 1)``; the outer ones are the extremes of all vectors."""

    borders: np.ndarray
    bits: int

    def encode(self, v: np.ndarray) -> np.ndarray:
        """Cell numbers of each vector's components."""
        inner = self.borders[:, 1:-1]
        return np.stack([np.searchsorted(inner[d], v[:, d], side="right") for d in range(v.shape[1])], axis=1).astype(np.uint8)

    def pack(self, cells: np.ndarray) -> np.ndarray:
        shown = (cells[:, :, None] >> np.arange(self.bits, dtype=np.uint8)) & 1
        return np.packbits(shown.reshape(len(cells), -1), axis=1)

    def unpack(self, packed: np.ndarray) -> np.ndarray:
        d = len(self.borders)
        shown = np.unpackbits(packed, axis=1, count=d * self.bits).reshape(len(packed), d, self.bits)
        return (shown << np.arange(self.bits, dtype=np.uint8)).sum(axis=2, dtype=np.uint8)

    def intervals(self, cells: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and most squared distance of every vector to every centroid, from lookup tables, both less the vector's
        squared distance to the middle of the centroids: that part is the same for all of them, unknown, and the widest."""
        dims = np.arange(cells.shape[1])
        least = np.empty((len(cells), len(centroids)), np.int64)
        most = np.empty_like(least)
        middle = centroids.sum(axis=0) // len(centroids)
        for k, c in enumerate(centroids):
            # linear in the component, so extreme at a cell's borders
            at = (middle - c)[:, None] * (2 * self.borders - (middle + c)[:, None])
            least[:, k] = np.minimum(at[:, :-1], at[:, 1:])[dims, cells].sum(axis=1)
            most[:, k] = np.maximum(at[:, :-1], at[:, 1:])[dims, cells].sum(axis=1)
        return least, most

    def decided(self, cells: np.ndarray, centroids: np.ndarray) -> np.ndarray:
        """The cluster where one interval lies below all others, else -1."""
        least, most = self.intervals(cells, centroids)
        possible = least <= most.min(axis=1, keepdims=True)
        return np.where(possible.sum(axis=1) == 1, possible.argmax(axis=1), -1)


def nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid, ties to the smaller number, and the squared distance, in whole numbers."""
    best, far = np.zeros(len(v), np.int64), None
    for k, c in enumerate(centroids):
        now = ((v - c) ** 2).sum(axis=1)
        best, far = (best, now) if far is None else (np.where(now < far, k, best), np.minimum(now, far))
    return best, far if far is not None else np.zeros(len(v), np.int64)


def _vectors(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), d)


def _packed(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def fit_cells(vectors: DataFrame, dimension: int, bits: int) -> Cells:
    """Quantile borders of at most ``SAMPLE_ROWS`` vectors, widened to the extremes of all, so that every bound holds."""
    ends = vectors.agg(*[f(F.get("v", F.lit(d))) for f in (F.min, F.max) for d in range(dimension)]).first()
    total = vectors.count()
    part = F.pmod(F.xxhash64("v"), F.lit(1 << 20)) < max(1, SAMPLE_ROWS * (1 << 20) // max(total, 1))
    sample = np.array([r.v for r in vectors.where(part).limit(SAMPLE_ROWS).select("v").collect()], np.int64).reshape(-1, dimension)
    low, high = np.array(ends[:dimension], np.int64), np.array(ends[dimension:], np.int64)
    shares = np.arange(1, 1 << bits) / (1 << bits)
    inner = np.floor(np.quantile(sample, shares, axis=0)).astype(np.int64) if len(sample) else np.repeat(low[None], len(shares), 0)
    return Cells(np.concatenate([low[:, None], np.clip(inner.T, low[:, None], high[:, None]), high[:, None]], axis=1), bits)


def approximation_file(vectors: DataFrame, cells: Cells) -> DataFrame:
    """``row``, ``vec_id``, ``v`` and the packed cells ``va`` as a table in buckets of ``row``."""
    schema = vectors.selectExpr("monotonically_increasing_id() AS row", "vec_id", "v", "binary('') AS va").schema
    d = len(cells.borders)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                packed = cells.pack(cells.encode(_vectors(batch.column(2), d)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.tobytes() for r in packed], pa.binary())], names=schema.names)

    spark = vectors.sparkSession
    numbered = vectors.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v").mapInArrow(run, schema)
    buckets, name = compute_partitions(spark), f"va_{uuid.uuid4().hex}"
    numbered.repartition(buckets, "row").write.bucketBy(buckets, "row").sortBy("row").option("path", new_path(spark)).format("parquet").saveAsTable(name)
    return spark.table(name)


def _moves(fetched: DataFrame, before: "np.ndarray | None", after: np.ndarray) -> DataFrame:
    """Per cluster and component the change of its sum (``at`` -1: of its count) when ``after`` replaces ``before``."""
    d = after.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _vectors(batch.column(0), d)
            new, _ = nearest(v, after)
            sums = np.zeros((len(after), d + 1), np.int64)
            rows = np.concatenate([np.ones((len(v), 1), np.int64), v], axis=1)
            if before is None:
                np.add.at(sums, new, rows)
            else:
                old, _ = nearest(v, before)
                moved = old != new
                np.add.at(sums, new[moved], rows[moved])
                np.subtract.at(sums, old[moved], rows[moved])
            k, at = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(at - 1), pa.array(sums[k, at])], names=["cluster", "at", "change"])

    partial = fetched.select("v").mapInArrow(run, "cluster long, at long, change long")
    return partial.groupBy("cluster", "at").agg(F.sum(F.col("change").cast("decimal(38,0)")).alias("change"))


def _undecided(rows: DataFrame, cells: Cells, before: np.ndarray, after: np.ndarray) -> DataFrame:
    """Rows whose approximation does not settle that they stay in their cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                c = cells.unpack(_packed(batch.column(1)))
                now = cells.decided(c, after)
                open_ = np.flatnonzero((now < 0) | (now != cells.decided(c, before)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(open_))], names=["row"])

    return rows.select("row", "va").mapInArrow(run, "row long")


def start_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors with the ``k`` smallest hashes of seed and id."""
    hashed = vectors.where("vec_id IS NOT NULL").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("hash"), "v")
    return np.array([r.v for r in hashed.orderBy("hash", "v").limit(k).collect()], np.int64)


def cluster(rows: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, dimension: int = DIMENSION, scale: int = SCALE, bits: int = BITS, fetches: "list[int] | None" = None) -> DataFrame:
    """One row per vector that takes part: ``vec_id``, ``cluster``, ``distance``, its cluster's and the total inertia, and the
    checksum of its centroid. ``fetches``, if given, receives the number of vectors fetched in each round after the first."""
    spark = rows.sparkSession
    vectors = stored(integer_vectors(rows, dimension, scale))
    centroids = start_centroids(vectors, k, seed)
    shape = "vec_id {}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string".format(rows.schema["vec_id"].dataType.simpleString())
    if not len(centroids):
        return spark.createDataFrame([], shape)
    cells = fit_cells(vectors, dimension, bits)
    file = approximation_file(vectors, cells)
    sums = [[0] * (dimension + 1) for _ in centroids]
    before = None
    for _ in range(rounds):
        if before is None:
            fetched = file
        else:
            open_ = stored(_undecided(file, cells, before, centroids))
            if fetches is not None:
                fetches.append(open_.count())
            fetched = file.select("row", "v").join(open_, "row", "left_semi")
        for r in _moves(fetched, before, centroids).collect():  # at most centroids times components
            sums[r.cluster][r["at"] + 1] += int(r.change)
        before = centroids
        centroids = np.array([[s // n[0] for s in n[1:]] if n[0] else list(c) for n, c in zip(sums, centroids)], np.int64)
        if (before == centroids).all():
            break

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = _vectors(batch.column(1), dimension)
                own = cells.decided(cells.unpack(_packed(batch.column(2))), centroids)
                far = ((v - centroids[own]) ** 2).sum(axis=1)
                open_ = np.flatnonzero(own < 0)
                own[open_], far[open_] = nearest(v[open_], centroids)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.astype(np.int32)), pa.array(far)], names=["vec_id", "cluster", "distance"])

    placed = stored(file.select("vec_id", "v", "va").mapInArrow(assign, ", ".join(shape.split(", ")[:3])))
    names = [(i, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)]
    inertia = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("part"))
    total = inertia.agg(F.sum("part").alias("all"))
    shown = stored(inertia.crossJoin(total).join(spark.createDataFrame(names, "cluster int, centroid_sha256 string"), "cluster"))  # one row per centroid
    parts = shown.selectExpr("cluster", "try_cast(part AS long) AS cluster_inertia", "try_cast(`all` AS long) AS inertia", "centroid_sha256")
    return placed.join(parts, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_vafile_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of 64 components in 8 clusters after 10 rounds."""
    return cluster(table(spark, sf_dir, "embeddings"))


# the rounds as a recursion over one row that holds all centroids
OP12_SQL = """
WITH RECURSIVE kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
first AS (SELECT sha256('3:' || vec_id) AS h, v FROM kept WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT 8),
start AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM first),
parts AS MATERIALIZED (SELECT row, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM kept),
rounds AS (
  SELECT 0 AS r, c, d, x FROM start
  UNION ALL
  (WITH now AS (SELECT * FROM rounds),
  far AS (SELECT p.row, n.c, sum((p.x - n.x) * (p.x - n.x)) AS far FROM parts p JOIN now n ON p.d = n.d GROUP BY p.row, n.c),
  own AS (SELECT row, arg_min(c, (far, c)) AS c FROM far GROUP BY row),
  mean AS (SELECT o.c, p.d, sum(p.x) AS s, count(*) AS n FROM own o JOIN parts p ON o.row = p.row GROUP BY o.c, p.d)
  SELECT now.r + 1 AS r, now.c, now.d, CASE WHEN n IS NULL THEN now.x ELSE CAST((s - ((s % n) + n) % n) // n AS BIGINT) END AS x
  FROM now LEFT JOIN mean ON now.c = mean.c AND now.d = mean.d WHERE now.r < 10)),
last AS (SELECT c, d, x FROM rounds WHERE r = 10),
far AS (SELECT p.row, n.c, sum((p.x - n.x) * (p.x - n.x)) AS far FROM parts p JOIN last n ON p.d = n.d GROUP BY p.row, n.c),
own AS (SELECT row, arg_min(c, (far, c)) AS c, min(far) AS far FROM far GROUP BY row),
name AS (SELECT c, sha256(string_agg(x, ',' ORDER BY d)) AS h FROM last GROUP BY c)
SELECT vec_id, CAST(own.c AS INTEGER) AS cluster, CAST(far AS BIGINT) AS distance, CAST(sum(far) OVER (PARTITION BY own.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(far) OVER () AS BIGINT) AS inertia, name.h AS centroid_sha256
FROM own JOIN kept ON own.row = kept.row JOIN name ON own.c = name.c"""
