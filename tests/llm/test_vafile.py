"""Clusters over the approximation file: equal to plain k-means in whole numbers, bounds that hold, odd rows."""

import hashlib
import math
import os
import random

import duckdb
import numpy as np

from touchline.llm import vafile

SF = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
SCHEMA = "vec_id long, embedding array<float>, cluster int, row string"


def plain_clusters(rows, k, rounds, seed, dimension, scale=1024):
    """(id, cluster, distance, cluster inertia, inertia, checksum) per kept row, in plain whole numbers."""
    kept = []
    for i, e in rows:
        if e is not None and len(e) == dimension and all(x is not None and math.isfinite(x) for x in e):
            kept.append((i, [math.floor(scale * float(np.float32(x))) for x in e]))
    named = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centres = [v for _, v in named[:k]]

    def assigned():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres)) for _, v in kept]

    for _ in range(rounds if centres else 0):
        own = assigned()
        for n in range(len(centres)):
            members = [v for (_, v), (_, c) in zip(kept, own) if c == n]
            if members:
                centres[n] = [sum(x) // len(members) for x in zip(*members)]
    own = assigned() if centres else []
    part = {n: sum(d for d, c in own if c == n) for n in range(len(centres))}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted([(i, c, d, part[c], sum(part.values()), names[c]) for (i, _), (d, c) in zip(kept, own)], key=str)


def rows_of(df):
    return sorted(map(tuple, df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)


def test_table_against_plain_and_sql(spark):
    got = rows_of(vafile.op12_vafile_clusters(spark, SF))
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert got == plain_clusters(rows, 8, 10, 3, 64)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    assert got == sorted(con.execute(vafile.OP12_SQL).fetchall(), key=str)


def test_odd_rows(spark):
    rnd = random.Random(4)
    some = [[rnd.gauss(0, 1) for _ in range(4)] for _ in range(40)]
    rows = [(i, v) for i, v in enumerate(some)] + [(100 + i, some[0]) for i in range(30)]  # a hot vector
    rows += [(7, some[9]), (None, some[3]), (None, [0.0] * 4), (200, [0.5, -0.5, 0.5, -0.5]), (201, [-0.0, 1e-9, -1e-9, 3.0])]
    rows += [(300, None), (301, []), (302, [1.0] * 5), (303, [1.0, None, 1.0, 1.0]), (304, [float("nan")] * 4), (305, [float("inf"), 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 9, "x") for i, v in rows], SCHEMA).repartition(3)
    for bits in (2, 5, 8):
        assert rows_of(vafile.cluster(df, 6, 7, 3, 4, bits=bits)) == plain_clusters(rows, 6, 7, 3, 4)
    few = df.where("vec_id IN (1, 2, 3)")
    assert rows_of(vafile.cluster(few, 8, 3, 3, 4)) == plain_clusters([r for r in rows if r[0] in (1, 2, 3)], 8, 3, 3, 4)
    assert vafile.cluster(df.where("vec_id < 0"), 8, 3, 3, 4).collect() == []
    assert vafile.cluster(df.where("vec_id IS NULL"), 8, 3, 3, 4).collect() == []
    assert vafile.cluster(df.where("vec_id > 300"), 8, 3, 3, 4).collect() == []


def test_equal_distances_go_to_the_smaller_number(spark):
    rows = [(i, [float(x), 0.0]) for i, x in enumerate([-2, -2, 2, 2, 0, 0, 0])]
    df = spark.createDataFrame([(i, v, None, None) for i, v in rows], SCHEMA)
    assert rows_of(vafile.cluster(df, 4, 5, 1, 2)) == plain_clusters(rows, 4, 5, 1, 2)


def test_huge_components_are_limited(spark):
    df = spark.createDataFrame([(1, [3e38, 0.0], None, None), (2, [-3e38, 0.0], None, None), (3, [0.0, 1.0], None, None)], SCHEMA)
    got = {r.vec_id: r.distance for r in vafile.cluster(df, 1, 1, 3, 2).collect()}
    assert got[1] >= (vafile.LIMIT - 1) ** 2 and got[3] < 1024**2


def test_intervals_hold_and_spare_fetches(spark):
    rng = np.random.default_rng(2)
    v = rng.integers(-900, 900, (500, 16))
    c = rng.integers(-400, 400, (5, 16))
    borders = np.sort(np.concatenate([v.min(0)[None], np.quantile(v[:80], np.arange(1, 16) / 16, axis=0).astype(np.int64), v.max(0)[None]]), axis=0).T
    cells = vafile.Cells(borders, 4)
    packed = cells.pack(cells.encode(v))
    assert packed.shape[1] == 16 * 4 // 8 and (cells.unpack(packed) == cells.encode(v)).all()
    least, most = cells.intervals(cells.encode(v), c)
    middle = c.sum(axis=0) // len(c)
    real = ((v[:, None] - c[None]) ** 2).sum(axis=2) - ((v - middle) ** 2).sum(axis=1)[:, None]
    assert (least <= real).all() and (real <= most).all()
    sure = cells.decided(cells.encode(v), c)
    assert (sure[sure >= 0] == real.argmin(axis=1)[sure >= 0]).all()
    # vectors near one of eight far points are settled by their cells alone
    points = rng.normal(0, 1, (8, 16))
    near = [(i, (points[i % 8] + rng.normal(0, 0.05, 16)).tolist(), None, None) for i in range(400)]
    fetched = []
    vafile.cluster(spark.createDataFrame(near, SCHEMA), 8, 10, 3, 16, bits=6, fetches=fetched).collect()
    assert fetched and max(fetched) < 400 and fetched[-1] < 100
