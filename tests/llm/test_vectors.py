"""Cover-tree join and projection forest against brute force."""

import os

import numpy as np
import pytest

from touchline.llm import covertree, forest

SF = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
SCHEMA = "vec_id long, embedding array<float>, label int, n long"


def brute(vectors, cosine=0.9):
    """n_links and component per id of the valid vectors."""
    ids = sorted(vectors)
    m = np.array([vectors[i] for i in ids], np.float64)
    m = m / np.sqrt((m * m).sum(axis=1, keepdims=True))
    linked = m @ m.T >= cosine
    np.fill_diagonal(linked, False)
    root = np.arange(len(ids))
    while True:
        new = np.minimum(root, np.where(linked, root[None, :], len(ids)).min(axis=1, initial=len(ids)))
        if (new == root).all():
            break
        root = new
    return {i: (int(linked[k].sum()), ids[root[k]]) for k, i in enumerate(ids)}


def clustered(seed, n, dim=16):
    """Groups of copies of all tightnesses, wide clusters and single vectors."""
    rng = np.random.default_rng(seed)
    out = []
    while len(out) < n:
        base = rng.normal(size=dim)
        for _ in range(rng.choice([1, 1, 3, 40])):
            out.append(base + rng.choice([0, 1e-6, 0.01, 0.1, 0.3]) * rng.normal(size=dim))
    return np.array(out[:n], np.float32)


def rows_of(m):
    return [(int(i), [float(x) for x in v], None, 5) for i, v in enumerate(m)]


def test_join_of_the_table(spark):
    table = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    out = covertree.op3_cover_tree(spark, SF).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in out} == brute(table)
    assert all(r.kept == (r.vec_id == r.component_id) for r in out)


@pytest.mark.parametrize("block,centres", [(10_000, 256), (100, 4), (60, 256)])
def test_join_of_clusters(spark, monkeypatch, block, centres):
    monkeypatch.setattr(covertree, "BLOCK_ROWS", block)
    monkeypatch.setattr(covertree, "CENTRES", centres)
    monkeypatch.setattr(covertree, "PAIRS_AT_ONCE", 500)
    m = clustered(block, 900)
    out = covertree.near_vectors(spark.createDataFrame(rows_of(m), SCHEMA)).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in out} == brute(dict(enumerate(m)))


def test_levels_are_nested_covering_and_apart():
    m = covertree.unit(clustered(4, 700).astype(np.float64))
    path = covertree.nested_levels(m)
    for level, radius in enumerate(covertree.RADII):
        far = np.linalg.norm(m - m[path[:, level]], axis=1)
        assert far.max() <= radius + 1e-7
        centres = np.unique(path[:, level])
        assert (path[centres, level] == centres).all()
        if level:
            assert set(np.unique(path[:, level - 1])) <= set(centres)
            assert all(len(set(path[path[:, level] == c, level - 1])) == 1 for c in centres)
            for c in np.unique(path[:, level - 1]):
                own = np.unique(path[path[:, level - 1] == c, level])
                d = np.linalg.norm(m[own][:, None] - m[own][None], axis=2)
                assert (d[~np.eye(len(own), dtype=bool)] > radius - 1e-7).all()


ODD = [
    (1, None), (2, []), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [None, 1.0]), (7, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]),
    (8, [1.0, 0.0]), (9, [1.0, 0.0]), (9, [1.0, 0.0]), (10, [1e-30, 0.0]), (11, [3e38, 1e38]), (12, [-1.0, 0.0]), (13, [0.0, 2.0]), (100, [1.0, 0.1]), (0, [0.5, 0.5]),
]


def odd(spark):
    return spark.createDataFrame([(i, v, 0, None) for i, v in ODD], SCHEMA)


def test_odd_rows_of_the_join(spark):
    out = covertree.near_vectors(odd(spark)).collect()
    assert len(out) == len(ODD)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out}
    assert all(got[i] == (0, i, True) for i in (1, 2, 3, 4, 5, 6, 7, 12, 13, 0)) and got[None] == (0, None, False)
    mixed = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [1.0, 0.0, 0.0]), (4, [1.0, 0.0, 0.1]), (5, [0.0, 1.0, 0.0]), (6, [1.0]), (6, None), (6, [2.0]), (4, None), (7, [-1.0])]
    out = covertree.near_vectors(spark.createDataFrame([(i, v, 0, None) for i, v in mixed], SCHEMA)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in out) == [(1, 1, 1), (2, 1, 1), (3, 1, 3), (4, 0, 4), (4, 1, 3), (5, 0, 5), (6, 0, 6), (6, 1, 6), (6, 1, 6), (7, 0, 7)]
    # the row of id 9 is there twice, and each links with the other
    assert got[8] == got[9][:1] + (8, True) and got[8][0] == 5 and got[100] == (5, 8, False) and got[11] == (5, 8, False)
    assert covertree.near_vectors(odd(spark).where("vec_id < 0")).count() == 0


def plain_nearest(vectors, query, k=10):
    far = sorted((float(np.sqrt(((np.float64(v) - np.float64(vectors[query])) ** 2).sum())), i) for i, v in vectors.items() if i != query)
    return far[:k]


def test_forest_recall_on_the_table(spark):
    table = {r.vec_id: np.array(r.embedding, np.float64) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    out = forest.op8_projection_forest(spark, SF).collect()
    found = {}
    for r in out:
        found.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
        assert r.score == pytest.approx(float(np.sqrt(((table[r.vec_id] - table[r.query_id]) ** 2).sum())), abs=1e-12)
    assert set(found) == {i for i in table if i % 100 == 0}
    right = total = 0
    for q, rows in found.items():
        assert [r for r, *_ in sorted(rows)] == list(range(1, 11)) and [x[1:] for x in sorted(rows)] == sorted(x[1:] for x in rows)
        right += len({i for *_, i in rows} & {i for _, i in plain_nearest(table, q)})
        total += 10
    assert right / total >= 0.9


@pytest.mark.parametrize("chunk", [50, 4096])
def test_forest_recall_with_chunks_and_a_hot_vector(spark, monkeypatch, chunk):
    monkeypatch.setattr(forest, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(forest, "CHUNK_QUERIES", 7)
    m = np.random.default_rng(3).normal(size=(3000, 24)).astype(np.float32)
    m[::3] = m[0]
    vectors = spark.createDataFrame(rows_of(m), SCHEMA).select("vec_id", "embedding")
    out = forest.nearest(forest.build_index(vectors), vectors.where("vec_id % 100 = 0")).collect()
    table = dict(enumerate(m.astype(np.float64)))
    right = 0
    for q in range(0, 3000, 100):
        mine = sorted((r.rank, r.score, r.vec_id) for r in out if r.query_id == q)
        assert len(mine) == 10
        right += len({round(s, 9) for _, s, _ in mine} & {round(s, 9) for s, _ in plain_nearest(table, q)}) / len({round(s, 9) for s, _ in plain_nearest(table, q)})
        if q % 300 == 0:
            assert [i for *_, i in mine] == [i for i in range(0, 60, 3) if i != q][:10] and mine[-1][1] == 0.0
    assert right >= 0.9 * 30


def test_odd_rows_of_the_forest(spark):
    out = forest.nearest_vectors(odd(spark), forest.F.col("vec_id") % 100 == 0).collect()
    mine = {q: [r.vec_id for r in sorted(out, key=lambda r: r.rank) if r.query_id == q] for q in (0, 100)}
    assert mine[100] == [8, 9, 0, 10, 12, 13, 11] and len(mine[0]) == 7
    assert forest.nearest_vectors(odd(spark).where("vec_id < -5"), forest.F.col("vec_id") % 100 == 0).count() == 0
    mixed = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 1.0]), (100, [1.0, 0.0, 0.0]), (3, [0.9, 0.0, 0.0]), (200, [4.0])]
    out = forest.nearest_vectors(spark.createDataFrame([(i, v, 0, None) for i, v in mixed], SCHEMA), forest.F.col("vec_id") % 100 == 0).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in out) == [(0, 1, 1), (0, 2, 2), (100, 1, 3)]


def test_clustered_vectors_need_few_rows(spark):
    """20,480 vectors in 256 clusters: recall of at least 0.9 from less than a fifth of the rows."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(256, 32))
    m = (centres[rng.integers(0, 256, 20_480)] + 0.25 * rng.normal(size=(20_480, 32))).astype(np.float32)
    import pandas as pd

    vectors = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(m)), "embedding": list(m.tolist())}), "vec_id long, embedding array<float>").repartition(8)
    index = forest.build_index(vectors)
    queries = vectors.where("vec_id % 100 = 0")
    wanted = forest.rows_to_take(index, queries, 10)
    out = forest.nearest(index, queries, 10, wanted).collect()
    wide, right, scored = m.astype(np.float64), 0, 0
    leaves = forest.leaves_of(index[0], wide)
    for q in range(0, len(m), 100):
        far = np.sqrt(((wide - wide[q]) ** 2).sum(axis=1))
        far[q] = np.inf
        right += len(set(np.argsort(far, kind="stable")[:10].tolist()) & {r.vec_id for r in out if r.query_id == q})
        met = np.zeros(len(m), bool)
        for t, leaf in forest.probes(index[0], wide[q], index[2], wanted):
            met |= leaves[:, t] == leaf
        scored += met.mean()
    n = len(range(0, len(m), 100))
    assert index[0].depth == 6 and right >= 0.9 * 10 * n and scored < 0.2 * n, (right / (10 * n), scored / n)
