"""Clusters of blocks against a plain version over all blocks and until nothing moves."""

import hashlib
import random

import numpy as np

from touchline.operators import formations as fm


def shapes_table(spark, n=120, rare=3, seed=3):
    """Four common shapes and one that ``rare`` blocks, late in hash order, hold."""
    rng = random.Random(seed)
    bases = [[(rng.uniform(-40, 40), rng.uniform(-30, 30)) for _ in range(10)] for _ in range(5)]
    order = sorted(range(n), key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i))
    kind = {i: 4 if i in order[-rare:] else i % 4 for i in range(n)}
    noise = lambda: rng.gauss(0, 2.5)
    pts = {i: [(x + 100 * (kind[i] == 4) + noise(), y + noise()) for x, y in bases[kind[i]]] for i in range(n)}
    df = spark.createDataFrame([("g", i, pts[i]) for i in range(n)], "g string, block_id long, pts array<struct<x:double,y:double>>")
    return df, {i: np.array(p) for i, p in pts.items()}, order


def cost(a, b):
    delta = a[:, None, :] - b[None, :, :]
    total, roles = fm.best_assignments((delta**2).sum(axis=-1)[None])
    return total[0], roles[0]


def plain_starts(pts, order, k):
    picked = [order[0]]
    while len(picked) < min(k, len(order)):
        picked.append(max((i for i in order if i not in picked), key=lambda i: min(cost(pts[i], pts[p])[0] for p in picked)))
    return picked


def plain_clusters(pts, order, k_min, k_max):
    starts, best = plain_starts(pts, order, k_max), None
    for k in range(k_min, k_max + 1):
        shapes, before = {c: pts[i] for c, i in enumerate(starts[:k])}, None
        while True:
            near = {i: sorted((cost(p, s)[0], c) for c, s in shapes.items())[:2] for i, p in pts.items()}
            label = {i: n[0][1] for i, n in near.items()}
            if label == before:
                break
            before, sums = label, {}
            for i, c in label.items():
                placed = np.empty_like(pts[i])
                placed[cost(pts[i], shapes[c])[1]] = pts[i]
                sums.setdefault(c, []).append(placed)
            shapes = {c: np.mean(p, axis=0) for c, p in sums.items()}
        mean = np.mean([(b[0] - a[0]) / max(a[0], b[0]) for a, b in near.values()])
        if best is None or round(mean, 9) > best[0]:
            best = (round(mean, 9), label)
    names = {}
    return {i: names.setdefault(best[1][i], len(names)) for i in sorted(pts)}


def test_starts_come_from_all_blocks(spark):
    df, pts, order = shapes_table(spark)
    got = fm.start_shapes(df, ["g"], ["block_id"], k_max=6).orderBy("c").collect()
    assert [[tuple(p) for p in r["shape"]] for r in got] == [[tuple(p) for p in pts[i]] for i in plain_starts(pts, order, 6)]
    assert any(i in order[-3:] for i in plain_starts(pts, order, 6)[:2])


def test_clusters_equal_the_plain_version(spark):
    df, pts, order = shapes_table(spark)
    got = {r.block_id: r.cluster_label for r in fm.cluster_blocks(df, ["g"], ["block_id"]).collect()}
    assert got == plain_clusters(pts, order, 3, 12)


def test_chain_runs_the_whole_range():
    from touchline.catalog.chain import SETTINGS
    from touchline.config import K_MAX

    assert SETTINGS.k_max == K_MAX
