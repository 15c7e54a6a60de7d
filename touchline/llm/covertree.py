"""Exact threshold join of embeddings by dual traversal of cover trees.

Vectors are scaled to length 1, so cosine at least ``c`` means a distance of at most ``sqrt(2 - 2c)``. Equal vectors are
one class with one place in the tree. The top of the tree is fitted on a bounded sample (``SAMPLE_ROWS`` vectors, at most
``CENTRES`` centres, each the farthest from those before) and every vector goes to its nearest centre; a centre's vectors
are dealt into blocks of bounded size. In a block, nested levels with halving radii are built: a level's centres cover
their node within the radius, lie farther apart than it, and are centres on all lower levels.

Two blocks meet unless the bound ``distance of centres - covering radii > threshold`` rules them out. Their task goes down
both trees together with the same bound for every pair of nodes. A pair that lies within the threshold altogether is not
opened: it adds its sizes to the counts of links. Pairs of single vectors are decided in double precision. Links come
back as spanning links, so groups of near copies are never expanded, and components are found on these.

Without structure, as between random vectors, no bound helps above single vectors: an exact join then compares all pairs
of blocks. Defined results: null, zero and non-finite vectors and rows without an id link with nothing; vectors of several
dimensions are compared within each; every row gives one, also where ids repeat, and a sound row of an id does not hide an
unsound one; equal rows link with each other; an empty table gives no rows. Labels and extra columns do not take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.llm.common import table
from touchline.llm.components import components, spanning_links
from touchline.llm.vectors import dimensions, is_usable, matrix, unit, usable_vectors
from touchline.session import stored

SAMPLE_ROWS = 16_384
CENTRES = 256
BLOCK_ROWS = 8_192
RADII = (0.5, 0.25, 0.125, 0.0625, 0.03125)
SLACK = 1e-9
TILE = 1_024
PAIRS_AT_ONCE = 400_000


def far_centres(sample: np.ndarray, most: int) -> np.ndarray:
    """Centres by farthest-first traversal."""
    if not len(sample):
        return sample
    picked = [0]
    near = np.full(len(sample), np.inf)
    while len(picked) < min(most, len(sample)):
        near = np.minimum(near, 2 - 2 * sample @ sample[picked[-1]])
        if near.max() <= SLACK:
            break
        picked.append(int(near.argmax()))
    return sample[picked]


def cover(points: np.ndarray, radius: float) -> np.ndarray:
    """For every point the index of its centre: centres are farther apart than ``radius``, points within it.

    The first point is a centre. Centres are picked from batches of points not yet covered.
    """
    least = 1 - radius * radius / 2
    centre = np.full(len(points), -1)
    rest = np.arange(len(points))
    while len(rest):
        batch = rest[:256]
        near = points[batch] @ points[batch].T >= least
        free, picked = np.ones(len(batch), bool), []
        for i in range(len(batch)):
            if free[i]:
                picked.append(i)
                free &= ~near[i]
                free[i] = False
        chosen = batch[picked]
        like = points[rest] @ points[chosen].T
        best = like.argmax(axis=1)
        best[np.isin(rest, chosen)] = np.searchsorted(chosen, rest[np.isin(rest, chosen)])
        inside = (like[np.arange(len(rest)), best] >= least) | np.isin(rest, chosen)
        centre[rest[inside]] = chosen[best[inside]]
        rest = rest[~inside]
    return centre


def nested_levels(points: np.ndarray, radii: tuple[float, ...] = RADII) -> np.ndarray:
    """Per point and level the index of its node's centre; a node of a level lies inside one node of the level above."""
    out = np.zeros((len(points), len(radii)), dtype=np.int32)
    above = np.zeros(len(points), dtype=np.int64)
    for level, radius in enumerate(radii):
        now = np.arange(len(points))
        order = np.argsort(above, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(above[order]) != 0]) if len(points) else []
        for inside in np.split(order, starts[1:]):
            if len(inside) > 1:
                inside = np.r_[above[inside[0]], inside[inside != above[inside[0]]]] if level else inside
                now[inside] = inside[cover(points[inside], radius)]
        out[:, level] = above = now
    return out


class Tree:
    """A block's levels: per level the nodes' centres, covering radii, weights, and each node's range of children."""

    def __init__(self, points: np.ndarray, weight: np.ndarray, path: np.ndarray):
        order = np.lexsort([*path.T[::-1]])
        self.order, self.points, self.weight = order, points[order], weight[order]
        self.levels = []
        path = path[order]
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        for level in range(path.shape[1]):
            new = np.r_[True, np.diff(path[:, level]) != 0]
            starts = np.flatnonzero(new)
            self.levels.append(self._level(starts, place[path[starts, level]]))
        n = np.arange(len(points))
        self.levels.append(self._level(n, n))
        for upper, lower in zip(self.levels, self.levels[1:]):
            upper["child"] = np.searchsorted(lower["start"], np.r_[upper["start"], len(points)])

    def _level(self, starts: np.ndarray, centre: np.ndarray) -> dict[str, np.ndarray]:
        ends = np.r_[starts[1:], len(self.points)].astype(np.int64)
        of = np.repeat(np.arange(len(starts)), ends - starts)
        far = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", self.points, self.points[centre[of]])))
        radius = np.maximum.reduceat(far, starts) if len(starts) else far
        # a rounded difference of nearly equal products is no better than this
        radius = np.where(ends - starts == 1, 0.0, radius + 1e-7)
        weight = np.add.reduceat(self.weight, starts) if len(starts) else self.weight
        return {"start": starts, "end": ends, "centre": centre, "radius": radius, "weight": weight, "links": np.zeros(len(starts), np.int64), "own": np.zeros(len(starts), np.int64)}

    def push_down(self) -> np.ndarray:
        """Links per point, in the order the points came in."""
        total = np.zeros(len(self.points), dtype=np.int64)
        for level in self.levels:
            size = level["end"] - level["start"]
            # a node within the threshold of itself has counted each member's own weight too
            total += np.repeat(level["links"], size) - np.repeat(level["own"], size) * self.weight
        out = np.empty_like(total)
        out[self.order] = total
        return out


def _top_pairs(u: Tree, v: Tree, reach: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of top nodes the bound does not rule out, by tiles of products; single vectors apart from wide nodes."""
    a, b = u.levels[0], v.levels[0]
    cu, cv = u.points[a["centre"]].astype(np.float32), v.points[b["centre"]].astype(np.float32)
    for wide in (False, True):
        columns = np.flatnonzero((b["radius"] > 0) == wide)
        if not len(columns):
            continue
        widest = b["radius"][columns].max()
        for at in range(0, len(cu), TILE):
            bound = reach + a["radius"][at : at + TILE] + widest
            least = np.where(bound < 2, 1 - bound * bound / 2, -2).astype(np.float32) - np.float32(1e-5)
            i, j = np.nonzero(cu[at : at + TILE] @ cv[columns].T >= least[:, None])
            i, j = i + at, columns[j]
            keep = i <= j if same else slice(None)
            yield i[keep], j[keep]


def _children(of: dict[str, np.ndarray], nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return of["child"][nodes], of["child"][nodes + 1] - of["child"][nodes]


def dual_traversal(u: Tree, v: Tree, cosine: float, same: bool, exact) -> tuple[np.ndarray, np.ndarray]:
    """Count links in both trees; return spanning links as places in ``u`` and then ``v``. ``same``: v is u.

    ``exact(i, j)`` decides pairs of places whose cosine is too near to the threshold for rounded products.
    """
    reach = float(np.sqrt(2 - 2 * cosine))
    shift = 0 if same else len(u.points)
    size = shift + len(v.points)
    found = [np.zeros(0, np.int64), np.zeros(0, np.int64)]

    def link(i: np.ndarray, j: np.ndarray) -> None:
        if len(i):
            found[:] = spanning_links(np.concatenate([found[0], i]), np.concatenate([found[1], j + shift]), size)

    stack = [(0, i, j) for i, j in _top_pairs(u, v, reach, same) if len(i)]
    while stack:
        level, i, j = stack.pop()
        if len(i) > PAIRS_AT_ONCE:
            stack += [(level, i[: len(i) // 2], j[: len(i) // 2]), (level, i[len(i) // 2 :], j[len(i) // 2 :])]
            continue
        a, b = u.levels[level], v.levels[level]
        like = np.einsum("ij,ij->i", u.points[a["centre"][i]], v.points[b["centre"][j]])
        far = np.sqrt(np.maximum(0, 2 - 2 * like))
        far[(i == j) & same] = 0.0
        wide = a["radius"][i] + b["radius"][j]
        single = (a["end"][i] - a["start"][i] == 1) & (b["end"][j] - b["start"][j] == 1)
        whole = ~single & (far + wide <= reach - SLACK)
        near = single & (like >= cosine) & ~((i == j) & same)
        edge = np.flatnonzero(single & (np.abs(like - cosine) < SLACK) & ~((i == j) & same))
        if len(edge):
            near[edge] = exact(a["start"][i[edge]], b["start"][j[edge]])
        for taken in (near, whole):
            p, q = i[taken], j[taken]
            own = (p == q) & same
            np.add.at(a["links"], p, b["weight"][q])
            np.add.at(b["links"], q[~own], a["weight"][p[~own]])
            a["own"][p[own]] = 1
            for x, y, first in ((a, b, True), (b, a, False)):
                s, t = (p, q) if first else (q, p)
                n = x["end"][s] - x["start"][s]
                of = np.repeat(np.arange(len(s)), n)
                member = x["start"][s][of] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                other = y["start"][t][of]
                link(*((member, other) if first else (other, member)))
        open_ = np.flatnonzero(~single & ~whole & (far - wide <= reach + SLACK))
        if len(open_) and level + 1 < len(u.levels):
            i, j = i[open_], j[open_]
            (i0, ni), (j0, nj) = _children(a, i), _children(b, j)
            n = ni * nj
            for part in np.split(np.arange(len(n)), np.flatnonzero(np.diff(np.cumsum(n) // PAIRS_AT_ONCE)) + 1):
                of = np.repeat(part, n[part])
                at = np.arange(len(of)) - np.repeat(np.cumsum(n[part]) - n[part], n[part])
                ci, cj = i0[of] + at // nj[of], j0[of] + at % nj[of]
                keep = (ci <= cj) | (i[of] != j[of]) if same else slice(None)
                stack.append((level + 1, ci[keep], cj[keep]))
    return found[0], found[1]


def vector_blocks(classes: DataFrame) -> DataFrame:
    """``centre`` and ``block`` of every class, with its ``path`` through the nested levels of its block."""
    total = classes.count()
    share = min(1.0, SAMPLE_ROWS / max(total, 1))
    sample = classes.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 20)) < int(share * (1 << 20))) if share < 1 else classes
    rows = sample.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE_ROWS).select("embedding").toArrow()
    centres = far_centres(unit(matrix(rows.column(0))), min(CENTRES, -(-total // BLOCK_ROWS)))
    schema = classes.select("*", F.lit(0).alias("centre"), F.lit(0.0).alias("far")).schema

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                like = unit(matrix(batch.column(batch.schema.get_field_index("embedding")))) @ centres.T
                best = like.argmax(axis=1)
                far = np.sqrt(np.maximum(0, 2 - 2 * like[np.arange(len(like)), best])) + 1e-7
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best.astype(np.int32)), pa.array(far)], names=schema.names)

    dealt = stored(classes.mapInArrow(nearest, schema))
    sizes = dealt.groupBy("centre").count().collect()  # one row per centre
    parts = F.create_map(*[F.lit(x) for r in sizes for x in (r.centre, -(-r["count"] // BLOCK_ROWS))]) if sizes else F.create_map(F.lit(0), F.lit(1))
    part = F.pmod(F.xxhash64("rep", F.lit(5)), F.element_at(parts, F.col("centre")).cast("long"))
    keyed = dealt.withColumn("block", part)
    out = T.StructType([*keyed.schema.fields, T.StructField("path", T.ArrayType(T.IntegerType()))])

    def levels(rows: pa.Table) -> pa.Table:
        path = nested_levels(unit(matrix(rows.column("embedding"))))
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, path.size + 1, max(path.shape[1], 1), dtype=np.int32)), pa.array(path.ravel()))
        return rows.append_column("path", flat)

    return keyed.groupBy("centre", "block").applyInArrow(levels, out), centres


def threshold_links(classes: DataFrame, cosine: float) -> tuple[DataFrame, DataFrame]:
    """Links per class (``rep``, ``links``: weights of all other classes within the threshold) and spanning links ``a``,
    ``b`` between classes."""
    made, centres = vector_blocks(classes)
    blocks = stored(made)
    reach = float(np.sqrt(2 - 2 * cosine))
    by_centre = {r.centre: r.far for r in blocks.groupBy("centre").agg(F.max("far").alias("far")).collect()}  # one row per centre
    apart = np.sqrt(np.maximum(0, 2 - 2 * centres @ centres.T)) if len(centres) else np.zeros((0, 0))
    meet = [(a, b) for a in by_centre for b in by_centre if a <= b and apart[a, b] - by_centre[a] - by_centre[b] <= reach + SLACK]
    spark = classes.sparkSession
    pairs = spark.createDataFrame(meet, "cu int, cv int")
    names = blocks.select("centre", "block").distinct()
    left = names.select(F.col("centre").alias("cu"), F.col("block").alias("bu"))
    right = names.select(F.col("centre").alias("cv"), F.col("block").alias("bv"))
    keys = ["cu", "bu", "cv", "bv"]
    tasks = stored(pairs.join(left, "cu").join(right, "cv").where("cu < cv OR bu <= bv").select(*keys))
    columns = ["rep", "n", "embedding", "path"]
    rows = blocks.select("centre", "block", *columns)
    one = tasks.join(rows, (F.col("cu") == F.col("centre")) & (F.col("bu") == F.col("block"))).select(*keys, F.lit(0).alias("side"), *columns)
    two = tasks.where("cu <> cv OR bu <> bv").join(rows, (F.col("cv") == F.col("centre")) & (F.col("bv") == F.col("block")))
    met = one.unionByName(two.select(*keys, F.lit(1).alias("side"), *columns))

    def run(rows: pa.Table) -> pa.Table:
        side = rows.column("side").to_numpy()
        reps, raw = rows.column("rep").to_numpy(), matrix(rows.column("embedding"))
        points, weight, path = unit(raw), rows.column("n").to_numpy(), matrix(rows.column("path")).astype(np.int64)
        same = not side.any()
        u_rows, v_rows = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        u = Tree(points[u_rows], weight[u_rows], path[u_rows])
        v = u if same else Tree(points[v_rows], weight[v_rows], path[v_rows])
        v_rows = u_rows if same else v_rows
        length = np.sqrt((raw * raw).sum(axis=1))

        def exact(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            p, q = u_rows[u.order[i]], v_rows[v.order[j]]
            return (raw[p] * raw[q]).sum(axis=1) / (length[p] * length[q]) >= cosine

        a, b = dual_traversal(u, v, cosine, same, exact)
        place = reps[u_rows[u.order]] if same else np.concatenate([reps[u_rows[u.order]], reps[v_rows[v.order]]])
        counts = [(reps[u_rows], u.push_down())] + ([] if same else [(reps[v_rows], v.push_down())])
        rep, links = np.concatenate([c[0] for c in counts]), np.concatenate([c[1] for c in counts])
        nothing = np.zeros(0, np.int64)
        return pa.table(
            {
                "rep": np.concatenate([rep[links > 0], place[a] if len(a) else nothing]),
                "links": pa.array([*links[links > 0].tolist(), *[None] * len(a)], pa.int64()),
                "other": pa.array([*[None] * int((links > 0).sum()), *(place[b] if len(b) else nothing).tolist()], pa.int64()),
            }
        )

    found = stored(met.groupBy(*keys).applyInArrow(run, "rep long, links long, other long"))
    counts = found.where("links IS NOT NULL").groupBy("rep").agg(F.sum("links").alias("links"))
    return counts, found.where("other IS NOT NULL").select(F.col("rep").alias("a"), F.col("other").alias("b"))


def near_vectors(rows: DataFrame, cosine: float = 0.9) -> DataFrame:
    """One row per row of ``rows``: vec_id, n_links, component_id, kept."""
    good = stored(usable_vectors(rows))
    classes = stored(good.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")))
    # a vector of another dimension may have the same id, so classes have numbers of their own
    numbered = stored(classes.withColumn("vec_id", F.col("rep")).withColumn("rep", F.monotonically_increasing_id()))
    counts, links = None, None
    for n in dimensions(numbered):
        of_links = threshold_links(numbered.where(F.size("embedding") == n).drop("vec_id"), cosine)
        counts, links = of_links if counts is None else (counts.unionByName(of_links[0]), links.unionByName(of_links[1]))
    if counts is None:
        counts, links = numbered.select("rep", F.lit(0).cast("long").alias("links")), numbered.selectExpr("rep AS a", "rep AS b")
    roots = components(links).withColumnRenamed("node", "rep")
    joined = numbered.join(counts, "rep", "left").join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    of_class = stored(joined.select("embedding", "vec_id", "n", "links", "root"))
    smallest = of_class.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    of_class = stored(of_class.join(smallest, "root").select("embedding", "n", "links", "component_id"))
    # a vector is no link of its own; the other copies of its class are
    linked = good.join(of_class, "embedding").select("vec_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    others = rows.where(~is_usable(rows)).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(others).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op3_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors with their links of cosine 0.9 or more and their component."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


# every pair by its cosine, components by repeated smallest neighbours
OP3_SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) >= 0.9 END),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM good
  UNION
  SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
root AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, vec_id = coalesce(component_id, vec_id) AS kept
FROM embeddings LEFT JOIN root ON vec_id = root.a LEFT JOIN degree ON vec_id = degree.a"""
