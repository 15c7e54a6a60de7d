"""Rounds of clustering blocks around mean shapes, on slices of blocks.

A slice holds the points of up to ``SLICE`` blocks of a group as flat arrays in one row, with what is known of each block: for
every number of clusters its shape and matched roles, and for every shape a lower bound of its distance. The root of
an assignment's cost is a distance, so a shape that moved by d is nearer by d at most. A round solves each block's own
shape anew and then only those shapes that the bounds leave open, so its results are those of solving all. Slices stay
where they are; only sums of points per shape are shuffled.

A group of up to ``WHOLE`` blocks is read by one task per number of clusters, which runs all its rounds (``whole_trails``)
and keeps the shapes of each; larger groups run a round at a time over all their slices.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from touchline.functions.batches import append_batchwise
from touchline.functions.keys import join_keys
from touchline.operators.assignments import SAME, best_assignments, priced_assignments
from touchline.session import compute_partitions, discard, stored

SLICE = 64
SOLVED_AT_ONCE = 4096
WHOLE = 131_072
PART = 16_384
# Fixed value: room for rounding in comparisons of bounds.
ROOM = 1e-9

STATE = T.StructType(
    [T.StructField("label", T.ArrayType(T.IntegerType())), T.StructField("role", T.ArrayType(T.IntegerType()))]
    + [T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("cost", "near", "lower", "sums", "counts")]
    + [T.StructField("hash", T.LongType())]
)


def slots(k_min: int, k_max: int) -> list[tuple[int, int]]:
    """(k, c) of every shape of a group in their fixed order."""
    return [(k, c) for k in range(k_min, k_max + 1) for c in range(1, k + 1)]


def sliced(blocks: DataFrame, by: list[str], block: list[str], points: str, size: int = SLICE) -> DataFrame:
    """One row per slice: ``ids``, the flat ``pts`` of its blocks and ``many``, whether a key had several rows."""
    known = blocks.groupBy(*by, *block).agg(F.min(points).alias("_pts"), (F.count(F.lit(1)) > 1).alias("_many"))
    number = known.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / size).alias("_slices"))
    dealt = join_keys(known, number, by).withColumn("_slice", F.pmod(F.xxhash64(*block), F.col("_slices")))
    held = dealt.groupBy(*by, "_slice").agg(F.collect_list(F.struct(F.struct(*block).alias("id"), F.col("_pts").alias("p"), F.col("_many").alias("many"))).alias("_b"))
    flat = F.flatten(F.transform("_b", lambda b: F.flatten(F.transform(b["p"], lambda p: F.array(p["x"], p["y"])))))
    out = held.select(*by, F.transform("_b", lambda b: b["id"]).alias("ids"), flat.alias("pts"), F.transform("_b", lambda b: b["many"]).alias("many"))
    return out.repartition(compute_partitions(blocks.sparkSession))


def packed_shapes(shapes: DataFrame, by: list[str], k_min: int, k_max: int) -> DataFrame:
    """One row per group: the flat ``shapes`` of all slots, NaN where a slot has none or a coordinate is missing, and ``held``."""
    at = F.create_map(*[v for i, (k, c) in enumerate(slots(k_min, k_max)) for v in (F.lit(k * 100_000 + c), F.lit(i))])
    nan = F.lit(float("nan"))
    flat = F.flatten(F.transform("shape", lambda p: F.array(F.coalesce(p["x"], nan), F.coalesce(p["y"], nan))))
    found = shapes.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct(F.element_at(at, F.col("k") * 100_000 + F.col("c")).alias("at"), flat.alias("s")))).alias("_m"), F.max(F.size("shape")).alias("_n"))
    every = F.sequence(F.lit(0), F.lit(len(slots(k_min, k_max)) - 1))
    empty = F.array_repeat(nan, 2 * F.col("_n"))
    shape = F.flatten(F.transform(every, lambda i: F.coalesce(F.col("_m")[i], empty)))
    return found.select(*by, shape.alias("shapes"), F.transform(every, lambda i: F.map_contains_key("_m", i)).alias("held"), F.lit(None).cast("array<double>").alias("before"))


def moved_shapes(state: DataFrame, shapes: DataFrame, by: list[str]) -> DataFrame:
    """The mean of every slot's members, role by role, with the shapes ``before``; slots without members are held no more."""
    parts = state.select(*by, F.posexplode(F.arrays_zip("sums", "counts")).alias("_at", "_v"))
    summed = parts.groupBy(*by, "_at").agg(F.sum("_v.sums").alias("s"), F.sum("_v.counts").alias("n"))
    cell = F.struct("_at", F.coalesce(F.col("s") / F.nullif("n", F.lit(0.0)), F.lit(float("nan"))).alias("x"))
    flat = summed.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(cell)), lambda c: c["x"]).alias("_new"))
    used = state.select(*by, F.explode(F.array_distinct("label")).alias("_slot")).groupBy(*by).agg(F.collect_set("_slot").alias("_used"))
    both = join_keys(join_keys(shapes.select(*by, "shapes", "held"), flat, by), used, by)
    held = F.transform("held", lambda h, i: h & F.array_contains("_used", i))
    return both.select(*by, F.col("_new").alias("shapes"), held.alias("held"), F.col("shapes").alias("before"))


def _numbers(array: pa.Array, row: int) -> np.ndarray:
    """The numbers of one row's array, missing ones as NaN."""
    return array.slice(row, 1).flatten().to_numpy(zero_copy_only=False).astype(float)


def _solved(pts: np.ndarray, shapes: np.ndarray, block: np.ndarray, slot: np.ndarray, over: np.ndarray, prices: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Costs and roles of pairs of a block and a shape; minus a bound where already each point's nearest cost more than ``over``.

    ``prices`` per block and shape add a bound, start the assignments and are renewed.
    """
    cost, role = np.full(len(block), np.nan), np.zeros((len(block), pts.shape[1]), np.int32)
    floor = np.zeros(len(block))
    for a in range(0, len(block), SOLVED_AT_ONCE):
        b, s = block[a : a + SOLVED_AT_ONCE], slot[a : a + SOLVED_AT_ONCE]
        cells, limit = _cells(pts, shapes, b, s), over[a : a + SOLVED_AT_ONCE]
        if np.isfinite(limit).any():
            floor[a : a + len(b)] = np.maximum(cells.min(axis=1).sum(axis=0), cells.min(axis=0).sum(axis=0))
            if prices is not None:
                own = prices[b, s].T.astype(float)
                floor[a : a + len(b)] = np.fmax(floor[a : a + len(b)], own.sum(axis=0) + (cells - own).min(axis=1).sum(axis=0))
        open_ = np.flatnonzero(~(floor[a : a + len(b)] > limit))
        if open_.size:
            costs = np.ascontiguousarray(cells[:, :, open_].transpose(2, 0, 1))
            if prices is None:
                cost[a + open_], role[a + open_] = best_assignments(costs)
            else:
                cost[a + open_], role[a + open_], prices[b[open_], s[open_]] = priced_assignments(costs, prices[b[open_], s[open_]])
            floor[a + open_] = np.inf
    return np.where(np.isinf(floor), cost, -floor), role


def _cells(pts: np.ndarray, shapes: np.ndarray, b: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Squared distances (point, role, pair) of pairs of a block and a shape."""
    p, q = np.ascontiguousarray(pts[b].transpose(1, 2, 0)), np.ascontiguousarray(shapes[s].transpose(1, 2, 0))
    return (p[:, None, 0] - q[None, :, 0]) ** 2 + (p[:, None, 1] - q[None, :, 1]) ** 2


def _still_best(pts: np.ndarray, shapes: np.ndarray, block: np.ndarray, slot: np.ndarray, role: np.ndarray, prices: np.ndarray) -> np.ndarray:
    """Costs of pairs by an earlier ``role`` where ``prices`` show it to be the only cheapest one, NaN elsewhere."""
    cost, n = np.full(len(block), np.nan), pts.shape[1]
    for a in range(0, len(block), SOLVED_AT_ONCE):
        b, s, r = block[a : a + SOLVED_AT_ONCE], slot[a : a + SOLVED_AT_ONCE], role[a : a + SOLVED_AT_ONCE].T
        cells, each = _cells(pts, shapes, b, s), np.arange(len(b))
        priced = cells - prices[b, s].T.astype(float)
        own = priced[np.arange(n)[:, None], r, each]
        tight = (priced - own[:, None] <= SAME * np.maximum(cells.max(axis=(0, 1)), 1e-300)).sum(axis=(0, 1))
        total = np.zeros(len(b))
        for i in range(n):
            total = total + cells[i, r[i], each]
        cost[a : a + len(b)] = np.where(tight == n, total, np.nan)
    return cost


def _one_slice(pts: np.ndarray, many: np.ndarray, shapes: np.ndarray, held: np.ndarray, moved: np.ndarray | None, label: np.ndarray | None, lower: np.ndarray | None, places: list[np.ndarray], whole: bool, prices: np.ndarray | None = None, kept: tuple | None = None) -> tuple:
    """A round of one slice: label, role, cost, near, lower per block, and the sums of the points of every slot.

    ``kept`` tells which shapes stand still, and the last round's cost and roles, which hold for these.
    """
    m, n, kinds = len(pts), pts.shape[1], len(places)
    sure = held & np.isfinite(shapes).all(axis=(1, 2))
    open_block = ~np.isfinite(pts).all(axis=(1, 2))
    bound = np.zeros((m, len(held))) if lower is None else lower - moved
    bound[:, ~sure], bound[open_block] = -np.inf, -np.inf
    bound[np.isnan(bound)] = -np.inf
    cost, near, chosen, roles = np.full((m, kinds), np.nan), np.full((m, kinds), np.nan), np.full((m, kinds), -1), np.zeros((m, kinds, n), np.int32)
    exact, role_at = np.full((m, len(held)), np.inf), np.zeros((m, len(held), n), np.int32)
    if label is not None:
        b, k = np.nonzero(held[np.maximum(label, 0)] & (label >= 0))
        s = label[b, k]
        if kept is not None:
            still, costs, matched = kept
            same = still[s]
            exact[b[same], s[same]], role_at[b[same], s[same]] = costs[b[same], k[same]], matched[b[same], k[same]]
            b, k, s = b[~same], k[~same], s[~same]
            role_at[b, s] = matched[b, k]
            exact[b, s] = found = _still_best(pts, shapes, b, s, matched[b, k], prices)
            b, s = b[np.isnan(found)], s[np.isnan(found)]
        exact[b, s], role_at[b, s] = _solved(pts, shapes, b, s, np.full(len(b), np.inf), prices)
    for k, place in enumerate(places):
        here = place[held[place]]
        if not here.size:
            continue
        best = np.min(np.where(np.isnan(exact[:, here]), -np.inf, exact[:, here]), axis=1)
        limit = np.full(m, np.inf) if whole else np.where(np.isfinite(best), np.sqrt(np.maximum(best, 0)) * (1 + ROOM) + ROOM, np.inf)
        todo = np.isinf(exact[:, here]) & ~(bound[:, here] > limit[:, None])
        b, j = np.nonzero(todo)
        s = here[j]
        got, role = _solved(pts, shapes, b, s, limit[b] ** 2, prices)
        solved = ~(got < 0)
        exact[b[solved], s[solved]], role_at[b[solved], s[solved]] = got[solved], role[solved]
        bound[b[~solved], s[~solved]] = np.maximum(bound[b[~solved], s[~solved]], np.sqrt(-got[~solved]))
        ranked = np.where(np.isnan(exact[:, here]), -np.inf, exact[:, here])
        order = np.argsort(ranked, axis=1, kind="stable")
        first = here[order[:, 0]]
        chosen[:, k], cost[:, k], roles[:, k] = first, exact[np.arange(m), first], role_at[np.arange(m), first]
        if whole:
            second = exact[np.arange(m), here[order[:, 1]]] if here.size > 1 else np.full(m, np.nan)
            near[:, k] = np.where(many, cost[:, k], second)
    known = np.isfinite(exact)
    bound[known] = np.sqrt(np.maximum(exact[known], 0))
    b, k = np.nonzero(chosen >= 0)
    there = ~np.isnan(pts[b])
    at = ((chosen[b, k][:, None] * n + roles[b, k])[..., None] * 2 + np.arange(2)).ravel()
    added = lambda values: np.bincount(at, values.ravel(), 2 * n * len(held)).reshape(len(held), n, 2)
    sums, counts = added(np.where(there, pts[b], 0.0)), added(there.astype(float))
    return chosen, roles, cost, near, bound, sums, counts


def _farthest(pts: np.ndarray, key: np.ndarray, k_max: int) -> np.ndarray:
    """Farthest-first start shapes of a group whose rows come in order; rows of one key are starts together."""
    near, picked = np.full(len(pts), np.inf), [0]
    while len(picked) < k_max:
        near[key == key[picked[-1]]] = -1.0
        b = np.flatnonzero(near >= 0)
        if not b.size:
            break
        for part in np.array_split(b, -(-len(b) // SOLVED_AT_ONCE)):
            cost, _ = _solved(pts, pts[picked[-1:]], part, np.zeros(len(part), int), near[part])
            near[part] = np.fmin(near[part], np.where(cost < 0, np.inf, cost))
        picked.append(int(near.argmax()))
    return pts[picked]


def _trail(pts: np.ndarray, many: np.ndarray, starts: np.ndarray, k: int, k_min: int, seed: int) -> tuple[list[int], list[np.ndarray], list[np.ndarray], int]:
    """All rounds of a group for ``k`` clusters: per round a hash of the labels, the shapes they came from and which were held.

    It ends where shapes come back; from there on rounds go in a circle that starts at the round given last.
    """
    (m, n, _), most = pts.shape, len(starts)
    held, shapes = np.zeros(k, bool), np.full((k, n, 2), np.nan)
    if k <= max(most, k_min):
        held[:most], shapes[: min(k, most)] = True, starts[:k]
    parts = [slice(a, a + PART) for a in range(0, m, PART)]
    prices = np.full((m, k, n), np.nan, np.float32)
    last: list[tuple | None] = [None] * len(parts)
    moved, still, places = None, None, [np.arange(k)]
    hashes, shaped, holds, seen = [], [], [], {}
    while (state := shapes.tobytes() + held.tobytes()) not in seen:
        seen[state] = len(hashes)
        sums, counts, made = np.zeros((k, n, 2)), np.zeros((k, n, 2)), hashlib.blake2b(seed.to_bytes(8, "little", signed=True), digest_size=8)
        for i, part in enumerate(parts):
            label, lower, kept = (None, None, None) if last[i] is None else (*last[i][:2], (still, *last[i][2:]))
            label, role, cost, _, lower, *added = _one_slice(pts[part], many[part], shapes, held, moved, label, lower, places, False, prices[part], kept)
            last[i] = label, lower, cost, role.astype(np.int8)
            sums, counts = sums + added[0], counts + added[1]
            made.update(label.astype(np.int8).tobytes())
        hashes.append(int.from_bytes(made.digest(), "little", signed=True))
        shaped.append(shapes)
        holds.append(held)
        used = np.isin(np.arange(k), np.concatenate([label.ravel() for label, *_ in last]))
        before, shapes, held = shapes, sums / np.where(counts > 0, counts, np.nan), held & used
        moved = np.sqrt(((shapes - before) ** 2).sum(axis=(1, 2))) * (1 + ROOM) + ROOM
        still = (shapes == before).all(axis=(1, 2))
    return hashes, shaped, holds, seen[state]


def whole_groups(blocks: DataFrame, by: list[str], key: Column, points: str = "pts") -> DataFrame:
    """One row per group: the flat ``pts`` of its rows in the order of ``key``, and of every key the number of ``rows`` it has."""
    flat = F.flatten(F.transform(points, lambda p: F.array(p["x"], p["y"])))
    keyed = blocks.select(*by, key.alias("key"), flat.alias("p")).groupBy(*by, "key").agg(F.array_sort(F.collect_list("p")).alias("p"))
    held = keyed.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("key", "p"))).alias("_b"))
    return held.select(*by, F.flatten(F.flatten(F.transform("_b", lambda b: b["p"]))).alias("pts"), F.transform("_b", lambda b: F.size(b["p"])).alias("rows"))


def _rows(batches: Iterator[pa.RecordBatch], names: list[str], schema: pa.Schema, use) -> Iterator[pa.RecordBatch]:
    """One batch per row: its other columns and the lists that ``use`` makes of the ``names``."""
    for batch in batches:
        for row in range(batch.num_rows):
            one = batch.slice(row, 1)
            made = use(*[one.column(name) for name in names])
            passed = [c.cast(schema.field(name).type) for c, name in zip(one.columns, one.schema.names) if name in schema.names]
            yield pa.RecordBatch.from_arrays([*passed, *[pa.array([v], t) for v, t in zip(made, schema.types[len(passed) :])]], schema=schema)


def _read(pts: pa.Array, rows: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    rows = rows.flatten().to_numpy()
    return _numbers(pts, 0).reshape(rows.sum(), -1, 2), rows


def whole_trails(groups: DataFrame, by: list[str], k_min: int, k_max: int, partitions: int) -> DataFrame:
    """Every group's rounds for every number of clusters ``k``, a row each: ``hashes``, ``trail``, ``holds`` and ``circle`` as in ``_trail``."""
    keys = groups.select(*by).schema
    begun_schema = T.StructType([*groups.schema.fields, T.StructField("starts", T.ArrayType(T.DoubleType()))])
    made = [("hashes", T.LongType()), ("trail", T.DoubleType()), ("holds", T.BooleanType())]
    run_schema = T.StructType([*keys.fields, T.StructField("k", T.IntegerType()), *[T.StructField(n, T.ArrayType(t)) for n, t in made], T.StructField("circle", T.IntegerType())])
    begun_arrow, run_arrow = to_arrow_schema(begun_schema), to_arrow_schema(run_schema)

    def begin(pts: pa.Array, rows: pa.Array) -> list:
        pts, rows = _read(pts, rows)
        return [_farthest(pts, np.repeat(np.arange(len(rows)), rows), k_max).ravel()]

    def run(pts: pa.Array, rows: pa.Array, starts: pa.Array, k: pa.Array, seed: pa.Array) -> list:
        pts, rows = _read(pts, rows)
        starts = _numbers(starts, 0).reshape(-1, *pts.shape[1:])
        hashes, trail, holds, circle = _trail(pts[np.cumsum(rows) - rows], rows > 1, starts, k[0].as_py(), k_min, seed[0].as_py())
        return [hashes, np.stack(trail).ravel(), np.concatenate(holds), circle]

    begun = stored(groups.repartition(partitions).mapInArrow(lambda b: _rows(b, ["pts", "rows"], begun_arrow, begin), begun_schema))
    units = begun.select(*by, F.explode(F.sequence(F.lit(k_min), F.lit(k_max))).alias("k"), "pts", "rows", "starts").withColumn("seed", F.xxhash64(*by, "k"))
    # ranges of the random seeds are of equal length, so no task gets many rows by chance
    out = units.repartitionByRange(partitions, "seed").mapInArrow(lambda b: _rows(b, ["pts", "rows", "starts", "k", "seed"], run_arrow, run), run_schema)
    out = stored(out)
    discard(begun)
    return out


def _round_at(t: Column) -> Column:
    """The place of round ``t`` in ``hashes``: after the last one rounds go in the circle."""
    n = F.size("hashes")
    return F.when(t < n, t).otherwise(F.col("circle") + F.pmod(t - F.col("circle"), n - F.col("circle")))


def trail_hashes(trails: DataFrame, first: int, end: int) -> list[int]:
    """The sum over all trails of the hashes of rounds ``first`` to ``end`` - 1."""
    each = trails.select("hashes", "circle", F.explode(F.sequence(F.lit(first), F.lit(end - 1))).alias("_t"))
    summed = each.groupBy("_t").agg(F.sum(F.get("hashes", _round_at(F.col("_t"))).cast("decimal(38,0)")).alias("_h"))
    found = {r["_t"]: int(r["_h"]) for r in summed.collect()}  # a number per round
    return [found.get(t, 0) for t in range(first, end)]


def shapes_at(trails: DataFrame, by: list[str], t: int) -> DataFrame:
    """One row per group as of ``packed_shapes``: the shapes of round ``t`` of its trails."""
    at = _round_at(F.lit(t))
    size = (F.size("trail") / F.size("hashes")).cast("int")
    cut = F.struct("k", F.slice("trail", at * size + 1, size).alias("s"), F.slice("holds", at * F.col("k") + 1, F.col("k")).alias("h"))
    packed = trails.groupBy(*by).agg(F.array_sort(F.collect_list(cut)).alias("_u"))
    flat = lambda name: F.flatten(F.transform("_u", lambda u: u[name]))
    return packed.select(*by, flat("s").alias("shapes"), flat("h").alias("held"), F.lit(None).cast("array<double>").alias("before"))


def next_round(state: DataFrame, shapes: DataFrame, by: list[str], block: list[str], k_min: int, k_max: int, whole: bool = False) -> DataFrame:
    """Slices with every block's cheapest shape, of equals the first; ``whole`` solves all shapes and adds the next one's cost as ``near``.

    ``state`` comes from ``sliced`` or an earlier round, whose bounds are used unless ``whole``.
    """
    table = slots(k_min, k_max)
    places = [np.array([i for i, (of, _) in enumerate(table) if of == k]) for k in range(k_min, k_max + 1)]
    known = not whole and "lower" in state.columns
    met = join_keys(state.select(*by, "ids", "pts", "many", *[n for n in ("label", "lower") if known]), shapes, by)

    def use(argument: pa.Array) -> list[pa.Array]:
        part = dict(zip([f.name for f in argument.type], argument.flatten()))
        out: list[list] = [[] for _ in range(7)]
        total: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for row in range(len(argument)):
            held = part["held"].slice(row, 1).flatten().to_numpy(zero_copy_only=False).astype(bool)
            many = part["many"].slice(row, 1).flatten().to_numpy(zero_copy_only=False).astype(bool)
            now = _numbers(part["shapes"], row).reshape(len(held), -1, 2)
            pts = _numbers(part["pts"], row).reshape(len(many), -1, 2)
            label = lower = moved = None
            if known:
                label = part["label"].slice(row, 1).flatten().to_numpy().reshape(len(many), -1)
                lower = _numbers(part["lower"], row).reshape(len(many), -1)
                before = _numbers(part["before"], row).reshape(now.shape)
                moved = np.sqrt(((now - before) ** 2).sum(axis=(1, 2))) * (1 + ROOM) + ROOM
            *found, sums, counts = _one_slice(pts, many, now, held, moved, label, lower, places, whole)
            # slices of a group that meet in a batch add up in the first one's row
            group = part["group"][row].as_py()
            if group in total:
                total[group][0][...] += sums
                total[group][1][...] += counts
                sums, counts = sums[:0], counts[:0]
            else:
                total[group] = sums, counts
            for values, made in zip(out, (*found, sums, counts)):
                values.append(made.reshape(-1))
        lists = []
        for values, kind in zip(out, (pa.int32(), pa.int32(), *[pa.float64()] * 5)):
            ends = np.cumsum([0, *[len(v) for v in values]]).astype(np.int32)
            flat = np.concatenate(values) if values else np.zeros(0)
            body = pa.array(flat.astype(np.int32)) if kind == pa.int32() else pa.array(flat, pa.float64(), from_pandas=True)
            lists.append(pa.ListArray.from_arrays(pa.array(ends), body))
        return [*lists, pa.array(np.zeros(len(argument), np.int64))]

    names = ["pts", "many", "shapes", "held", *(["label", "lower", "before"] if known else [])]
    group = F.xxhash64(*[F.coalesce(F.to_json(F.struct(b)), F.lit("")) for b in by]).alias("group")
    slim = met.select(*by, "ids", "pts", "many", F.struct(*names, group).alias("_in"))
    out = append_batchwise(slim, F.col("_in"), STATE, use).drop("_in")
    return out.withColumn("hash", F.xxhash64(*by, "ids", "label"))


def unpacked(state: DataFrame, by: list[str], block: list[str], k_min: int, k_max: int) -> DataFrame:
    """One row per block and number of clusters ``k``: ``c``, ``cost`` and ``near``."""
    kinds = k_max - k_min + 1
    first = F.create_map(*[v for i, (k, c) in enumerate(slots(k_min, k_max)) if c == 1 for v in (F.lit(k), F.lit(i))])

    def of(name: str, at: Column) -> Column:
        return F.get(name, at)

    rows = state.select(*by, "label", "cost", "near", F.posexplode("ids").alias("_i", "_id"))
    each = rows.select("*", F.explode(F.sequence(F.lit(k_min), F.lit(k_max))).alias("k"))
    at = F.col("_i") * kinds + F.col("k") - k_min
    out = each.select(*by, *[F.col("_id")[b].alias(b) for b in block], "k", (of("label", at) - F.element_at(first, F.col("k")) + 1).alias("c"), of("cost", at).alias("cost"), of("near", at).alias("near"), of("label", at).alias("_slot"))
    return out.where("_slot >= 0").drop("_slot")
