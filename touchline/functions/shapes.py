"""Expressions over the player and role arrays of one row; nothing here shuffles."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from touchline.config import OUTFIELD, PITCH_LENGTH
from touchline.functions.coords import goal_x
from touchline.functions.keys import known


def on_side(players: Column, side: str | Column) -> Column:
    """Players of one side that have both coordinates."""
    return F.filter(players, lambda p: (p["side"] == side) & known(p["x"], p["y"]))


def _dist(a: Column, b: Column) -> Column:
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Bind an expression that is used several times, so that each row evaluates it once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def sorted_quantile(ordered: Column, p: float) -> Column:
    """Linear-interpolation quantile of a sorted array without NULLs."""
    at = (F.size(ordered) - 1) * F.lit(p)
    low = F.floor(at).cast("int")
    a = F.get(ordered, low)
    b = F.get(ordered, F.least(low + 1, F.size(ordered) - 1))
    return a + (b - a) * (at - low)


def quantile(values: Column, p: float) -> Column:
    """Linear-interpolation quantile of a small array without NULLs."""
    return let(F.array_sort(values), lambda s: sorted_quantile(s, p))


def spacing(players: Column, side: str | Column) -> Column:
    """Width and depth (p90 - p10 of y and x) and stretch (mean pair distance); NULL under three players."""
    pts = on_side(players, side)

    def range_of(p: Column, axis: str) -> Column:
        ordered = F.array_sort(F.transform(p, lambda q: q[axis]))
        return let(ordered, lambda s: sorted_quantile(s, 0.9) - sorted_quantile(s, 0.1))

    def of(p: Column) -> Column:
        n = F.size(p)
        pairs = array_sum(F.transform(p, lambda a: array_sum(F.transform(p, lambda b: _dist(a, b)))))
        return F.when(
            n >= 3,
            F.struct(
                range_of(p, "y").alias("width"),
                range_of(p, "x").alias("depth"),
                (pairs / (n * (n - 1))).alias("stretch"),
            ),
        )

    return let(pts, of)


def carrier(players: Column, side: str | Column, ball_x: Column, ball_y: Column) -> Column:
    """Player of the side nearest to the ball (first in the array on ties), NULL without ball or players."""
    pts = on_side(players, side)
    nearest = F.array_min(
        F.transform(
            pts,
            lambda p, i: F.struct(
                F.hypot(p["x"] - ball_x, p["y"] - ball_y).alias("distance"),
                i.alias("position"),
                p["player"].alias("player"),
                p["x"].alias("x"),
                p["y"].alias("y"),
            ),
        )
    )
    return F.when(ball_x.isNotNull() & ball_y.isNotNull(), nearest)


# Shape of the pressure zone around the ball carrier.
ZONE_BACK = 3.0
ZONE_FRONT = 9.0
ZONE_GOAL_SLOPE = 0.05
ZONE_POWER = 1.75


def pressure_on(players: Column, who: Column, attackers: Column, defenders: Column, length: float = PITCH_LENGTH) -> Column:
    """Total pressure of the defenders on a carrier struct.

    Each defender inside the zone adds ``100 * (1 - distance / reach) ^ 1.75``; the reach grows from the back of
    the carrier to the side facing the goal.
    """
    to_goal_x = goal_x(attackers, length) - who["x"]
    to_goal_y = -who["y"]
    goal_distance = F.hypot(to_goal_x, to_goal_y)
    front = F.lit(ZONE_FRONT) - ZONE_GOAL_SLOPE * (length - goal_distance)

    def share(p: Column) -> Column:
        dx, dy = p["x"] - who["x"], p["y"] - who["y"]
        d = F.hypot(dx, dy)
        cosine = (to_goal_x * dx + to_goal_y * dy) / ((goal_distance + 1e-9) * (d + 1e-9))
        z = (1.0 + F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))) / 2.0
        reach = ZONE_BACK + (front - ZONE_BACK) * ((z * z * z + 0.3 * z) / 1.3)
        weight = F.pow(F.greatest(1.0 - d / F.greatest(reach, F.lit(1e-4)), F.lit(0.0)), F.lit(ZONE_POWER)) * 100.0
        return F.when(d <= F.greatest(front, F.lit(ZONE_BACK)), weight).otherwise(F.lit(0.0))

    total = array_sum(F.transform(on_side(players, defenders), share))
    return F.when(who.isNotNull(), total)


def centred(players: Column) -> Column:
    """Players relative to the mean of the known points of their side."""

    def mean(side: str, axis: str) -> Column:
        known = F.filter(players, lambda q: (q["side"] == side) & q[axis].isNotNull())
        return let(known, lambda k: array_sum(F.transform(k, lambda q: q[axis])) / F.nullif(F.size(k), F.lit(0)))

    means = F.struct(*[mean(s, a).alias(f"{s}_{a}") for s in ("home", "away") for a in ("x", "y")])

    def shifted(m: Column) -> Column:
        def of(p: Column, axis: str) -> Column:
            return p[axis] - F.when(p["side"] == "home", m[f"home_{axis}"]).otherwise(m[f"away_{axis}"])

        return F.transform(players, lambda p: p.withField("x", of(p, "x")).withField("y", of(p, "y")))

    return let(means, shifted)


def third_neighbour(points: Column) -> Column:
    """Per point, the distance to its third-nearest other point (the farthest when fewer exist)."""

    def of(p: Column) -> Column:
        others = F.array_sort(F.transform(points, lambda q: _dist(p, q)))
        return F.get(others, F.least(F.lit(3), F.size(points) - 1))

    return F.transform(points, of)


def chain_order(points: Column) -> Column:
    """0-based order of the points along a nearest-neighbour walk.

    The walk starts at the point with the closest third neighbour, always steps to the nearest point not yet
    visited (lowest index on ties) and is reversed when it ends left of where it began.
    """
    start = let(third_neighbour(points), lambda near: F.array_position(near, F.array_min(near)).cast("int") - 1)
    steps = F.when(F.size(points) > 1, F.sequence(F.lit(1), F.size(points) - 1)).otherwise(
        F.array().cast("array<int>")
    )

    def step(order: Column, _: Column) -> Column:
        def nearest(last: Column) -> Column:
            left = F.filter(
                F.transform(points, lambda q, i: F.struct(_dist(last, q).alias("d"), i.alias("i"))),
                lambda s: ~F.array_contains(order, s["i"]),
            )
            return F.array_min(left)["i"]

        return F.concat(order, F.array(let(F.get(points, F.element_at(order, -1)), nearest)))

    def to_right(walk: Column) -> Column:
        first, final = F.get(points, F.get(walk, F.lit(0))), F.get(points, F.element_at(walk, -1))
        return F.when(final["x"] < first["x"], F.reverse(walk)).otherwise(walk)

    return let(F.aggregate(steps, F.array(start), step), to_right)


def _without(points: Column, index: Column) -> Column:
    """Points without the one at a 0-based index."""
    return F.filter(points, lambda p, i: i != index)


def squash(points: Column, target: int = OUTFIELD) -> Column:
    """Replace the closest neighbouring pair of the ordered points by its midpoint until ``target`` are left."""

    def step(pts: Column, _: Column) -> Column:
        gaps = F.transform(
            F.slice(pts, 1, F.greatest(F.size(pts) - 1, F.lit(1))),
            lambda p, i: F.struct(_dist(p, F.get(pts, i + 1)).alias("d"), i.alias("i")),
        )

        def merge(at: Column) -> Column:
            a, b = F.get(pts, at), F.get(pts, at + 1)
            middle = F.struct(((a["x"] + b["x"]) / 2.0).alias("x"), ((a["y"] + b["y"]) / 2.0).alias("y"))
            return F.concat(F.slice(pts, 1, at), F.array(middle), F.slice(pts, at + 3, F.size(pts)))

        return let(F.array_min(gaps)["i"], merge)

    surplus = F.slice(points, 1, F.greatest(F.size(points) - target, F.lit(0)))
    return F.aggregate(surplus, points, step)


def canonical_outfield(points: Column, target: int = OUTFIELD, axis: str = "y") -> Column:
    """Exactly ``target`` outfield points: the deepest point is the keeper, surplus ones are squashed, fewer give NULL."""
    depth = F.transform(points, lambda p: p[axis])
    keeper = let(depth, lambda d: F.array_position(d, F.array_min(d)).cast("int") - 1)
    plain = F.transform(points, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    out = let(keeper, lambda k: _without(plain, k))
    return let(out, lambda o: F.when(F.size(o) >= target, squash(o, target)))


def bures(ax: Column, ay: Column, bx: Column, by: Column, xx: Column, xy: Column, yy: Column) -> Column:
    """Squared 2-Wasserstein distance of N(a, I/2) and N(b, [[xx, xy], [xy, yy]]) in closed form."""
    trace = xx + yy
    det = F.greatest(xx * yy - xy * xy, F.lit(0.0))
    return F.pow(ax - bx, 2) + F.pow(ay - by, 2) + 1.0 + trace - math.sqrt(2.0) * F.sqrt(trace + 2.0 * F.sqrt(det))


def _count_equal(values: Column, wanted: int) -> Column:
    return F.size(F.filter(values, lambda v: v == wanted))


def line_counts(points: Column, lines: int) -> Column:
    """Players per line: right-closed bins between the quantiles of y."""

    def of(ordered: Column) -> Column:
        cuts = F.array(*[sorted_quantile(ordered, i / lines) for i in range(1, lines)])
        line = let(cuts, lambda c: F.transform(ordered, lambda y: F.size(F.filter(c, lambda q: y > q))))
        return let(line, lambda l: F.array(*[_count_equal(l, i) for i in range(lines)]))

    return let(F.array_sort(F.transform(points, lambda p: p["y"])), of)


def gap_counts(points: Column, lines: int) -> Column:
    """Players per line when the lines are split at the largest gaps of y."""

    def of(ys: Column) -> Column:
        gaps = F.transform(
            F.sequence(F.lit(1), F.size(ys) - 1),
            lambda i: F.struct((-(F.get(ys, i) - F.get(ys, i - 1))).alias("g"), i.alias("i")),
        )
        cut = F.array_sort(F.transform(F.slice(F.array_sort(gaps), 1, lines - 1), lambda s: s["i"]))
        bounds = F.concat(F.array(F.lit(0)), cut, F.array(F.size(ys)))
        return let(
            bounds, lambda b: F.transform(F.sequence(F.lit(1), F.lit(lines)), lambda i: F.get(b, i) - F.get(b, i - 1))
        )

    return let(F.array_sort(F.transform(points, lambda p: p["y"])), of)


def count_variance(counts: Column) -> Column:
    def of(mean: Column) -> Column:
        return F.aggregate(counts, F.lit(0.0), lambda a, c: a + F.pow(c - mean, 2)) / F.size(counts)

    return let(F.aggregate(counts, F.lit(0.0), lambda a, c: a + c) / F.size(counts), of)


def _option(k: int) -> Callable[[Column], Column]:
    return lambda c: F.struct(count_variance(c).alias("variance"), F.lit(k).alias("k"), c.alias("counts"))


def best_counts(points: Column, lines: str = "quantile") -> Column:
    """Counts over 3, 4 or 5 lines with the lowest variance, fewest lines on ties."""
    split = line_counts if lines == "quantile" else gap_counts
    options = F.array(
        *[
            let(
                split(points, k),
                _option(k),
            )
            for k in (3, 4, 5)
        ]
    )
    return F.array_min(options)["counts"]
