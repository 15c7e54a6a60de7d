"""Queries over player positions: shapes, pressure, blocks, templates and rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.catalog import views as v
from touchline.catalog.frames import r6
from touchline.catalog.views import with_views
from touchline.functions import coords, shapes
from touchline.operators import blocks, formations, metrics, rasters
from touchline.operators.sequences import number_rows
from touchline.session import stored
from touchline.sources import files, layouts

WIN, SHIFT, TINY = 10, 11.0, 3


def r4(c, name):
    return (F.round(c, 4) + F.lit(0.0)).alias(name)


def normalize_coords(spark, sf_dir):
    f = coords.normalize_players(v.player_frames(spark, sf_dir))
    return layouts.positions(f).select("frame", "side", "player", r6("x", "x"), r6("y", "y"), r6("ball_x", "ball_x"), r6("ball_y", "ball_y"))


NORMALIZE_SQL = with_views("fx_positions fx_ball", """
SELECT p.frame, side, player, round((x + 52.5) / 105, 6) AS x, round((y + 34) / 68, 6) AS y,
       round((ball_x + 52.5) / 105, 6) AS ball_x, round((ball_y + 34) / 68, 6) AS ball_y
FROM fx_positions p JOIN fx_ball b USING (frame)""")


def wide_to_long(spark, sf_dir):
    f = v.player_frames(spark, sf_dir)
    wide = f.select(
        "frame", "label",
        *[F.get("players", F.lit(11 * s + i - 1))[axis].alias(f"{side}_{i}_{axis}")
          for s, side in enumerate(("home", "away")) for i in range(1, 12) for axis in ("x", "y")],
    )
    return layouts.positions(layouts.from_wide(wide)).select("frame", "label", "side", F.col("player").cast("long"), r6("x", "x"), r6("y", "y"))


WIDE_SQL = with_views("fx_positions", "SELECT frame, label, side, player, round(x, 6) AS x, round(y, 6) AS y FROM fx_positions")


def centroid_center(spark, sf_dir):
    f = v.player_frames(spark, sf_dir).withColumn("players", shapes.centred(F.col("players")))
    return layouts.positions(f).select("frame", "side", "player", r6("x", "x"), r6("y", "y"))


CENTROID_SQL = with_views("fx_positions", """
SELECT frame, side, player, round(x - avg(x) OVER w, 6) + 0.0 AS x, round(y - avg(y) OVER w, 6) + 0.0 AS y
FROM fx_positions WINDOW w AS (PARTITION BY frame, side)""")


def _numbered(spark, sf_dir):
    """Player frames per side with their row number in the label, stored because several steps read them."""
    return stored(v.by_side(number_rows(v.player_frames(spark, sf_dir), ["label"], "frame")))


SIDE = ["label", "side"]


def rolling_mean(spark, sf_dir):
    out = blocks.rolling_means(v.side_points(_numbered(spark, sf_dir)), SIDE, WIN)
    return out.select("label", "side", "frame", "player", r6("mean_x", "mean_x"), r6("mean_y", "mean_y"))


_ROLLING = """
WITH r AS (SELECT *, avg(x) OVER w AS mean_x, avg(y) OVER w AS mean_y FROM fx_numbered
           WINDOW w AS (PARTITION BY label, side, player ORDER BY rn ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
m AS (SELECT *, sqrt(pow(mean_x - lag(mean_x, 10) OVER w, 2) + pow(mean_y - lag(mean_y, 10) OVER w, 2)) AS move
      FROM r WINDOW w AS (PARTITION BY label, side, player ORDER BY rn)),
n AS (SELECT label, side, max(rn) AS n_rows FROM fx_numbered GROUP BY label, side),
c AS (SELECT m.label, m.side, rn - 11 AS cut, max(move) AS shift FROM m JOIN n USING (label, side) WHERE n_rows >= 20 AND rn > 10
      GROUP BY m.label, m.side, rn HAVING max(move) > 11)
"""
ROLLING_SQL = with_views("fx_numbered", _ROLLING + "SELECT label, side, frame, player, round(mean_x, 6) + 0.0 AS mean_x, round(mean_y, 6) + 0.0 AS mean_y FROM r")


def shift_cuts(spark, sf_dir):
    out = blocks.shift_cuts(v.side_points(_numbered(spark, sf_dir)), SIDE, WIN, SHIFT)
    return out.select("label", "side", "cut", r6("shift", "shift"))


SHIFT_SQL = with_views("fx_numbered", _ROLLING + "SELECT label, side, cut, round(shift, 6) AS shift FROM c")


def _blocks(numbered):
    lengths = numbered.groupBy(*SIDE).agg(F.max("rn").alias("n_rows"))
    cuts = stored(blocks.shift_cuts(v.side_points(numbered), SIDE, WIN, SHIFT))
    return blocks.blocks_from_cuts(cuts, lengths, SIDE, TINY)


def stable_blocks(spark, sf_dir):
    return _blocks(_numbered(spark, sf_dir))


_BLOCKS = _ROLLING + """,
z AS (SELECT label, side, 0 AS cut FROM n UNION SELECT label, side, cut FROM c),
i AS (SELECT label, side, cut, coalesce(lead(cut) OVER (PARTITION BY label, side ORDER BY cut), n_rows) - cut AS len, n_rows FROM z JOIN n USING (label, side)),
s AS (SELECT * FROM i WHERE cut = 0 OR len >= 3),
b AS (SELECT label, side, CAST(cut AS BIGINT) AS start_row, CAST(coalesce(lead(cut) OVER (PARTITION BY label, side ORDER BY cut), n_rows) - 1 AS BIGINT) AS end_row FROM s)
"""
BLOCKS_OF_CUTS_SQL = with_views("fx_numbered", _BLOCKS + "SELECT * FROM b")


def block_meta(spark, sf_dir):
    f = _numbered(spark, sf_dir)
    placed = blocks.assign_blocks(f, stored(_blocks(f)), SIDE)
    there = F.size(shapes.on_side(F.col("players"), F.col("side"))) > 0
    out = blocks.block_meta(placed, [*SIDE, "start_row"], has_player=there, min_seconds=0.2)
    return out.withColumn("block_id", blocks.block_id("label", "block_start_frame")).withColumn("agg_seconds", r6("agg_seconds"))


BLOCK_META_SQL = with_views("fx_numbered", _BLOCKS + """,
f AS (SELECT DISTINCT b.label, b.side, start_row, frame FROM b JOIN fx_numbered p ON p.label = b.label AND p.side = b.side AND rn - 1 BETWEEN start_row AND end_row)
SELECT label, side, start_row, min(frame) AS block_start_frame, max(frame) AS block_end_frame, count(*) AS num_frames,
       round(count(*) / 25.0, 6) AS agg_seconds, label * 10000000 + min(frame) AS block_id
FROM f GROUP BY label, side, start_row HAVING count(*) / 25.0 >= 0.2""")


def role_templates(spark, sf_dir):
    f = _numbered(spark, sf_dir)
    placed = blocks.assign_blocks(f, stored(_blocks(f)), SIDE)
    placed = placed.withColumn("players", shapes.centred(F.col("players"))).select("label", "start_row", "players")
    out = blocks.role_templates(layouts.positions(placed), [*SIDE, "start_row"])
    return out.select("label", "side", "start_row", "player", "n_points", *[r6(c, c) for c in ("mu_x", "mu_y", "cov_xx", "cov_xy", "cov_yy")])


ROLE_TEMPLATES_SQL = with_views("fx_numbered", _BLOCKS + """,
g AS (SELECT *, x - avg(x) OVER w AS cx, y - avg(y) OVER w AS cy FROM fx_numbered WINDOW w AS (PARTITION BY frame, side)),
t AS (SELECT b.label, b.side, start_row, player, count(cx) AS n_points, avg(cx) AS mx, avg(cy) AS my, var_samp(cx) AS xx, covar_samp(cx, cy) AS xy, var_samp(cy) AS yy
      FROM b JOIN g ON g.label = b.label AND g.side = b.side AND rn - 1 BETWEEN start_row AND end_row GROUP BY ALL)
SELECT label, side, start_row, player, n_points, round(coalesce(mx, 0), 6) + 0.0 AS mu_x, round(coalesce(my, 0), 6) + 0.0 AS mu_y,
       round(CASE WHEN n_points > 1 THEN xx ELSE 0.000001 END, 6) AS cov_xx, round(CASE WHEN n_points > 1 THEN xy ELSE 0 END, 6) + 0.0 AS cov_xy,
       round(CASE WHEN n_points > 1 THEN yy ELSE 0.000001 END, 6) AS cov_yy
FROM t""")


def nn3(spark, sf_dir):
    p = v.role_points(spark, sf_dir).withColumn("near", shapes.third_neighbour(F.col("pts")))
    near = F.col("near")
    return p.select("frame", "side", r6(F.array_min(near), "third_distance"), F.array_position(near, F.array_min(near)).alias("start_player"))


NN3_SQL = with_views("fx_roles", """
WITH d AS (SELECT a.frame, a.side, a.i, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS dist
           FROM fx_roles a JOIN fx_roles b ON a.frame = b.frame AND a.side = b.side AND a.i <> b.i),
r AS (SELECT *, row_number() OVER (PARTITION BY frame, side, i ORDER BY dist) AS nth FROM d)
SELECT frame, side, round(dist, 6) AS third_distance, i AS start_player
FROM (SELECT *, row_number() OVER (PARTITION BY frame, side ORDER BY dist, i) AS pick FROM r WHERE nth = 3) WHERE pick = 1""")


def shaw_order(spark, sf_dir):
    p = v.role_points(spark, sf_dir, 11)
    order = F.transform(shapes.chain_order(F.col("pts")), lambda i: (i + 1).cast("string"))
    return p.select("frame", "side", F.array_join(order, "-").alias("role_order"))


SHAW_SQL = with_views("fx_roles", """
WITH p AS (SELECT * FROM fx_roles WHERE i <= 11),
d AS (SELECT a.frame, a.side, a.i, b.i AS j, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS dist
      FROM p a JOIN p b ON a.frame = b.frame AND a.side = b.side AND a.i <> b.i),
r AS (SELECT *, row_number() OVER (PARTITION BY frame, side, i ORDER BY dist) AS nth FROM d),
s AS (SELECT frame, side, i FROM (SELECT *, row_number() OVER (PARTITION BY frame, side ORDER BY dist, i) AS pick FROM r WHERE nth = 3) WHERE pick = 1),
w AS (SELECT frame, side, [i] AS ord FROM s
      UNION ALL
      SELECT frame, side, list_append(ord, j) FROM (
        SELECT w.frame, w.side, w.ord, d.j, row_number() OVER (PARTITION BY w.frame, w.side ORDER BY d.dist, d.j) AS nth
        FROM w JOIN d ON d.frame = w.frame AND d.side = w.side AND d.i = w.ord[-1] WHERE NOT list_contains(w.ord, d.j)) WHERE nth = 1)
SELECT w.frame, w.side, array_to_string(CASE WHEN z.x < a.x THEN list_reverse(ord) ELSE ord END, '-') AS role_order
FROM w JOIN p a ON a.frame = w.frame AND a.side = w.side AND a.i = ord[1] JOIN p z ON z.frame = w.frame AND z.side = w.side AND z.i = ord[-1]
WHERE len(ord) = 11""").replace("WITH fx_roles AS", "WITH RECURSIVE fx_roles AS", 1)


def canonical10(spark, sf_dir):
    p = v.role_points(spark, sf_dir, 13)
    ten = shapes.canonical_outfield(F.col("pts"))
    return p.select("frame", "side", F.posexplode(ten).alias("role", "p")).select(
        "frame", "side", (F.col("role") + 1).alias("role"), r6("p.x", "x"), r6("p.y", "y")
    )


def _squash_sql(source: str, target: str) -> str:
    return f"""
{target}d AS (SELECT *, list_transform(range(1, len(pts)), lambda k: sqrt(pow(pts[k + 1].x - pts[k].x, 2) + pow(pts[k + 1].y - pts[k].y, 2))) AS gap FROM {source}),
{target}j AS (SELECT *, list_position(gap, list_min(gap)) AS j FROM {target}d),
{target} AS (SELECT frame, side, list_concat(list_concat(pts[1:j - 1], [{{'x': (pts[j].x + pts[j + 1].x) / 2, 'y': (pts[j].y + pts[j + 1].y) / 2}}]), pts[j + 2:]) AS pts FROM {target}j)"""


CANONICAL_SQL = with_views("fx_roles", """
WITH o AS (SELECT *, row_number() OVER (PARTITION BY frame, side ORDER BY y, i) AS depth FROM fx_roles WHERE i <= 13),
q0 AS (SELECT frame, side, list({'x': x, 'y': y} ORDER BY i) AS pts FROM o WHERE depth > 1 GROUP BY frame, side),"""
    + _squash_sql("q0", "q1") + "," + _squash_sql("q1", "q2") + """
SELECT frame, side, CAST(role AS INTEGER) AS role, round(pts[role].x, 6) + 0.0 AS x, round(pts[role].y, 6) + 0.0 AS y
FROM q2, (SELECT unnest(range(1, 11)) AS role) r""")


def _cov(name: str):
    return {"xx": F.abs(F.col("label") - 3) + 1.5, "xy": (F.col("frame") % 5) / 10.0, "yy": F.col("label") / 4.0 + 0.7}[name]


def w2_pairs(spark, sf_dir):
    p = v.role_points(spark, sf_dir, 10)
    a, b = F.get("pts", F.col("i") - 1), F.get("pts", 10 - F.col("i"))
    cost = shapes.bures(a["x"], a["y"], b["x"], b["y"], _cov("xx"), _cov("xy"), _cov("yy"))
    return p.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(10)))).select("frame", "side", "i", r4(cost, "w2"))


W2_SQL = with_views("fx_roles", """
WITH c AS (SELECT frame, side, CAST(i AS INTEGER) AS i, x, y, abs(label - 3) + 1.5 AS xx, CAST(frame % 5 AS DOUBLE) / 10 AS xy, CAST(label AS DOUBLE) / 4 + 0.7 AS yy
           FROM fx_roles WHERE i <= 10),
e AS (SELECT *, (xx + yy) / 4 + sqrt(pow((xx - yy) / 4, 2) + pow(xy / 2, 2)) AS l1, (xx + yy) / 4 - sqrt(pow((xx - yy) / 4, 2) + pow(xy / 2, 2)) AS l2 FROM c)
SELECT a.frame, a.side, a.i, round(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + 1 + a.xx + a.yy - 2 * (sqrt(greatest(a.l1, 0)) + sqrt(greatest(a.l2, 0))), 4) + 0.0 AS w2
FROM e a JOIN e b ON a.frame = b.frame AND a.side = b.side AND b.i = 11 - a.i""")


def line_counts(spark, sf_dir):
    p = v.role_points(spark, sf_dir, 10)
    text = lambda c: F.array_join(F.transform(c, lambda n: n.cast("string")), "-")
    pts = F.col("pts")
    return p.select(
        "frame", "side", *[text(shapes.line_counts(pts, k)).alias(f"lines_{k}") for k in (3, 4, 5)], text(shapes.best_counts(pts)).alias("best")
    )


_LINES = """
WITH t AS (SELECT * FROM fx_roles WHERE i <= 10),
q AS (SELECT frame, side, """ + ", ".join(
    f"quantile_cont(y, {j} / {k}.0) AS q{k}_{j}" for k in (3, 4, 5) for j in range(1, k)
) + """ FROM t GROUP BY frame, side),
l AS (SELECT t.frame, t.side, """ + ", ".join(
    f"concat_ws('-', " + ", ".join(
        "sum(CAST(" + " + ".join(f"CAST(y > q{k}_{j} AS INT)" for j in range(1, k)) + f" = {b} AS INT))" for b in range(k)
    ) + f") AS lines_{k}" for k in (3, 4, 5)
) + """ FROM t JOIN q USING (frame, side) GROUP BY t.frame, t.side),
u AS (SELECT *, list_aggregate(CAST(string_split(lines_3, '-') AS INT[]), 'var_pop') AS v3, list_aggregate(CAST(string_split(lines_4, '-') AS INT[]), 'var_pop') AS v4,
             list_aggregate(CAST(string_split(lines_5, '-') AS INT[]), 'var_pop') AS v5 FROM l)
"""
LINE_COUNTS_SQL = with_views("fx_roles", _LINES + """
SELECT frame, side, lines_3, lines_4, lines_5, CASE WHEN v3 <= v4 AND v3 <= v5 THEN lines_3 WHEN v4 <= v5 THEN lines_4 ELSE lines_5 END AS best FROM u""")


def project_formation(spark, sf_dir):
    p = v.role_points(spark, sf_dir, 10)
    phase = F.get(F.array(*[F.lit(x) for x in ("build-up", "mid-block", "high-block", "low-block", "attacking-play", "other")]), (F.col("frame") % 6).cast("int"))
    p = p.withColumn("phase", phase).withColumn("counts", shapes.gap_counts(F.col("pts"), 4))
    return formations.project_to_allowed(p, "counts", "phase").select("frame", "side", "phase", F.array_join(F.transform("counts", lambda n: n.cast("string")), "-").alias("raw"), "formation")


# Written out, so that a slip in the library's lists shows.
_ALLOWED = ", ".join(
    f"('{phase}', {i}, '{form}')"
    for phase, forms in (
        ("build-up", "2-4-3-1 2-4-4 2-1-4-3 3-4-3 3-1-4-2 3-5-2 3-4-2-1 4-3-3 4-2-3-1 4-4-2"),
        ("mid-block", "4-2-3-1 4-4-2 4-1-4-1 4-3-2-1 5-3-2 5-2-3"),
        ("high-block", "4-4-2 4-2-3-1 4-3-3"),
        ("low-block", "5-4-1 5-3-2 4-5-1 4-4-2"),
        ("attacking-play", "2-4-4 2-3-2-3 3-4-3 3-2-4-1 4-2-3-1 4-3-3"),
    )
    for i, form in enumerate(forms.split())
)
PROJECT_SQL = with_views("fx_roles", """
WITH t AS (SELECT *, y - lag(y) OVER (PARTITION BY frame, side ORDER BY y) AS gap, row_number() OVER (PARTITION BY frame, side ORDER BY y) AS pos FROM fx_roles WHERE i <= 10),
g AS (SELECT *, row_number() OVER (PARTITION BY frame, side ORDER BY gap DESC NULLS LAST, pos) <= 3 AND gap IS NOT NULL AS cut FROM t),
n AS (SELECT *, sum(CAST(cut AS INT)) OVER (PARTITION BY frame, side ORDER BY pos) AS line FROM g),
c AS (SELECT frame, side, line, count(*) AS n FROM n GROUP BY ALL),
r AS (SELECT frame, side, list(n ORDER BY line) AS counts, CASE frame % 6 WHEN 0 THEN 'build-up' WHEN 1 THEN 'mid-block' WHEN 2 THEN 'high-block'
        WHEN 3 THEN 'low-block' WHEN 4 THEN 'attacking-play' ELSE 'other' END AS phase FROM c GROUP BY frame, side),
a(phase, pos, form) AS (VALUES """ + _ALLOWED + """),
d AS (SELECT r.frame, r.side, r.phase, counts, form, pos, CAST(string_split(form, '-') AS INT[]) AS f FROM r LEFT JOIN a ON r.phase = a.phase),
s AS (SELECT *, 2 * abs(len(counts) - len(f)) + list_sum(list_transform(range(1, least(len(counts), len(f)) + 1), lambda k: abs(counts[k] - f[k]))) AS dist FROM d)
SELECT frame, side, phase, array_to_string(counts, '-') AS raw, coalesce(form, array_to_string(counts, '-')) AS formation
FROM (SELECT *, row_number() OVER (PARTITION BY frame, side ORDER BY dist, pos) AS nth FROM s) WHERE nth = 1""")


def spacing(spark, sf_dir):
    f = v.player_frames(spark, sf_dir).select("frame", F.explode(F.array(F.lit("home"), F.lit("away"))).alias("side"), "players")
    s = f.select("frame", "side", shapes.spacing(F.col("players"), F.col("side")).alias("s"))
    return s.select("frame", "side", r6("s.width", "width"), r6("s.depth", "depth"), r6("s.stretch", "stretch"))


_SPACING = """
q AS (SELECT frame, side, quantile_cont(y, 0.9) - quantile_cont(y, 0.1) AS width, quantile_cont(x, 0.9) - quantile_cont(x, 0.1) AS depth
      FROM fx_positions WHERE x IS NOT NULL GROUP BY frame, side HAVING count(*) >= 3),
h AS (SELECT a.frame, a.side, avg(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS stretch
      FROM fx_positions a JOIN fx_positions b ON a.frame = b.frame AND a.side = b.side AND a.player < b.player AND a.x IS NOT NULL AND b.x IS NOT NULL GROUP BY ALL)
"""
SPACING_SQL = with_views("fx_positions", "WITH " + _SPACING + """
SELECT frame, side, round(width, 6) AS width, round(depth, 6) AS depth, round(stretch, 6) AS stretch FROM q JOIN h USING (frame, side)""")


def ball_carrier(spark, sf_dir):
    f = v.player_frames(spark, sf_dir).select("*", F.explode(F.array(F.lit("home"), F.lit("away"))).alias("side"))
    c = f.select("frame", "side", shapes.carrier(F.col("players"), F.col("side"), F.col("ball_x"), F.col("ball_y")).alias("c"))
    return c.select("frame", "side", F.col("c.player").alias("player"), r6("c.distance", "distance"))


_CARRIER = """
k AS (SELECT p.frame, p.side, p.player, x AS cx, y AS cy, sqrt(pow(x - ball_x, 2) + pow(y - ball_y, 2)) AS distance,
        row_number() OVER (PARTITION BY p.frame, p.side ORDER BY sqrt(pow(x - ball_x, 2) + pow(y - ball_y, 2)), player) AS nth
      FROM fx_positions p JOIN fx_ball b USING (frame) WHERE x IS NOT NULL),
"""
CARRIER_SQL = with_views("fx_positions fx_ball", "WITH " + _CARRIER.rstrip().rstrip(",") + "\nSELECT frame, side, player, round(distance, 6) AS distance FROM k WHERE nth = 1")


def pressure(spark, sf_dir):
    f = metrics.player_facts(v.held_frames(spark, sf_dir), F.col("ball_x"), F.col("ball_y"))
    return f.where("poss <> ''").select("frame", "poss", r6("pressure", "pressure"))


_PRESSURE = _CARRIER + """
v AS (SELECT h.frame, h.label, h.poss, h.is_pass, cx, cy, (CASE WHEN h.poss = 'home' THEN 52.5 ELSE -52.5 END) - cx AS gx, -cy AS gy
      FROM fx_held h JOIN k ON k.frame = h.frame AND k.side = h.poss AND nth = 1),
u AS (SELECT v.*, sqrt(gx * gx + gy * gy) AS gd, d.x - cx AS dx, d.y - cy AS dy, sqrt(pow(d.x - cx, 2) + pow(d.y - cy, 2)) AS dd
      FROM v LEFT JOIN fx_positions d ON d.frame = v.frame AND d.side <> v.poss AND d.x IS NOT NULL),
z AS (SELECT *, 9 - 0.05 * (105 - gd) AS front, (1 + greatest(-1, least(1, (gx * dx + gy * dy) / ((gd + 1e-9) * (dd + 1e-9))))) / 2 AS z FROM u),
l AS (SELECT *, 3 + (front - 3) * ((z * z * z + 0.3 * z) / 1.3) AS reach FROM z),
p AS (SELECT frame, label, poss, is_pass, sum(CASE WHEN dd <= greatest(front, 3) THEN pow(greatest(1 - dd / greatest(reach, 1e-4), 0), 1.75) * 100 ELSE 0 END) AS pressure
      FROM l GROUP BY ALL)
"""
PRESSURE_SQL = with_views("fx_positions fx_held", "WITH " + _PRESSURE + "SELECT frame, poss, round(pressure, 6) AS pressure FROM p")


def pressure_ppda(spark, sf_dir):
    f = metrics.player_facts(v.held_frames(spark, sf_dir), F.col("ball_x"), F.col("ball_y"))
    aggs = {}
    for s in metrics.SIDES:
        aggs |= metrics.pressure_metrics(s, 5.0) | metrics.spacing_means(s)
    return f.groupBy("label").agg(*[r6(c, n) for n, c in aggs.items()])


PRESSURE_PPDA_SQL = with_views("fx_positions fx_held", "WITH " + _PRESSURE + "," + _SPACING + """,
w AS (SELECT f.label, """ + ", ".join(f"round(avg(CASE WHEN q.side = '{s}' THEN {m} END), 6) AS {s}_{m}" for s in ("home", "away") for m in ("width", "depth", "stretch")) + """
      FROM q JOIN h USING (frame, side) JOIN fx_held f USING (frame) GROUP BY f.label)
SELECT p.label, """ + ", ".join(
    f"""round(CAST(sum(CAST(is_pass AND poss = '{o}' AS INT)) AS DOUBLE) / greatest(1, sum(CAST(poss = '{o}' AND pressure >= 5 AS INT))), 6) AS {s}_ppda_press,
    round(CAST(sum(CAST(poss = '{o}' AND pressure >= 5 AS INT)) AS DOUBLE) / greatest(1, sum(CAST(poss = '{o}' AS INT))), 6) AS {s}_press_rate,
    round(avg(CASE WHEN poss = '{o}' THEN pressure END), 6) AS {s}_avg_press""" for s, o in (("home", "away"), ("away", "home"))
) + ", " + ", ".join(f"any_value(w.{s}_{m}) AS {s}_{m}" for s in ("home", "away") for m in ("width", "depth", "stretch")) + """
FROM p JOIN w USING (label) GROUP BY p.label""")


def pixel_coords(spark, sf_dir):
    f = coords.normalize_players(v.player_frames(spark, sf_dir))
    return layouts.positions(f).where("x IS NOT NULL").select("frame", "side", "player", coords.pixel("x", 105).alias("px"), coords.pixel("y", 68).alias("py"))


PIXEL_SQL = with_views("fx_positions", """
SELECT frame, side, player, CAST(greatest(0, least(104, round_even((x + 52.5) / 105 * 105, 0))) AS INTEGER) AS px,
       CAST(greatest(0, least(67, round_even((y + 34) / 68 * 68, 0))) AS INTEGER) AS py
FROM fx_positions WHERE x IS NOT NULL""")


def raster_cells(spark, sf_dir):
    f = number_rows(coords.normalize_players(v.player_frames(spark, sf_dir)), ["label"], "frame")
    out = rasters.window_rasters(f.withColumn("centre", F.col("ball_x") > 0.5), ["label"], centre="centre")
    return rasters.cell_rows(out, ["label", "frame"]).groupBy("label", "frame", "channel").agg(
        F.count(F.lit(1)).alias("n_cells"), F.sum(F.col("px") * 1000 + F.col("py")).alias("cell_sum")
    )


RASTER_SQL = with_views("fx_positions fx_ball", """
WITH o AS (SELECT frame, label, side AS channel, x, y FROM fx_positions WHERE x IS NOT NULL UNION ALL SELECT frame, label, 'ball', ball_x, ball_y FROM fx_ball),
c AS (SELECT frame, label, channel, greatest(0, least(104, round_even((x + 52.5) / 105 * 105, 0))) AS px,
             greatest(0, least(67, round_even((y + 34) / 68 * 68, 0))) AS py FROM o),
n AS (SELECT frame, label, row_number() OVER (PARTITION BY label ORDER BY frame) AS rn FROM fx_ball),
b AS (SELECT frame FROM fx_ball WHERE (ball_x + 52.5) / 105 > 0.5),
w AS (SELECT DISTINCT m.label, m.frame, channel, px, py FROM n m JOIN n k ON m.label = k.label AND k.rn BETWEEN m.rn - 6 AND m.rn + 6 JOIN c ON c.frame = k.frame
      WHERE m.frame IN (SELECT frame FROM b))
SELECT label, frame, channel, count(*) AS n_cells, CAST(sum(px * 1000 + py) AS BIGINT) AS cell_sum FROM w GROUP BY ALL""")


def softmax_argmax(spark, sf_dir):
    e = v.table(spark, sf_dir, "embeddings")
    logits = F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double") * 8)
    e = e.withColumn("p", rasters.softmax(logits)).withColumn("d", rasters.decode(F.col("p"), ["build-up", "mid-block", "high-block", "low-block"]))
    return e.select(F.col("vec_id").alias("frame"), F.col("d.label").alias("label"), r6("d.confidence", "confidence"), r6(F.get("p", F.lit(0)), "p_first"))


SOFTMAX_SQL = """
WITH l AS (SELECT vec_id AS frame, list_transform(embedding[1:4], lambda x: exp(CAST(x AS DOUBLE) * 8 - CAST(list_max(embedding[1:4]) AS DOUBLE) * 8)) AS e FROM embeddings),
p AS (SELECT frame, e, list_sum(e) AS s FROM l)
SELECT frame, ['build-up', 'mid-block', 'high-block', 'low-block'][list_position(e, list_max(e))] AS label, round(list_max(e) / s, 6) AS confidence,
       round(e[1] / s, 6) AS p_first
FROM p"""


def parse_frame_key(spark, sf_dir):
    e = v.table(spark, sf_dir, "embeddings")
    name = F.concat(
        F.when(F.col("vec_id") % 4 == 0, "SPORTEC").when(F.col("vec_id") % 4 == 1, "metrica").when(F.col("vec_id") % 4 == 2, "sportec").otherwise("other"),
        F.lit("_"), (F.col("label") % 2 + 1).cast("string"), F.lit("_"), F.col("vec_id").cast("string"), F.lit(".npz"),
    )
    out = e.select(name.alias("name")).withColumn("k", files.frame_key("name")).where("k IS NOT NULL")
    return out.select("name", "k.provider", "k.period_id", "k.frame")


FRAME_KEY_SQL = """
WITH n AS (SELECT concat(CASE vec_id % 4 WHEN 0 THEN 'SPORTEC' WHEN 1 THEN 'metrica' WHEN 2 THEN 'sportec' ELSE 'other' END, '_', label % 2 + 1, '_', vec_id, '.npz') AS name,
                  vec_id, label FROM embeddings)
SELECT name, lower(split_part(name, '_', 1)) AS provider, CAST(split_part(name, '_', 2) AS BIGINT) AS period_id,
       CAST(replace(split_part(name, '_', 3), '.npz', '') AS BIGINT) AS frame
FROM n WHERE vec_id % 4 <> 3"""


QUERIES = {
    "normalize_coords": (normalize_coords, NORMALIZE_SQL),
    "wide_to_long": (wide_to_long, WIDE_SQL),
    "centroid_center": (centroid_center, CENTROID_SQL),
    "rolling_mean": (rolling_mean, ROLLING_SQL),
    "shift_cuts": (shift_cuts, SHIFT_SQL),
    "blocks": (stable_blocks, BLOCKS_OF_CUTS_SQL),
    "block_meta": (block_meta, BLOCK_META_SQL),
    "role_templates": (role_templates, ROLE_TEMPLATES_SQL),
    "nn3": (nn3, NN3_SQL),
    "shaw_order": (shaw_order, SHAW_SQL),
    "canonical10": (canonical10, CANONICAL_SQL),
    "w2_pairs": (w2_pairs, W2_SQL),
    "line_counts": (line_counts, LINE_COUNTS_SQL),
    "project_formation": (project_formation, PROJECT_SQL),
    "spacing": (spacing, SPACING_SQL),
    "ball_carrier": (ball_carrier, CARRIER_SQL),
    "pressure": (pressure, PRESSURE_SQL),
    "pressure_ppda": (pressure_ppda, PRESSURE_PPDA_SQL),
    "pixel_coords": (pixel_coords, PIXEL_SQL),
    "raster_cells": (raster_cells, RASTER_SQL),
    "softmax_argmax": (softmax_argmax, SOFTMAX_SQL),
    "parse_frame_key": (parse_frame_key, FRAME_KEY_SQL),
}
