"""Queries over team panels, event text and scalar rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.catalog import views as v
from touchline.catalog.frames import r6
from touchline.catalog.views import SQL_VIEWS, with_views
from touchline.functions import coords, events
from touchline.operators import masks, panels
from touchline.session import stored
from touchline.sources import files, layouts

TEAM = ["team_id"]


def touches(spark, sf_dir):
    """Labelled ball events in [0, 1] coordinates with gaps, from ``lineitem``."""
    l = v.table(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber")
    q = F.col("l_quantity").cast("long") % 6
    return l.select(
        F.col("l_returnflag").alias("team_id"),
        F.when(n == 1, "ShotWide").when(n == 2, "SuccessfulShot").when(n == 3, "SavedShot").when(n == 4, "Pass").when(n == 5, "PassLong").otherwise("Tackle").alias("label"),
        F.when(q == 0, "1").when(q == 1, "0").when(q == 2, "True").when(q == 3, "no").when(q == 4, " goal ").alias("success"),
        (F.col("l_suppkey") % 11).alias("passer"),
        F.when(F.col("l_suppkey") % 13 != 0, F.col("l_quantity") / 50).alias("x"),
        (F.col("l_discount") * 10).alias("y"),
        F.when(F.col("l_partkey") % 7 != 0, F.col("l_extendedprice") / 105000).alias("x2"),
        (F.col("l_tax") * 12.5).alias("y2"),
    )


SQL_VIEWS["fx_touches"] = """
SELECT l_returnflag AS team_id, CASE l_linenumber WHEN 1 THEN 'ShotWide' WHEN 2 THEN 'SuccessfulShot' WHEN 3 THEN 'SavedShot' WHEN 4 THEN 'Pass'
         WHEN 5 THEN 'PassLong' ELSE 'Tackle' END AS label,
       CASE CAST(l_quantity AS BIGINT) % 6 WHEN 0 THEN '1' WHEN 1 THEN '0' WHEN 2 THEN 'True' WHEN 3 THEN 'no' WHEN 4 THEN ' goal ' END AS success,
       l_suppkey % 11 AS passer, CASE WHEN l_suppkey % 13 <> 0 THEN l_quantity / 50 END AS x, l_discount * 10 AS y,
       CASE WHEN l_partkey % 7 <> 0 THEN l_extendedprice / 105000 END AS x2, l_tax * CAST(12.5 AS DOUBLE) AS y2
FROM lineitem
"""


def fixtures_by_team(spark, sf_dir):
    """Rows naming the home and away team, some blank or missing, from ``orders`` and ``customer``."""
    o, c = v.table(spark, sf_dir, "orders"), v.table(spark, sf_dir, "customer")
    j = o.join(c, o.o_custkey == c.c_custkey)
    return j.select(
        F.col("c_nationkey").alias("team_id"),
        F.when(F.col("o_orderkey") % 7 == 0, " ").otherwise(F.col("c_mktsegment")).alias("home_team"),
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("away_team"),
    )


SQL_VIEWS["fx_teams"] = """
SELECT c_nationkey AS team_id, CASE WHEN o_orderkey % 7 = 0 THEN ' ' ELSE c_mktsegment END AS home_team,
       CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS away_team
FROM orders JOIN customer ON o_custkey = c_custkey
"""


def _scale_sql(rows: str, cols=("x", "y", "x2", "y2"), by: str = "team_id") -> str:
    size = {"x": 105, "y": 68, "x2": 105, "y2": 68}
    stats = ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in cols)
    dom = ", ".join(
        f"CASE WHEN lo_{c} >= -1.01 AND hi_{c} <= 1.01 THEN ({{v}} + 1) / 2 * {size[c]} ELSE {{v}} END".replace("{v}", f"{pre}{c}") + f" AS {out}{c}"
        for c in cols
        for pre, out in (("", "d_"), ("lo_", "a_"), ("hi_", "b_"))
    )
    fin = ", ".join(
        f"greatest(0, least({size[c]}, CASE WHEN b_{c} > a_{c} THEN (d_{c} - a_{c}) * (({size[c]} - 2 * 0.075::DOUBLE * {size[c]}) / (b_{c} - a_{c})) + 0.075::DOUBLE * {size[c]} ELSE d_{c} END)) AS s_{c}"
        for c in cols
    )
    nulls = ", ".join(f"CASE WHEN d_{c} IS NOT NULL THEN s_{c} END AS {c}" for c in cols)
    drop = ", ".join([*cols, *[f"{p}{c}" for c in cols for p in ("lo_", "hi_", "d_", "a_", "b_")]])
    return f"""
sc_stats AS (SELECT {by}, {stats} FROM {rows} GROUP BY {by}),
sc_dom AS (SELECT r.*, {dom}, {", ".join(f"lo_{c}, hi_{c}" for c in cols)} FROM {rows} r JOIN sc_stats USING ({by})),
sc_fin AS (SELECT *, {fin} FROM sc_dom),
scaled AS (SELECT * EXCLUDE ({drop}, {", ".join(f"s_{c}" for c in cols)}), {nulls} FROM sc_fin WHERE d_x IS NOT NULL AND d_y IS NOT NULL)"""


PASS_ROWS = """
WITH rp AS (SELECT team_id, label, coalesce(lower(success) IN ('true', 't', '1', 'yes', 'y', 'successful'), false) AS success, passer, x, y, x2, y2
            FROM fx_touches WHERE lower(label) LIKE '%pass%'),"""
SHOT_ROWS = """
WITH rs0 AS (SELECT team_id, label, success, CASE WHEN x IS NULL OR y IS NULL THEN x2 ELSE x END AS x, CASE WHEN x IS NULL OR y IS NULL THEN y2 ELSE y END AS y, x2, y2,
       coalesce(TRY_CAST(success AS DOUBLE) > 0, false) OR coalesce(lower(trim(success)) IN ('true', 't', 'y', 'yes', '1', 'success', 'successful', 'goal'), false)
         OR lower(label) LIKE '%goal%' AS is_goal
     FROM fx_touches WHERE lower(label) IN ('shotwide', 'successfulshot', 'savedshot', 'blockedshot', 'shotwoodwork')),
rs AS (SELECT * FROM rs0 WHERE x IS NOT NULL AND y IS NOT NULL),"""
XY = ["x", "y", "x2", "y2"]


def auto_scale(spark, sf_dir):
    t = touches(spark, sf_dir)
    out = coords.auto_scale(t, TEAM, panels.EXTENTS)
    return out.select("team_id", "label", "passer", *[r6(c, c) for c in XY])


AUTO_SCALE_SQL = with_views("fx_touches", "WITH " + _scale_sql("fx_touches") + "\nSELECT team_id, label, passer, " + ", ".join(f"round({c}, 6) AS {c}" for c in XY) + " FROM scaled")


def team_passes(spark, sf_dir):
    return panels.team_passes(touches(spark, sf_dir), TEAM).select("team_id", "label", "success", "passer", *[r6(c, c) for c in XY])


TEAM_PASSES_SQL = with_views("fx_touches", PASS_ROWS + _scale_sql("rp") + "\nSELECT team_id, label, success, passer, " + ", ".join(f"round({c}, 6) AS {c}" for c in XY) + " FROM scaled")


def team_shots(spark, sf_dir):
    return panels.team_shots(touches(spark, sf_dir), TEAM).select("team_id", "label", "is_goal", *[r6(c, c) for c in XY])


TEAM_SHOTS_SQL = with_views("fx_touches", SHOT_ROWS + _scale_sql("rs") + "\nSELECT team_id, label, is_goal, " + ", ".join(f"round({c}, 6) AS {c}" for c in XY) + " FROM scaled")


def shot_table(spark, sf_dir):
    s = panels.shot_table(panels.team_shots(touches(spark, sf_dir), TEAM))
    return s.select("team_id", "is_goal", r6("x", "x"), r6("y", "y"), r6("end_x", "end_x"), r6("end_y", "end_y"))


SHOT_TABLE_SQL = with_views("fx_touches", SHOT_ROWS + _scale_sql("rs") + """
SELECT team_id, is_goal, round(x, 6) AS x, round(y, 6) AS y,
       round(CASE WHEN is_goal THEN 104.0 ELSE coalesce(x2, least(105, x + 6)) END, 6) AS end_x,
       round(CASE WHEN is_goal THEN greatest(30.34, least(37.66, y)) ELSE coalesce(y2, y) END, 6) AS end_y FROM scaled""")


def shot_counts(spark, sf_dir):
    return panels.shot_counts(panels.team_shots(touches(spark, sf_dir), TEAM), TEAM)


SHOT_COUNTS_SQL = with_views("fx_touches", SHOT_ROWS + _scale_sql("rs") + """
SELECT team_id, CAST(sum(CAST(is_goal AS INT)) AS BIGINT) AS goals, count(*) - CAST(sum(CAST(is_goal AS INT)) AS BIGINT) AS others FROM scaled GROUP BY team_id""")


def pass_success_flag(spark, sf_dir):
    t = touches(spark, sf_dir)
    ends = t.drop("success")
    return t.select("team_id", events.success_flag(t).alias("by_token"), events.success_flag(ends).alias("by_end")).groupBy("team_id", "by_token", "by_end").agg(F.count(F.lit(1)).alias("n"))


SUCCESS_SQL = with_views("fx_touches", """
SELECT team_id, coalesce(lower(success) IN ('true', 't', '1', 'yes', 'y', 'successful'), false) AS by_token, x2 IS NOT NULL AND y2 IS NOT NULL AS by_end, count(*) AS n
FROM fx_touches GROUP BY ALL""")


def goal_flag(spark, sf_dir):
    t = touches(spark, sf_dir)
    return t.select("team_id", "label", events.goal_flag("success", "label").alias("is_goal")).groupBy("team_id", "label", "is_goal").agg(F.count(F.lit(1)).alias("n"))


GOAL_SQL = with_views("fx_touches", """
SELECT team_id, label, coalesce(TRY_CAST(success AS DOUBLE) > 0, false) OR coalesce(lower(trim(success)) IN ('true', 't', 'y', 'yes', '1', 'success', 'successful', 'goal'), false)
         OR lower(label) LIKE '%goal%' AS is_goal, count(*) AS n
FROM fx_touches GROUP BY ALL""")


def pass_map_counts(spark, sf_dir):
    return panels.pass_map_counts(v.passes(spark, sf_dir), TEAM)


PASS_MAP_SQL = with_views("fx_passes", """
SELECT team_id, CASE WHEN x <= 52.5 THEN 'def' ELSE 'att' END AS half, CAST(sum(CAST(success AS INT)) AS BIGINT) AS n_ok,
       CAST(sum(CAST(NOT success AS INT)) AS BIGINT) AS n_fail, count(*) AS n_total
FROM fx_passes GROUP BY ALL""")


def heatmap(spark, sf_dir):
    return panels.density(v.passes(spark, sf_dir), TEAM)


HEATMAP_SQL = with_views("fx_passes", """
SELECT team_id, CAST(least(floor(round(x / 105 * 30, 9)), 29) AS INTEGER) AS bin_x, CAST(least(floor(round(y / 68 * 20, 9)), 19) AS INTEGER) AS bin_y, count(*) AS n
FROM fx_passes WHERE x BETWEEN 0 AND 105 AND y BETWEEN 0 AND 68 GROUP BY ALL""")


def press_heatmap(spark, sf_dir):
    rows = stored(v.alive(spark, sf_dir))
    point = lambda s: masks.recovery_points(rows, s).select("match_id", F.lit(s).alias("side"), F.col("ball_x").alias("x"), F.col("ball_y").alias("y"))
    scaled = coords.auto_scale(stored(point("home").unionByName(point("away"))), ["match_id", "side"], {"x": 105.0, "y": 68.0})
    return panels.density(scaled, ["match_id", "side"])


PRESS_SQL = with_views("fx_alive", """
WITH c AS (SELECT match_id, ball_x AS x, ball_y AS y, team_possession, lag(team_possession) OVER (PARTITION BY match_id, period_id ORDER BY rn) AS prev FROM fx_alive),
fp AS (SELECT match_id, team_possession AS side, x, y FROM c WHERE team_possession <> prev AND x IS NOT NULL AND y IS NOT NULL),""" + _scale_sql("fp", ("x", "y"), "match_id, side") + """
SELECT match_id, side, CAST(least(floor(round(x / 105 * 30, 9)), 29) AS INTEGER) AS bin_x, CAST(least(floor(round(y / 68 * 20, 9)), 19) AS INTEGER) AS bin_y, count(*) AS n
FROM scaled WHERE x BETWEEN 0 AND 105 AND y BETWEEN 0 AND 68 GROUP BY ALL""")


def player_spread(spark, sf_dir):
    out = panels.player_spread(v.passes(spark, sf_dir), TEAM)
    return out.select("team_id", "passer", "n", r6("mx", "mx"), r6("my", "my"), r6("r", "r"))


SPREAD_SQL = with_views("fx_passes", """
SELECT team_id, passer, count(*) AS n, round(avg(x), 6) AS mx, round(avg(y), 6) AS my,
       round(greatest(1.5, least(12, coalesce((stddev_samp(x) + stddev_samp(y)) / 2, 2.5))), 6) AS r
FROM fx_passes GROUP BY team_id, passer""")


def player_blobs(spark, sf_dir):
    out = panels.player_blobs(v.passes(spark, sf_dir), TEAM)
    return out.select("team_id", "passer", "n", *[r6(c, c) for c in ("mx", "my", "sx", "sy", "rx", "ry")])


BLOBS_SQL = with_views("fx_passes", """
WITH g AS (SELECT team_id, passer, count(*) AS n, avg(x) AS mx, avg(y) AS my, greatest(1.5, least(10, coalesce(stddev_samp(x), 2))) AS sx,
                  greatest(1.5, least(10, coalesce(stddev_samp(y), 2))) AS sy FROM fx_passes GROUP BY team_id, passer)
SELECT team_id, passer, n, round(mx, 6) AS mx, round(my, 6) AS my, round(sx, 6) AS sx, round(sy, 6) AS sy, round(sx * 1.8, 6) AS rx, round(sy * 1.8, 6) AS ry FROM g""")


_NODES = """
WITH k AS (SELECT * FROM fx_passes WHERE receiver IS NOT NULL),
s AS (SELECT team_id, passer AS player, avg(x) AS sx, avg(y) AS sy FROM k GROUP BY ALL),
t AS (SELECT team_id, receiver AS player, avg(x2) AS tx, avg(y2) AS ty, count(*) AS n FROM k GROUP BY ALL),
l AS (SELECT team_id, quantile_cont(n, 0.1) AS lo, quantile_cont(n, 0.9) AS hi FROM t GROUP BY team_id),
nd AS (SELECT team_id, player, coalesce(sx, tx) AS nx, coalesce(sy, ty) AS ny, coalesce(n, 0) AS received,
              20 + greatest(0, least(1, (coalesce(n, 0) - lo) / (CASE WHEN hi <= lo THEN 1 ELSE hi - lo END))) * 20 AS size
       FROM s FULL OUTER JOIN t USING (team_id, player) JOIN l USING (team_id))
"""


def pass_network_nodes(spark, sf_dir):
    out = panels.network_nodes(v.passes(spark, sf_dir), TEAM)
    return out.select("team_id", "player", "received", r6("nx", "nx"), r6("ny", "ny"), r6("size", "size"))


NODES_SQL = with_views("fx_passes", _NODES + "SELECT team_id, player, received, round(nx, 6) AS nx, round(ny, 6) AS ny, round(size, 6) AS size FROM nd")


def pass_network_edges(spark, sf_dir):
    out = panels.network_edges(v.passes(spark, sf_dir), TEAM)
    return out.select("team_id", "passer", "receiver", "n", r6("width", "width"), r6("mid_x", "mid_x"), r6("mid_y", "mid_y"))


EDGES_SQL = with_views("fx_passes", _NODES + """
SELECT e.team_id, passer, receiver, n, round(greatest(0.7, log2(1 + n) * 0.9), 6) AS width, round((u.nx + w.nx) / 2, 6) AS mid_x, round((u.ny + w.ny) / 2, 6) AS mid_y
FROM (SELECT team_id, passer, receiver, count(*) AS n FROM k GROUP BY ALL HAVING count(*) >= 3) e
JOIN nd u ON u.team_id = e.team_id AND u.player = passer JOIN nd w ON w.team_id = e.team_id AND w.player = receiver""")


def pass_vectors(spark, sf_dir):
    out = panels.pass_vectors(v.passes(spark, sf_dir))
    return out.select("team_id", "passer", *[r6(c, c) for c in ("x", "y", "length", "ux", "uy", "left_x", "left_y", "right_x", "right_y")])


VECTORS_SQL = with_views("fx_passes", """
WITH d AS (SELECT *, x2 - x AS dx, y2 - y AS dy, sqrt(pow(x2 - x, 2) + pow(y2 - y, 2)) AS length FROM fx_passes),
u AS (SELECT *, dx / length AS ux, dy / length AS uy FROM d WHERE length >= 0.000001)
SELECT team_id, passer, round(x, 6) AS x, round(y, 6) AS y, round(length, 6) AS length, round(ux, 6) + 0.0 AS ux, round(uy, 6) + 0.0 AS uy,
       round(x2 - 2.2 * ux - 1.2 * uy, 6) + 0.0 AS left_x, round(y2 - 2.2 * uy + 1.2 * ux, 6) + 0.0 AS left_y,
       round(x2 - 2.2 * ux + 1.2 * uy, 6) + 0.0 AS right_x, round(y2 - 2.2 * uy - 1.2 * ux, 6) + 0.0 AS right_y
FROM u""")


def distinct_teams(spark, sf_dir):
    return panels.distinct_teams(touches(spark, sf_dir))


DISTINCT_SQL = with_views("fx_touches", "SELECT DISTINCT team_id FROM fx_touches WHERE lower(label) LIKE '%pass%' ORDER BY 1")


def team_opponent_pair(spark, sf_dir):
    return panels.team_opponent_pair(fixtures_by_team(spark, sf_dir))


PAIR_SQL = with_views("fx_teams", """
WITH c AS (SELECT team_id, home_team, away_team, count(*) AS n FROM fx_teams GROUP BY ALL)
SELECT team_id, home_team AS team_name, away_team AS opponent_name, n
FROM (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY n DESC, coalesce(home_team, ''), coalesce(away_team, '')) AS nth FROM c) WHERE nth = 1""")


def team_labels(spark, sf_dir):
    return panels.team_labels(fixtures_by_team(spark, sf_dir))


LABELS_SQL = with_views("fx_teams", """
WITH c AS (SELECT team_id, coalesce(nullif(trim(home_team), ''), nullif(trim(away_team), '')) AS name, count(*) AS n FROM fx_teams GROUP BY team_id, home_team, away_team)
SELECT team_id, concat(name, ' (', team_id, ')') AS team_label
FROM (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY n DESC, name) AS nth FROM c WHERE name IS NOT NULL) WHERE nth = 1""")


def team_modal_names(spark, sf_dir):
    return panels.team_modal_names(fixtures_by_team(spark, sf_dir))


MODAL_SQL = with_views("fx_teams", """
WITH l AS (SELECT team_id, 'h' AS side, home_team AS name FROM fx_teams UNION ALL SELECT team_id, 'a', away_team FROM fx_teams),
c AS (SELECT team_id, name, sum(CAST(side = 'h' AS INT)) AS h, sum(CAST(side = 'a' AS INT)) AS a FROM l WHERE name IS NOT NULL GROUP BY ALL),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY h + a DESC, name) AS nth FROM c) WHERE nth = 1),
hm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY h DESC, name) AS nth FROM c WHERE h > 0) WHERE nth = 1),
am AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY a DESC, name) AS nth FROM c WHERE a > 0) WHERE nth = 1)
SELECT o.team_id, o.name AS team_name, CASE WHEN o.h >= o.a THEN am.name ELSE hm.name END AS opponent_name
FROM o LEFT JOIN hm USING (team_id) LEFT JOIN am USING (team_id)""")


def clean_event_ids(spark, sf_dir):
    o = v.table(spark, sf_dir, "orders")
    left = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.col("o_orderkey").cast("string"), F.lit(".0"))).otherwise(F.concat(F.col("o_orderkey").cast("string"), F.lit(".05")))
    right = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.col("o_orderkey").cast("string"), F.lit("_x1"))).otherwise(F.concat(F.lit("e"), F.col("o_orderkey").cast("string")))
    return o.select("o_orderkey", events.clean_number_id(left).alias("frame_id"), events.leading_digits(right).alias("event_id"))


CLEAN_IDS_SQL = """
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey AS VARCHAR) ELSE concat(o_orderkey, '.05') END AS frame_id,
       CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey AS VARCHAR) END AS event_id FROM orders"""


def clean_phase(spark, sf_dir):
    o = v.table(spark, sf_dir, "orders")
    raw = F.concat(F.lit("  "), F.replace("o_orderpriority", F.lit("-"), F.lit("_")), F.lit(" "))
    return o.select("o_orderkey", events.clean_phase(raw).alias("phase"), events.clean_phase(raw, underscores=True).alias("lookup_phase"))


CLEAN_PHASE_SQL = """
SELECT o_orderkey, replace(lower(trim(replace(o_orderpriority, '-', '_'))), ' ', '-') AS phase,
       replace(replace(lower(trim(replace(o_orderpriority, '-', '_'))), ' ', '-'), '_', '-') AS lookup_phase FROM orders"""


def slug(spark, sf_dir):
    return v.table(spark, sf_dir, "documents").select("doc_id", events.slug("text").alias("slug"))


SLUG_SQL = r"""
SELECT doc_id, substr(regexp_replace(regexp_replace(translate(regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g'), ':\/', '---'),
         '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 120) AS slug FROM documents"""


def attach_match_meta(spark, sf_dir):
    f = v.frames(spark, sf_dir).select("match_id", "period_id", "frame")
    runs = v.frames(spark, sf_dir).groupBy("match_id").agg(
        F.max("player_id").alias("home_score"), F.min("receiver_player_id").alias("away_score"), F.count(F.lit(1)).cast("string").alias("run_key")
    )
    return layouts.attach_match_meta(f, runs)


META_SQL = with_views("fx_frames", """
WITH r AS (SELECT match_id, max(player_id) AS home_score, min(receiver_player_id) AS away_score, CAST(count(*) AS VARCHAR) AS run_key FROM fx_frames GROUP BY match_id)
SELECT f.match_id, period_id, frame, home_score, away_score, concat(f.match_id, '_', substr(md5(run_key), 1, 8)) AS unique_match_id FROM fx_frames f JOIN r USING (match_id)""")


def flip_coords(spark, sf_dir):
    return coords.flip(v.passes(spark, sf_dir), XY).select("team_id", "passer", *[r6(c, c) for c in XY])


FLIP_SQL = with_views("fx_passes", "SELECT team_id, passer, " + ", ".join(f"round(-{c}, 6) + 0.0 AS {c}" for c in XY) + " FROM fx_passes")


def json_props(spark, sf_dir):
    e = v.table(spark, sf_dir, "events")
    path = lambda p: F.get_json_object("props", p)
    return e.select(
        "event_id", F.coalesce(path("$.phase"), F.lit("")).alias("phase"), F.coalesce(path("$.k").try_cast("double"), F.lit(0.0)).alias("support")
    )


JSON_SQL = "SELECT event_id, coalesce(props ->> '$.phase', '') AS phase, coalesce(TRY_CAST(props ->> '$.k' AS DOUBLE), 0) AS support FROM events"


def src_json_shots(spark, sf_dir):
    e = v.table(spark, sf_dir, "events").withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("double"))
    kind = F.when(F.col("event_type") == "error", "Shot").otherwise("Pass")
    place = F.when(F.col("event_id") % 11 != 0, F.array(F.col("value") % 120, F.col("k") * 0.8))
    outcome = F.when(F.col("k") < 20, "Goal").otherwise("Saved")
    text = F.to_json(F.struct(kind_struct(kind), place.alias("location"), F.struct(F.struct(outcome.alias("name")).alias("outcome")).alias("shot")))
    nested = e.select("event_id", F.from_json(text, files.SHOT_SCHEMA).alias("e")).select("event_id", "e.*")
    return files.shots_from_events(nested).select("event_id", r6("coordinates_x", "coordinates_x"), r6("coordinates_y", "coordinates_y"), "is_goal")


def kind_struct(kind):
    return F.struct(kind.alias("name")).alias("type")


JSON_SHOTS_SQL = """
WITH e AS (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k FROM events WHERE event_type = 'error' AND event_id % 11 <> 0)
SELECT event_id, round((value % 120) * 105 / 120, 6) AS coordinates_x, round(k * 0.8::DOUBLE * 68 / 80, 6) AS coordinates_y, k < 20 AS is_goal FROM e"""


QUERIES = {
    "auto_scale": (auto_scale, AUTO_SCALE_SQL),
    "team_passes": (team_passes, TEAM_PASSES_SQL),
    "team_shots": (team_shots, TEAM_SHOTS_SQL),
    "shot_table": (shot_table, SHOT_TABLE_SQL),
    "shot_counts": (shot_counts, SHOT_COUNTS_SQL),
    "pass_success_flag": (pass_success_flag, SUCCESS_SQL),
    "goal_flag": (goal_flag, GOAL_SQL),
    "pass_map_counts": (pass_map_counts, PASS_MAP_SQL),
    "heatmap": (heatmap, HEATMAP_SQL),
    "press_heatmap": (press_heatmap, PRESS_SQL),
    "player_spread": (player_spread, SPREAD_SQL),
    "player_blobs": (player_blobs, BLOBS_SQL),
    "pass_network_nodes": (pass_network_nodes, NODES_SQL),
    "pass_network_edges": (pass_network_edges, EDGES_SQL),
    "pass_vectors": (pass_vectors, VECTORS_SQL),
    "distinct_teams": (distinct_teams, DISTINCT_SQL),
    "team_opponent_pair": (team_opponent_pair, PAIR_SQL),
    "team_labels": (team_labels, LABELS_SQL),
    "team_modal_names": (team_modal_names, MODAL_SQL),
    "clean_event_ids": (clean_event_ids, CLEAN_IDS_SQL),
    "clean_phase": (clean_phase, CLEAN_PHASE_SQL),
    "slug": (slug, SLUG_SQL),
    "attach_match_meta": (attach_match_meta, META_SQL),
    "flip_coords": (flip_coords, FLIP_SQL),
    "json_props": (json_props, JSON_SQL),
    "src_json_shots": (src_json_shots, JSON_SHOTS_SQL),
}
