"""Queries over joins: events to frames, blocks to blocks, frames to windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.catalog import views as v
from touchline.catalog.frames import CFG, XG, r6
from touchline.catalog.views import with_views
from touchline.operators import alignment, joins, metrics, panels
from touchline.operators.masks import first_per_key
from touchline.session import stored
from touchline.sources import layouts

PAIR_KEYS = ["provider", "match_id", "period_id"]
# Fixed value: tolerance of the event synchronisation on the given events, which are minutes apart.
SYNC_SECONDS = 240.0
# Fixed value: shared frames of a pair on the given tables, whose blocks are a few frames long.
MIN_OVERLAP = 5


def asof_sync(spark, sf_dir):
    f = v.frames(spark, sf_dir)
    ticks = f.select("match_id", "ts", "frame")
    happenings = f.where("original_event IS NOT NULL").select("match_id", "event_id", (F.col("ts") + F.expr("INTERVAL 90 SECONDS")).alias("ts"))
    out = joins.nearest_in_time(ticks, happenings, ["match_id"], SYNC_SECONDS)
    return out.select("match_id", "event_id", F.col("frame").cast("string"), F.col("offset_us").cast("string"))


ASOF_SQL = with_views("fx_frames", """
WITH t AS (SELECT match_id, ts, frame FROM fx_frames),
e AS (SELECT match_id, event_id, ts + INTERVAL 90 SECOND AS ts FROM fx_frames WHERE original_event IS NOT NULL),
b AS (SELECT e.*, t.frame AS bf, t.ts AS bt FROM e ASOF LEFT JOIN t ON e.match_id = t.match_id AND e.ts >= t.ts),
a AS (SELECT b.*, t.frame AS af, t.ts AS nx FROM b ASOF LEFT JOIN t ON b.match_id = t.match_id AND b.ts <= t.ts),
d AS (SELECT *, epoch_us(ts) - epoch_us(bt) AS back, epoch_us(nx) - epoch_us(ts) AS ahead FROM a)
SELECT match_id, event_id,
       CASE WHEN back <= 240000000 AND (ahead IS NULL OR back <= ahead) THEN bf WHEN ahead <= 240000000 THEN af END :: VARCHAR AS frame,
       CASE WHEN back <= 240000000 AND (ahead IS NULL OR back <= ahead) THEN -back WHEN ahead <= 240000000 THEN ahead END :: VARCHAR AS offset_us
FROM d""")


def event_alignment(spark, sf_dir):
    f = v.frames(spark, sf_dir)
    ticks = f.select("match_id", "ts", "frame", "ball_x", "ball_y")
    happenings = f.where("original_event IS NOT NULL").select("match_id", "event_id", (F.col("ts") + F.expr("INTERVAL 90 SECONDS")).alias("ts"))
    out = alignment.align_events(ticks, happenings, ["match_id"], SYNC_SECONDS)
    return out.select("match_id", "event_id", F.col("frame").cast("string"), F.col("offset_us").cast("string"))


def merge_frames_events(spark, sf_dir):
    f = v.frames(spark, sf_dir)
    left = f.select(
        F.col("match_id").alias("unique_match_id"), "frame", "period_id", "ball_status",
        F.when(F.col("original_event").isNotNull(), F.concat((F.col("event_id") % 997).cast("string"), F.lit(".0"))).alias("original_event_id"),
    )
    events = f.select(
        F.col("match_id").alias("unique_match_id"),
        F.concat((F.col("event_id") % 997).cast("string"), F.lit("_x")).alias("event_id"),
        F.col("event_id").alias("seq"),
        F.col("ball_status").alias("ball_state"),
        F.col("original_event").alias("event_type"),
        F.col("player_id").cast("string"), F.col("receiver_player_id").cast("string"),
    )
    out = joins.merge_frames_events(left, events, order=["seq"])
    return out.select("unique_match_id", "period_id", "frame", "original_event_id", "event_type", "player_id", "receiver_player_id")


MERGE_SQL = with_views("fx_frames", """
WITH l AS (SELECT match_id AS unique_match_id, period_id, frame,
                  CASE WHEN original_event IS NOT NULL THEN concat(CAST(event_id % 997 AS VARCHAR), '.0') END AS original_event_id
           FROM fx_frames),
e AS (SELECT match_id AS unique_match_id, CAST(event_id % 997 AS VARCHAR) AS id, original_event AS event_type, player_id,
             receiver_player_id, row_number() OVER (PARTITION BY match_id, event_id % 997 ORDER BY event_id) AS nth
      FROM fx_frames WHERE ball_status = 'alive')
SELECT l.unique_match_id, l.period_id, l.frame, l.original_event_id, e.event_type, CAST(e.player_id AS VARCHAR) AS player_id,
       CAST(e.receiver_player_id AS VARCHAR) AS receiver_player_id
FROM l LEFT JOIN e ON l.unique_match_id = e.unique_match_id AND e.nth = 1 AND replace(l.original_event_id, '.0', '') = e.id""")


def update_from_stage(spark, sf_dir):
    f = v.frames(spark, sf_dir)
    target = f.select("match_id", "period_id", "frame", "phase_home", "phase_away")
    stage = f.where("ball_status = 'alive' AND original_event IS NOT NULL").select(
        "match_id", "period_id", "frame", F.lower("original_event").alias("phase_home"), r6("ball_x", "phase_home_conf")
    )
    return joins.update_from_stage(target, stage, ["match_id", "period_id", "frame"])


UPDATE_SQL = with_views("fx_frames", """
SELECT match_id, period_id, frame,
       CASE WHEN ball_status = 'alive' AND original_event IS NOT NULL THEN lower(original_event) ELSE phase_home END AS phase_home,
       phase_away,
       CASE WHEN ball_status = 'alive' AND original_event IS NOT NULL THEN round(ball_x, 6) END AS phase_home_conf
FROM fx_frames""")


def schema_evolve_union(spark, sf_dir):
    c = v.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    s = v.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("string").alias("nation"))
    return layouts.append_columns(c, s)


SCHEMA_SQL = """SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, CAST(NULL AS VARCHAR) AS nation FROM customer
UNION ALL SELECT s_suppkey, s_name, NULL, CAST(s_nationkey AS VARCHAR) FROM supplier"""


def dedupe_first(spark, sf_dir):
    f = v.frames(spark, sf_dir).select("match_id", "player_id", "original_event", "period_id", "frame", "event_id")
    return first_per_key(f, ["match_id", "player_id"], ["event_id"])


DEDUPE_SQL = with_views("fx_frames", """
SELECT match_id, player_id, original_event, period_id, frame, event_id
FROM (SELECT *, row_number() OVER (PARTITION BY match_id, player_id ORDER BY event_id) AS nth FROM fx_frames) WHERE nth = 1""")


def block_windows(spark, sf_dir):
    b = v.blocks(spark, sf_dir)
    roles = b.withColumn("role_index", F.explode(F.sequence(F.lit(1), F.lit(2))))
    roles = roles.withColumns({"block_start_frame": F.col("start_frame") + F.col("role_index"), "block_end_frame": F.col("end_frame") - F.col("role_index")})
    return joins.block_windows(roles, ["provider", "match_id", "side", "phase", "period_id", "block_id"])


BLOCK_WINDOWS_SQL = with_views("fx_blocks", """
SELECT provider, match_id, side, phase, period_id, block_id, start_frame + 1 AS start_frame, end_frame - 1 AS end_frame FROM fx_blocks""")


def _pairs(spark, sf_dir):
    b = v.blocks(spark, sf_dir)
    keys = ["provider", "match_id", "side", "phase", "period_id", "block_id"]
    forms = b.where("predicted_formation IS NOT NULL").select(*keys, "predicted_formation")
    named = joins.block_forms(b.drop("predicted_formation"), forms, keys)
    return joins.interval_pairs(named.where("side = 'home'").drop("side"), named.where("side = 'away'").drop("side"), PAIR_KEYS, MIN_OVERLAP, 32)


PAIRS_SQL = """
WITH pairs AS (
SELECT h.provider, h.match_id, h.period_id, h.block_id AS home_block_id, a.block_id AS away_block_id,
       h.phase AS phase_home, a.phase AS phase_away, h.predicted_formation AS home_form, a.predicted_formation AS away_form,
       greatest(h.start_frame, a.start_frame) AS pair_start, least(h.end_frame, a.end_frame) AS pair_end
FROM fx_blocks h JOIN fx_blocks a ON h.provider = a.provider AND h.match_id = a.match_id AND h.period_id = a.period_id
WHERE h.side = 'home' AND a.side = 'away' AND h.start_frame <= a.end_frame AND a.start_frame <= h.end_frame
  AND least(h.end_frame, a.end_frame) - greatest(h.start_frame, a.start_frame) + 1 >= 5)
"""


def _pair_columns(pairs):
    return pairs.select(
        *PAIR_KEYS, "home_block_id", "away_block_id", F.col("home_phase").alias("phase_home"), F.col("away_phase").alias("phase_away"),
        F.col("home_predicted_formation").alias("home_form"), F.col("away_predicted_formation").alias("away_form"), "pair_start", "pair_end",
    )


def interval_pairs(spark, sf_dir):
    return _pair_columns(_pairs(spark, sf_dir))


INTERVAL_PAIRS_SQL = with_views("fx_blocks", PAIRS_SQL + "SELECT * FROM pairs")


def frames_in_pairs(spark, sf_dir):
    f = v.alive(spark, sf_dir).select("match_id", "period_id", "frame", "original_event")
    pairs = stored(_pair_columns(_pairs(spark, sf_dir))).drop("provider")
    rows = joins.frames_in_intervals(f, pairs, ["match_id", "period_id"])
    return rows.groupBy("match_id", "period_id", "home_block_id", "away_block_id").agg(
        F.count(F.lit(1)).alias("n_frames"), F.count("original_event").alias("n_events"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame")
    )


FRAMES_IN_PAIRS_SQL = with_views("fx_alive fx_blocks", PAIRS_SQL + """
SELECT p.match_id, p.period_id, home_block_id, away_block_id, count(*) AS n_frames, count(original_event) AS n_events,
       min(frame) AS first_frame, max(frame) AS last_frame
FROM fx_alive f JOIN pairs p ON f.match_id = p.match_id AND f.period_id = p.period_id AND frame BETWEEN pair_start AND pair_end
GROUP BY ALL""")


def block_center_frames(spark, sf_dir):
    b = v.blocks(spark, sf_dir).select("match_id", "period_id", "block_id", "start_frame", "end_frame")
    f = v.frames(spark, sf_dir).select("match_id", "period_id", "frame", "ball_status")
    return joins.block_center_frames(b, f, ["match_id", "period_id"])


BLOCK_CENTER_SQL = with_views("fx_frames fx_blocks", """
WITH c AS (SELECT match_id, period_id, block_id, start_frame, end_frame, (start_frame + end_frame) // 2 AS mid FROM fx_blocks),
j AS (SELECT c.*, f.frame, f.ball_status, count(*) OVER (PARTITION BY c.block_id) AS n
      FROM c JOIN fx_frames f ON c.match_id = f.match_id AND c.period_id = f.period_id AND f.frame BETWEEN mid - 6 AND mid + 6)
SELECT match_id, period_id, block_id, start_frame, end_frame, frame, ball_status FROM j
WHERE n >= 13 OR frame BETWEEN start_frame AND end_frame""")


def measured_pairs(spark, sf_dir):
    """All pairs of blocks with their metrics."""
    facts = stored(metrics.frame_facts(v.alive(spark, sf_dir), XG, CFG).drop("phase_home", "phase_away"))
    pairs = stored(_pair_columns(_pairs(spark, sf_dir)))
    by = [*PAIR_KEYS, "home_block_id", "away_block_id", "pair_start"]
    measured = metrics.interval_metrics(facts, pairs, PAIR_KEYS, by)
    return measured.join(pairs.drop("pair_end"), by)


METRIC_COLUMNS = [f"{s}_{m}" for s in ("home", "away") for m in ("xg", "possession_pct", "recovery_s", "xt", "ppda", "quick_strength")]


def pair_metrics(spark, sf_dir):
    out = measured_pairs(spark, sf_dir)
    return out.select("match_id", "period_id", "home_block_id", "away_block_id", "n_frames", *[r6(c, c) for c in METRIC_COLUMNS])


_SIDE_SQL = """
       round({s}_xg, 6) AS {s}_xg, round({s}_pct, 6) AS {s}_possession_pct, round({s}_rec, 6) AS {s}_recovery_s,
       round({s}_xt, 6) AS {s}_xt, round({s}_ppda, 6) AS {s}_ppda,
       round(0.5 * {s}_xg + 0.3 * {s}_pct + 0.2 * (CASE WHEN {s}_rec > 0 THEN 1 / {s}_rec ELSE 0 END), 6) AS {s}_quick_strength"""
_SIDE_AGG = """
       coalesce(sum(CASE WHEN is_shot AND poss = '{s}' THEN xg END), 0) AS {s}_xg,
       100.0 * sum(CAST(poss = '{s}' AS BIGINT)) / count(*) AS {s}_pct,
       avg(CASE WHEN {s}_won AND {s}_lost_after >= pair_start THEN rn - {s}_lost_rn END) / 25.0 AS {s}_rec,
       coalesce(avg(CASE WHEN poss = '{s}' THEN xt END), 0) AS {s}_xt,
       CAST(sum(CAST(is_pass AND poss = '{o}' AS BIGINT)) AS DOUBLE) / greatest(1, sum(CAST(is_defence AND poss = '{s}' AS BIGINT))
         + sum(CAST({s}_won AND prev_frame >= pair_start AS BIGINT))) AS {s}_ppda"""
_SIDE_STEP = """
       prev IS NOT NULL AND prev <> '{s}' AND poss = '{s}' AS {s}_won,
       max(CASE WHEN prev = '{s}' AND poss <> '{s}' THEN rn END) OVER w AS {s}_lost_rn,
       max(CASE WHEN prev = '{s}' AND poss <> '{s}' THEN prev_frame END) OVER w AS {s}_lost_after"""
PAIR_METRICS_CTE = PAIRS_SQL + """,
st AS (SELECT *, coalesce(team_possession, '') AS poss, lag(coalesce(team_possession, '')) OVER w AS prev, lag(frame) OVER w AS prev_frame
       FROM fx_alive WINDOW w AS (PARTITION BY match_id, period_id ORDER BY frame)),
sv AS (SELECT *, sqrt(pow(105 - ball_x * 105, 2) + pow(34 - ball_y * 68, 2)) AS d, ball_x * 105 - 52.5 AS mx, ball_y * 68 - 34.0 AS my,
         coalesce(regexp_matches(lower(original_event), 'pass|cross'), false) AS is_pass,
         coalesce(regexp_matches(lower(original_event), 'tackle|intercept|recover|clear|foul|duel'), false) AS is_defence,
         coalesce(regexp_matches(lower(original_event), 'shot|goal'), false) AS is_shot,""" + _SIDE_STEP.format(s="home") + "," + _SIDE_STEP.format(s="away") + """
       FROM st WINDOW w AS (PARTITION BY match_id, period_id ORDER BY rn)),
fa AS (SELECT *, 1 / (1 + exp(-(0.4 - 0.11 * d + 1.2 * atan2(7.32 * d, d * d - 3.66 * 3.66)))) AS xg,
         exp(-sqrt((53 - mx) * (53 - mx) + my * my) / 20) * (1 - atan2(abs(my), greatest(0.000001, 53 - mx)) / (pi() / 2)) AS xt FROM sv),
pm AS (SELECT p.provider, p.match_id, p.period_id, home_block_id, away_block_id, p.phase_home, p.phase_away, home_form, away_form,
         count(*) AS n_frames,""" + _SIDE_AGG.format(s="home", o="away") + "," + _SIDE_AGG.format(s="away", o="home") + """
       FROM fa f JOIN pairs p ON f.match_id = p.match_id AND f.period_id = p.period_id AND frame BETWEEN pair_start AND pair_end
       GROUP BY ALL)
"""
PAIR_METRICS_SQL = with_views("fx_alive fx_blocks", PAIR_METRICS_CTE + "SELECT match_id, period_id, home_block_id, away_block_id, n_frames," + _SIDE_SQL.format(s="home") + "," + _SIDE_SQL.format(s="away") + " FROM pm")


def fvf_from_pairs(spark, sf_dir):
    pairs = metrics.equal_strength(stored(measured_pairs(spark, sf_dir)))
    out = metrics.matchups(pairs, ["provider", "phase_home", "phase_away", "home_form", "away_form"])
    skip = ["provider", "phase_home", "phase_away", "home_form", "away_form", "pairs"]
    return out.select(*skip, *[r6(c, c) for c in out.columns if c not in skip])


_EQ_METRICS = [f"{s}_{m}" for s in ("home", "away") for m in ("xg", "xt", "possession_pct", "ppda", "recovery_s")]
_POS = ("xg", "xt", "possession_pct")
_SHORT = {"xg": "xg", "xt": "xt", "possession_pct": "pct", "ppda": "ppda", "recovery_s": "rec"}


def _src(c: str) -> str:
    side, m = c.split("_", 1)
    return f"{side}_{_SHORT[m]}"


FVF_FROM_PAIRS_SQL = with_views("fx_alive fx_blocks", PAIR_METRICS_CTE + ",\nqb AS (SELECT " + ", ".join(
    f"quantile_cont({_src(c)}, 0.05) AS lo_{c}, quantile_cont({_src(c)}, 0.95) AS hi_{c}" for c in _EQ_METRICS
) + " FROM pm),\nsc AS (SELECT pm.*, " + ", ".join(
    ("" if c.split("_", 1)[1] in _POS else "1 - ")
    + f"greatest(0, least(1, ({_src(c)} - lo_{c}) / (CASE WHEN hi_{c} = lo_{c} THEN 1 ELSE hi_{c} - lo_{c} END))) AS g_{c}" for c in _EQ_METRICS
) + " FROM pm, qb),\nfl AS (SELECT *, " + ", ".join(
    f"CASE WHEN {_src(c)} IS NULL THEN avg(CASE WHEN {_src(c)} IS NOT NULL THEN g_{c} END) OVER () ELSE g_{c} END AS f_{c}" for c in _EQ_METRICS
) + " FROM sc)\nSELECT provider, phase_home, phase_away, home_form, away_form, count(*) AS pairs, " + ", ".join(
    f"round(avg({s}_{src}), 6) AS {s}_{name}" for s in ("home", "away") for name, src in (("xg", "xg"), ("possession_pct", "pct"), ("recovery_s", "rec"), ("xt", "xt"), ("ppda", "ppda"))
) + ", " + ", ".join(
    "round(avg((" + " + ".join(f"f_{c}" for c in _EQ_METRICS if c.startswith(s)) + f") / 5), 6) AS {s}_strength" for s in ("home", "away")
) + "\nFROM fl GROUP BY ALL")


def match_runs(spark, sf_dir):
    f = v.frames(spark, sf_dir)
    out = panels.match_runs(f, ["match_id"])
    run = F.concat(F.col("match_id"), F.lit("_"), F.substring(F.md5("match_id"), 1, 8))
    return out.select(run.alias("unique_match_id"), "match_id", F.date_format("first_ts", "yyyy-MM-dd HH:mm:ss").alias("first_ts"), "n_rows")


MATCH_RUNS_SQL = with_views("fx_frames", """
SELECT concat(match_id, '_', substr(md5(match_id), 1, 8)) AS unique_match_id, match_id,
       strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, count(*) AS n_rows
FROM fx_frames GROUP BY match_id""")


QUERIES = {
    "asof_sync": (asof_sync, ASOF_SQL),
    "event_alignment": (event_alignment, None),
    "merge_frames_events": (merge_frames_events, MERGE_SQL),
    "update_from_stage": (update_from_stage, UPDATE_SQL),
    "schema_evolve_union": (schema_evolve_union, SCHEMA_SQL),
    "dedupe_first": (dedupe_first, DEDUPE_SQL),
    "block_windows": (block_windows, BLOCK_WINDOWS_SQL),
    "interval_pairs": (interval_pairs, INTERVAL_PAIRS_SQL),
    "frames_in_pairs": (frames_in_pairs, FRAMES_IN_PAIRS_SQL),
    "block_center_frames": (block_center_frames, BLOCK_CENTER_SQL),
    "pair_metrics": (pair_metrics, PAIR_METRICS_SQL),
    "fvf_aggregate": (fvf_from_pairs, FVF_FROM_PAIRS_SQL),
    "match_runs": (match_runs, MATCH_RUNS_SQL),
}
