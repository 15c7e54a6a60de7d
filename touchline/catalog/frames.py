"""Queries over tracking frames: masks, possession, joins of events and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.catalog import views as v
from touchline.catalog.views import with_views
from touchline.config import PROVIDERS
from touchline.functions.events import is_defence, is_pass, is_set_piece, is_shot
from touchline.functions.threat import expected_threat, goal_probability, shot_angle, shot_distance
from touchline.operators import masks, metrics
from touchline.session import stored
from touchline.sources import files

PAD = 5
XG = (0.4, -0.11, 1.2)
CFG = PROVIDERS["sportec"]
KEYS = ["match_id", "period_id"]


def r6(c, name: str | None = None):
    c = F.col(c) if isinstance(c, str) else c
    out = F.round(c, 6) + F.lit(0.0)
    return out.alias(name) if name else out


def _facts(spark, sf_dir) -> DataFrame:
    return metrics.frame_facts(stored(v.alive(spark, sf_dir)), XG, CFG)


def match_profile(spark, sf_dir):
    rows = _facts(spark, sf_dir)
    start = F.lit(-(2**62))
    aggs = {}
    for s in metrics.SIDES:
        aggs |= metrics.possession_metrics(s, start) | metrics.ppda_metric(s, start)
    wide = rows.groupBy("match_id").agg(*[c.alias(n) for n, c in aggs.items()])
    sides = F.array(
        *[
            F.struct(
                F.lit(s).alias("side"),
                r6(f"{s}_possession_pct").alias("possession_pct"),
                r6(f"{s}_recovery_s").alias("recovery_s"),
                r6(f"{s}_ppda").alias("ppda"),
            )
            for s in metrics.SIDES
        ]
    )
    return wide.select("match_id", F.inline(sides))


STEPS_SQL = """
WITH p AS (
  SELECT *, coalesce(team_possession, '') AS poss,
         lag(coalesce(team_possession, '')) OVER w AS prev, lag(frame) OVER w AS prev_frame
  FROM fx_alive WINDOW w AS (PARTITION BY match_id, period_id ORDER BY frame)),
s AS (SELECT 'home' AS side, 'away' AS rival UNION ALL SELECT 'away', 'home'),
m AS (
  SELECT p.*, s.side, s.rival,
         prev IS NOT NULL AND prev = side AND poss <> side AS lost,
         prev IS NOT NULL AND prev <> side AND poss = side AS won
  FROM p CROSS JOIN s),
g AS (
  SELECT *, max(CASE WHEN lost THEN rn END) OVER (PARTITION BY match_id, period_id, side ORDER BY rn) AS lost_rn,
         max(CASE WHEN lost THEN prev_frame END) OVER (PARTITION BY match_id, period_id, side ORDER BY rn) AS lost_after,
         coalesce(regexp_matches(lower(original_event), 'pass|cross'), false) AS is_pass,
         coalesce(regexp_matches(lower(original_event), 'tackle|intercept|recover|clear|foul|duel'), false) AS is_defence,
         coalesce(regexp_matches(lower(original_event), 'shot|goal'), false) AS is_shot
  FROM m)
"""

MATCH_PROFILE_SQL = with_views("fx_alive", STEPS_SQL + """
SELECT match_id, side, round(100.0 * sum(CAST(poss = side AS BIGINT)) / count(*), 6) AS possession_pct,
       round(avg(CASE WHEN won THEN rn - lost_rn END) / 25.0, 6) AS recovery_s,
       round(CAST(sum(CAST(is_pass AND poss = rival AS BIGINT)) AS DOUBLE)
             / greatest(1, sum(CAST(is_defence AND poss = side AS BIGINT)) + sum(CAST(won AS BIGINT))), 6) AS ppda
FROM g GROUP BY match_id, side""")


def table_counts(spark, sf_dir):
    return files.table_counts(v.frames(spark, sf_dir))


TABLE_COUNTS_SQL = with_views("fx_frames", "SELECT count(*) AS n_rows, count(DISTINCT match_id) AS n_matches FROM fx_frames")


def scan_alive(spark, sf_dir):
    return v.alive(spark, sf_dir).select("match_id", "period_id", "frame", "rn", "team_possession", r6("ball_x", "ball_x"), r6("ball_y", "ball_y"))


SCAN_ALIVE_SQL = with_views("fx_alive", """
SELECT match_id, period_id, frame, rn, team_possession, round(ball_x, 6) AS ball_x, round(ball_y, 6) AS ball_y FROM fx_alive""")


def scan_match(spark, sf_dir):
    f = v.frames(spark, sf_dir).withColumn("unique_match_id", F.col("match_id"))
    return files.match_frames(f, "m1").select("match_id", "period_id", "frame", "ball_status", "original_event")


SCAN_MATCH_SQL = with_views("fx_frames", """
SELECT match_id, period_id, frame, ball_status, original_event FROM fx_frames WHERE match_id = 'm1' AND ball_status = 'alive'""")


def detect_events(spark, sf_dir):
    f = v.frames(spark, sf_dir).withColumn("event_type", F.upper("original_event"))
    flags = {"is_shot": is_shot(f, CFG), "is_pass": is_pass(f, CFG), "is_defence": is_defence(f, CFG), "is_set_piece": is_set_piece("original_event")}
    return f.withColumns(flags).groupBy("match_id", "original_event", *flags).agg(F.count(F.lit(1)).alias("n"))


DETECT_EVENTS_SQL = with_views("fx_frames", """
SELECT match_id, original_event,
       coalesce(upper(original_event) IN ('SHOTWIDE','SUCCESSFULSHOT','SAVEDSHOT','BLOCKEDSHOT','SHOTWOODWORK')
                OR regexp_matches(lower(original_event), 'shot|goal'), false) AS is_shot,
       coalesce(upper(original_event) IN ('PASS','CROSS','FREEKICKPASS','GOAL_KICK')
                OR regexp_matches(lower(original_event), 'pass|cross'), false) AS is_pass,
       coalesce(upper(original_event) IN ('TACKLE','INTERCEPTION','CHALLENGE','CLEARANCE','BALL_RECOVERY','FOUL')
                OR regexp_matches(lower(original_event), 'tackle|intercept|recover|clear|foul|duel'), false) AS is_defence,
       coalesce(lower(original_event) IN ('set piece','corner','freekick','throwin','penalty','goalkick','kickoff',
                'offside','drop_ball','cornerkick','free_kick','throw_in','goal_kick','kick_off'), false) AS is_set_piece,
       count(*) AS n
FROM fx_frames GROUP BY ALL""")


def set_piece_mask(spark, sf_dir):
    return v.frames(spark, sf_dir).select("match_id", "period_id", "frame", is_set_piece("original_event").alias("set_piece"))


SET_PIECE_SQL = with_views("fx_frames", """
SELECT match_id, period_id, frame, coalesce(lower(original_event) IN ('set piece','corner','freekick','throwin','penalty',
  'goalkick','kickoff','offside','drop_ball','cornerkick','free_kick','throw_in','goal_kick','kick_off'), false) AS set_piece
FROM fx_frames""")


def possession_changes(spark, sf_dir):
    out = masks.possession_changes(v.alive(spark, sf_dir))
    return out.where("changed").select("match_id", "period_id", "frame", "rn", "team_possession")


CHANGES_SQL = """
WITH c AS (SELECT *, coalesce(team_possession <> lag(team_possession) OVER w, false) AS changed,
                  coalesce(phase_home <> lag(phase_home) OVER w, false) AS start_home,
                  coalesce(phase_away <> lag(phase_away) OVER w, false) AS start_away,
                  coalesce(lower(original_event) = 'throwin', false) AS set_piece
           FROM fx_alive WINDOW w AS (PARTITION BY match_id, period_id ORDER BY rn)),
t AS (SELECT *, max(CAST(changed AS INT)) OVER p = 1 AS transition, max(CAST(start_home AS INT)) OVER p = 1 AS drop3_home,
             max(CAST(start_away AS INT)) OVER p = 1 AS drop3_away
      FROM c WINDOW p AS (PARTITION BY match_id, period_id ORDER BY rn ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)),
f AS (SELECT *, sum(CAST(NOT set_piece AND NOT transition AS INT)) OVER (PARTITION BY match_id, period_id ORDER BY rn
                ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) = 13 AS full_window,
             NOT set_piece AND NOT transition AND phase_home IS NOT NULL AND NOT drop3_home AS eligible_home,
             NOT set_piece AND NOT transition AND phase_away IS NOT NULL AND NOT drop3_away AS eligible_away
      FROM t)
"""
POSSESSION_CHANGES_SQL = with_views("fx_alive", CHANGES_SQL + "SELECT match_id, period_id, frame, rn, team_possession FROM f WHERE changed")


def transition_mask(spark, sf_dir):
    out = masks.mask_after_change(v.alive(spark, sf_dir), "team_possession", "transition", PAD)
    return out.select("match_id", "period_id", "frame", "transition")


TRANSITION_SQL = with_views("fx_alive", CHANGES_SQL + "SELECT match_id, period_id, frame, transition FROM f")


def phase_start_mask(spark, sf_dir):
    out = masks.mask_after_change(v.alive(spark, sf_dir), "phase_home", "drop3_home", PAD)
    out = masks.mask_after_change(out, "phase_away", "drop3_away", PAD)
    return out.select("match_id", "period_id", "frame", "drop3_home", "drop3_away")


PHASE_START_SQL = with_views("fx_alive", CHANGES_SQL + "SELECT match_id, period_id, frame, drop3_home, drop3_away FROM f")


def eligibility(spark, sf_dir):
    out = masks.frame_masks(v.alive(spark, sf_dir), pad=PAD)
    return out.select("match_id", "period_id", "frame", "set_piece", "transition", "drop3_home", "drop3_away", "eligible_home", "eligible_away")


ELIGIBILITY_SQL = with_views("fx_alive", CHANGES_SQL + """
SELECT match_id, period_id, frame, set_piece, transition, drop3_home, drop3_away, eligible_home, eligible_away FROM f""")


def full_window(spark, sf_dir):
    return masks.frame_masks(v.alive(spark, sf_dir), pad=PAD).select("match_id", "period_id", "frame", "full_window")


FULL_WINDOW_SQL = with_views("fx_alive", CHANGES_SQL + "SELECT match_id, period_id, frame, full_window FROM f")


def possession_recovery(spark, sf_dir):
    rows = masks.possession_steps(stored(v.alive(spark, sf_dir)), CFG)
    start = F.lit(-(2**62))
    aggs = metrics.possession_metrics("home", start) | metrics.possession_metrics("away", start)
    return rows.groupBy(*KEYS).agg(*[r6(c, n) for n, c in aggs.items()])


POSSESSION_RECOVERY_SQL = with_views("fx_alive", STEPS_SQL + """
SELECT match_id, period_id,
       round(100.0 * sum(CAST(side = 'home' AND poss = side AS BIGINT)) / (count(*) / 2.0), 6) AS home_possession_pct,
       round(100.0 * sum(CAST(side = 'away' AND poss = side AS BIGINT)) / (count(*) / 2.0), 6) AS away_possession_pct,
       round(avg(CASE WHEN won AND side = 'home' THEN rn - lost_rn END) / 25.0, 6) AS home_recovery_s,
       round(avg(CASE WHEN won AND side = 'away' THEN rn - lost_rn END) / 25.0, 6) AS away_recovery_s
FROM g GROUP BY match_id, period_id""")


def ppda(spark, sf_dir):
    rows = _facts(spark, sf_dir)
    start = F.lit(-(2**62))
    aggs = metrics.ppda_metric("home", start) | metrics.ppda_metric("away", start)
    return rows.groupBy(*KEYS).agg(*[r6(c, n) for n, c in aggs.items()])


PPDA_SQL = with_views("fx_alive", STEPS_SQL + """,
q AS (SELECT match_id, period_id, side,
       round(CAST(sum(CAST(is_pass AND poss = rival AS BIGINT)) AS DOUBLE)
             / greatest(1, sum(CAST(is_defence AND poss = side AS BIGINT)) + sum(CAST(won AS BIGINT))), 6) AS ppda
FROM g GROUP BY match_id, period_id, side)
SELECT match_id, period_id, max(CASE WHEN side = 'home' THEN ppda END) AS home_ppda,
       max(CASE WHEN side = 'away' THEN ppda END) AS away_ppda
FROM q GROUP BY match_id, period_id""")


def recovery_points(spark, sf_dir):
    rows = stored(v.alive(spark, sf_dir))
    home, away = (masks.recovery_points(rows, s).withColumn("side", F.lit(s)) for s in metrics.SIDES)
    return home.unionByName(away).select("match_id", "period_id", "side", "frame", r6("ball_x", "x"), r6("ball_y", "y"))


RECOVERY_POINTS_SQL = with_views("fx_alive", CHANGES_SQL + """
SELECT match_id, period_id, team_possession AS side, frame, round(ball_x, 6) AS x, round(ball_y, 6) AS y FROM f
WHERE changed AND ball_x IS NOT NULL AND ball_y IS NOT NULL""")


def xg_features(spark, sf_dir):
    f = v.frames(spark, sf_dir)
    d = shot_distance(F.col("ball_x") * 105, F.col("ball_y") * 68)
    return f.where(is_shot(f, CFG)).select("match_id", "period_id", "frame", r6(d, "distance"), r6(shot_angle(d), "angle"))


SHOTS_SQL = """
WITH d AS (SELECT *, sqrt(pow(105 - ball_x * 105, 2) + pow(34 - ball_y * 68, 2)) AS distance FROM fx_frames
           WHERE regexp_matches(lower(original_event), 'shot|goal')),
a AS (SELECT *, atan2(7.32 * distance, distance * distance - 3.66 * 3.66) AS angle FROM d)
"""
XG_FEATURES_SQL = with_views("fx_frames", SHOTS_SQL + "SELECT match_id, period_id, frame, round(distance, 6) AS distance, round(angle, 6) AS angle FROM a")


def xg_score(spark, sf_dir):
    f = v.frames(spark, sf_dir)
    return f.where(is_shot(f, CFG)).select("match_id", "period_id", "frame", r6(goal_probability(F.col("ball_x"), F.col("ball_y"), XG), "xg"))


XG_SCORE_SQL = with_views("fx_frames", SHOTS_SQL + """
SELECT match_id, period_id, frame, round(1 / (1 + exp(-(0.4 - 0.11 * distance + 1.2 * angle))), 6) AS xg FROM a""")


def window_xg(spark, sf_dir):
    aggs = {f"{s}_xg": metrics.threat_metrics(s)[f"{s}_xg"] for s in metrics.SIDES}
    return _facts(spark, sf_dir).groupBy(*KEYS).agg(*[r6(c, n) for n, c in aggs.items()])


WINDOW_XG_SQL = with_views("fx_frames", SHOTS_SQL + """,
x AS (SELECT *, 1 / (1 + exp(-(0.4 - 0.11 * distance + 1.2 * angle))) AS xg FROM a WHERE ball_status = 'alive'),
k AS (SELECT DISTINCT match_id, period_id FROM fx_frames WHERE ball_status = 'alive')
SELECT k.match_id, k.period_id, round(coalesce(sum(CASE WHEN team_possession = 'home' THEN xg END), 0), 6) AS home_xg,
       round(coalesce(sum(CASE WHEN team_possession = 'away' THEN xg END), 0), 6) AS away_xg
FROM k LEFT JOIN x USING (match_id, period_id) GROUP BY ALL""")


def window_xt(spark, sf_dir):
    aggs = {f"{s}_xt": metrics.threat_metrics(s)[f"{s}_xt"] for s in metrics.SIDES}
    return _facts(spark, sf_dir).groupBy(*KEYS).agg(*[r6(c, n) for n, c in aggs.items()])


WINDOW_XT_SQL = with_views("fx_frames", """
WITH m AS (SELECT *, ball_x * 105 - 52.5 AS x, ball_y * 68 - 34.0 AS y FROM fx_frames WHERE ball_status = 'alive'),
t AS (SELECT *, exp(-sqrt((53 - x) * (53 - x) + y * y) / 20) * (1 - atan2(abs(y), greatest(0.000001, 53 - x)) / (pi() / 2)) AS xt FROM m)
SELECT match_id, period_id, round(coalesce(avg(CASE WHEN team_possession = 'home' THEN xt END), 0), 6) AS home_xt,
       round(coalesce(avg(CASE WHEN team_possession = 'away' THEN xt END), 0), 6) AS away_xt
FROM t GROUP BY match_id, period_id""")


def threat_surface(spark, sf_dir):
    f = v.frames(spark, sf_dir)
    return f.select("match_id", "period_id", "frame", r6(expected_threat(F.col("ball_x") * 105 - 52.5, F.col("ball_y") * 68 - 34.0), "xt"))


THREAT_SURFACE_SQL = with_views("fx_frames", """
WITH m AS (SELECT *, ball_x * 105 - 52.5 AS x, ball_y * 68 - 34.0 AS y FROM fx_frames)
SELECT match_id, period_id, frame,
       round(exp(-sqrt((53 - x) * (53 - x) + y * y) / 20) * (1 - atan2(abs(y), greatest(0.000001, 53 - x)) / (pi() / 2)), 6) AS xt
FROM m""")


def quick_strength(spark, sf_dir):
    wide = metrics.sequence_metrics(_facts(spark, sf_dir), KEYS)
    return wide.select(*KEYS, r6("home_quick_strength", "home_quick_strength"), r6("away_quick_strength", "away_quick_strength"))


QUICK_STRENGTH_SQL = with_views("fx_alive", STEPS_SQL + """,
x AS (SELECT *, sqrt(pow(105 - ball_x * 105, 2) + pow(34 - ball_y * 68, 2)) AS d FROM g),
y AS (SELECT match_id, period_id, side,
        coalesce(sum(CASE WHEN is_shot AND poss = side THEN 1 / (1 + exp(-(0.4 - 0.11 * d + 1.2 * atan2(7.32 * d, d * d - 3.66 * 3.66)))) END), 0) AS xg,
        100.0 * sum(CAST(poss = side AS BIGINT)) / count(*) AS pct, avg(CASE WHEN won THEN rn - lost_rn END) / 25.0 AS rec
      FROM x GROUP BY match_id, period_id, side),
z AS (SELECT *, 0.5 * xg + 0.3 * pct + 0.2 * (CASE WHEN rec > 0 THEN 1 / rec ELSE 0 END) AS q FROM y)
SELECT match_id, period_id, round(max(CASE WHEN side = 'home' THEN q END), 6) AS home_quick_strength,
       round(max(CASE WHEN side = 'away' THEN q END), 6) AS away_quick_strength
FROM z GROUP BY match_id, period_id""")


QUERIES = {
    "match_profile": (match_profile, MATCH_PROFILE_SQL),
    "table_counts": (table_counts, TABLE_COUNTS_SQL),
    "scan_alive": (scan_alive, SCAN_ALIVE_SQL),
    "scan_match": (scan_match, SCAN_MATCH_SQL),
    "detect_events": (detect_events, DETECT_EVENTS_SQL),
    "set_piece_mask": (set_piece_mask, SET_PIECE_SQL),
    "possession_changes": (possession_changes, POSSESSION_CHANGES_SQL),
    "transition_mask": (transition_mask, TRANSITION_SQL),
    "phase_start_mask": (phase_start_mask, PHASE_START_SQL),
    "eligibility": (eligibility, ELIGIBILITY_SQL),
    "full_window": (full_window, FULL_WINDOW_SQL),
    "possession_recovery": (possession_recovery, POSSESSION_RECOVERY_SQL),
    "ppda": (ppda, PPDA_SQL),
    "recovery_points": (recovery_points, RECOVERY_POINTS_SQL),
    "xg_features": (xg_features, XG_FEATURES_SQL),
    "xg_score": (xg_score, XG_SCORE_SQL),
    "window_xg": (window_xg, WINDOW_XG_SQL),
    "window_xt": (window_xt, WINDOW_XT_SQL),
    "threat_surface": (threat_surface, THREAT_SURFACE_SQL),
    "quick_strength": (quick_strength, QUICK_STRENGTH_SQL),
}
