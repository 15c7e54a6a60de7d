"""Queries that write through a sink and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.catalog import views as v
from touchline.catalog.frames import r6
from touchline.catalog.views import with_views
from touchline.config import PROVIDERS
from touchline.operators import passgraph as pg
from touchline.session import new_path, shared_table
from touchline.sources import files, layouts

EVENTS_SCHEMA = "_id long, _match string, _x double, _y double, _endX double"


def src_xml_events(spark, sf_dir):
    """Event coordinates from XML, turned round; every tenth x is the text NaN."""
    f = v.frames(spark, sf_dir).where("original_event IS NOT NULL")
    x = F.when(F.col("event_id") % 10 == 0, "NaN").otherwise(F.col("ball_x").cast("string"))
    rows = f.select(F.col("event_id").alias("_id"), F.col("match_id").alias("_match"), x.alias("_x"), F.col("ball_y").cast("string").alias("_y"), F.col("ball_x").cast("string").alias("_endX"))
    path = shared_table(rows, "xml", rootTag="Events", rowTag="Event")
    fields = {"event_id": F.col("_id"), "match_id": F.col("_match"), "coordinates_x": F.col("_x"), "coordinates_y": F.col("_y"), "end_coordinates_x": F.col("_endX")}
    out = files.read_events_xml(spark, path, "Event", _schema(EVENTS_SCHEMA), fields)
    return out.select("event_id", "match_id", *[r6(c, c) for c in ("coordinates_x", "coordinates_y", "end_coordinates_x")])


def _schema(ddl: str):
    from pyspark.sql import types as T

    return T.StructType.fromDDL(ddl)


XML_EVENTS_SQL = with_views("fx_frames", """
SELECT event_id, match_id, CASE WHEN event_id % 10 <> 0 THEN round(-ball_x, 6) + 0.0 END AS coordinates_x, round(-ball_y, 6) + 0.0 AS coordinates_y,
       round(-ball_x, 6) + 0.0 AS end_coordinates_x FROM fx_frames WHERE original_event IS NOT NULL""")


def replace_matches(spark, sf_dir):
    """All frames appended, then the odd matches replaced by rows with one more column, and read back."""
    f = v.frames(spark, sf_dir).select("match_id", "period_id", "frame", "ball_status")
    path = new_path(spark)
    files.append_table(f, path)
    odd = F.regexp_extract("match_id", "([0-9]+)", 1).cast("long") % 2 == 1
    files.replace_matches(f.where(odd & (F.col("frame") <= 100)).withColumn("checked", F.lit("yes")), path)
    return files.read_table(spark, path).select("match_id", "period_id", "frame", "ball_status", "checked")


REPLACE_SQL = with_views("fx_frames", """
SELECT match_id, period_id, frame, ball_status, CASE WHEN CAST(substr(match_id, 2) AS BIGINT) % 2 = 1 THEN 'yes' END AS checked
FROM fx_frames WHERE CAST(substr(match_id, 2) AS BIGINT) % 2 = 0 OR frame <= 100""")


def audit_csv(spark, sf_dir):
    """Phases and events written for people to read, and read back."""
    f = v.frames(spark, sf_dir).select("match_id", "frame", "event_id", "phase_home", "original_event")
    path = new_path(spark)
    files.write_audit_csv(f, path)
    return spark.read.schema(f.schema).option("header", True).csv(path)


AUDIT_SQL = with_views("fx_frames", "SELECT match_id, frame, event_id, phase_home, original_event FROM fx_frames")


def slice_passes_of_team(spark, sf_dir):
    """Passes of one team of one match, the match given as text."""
    p = v.passes(spark, sf_dir).withColumns({"original_event": F.lit("PASS"), "match_id": F.col("passer") % 2})
    return pg.slice_passes(p, match_id="1", team_id="A").groupBy("team_id", "passer").agg(F.count(F.lit(1)).alias("n"))


SLICE_TEAM_SQL = with_views("fx_passes", """
SELECT team_id, passer, count(*) AS n FROM fx_passes WHERE receiver IS NOT NULL AND passer % 2 = 1 AND team_id = 'A' GROUP BY ALL""")


def canonical_events(spark, sf_dir):
    """The second provider's column names and team tags, brought to those of the analysis."""
    f = v.frames(spark, sf_dir)
    tag = F.when(F.col("team_possession") == "home", "FIFATMA").when(F.col("team_possession") == "away", "FIFATBA")
    other = f.select("event_id", F.col("period_id").alias("period_id_x"), tag.alias("team_id"), F.col("receiver_player_id").alias("to_player_id"), F.col("ball_x").alias("start_x"), F.col("ball_y").alias("end_y"))
    out = layouts.canonical_events(other, PROVIDERS["metrica"])
    return out.select("event_id", "period_id", "team_possession", "receiver_player_id", r6("coordinates_x", "coordinates_x"), r6("end_coordinates_y", "end_coordinates_y"))


CANONICAL_SQL = with_views("fx_frames", """
SELECT event_id, period_id, team_possession, receiver_player_id, round(ball_x, 6) + 0.0 AS coordinates_x, round(ball_y, 6) + 0.0 AS end_coordinates_y FROM fx_frames""")


QUERIES = {
    "src_xml_events": (src_xml_events, XML_EVENTS_SQL),
    "replace_matches": (replace_matches, REPLACE_SQL),
    "canonical_events": (canonical_events, CANONICAL_SQL),
    "audit_csv": (audit_csv, AUDIT_SQL),
    "slice_passes_of_team": (slice_passes_of_team, SLICE_TEAM_SQL),
}
