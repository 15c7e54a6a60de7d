"""File sources and sinks."""

import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.operators import knowledge, recommend
from touchline.session import shared_folder, stored
from touchline.sources import files, layouts

XML = """<?xml version="1.0"?>
<Feed>
  <Frame N="1" T="2024-05-01T10:00:00Z" BallX="1.5" BallY="-2.0"><P Side="home" Id="7" X="0.5" Y="1.0"/><P Side="away" Id="9" X="-3.0" Y="2.5"/></Frame>
  <Frame N="2" T="2024-05-01T10:00:01Z" BallX="1.0" BallY="0.0"><P Side="home" Id="7" X="0.6" Y="1.1"/></Frame>
</Feed>
"""
EVENTS = """<?xml version="1.0"?>
<Events><Event EventId="12_a" Kind="Pass"><Start X="1.0" Y="2.0"/></Event><Event EventId="13" Kind="Shot"><Start X="-4.0" Y="0.5"/></Event></Events>
"""


def test_tracking_xml(spark, tmp_path):
    (tmp_path / "m1.xml").write_text(XML)
    player = T.StructType([T.StructField(f"_{n}", T.StringType()) for n in ("Side", "Id", "X", "Y")])
    schema = T.StructType(
        [T.StructField("_N", T.LongType()), T.StructField("_BallX", T.DoubleType()), T.StructField("_BallY", T.DoubleType()), T.StructField("P", T.ArrayType(player))]
    )
    named = F.transform("P", lambda p: F.struct(p["_Side"].alias("_side"), p["_Id"].alias("_player"), p["_X"].alias("_x"), p["_Y"].alias("_y")))
    df = files.read_tracking_xml(spark, str(tmp_path), "Frame", schema, named, {"frame": F.col("_N"), "ball_x": F.col("_BallX"), "ball_y": F.col("_BallY")})
    rows = layouts.positions(df).orderBy("frame", "player").collect()
    assert [(r.frame, r.side, r.player, r.x, r.y) for r in rows] == [(1, "home", "7", 0.5, 1.0), (1, "away", "9", -3.0, 2.5), (2, "home", "7", 0.6, 1.1)]


def test_events_xml_is_flipped(spark, tmp_path):
    (tmp_path / "e.xml").write_text(EVENTS)
    start = T.StructType([T.StructField("_X", T.DoubleType()), T.StructField("_Y", T.DoubleType())])
    schema = T.StructType([T.StructField("_EventId", T.StringType()), T.StructField("_Kind", T.StringType()), T.StructField("Start", start)])
    fields = {"event_id": F.col("_EventId"), "event_type": F.col("_Kind"), "coordinates_x": F.col("Start._X"), "coordinates_y": F.col("Start._Y")}
    rows = {r.event_id: (r.coordinates_x, r.coordinates_y) for r in files.read_events_xml(spark, str(tmp_path), "Event", schema, fields).collect()}
    assert rows == {"12_a": (-1.0, -2.0), "13": (4.0, -0.5)}


def test_shots_json(spark, tmp_path):
    events = [
        {"type": {"name": "Shot"}, "location": [120.0, 40.0], "shot": {"outcome": {"name": "Goal"}}, "other": 1},
        {"type": {"name": "Shot"}, "location": None, "shot": {"outcome": {"name": "Saved"}}},
        {"type": {"name": "Pass"}, "location": [1.0, 2.0]},
    ]
    (tmp_path / "e.json").write_text(json.dumps(events, indent=1))
    rows = files.read_shots_json(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in rows] == [(105.0, 34.0, True)]


def test_append_grows_and_replace_keeps_other_matches(spark, tmp_path):
    path = str(tmp_path / "t")
    files.append_table(spark.createDataFrame([("a", 1), ("b", 2)], "match_id string, v int"), path)
    files.append_table(spark.createDataFrame([("c", 3, "x")], "match_id string, v int, extra string"), path)
    rows = {r.match_id: (r.v, r.extra) for r in files.read_table(spark, path).collect()}
    assert rows == {"a": (1, None), "b": (2, None), "c": (3, "x")}
    files.replace_matches(spark.createDataFrame([(9, "y", "b")], "v int, extra string, match_id string"), path)
    rows = {r.match_id: (r.v, r.extra) for r in files.read_table(spark, path).collect()}
    assert rows == {"a": (1, None), "b": (9, "y"), "c": (3, "x")}


def test_alive_and_match_scans(spark):
    df = spark.createDataFrame([("r1", "alive", 1), ("r1", "dead", 2), ("r2", "alive", 3)], "unique_match_id string, ball_status string, frame int")
    assert [r.frame for r in files.match_frames(df, "r1").collect()] == [1]
    assert files.match_frames(df.drop("ball_status"), "r1").count() == 2


def test_audit_csv(spark, tmp_path):
    path = str(tmp_path / "audit")
    files.write_audit_csv(spark.createDataFrame([(1, "mid-block")], "frame int, phase string"), path)
    assert spark.read.option("header", True).csv(path).first().phase == "mid-block"


def test_wide_layout(spark):
    df = spark.createDataFrame([(1, 0.1, 0.2, float("nan"), 0.4, 9.0)], "frame int, home_10_x double, home_10_y double, away_3_x double, away_3_y double, home_score double")
    out = layouts.from_wide(df)
    assert out.columns == ["frame", "home_score", "players"]
    assert [tuple(p) for p in out.first().players] == [("away", "3", None, 0.4), ("home", "10", 0.1, 0.2)]


def test_stored_table_survives_in_shared_folder(spark):
    df = stored(spark.range(10).withColumn("a", F.array("id")))
    assert df.count() == 10 and all(shared_folder(spark).split(":")[-1] in f for f in df.inputFiles())


def test_recommendation_round_trip(spark, tmp_path):
    fvf = spark.createDataFrame(
        [("p", "mid-block", "low-block", "4-4-2", "4-3-3", 9, 0.7, 0.4), ("p", "mid-block", "low-block", "3-5-2", "4-3-3", 6, 0.6, 0.5), ("p", "mid-block", "low-block", None, "4-3-3", 2, 0.5, 0.5)],
        "provider string, phase_home string, phase_away string, home_form string, away_form string, pairs long, home_strength double, away_strength double",
    )
    contexts = spark.createDataFrame([("p", "home", "4-3-3", "low-block")], "provider string, our_side string, opponent_form string, opponent_phase string")
    out = recommend.recommend(fvf, contexts, recommend.fallback_classes(spark), knowledge.counters_edges(fvf), strategies=("attack",))
    path = str(tmp_path / "recos")
    recommend.to_rows(out).withColumn("created_at", F.lit(1)).write.parquet(path)
    back = spark.read.parquet(path)
    row = out.first()
    assert row.recommended_formation == "4-4-2" and abs(sum(e.score for e in row.evidence.fusion.fused_scores) - 1) < 1e-9
    sections = {r.section for r in recommend.evidence_rows(back, ["provider"]).collect()}
    assert sections == {"prior", "model", "fused", "opponent_tag", "our_tag"}
    tags = knowledge.exhibits_edges(back)
    assert {r.dst_key for r in tags.collect()} == {"mid_block"} and {r.src_key for r in tags.collect()} == {"4-3-3|low-block"}
    nodes = {(r.kind, r.key) for r in knowledge.exhibits_nodes(tags).collect()}
    assert nodes == {("TeamPhase", "4-3-3|low-block"), ("StyleTag", "mid_block")}
