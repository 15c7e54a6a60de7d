"""The whole analysis on generated matches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.operators import joins, metrics
from touchline.plans import analysis as an
from touchline.sources.layouts import positions

XG = (0.1, -0.1, 0.5)
SETTINGS = an.Settings(fps=5, pad_rows=3, rolling_rows=40, shift_metres=7.0, tiny_rows=10, min_block_seconds=8, min_overlap_frames=20)
SCHEMA = (
    "provider string, match_id string, period_id long, frame long, team_possession string, original_event string, "
    "players array<struct<side:string,player:string,x:double,y:double>>, ball_x double, ball_y double, phase_home string, phase_away string"
)


def generate(matches=2, frames=500):
    rng = np.random.default_rng(0)
    base = {s: [rng.uniform(0.1, 0.9, size=(11, 2)) for _ in range(2)] for s in ("home", "away")}
    rows = []
    for m in range(matches):
        for period in (1, 2):
            for f in range(1, frames + 1):
                players = []
                for side in ("home", "away"):
                    shape = base[side][0 if f < 260 else 1] + rng.normal(scale=0.005, size=(11, 2))
                    for p, (x, y) in enumerate(shape):
                        missing = (f + p) % 97 == 0
                        players.append((side, f"{p:02d}", None if missing else float(x), None if missing else float(y)))
                poss = ["home", "away", None][(f // 37) % 3]
                event = {0: "Pass", 1: "Tackle", 2: "SavedShot", 3: "ThrowIn"}.get(f % 23)
                phase = "mid-block" if f < 480 else "low-block"
                rows.append(("sportec", f"m{m}", period, f, poss, event, players, float(rng.random()), float(rng.random()), phase, "build-up"))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    frames = spark.createDataFrame(generate(), SCHEMA)
    return an.analyse_matches(frames, XG, SETTINGS)


def test_templates_cover_both_shapes(tables):
    blocks = tables["templates"].select(*an.BLOCK, "block_start_frame", "block_end_frame", "num_frames").distinct().collect()
    per = {}
    for b in blocks:
        per.setdefault((b.match_id, b.period_id, b.side), []).append(b)
    assert len(per) == 8 and all(len(v) >= 2 for v in per.values())
    for v in per.values():
        spans = sorted((b.block_start_frame, b.block_end_frame) for b in v)
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_orders_are_permutations(tables):
    out = tables["templates"].groupBy(*an.BLOCK).agg(
        F.sort_array(F.collect_list("role_index")).alias("a"), F.sort_array(F.collect_list("orig_role_index")).alias("b")
    )
    assert all(r.a == list(range(1, 12)) and r.b == r.a for r in out.collect())


def test_every_block_gets_a_prediction(tables):
    n = tables["templates"].select(*an.BLOCK).distinct().count()
    assert tables["predictions"].count() == n
    for r in tables["predictions"].collect():
        assert r.predicted_formation and r.w2_cost >= -1e-6 and r.w2_margin >= 0
        assert r.method == "w2_hungarian_template" or r.method == "resnet_fallback_conf_0.000"


def test_pair_metrics_equal_direct_aggregation(spark, tables):
    pairs = tables["pairs"]
    assert pairs.count() > 0
    metre = F.transform("players", lambda p: p.withField("x", (p["x"] - 0.5) * 105).withField("y", (p["y"] - 0.5) * 68))
    facts = metrics.frame_facts(tables["frames"].withColumn("players", metre).drop("phase_home", "phase_away"), XG, keys=an.SEQUENCE)
    spans = an.block_pairs(tables["templates"], tables["predictions"], SETTINGS)
    rows = joins.frames_in_intervals(facts, spans, an.SEQUENCE)
    start = F.col("pair_start")
    aggs = {}
    for s in metrics.SIDES:
        for part in (metrics.threat_metrics(s), metrics.possession_metrics(s, start), metrics.ppda_metric(s, start), metrics.pressure_metrics(s), metrics.spacing_means(s)):
            aggs |= part
    want = {tuple(r[c] for c in an.PAIR): r for r in rows.groupBy(*an.PAIR).agg(*[c.alias(n) for n, c in aggs.items()]).collect()}
    got = {tuple(r[c] for c in an.PAIR): r for r in pairs.collect()}
    assert set(got) == set(want)
    for k, r in got.items():
        for n in aggs:
            a, b = r[n], want[k][n]
            assert (a is None and b is None) or abs(a - b) < 1e-9, (k, n, a, b)


def test_matchups_count_all_pairs(tables):
    total = tables["matchups"].agg(F.sum("pairs")).first()[0]
    assert total == tables["pairs"].count()
    assert {"home_strength", "away_width", "home_avg_press"} <= set(tables["matchups"].columns)


def test_same_result_at_one_partition(spark, tables):
    first = sorted(map(str, tables["matchups"].select("phase_home", "phase_away", "home_form", "pairs", F.round("home_strength", 9)).collect()))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        again = an.analyse_matches(spark.createDataFrame(generate(), SCHEMA), XG, SETTINGS)["matchups"]
        second = sorted(map(str, again.select("phase_home", "phase_away", "home_form", "pairs", F.round("home_strength", 9)).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert first == second


def test_positions_keep_all_players(tables):
    f = tables["frames"]
    assert positions(f).count() == 22 * f.count()
