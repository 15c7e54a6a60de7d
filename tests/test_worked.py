"""Hand-worked frames and property checks."""

import itertools
import math
import os
import random
import subprocess
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from touchline.functions import coords, events, shapes
from touchline.operators import formations as fm
from touchline.operators import joins, knowledge, masks, metrics, models, passgraph, rasters, recommend
from touchline.operators.quantiles import exact_quantiles
from touchline.operators.sequences import number_rows
from touchline.session import stored

KEYS = ["match_id", "period_id"]


def possession(spark, values):
    rows = [("m", 1, i, p) for i, p in enumerate(values, 1)]
    return number_rows(spark.createDataFrame(rows, "match_id string, period_id int, frame long, team_possession string"), KEYS, "frame")


def test_changes_skip_unknown(spark):
    out = masks.possession_changes(possession(spark, ["home", None, "away", "home"])).orderBy("frame").collect()
    assert [r.changed for r in out] == [False, False, False, True]
    steps = masks.possession_steps(possession(spark, ["home", None, "away", "home"])).orderBy("frame").collect()
    assert sum(r.to_home for r in steps) == 1


def test_recovery_rows(spark):
    steps = masks.possession_steps(possession(spark, ["home", "away", "away", "home"])).orderBy("frame").collect()
    assert [r.home_gap for r in steps] == [None, None, None, 2]


def test_full_window_needs_thirteen(spark):
    for n, want in ((13, [7]), (12, [])):
        df = possession(spark, ["home"] * n).withColumn("ok", F.lit(True))
        assert [r.frame for r in masks.full_windows(df, "ok").where("full_window").collect()] == want


def test_quantiles(spark):
    df = spark.createDataFrame([("g", v) for v in (1.0, 2.5, 3.0, 7.0, 11.0)], "g string, v double")
    row = exact_quantiles(df, ["g"], "v", {"a": 0.05, "b": 0.1, "c": 0.9, "d": 0.95}).first()
    assert np.allclose([row.a, row.b, row.c, row.d], [1.3, 1.6, 9.4, 10.2])


def test_quantiles_against_numpy(spark):
    rng = np.random.default_rng(1)
    data = {"heavy": np.where(rng.random(3000) < 0.6, 1.25, rng.lognormal(0, 3, 3000)), "flat": np.full(50, 2.0), "two": np.array([1.0, 5.0])}
    df = spark.createDataFrame([(k, float(x)) for k, v in data.items() for x in v], "g string, v double")
    for limits in ({}, {"bins": 16, "ranked_rows": 20}):
        got = {r.g: r for r in exact_quantiles(df, ["g"], "v", {"p5": 0.05, "p50": 0.5, "p95": 0.95}, **limits).collect()}
        for k, v in data.items():
            assert np.allclose([got[k].p5, got[k].p50, got[k].p95], np.quantile(v, [0.05, 0.5, 0.95]))


def points(spark, pts):
    return spark.createDataFrame([(1, [(float(x), float(y)) for x, y in pts])], "id int, pts array<struct<x:double,y:double>>")


def test_line_counts(spark):
    df = points(spark, [(0, y) for y in range(10)])
    row = df.select(*[shapes.line_counts(F.col("pts"), k).alias(f"l{k}") for k in (3, 4, 5)], shapes.best_counts(F.col("pts")).alias("best")).first()
    assert (row.l3, row.l4, row.l5, row.best) == ([4, 3, 3], [3, 2, 2, 3], [2, 2, 2, 2, 2], [2, 2, 2, 2, 2])


def test_gap_counts(spark):
    df = points(spark, [(0, y) for y in (0, 1, 2, 3, 20, 21, 22, 23, 50, 51)])
    assert df.select(shapes.gap_counts(F.col("pts"), 3).alias("c")).first().c == [4, 4, 2]


def test_projection(spark):
    df = spark.createDataFrame([([2, 2, 2, 2, 2], "Attacking-Play"), ([4, 4, 2], "unknown")], "c array<int>, phase string")
    assert [r.formation for r in fm.project_to_allowed(df, "c", "phase").collect()] == ["2-3-2-3", "4-4-2"]


def eigen_distance(m1, m2, c2):
    w, v = np.linalg.eigh(c2)
    root = (v * np.sqrt(np.clip(w, 0, None))) @ v.T
    w2, _ = np.linalg.eigh(root @ (np.eye(2) * 0.5) @ root)
    return float((m1 - m2) @ (m1 - m2) + np.trace(np.eye(2) * 0.5 + c2) - 2 * np.sqrt(np.clip(w2, 0, None)).sum())


def test_gaussian_distance(spark):
    rng = np.random.default_rng(0)
    rows, want = [(0.0, 0.0, 0.0, 0.0, 0.5, 0.0, 0.5)], [0.0]
    for _ in range(50):
        a = rng.normal(size=(2, 2))
        c, m1, m2 = a @ a.T, rng.normal(size=2), rng.normal(size=2)
        rows.append(tuple(map(float, (*m1, *m2, c[0, 0], c[0, 1], c[1, 1]))))
        want.append(eigen_distance(m1, m2, c))
    df = spark.createDataFrame(rows, "ax double, ay double, bx double, by double, xx double, xy double, yy double").coalesce(1)
    got = [r.d for r in df.select(shapes.bures(*[F.col(c) for c in df.columns]).alias("d")).collect()]
    assert np.allclose(got, want, atol=1e-9) and min(got) > -1e-9


def test_pixel_rounds_half_to_even(spark):
    assert spark.range(1).select(coords.pixel(F.lit(0.5), 105).alias("p")).first().p == 52


def test_assignment_is_minimal():
    rng = np.random.default_rng(3)
    costs = rng.random((20, 5, 5))
    total, columns = fm.best_assignments(costs)
    for c, t, cols in zip(costs, total, columns):
        best = min(sum(c[i, p[i]] for i in range(5)) for p in itertools.permutations(range(5)))
        assert math.isclose(best, t) and sorted(cols) == list(range(5)) and math.isclose(c[np.arange(5), cols].sum(), t)


def test_chain_order_is_a_permutation(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, [tuple(map(float, p)) for p in rng.normal(size=(9, 2))]) for i in range(20)], "id int, pts array<struct<x:double,y:double>>")
    for r in df.select("pts", shapes.chain_order(F.col("pts")).alias("o")).collect():
        assert sorted(r.o) == list(range(9)) and r.pts[r.o[-1]].x >= r.pts[r.o[0]].x


def test_canonical_outfield_sizes(spark):
    rng = np.random.default_rng(5)
    for n, want in ((10, None), (11, 10), (12, 10), (16, 10)):
        df = points(spark, rng.normal(size=(n, 2)))
        out = df.select(shapes.canonical_outfield(F.col("pts")).alias("p")).first().p
        assert (len(out) if out else None) == want


def test_clusters_find_separate_shapes(spark):
    rng = np.random.default_rng(6)
    base = [rng.normal(scale=20, size=(10, 2)) for _ in range(3)]
    rows = [("g", 0, i, [tuple(map(float, p)) for p in base[i % 3] + rng.normal(scale=0.1, size=(10, 2))]) for i in range(18)]
    df = spark.createDataFrame(rows, "g string, segment long, block_id long, pts array<struct<x:double,y:double>>")
    out = fm.cluster_blocks(df, ["g"], ["segment", "block_id"], k_max=5).collect()
    assert {r.block_id % 3: r.cluster_label for r in out} == {0: 0, 1: 1, 2: 2}
    assert len(out) == 18 and sum(r.is_medoid for r in out) == 3 and all(r.silhouette > 0.9 for r in out)


def test_small_groups_cluster(spark):
    rows = [("one", 0, 1, [(0.0, 0.0), (1.0, 1.0)])] + [("two", 0, i, [(float(i), 0.0), (1.0, 1.0)]) for i in (1, 2)]
    df = spark.createDataFrame(rows, "g string, segment long, block_id long, pts array<struct<x:double,y:double>>")
    out = {(r.g, r.block_id): r.cluster_label for r in fm.cluster_blocks(df, ["g"], ["segment", "block_id"]).collect()}
    assert out == {("one", 1): 0, ("two", 1): 0, ("two", 2): 1}


@pytest.mark.parametrize("copies", [1, 2, 30])
def test_clusters_do_not_depend_on_size(spark, copies):
    """Three shapes stay three clusters however often their blocks are repeated."""
    rng = np.random.default_rng(9)
    base = [rng.normal(scale=20, size=(10, 2)) for _ in range(3)]
    shapes = [base[i % 3] + rng.normal(scale=0.1, size=(10, 2)) for i in range(15)]
    rows = [("g", c * 15 + i, [tuple(map(float, p)) for p in x[rng.permutation(10)]]) for c in range(copies) for i, x in enumerate(shapes)]
    df = spark.createDataFrame(rows, "g string, block_id long, pts array<struct<x:double,y:double>>")
    out = fm.cluster_blocks(df, ["g"], ["block_id"], k_max=5).collect()
    assert {(r.block_id % 3, r.cluster_label, r.n_blocks_in_cluster) for r in out} == {(i, i, 5 * copies) for i in range(3)}
    assert len(out) == 15 * copies and sum(r.is_medoid for r in out) == 3 and all(r.silhouette > 0.9 for r in out)


def test_role_template_of_few_points(spark):
    from touchline.operators.blocks import role_templates

    rows = [("b", 1, 2.0, 3.0), ("b", 2, None, None), ("b", 3, 1.0, 1.0), ("b", 3, 3.0, 2.0)]
    got = {r.player: r for r in role_templates(spark.createDataFrame(rows, "b string, player int, x double, y double"), ["b"]).collect()}
    assert (got[1].mu_x, got[1].cov_xx, got[1].cov_xy) == (2.0, 1e-6, 0.0)
    assert (got[2].mu_x, got[2].mu_y, got[2].cov_yy) == (0.0, 0.0, 1e-6)
    assert (got[3].cov_xx, got[3].cov_xy, got[3].cov_yy) == (2.0, 1.0, 0.5)


def test_touching_intervals(spark):
    h = spark.createDataFrame([("k", 1, 0, 100)], "k string, block_id int, start_frame long, end_frame long")
    a = spark.createDataFrame([("k", 2, 100, 300)], "k string, block_id int, start_frame long, end_frame long")
    assert joins.interval_pairs(h, a, ["k"], 1).count() == 1
    assert joins.interval_pairs(h, a, ["k"], 2).count() == 0


def test_interval_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(7)

    def side():
        s = rng.integers(0, 20000, 60)
        return [("k", i, int(x), int(x + rng.integers(0, 9000))) for i, x in enumerate(s)]

    h, a = side(), side()
    schema = "k string, block_id int, start_frame long, end_frame long"
    got = {
        (r.home_block_id, r.away_block_id, r.pair_start, r.pair_end)
        for r in joins.interval_pairs(spark.createDataFrame(h, schema), spark.createDataFrame(a, schema), ["k"], 250).collect()
    }
    want = {
        (x[1], y[1], max(x[2], y[2]), min(x[3], y[3])) for x in h for y in a if min(x[3], y[3]) - max(x[2], y[2]) + 1 >= 250
    }
    assert got == want


def test_nested_blocks_all_pair(spark):
    schema = "k string, block_id int, start_frame long, end_frame long"
    h = spark.createDataFrame([("k", 1, 0, 5000), ("k", 2, 1000, 2000)], schema)
    a = spark.createDataFrame([("k", 3, 0, 6000), ("k", 4, 5200, 6000)], schema)
    assert joins.interval_pairs(h, a, ["k"], 250).count() == 2


def test_nearest_in_time(spark):
    rng = np.random.default_rng(8)
    frames = sorted(int(t) for t in rng.integers(0, 300_000, 80))
    events = sorted(int(t) for t in rng.integers(0, 300_000, 60))
    f = spark.createDataFrame([("m", i, t) for i, t in enumerate(frames)], "m string, frame long, ms long").withColumn("ts", F.timestamp_millis("ms"))
    e = spark.createDataFrame([("m", i, t) for i, t in enumerate(events)], "m string, event_id long, ms long").withColumn("ts", F.timestamp_millis("ms"))
    out = joins.nearest_in_time(f.drop("ms"), e.drop("ms"), ["m"], 1.0, span_seconds=5.0)
    got = {r.event_id: r.offset_us for r in out.collect()}
    for i, t in enumerate(events):
        d = min((abs(x - t), x - t) for x in frames)
        want = d[0] if d[0] <= 1000 else None
        assert (None if got[i] is None else abs(got[i]) / 1000) == want


def test_softmax_and_priors(spark):
    row = spark.range(1).select(rasters.softmax(F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))).alias("p")).first()
    assert np.allclose(row.p, [1 / 3] * 3)
    contexts = spark.createDataFrame([("p", "home", "4-4-2", "mid-block")], "provider string, our_side string, opponent_form string, opponent_phase string")
    counters = spark.createDataFrame(
        [("p", "a", "4-4-2", "mid-block", 0.0), ("p", "b", "4-4-2", "mid-block", 0.0), ("q", "c", "4-4-2", "low-block", 9.0)],
        "provider string, candidate string, opponent string, phase string, support double",
    )
    out = knowledge.kg_prior(contexts, counters, passgraph.CONTEXT).collect()
    assert {r.candidate: r.prior for r in out} == {"a": 0.5, "b": 0.5} and {r.tier for r in out} == {1}


@pytest.mark.parametrize(
    "phase,provider,tier,names",
    [("mid block", "p", 1, {"a"}), ("low_block", "p", 2, {"b"}), ("other", "p", 3, {"a"}), ("other", "zz", 4, {"a", "b"}), ("other", None, 3, {"a", "b"})],
)
def test_prior_fallback(spark, phase, provider, tier, names):
    contexts = spark.createDataFrame([(provider, "home", "4-4-2", phase)], "provider string, our_side string, opponent_form string, opponent_phase string")
    counters = spark.createDataFrame(
        [("p", "a", "4-4-2", "mid-block", 1.0), ("q", "b", "4-4-2", "low-block", 2.0)],
        "provider string, candidate string, opponent string, phase string, support double",
    )
    out = knowledge.counter_options(contexts, counters, passgraph.CONTEXT).collect()
    assert {r.candidate for r in out} == names and {r.tier for r in out} == {tier}


def test_flags_and_ids(spark):
    df = spark.createDataFrame([("12.0", "12_a", "Goal Kick", "0.0"), ("1.05", "x1", None, "yes")], "a string, b string, label string, s string")
    rows = df.select(
        events.clean_number_id("a").alias("a"), events.leading_digits("b").alias("b"), events.is_set_piece("label").alias("sp"), events.goal_flag("s", None).alias("g")
    ).collect()
    assert [tuple(r) for r in rows] == [("12", "12", True, False), ("1.05", None, False, True)]


def test_same_value(spark):
    df = spark.createDataFrame([(7,), (8,)], "team_id int")
    assert df.where(events.same_value("team_id", "7")).count() == 1
    assert df.where(events.same_value("team_id", None)).count() == 2


def test_quick_strength_ignores_unknown(spark):
    row = spark.range(1).select(metrics.quick_strength(F.lit(1.0), F.lit(None).cast("double"), F.lit(0.0)).alias("q")).first()
    assert row.q == 0.5


def test_update_keeps_unstaged(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    s = spark.createDataFrame([(2, "c", 5)], "k int, v string, n int")
    assert {tuple(r) for r in joins.update_from_stage(t, s, ["k"]).collect()} == {(1, "a", None), (2, "c", 5)}


def test_merge_spreads_missing_ids(spark):
    f = spark.createDataFrame([("r", 1, "10.0"), ("r", 2, None), ("r", 3, "11")], "unique_match_id string, frame int, original_event_id string")
    e = spark.createDataFrame(
        [("r", "10_x", 1, "Pass", "alive"), ("r", "10_y", 2, "Shot", "alive"), ("r", "11", 3, "Foul", "dead")],
        "unique_match_id string, event_id string, n int, event_type string, ball_state string",
    )
    out = {r.frame: r.event_type for r in joins.merge_frames_events(f, e, order=["n"]).collect()}
    assert out == {1: "Pass", 2: None, 3: None}


def test_xg_coefficients_fall_with_distance(spark):
    rng = np.random.default_rng(9)
    x, y = rng.uniform(60, 105, 600), rng.uniform(10, 58, 600)
    goal = rng.random(600) < np.exp(-np.hypot(105 - x, 34 - y) / 12)
    shots = spark.createDataFrame([(float(a), float(b), bool(g)) for a, b, g in zip(x, y, goal)], "coordinates_x double, coordinates_y double, is_goal boolean")
    model = models.fit_xg(shots)
    scored = models.score_xg(model, shots)
    close, far = (scored.where(c).agg(F.avg("xg")).first()[0] for c in ("distance < 10", "distance > 30"))
    assert close > 2 * far and len(models.xg_coefficients(model)) == 3


def test_style_tags(spark):
    df = spark.createDataFrame([(5.0, 0.5, 25.0, 20.0, "bad")], "opp_ppda double, opp_press_rate double, opp_width double, opp_depth double, opp_xt string")
    tags = df.select(recommend.style_tags("opp_", columns=df.columns).alias("t")).first().t
    assert tags == ["compact_block", "high_block", "high_pressing", "press_triggers_often"]


def test_user_models_score_in_tasks(spark):
    df = spark.createDataFrame([(1, [0, 5]), (2, [7140])], "id int, cells array<int>")
    out = {r.id: list(r.logits) for r in rasters.score_rasters(df, lambda image: image.sum(axis=(2, 3))).collect()}
    assert out == {1: [2.0, 0.0, 0.0], 2: [0.0, 1.0, 0.0]}
    nodes = spark.createDataFrame([("t", 1, 1, 0, 1.0, 0.0, 0.0, 0.1), ("t", 2, 0, 1, 0.0, 1.0, 1.0, 0.0)], "team string, player int, made int, received int, success_rate double, mean_x double, mean_y double, mean_length double")
    edges = spark.createDataFrame([("t", 1, 2, 1.0, 1.0, 0.1)], "team string, passer int, receiver int, share double, success_rate double, mean_length double")
    graphs = passgraph.graph_pack(nodes, edges, ["team"])
    row = passgraph.score_graphs(graphs, lambda gs: [[len(g["nodes"]), len(g["edges"])] for g in gs]).first()
    assert list(row.logits) == [2.0, 1.0] and (row.edges[0].source, row.edges[0].target) == (0, 1)


def test_block_labels_use_the_side_head(spark):
    frames = spark.createDataFrame(
        [("m", 1, f, [("home", "1", 0.5, 0.5), ("away", "2", None, 0.1)], 0.0, 0.0) for f in range(1, 30)],
        "match_id string, period_id int, frame long, players array<struct<side:string,player:string,x:double,y:double>>, ball_x double, ball_y double",
    )
    schema = "match_id string, period_id int, side string, block_id long, start_frame long, end_frame long"
    blocks = spark.createDataFrame([("m", 1, "home", 1, 1, 29), ("m", 1, "away", 2, 27, 29), ("m", 1, "away", 3, 900, 990)], schema)
    by = ["match_id", "period_id", "side", "block_id", "start_frame", "end_frame"]
    cells = rasters.block_rasters(blocks, frames, ["match_id", "period_id"], by)
    assert {r.block_id: sorted(r.cells) for r in cells.collect()} == {1: [34 * 105 + 52, 2 * 7140], 2: [34 * 105 + 52, 2 * 7140]}
    head = lambda image: np.tile([0.0, 2.0, 5.0, 1.0], (len(image), 1))
    out = rasters.label_blocks(cells, head, {"home": ["4-4-2", "4-3-3"], "away": ["3-5-2", "5-3-2"]}, ["side", "block_id"])
    assert {r.block_id: r.label for r in out.collect()} == {1: "4-3-3", 2: "3-5-2"}
    shapes_df = spark.createDataFrame([("g", 1), ("g", 2), ("g", 3)], "g string, block_id long")
    matches = spark.createDataFrame([("g", 1, "4-4-2", 0, 1.0, 90.0, 2), ("g", 2, "4-4-2", 0, 1.0, 10.0, 2)], "g string, block_id long, formation string, mirrored int, w2_cost double, w2_margin double, members long")
    gates = spark.createDataFrame([("g", 5.0, 50.0)], "g string, cost_limit double, margin_limit double")
    fallback = out.withColumn("g", F.lit("g"))
    got = {r.block_id: (r.predicted_formation, r.method) for r in fm.predict_formations(shapes_df, matches, gates, ["g"], ["block_id"], fallback=fallback).collect()}
    assert got[1] == ("4-4-2", "w2_hungarian_template") and got[2][0] == "3-5-2" and got[2][1].startswith("resnet_fallback_conf_0.9")
    assert got[3] == ("unknown", "resnet_fallback_conf_0.000")


def test_sample_is_repeatable(spark):
    df = spark.range(50).withColumn("k", F.col("id").cast("string"))
    a = [r.id for r in passgraph.sample_slices(df, 7, ["k"]).collect()]
    b = [r.id for r in passgraph.sample_slices(df.repartition(9), 7, ["k"]).collect()]
    assert a == b and len(set(a)) == 7


def test_node_upsert_keeps_newest_value(spark):
    schema = "kind string, key string, props map<string,string>"
    old = spark.createDataFrame([("F", "a", {"x": "1", "y": "1"}), ("F", "b", {})], schema)
    new = spark.createDataFrame([("F", "a", {"x": "2"}), ("F", "c", {"z": "9"})], schema)
    out = {r.key: r.props for r in knowledge.upsert_nodes(old, new).collect()}
    assert out == {"a": {"x": "2", "y": "1"}, "b": {}, "c": {"z": "9"}}


def test_candidates_fill_up_from_the_model(spark):
    fvf = spark.createDataFrame(
        [("p", "mid-block", "low-block", "b", "z", 9, 0.5, 0.5), ("p", "mid-block", "low-block", "d", "z", 2, 0.5, 0.5)],
        "provider string, phase_home string, phase_away string, home_form string, away_form string, pairs long, home_strength double, away_strength double",
    )
    context = ("p", "home", "z", "low-block")
    names = "provider string, our_side string, opponent_form string, opponent_phase string"
    contexts = spark.createDataFrame([context], names)
    classes = spark.createDataFrame(list(enumerate("abcdef")), "form_id int, form string")
    scores = spark.createDataFrame([(*context, f, s) for f, s in zip("abcdef", (0.1, 0.9, 0.3, 0.2, 0.8, 0.0))], names + ", form string, score double")
    out = {r.position: r.form for r in recommend.candidate_forms(fvf, contexts, classes, scores).collect()}
    assert out == {1: "b", 2: "e", 3: "c", 4: "d"}


def test_task_functions_need_no_installed_package(tmp_path):
    """What runs in the tasks is shipped whole: a plain interpreter elsewhere can load and call it."""
    path = tmp_path / "solve.bin"
    path.write_bytes(cloudpickle.dumps(fm._solve))
    code = (
        "import pickle, sys, pyarrow as pa\n"
        "solve = pickle.load(open(sys.argv[1], 'rb'))\n"
        "cost, columns = solve(pa.array([[1.0, 5.0, 2.0, 1.0], None], pa.list_(pa.float64())))\n"
        "assert cost.to_pylist() == [2.0, None] and columns.to_pylist() == [[0, 1], None]\n"
        "assert not any(m.startswith('touchline') for m in sys.modules)\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code, str(path)], cwd=tmp_path, env=env, check=True)


def test_points_on_cell_edges_belong_to_the_higher_cell(spark):
    """Every edge of the 30 x 20 cells, also after a change of domain and a stretch that put points on edges up to rounding."""
    from touchline.functions import coords
    from touchline.operators import panels

    edges = [(1, 105.0 * i / 30, 68.0 * j / 20) for i in range(31) for j in range(21)]
    df = spark.createDataFrame(edges, "m int, x double, y double")
    got = {(r.bin_x, r.bin_y): r.n for r in panels.density(df, ["m"]).collect()}
    assert got == {(i, j): (1 + (i == 29)) * (1 + (j == 19)) for i in range(30) for j in range(20)}
    # 21 points from end to end of the stretched part: steps of a whole number of cells along x
    line = spark.createDataFrame([(1, -0.8 + 1.6 * k / 17, -0.5 + k / 17) for k in range(18)], "m int, x double, y double")
    scaled = coords.auto_scale(line, ["m"], {"x": 105.0, "y": 68.0})
    bins = sorted((r.bin_x, r.bin_y) for r in panels.density(scaled, ["m"], bins_x=20, bins_y=20).collect())
    assert bins == [(int(1.5 + k + 1e-6), int(1.5 + k + 1e-6)) for k in range(18)]
    raw = {r.x: r.n for r in scaled.groupBy("x").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    assert min(raw) == 105 * 0.075 and abs(max(raw) - 105 * 0.925) < 1e-9


def test_quantiles_read_their_input_until_it_is_narrowed(spark):
    """The last pass reads the few values inside the ranges; atoms, two zeros and skew are settled by counts."""
    rng = random.Random(8)
    values = {"even": [rng.random() for _ in range(4000)], "atoms": [float(rng.choice([0, 0, 0, 7])) for _ in range(3000)]}
    values |= {"zeros": [-0.0, 0.0] * 300, "skew": [10.0 ** rng.randint(-3, 3) * rng.random() for _ in range(3000)]}
    df = stored(spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs], "g string, v double"))
    out = exact_quantiles(df, ["g"], "v", {"lo": 0.05, "hi": 0.95}, bins=64, ranked_rows=200)
    assert not set(df.inputFiles()) & set(out.select("lo").where("lo < hi").inputFiles())
    got = {r.g: r for r in out.collect()}
    for g, vs in values.items():
        vs = sorted(vs)
        for name, p in (("lo", 0.05), ("hi", 0.95)):
            at = (len(vs) - 1) * p
            a, b = vs[int(at)], vs[min(int(at) + 1, len(vs) - 1)]
            want = a if a == b else a + (b - a) * (at - int(at))
            assert abs(got[g][name] - want) <= 1e-12 * max(1.0, abs(want)), (g, name)
    assert str(got["zeros"].lo) == "0.0"


def test_equal_strength_is_plain_arithmetic(spark):
    """Missing metrics count as their column's mean; nothing is gathered in arrays row by row."""
    rows = [(0.0, 10.0, None), (1.0, None, None), (2.0, 30.0, None), (None, 20.0, None)]
    df = spark.createDataFrame(rows, "home_xg double, home_ppda double, home_xt double")
    for s in ("xg", "ppda"):
        df = df.withColumn(f"away_{s}", F.col(f"home_{s}"))
    out = metrics.equal_strength(stored(df))
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString().split("\n")[0]
    got = [r.home_strength_eq for r in out.orderBy(F.col("home_xg").asc_nulls_last()).collect()]
    # scaled between 0.1 and 1.9 and between 11 and 29; both means are a half; the column without values is left out
    want = [(0 + 1) / 2, (0.5 + 0.5) / 2, (1 + 0) / 2, (0.5 + 0.5) / 2]
    assert all(abs(a - b) < 1e-9 for a, b in zip(got, want)), got
