"""Chunked sequence operators against plain Python loops."""

import random

import pytest
from pyspark.sql import functions as F

from touchline.config import PROVIDERS
from touchline.operators import blocks, masks, metrics
from touchline.operators.sequences import next_order, number_rows, running_max


def make_rows(seed, n=180):
    rng = random.Random(seed)
    rows, frame = [], 0
    for match in ("a", "b"):
        frame = 0
        for _ in range(n if match == "a" else 9):
            frame += rng.choice([1, 1, 1, 2, 40])
            rows.append(
                (match, 1, frame, rng.choice(["home", "home", "away", None]), rng.choice(["x", "x", "x", "y", None]),
                 rng.choice(["y", "z", "z"]), rng.choice([None, None, None, "Pass", "Tackle", "ThrowIn", "SavedShot"]))
            )
    return rows


SCHEMA = "match_id string, period_id int, frame long, team_possession string, phase_home string, phase_away string, original_event string"


@pytest.fixture(params=[1, 2])
def rows(request):
    return make_rows(request.param)


@pytest.fixture()
def df(spark, rows):
    return number_rows(spark.createDataFrame(rows, SCHEMA).repartition(5), ["match_id", "period_id"], "frame")


def by_match(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return {m: sorted(v, key=lambda r: r[2]) for m, v in out.items()}


def test_number_rows(small_chunks, spark, rows, df):
    got = {(r.match_id, r.frame): r.rn for r in df.collect()}
    want = {(m, r[2]): i for m, v in by_match(rows).items() for i, r in enumerate(v, 1)}
    assert got == want


def loop_masks(v, pad, radius):
    n = len(v)

    def changes(i):
        s = [r[i] for r in v]
        return [k > 0 and s[k] is not None and s[k - 1] is not None and s[k] != s[k - 1] for k in range(n)]

    def after(flags):
        out = [False] * n
        for k, f in enumerate(flags):
            if f:
                for j in range(k, min(k + pad, n - 1) + 1):
                    out[j] = True
        return out

    trans, drop = after(changes(3)), after(changes(4))
    setp = [r[6] == "ThrowIn" for r in v]
    calm = [not a and not b for a, b in zip(trans, setp)]
    full = [radius <= k < n - radius and all(calm[k - radius : k + radius + 1]) for k in range(n)]
    elig = [c and r[4] is not None and not d for c, r, d in zip(calm, v, drop)]
    return trans, drop, full, elig


def test_masks_equal_loops(small_chunks, rows, df):
    got = {(r.match_id, r.frame): r for r in masks.frame_masks(df, pad=4, window_rows=5).collect()}
    assert len(got) == len(rows)
    for m, v in by_match(rows).items():
        for k, (t, d, f, e) in enumerate(zip(*loop_masks(v, 4, 2))):
            r = got[m, v[k][2]]
            assert (r.transition, r.drop3_home, r.full_window, r.eligible_home) == (t, d, f, e)


def test_single_masks_equal_combined(small_chunks, df):
    a = masks.mask_after_change(df, "team_possession", "t", 4)
    b = masks.frame_masks(df, pad=4)
    assert a.join(b, ["match_id", "frame"]).where("t <> transition").count() == 0


def loop_window(v, side):
    poss = [r[3] or "" for r in v]
    lost, gaps, wins = None, [], 0
    for i in range(1, len(poss)):
        if poss[i] != poss[i - 1]:
            if poss[i - 1] == side:
                lost = i
            elif poss[i] == side and lost is not None:
                gaps.append(i - lost)
                lost = None
            wins += poss[i] == side
    rival = "away" if side == "home" else "home"
    passes = sum(r[6] == "Pass" and p == rival for r, p in zip(v, poss))
    acts = sum(r[6] == "Tackle" and p == side for r, p in zip(v, poss))
    return 100 * poss.count(side) / len(v), (sum(gaps) / len(gaps) / 25 if gaps else None), passes / max(1, acts + wins)


def near(a, b):
    return (a is None and b is None) or (a is not None and b is not None and abs(a - b) < 1e-9)


def test_interval_metrics_equal_loops(small_chunks, spark, rows, df):
    facts = metrics.frame_facts(
        df.withColumns({"ball_x": F.lit(0.3), "ball_y": F.lit(0.6)}), (0.1, -0.1, 0.5), PROVIDERS["sportec"]
    )
    rng = random.Random(5)
    spans = []
    last = max(r[2] for r in rows)
    for i in range(40):
        a = rng.randrange(0, last)
        spans.append(("a", 1, i, a, a + rng.choice([0, 3, 60, 500, 2000])))
    intervals = spark.createDataFrame(spans, "match_id string, period_id int, id int, pair_start long, pair_end long")
    got = {
        r.id: r
        for r in metrics.interval_metrics(
            facts, intervals, ["match_id", "period_id"], ["match_id", "period_id", "id", "pair_start"], chunk=16
        ).collect()
    }
    a_rows = by_match(rows)["a"]
    for _, _, i, s, e in spans:
        v = [r for r in a_rows if s <= r[2] <= e]
        if not v:
            assert i not in got
            continue
        assert got[i].n_frames == len(v)
        for side in ("home", "away"):
            want = loop_window(v, side)
            have = (got[i][f"{side}_possession_pct"], got[i][f"{side}_recovery_s"], got[i][f"{side}_ppda"])
            assert all(near(x, y) for x, y in zip(have, want)), (i, side, have, want)


def test_recovery_points(small_chunks, rows, df):
    f = df.withColumns({"ball_x": F.lit(1.0), "ball_y": F.lit(1.0)})
    got = {(r.match_id, r.frame) for r in masks.recovery_points(f, "home").collect()}
    want = set()
    for m, v in by_match(rows).items():
        for a, b in zip(v, v[1:]):
            if b[3] == "home" and a[3] not in (None, "home"):
                want.add((m, b[2]))
    assert got == want


def test_recoveries_by_tag_or_team_id(small_chunks, spark, rows, df):
    """Match ``b`` holds team ids, all others side tags; both are found without being told."""
    ids = {"home": "T1", "away": "T2"}
    known = F.create_map(*[F.lit(x) for pair in ids.items() for x in pair])
    poss = F.when(F.col("match_id") == "b", known[F.col("team_possession")]).otherwise(F.upper("team_possession"))
    f = df.withColumns({"ball_x": F.lit(1.0), "ball_y": F.lit(1.0), "side": F.lit("clash"), "team_possession": poss})
    teams = [(m, s, i) for m in ("a", "b") for s, i in ids.items()] + [("b", "home", "t1"), ("b", None, "T2"), ("b", "away", None)]
    out = masks.recoveries(f, spark.createDataFrame(teams, "match_id string, side string, team_id string")).collect()
    want = sorted((m, b[2], b[3]) for m, v in by_match(rows).items() for a, b in zip(v, v[1:]) if None not in (a[3], b[3]) and b[3] in ids and a[3] != b[3])
    assert sorted((r.match_id, r.frame, r.side) for r in out) == want and any(m == "b" for m, *_ in want)


def test_recoveries_of_nothing(spark, df):
    f = df.withColumns({"ball_x": F.lit(1.0), "ball_y": F.lit(1.0)})
    teams = spark.createDataFrame([], "match_id string, side string, team_id string")
    assert masks.recoveries(f.where("false"), teams).collect() == []
    assert masks.recoveries(f.withColumn("team_possession", F.lit(None).cast("string")), teams).collect() == []


def test_running_max_and_next_order(small_chunks, spark):
    df = spark.createDataFrame([("k", i) for i in (0, 3, 4, 50, 51, 300)], "k string, o long")
    out = next_order(df, ["k"], "o", "n").orderBy("o").collect()
    assert [r.n for r in out] == [3, 4, 50, 51, 300, None]
    numbered = number_rows(df, ["k"], "o")
    got = running_max(numbered, ["k"], {"m": F.when(F.col("o") % 3 == 0, F.col("o"))}).orderBy("o").collect()
    assert [r.m for r in got] == [0, 3, 3, 3, 51, 300]


def loop_blocks(cuts, n, tiny):
    cuts = sorted({0, *cuts}) + [n]
    merged = []
    for a, b in zip(cuts, cuts[1:]):
        if merged and b - a < tiny:
            merged[-1][1] = b - 1
        else:
            merged.append([a, b - 1])
    return [tuple(m) for m in merged]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_blocks_from_cuts(small_chunks, spark, seed):
    rng = random.Random(seed)
    n = 200
    cuts = sorted(rng.sample(range(1, n), 25))
    frame = spark.createDataFrame([("k", c) for c in cuts], "k string, cut long")
    lengths = spark.createDataFrame([("k", n)], "k string, n_rows long")
    got = sorted((r.start_row, r.end_row) for r in blocks.blocks_from_cuts(frame, lengths, ["k"], 6).collect())
    assert got == loop_blocks(cuts, n, 6)
    rows = spark.createDataFrame([("k", i + 1) for i in range(n)], "k string, rn long")
    placed = blocks.assign_blocks(rows, blocks.blocks_from_cuts(frame, lengths, ["k"], 6), ["k"]).collect()
    assert all(any(a == r.start_row and a <= r.rn - 1 <= b for a, b in got) for r in placed)


def test_rolling_means_across_chunks(small_chunks, spark):
    rng = random.Random(0)
    pts = [("k", p, i, None if rng.random() < 0.2 else rng.random(), rng.random()) for p in (1, 2) for i in range(1, 61)]
    pts = [(k, p, i, x, None if x is None else y) for k, p, i, x, y in pts]
    df = spark.createDataFrame(pts, "k string, player int, rn long, x double, y double")
    got = {(r.player, r.rn): r.mean_x for r in blocks.rolling_means(df, ["k"], 9).collect()}
    for p in (1, 2):
        xs = [r[3] for r in pts if r[1] == p]
        for i in range(60):
            known = [x for x in xs[max(0, i - 8) : i + 1] if x is not None]
            assert near(got[p, i + 1], sum(known) / len(known) if known else None)
