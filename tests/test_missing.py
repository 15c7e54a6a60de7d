"""Missing and infinite values: NULL keys stay, NaN counts as missing, infinities keep their ranks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.operators import blocks, sequences
from touchline.operators.quantiles import exact_quantiles
from touchline.sources import files


def test_null_keys_are_keys(spark, small_chunks):
    rows = [(m, p, f, "home" if f % 3 else "away") for m, p in ((1, 1), (None, 1), (1, None), (None, None)) for f in range(25)]
    df = spark.createDataFrame(rows, "match_id long, period_id long, frame long, team string")
    keys = ["match_id", "period_id"]
    numbered = sequences.number_rows(df, keys, "frame")
    assert {(r.match_id, r.period_id, r.frame): r.rn for r in numbered.collect()} == {(m, p, f): f + 1 for m, p, f, _ in rows}
    so_far = sequences.running_max(numbered, keys, {"last": F.when(F.col("team") == "away", F.col("rn"))})
    assert {(r.match_id, r.period_id, r.rn, r.last) for r in so_far.collect()} == {(m, p, f + 1, f - f % 3 + 1) for m, p, f, _ in rows}
    following = sequences.next_order(df, keys, "frame", "following").collect()
    assert {(r.match_id, r.period_id, r.frame, r.following) for r in following} == {(m, p, f, f + 1 if f < 24 else None) for m, p, f, _ in rows}
    halo = sequences.core_rows(sequences.with_halo(numbered, keys, before=3, after=2))
    assert halo.count() == len(rows)


@pytest.mark.parametrize("extra", [[math.inf], [-math.inf] * 30 + [math.inf] * 150, [1e308, -1e308, 5e-324], [math.nan, None]])
def test_quantiles_with_odd_values(spark, extra):
    values = [float(v) for v in np.random.default_rng(1).exponential(size=200).round(3)] + extra
    rows = [("g", v) for v in values] + [(None, float(i)) for i in range(90)] + [("only", math.inf)] * 3
    df = spark.createDataFrame(rows, "g string, v double")
    probs = {"low": 0.05, "mid": 0.5, "high": 0.95}
    got = {r.g: r for r in exact_quantiles(df, ["g"], "v", probs, bins=8, ranked_rows=20).collect()}
    known = sorted(v for v in values if v is not None and not math.isnan(v))
    for n, p in probs.items():
        at = (len(known) - 1) * p
        a, b = known[math.floor(at)], known[math.ceil(at)]
        want = a if a == b else a + (b - a) * (at - math.floor(at))
        assert got["g"][n] == want or got["g"][n] == pytest.approx(want)
        assert got[None][n] == pytest.approx(89 * p) and got["only"][n] == math.inf


def test_nan_is_missing_in_means_and_templates(spark):
    rows = [(1, i + 1, "a", float(i) if i != 3 else math.nan, 1.0) for i in range(12)]
    df = spark.createDataFrame(rows, "k long, rn long, player string, x double, y double")
    out = {r.rn: r.mean_x for r in blocks.rolling_means(df, ["k"], 3).collect()}
    for rn in range(1, 13):
        seen = [float(i) for i in range(max(0, rn - 3), rn) if i != 3]
        assert out[rn] == pytest.approx(sum(seen) / len(seen))
    t = blocks.role_templates(df, ["k"]).first()
    assert t.n_points == 11 and t.mu_x == pytest.approx(np.mean([i for i in range(12) if i != 3]))


def test_nan_text_becomes_null_at_ingest(spark, tmp_path):
    path = tmp_path / "frames.xml"
    path.write_text(
        '<T><Frame n="1" ballX="NaN"><Player side="home" player="1" x="NaN" y="0.5"/><Player side="home" player="2" x="0.1" y="0.2"/></Frame></T>'
    )
    schema = "_n long, _ballX double, Player array<struct<_side:string,_player:string,_x:double,_y:double>>"
    out = files.read_tracking_xml(spark, str(path), "Frame", schema, "Player", {"frame": F.col("_n"), "ball_x": F.col("_ballX")}).first()
    assert out.ball_x is None and [p.x for p in out.players] == [None, 0.1]
