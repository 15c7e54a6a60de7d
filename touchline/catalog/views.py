"""Football-shaped views over the given tables, as DataFrames and as SQL text for the check engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators.sequences import number_rows
from touchline.sources.files import alive_frames


# Frames and blocks of one match: more data means more matches, not longer ones.
MATCH_FRAMES = 600
MATCH_BLOCKS = 900


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _numbered_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracking frames with events, possession and phases, from ``events``; ``rn`` counts the alive ones."""
    e = table(spark, sf_dir, "events")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    e = e.withColumn("k", k).withColumn("provider", F.lit("sportec"))
    e = e.withColumn("match_id", F.concat(F.lit("m"), F.floor(F.col("event_id") / MATCH_FRAMES).cast("string")))
    e = e.withColumn("period_id", 1 + F.floor(F.col("event_id") / (MATCH_FRAMES // 2)).cast("long") % 2)
    e = number_rows(e, ["match_id", "period_id"], "event_id", "frame", among={"rn": F.col("k") % 10 != 0})
    kind, half = F.col("event_type"), F.col("k")
    original = (
        F.when(kind == "purchase", "Pass")
        .when((kind == "click") & (half < 50), "Cross")
        .when(kind == "click", "Tackle")
        .when((kind == "error") & (half < 30), "SavedShot")
        .when((kind == "error") & (half < 40), "SuccessfulShot")
        .when((kind == "signup") & (half < 20), "ThrowIn")
    )
    # long spells of possession in even matches, short ones in odd matches
    spell = F.when(F.floor(F.col("event_id") / MATCH_FRAMES) % 2 == 0, 60.0).otherwise(3.0)
    turn = F.floor(F.col("event_id") / spell).cast("long") % 5
    own = F.floor(F.col("event_id") / 150.0).cast("long") % 4
    other = F.floor(F.col("event_id") / 110.0).cast("long") % 3
    return e.select(
        "provider", "match_id", "period_id", "frame", "ts", "event_id",
        F.when(half % 10 == 0, "dead").otherwise("alive").alias("ball_status"),
        F.when(turn.isin(0, 2), "home").when(turn.isin(1, 4), "away").alias("team_possession"),
        original.alias("original_event"),
        F.when(own == 0, "build-up").when(own == 1, "mid-block").when(own == 3, "attacking-play").alias("phase_home"),
        F.when(other == 0, "low-block").when(other == 1, "mid-block").otherwise("high-block").alias("phase_away"),
        F.col("user_id").alias("player_id"),
        ((F.col("user_id") + half) % 11).alias("receiver_player_id"),
        (F.least("value", F.lit(200.0)) / 200).alias("ball_x"),
        (half.cast("double") / 99).alias("ball_y"),
        "rn",
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracking frames with events, possession and phases."""
    return _numbered_frames(spark, sf_dir).drop("rn")


FRAMES_SQL = """
SELECT 'sportec' AS provider, concat('m', CAST(event_id // 600 AS VARCHAR)) AS match_id,
       1 + CAST(event_id // 300 AS BIGINT) % 2 AS period_id,
       CAST(row_number() OVER (PARTITION BY event_id // 600, event_id // 300 ORDER BY ts, event_id) AS BIGINT) AS frame,
       ts, event_id,
       CASE WHEN k % 10 = 0 THEN 'dead' ELSE 'alive' END AS ball_status,
       CASE CAST(FLOOR(event_id / CASE WHEN (event_id // 600) % 2 = 0 THEN 60.0 ELSE 3.0 END) AS BIGINT) % 5 WHEN 0 THEN 'home' WHEN 1 THEN 'away' WHEN 2 THEN 'home'
            WHEN 3 THEN NULL ELSE 'away' END AS team_possession,
       CASE WHEN event_type = 'purchase' THEN 'Pass'
            WHEN event_type = 'click' AND k < 50 THEN 'Cross'
            WHEN event_type = 'click' THEN 'Tackle'
            WHEN event_type = 'error' AND k < 30 THEN 'SavedShot'
            WHEN event_type = 'error' AND k < 40 THEN 'SuccessfulShot'
            WHEN event_type = 'signup' AND k < 20 THEN 'ThrowIn'
            ELSE NULL END AS original_event,
       CASE CAST(FLOOR(event_id / 150.0) AS BIGINT) % 4 WHEN 0 THEN 'build-up' WHEN 1 THEN 'mid-block'
            WHEN 2 THEN NULL ELSE 'attacking-play' END AS phase_home,
       CASE CAST(FLOOR(event_id / 110.0) AS BIGINT) % 3 WHEN 0 THEN 'low-block' WHEN 1 THEN 'mid-block'
            ELSE 'high-block' END AS phase_away,
       user_id AS player_id, (user_id + k) % 11 AS receiver_player_id,
       least(value, CAST(200 AS DOUBLE)) / 200 AS ball_x, CAST(k AS DOUBLE) / 99 AS ball_y
FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events) e
"""

ALIVE_SQL = """
SELECT *, CAST(row_number() OVER (PARTITION BY match_id, period_id ORDER BY frame) AS BIGINT) AS rn
FROM fx_frames WHERE ball_status = 'alive'
"""


def alive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alive frames with their position ``rn`` in the period."""
    return alive_frames(_numbered_frames(spark, sf_dir))


def _side_players(side: str, offset: int) -> "F.Column":
    """Eleven points of one side as structs; every 17th is missing."""

    def point(i):
        missing = (F.col("vec_id") + i) % 17 == 0
        x = F.element_at("embedding", F.lit(offset - 1).cast("int") + 2 * i.cast("int")).cast("double") * 105
        y = F.element_at("embedding", F.lit(offset).cast("int") + 2 * i.cast("int")).cast("double") * 68
        return F.struct(
            F.lit(side).alias("side"),
            i.cast("long").alias("player"),
            F.when(~missing, x).alias("x"),
            F.when(~missing, y).alias("y"),
        )

    return F.transform(F.sequence(F.lit(1), F.lit(11)), point)


def player_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per frame: ``players`` array in centre-origin metres and the ball, from ``embeddings``."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("frame"),
        F.col("label").cast("long").alias("label"),
        F.concat(_side_players("home", 0), _side_players("away", 22)).alias("players"),
        (F.element_at("embedding", 45).cast("double") * 105).alias("ball_x"),
        (F.element_at("embedding", 46).cast("double") * 68).alias("ball_y"),
    )


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long view: one row per frame and player."""
    return player_frames(spark, sf_dir).select("frame", "label", F.inline("players"))


POSITIONS_SQL = """
SELECT vec_id AS frame, CAST(label AS BIGINT) AS label, s.side, CAST(p.player AS BIGINT) AS player,
       CASE WHEN (vec_id + p.player) % 17 = 0 THEN NULL
            ELSE CAST(embedding[s.off + 2 * p.player - 1] AS DOUBLE) * 105 END AS x,
       CASE WHEN (vec_id + p.player) % 17 = 0 THEN NULL
            ELSE CAST(embedding[s.off + 2 * p.player] AS DOUBLE) * 68 END AS y
FROM embeddings
CROSS JOIN (VALUES (1),(2),(3),(4),(5),(6),(7),(8),(9),(10),(11)) AS p(player)
CROSS JOIN (VALUES ('home', 0), ('away', 22)) AS s(side, off)
"""

BALL_SQL = """
SELECT vec_id AS frame, CAST(label AS BIGINT) AS label, CAST(embedding[45] AS DOUBLE) * 105 AS ball_x,
       CAST(embedding[46] AS DOUBLE) * 68 AS ball_y
FROM embeddings
"""


def passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passes of three teams in pitch metres, from ``lineitem``."""
    l = table(spark, sf_dir, "lineitem")
    return l.select(
        F.col("l_returnflag").alias("team_id"),
        (F.col("l_suppkey") % 11).alias("passer"),
        F.when(F.col("l_linenumber") != 7, F.col("l_partkey") % 11).alias("receiver"),
        (F.col("l_quantity") / 50 * 105).alias("x"),
        (F.col("l_discount") * 10 * 68).alias("y"),
        (F.col("l_extendedprice") / 1000).alias("x2"),
        (F.col("l_tax") * 12.5 * 68).alias("y2"),
        (F.col("l_linestatus") == "O").alias("success"),
    )


PASSES_SQL = """
SELECT l_returnflag AS team_id, l_suppkey % 11 AS passer,
       CASE WHEN l_linenumber = 7 THEN NULL ELSE l_partkey % 11 END AS receiver,
       l_quantity / 50 * 105 AS x, l_discount * 10 * 68 AS y,
       l_extendedprice / 1000 AS x2, l_tax * CAST(12.5 AS DOUBLE) * 68 AS y2,
       l_linestatus = 'O' AS success
FROM lineitem
"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formation blocks (closed frame intervals), from ``orders``."""
    o = table(spark, sf_dir, "orders")
    phase = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "attacking-play")
        .when(F.col("o_orderpriority") == "2-HIGH", "high-block")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "mid-block")
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "low-block")
        .otherwise("build-up")
    )
    form = F.col("o_custkey") % 5
    start = (F.col("o_orderkey") * 7919) % (MATCH_FRAMES // 2)
    return o.select(
        F.lit("sportec").alias("provider"),
        F.concat(F.lit("m"), F.floor(F.col("o_orderkey") / MATCH_BLOCKS).cast("string")).alias("match_id"),
        F.when(F.col("o_orderkey") % 2 == 0, "home").otherwise("away").alias("side"),
        phase.alias("phase"),
        (1 + F.floor(F.col("o_orderkey") / 2.0).cast("long") % 2).alias("period_id"),
        F.col("o_orderkey").alias("block_id"),
        start.alias("start_frame"),
        (start + 5 + F.floor(F.col("o_totalprice") / 100000.0).cast("long")).alias("end_frame"),
        F.when(form == 0, "4-4-2").when(form == 1, "4-3-3").when(form == 2, "4-2-3-1").when(form == 3, "3-5-2").alias(
            "predicted_formation"
        ),
    )


BLOCKS_SQL = """
SELECT 'sportec' AS provider, concat('m', CAST(o_orderkey // 900 AS VARCHAR)) AS match_id,
       CASE WHEN o_orderkey % 2 = 0 THEN 'home' ELSE 'away' END AS side,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'attacking-play' WHEN '2-HIGH' THEN 'high-block'
            WHEN '3-MEDIUM' THEN 'mid-block' WHEN '4-NOT SPECIFIED' THEN 'low-block' ELSE 'build-up' END AS phase,
       1 + CAST(FLOOR(o_orderkey / 2.0) AS BIGINT) % 2 AS period_id,
       o_orderkey AS block_id,
       (o_orderkey * 7919) % 300 AS start_frame,
       (o_orderkey * 7919) % 300 + 5 + CAST(FLOOR(o_totalprice / 100000.0) AS BIGINT) AS end_frame,
       CASE o_custkey % 5 WHEN 0 THEN '4-4-2' WHEN 1 THEN '4-3-3' WHEN 2 THEN '4-2-3-1' WHEN 3 THEN '3-5-2' ELSE NULL END
         AS predicted_formation
FROM orders
"""


def fvf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formation-versus-formation rows, from ``orders`` and ``customer``."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    j = o.join(c, o.o_custkey == c.c_custkey)
    ok, nk, ck = F.col("o_orderkey"), F.col("c_nationkey"), F.col("o_custkey")
    keyed = j.select(
        F.when(nk % 2 == 0, "sportec").otherwise("metrica").alias("provider"),
        F.when(ok % 3 == 0, "mid-block").when(ok % 3 == 1, "low-block").otherwise("Build Up").alias("phase_home"),
        F.when(nk % 3 == 0, "mid-block").when(nk % 3 == 1, "high block").alias("phase_away"),
        F.when(ck % 4 == 0, "4-4-2").when(ck % 4 == 1, "4-3-3").when(ck % 4 == 2, "4-2-3-1").otherwise("3-5-2").alias(
            "home_form"
        ),
        F.when(F.col("c_mktsegment") == "BUILDING", "4-4-2")
        .when(F.col("c_mktsegment") == "MACHINERY", "4-3-3")
        .when(F.col("c_mktsegment") == "HOUSEHOLD", "5-3-2")
        .when(F.col("c_mktsegment") == "AUTOMOBILE", "3-4-2-1")
        .otherwise("4-2-3-1")
        .alias("away_form"),
        "o_totalprice", "c_acctbal", "o_orderkey", "o_custkey",
    )
    return keyed.groupBy("provider", "phase_home", "phase_away", "home_form", "away_form").agg(
        F.count(F.lit(1)).alias("pairs"),
        (F.avg("o_totalprice") / 500000).alias("home_strength"),
        (F.avg("c_acctbal") / 10000).alias("away_strength"),
        F.avg(ok % 20).alias("home_ppda"),
        F.avg(ck % 15).alias("away_ppda"),
        (F.avg(ok % 100) / 100).alias("home_press_rate"),
        (F.avg(ck % 100) / 100).alias("away_press_rate"),
        (F.avg(ok % 90) / 100).alias("home_xt"),
        (F.avg(ck % 80) / 100).alias("away_xt"),
        F.avg(ok % 30).alias("home_ppda_press"),
        F.avg(ck % 25).alias("away_ppda_press"),
        F.avg(ok % 110).alias("home_avg_press"),
        F.avg(ck % 105).alias("away_avg_press"),
        (20 + F.avg(ok % 41)).alias("home_width"),
        (20 + F.avg(ck % 43)).alias("away_width"),
        (20 + F.avg(ok % 37)).alias("home_depth"),
        (20 + F.avg(ck % 39)).alias("away_depth"),
        F.avg(ok % 101).alias("home_possession_pct"),
        F.avg(ck % 97).alias("away_possession_pct"),
    )


FVF_SQL = """
SELECT CASE WHEN c_nationkey % 2 = 0 THEN 'sportec' ELSE 'metrica' END AS provider,
       CASE o_orderkey % 3 WHEN 0 THEN 'mid-block' WHEN 1 THEN 'low-block' ELSE 'Build Up' END AS phase_home,
       CASE c_nationkey % 3 WHEN 0 THEN 'mid-block' WHEN 1 THEN 'high block' ELSE NULL END AS phase_away,
       CASE o_custkey % 4 WHEN 0 THEN '4-4-2' WHEN 1 THEN '4-3-3' WHEN 2 THEN '4-2-3-1' ELSE '3-5-2' END AS home_form,
       CASE c_mktsegment WHEN 'BUILDING' THEN '4-4-2' WHEN 'MACHINERY' THEN '4-3-3' WHEN 'HOUSEHOLD' THEN '5-3-2'
            WHEN 'AUTOMOBILE' THEN '3-4-2-1' ELSE '4-2-3-1' END AS away_form,
       count(*) AS pairs,
       avg(o_totalprice) / 500000 AS home_strength, avg(c_acctbal) / 10000 AS away_strength,
       avg(o_orderkey % 20) AS home_ppda, avg(o_custkey % 15) AS away_ppda,
       avg(o_orderkey % 100) / 100 AS home_press_rate, avg(o_custkey % 100) / 100 AS away_press_rate,
       avg(o_orderkey % 90) / 100 AS home_xt, avg(o_custkey % 80) / 100 AS away_xt,
       avg(o_orderkey % 30) AS home_ppda_press, avg(o_custkey % 25) AS away_ppda_press,
       avg(o_orderkey % 110) AS home_avg_press, avg(o_custkey % 105) AS away_avg_press,
       20 + avg(o_orderkey % 41) AS home_width, 20 + avg(o_custkey % 43) AS away_width,
       20 + avg(o_orderkey % 37) AS home_depth, 20 + avg(o_custkey % 39) AS away_depth,
       avg(o_orderkey % 101) AS home_possession_pct, avg(o_custkey % 97) AS away_possession_pct
FROM orders JOIN customer ON o_custkey = c_custkey
GROUP BY 1, 2, 3, 4, 5
"""

SQL_VIEWS = {
    "fx_frames": FRAMES_SQL,
    "fx_alive": ALIVE_SQL,
    "fx_positions": POSITIONS_SQL,
    "fx_ball": BALL_SQL,
    "fx_passes": PASSES_SQL,
    "fx_blocks": BLOCKS_SQL,
    "fx_fvf": FVF_SQL,
}
NEEDS = {"fx_alive": ["fx_frames"]}


def with_views(names: str, body: str) -> str:
    """SQL text: the named views as CTEs, then ``body`` (itself a SELECT or further CTEs ending in one)."""
    wanted: list[str] = []
    for name in names.split():
        for n in [*NEEDS.get(name, []), name]:
            if n not in wanted:
                wanted.append(n)
    ctes = ",\n".join(f"{n} AS ({SQL_VIEWS[n].strip()})" for n in wanted)
    body = body.strip()
    joiner = ",\n" + body[5:] if body[:5].upper() == "WITH " else "\n" + body
    return f"WITH {ctes}{joiner}"


def role_points(spark: SparkSession, sf_dir: str, n: int = 14) -> DataFrame:
    """One row per frame and side with ``n`` role means as ``pts`` and a role covariance, from ``embeddings``."""
    e = table(spark, sf_dir, "embeddings")

    def points(offset: int):
        return F.transform(
            F.sequence(F.lit(1), F.lit(n)),
            lambda i: F.struct(
                (F.element_at("embedding", F.lit(offset - 1) + 2 * i).cast("double") * 105).alias("x"),
                (F.element_at("embedding", F.lit(offset) + 2 * i).cast("double") * 68).alias("y"),
            ),
        )

    sides = F.array(*[F.struct(F.lit(s).alias("side"), points(o).alias("pts")) for s, o in (("home", 0), ("away", 28))])
    return e.select(F.col("vec_id").alias("frame"), F.col("label").cast("long").alias("label"), F.inline(sides))


ROLE_POINTS_SQL = """
SELECT vec_id AS frame, CAST(label AS BIGINT) AS label, s.side, CAST(p.i AS BIGINT) AS i,
       CAST(embedding[s.off + 2 * p.i - 1] AS DOUBLE) * 105 AS x, CAST(embedding[s.off + 2 * p.i] AS DOUBLE) * 68 AS y
FROM embeddings
CROSS JOIN (SELECT unnest(range(1, 15)) AS i) AS p
CROSS JOIN (VALUES ('home', 0), ('away', 28)) AS s(side, off)
"""
SQL_VIEWS["fx_roles"] = ROLE_POINTS_SQL


def held_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Player frames with a side in possession and pass marks."""
    f = player_frames(spark, sf_dir)
    poss = F.when(F.col("frame") % 3 == 0, "home").when(F.col("frame") % 3 == 1, "away").otherwise("")
    return f.withColumns({"poss": poss, "is_pass": F.col("frame") % 4 == 0})


HELD_SQL = """
SELECT frame, label, ball_x, ball_y, CASE frame % 3 WHEN 0 THEN 'home' WHEN 1 THEN 'away' ELSE '' END AS poss, frame % 4 = 0 AS is_pass
FROM fx_ball
"""
SQL_VIEWS["fx_held"] = HELD_SQL
NEEDS["fx_held"] = ["fx_ball"]


def by_side(numbered: DataFrame) -> DataFrame:
    """Numbered player frames, one row per side with its own players."""
    sides = numbered.withColumn("side", F.explode(F.array(F.lit("home"), F.lit("away"))))
    return sides.withColumn("players", F.filter("players", lambda p: p["side"] == F.col("side")))


def side_points(sides: DataFrame) -> DataFrame:
    """One row per frame, side and player."""
    return sides.select("label", "side", "frame", "rn", F.explode("players").alias("_p")).select("label", "side", "frame", "rn", "_p.player", "_p.x", "_p.y")


NUMBERED_SQL = """
SELECT label, side, frame, player, x, y, CAST(row_number() OVER (PARTITION BY label, side, player ORDER BY frame) AS BIGINT) AS rn
FROM fx_positions
"""
SQL_VIEWS["fx_numbered"] = NUMBERED_SQL
NEEDS["fx_numbered"] = ["fx_positions"]
