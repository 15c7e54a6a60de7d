"""Team-level tables: passes, shots, densities, centroids, pass networks and names.

Every function works for all teams of a table at once; ``by`` names the columns that make a team (and match).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.config import PITCH_LENGTH, PITCH_WIDTH, SHOT_LABELS
from touchline.functions.coords import auto_scale
from touchline.functions.events import goal_flag, success_flag

EXTENTS = {"x": PITCH_LENGTH, "y": PITCH_WIDTH, "x2": PITCH_LENGTH, "y2": PITCH_WIDTH}
# Goal mouth half width, drawn length of an open-ended shot, arrow head size.
GOAL_HALF = 3.66
SHOT_ARROW = 6.0
HEAD_LENGTH, HEAD_WIDTH = 2.2, 1.2


def team_passes(events: DataFrame, by: list[str], label: str = "label", stretch: bool = True) -> DataFrame:
    """Passes with a success flag, coordinates brought to the pitch per team."""
    p = events.where(F.lower(label).contains("pass"))
    p = p.withColumn("success", success_flag(p))
    return auto_scale(p, by, {c: s for c, s in EXTENTS.items() if c in p.columns}, stretch=stretch)


def team_shots(
    events: DataFrame, by: list[str], label: str = "label", success: str | None = "success", stretch: bool = True
) -> DataFrame:
    """Shots with a goal flag; a missing start is taken from the end, coordinates are brought to the pitch per team."""
    s = events.where(F.lower(label).isin(*SHOT_LABELS))
    s = s.withColumns({c: F.col(c).cast("double") for c in EXTENTS if c in s.columns})
    if "x2" in s.columns and "y2" in s.columns:
        lost = F.col("x").isNull() | F.col("y").isNull()
        s = s.withColumns({"x": F.when(lost, F.col("x2")).otherwise(F.col("x")), "y": F.when(lost, F.col("y2")).otherwise(F.col("y"))})
    s = s.withColumn("is_goal", goal_flag(success if success in s.columns else None, label))
    s = s.dropna(subset=["x", "y"])
    return auto_scale(s, by, {c: e for c, e in EXTENTS.items() if c in s.columns}, stretch=stretch)


def pass_map_counts(passes: DataFrame, by: list[str], length: float = PITCH_LENGTH) -> DataFrame:
    """Successful, failed and all passes per half of the pitch."""
    half = F.when(F.col("x") <= length / 2, "def").otherwise("att").alias("half")
    ok = F.sum(F.col("success").cast("long"))
    return passes.groupBy(*by, half).agg(
        ok.alias("n_ok"), (F.count(F.lit(1)) - ok).alias("n_fail"), F.count(F.lit(1)).alias("n_total")
    )


def density(
    points: DataFrame, by: list[str], bins_x: int = 30, bins_y: int = 20, length: float = PITCH_LENGTH, width: float = PITCH_WIDTH
) -> DataFrame:
    """Points per pitch cell; a point on the edge of two cells, up to rounding, belongs to the higher one, the far edges to
    the last cells."""

    def cell(c: str, size: float, bins: int) -> Column:
        return F.least(F.floor(F.round(F.col(c) / size * bins, 9)), F.lit(bins - 1)).cast("int")

    inside = points.where(F.col("x").between(0.0, length) & F.col("y").between(0.0, width))
    return inside.groupBy(*by, cell("x", length, bins_x).alias("bin_x"), cell("y", width, bins_y).alias("bin_y")).agg(
        F.count(F.lit(1)).alias("n")
    )


def _clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def player_spread(passes: DataFrame, by: list[str], player: str = "passer") -> DataFrame:
    """Mean start point of each player with a radius from the known axis deviations."""
    known = passes.where(F.col(player).isNotNull())
    g = known.groupBy(*by, player).agg(
        F.avg("x").alias("mx"), F.avg("y").alias("my"), F.stddev_samp("x").alias("_sx"), F.stddev_samp("y").alias("_sy"), F.count(F.lit(1)).alias("n")
    )
    mean = F.when(F.col("_sx").isNotNull() & F.col("_sy").isNotNull(), (F.col("_sx") + F.col("_sy")) / 2.0).otherwise(
        F.coalesce("_sx", "_sy")
    )
    return g.withColumn("r", _clip(F.coalesce(mean, F.lit(2.5)), 1.5, 12.0)).drop("_sx", "_sy")


def player_blobs(passes: DataFrame, by: list[str], player: str = "passer", scale: float = 1.8) -> DataFrame:
    """Mean start point of each player with clipped axis deviations and ellipse radii."""
    known = passes.where(F.col(player).isNotNull())

    def deviation(c: str) -> Column:
        return _clip(F.coalesce(F.stddev_samp(c), F.lit(2.0)), 1.5, 10.0)

    g = known.groupBy(*by, player).agg(
        F.avg("x").alias("mx"), F.avg("y").alias("my"), deviation("x").alias("sx"), deviation("y").alias("sy"), F.count(F.lit(1)).alias("n")
    )
    return g.withColumns({"rx": F.col("sx") * scale, "ry": F.col("sy") * scale})


def network_nodes(passes: DataFrame, by: list[str], low: float = 20.0, high: float = 40.0) -> DataFrame:
    """Place and size of each player of the pass network.

    The mean start of own passes, else the mean end of received ones; the size grows with passes received between the
    10 % and 90 % quantile of the team's receivers. A team's receivers are a squad, so the quantile is over a few rows.
    """
    known = passes.where(F.col("receiver").isNotNull())
    source = known.groupBy(*by, F.col("passer").alias("player")).agg(F.avg("x").alias("_sx"), F.avg("y").alias("_sy"))
    target = known.groupBy(*by, F.col("receiver").alias("player")).agg(
        F.avg("x2").alias("_tx"), F.avg("y2").alias("_ty"), F.count(F.lit(1)).alias("_n")
    )
    limits = target.groupBy(*by).agg(
        F.percentile("_n", F.lit(0.1)).alias("_lo"), F.percentile("_n", F.lit(0.9)).alias("_hi")
    )
    nodes = source.join(target, [*by, "player"], "full_outer").join(limits, by, "left")
    top = F.when(F.col("_hi") <= F.col("_lo"), F.col("_lo") + 1.0).otherwise(F.col("_hi"))
    share = _clip((F.coalesce("_n", F.lit(0)) - F.col("_lo")) / (top - F.col("_lo")), 0.0, 1.0)
    return nodes.select(
        *by,
        "player",
        F.coalesce("_sx", "_tx").alias("nx"),
        F.coalesce("_sy", "_ty").alias("ny"),
        F.coalesce("_n", F.lit(0)).alias("received"),
        (low + share * (high - low)).alias("size"),
    )


def network_edges(passes: DataFrame, by: list[str], min_edge: int = 3) -> DataFrame:
    """Passes between two players, at least ``min_edge`` of them, with line width and middle point."""
    known = passes.where(F.col("receiver").isNotNull() & F.col("passer").isNotNull())
    edges = known.groupBy(*by, "passer", "receiver").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(1, min_edge))
    at = network_nodes(passes, by).select(*by, "player", "nx", "ny")
    u = at.select(*by, F.col("player").alias("passer"), F.col("nx").alias("_ux"), F.col("ny").alias("_uy"))
    w = at.select(*by, F.col("player").alias("receiver"), F.col("nx").alias("_wx"), F.col("ny").alias("_wy"))
    placed = edges.join(u, [*by, "passer"]).join(w, [*by, "receiver"])
    return placed.select(
        *by,
        "passer",
        "receiver",
        "n",
        F.greatest(F.lit(0.7), F.log2(F.lit(1.0) + F.col("n")) * 0.9).alias("width"),
        ((F.col("_ux") + F.col("_wx")) / 2).alias("mid_x"),
        ((F.col("_uy") + F.col("_wy")) / 2).alias("mid_y"),
    )


def shot_table(shots: DataFrame, length: float = PITCH_LENGTH, width: float = PITCH_WIDTH) -> DataFrame:
    """Arrow end of each shot: its end or six metres on; goals end in the goal mouth."""
    open_x = F.coalesce("x2", F.least(F.lit(length), F.col("x") + SHOT_ARROW))
    open_y = F.coalesce("y2", "y")
    goal_y = _clip(F.col("y"), width / 2 - GOAL_HALF, width / 2 + GOAL_HALF)
    return shots.withColumns(
        {
            "end_x": F.when(F.col("is_goal"), F.lit(length - 1.0)).otherwise(open_x),
            "end_y": F.when(F.col("is_goal"), goal_y).otherwise(open_y),
        }
    )


def shot_counts(shots: DataFrame, by: list[str]) -> DataFrame:
    goals = F.sum(F.col("is_goal").cast("long"))
    return shots.groupBy(*by).agg(goals.alias("goals"), (F.count(F.lit(1)) - goals).alias("others"))


def pass_vectors(passes: DataFrame) -> DataFrame:
    """Length, direction and arrow head points of passes with an end; passes without length go."""
    dx, dy = F.col("x2") - F.col("x"), F.col("y2") - F.col("y")
    out = passes.withColumns({"_dx": dx, "_dy": dy}).withColumn("length", F.hypot("_dx", "_dy"))
    out = out.where((F.col("length") >= 1e-6) & (F.col("length") < float("inf")))
    out = out.withColumns({"ux": F.col("_dx") / F.col("length"), "uy": F.col("_dy") / F.col("length")})
    bx, by = F.col("x2") - HEAD_LENGTH * F.col("ux"), F.col("y2") - HEAD_LENGTH * F.col("uy")
    return out.withColumns(
        {
            "left_x": bx - HEAD_WIDTH * F.col("uy"),
            "left_y": by + HEAD_WIDTH * F.col("ux"),
            "right_x": bx + HEAD_WIDTH * F.col("uy"),
            "right_y": by - HEAD_WIDTH * F.col("ux"),
        }
    ).drop("_dx", "_dy")


def distinct_teams(events: DataFrame, team: str = "team_id", label: str = "label") -> DataFrame:
    """Teams that passed, in order."""
    return events.where(F.lower(label).contains("pass")).select(team).distinct().orderBy(team)


def _named_counts(df: DataFrame, team: str) -> DataFrame:
    return df.groupBy(team, "home_team", "away_team").agg(F.count(F.lit(1)).alias("_n"))


def team_opponent_pair(df: DataFrame, team: str = "team_id", our_side: str = "home") -> DataFrame:
    """Own and opposing name from the most frequent (home, away) pair; names break ties."""
    pairs = _named_counts(df, team)
    rank = F.struct((-F.col("_n")).alias("n"), F.coalesce("home_team", F.lit("")).alias("h"), F.coalesce("away_team", F.lit("")).alias("a"))
    best = pairs.groupBy(team).agg(F.min_by(F.struct("home_team", "away_team", "_n"), rank).alias("_p"))
    own, other = ("home_team", "away_team") if our_side == "home" else ("away_team", "home_team")
    return best.select(team, F.col(f"_p.{own}").alias("team_name"), F.col(f"_p.{other}").alias("opponent_name"), F.col("_p._n").alias("n"))


def team_labels(df: DataFrame, team: str = "team_id") -> DataFrame:
    """Label per team: ``name (id)`` from the most frequent pair that has a name, else the id."""
    blank = F.lit("")
    name = F.coalesce(F.nullif(F.trim("home_team"), blank), F.nullif(F.trim("away_team"), blank))
    named = _named_counts(df, team).withColumn("_name", name)
    best = named.groupBy(team).agg(
        F.min_by("_name", F.when(F.col("_name").isNotNull(), F.struct((-F.col("_n")).alias("n"), F.col("_name").alias("name")))).alias("_name")
    )
    key = F.col(team).cast("string")
    label = F.when(F.col("_name").isNotNull(), F.concat("_name", F.lit(" ("), key, F.lit(")"))).otherwise(key)
    return best.select(team, label.alias("team_label"))


def team_modal_names(df: DataFrame, team: str = "team_id") -> DataFrame:
    """Most frequent name of a team over both columns, and of its opponent over the other column."""
    counts = _named_counts(df, team)
    long = counts.select(
        team, F.inline(F.array(*[F.struct(F.lit(c).alias("_col"), F.col(c).alias("_name"), F.col("_n")) for c in ("home_team", "away_team")]))
    ).where("_name IS NOT NULL")
    per = long.groupBy(team, "_name").agg(
        F.sum(F.when(F.col("_col") == "home_team", F.col("_n")).otherwise(0)).alias("_h"),
        F.sum(F.when(F.col("_col") == "away_team", F.col("_n")).otherwise(0)).alias("_a"),
    )

    def most(count: Column) -> Column:
        return F.min_by(F.struct("_name", "_h", "_a"), F.when(count > 0, F.struct((-count).alias("n"), F.col("_name").alias("name"))))

    best = per.groupBy(team).agg(
        most(F.col("_h") + F.col("_a")).alias("_own"), most(F.col("_h")).alias("_home"), most(F.col("_a")).alias("_away")
    )
    opponent = F.when(F.col("_own._h") >= F.col("_own._a"), F.col("_away._name")).otherwise(F.col("_home._name"))
    return best.select(team, F.col("_own._name").alias("team_name"), opponent.alias("opponent_name"))


def match_runs(frames: DataFrame, by: list[str], ts: str = "ts") -> DataFrame:
    """Rows and first time of each match run."""
    return frames.groupBy(*by).agg(F.min(ts).alias("first_ts"), F.count(F.lit(1)).alias("n_rows"))


def latest_per_key(df: DataFrame, key: list[str], created: str = "created_at", tie: str | None = None) -> DataFrame:
    """Newest row of each key; rows are cut to one per key before the shuffle."""
    order = [F.col(created).desc(), *([F.col(tie)] if tie else [])]
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")
