"""Match metrics over windows of frames, pairs of blocks and formation match-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.config import FPS, NEGATIVE_METRICS, POSITIVE_METRICS, PROVIDERS, ProviderConfig
from touchline.functions.events import is_defence, is_pass, is_shot
from touchline.functions.shapes import carrier, pressure_on, spacing
from touchline.functions.threat import expected_threat, goal_probability
from touchline.operators.masks import SEQUENCE, possession_side, possession_steps
from touchline.operators.quantiles import exact_quantiles
from touchline.session import compute_partitions

SIDES = ("home", "away")
OTHER = {"home": "away", "away": "home"}
PRESS_THRESHOLD = 60.0
# Fixed list: the metrics measured for each side of a pair of blocks.
WINDOW_METRICS = [
    "xg", "possession_pct", "recovery_s", "quick_strength", "xt", "ppda", "ppda_press", "press_rate", "avg_press",
    "width", "depth", "stretch",
]
# Fixed list: the metrics averaged into a formation match-up.
MATCHUP_METRICS = [
    "xg", "possession_pct", "recovery_s", "strength", "strength_ml", "xt", "ppda", "ppda_press", "press_rate",
    "avg_press", "width", "depth", "stretch",
]


def frame_facts(
    df: DataFrame,
    xg_coefficients: tuple[float, float, float],
    cfg: ProviderConfig = PROVIDERS["sportec"],
    keys: list[str] = SEQUENCE,
    unit_ball: bool = True,
) -> DataFrame:
    """Everything the window metrics read, computed once per alive frame.

    ``unit_ball`` says that ball coordinates are in [0, 1]; threat and pressure take metres from the centre, which
    is then derived. Frames without a ``players`` array have no pressure and spacing columns. What needs the players
    is computed first, row by row, so that the array itself is never shuffled; it is not in the result.
    """
    bx, by = F.col("ball_x"), F.col("ball_y")
    mx, my = (bx * 105.0 - 52.5, by * 68.0 - 34.0) if unit_ball else (bx, by)
    ux, uy = (bx, by) if unit_ball else ((bx + 52.5) / 105.0, (by + 34.0) / 68.0)
    known = bx.isNotNull() & by.isNotNull()
    out = df.withColumns(
        {
            "poss": possession_side(cfg),
            "is_pass": is_pass(df, cfg),
            "is_defence": is_defence(df, cfg),
            "xg": F.when(is_shot(df, cfg) & known, goal_probability(ux, uy, xg_coefficients)),
            "xt": F.when(known, expected_threat(mx, my)),
        }
    )
    if "players" in df.columns:
        out = player_facts(out, mx, my).drop("players")
    return possession_steps(out, cfg, keys=keys)


def player_facts(df: DataFrame, ball_x: Column, ball_y: Column, poss: str = "poss") -> DataFrame:
    """Add ``pressure`` (on the carrier of the side in possession) and per side width, depth and stretch."""
    players, p = F.col("players"), F.col(poss)
    holder = F.when(p.isin(*SIDES), p)
    rival = F.when(p == "home", "away").when(p == "away", "home")
    df = df.withColumn("_carrier", carrier(players, holder, ball_x, ball_y))
    df = df.withColumn("pressure", pressure_on(players, F.col("_carrier"), holder, rival)).drop("_carrier")
    df = df.withColumns({f"_{s}": spacing(players, s) for s in SIDES})
    return df.withColumns(
        {f"{s}_{m}": F.col(f"_{s}")[m] for s in SIDES for m in ("width", "depth", "stretch")}
    ).drop("_home", "_away")


def _n(condition: Column) -> Column:
    return F.sum(condition.cast("long"))


def possession_metrics(side: str, start: Column, fps: int = FPS) -> dict[str, Column]:
    """Share of rows in possession (%) and mean seconds to win the ball back inside the window."""
    inside = F.col(f"{side}_lost_after") >= start
    return {
        f"{side}_possession_pct": _n(F.col("poss") == side) * 100.0 / F.count(F.lit(1)),
        f"{side}_recovery_s": F.avg(F.when(inside, F.col(f"{side}_gap"))) / float(fps),
    }


def ppda_metric(side: str, start: Column) -> dict[str, Column]:
    """Opponent passes per own defensive act or ball win."""
    rival = OTHER[side]
    acts = _n(F.col("is_defence") & (F.col("poss") == side))
    wins = _n(F.coalesce(F.col(f"to_{side}") & (F.col("prev_frame") >= start), F.lit(False)))
    passes = _n(F.col("is_pass") & (F.col("poss") == rival))
    return {f"{side}_ppda": passes / F.greatest(F.lit(1), acts + wins)}


def threat_metrics(side: str) -> dict[str, Column]:
    """Sum of xG over own shots and mean threat over own possession."""
    own = F.col("poss") == side
    return {
        f"{side}_xg": F.coalesce(F.sum(F.when(own, F.col("xg"))), F.lit(0.0)),
        f"{side}_xt": F.coalesce(F.avg(F.when(own, F.col("xt"))), F.lit(0.0)),
    }


def pressure_metrics(side: str, threshold: float = PRESS_THRESHOLD) -> dict[str, Column]:
    """Press rate, mean pressure and pressure-based PPDA while the opponent has the ball."""
    rival = F.col("poss") == OTHER[side]
    pressed = _n(F.coalesce(rival & (F.col("pressure") >= threshold), F.lit(False)))
    return {
        f"{side}_ppda_press": _n(F.col("is_pass") & rival) / F.greatest(F.lit(1), pressed),
        f"{side}_press_rate": pressed / F.greatest(F.lit(1), _n(rival)),
        f"{side}_avg_press": F.avg(F.when(rival, F.col("pressure"))),
    }


def spacing_means(side: str) -> dict[str, Column]:
    return {f"{side}_{m}": F.avg(f"{side}_{m}") for m in ("width", "depth", "stretch")}


def quick_strength(xg: Column, possession: Column, recovery: Column) -> Column:
    """0.5 xG + 0.3 possession + 0.2 / recovery, unknown terms count nothing."""
    speed = F.when(recovery > 0, 1.0 / recovery).otherwise(F.lit(0.0))
    return 0.5 * xg + 0.3 * F.coalesce(possession, F.lit(0.0)) + 0.2 * F.coalesce(speed, F.lit(0.0))


def _count(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("long")


def _row_parts(df: DataFrame, frame: str) -> dict[str, Column]:
    """Summable parts of one frame: every window metric is a formula over sums of these."""
    parts = {"n_frames": F.lit(1).cast("long")}
    for s in SIDES:
        own, rival = F.col("poss") == s, F.col("poss") == OTHER[s]
        parts |= {
            f"{s}_own": _count(own),
            f"{s}_xg": F.when(own, F.col("xg")),
            f"{s}_xt_sum": F.when(own, F.col("xt")),
            f"{s}_xt_n": _count(own & F.col("xt").isNotNull()),
            f"{s}_passes": _count(own & F.col("is_pass")),
            f"{s}_acts": _count(own & F.col("is_defence")),
            f"{s}_wins": _count(F.col(f"to_{s}")),
            f"{s}_gaps": F.col(f"{s}_gap"),
            f"{s}_gaps_n": _count(F.col(f"{s}_gap").isNotNull()),
        }
        if "pressure" in df.columns:
            pressure = F.when(rival, F.col("pressure"))
            parts |= {
                f"{s}_press_sum": pressure,
                f"{s}_press_n": _count(pressure.isNotNull()),
                f"{s}_pressed": _count(pressure >= PRESS_THRESHOLD),
            }
            for m in ("width", "depth", "stretch"):
                parts |= {f"{s}_{m}_sum": F.col(f"{s}_{m}"), f"{s}_{m}_n": _count(F.col(f"{s}_{m}").isNotNull())}
    return parts


def _row_firsts(frame: str) -> dict[str, Column]:
    """What the first row and the first ball win of a window add that may have begun before it."""
    firsts = {"_at": F.col(frame)}
    for s in SIDES:
        won = F.col(f"{s}_gap").isNotNull()
        firsts |= {
            f"_arrived_{s}": _count(F.col(f"to_{s}")),
            f"_won_at_{s}": F.when(won, F.col(frame)),
            f"_won_gap_{s}": F.col(f"{s}_gap"),
            f"_won_lost_{s}": F.col(f"{s}_lost_after"),
        }
    return firsts


def _merge(parts: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """Sum the parts of each group and keep its earliest row's and earliest ball win's values."""
    aggs = [F.sum(n).alias(n) for n in names] + [F.min("_at").alias("_at")]
    for s in SIDES:
        aggs += [
            F.min_by(f"_arrived_{s}", "_at").alias(f"_arrived_{s}"),
            F.min(f"_won_at_{s}").alias(f"_won_at_{s}"),
            F.min_by(f"_won_gap_{s}", f"_won_at_{s}").alias(f"_won_gap_{s}"),
            F.min_by(f"_won_lost_{s}", f"_won_at_{s}").alias(f"_won_lost_{s}"),
        ]
    return parts.groupBy(*by).agg(*aggs)


def _from_parts(sums: DataFrame, by: list[str], start: Column, fps: int = FPS) -> DataFrame:
    """Metrics of each group from its merged parts.

    The first row's arrival never counts, and the first ball win counts only when the ball was lost inside the window.
    """
    players = "home_press_sum" in sums.columns
    out: dict[str, Column] = {}
    for s in SIDES:
        o = OTHER[s]
        stray = F.coalesce(F.col(f"_won_lost_{s}") < start, F.lit(True)) & F.col(f"_won_at_{s}").isNotNull()
        gaps = F.coalesce(f"{s}_gaps", F.lit(0)) - F.when(stray, F.col(f"_won_gap_{s}")).otherwise(0)
        gaps_n = F.col(f"{s}_gaps_n") - F.when(stray, 1).otherwise(0)
        wins = F.col(f"{s}_wins") - F.col(f"_arrived_{s}")
        out |= {
            f"{s}_xg": F.coalesce(f"{s}_xg", F.lit(0.0)),
            f"{s}_possession_pct": F.col(f"{s}_own") * 100.0 / F.col("n_frames"),
            f"{s}_recovery_s": gaps / F.nullif(gaps_n, F.lit(0)) / float(fps),
            f"{s}_xt": F.coalesce(F.col(f"{s}_xt_sum") / F.nullif(F.col(f"{s}_xt_n"), F.lit(0)), F.lit(0.0)),
            f"{s}_ppda": F.col(f"{o}_passes") / F.greatest(F.lit(1), F.col(f"{s}_acts") + wins),
        }
        if players:
            out |= {
                f"{s}_ppda_press": F.col(f"{o}_passes") / F.greatest(F.lit(1), F.col(f"{s}_pressed")),
                f"{s}_press_rate": F.col(f"{s}_pressed") / F.greatest(F.lit(1), F.col(f"{o}_own")),
                f"{s}_avg_press": F.col(f"{s}_press_sum") / F.nullif(F.col(f"{s}_press_n"), F.lit(0)),
            }
            for m in ("width", "depth", "stretch"):
                out[f"{s}_{m}"] = F.col(f"{s}_{m}_sum") / F.nullif(F.col(f"{s}_{m}_n"), F.lit(0))
    measured = sums.select(*by, "n_frames", *[c.alias(n) for n, c in out.items()])
    return measured.withColumns(
        {
            f"{s}_quick_strength": quick_strength(
                F.col(f"{s}_xg"), F.col(f"{s}_possession_pct"), F.col(f"{s}_recovery_s")
            )
            for s in SIDES
        }
    )


def sequence_metrics(facts: DataFrame, by: list[str], frame: str = "frame") -> DataFrame:
    """Every metric the facts allow over whole sequences, one row per ``by``."""
    parts, firsts = _row_parts(facts, frame), _row_firsts(frame)
    rows = facts.select(*by, *[c.alias(n) for n, c in parts.items()], *[c.alias(n) for n, c in firsts.items()])
    return _from_parts(_merge(rows, by, list(parts)), by, F.lit(-(2**62)))


# Frames per summary chunk of ``interval_metrics``.
SUMMARY_FRAMES = 64


def interval_metrics(
    facts: DataFrame,
    intervals: DataFrame,
    keys: list[str],
    by: list[str],
    start: str = "pair_start",
    end: str = "pair_end",
    frame: str = "frame",
    chunk: int = SUMMARY_FRAMES,
) -> DataFrame:
    """Every metric the facts allow over each interval of frames.

    Frames are summarised per chunk once. An interval joins the summaries of the chunks it covers and the single
    frames at its two ends, all by equality of keys and chunk, so a pair of ten-minute blocks costs a few hundred rows
    instead of 15,000 and crowded matches spread over their chunks. ``by`` names the columns of an interval and must
    include ``keys`` and ``start``.
    """
    parts, firsts = _row_parts(facts, frame), _row_firsts(frame)
    rows = facts.select(
        *keys,
        F.floor(F.col(frame) / chunk).cast("long").alias("_chunk"),
        *[c.alias(n) for n, c in parts.items()],
        *[c.alias(n) for n, c in firsts.items()],
    )
    summaries = _merge(rows, [*keys, "_chunk"], list(parts))
    first_whole = F.ceil(F.col(start) / chunk).cast("long")
    last_whole = (F.floor((F.col(end) + 1) / chunk) - 1).cast("long")
    # A stored interval list may be one small file; its expansion is the work, so it is spread first.
    listed = intervals.select(*dict.fromkeys([*by, start, end])).repartition(compute_partitions(intervals.sparkSession), *by)
    spans = listed.withColumns(
        {"_a": first_whole, "_b": last_whole, "_c": F.floor(F.col(start) / chunk).cast("long"), "_d": F.floor(F.col(end) / chunk).cast("long")}
    )
    inner = spans.where("_a <= _b").withColumn("_chunk", F.explode(F.sequence("_a", "_b")))
    left_end = F.when((F.col("_c") < F.col("_a")) | (F.col("_c") > F.col("_b")), F.col("_c"))
    right_end = F.when(((F.col("_d") < F.col("_a")) | (F.col("_d") > F.col("_b"))) & (F.col("_d") != F.col("_c")), F.col("_d"))
    ends = spans.withColumn("_chunk", F.explode(F.array_compact(F.array(left_end, right_end))))
    columns = [*by, *parts, *firsts]
    # The planner sizes the interval lists before they are spread over chunks, so it must not choose to broadcast them.
    covered = inner.hint("merge").join(summaries, [*keys, "_chunk"]).select(*columns)
    single = ends.hint("merge").join(rows, [*keys, "_chunk"]).where(F.col("_at").between(F.col(start), F.col(end))).select(*columns)
    return _from_parts(_merge(covered.unionByName(single), by, list(parts)), by, F.col(start))


def robust_scale(value: Column, low: Column, width: Column) -> Column:
    """Min-max over a range of ``width`` from ``low``, clipped to [0, 1]."""
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / width)))


def _long(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns])))


def robust_minmax(df: DataFrame, columns: list[str], suffix: str = "_scaled") -> DataFrame:
    """Add every column scaled between its 5 % and 95 % quantile over the whole table.

    The bounds of all columns come from one exact quantile job and reach the rows as one scalar row; equal bounds are one
    apart. What is the same for all rows is in that row, so that the code of a row stays short enough to be compiled.
    """
    bounds = exact_quantiles(_long(df, columns), ["metric"], "value", {"lo": 0.05, "hi": 0.95})
    top = F.when(F.col("hi") == F.col("lo"), F.col("lo") + 1.0).otherwise(F.col("hi"))
    one = bounds.withColumn("width", top - F.col("lo")).agg(
        F.struct(
            *[F.max(F.when(F.col("metric") == c, F.col("lo"))).alias(f"lo_{c}") for c in columns],
            *[F.max(F.when(F.col("metric") == c, F.col("width"))).alias(f"width_{c}") for c in columns],
        ).alias("b")
    )
    with_bounds = df.withColumn("_b", one.scalar())
    return with_bounds.withColumns(
        {f"{c}{suffix}": robust_scale(F.col(c), F.col("_b")[f"lo_{c}"], F.col("_b")[f"width_{c}"]) for c in columns}
    ).drop("_b")


def equal_strength(df: DataFrame) -> DataFrame:
    """Add ``<side>_strength_eq``: mean of scaled metrics, those where less is better turned round.

    A missing metric counts as the mean of its scaled column.
    """
    metrics = {s: [f"{s}_{m}" for m in POSITIVE_METRICS + NEGATIVE_METRICS if f"{s}_{m}" in df.columns] for s in SIDES}
    columns = metrics["home"] + metrics["away"]
    scaled = robust_minmax(df, columns)
    good = {c: (F.col(f"{c}_scaled") if c.split("_", 1)[1] in POSITIVE_METRICS else 1.0 - F.col(f"{c}_scaled")) for c in columns}
    scaled = scaled.withColumns({f"_g_{c}": good[c] for c in columns})
    # A column without any value is left out of its side's mean.
    present = {side: sum((F.when(F.count(f"_g_{c}") > 0, 1).otherwise(0) for c in metrics[side]), F.lit(0)) for side in SIDES}
    means = scaled.agg(
        F.struct(
            *[F.coalesce(F.avg(f"_g_{c}"), F.lit(0.0)).alias(c) for c in columns],
            *[F.nullif(n, F.lit(0)).alias(f"_n_{side}") for side, n in present.items()],
        ).alias("m")
    )
    filled = scaled.withColumn("_m", means.scalar())

    def strength(side: str) -> Column:
        return sum((F.coalesce(F.col(f"_g_{c}"), F.col("_m")[c]) for c in metrics[side]), F.lit(0.0)) / F.col("_m")[f"_n_{side}"]

    return filled.withColumns({f"{s}_strength_eq": strength(s) for s in SIDES}).drop(
        "_m", *[f"_g_{c}" for c in columns], *[f"{c}_scaled" for c in columns]
    )


def matchups(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Formation-versus-formation table: number of pairs and the mean of every metric present; NULL groups stay."""
    named = {"strength": "strength_eq"}
    aggs = []
    for m in MATCHUP_METRICS:
        for s in SIDES:
            source = f"{s}_{named.get(m, m)}"
            if source in pairs.columns:
                aggs.append(F.avg(source).alias(f"{s}_{m}"))
    return pairs.groupBy(*by).agg(F.count("home_xg").alias("pairs"), *aggs)
