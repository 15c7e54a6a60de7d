"""The steps from normalised frames to formation match-ups, for any number of matches at once.

Frames: ``provider``, ``match_id``, ``period_id``, ``frame``, ``team_possession``, ``original_event``, ``players``
(array of side, player, x, y in [0, 1]), ``ball_x``, ``ball_y``, ``phase_home``, ``phase_away``; alive frames only.
Each step's result is stored in the shared folder where several later steps read it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.config import (
    FPS,
    K_MAX,
    MIN_BLOCK_SECONDS,
    MIN_OVERLAP_SECONDS,
    PITCH_LENGTH,
    PITCH_WIDTH,
    PROVIDERS,
    ROLLING_ROWS,
    SHIFT_METRES,
    TINY_BLOCK_SECONDS,
    TRANSITION_SECONDS,
    ProviderConfig,
)
from touchline.functions.coords import to_metres
from touchline.functions.shapes import canonical_outfield, centred, chain_order
from touchline.operators import blocks as bl
from touchline.operators import formations as fm
from touchline.operators import joins, masks, metrics, strengths
from touchline.operators.sequences import number_rows
from touchline.session import stored
from touchline.sources.layouts import positions

SEQUENCE = ["provider", "match_id", "period_id"]
BLOCK = ["provider", "match_id", "side", "phase", "period_id", "block_id"]
GROUP = ["provider", "side", "phase"]
WITHIN = ["match_id", "period_id", "block_id"]


@dataclass(frozen=True)
class Settings:
    """Frame rate and window lengths of an analysis."""

    fps: int = FPS
    pad_rows: int = TRANSITION_SECONDS * FPS
    rolling_rows: int = ROLLING_ROWS
    shift_metres: float = SHIFT_METRES
    tiny_rows: int = TINY_BLOCK_SECONDS * FPS
    min_block_seconds: float = MIN_BLOCK_SECONDS
    min_overlap_frames: int = MIN_OVERLAP_SECONDS * FPS
    k_max: int = K_MAX


MASKS = ["set_piece", "transition", "drop3_home", "drop3_away", "eligible_home", "eligible_away", "full_window"]


def masked_frames(frames: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Frames numbered within their period, with all masks.

    The masks are worked out on the few columns they read; the players move once, to meet them by frame.
    """
    narrow = frames.select(*SEQUENCE, "frame", "team_possession", "original_event", "phase_home", "phase_away")
    masked = masks.frame_masks(number_rows(narrow, SEQUENCE, "frame"), pad=settings.pad_rows, keys=SEQUENCE)
    return stored(frames.join(masked.select(*SEQUENCE, "frame", "rn", *MASKS), [*SEQUENCE, "frame"]))


def _in_metres(players: F.Column) -> F.Column:
    return F.transform(players, lambda p: p.withField("x", to_metres(p["x"], PITCH_LENGTH)).withField("y", to_metres(p["y"], PITCH_WIDTH)))


def role_templates(masked: DataFrame, side: str, settings: Settings = Settings()) -> DataFrame:
    """Gaussian role templates of one side's stable blocks, one row per block and player."""
    keys = [*SEQUENCE, "phase"]
    own = F.filter("players", lambda p: p["side"] == side)
    rows = masked.where(F.col(f"eligible_{side}")).select(
        *SEQUENCE, "frame", F.col(f"phase_{side}").alias("phase"), centred(_in_metres(own)).alias("players")
    )
    rows = stored(number_rows(rows, keys, "frame"))
    points = positions(rows).drop("side")
    cuts = bl.shift_cuts(points, keys, settings.rolling_rows, settings.shift_metres)
    lengths = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    spans = bl.blocks_from_cuts(cuts, lengths, keys, settings.tiny_rows)
    # Blocks cover their sequence, so every row meets exactly one of them.
    ends = spans.select(*keys, "start_row", (F.col("start_row") + 1).alias("_from"), (F.col("end_row") + 1).alias("_to"))
    placed = stored(joins.frames_in_intervals(rows, ends, keys, "_from", "_to", "rn").drop("_from", "_to"))
    by = [*keys, "start_row"]
    known = F.size(F.filter("players", lambda p: p["x"].isNotNull() & p["y"].isNotNull())) > 0
    meta = bl.block_meta(placed, by, has_player=known, min_seconds=settings.min_block_seconds, fps=settings.fps)
    roles = bl.role_templates(positions(placed).drop("side"), by)
    # Rows of one block are a squad.
    order = Window.partitionBy(*by).orderBy("player")
    return (
        roles.join(meta, by)
        .withColumns(
            {
                "side": F.lit(side),
                "block_id": bl.block_id("period_id", "block_start_frame"),
                "role_index": F.row_number().over(order),
            }
        )
        .drop("start_row")
    )


BLOCK_META = ["block_start_frame", "block_end_frame", "num_frames", "agg_seconds"]


def ordered_roles(templates: DataFrame) -> DataFrame:
    """Roles of each block in nearest-neighbour order from left to right, with their original index."""
    role = F.struct("role_index", F.col("mu_x").alias("x"), F.col("mu_y").alias("y"), "cov_xx", "cov_xy", "cov_yy")
    packed = templates.groupBy(*BLOCK, *BLOCK_META).agg(F.array_sort(F.collect_list(role)).alias("_roles"))
    walked = packed.withColumn("_order", chain_order(F.col("_roles")))
    placed = walked.withColumn("_sorted", F.transform("_order", lambda i: F.get("_roles", i)))
    return placed.select(*BLOCK, *BLOCK_META, F.posexplode("_sorted").alias("_pos", "_r")).select(
        *BLOCK,
        *BLOCK_META,
        (F.col("_pos") + 1).alias("role_index"),
        F.col("_r.role_index").alias("orig_role_index"),
        F.col("_r.x").alias("mu_x"),
        F.col("_r.y").alias("mu_y"),
        F.col("_r.cov_xx").alias("cov_xx"),
        F.col("_r.cov_xy").alias("cov_xy"),
        F.col("_r.cov_yy").alias("cov_yy"),
    )


def formation_predictions(
    ordered: DataFrame, settings: Settings = Settings(), fallback: DataFrame | None = None, lines: str = "gap"
) -> DataFrame:
    """Formation of each block by clustering, naming and template matching within its provider, side and phase."""
    role = F.struct("role_index", F.col("mu_x").alias("x"), F.col("mu_y").alias("y"))
    packed = ordered.groupBy(*BLOCK, *BLOCK_META).agg(F.array_sort(F.collect_list(role)).alias("_roles"))
    shapes = packed.withColumn("pts", canonical_outfield(F.col("_roles"))).where("pts IS NOT NULL").drop("_roles")
    shapes = stored(shapes)
    clusters = stored(fm.cluster_blocks(shapes, GROUP, WITHIN, k_max=settings.k_max))
    templates = fm.cluster_templates(shapes, clusters, GROUP, WITHIN)
    named = stored(fm.named_templates(templates, GROUP, "phase", lines))
    matches = stored(fm.match_templates(shapes, named, GROUP, WITHIN))
    gates = fm.robust_gates(matches, GROUP)
    return fm.predict_formations(shapes.drop("pts"), matches, gates, GROUP, WITHIN, clusters, fallback)


def block_pairs(templates: DataFrame, predictions: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Overlapping home and away blocks with their formations and shared frames."""
    named = joins.block_forms(joins.block_windows(templates, BLOCK), predictions, BLOCK)
    side = lambda s: named.where(F.col("side") == s).drop("side")
    pairs = joins.interval_pairs(side("home"), side("away"), SEQUENCE, settings.min_overlap_frames)
    return pairs.select(
        *SEQUENCE,
        "home_block_id",
        "away_block_id",
        F.col("home_phase").alias("phase_home"),
        F.col("away_phase").alias("phase_away"),
        F.col("home_predicted_formation").alias("home_form"),
        F.col("away_predicted_formation").alias("away_form"),
        "pair_start",
        "pair_end",
    )


PAIR = [*SEQUENCE, "home_block_id", "away_block_id", "phase_home", "phase_away", "pair_start"]


def pair_metrics(
    masked: DataFrame, pairs: DataFrame, xg_coefficients: tuple[float, float, float], cfg: ProviderConfig = PROVIDERS["sportec"]
) -> DataFrame:
    """All metrics of each pair of blocks, with equal-weight strengths."""
    columns = [*SEQUENCE, "frame", "rn", "team_possession", "original_event", "ball_x", "ball_y"]
    event = ["event_type"] if "event_type" in masked.columns else []
    metre = F.transform(
        "players",
        lambda p: p.withField("x", (p["x"] - 0.5) * PITCH_LENGTH).withField("y", (p["y"] - 0.5) * PITCH_WIDTH),
    )
    facts = stored(metrics.frame_facts(masked.select(*columns, *event, metre.alias("players")), xg_coefficients, cfg, SEQUENCE))
    measured = metrics.interval_metrics(facts, pairs, SEQUENCE, PAIR)
    return stored(measured.join(pairs.select(*PAIR, "home_form", "away_form"), PAIR))


def matchup_table(measured: DataFrame) -> DataFrame:
    """Formation-versus-formation means over all pairs, with both strengths; NULL formations and phases are groups."""
    rated = strengths.ml_strength(stored(metrics.equal_strength(measured)), PAIR)
    return metrics.matchups(rated, ["provider", "phase_home", "phase_away", "home_form", "away_form"])


def analyse_matches(
    frames: DataFrame, xg_coefficients: tuple[float, float, float], settings: Settings = Settings(), cfg: ProviderConfig = PROVIDERS["sportec"]
) -> dict[str, DataFrame]:
    """Every table of the analysis: masks, templates, predictions, pairs with metrics and match-ups."""
    masked = masked_frames(frames, settings)
    both = role_templates(masked, "home", settings).unionByName(role_templates(masked, "away", settings))
    templates = stored(ordered_roles(stored(both)))
    predictions = stored(formation_predictions(templates, settings))
    pairs = stored(block_pairs(templates, predictions, settings))
    measured = pair_metrics(masked, pairs, xg_coefficients, cfg)
    return {
        "frames": masked,
        "templates": templates,
        "predictions": predictions,
        "pairs": measured,
        "matchups": matchup_table(measured),
    }
