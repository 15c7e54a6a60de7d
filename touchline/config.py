"""Default parameters, event vocabularies and provider layouts."""

from __future__ import annotations

from dataclasses import dataclass

# Frame rate, pitch, windows and thresholds of the analysis.
FPS = 25
PITCH_LENGTH = 105.0
PITCH_WIDTH = 68.0
WINDOW_FRAMES = 13
TRANSITION_SECONDS = 3
PAD_ROWS = TRANSITION_SECONDS * FPS
ROLLING_ROWS = 2 * 60 * FPS
SHIFT_METRES = 7.0
MIN_BLOCK_SECONDS = 45
TINY_BLOCK_SECONDS = 5
OUTFIELD = 10
K_MIN, K_MAX = 3, 12
COST_CAP = 1500.0
MARGIN_FLOOR = 50.0
MIN_OVERLAP_SECONDS = 10
FUSION_ALPHA, FUSION_BETA, TOP_K = 0.55, 0.45, 3

# Event label vocabularies.
SET_PIECE_LABELS = [
    "set piece", "corner", "free_kick", "throw_in", "penalty", "goal_kick", "kick_off", "offside",
    "drop_ball", "freekick", "throwin", "goalkick", "kickoff", "cornerkick",
]
SHOT_PATTERN = "shot|goal"
PASS_PATTERN = "pass|cross"
DEFENCE_PATTERN = "tackle|intercept|recover|clear|foul|duel"
SUCCESS_TOKENS = ["true", "t", "1", "yes", "y", "successful"]
GOAL_TOKENS = ["true", "t", "y", "yes", "1", "success", "successful", "goal"]
SHOT_LABELS = ["shotwide", "successfulshot", "savedshot", "blockedshot", "shotwoodwork"]

# Formations allowed per phase of play, in order of preference.
ALLOWED_FORMATIONS = {
    "build-up": ["2-4-3-1", "2-4-4", "2-1-4-3", "3-4-3", "3-1-4-2", "3-5-2", "3-4-2-1", "4-3-3", "4-2-3-1", "4-4-2"],
    "mid-block": ["4-2-3-1", "4-4-2", "4-1-4-1", "4-3-2-1", "5-3-2", "5-2-3"],
    "high-block": ["4-4-2", "4-2-3-1", "4-3-3"],
    "low-block": ["5-4-1", "5-3-2", "4-5-1", "4-4-2"],
    "attacking-play": ["2-4-4", "2-3-2-3", "3-4-3", "3-2-4-1", "4-2-3-1", "4-3-3"],
}

# Classes used when no label map is given.
FALLBACK_CLASSES = ["4-2-3-1", "4-4-2", "4-3-3"]
DEFAULT_FORMATION = "4-2-3-1"

# Thresholds of the playing-style rules.
STYLE_THRESHOLDS = {
    "ppda_high": 12.0,
    "ppda_low": 7.0,
    "press_rate_high": 0.33,
    "avg_press_high": 55.0,
    "width_high": 38.0,
    "width_low": 28.0,
    "depth_high": 40.0,
    "depth_low": 30.0,
    "possession_low": 44.0,
    "possession_high": 56.0,
    "xt_high": 0.25,
}

# Weights of the matchup prior per strategy; metrics of NEGATIVE_METRICS count as one minus their share.
STRATEGY_WEIGHTS = {
    "attack": {"strength": 0.35, "xt": 0.35, "ppda": 0.10, "ppda_press": 0.05, "press_rate": 0.05, "avg_press": 0.05},
    "defense": {"strength": 0.25, "xt": 0.10, "ppda": 0.30, "ppda_press": 0.15, "press_rate": 0.15, "avg_press": 0.05},
    "mixed": {"strength": 0.50, "xt": 0.20, "ppda": 0.15, "ppda_press": 0.05, "press_rate": 0.05, "avg_press": 0.05},
}

# Metrics where more is better and where less is better.
POSITIVE_METRICS = ["xg", "xt", "press_rate", "avg_press", "possession_pct"]
NEGATIVE_METRICS = ["ppda", "ppda_press", "recovery_s"]


@dataclass(frozen=True)
class ProviderConfig:
    """Column names, possession tags and event vocabularies of one data provider."""

    name: str
    home_tag: str = "home"
    away_tag: str = "away"
    shot_types: tuple[str, ...] = ()
    pass_types: tuple[str, ...] = ()
    defence_types: tuple[str, ...] = ()
    period_col: str = "period_id"
    possession_col: str = "team_possession"
    receiver_col: str = "receiver_player_id"
    start_cols: tuple[str, str] = ("coordinates_x", "coordinates_y")
    end_cols: tuple[str, str] = ("end_coordinates_x", "end_coordinates_y")
    pass_value: str = "pass"


# The two provider layouts.
PROVIDERS = {
    "sportec": ProviderConfig(
        name="sportec",
        shot_types=("SHOTWIDE", "SUCCESSFULSHOT", "SAVEDSHOT", "BLOCKEDSHOT", "SHOTWOODWORK"),
        pass_types=("PASS", "CROSS", "FREEKICKPASS", "GOAL_KICK"),
        defence_types=("TACKLE", "INTERCEPTION", "CHALLENGE", "CLEARANCE", "BALL_RECOVERY", "FOUL"),
    ),
    "metrica": ProviderConfig(
        name="metrica",
        home_tag="FIFATMA",
        away_tag="FIFATBA",
        shot_types=("SHOT", "GOAL"),
        pass_types=("PASS", "CROSS"),
        defence_types=("TACKLE", "INTERCEPTION", "CHALLENGE", "CLEARANCE", "RECOVERY", "FOUL"),
        period_col="period_id_x",
        possession_col="team_id",
        receiver_col="to_player_id",
        start_cols=("start_x", "start_y"),
        end_cols=("end_x", "end_y"),
    ),
}
