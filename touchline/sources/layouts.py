"""Frame layouts: wide tables, match metadata and additive schemas."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.config import ProviderConfig

# Fixed value: names of the player coordinate columns of a wide tracking table.
PLAYER_COLUMN = re.compile(r"^(home|away)_(.+)_x$")


def player_columns(columns: list[str]) -> list[tuple[str, str]]:
    """(side, player) of every ``<side>_<player>_x`` column that has its ``_y``, sorted."""
    found = [m.groups() for m in map(PLAYER_COLUMN.match, columns) if m]
    return sorted((s, p) for s, p in found if f"{s}_{p}_y" in columns)


def from_wide(df: DataFrame) -> DataFrame:
    """Replace two columns per player by one ``players`` array, so that squads of any match share one schema."""
    named = player_columns(df.columns)
    coordinate = {f"{s}_{p}_{axis}" for s, p in named for axis in "xy"}
    keep = [c for c in df.columns if c not in coordinate]

    def number(c: str):
        return F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))

    players = F.array(
        *[
            F.struct(
                F.lit(s).alias("side"), F.lit(p).alias("player"), number(f"{s}_{p}_x").alias("x"), number(f"{s}_{p}_y").alias("y")
            )
            for s, p in named
        ]
    )
    return df.select(*keep, players.alias("players"))


def positions(df: DataFrame) -> DataFrame:
    """Long view: one row per frame and player."""
    keep = [c for c in df.columns if c != "players"]
    return df.select(*keep, F.inline("players"))


def canonical_events(events: DataFrame, provider: ProviderConfig) -> DataFrame:
    """A provider's columns under the names the analysis reads; columns that are not there are left out."""
    default = ProviderConfig(name="")
    names = {getattr(provider, f): getattr(default, f) for f in ("period_col", "possession_col", "receiver_col")}
    names |= dict(zip((*provider.start_cols, *provider.end_cols), (*default.start_cols, *default.end_cols)))
    renamed = {a: b for a, b in names.items() if a != b and a in events.columns}
    side = F.when(F.col(provider.possession_col) == provider.home_tag, "home").when(F.col(provider.possession_col) == provider.away_tag, "away")
    tagged = events.withColumn(provider.possession_col, side) if provider.possession_col in events.columns else events
    return tagged.withColumnsRenamed(renamed)


def attach_match_meta(frames: DataFrame, matches: DataFrame, run_key: str = "run_key") -> DataFrame:
    """Add team names, score and pitch of the match and the run id ``<match>_<8 hex of the run key>``.

    The match table is small next to the frames but grows with them, so its size decides the join at run time.
    """
    run = F.concat("match_id", F.lit("_"), F.substring(F.md5(F.col(run_key).cast("string")), 1, 8))
    return frames.join(matches.withColumn("unique_match_id", run).drop(run_key), "match_id", "left")


def append_columns(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both; columns missing on either side are NULL there."""
    return old.unionByName(new, allowMissingColumns=True)
