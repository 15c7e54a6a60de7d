"""Coordinate expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.config import PITCH_LENGTH, PITCH_WIDTH
from touchline.session import stored


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_unit(c: str | Column, extent: float) -> Column:
    """Centre-origin metres to [0, 1]."""
    return (_c(c) + extent / 2.0) / extent


def to_metres(c: str | Column, extent: float) -> Column:
    """[0, 1] to metres from the corner."""
    return _c(c) * extent


def rescale(c: str | Column, source: float, target: float) -> Column:
    """Same point on a pitch of another size, e.g. 120 x 80 to 105 x 68."""
    return _c(c) * target / source


def normalize_players(df: DataFrame, length: float = PITCH_LENGTH, width: float = PITCH_WIDTH) -> DataFrame:
    """Players array and ball of each frame from centre-origin metres to [0, 1]."""
    moved = F.transform(
        "players",
        lambda p: p.withField("x", to_unit(p["x"], length)).withField("y", to_unit(p["y"], width)),
    )
    return df.withColumns(
        {"players": moved, "ball_x": to_unit("ball_x", length), "ball_y": to_unit("ball_y", width)}
    )


def flip(df: DataFrame, columns: list[str]) -> DataFrame:
    """Turn the pitch by half a circle: change the sign of the coordinate columns that exist."""
    return df.withColumns({c: -F.col(c) for c in columns if c in df.columns})


def pixel(c: str | Column, cells: int) -> Column:
    """[0, 1] to a raster index: half-even rounding, clipped to the raster."""
    at = F.bround(_c(c) * cells).cast("int")
    return F.when(at.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(cells - 1), at)))


def goal_x(side: str | Column, length: float = PITCH_LENGTH) -> Column:
    """x of the goal the side attacks, centre-origin metres."""
    return F.when(_c(side) == "home", F.lit(length / 2)).otherwise(F.lit(-length / 2))


def auto_scale(
    df: DataFrame,
    by: list[str],
    extents: dict[str, float],
    required: tuple[str, ...] = ("x", "y"),
    stretch: bool = True,
    margin: float = 0.075,
) -> DataFrame:
    """Bring each coordinate column to pitch metres per group.

    A column whose range lies in [-1, 1] is read as centred (this includes [0, 1] data), then it is stretched to
    leave ``margin`` of the pitch free on both ends and clipped to the pitch. Rows without a start point go. One
    row of extremes per group, written first so that its size is known, joins back to the rows.
    """
    numeric = df.withColumns({c: F.col(c).cast("double") for c in extents})
    clean = numeric.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in extents})
    finite = {c: F.when(F.abs(c) < float("inf"), F.col(c)) for c in extents}
    ends = clean.groupBy(*by).agg(
        *[F.min(c).alias(f"lo_{c}") for c in extents],
        *[F.max(c).alias(f"hi_{c}") for c in extents],
        *[F.min(finite[c]).alias(f"a_{c}") for c in extents],
        *[F.max(finite[c]).alias(f"b_{c}") for c in extents],
    )
    def in_domain(value: Column, c: str) -> Column:
        return F.when(F.col(f"_in_{c}"), (value + 1.0) / 2.0 * extents[c]).otherwise(value)

    # Per group: whether the domain changes, where the stretch begins, and its factor, null where there is no range.
    known = ends.withColumns({f"_in_{c}": (F.col(f"lo_{c}") >= -1.01) & (F.col(f"hi_{c}") <= 1.01) for c in extents})
    known = known.withColumns({f"_{e}_{c}": in_domain(F.col(f"{e}_{c}"), c) for c in extents for e in "ab"})
    grow = {f"_g_{c}": F.when(F.col(f"_b_{c}") > F.col(f"_a_{c}"), (size - 2 * margin * size) / (F.col(f"_b_{c}") - F.col(f"_a_{c}"))) for c, size in extents.items()}
    known = known.withColumns(grow).select(*by, *[f"_{e}_{c}" for c in extents for e in ("in", "a", "g")])
    joined = clean.join(stored(known), by, "left")
    moved = {c: in_domain(F.col(c), c) for c in extents}
    if stretch:
        moved = {c: F.when(F.col(f"_g_{c}").isNotNull(), (moved[c] - F.col(f"_a_{c}")) * F.col(f"_g_{c}") + margin * size).otherwise(moved[c]) for c, size in extents.items()}
    clipped = {
        c: F.when(F.col(c).isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(float(size)), moved[c]))) for c, size in extents.items()
    }
    needed = [c for c in required if c in extents]
    return joined.dropna(subset=needed).withColumns(clipped).select(*df.columns)
