"""Stable formation blocks and their Gaussian role templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.config import FPS, MIN_BLOCK_SECONDS, ROLLING_ROWS, SHIFT_METRES, TINY_BLOCK_SECONDS
from touchline.functions.keys import known
from touchline.operators.sequences import core_rows, halo_window, next_order, running_max, with_halo

BLOCK_ID_PERIOD = 10_000_000


def _with_means(df: DataFrame, keys: list[str], win: int, rn: str, before: int) -> DataFrame:
    """Halo copies plus ``mean_x``/``mean_y`` over the trailing ``win`` rows of each player.

    Two running sums and their lagged values give each trailing sum in constant time per row.
    """
    group = [*keys, "player"]
    w = halo_window(group, rn)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    both = known("x", "y")
    out = with_halo(df, group, rn, before=before)
    out = out.withColumns(
        {
            "_sx": F.sum(F.when(both, F.col("x")).otherwise(0.0)).over(upto),
            "_sy": F.sum(F.when(both, F.col("y")).otherwise(0.0)).over(upto),
            "_n": F.sum(both.cast("long")).over(upto),
        }
    )

    def trailing(c: str) -> Column:
        return F.col(c) - F.coalesce(F.lag(c, win).over(w), F.lit(0))

    out = out.withColumns({"_tx": trailing("_sx"), "_ty": trailing("_sy"), "_tn": F.nullif(trailing("_n"), F.lit(0))})
    return out.withColumns({"mean_x": F.col("_tx") / F.col("_tn"), "mean_y": F.col("_ty") / F.col("_tn")}).drop(
        "_sx", "_sy", "_n", "_tx", "_ty", "_tn"
    )


def rolling_means(df: DataFrame, keys: list[str], win: int = ROLLING_ROWS, rn: str = "rn") -> DataFrame:
    """Add the mean position of each player over the trailing ``win`` rows; missing points count nothing."""
    return core_rows(_with_means(df, keys, win, rn, win - 1))


def shift_cuts(
    df: DataFrame, keys: list[str], win: int = ROLLING_ROWS, threshold: float = SHIFT_METRES, rn: str = "rn"
) -> DataFrame:
    """Rows where the shape changed: some player's trailing mean moved by more than ``threshold`` within ``win`` rows.

    ``df`` has one row per frame and player. Output: ``keys``, ``cut`` (0-based row before the move) and ``shift``.
    Sequences shorter than two windows have no cuts.
    """
    w = halo_window([*keys, "player"], rn)
    out = _with_means(df, keys, win, rn, 2 * win - 1)
    out = out.withColumn(
        "_move",
        F.hypot(F.col("mean_x") - F.lag("mean_x", win).over(w), F.col("mean_y") - F.lag("mean_y", win).over(w)),
    )
    moves = core_rows(out).groupBy(*keys, rn).agg(F.max("_move").alias("shift"))
    cuts = moves.where((F.col(rn) > win) & (F.col("shift") > threshold))
    long_enough = df.groupBy(*keys).agg(F.max(rn).alias("_rows")).where(F.col("_rows") >= 2 * win).select(*keys)
    return cuts.join(long_enough, keys, "left_semi").select(*keys, (F.col(rn) - 1 - win).alias("cut"), "shift")


def blocks_from_cuts(
    cuts: DataFrame, lengths: DataFrame, keys: list[str], tiny_rows: int = TINY_BLOCK_SECONDS * FPS
) -> DataFrame:
    """Closed row intervals between cuts, covering the sequence.

    ``lengths`` has ``keys`` and ``n_rows``. An interval shorter than ``tiny_rows`` joins the one before it. Output:
    ``keys``, 0-based ``start_row`` and ``end_row``.
    """
    zero = lengths.select(*keys, F.lit(0).cast("long").alias("cut"))
    points = cuts.select(*keys, F.col("cut").cast("long")).where("cut > 0").distinct().unionByName(zero)
    stored = next_order(points, keys, "cut", "_next").join(lengths, keys)
    length = F.coalesce(F.col("_next"), F.col("n_rows")) - F.col("cut")
    starts = stored.where((F.col("cut") == 0) | (length >= tiny_rows)).select(*keys, "n_rows", F.col("cut").alias("start_row"))
    closed = next_order(starts, keys, "start_row", "_next")
    return closed.select(*keys, "start_row", (F.coalesce(F.col("_next"), F.col("n_rows")) - 1).alias("end_row"))


def assign_blocks(frames: DataFrame, blocks: DataFrame, keys: list[str], rn: str = "rn") -> DataFrame:
    """Add ``start_row`` of the block each row belongs to; blocks cover their sequence."""
    starts = blocks.select(*keys, (F.col("start_row") + 1).alias(rn), F.lit(True).alias("_starts"))
    marked = frames.join(starts, [*keys, rn], "left")
    out = running_max(marked, keys, {"start_row": F.when(F.col("_starts"), F.col(rn) - 1)}, rn)
    return out.drop("_starts")


def block_meta(
    frames: DataFrame,
    by: list[str],
    frame: str = "frame",
    has_player: Column | None = None,
    min_seconds: float = MIN_BLOCK_SECONDS,
    fps: float = FPS,
) -> DataFrame:
    """First and last frame, seconds and usable frames per block; blocks under ``min_seconds`` go.

    ``has_player`` says whether a frame has any player.
    """
    usable = F.count(F.lit(1)) if has_player is None else F.sum(has_player.cast("long"))
    out = frames.groupBy(*by).agg(
        F.min(frame).alias("block_start_frame"),
        F.max(frame).alias("block_end_frame"),
        usable.alias("num_frames"),
        (F.count(F.lit(1)) / float(fps)).alias("agg_seconds"),
    )
    return out.where((F.col("agg_seconds") >= min_seconds) & (F.col("num_frames") > 0))


def role_templates(points: DataFrame, by: list[str], player: str = "player") -> DataFrame:
    """Mean and 2 x 2 sample covariance of each player's points per block.

    No points: mean 0. At most one point: covariance 1e-6 on the diagonal.
    """
    x, y = F.when(known("x", "y"), F.col("x")), F.when(known("x", "y"), F.col("y"))
    out = points.groupBy(*by, player).agg(
        F.count(x).alias("n_points"),
        F.avg(x).alias("_mx"),
        F.avg(y).alias("_my"),
        F.var_samp(x).alias("_xx"),
        F.covar_samp(x, y).alias("_xy"),
        F.var_samp(y).alias("_yy"),
    )
    many = F.col("n_points") > 1
    return out.select(
        *by,
        player,
        "n_points",
        F.coalesce("_mx", F.lit(0.0)).alias("mu_x"),
        F.coalesce("_my", F.lit(0.0)).alias("mu_y"),
        F.when(many, F.col("_xx")).otherwise(1e-6).alias("cov_xx"),
        F.when(many, F.col("_xy")).otherwise(0.0).alias("cov_xy"),
        F.when(many, F.col("_yy")).otherwise(1e-6).alias("cov_yy"),
    )


def block_id(period: str | Column, start_frame: str | Column) -> Column:
    period = F.col(period) if isinstance(period, str) else period
    start_frame = F.col(start_frame) if isinstance(start_frame, str) else start_frame
    return period.cast("long") * BLOCK_ID_PERIOD + start_frame
