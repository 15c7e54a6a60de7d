"""Frame masks: possession changes, transitions, phase starts, eligibility and full windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.config import PAD_ROWS, PROVIDERS, WINDOW_FRAMES, ProviderConfig
from touchline.functions.events import is_set_piece
from touchline.functions.keys import join_keys
from touchline.operators.sequences import core_rows, halo_window, running_max, with_halo
from touchline.session import stored

SEQUENCE = ["match_id", "period_id"]


def _changed(value: Column, window: Window) -> Column:
    """Differs from the previous row, both known."""
    return F.coalesce(value != F.lag(value).over(window), F.lit(False))


def _within_pad(flag: str, window: Window, rn: str, pad: int) -> Column:
    """The row itself or one of the ``pad`` rows before it is flagged."""
    latest = F.max(F.when(F.col(flag), F.col(rn))).over(window.rowsBetween(Window.unboundedPreceding, 0))
    return F.coalesce(F.col(rn) - latest <= pad, F.lit(False))


def possession_changes(
    df: DataFrame, possession: str = "team_possession", keys: list[str] = SEQUENCE, rn: str = "rn"
) -> DataFrame:
    """Add ``changed``: the side in possession differs from the previous row's, both known."""
    w = halo_window(keys, rn)
    halo = with_halo(df, keys, rn, before=1)
    return core_rows(halo.withColumn("changed", _changed(F.lower(possession), w)))


def mask_after_change(
    df: DataFrame, column: str, name: str, pad: int = PAD_ROWS, keys: list[str] = SEQUENCE, rn: str = "rn"
) -> DataFrame:
    """Add ``name``: true on each change of ``column`` and the ``pad`` rows after it."""
    w = halo_window(keys, rn)
    halo = with_halo(df, keys, rn, before=pad + 1).withColumn("_change", _changed(F.lower(column), w))
    return core_rows(halo.withColumn(name, _within_pad("_change", w, rn, pad)).drop("_change"))


def frame_masks(
    df: DataFrame,
    label: str = "original_event",
    possession: str = "team_possession",
    phases: dict[str, str] | None = None,
    pad: int = PAD_ROWS,
    window_rows: int = WINDOW_FRAMES,
    in_play: str | None = None,
    keys: list[str] = SEQUENCE,
    rn: str = "rn",
) -> DataFrame:
    """All masks of a frame in one pass over its sequence.

    Adds ``set_piece``, ``transition``, per side ``drop3_<side>`` and ``eligible_<side>``, and ``full_window``: every
    row of the centred window is in play, no set piece and no transition.
    """
    phases = phases or {"home": "phase_home", "away": "phase_away"}
    radius = window_rows // 2
    w = halo_window(keys, rn)
    out = with_halo(df, keys, rn, before=pad + 1 + radius, after=radius)
    out = out.withColumn("set_piece", is_set_piece(label)).withColumn("_change", _changed(F.lower(possession), w))
    out = out.withColumns({f"_start_{side}": _changed(F.col(phase), w) for side, phase in phases.items()})
    out = out.withColumn("transition", _within_pad("_change", w, rn, pad))
    out = out.withColumns({f"drop3_{side}": _within_pad(f"_start_{side}", w, rn, pad) for side in phases})
    calm = ~F.col("set_piece") & ~F.col("transition")
    out = out.withColumns(
        {f"eligible_{side}": calm & F.col(phase).isNotNull() & ~F.col(f"drop3_{side}") for side, phase in phases.items()}
    )
    usable = calm & F.coalesce(F.col(in_play).cast("boolean"), F.lit(False)) if in_play else calm
    inside = F.sum(usable.cast("int")).over(w.rowsBetween(-radius, radius))
    out = out.withColumn("full_window", inside == 2 * radius + 1)
    return core_rows(out.drop("_change", *[f"_start_{side}" for side in phases]))


def full_windows(
    df: DataFrame, usable: str, window_rows: int = WINDOW_FRAMES, keys: list[str] = SEQUENCE, rn: str = "rn"
) -> DataFrame:
    """Add ``full_window``: all rows of the centred window are usable; rows near the ends are not."""
    radius = window_rows // 2
    w = halo_window(keys, rn)
    halo = with_halo(df, keys, rn, before=radius, after=radius)
    inside = F.sum(F.col(usable).cast("int")).over(w.rowsBetween(-radius, radius))
    return core_rows(halo.withColumn("full_window", F.coalesce(inside == 2 * radius + 1, F.lit(False))))


def possession_side(cfg: ProviderConfig = PROVIDERS["sportec"], possession: str = "team_possession") -> Column:
    """'home', 'away', or the lower-case tag as it is; '' when unknown."""
    tag = F.lower(F.coalesce(F.col(possession).cast("string"), F.lit("")))
    return F.when(tag == cfg.home_tag.lower(), "home").when(tag == cfg.away_tag.lower(), "away").otherwise(tag)


def possession_steps(
    df: DataFrame,
    cfg: ProviderConfig = PROVIDERS["sportec"],
    possession: str = "team_possession",
    keys: list[str] = SEQUENCE,
    rn: str = "rn",
    order: str = "frame",
) -> DataFrame:
    """Per row, what the possession metrics of any window need.

    Adds ``poss`` ('home', 'away' or ''), ``prev_frame``, per side ``to_<side>`` (possession arrives on this row) and,
    on those rows, ``<side>_gap`` (rows since that side last lost the ball) with ``<side>_lost_after``, the frame
    before that loss. A loss belongs to a window exactly when ``<side>_lost_after`` lies in it, so windows of any
    length are plain filters on these columns.
    """
    w = halo_window(keys, rn)
    out = with_halo(df.withColumn("poss", possession_side(cfg, possession)), keys, rn, before=1)
    out = out.withColumn("_prev", F.lag("poss").over(w)).withColumn("prev_frame", F.lag(order).over(w))
    moved = F.col("_prev").isNotNull() & (F.col("poss") != F.col("_prev"))
    out = out.withColumn("_moved", moved)
    sides = ("home", "away")
    out = core_rows(out.withColumns({f"to_{s}": F.col("_moved") & (F.col("poss") == s) for s in sides}))
    lost = {s: F.col("_moved") & (F.col("_prev") == s) for s in sides}
    carried = {}
    for s in sides:
        carried[f"_lost_rn_{s}"] = F.when(lost[s], F.col(rn))
        carried[f"_lost_after_{s}"] = F.when(lost[s], F.col("prev_frame"))
    out = running_max(out, keys, carried, rn)
    return out.withColumns(
        {
            **{f"{s}_gap": F.when(F.col(f"to_{s}"), F.col(rn) - F.col(f"_lost_rn_{s}")) for s in sides},
            **{f"{s}_lost_after": F.when(F.col(f"to_{s}"), F.col(f"_lost_after_{s}")) for s in sides},
        }
    ).drop("_prev", "_moved", *carried)


def recovery_points(df: DataFrame, side: str, keys: list[str] = SEQUENCE, rn: str = "rn") -> DataFrame:
    """Ball position at the rows where possession arrives at a side; ``side`` is the possession value to look for.

    The first row of a sequence and the first known value after an unknown one do not count.
    """
    w = halo_window(keys, rn)
    tag = F.lower(F.col("team_possession").cast("string"))
    halo = with_halo(df, keys, rn, before=1)
    prev = F.lag("team_possession").over(w)
    halo = halo.withColumn("_arrives", (tag == side.lower()) & F.coalesce(F.col("team_possession") != prev, F.lit(False)))
    return core_rows(halo.where("_arrives").drop("_arrives")).where("ball_x IS NOT NULL AND ball_y IS NOT NULL")


def recoveries(df: DataFrame, teams: DataFrame, match: str = "match_id", keys: list[str] = SEQUENCE, rn: str = "rn") -> DataFrame:
    """Ball position at the rows where possession arrives at a side, with ``side``; ``teams`` has a match's ``side``, ``team_id``.

    A match in which any row has the possession ``home`` or ``away`` is read by side tags, any other one by team ids, so the
    caller need not know. All rows of a match decide, by one aggregate per match; tags and ids are compared in lower case.
    Matches without a row in ``teams`` are read by tags only; a NULL side or id names nobody, and repeated rows of ``teams``
    count once. The first row of a sequence and the first known value after an unknown one do not count. A column ``side``
    of ``df`` is replaced.
    """
    tag = F.lower(F.col("team_possession").cast("string"))
    tagged = df.groupBy(match).agg(F.coalesce(F.max(tag.isin("home", "away")), F.lit(False)).alias("_tagged"))
    named = teams.select(match, F.lower("side").alias("side"), F.lower(F.col("team_id").cast("string")).alias("_name")).where("side IS NOT NULL AND _name IS NOT NULL")
    by_id = join_keys(tagged.where("NOT _tagged"), named.distinct(), [match]).select(match, "side", "_name")
    tags = F.inline(F.array(*[F.struct(F.lit(s).alias("side"), F.lit(s).alias("_name")) for s in ("home", "away")]))
    wanted = stored(by_id.unionByName(tagged.where("_tagged").select(match, tags)))
    w = halo_window(keys, rn)
    halo = with_halo(df.drop("side"), keys, rn, before=1)
    halo = halo.withColumn("_moved", F.coalesce(F.col("team_possession") != F.lag("team_possession").over(w), F.lit(False)))
    moved = core_rows(halo.where("_moved").drop("_moved")).where("ball_x IS NOT NULL AND ball_y IS NOT NULL")
    return join_keys(moved.withColumn("_name", tag), wanted, [match, "_name"]).drop("_name")


def first_per_key(df: DataFrame, key: list[str], order: list[str | Column]) -> DataFrame:
    """Keep the first row of each key; rows are cut to one per key on the map side before the shuffle."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")
