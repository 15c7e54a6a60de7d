"""Joins of frames, events, blocks and intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.config import FPS, MIN_OVERLAP_SECONDS, WINDOW_FRAMES
from touchline.functions.events import clean_number_id, leading_digits
from touchline.operators.masks import first_per_key
from touchline.session import stored

BUCKET_FRAMES = 3_000
FRAME_BUCKET = 512


def nearest_in_time(
    frames: DataFrame,
    events: DataFrame,
    keys: list[str],
    tolerance_seconds: float = 1.0,
    ts: str = "ts",
    frame: str = "frame",
    event: str = "event_id",
    span_seconds: float | None = None,
) -> DataFrame:
    """Give each event the frame nearest in time within the tolerance (the earlier one on ties), else NULL.

    Time is cut into spans of at least the tolerance; a frame is copied into a neighbouring span only when it lies
    within the tolerance of its border, so a span holds its own rows plus a thin edge and a long match is spread
    over many tasks. Output: events with ``frame`` and ``offset_us`` (frame time minus event time).
    """
    tol = int(tolerance_seconds * 1_000_000)
    span = int(max(span_seconds or 60.0, tolerance_seconds) * 1_000_000)

    def micros(c: str) -> Column:
        return F.unix_micros(F.col(c).cast("timestamp"))

    f = frames.select(*keys, micros(ts).alias("_t"), F.col(frame).alias("_frame"))
    first = F.floor((F.col("_t") - tol) / span).cast("long")
    last = F.floor((F.col("_t") + tol) / span).cast("long")
    f = f.withColumn("_span", F.explode(F.sequence(first, last)))
    e = events.withColumn("_t", micros(ts)).withColumn("_span", F.floor(F.col("_t") / span).cast("long"))
    both = e.withColumn("_is_event", F.lit(1)).unionByName(
        f.withColumn("_is_event", F.lit(0)), allowMissingColumns=True
    )
    mark = F.when(F.col("_is_event") == 0, F.struct("_t", "_frame"))
    # Looking ahead is looking back in reverse order: one running value per row in both directions.
    span_rows = Window.partitionBy(*keys, "_span")
    forth = span_rows.orderBy("_t", "_is_event", "_frame").rowsBetween(Window.unboundedPreceding, 0)
    reverse = span_rows.orderBy(F.col("_t").desc(), "_is_event", F.col("_frame").desc()).rowsBetween(Window.unboundedPreceding, 0)
    back = F.last(mark, ignorenulls=True).over(forth)
    ahead = F.last(mark, ignorenulls=True).over(reverse)
    out = both.withColumns({"_back": back, "_ahead": ahead}).where("_is_event = 1")
    behind, front = F.col("_t") - F.col("_back")["_t"], F.col("_ahead")["_t"] - F.col("_t")
    use_back = (behind <= tol) & F.coalesce(behind <= front, F.lit(True))
    pick = F.when(use_back, F.col("_back")).when(front <= tol, F.col("_ahead"))
    return out.withColumn("_pick", pick).select(
        *events.columns, F.col("_pick")["_frame"].alias(frame), (F.col("_pick")["_t"] - F.col("_t")).alias("offset_us")
    )


def merge_frames_events(
    frames: DataFrame,
    events: DataFrame,
    run: str = "unique_match_id",
    frame_event_id: str = "original_event_id",
    event_id: str = "event_id",
    order: list[str] | None = None,
    keep: tuple[str, ...] = (
        "event_type", "team_id", "player_id", "coordinates_x", "coordinates_y", "end_coordinates_x",
        "end_coordinates_y", "receiver_player_id", "result", "success",
    ),
) -> DataFrame:
    """Frames with the columns of their event: alive events, the first one per cleaned id, left join.

    Most frames carry no event id. They meet no event, so they pass by the join without a shuffle. Columns present on both sides get the suffix ``_event`` on the event side.
    """
    e = events.where("ball_state = 'alive'") if "ball_state" in events.columns else events
    e = e.withColumn("_id", leading_digits(event_id)).where("_id IS NOT NULL")
    e = first_per_key(e, [run, "_id"], order or [event_id])
    kept = [c for c in keep if c in e.columns]
    renamed = [F.col(c).alias(f"{c}_event" if c in frames.columns else c) for c in kept]
    e = e.select(F.col(run).alias("_run"), F.col("_id").alias("_event"), *renamed)
    f = frames.withColumn("_clean", clean_number_id(frame_event_id))
    met = f.where("_clean IS NOT NULL").join(e, (F.col(run) == F.col("_run")) & (F.col("_clean") == F.col("_event")), "left")
    without = f.where("_clean IS NULL").drop("_clean")
    return met.drop("_clean", "_run", "_event").unionByName(without, allowMissingColumns=True)


def update_from_stage(target: DataFrame, stage: DataFrame, keys: list[str]) -> DataFrame:
    """Write the stage's values onto the target rows of the same key; rows without a stage row keep theirs."""
    values = [c for c in stage.columns if c not in keys]
    s = stage.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in values], F.lit(True).alias("_staged"))
    joined = target.join(s, keys, "left")
    new = {c: F.when(F.col("_staged"), F.col(f"_new_{c}")) for c in values}
    out = {c: F.when(F.col("_staged"), F.col(f"_new_{c}")).otherwise(F.col(c)) if c in target.columns else new[c] for c in values}
    order = [*target.columns, *[c for c in values if c not in target.columns]]
    return joined.withColumns(out).select(*order)


def block_windows(templates: DataFrame, block: list[str]) -> DataFrame:
    """First and last frame of each block from its template rows, one per role."""
    return templates.groupBy(*block).agg(F.min("block_start_frame").alias("start_frame"), F.max("block_end_frame").alias("end_frame"))


def block_forms(windows: DataFrame, forms: DataFrame, keys: list[str]) -> DataFrame:
    """Block windows with their predicted formation, NULL where none was predicted."""
    return windows.join(forms.select(*keys, "predicted_formation"), keys, "left")


def interval_pairs(
    home: DataFrame,
    away: DataFrame,
    keys: list[str],
    min_overlap: int = MIN_OVERLAP_SECONDS * FPS,
    bucket: int = BUCKET_FRAMES,
    start: str = "start_frame",
    end: str = "end_frame",
) -> DataFrame:
    """Pairs of intervals that share at least ``min_overlap`` frames, with the shared interval.

    Both sides are listed under every frame bucket they touch and meet by equality of ``keys`` and bucket; a pair is
    kept in the bucket where its shared interval begins, so it appears once. The bucket spreads a crowded match.
    Non-key columns come back with the prefixes ``home_`` and ``away_``.
    """

    def listed(df: DataFrame, side: str) -> DataFrame:
        named = df.select(*keys, *[F.col(c).alias(f"{side}_{c}") for c in df.columns if c not in keys])
        first = F.floor(F.col(f"{side}_{start}") / bucket).cast("long")
        last = F.floor(F.col(f"{side}_{end}") / bucket).cast("long")
        return named.withColumn("_bucket", F.explode(F.sequence(first, last)))

    h, a = listed(home, "home"), listed(away, "away")
    begin = F.greatest(f"home_{start}", f"away_{start}")
    finish = F.least(f"home_{end}", f"away_{end}")
    # Listed intervals outgrow the planner's size estimate, so neither side is left for it to broadcast.
    met = h.hint("merge").join(a, [*keys, "_bucket"]).where(
        (finish - begin + 1 >= min_overlap) & (finish >= begin) & (F.floor(begin / bucket) == F.col("_bucket"))
    )
    return met.withColumns({"pair_start": begin, "pair_end": finish}).drop("_bucket")


def frames_in_intervals(
    frames: DataFrame,
    intervals: DataFrame,
    keys: list[str],
    start: str = "pair_start",
    end: str = "pair_end",
    frame: str = "frame",
    bucket: int = FRAME_BUCKET,
) -> DataFrame:
    """Each frame joined to every interval that contains it, by equality of keys and frame bucket.

    Buckets are shorter than the usual interval, so few frames meet an interval that only touches their bucket. For
    metrics of intervals use ``interval_metrics``, which does not list the frames.
    """
    first, last = F.floor(F.col(start) / bucket).cast("long"), F.floor(F.col(end) / bucket).cast("long")
    i = intervals.withColumn("_bucket", F.explode(F.sequence(first, last)))
    f = frames.withColumn("_bucket", F.floor(F.col(frame) / bucket).cast("long"))
    return f.join(i.hint("merge"), [*keys, "_bucket"]).where(F.col(frame).between(F.col(start), F.col(end))).drop("_bucket")


def block_center_frames(
    blocks: DataFrame,
    frames: DataFrame,
    keys: list[str],
    window_rows: int = WINDOW_FRAMES,
    start: str = "start_frame",
    end: str = "end_frame",
    frame: str = "frame",
) -> DataFrame:
    """Frames of the window round each block's middle frame.

    When fewer than ``window_rows`` frames exist there, only those inside the block count. The window is listed frame
    by frame, so the join is on equality. Output: block columns with the frame's columns.
    """
    half = window_rows // 2
    centre = F.floor((F.col(start) + F.col(end)) / 2).cast("long")
    block_cols = blocks.columns
    b = blocks.withColumn("_centre", centre)
    listed = b.withColumn(frame, F.explode(F.sequence(F.greatest(F.col("_centre") - half, F.lit(0)), F.col("_centre") + half)))
    found = stored(listed).join(frames, [*keys, frame])
    w = Window.partitionBy(*block_cols)
    counted = found.withColumn("_found", F.count(F.lit(1)).over(w))
    inside = F.col(frame).between(F.col(start), F.col(end))
    return counted.where((F.col("_found") >= window_rows) | inside).drop("_found", "_centre")
