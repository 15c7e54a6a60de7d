"""File sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.config import PITCH_LENGTH, PITCH_WIDTH
from touchline.functions.coords import flip, rescale

# Fixed value: raster files are named provider_period_frame.
FRAME_KEY = r"(?i)^(metrica|sportec)_(\d+)_(\d+)\.npz$"


def _number(value: Column) -> Column:
    """A double, NULL for NaN."""
    value = value.cast("double")
    return F.when(~F.isnan(value), value)


def _without_nan(df: DataFrame) -> DataFrame:
    """Floating-point columns with NULL for NaN."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def read_tracking_xml(
    spark: SparkSession, path: str, row_tag: str, schema: T.StructType, players: str, fields: dict[str, Column]
) -> DataFrame:
    """Tracking frames from XML files: one row per ``row_tag`` element.

    ``players`` names the repeated element that becomes the ``players`` array and must hold ``_side``, ``_player``,
    ``_x`` and ``_y``; ``fields`` maps output columns to expressions over the element. Files are split by Spark, any
    number of matches is one job.
    """
    raw = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
    array = F.transform(
        players,
        lambda p: F.struct(
            p["_side"].alias("side"), p["_player"].alias("player"), _number(p["_x"]).alias("x"), _number(p["_y"]).alias("y")
        ),
    )
    return _without_nan(raw.select(*[c.alias(n) for n, c in fields.items()], array.alias("players")))


def read_events_xml(
    spark: SparkSession, path: str, row_tag: str, schema: T.StructType, fields: dict[str, Column]
) -> DataFrame:
    """Events from XML files, turned to the tracking data's orientation."""
    raw = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
    events = _without_nan(raw.select(*[c.alias(n) for n, c in fields.items()]))
    return flip(events, ["coordinates_x", "coordinates_y", "end_coordinates_x", "end_coordinates_y"])


# Fixed value: the fields of public shot events that the shot model needs.
SHOT_SCHEMA = "type STRUCT<name: STRING>, location ARRAY<DOUBLE>, shot STRUCT<outcome: STRUCT<name: STRING>>"


def shots_from_events(events: DataFrame) -> DataFrame:
    """Shots on a 105 x 68 pitch with their goal flag, from nested events on 120 x 80; shots without a place go."""
    x = rescale(F.get("location", F.lit(0)), 120.0, PITCH_LENGTH)
    y = rescale(F.get("location", F.lit(1)), 80.0, PITCH_WIDTH)
    carried = [c for c in events.columns if c not in ("type", "location", "shot")]
    goal = F.coalesce(F.col("shot.outcome.name") == "Goal", F.lit(False))
    shots = events.where(F.col("type.name") == "Shot").select(
        *carried, x.alias("coordinates_x"), y.alias("coordinates_y"), goal.alias("is_goal")
    )
    return shots.dropna(subset=["coordinates_x", "coordinates_y"])


def read_shots_json(spark: SparkSession, path: str) -> DataFrame:
    """Shots from nested JSON event files."""
    return shots_from_events(spark.read.schema(SHOT_SCHEMA).option("multiLine", True).json(path))


def alive_frames(frames: DataFrame, status: str = "ball_status") -> DataFrame:
    """Frames with the ball in play; all frames when the feed has no status."""
    return frames.where(F.col(status) == "alive") if status in frames.columns else frames


def match_frames(frames: DataFrame, unique_match_id: str) -> DataFrame:
    """Frames of one run; prunes to one folder when the table is partitioned by it."""
    return alive_frames(frames.where(F.col("unique_match_id") == unique_match_id))


def frame_key(name: str | Column) -> Column:
    """Provider, period and frame in a raster's file name, NULL when it is not one."""
    name = F.col(name) if isinstance(name, str) else name
    part = lambda i: F.regexp_extract(name, FRAME_KEY, i)
    return F.when(
        name.rlike(FRAME_KEY),
        F.struct(
            F.lower(part(1)).alias("provider"), part(2).cast("long").alias("period_id"), part(3).cast("long").alias("frame")
        ),
    )


def append_table(df: DataFrame, path: str, partition: str = "match_id") -> None:
    """Append rows; new columns are allowed and read back with ``read_table``."""
    df.write.mode("append").partitionBy(partition).parquet(path)


def replace_matches(df: DataFrame, path: str, partition: str = "match_id") -> None:
    """Replace the matches present in ``df`` and leave every other match as it is."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(path)


def write_audit_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def table_counts(df: DataFrame, match: str = "match_id") -> DataFrame:
    """Rows and distinct matches of a table."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(match).alias("n_matches"))
