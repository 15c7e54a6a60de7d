"""Sparse occupancy rasters of frame windows and model scores on them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.config import PITCH_LENGTH, PITCH_WIDTH, WINDOW_FRAMES
from touchline.functions.batches import append_batchwise
from touchline.functions.coords import pixel
from touchline.operators.joins import block_center_frames
from touchline.operators.sequences import core_rows, halo_window, with_halo

WIDTH, HEIGHT = int(PITCH_LENGTH), int(PITCH_WIDTH)
CELLS = WIDTH * HEIGHT
CHANNELS = ["home", "away", "ball"]


def frame_cells(players: Column, ball_x: Column, ball_y: Column) -> Column:
    """Occupied cells of one frame as codes ``channel * CELLS + py * WIDTH + px``; coordinates in [0, 1]."""

    def code(channel: Column, x: Column, y: Column) -> Column:
        return channel * CELLS + pixel(y, HEIGHT) * WIDTH + pixel(x, WIDTH)

    known = F.filter(players, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    dots = F.transform(known, lambda p: code(F.when(p["side"] == "home", 0).otherwise(1), p["x"], p["y"]))
    ball = F.when(ball_x.isNotNull() & ball_y.isNotNull(), code(F.lit(2), ball_x, ball_y))
    return F.array_distinct(F.array_compact(F.concat(dots, F.array(ball))))


def window_rasters(df: DataFrame, keys: list[str], window_rows: int = WINDOW_FRAMES, rn: str = "rn", centre: str | None = None) -> DataFrame:
    """Add ``cells``: all cells occupied in the centred window of rows; ``centre`` flags the rows to keep.

    One halo shuffle by frame position; the raster stays a short list of codes.
    """
    radius = window_rows // 2
    w = halo_window(keys, rn).rowsBetween(-radius, radius)
    halo = with_halo(df.withColumn("_cells", frame_cells(F.col("players"), F.col("ball_x"), F.col("ball_y"))), keys, rn, radius, radius)
    out = core_rows(halo.withColumn("cells", F.array_distinct(F.flatten(F.collect_list("_cells").over(w)))).drop("_cells"))
    return out.where(centre) if centre else out


def block_rasters(
    blocks: DataFrame, frames: DataFrame, keys: list[str], by: list[str], window_rows: int = WINDOW_FRAMES
) -> DataFrame:
    """Add ``cells`` to each block that has frames: all cells occupied in the window round its middle frame.

    ``by`` names the block's columns, its ``start_frame`` and ``end_frame`` included; a block gathers at most
    ``window_rows`` short lists.
    """
    spots = frames.select(*keys, "frame", frame_cells(F.col("players"), F.col("ball_x"), F.col("ball_y")).alias("_cells"))
    found = block_center_frames(blocks.select(*by), spots, keys, window_rows)
    return found.groupBy(*by).agg(F.array_distinct(F.flatten(F.collect_list("_cells"))).alias("cells"))


def label_blocks(
    rasters: DataFrame, model: Callable[[np.ndarray], np.ndarray], labels: dict[str, list[str]], by: list[str]
) -> DataFrame:
    """Formation label and confidence of each block from a user's model with one head per side.

    The model returns the home head's logits followed by the away head's; the block's side picks the head. The
    result is the ``fallback`` of ``predict_formations``.
    """
    home, away = labels["home"], labels["away"]
    scored = score_rasters(rasters, model)
    first = F.when(F.col("side") == "home", 1).otherwise(len(home) + 1)
    count = F.when(F.col("side") == "home", len(home)).otherwise(len(away))
    probs = softmax(F.slice("logits", first, count))
    best = scored.withColumn("_p", probs)
    picked = F.when(F.col("side") == "home", decode(F.col("_p"), home)).otherwise(decode(F.col("_p"), away))
    return best.withColumn("_d", picked).select(*by, F.col("_d.label").alias("label"), F.col("_d.confidence").alias("confidence"))


def cell_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per occupied cell: channel name, px and py."""
    cell = F.col("_cell")
    names = F.array(*[F.lit(c) for c in CHANNELS])
    return df.select(*columns, F.explode("cells").alias("_cell")).select(
        *columns,
        F.get(names, F.floor(cell / CELLS).cast("int")).alias("channel"),
        (cell % WIDTH).alias("px"),
        F.floor(cell % CELLS / WIDTH).cast("int").alias("py"),
    )


def score_rasters(
    df: DataFrame, model: Callable[[np.ndarray], np.ndarray], cells: str = "cells", rows_per_batch: int = 256
) -> DataFrame:
    """Add ``logits`` from a user's model, called on (rows, 3, height, width) float32 batches inside the tasks."""

    def logits(codes: pa.Array) -> list[pa.Array]:
        out: list = []
        for at in range(0, len(codes), rows_per_batch):
            part = codes.slice(at, rows_per_batch).to_pylist()
            image = np.zeros((len(part), 3 * CELLS), dtype=np.float32)
            for i, row in enumerate(part):
                image[i, np.asarray(row or [], dtype=np.int64)] = 1.0
            out.extend(np.asarray(model(image.reshape(len(part), 3, HEIGHT, WIDTH)), dtype=np.float32))
        return [pa.array(out, pa.list_(pa.float32()))]

    return append_batchwise(df, F.col(cells), T.StructType().add("logits", T.ArrayType(T.FloatType())), logits)


def softmax(logits: Column, temperature: float = 1.0) -> Column:
    """Probabilities of a logits array, shifted by its maximum."""
    scaled = F.transform(logits, lambda v: v.cast("double") / max(temperature, 1e-6))
    top = F.array_max(scaled)
    powers = F.transform(scaled, lambda v: F.exp(v - top))
    total = F.aggregate(powers, F.lit(0.0), lambda a, v: a + v)
    return F.transform(powers, lambda v: v / total)


def decode(probabilities: Column, labels: list[str]) -> Column:
    """Most likely label and its probability, the first on ties."""
    best = F.array_max(probabilities)
    at = F.array_position(probabilities, best).cast("int") - 1
    return F.struct(F.get(F.array(*[F.lit(l) for l in labels]), at).alias("label"), best.alias("confidence"))


def coarse_zones(cells: Column, columns: int = 7, rows: int = 4) -> Column:
    """Channel and coarse pitch zone of every occupied cell, as text tokens."""

    def zone(c: Column) -> Column:
        across = F.floor((c % WIDTH) * columns / WIDTH)
        up = F.floor(F.floor(c % CELLS / WIDTH) * rows / HEIGHT)
        return (F.floor(c / CELLS) * (columns * rows) + up * columns + across).cast("string")

    return F.transform(cells, zone)
