"""Ordered alignment of events and frames.

Unlike the nearest frame per event, an alignment keeps the order of both sequences and gives a frame to one event at most.
An event without a frame costs a gap; a pair costs its share of the tolerance in time, plus, where both have a place, its
distance in units of ``metres``. The alignment of least total cost is found by dynamic programming in the band of the
tolerance. Stretches without events cut a match into batches: where two events lie more than two tolerances apart, no frame
can serve both and no order can be broken, so batches are independent and the total is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.functions.keys import join_keys
from touchline.operators.sequences import next_order, number_rows, running_max
from touchline.session import stored

CHUNK_MICROS = 60_000_000
BUCKET_MICROS = 10_000_000


def align(costs: "list[np.ndarray]", first: np.ndarray, gap: float) -> tuple[np.ndarray, float]:
    """Frame per event, or -1, and the total cost. Event i may take the frames from ``first[i]`` on at ``costs[i]``; both
    ends of these ranges never fall. Ties prefer a frame to a gap, and earlier frames."""
    matched: list[np.ndarray] = []
    low, best = 0, np.zeros(1)  # least cost of the events so far if frames before low + k are used, k = 0, 1, ...
    for cost, begin in zip(costs, first.tolist()):
        end = max(begin + len(cost), low + len(best) - 1)
        at = np.minimum(np.arange(begin, end + 1) - low, len(best) - 1)
        before = best[at]
        taken = np.full(end - begin + 1, np.inf)
        taken[1 : len(cost) + 1] = cost + before[: len(cost)]
        # the frame that ends the cheapest way with frames before begin + k, the earliest of equal ones
        so_far = np.minimum.accumulate(taken)
        new = np.r_[True, so_far[1:] < so_far[:-1]]
        frame = begin - 1 + np.maximum.accumulate(np.where(new, np.arange(len(taken)), 0))
        matched.append(np.where(so_far <= before + gap, frame, -1))
        low, best = begin, np.minimum(so_far, before + gap)
    out = np.full(len(costs), -1)
    used = low + len(best) - 1
    for i in range(len(costs) - 1, -1, -1):
        k = min(used - int(first[i]), len(matched[i]) - 1)
        if k >= 0 and matched[i][k] >= 0:
            out[i] = used = int(matched[i][k])
    return out, float(best[-1])


def event_batches(events: DataFrame, keys: list[str], tolerance: int, t: str = "_t") -> DataFrame:
    """Add ``_batch``: the time at which the event's batch begins."""
    # events of one time are in one batch, so times are what is cut
    times = number_rows(events.select(*keys, t).distinct(), keys, t, "_rn", CHUNK_MICROS)
    times = next_order(stored(times.withColumn("_neg", -F.col(t))), keys, "_neg", "_prev", CHUNK_MICROS)
    starts = F.when(F.col("_prev").isNull() | (F.col(t) + F.col("_prev") > 2 * tolerance), F.col(t))
    batches = running_max(times, keys, {"_batch": starts}, "_rn").select(*keys, t, "_batch")
    return join_keys(events, batches, [*keys, t], "left")


def align_events(
    frames: DataFrame,
    events: DataFrame,
    keys: list[str],
    tolerance_seconds: float = 1.0,
    gap: float = 1.0,
    metres: float = 25.0,
    ts: str = "ts",
    frame: str = "frame",
    places: "tuple[str, str, str, str] | None" = None,
) -> DataFrame:
    """Events with ``frame`` and ``offset_us`` (frame time minus event time), NULL where the event has a gap.

    ``places`` names the events' x and y and the frames' x and y. Events and frames without a time take no part; frames
    of equal time are ordered by ``frame``; equal events are aligned each, in any order.
    """
    tol = int(tolerance_seconds * 1_000_000)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    own = events.withColumns({"_t": micros, "_ex": F.col(places[0]).cast("double") if places else F.lit(None).cast("double"), "_ey": F.col(places[1]).cast("double") if places else F.lit(None).cast("double")})
    timed = stored(event_batches(own.where("_t IS NOT NULL"), keys, tol))
    spans = timed.groupBy(*keys, "_batch").agg((F.min("_t") - tol).alias("_lo"), (F.max("_t") + tol).alias("_hi"))
    bucket = lambda c: F.floor(F.col(c) / BUCKET_MICROS).cast("long")
    spans = stored(spans.withColumn("_bucket", F.explode(F.sequence(bucket("_lo"), bucket("_hi")))))
    place = [F.col(places[2]).cast("double").alias("_fx"), F.col(places[3]).cast("double").alias("_fy")] if places else [F.lit(None).cast("double").alias("_fx"), F.lit(None).cast("double").alias("_fy")]
    ticks = frames.select(*keys, micros.alias("_ft"), F.col(frame).alias("_frame"), *place).where("_ft IS NOT NULL").withColumn("_bucket", bucket("_ft"))
    near = join_keys(ticks, spans, [*keys, "_bucket"], "inner").where("_ft BETWEEN _lo AND _hi").select(*keys, "_batch", "_ft", "_frame", "_fx", "_fy")
    names = events.columns
    schema = T.StructType([*events.schema.fields, T.StructField(frame, frames.schema[frame].dataType), T.StructField("offset_us", T.LongType())])

    def run(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        mine, theirs = mine.sort_by("_t"), theirs.sort_by([("_ft", "ascending"), ("_frame", "ascending")])
        t, ft = mine.column("_t").to_numpy(), theirs.column("_ft").to_numpy()
        first, last = np.searchsorted(ft, t - tol, "left"), np.searchsorted(ft, t + tol, "right")
        ex, ey, fx, fy = (np.asarray(c.to_numpy(), float) for c in (mine.column("_ex"), mine.column("_ey"), theirs.column("_fx"), theirs.column("_fy")))
        costs = []
        for i, (a, b) in enumerate(zip(first, last)):
            far = np.hypot(fx[a:b] - ex[i], fy[a:b] - ey[i]) / metres
            costs.append(np.abs(ft[a:b] - t[i]) / max(tol, 1) + np.where(np.isnan(far), 0.0, far))
        chosen, _ = align(costs, first, gap)
        take = pa.array(chosen, mask=chosen < 0)
        offset = pa.array(np.where(chosen >= 0, ft[chosen] - t, 0) if len(ft) else np.zeros(len(t), np.int64), mask=chosen < 0)
        columns = [mine.column(c) for c in names] + [theirs.column("_frame").take(take), offset]
        return pa.table(columns, names=schema.names)

    keyed = [*keys, "_batch"]
    renamed = near.select(*[F.col(c).alias(c) for c in near.columns])
    out = timed.groupBy(*keyed).cogroup(renamed.groupBy(*keyed)).applyInArrow(run, schema)
    untimed = own.where("_t IS NULL").select(*names, F.lit(None).cast(frames.schema[frame].dataType).alias(frame), F.lit(None).cast("long").alias("offset_us"))
    return out.unionByName(untimed)
