"""Ordered operators over frames that never need one match inside one task.

A match period is a sequence ordered by a whole number (its frame). Plain window functions over
``(match, period)`` put each sequence into one task, which fails as soon as one sequence holds a large part of
the data. The operators here cut the sequence into chunks of at most ``size`` rows:

* ``number_rows`` gives every row its dense position, from chunk counts and a running total of those counts;
* ``with_halo`` copies the rows a bounded look-back or look-ahead needs into the neighbouring chunk, after which
  an ordinary window over ``(keys, chunk)`` is exact;
* ``running_max`` and ``next_order`` carry unbounded look-back and look-ahead across chunks with one summary row
  per chunk.

A NULL key is a key like any other. The order column must be a whole number that is unique within the keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.keys import join_keys

CHUNK_ROWS = 16_384


def _chunk(order: str | Column, size: int | None) -> Column:
    size = size or CHUNK_ROWS
    order = F.col(order) if isinstance(order, str) else order
    return F.floor(order / F.lit(size)).cast("long")


def number_rows(
    df: DataFrame, keys: list[str], order: str, name: str = "rn", size: int | None = None, among: dict[str, Column] | None = None
) -> DataFrame:
    """Add ``name``: the 1-based position of the row within ``keys`` by ``order``.

    ``among`` adds further numbers in the same pass: the position among the rows that meet a condition.
    """
    wanted = {name: F.lit(True), **(among or {})}
    chunked = df.withColumn("_chunk", _chunk(order, size)).withColumns({f"_is_{n}": c for n, c in wanted.items()})
    hits = {n: F.when(F.col(f"_is_{n}"), 1) for n in wanted}
    counts = chunked.groupBy(*keys, "_chunk").agg(*[F.count(h).alias(f"_rows_{n}") for n, h in hits.items()])
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_chunk", *[F.coalesce(F.sum(f"_rows_{n}").over(earlier), F.lit(0)).alias(f"_offset_{n}") for n in wanted])
    within = Window.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ranked = chunked.withColumns({f"_place_{n}": F.count(h).over(within) for n, h in hits.items()})
    out = join_keys(ranked, offsets, [*keys, "_chunk"], "left")
    out = out.withColumns({n: F.col(f"_offset_{n}") + F.col(f"_place_{n}") for n in wanted})
    return out.drop("_chunk", *[f"_{kind}_{n}" for kind in ("is", "offset", "place") for n in wanted])


def with_halo(
    df: DataFrame, keys: list[str], rn: str = "rn", before: int = 0, after: int = 0, size: int | None = None
) -> DataFrame:
    """Assign rows to chunks of ``size`` positions and copy border rows into the chunks that look at them.

    Adds ``_chunk`` and ``_core``; windows run over ``(keys, _chunk)`` and ``_core`` rows are kept afterwards.
    """
    size = max(size or CHUNK_ROWS, before + after, 1)
    first = F.floor((F.col(rn) - 1 - F.lit(after)) / F.lit(size)).cast("long")
    last = F.floor((F.col(rn) - 1 + F.lit(before)) / F.lit(size)).cast("long")
    home = F.floor((F.col(rn) - 1) / F.lit(size)).cast("long")
    return (
        df.withColumn("_home", home)
        .withColumn("_chunk", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
        .withColumn("_core", F.col("_chunk") == F.col("_home"))
        .drop("_home")
    )


def core_rows(df: DataFrame) -> DataFrame:
    """Drop the copies made by ``with_halo``."""
    return df.where("_core").drop("_core", "_chunk")


def halo_window(keys: list[str], rn: str = "rn") -> Window:
    return Window.partitionBy(*keys, "_chunk").orderBy(rn)


def running_max(
    df: DataFrame, keys: list[str], outputs: dict[str, Column], rn: str = "rn", size: int | None = None
) -> DataFrame:
    """Add the largest value so far (this row included) of each expression.

    For values that grow along the sequence (positions, frames), NULL where a condition fails, this is the value at
    the latest row that met the condition.
    """
    marked = df.withColumn("_chunk", _chunk(F.col(rn) - 1, size))
    for name, value in outputs.items():
        marked = marked.withColumn(f"_v_{name}", value)
    names = list(outputs)
    tops = marked.groupBy(*keys, "_chunk").agg(*[F.max(f"_v_{n}").alias(f"_top_{n}") for n in names])
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = tops.select(*keys, "_chunk", *[F.max(f"_top_{n}").over(earlier).alias(f"_carry_{n}") for n in names])
    so_far = Window.partitionBy(*keys, "_chunk").orderBy(rn).rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumns({f"_own_{n}": F.max(f"_v_{n}").over(so_far) for n in names})
    out = join_keys(marked, carry, [*keys, "_chunk"], "left")
    for n in names:
        out = out.withColumn(n, F.coalesce(f"_own_{n}", f"_carry_{n}"))
    return out.drop("_chunk", *[f"_{kind}_{n}" for kind in ("v", "own", "carry") for n in names])


def next_order(df: DataFrame, keys: list[str], order: str, name: str, size: int | None = None) -> DataFrame:
    """Add ``name``: the order value of the following row, NULL on the last one."""
    marked = df.withColumn("_chunk", _chunk(order, size))
    heads = marked.groupBy(*keys, "_chunk").agg(F.min(order).alias("_head"))
    later = Window.partitionBy(*keys).orderBy("_chunk")
    carry = heads.select(*keys, "_chunk", F.lead("_head").over(later).alias("_carry"))
    within = Window.partitionBy(*keys, "_chunk").orderBy(order)
    led = marked.withColumn("_lead", F.lead(order).over(within))
    return join_keys(led, carry, [*keys, "_chunk"], "left").withColumn(name, F.coalesce("_lead", "_carry")).drop("_chunk", "_carry", "_lead")
