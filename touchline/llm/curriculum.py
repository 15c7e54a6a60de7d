"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time 0 to 1, here a line between two knots. Its integral, scaled to the
source's target, is the source's cumulative token demand; inverting that at the place where a document begins in its
source's stream gives the document's training position. Range-sorting by position yields the training order.

A source's stream runs through its documents in hash order, again and again until the demand is met. Places in it are
cumulative sizes: sums per (source, hash bucket) give the bucket offsets, ranks are taken only inside a bucket, and a
source has as many buckets as its rows need, so a source with a third of all rows is never one task.

Defined results: null texts have size 0, a null source is a source of its own and the last, documents of size 0 are taken
without adding words, equal rows follow each other, an empty table gives no rows. Extra columns pass through ``positions``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.llm.common import table
from touchline.session import stored

BUCKET_ROWS = 2_000
WEIGHTS = (5, 2, 1)
CAP = 3
# Weight multipliers at the begin and the end of training by the source's place in the weight cycle: heavy sources fade,
# light ones grow; each line has mean 1.
RAMPS = ((1.4, 0.6), (1.0, 1.0), (0.6, 1.4))


# the columns that ``positions`` and ``in_training_order`` add
OUTPUTS = ("source_size", "weight", "target", "times", "taken", "time")


def word_count(text: "Column | str") -> Column:
    """Number of runs of anything but ASCII white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def weighted_sources(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, ramps: tuple[tuple[float, float], ...] = RAMPS) -> DataFrame:
    """One row per source: rows, size, weight and ramp, cycling in code point order, null last."""
    by_source = sizes.groupBy("source").agg(F.count("*").alias("rows"), F.sum("size").alias("source_size"))
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), place + 1)
    return by_source.withColumns({"weight": pick(weights), "ramp_from": pick([float(a) for a, _ in ramps]), "ramp_to": pick([float(b) for _, b in ramps])})


def targets(sources: DataFrame, cap: int = CAP) -> DataFrame:
    """Add ``target``: shares of the total size by weight, held at ``cap`` times the source's size, the excess reshared.

    Raising one level until all is shared, sources reach their caps in the order of cap over weight. The level is right
    where the next source in that order stays under its cap. Works on one row per source.
    """
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = sources.withColumns(
        {
            "_total": F.sum("source_size").over(every),
            "_capped": F.coalesce(F.sum("source_size").over(before), F.lit(0)) * cap,
            "_weights": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        }
    ).withColumn("_level", (F.col("_total") - F.col("_capped")).cast("double") / F.col("_weights"))
    fits = F.col("_level") * F.col("weight") <= F.col("source_size") * cap
    level = F.min(F.when(fits, F.struct(F.col("_capped"), F.col("_level")))).over(every)["_level"]
    target = F.least(F.col("source_size") * F.lit(float(cap)), F.coalesce(level, F.lit(float("inf"))) * F.col("weight"))
    return ranked.withColumn("target", target).drop("_total", "_capped", "_weights", "_level")


def demand_time(share: Column, begin: Column, end: Column) -> Column:
    """When a source's cumulative demand reaches ``share`` of its whole: the inverse of the integrated ramp, 0 to 1."""
    drift = end - begin
    return F.least(F.lit(1.0), 2 * share / (begin + F.sqrt(F.greatest(begin * begin + 2 * drift * share, F.lit(0.0)))))


def stream_places(sized: DataFrame, sources: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Add ``begins``: words of the source before the document, in the order of the id's hash."""
    same = F.col("source").eqNullSafe(F.col("_source"))
    facts = sources.withColumnRenamed("source", "_source")
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    spread = F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / float(1 << 32)
    rows = sized.join(facts, same).drop("_source").withColumn("_key", key)
    rows = rows.withColumn("_bucket", F.floor(spread * F.ceil(F.col("rows") / bucket_rows)))
    sums = rows.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select(F.col("source").alias("_source"), F.col("_bucket").alias("_b"), F.coalesce(before, F.lit(0)).alias("_offset"))
    inside = F.sum("size").over(
        Window.partitionBy("source", "_bucket").orderBy("_key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    )
    met = rows.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(stored(offsets), same & (F.col("_bucket") == F.col("_b")))
    return met.withColumn("begins", F.col("_offset") + F.col("_inside")).drop("_source", "_b", "_bucket", "_offset", "_inside", "_key")


def positions(docs: DataFrame, cap: int = CAP, weights: tuple[int, ...] = WEIGHTS, ramps: tuple[tuple[float, float], ...] = RAMPS) -> DataFrame:
    """``docs`` (with ``doc_id``, ``source``, ``size``) with target, copies taken and the training time of each copy.

    Other columns pass through whatever their names; those named like an output (``OUTPUTS``) are replaced by it.

    A copy is taken if its middle lies before the source's target, so a source misses its target by half a document at
    most, and never more than ``cap`` copies.
    """
    # other columns travel in one struct, out of the way of the names used here
    others = [c for c in docs.columns if c not in ("doc_id", "source", "size", *OUTPUTS)]
    docs = docs.select("doc_id", "source", "size", *([F.struct(*[F.col(f"`{c}`") for c in others]).alias("_others")] if others else []))
    sources = stored(targets(weighted_sources(docs, weights, ramps), cap))
    placed = stream_places(docs, sources)
    middle = F.col("begins") + F.col("size") / 2
    rounds = F.ceil((F.col("target") - middle) / F.col("source_size"))
    copies = F.when(F.col("source_size") > 0, F.greatest(F.least(rounds, F.lit(cap)), F.lit(0))).otherwise(1).cast("int")
    share = lambda k: (F.col("begins") + k * F.col("source_size")) / F.col("target")
    time = F.transform(
        F.when(F.col("_copies") > 0, F.sequence(F.lit(0), F.col("_copies") - 1)).otherwise(F.array().cast("array<int>")),
        lambda k: F.when(F.col("target") > 0, demand_time(share(k), F.col("ramp_from"), F.col("ramp_to"))).otherwise(0.0),
    )
    out = placed.withColumn("_copies", copies).withColumn("times", time).withColumn("taken", F.col("_copies") * F.col("size"))
    out = out.drop("_copies", "rows", "ramp_from", "ramp_to", "begins")
    return out.select("doc_id", "source", "size", *(["_others.*"] if others else []), *[c for c in OUTPUTS if c in out.columns])


def in_training_order(placed: DataFrame) -> DataFrame:
    """One row per copy, range-sorted by training time."""
    copies = placed.select("*", F.explode("times").alias("time")).drop("times")
    return copies.repartitionByRange("time", "doc_id").sortWithinPartitions("time", "doc_id")


def op2_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: what the mix takes of each, and when it is first met."""
    sized = stored(table(spark, sf_dir, "documents").select("doc_id", "source", word_count("text").alias("size")))
    out = positions(sized)
    mixed = out.select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), F.round(F.try_element_at("times", F.lit(1)), 9).alias("first_time"))
    return mixed.repartitionByRange("first_time", "doc_id").sortWithinPartitions("first_time", "doc_id")


OP2_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS place FROM d GROUP BY source),
w AS (
  SELECT *, [5, 2, 1][place + 1] AS weight, [1.4, 1.0, 0.6][place + 1]::DOUBLE AS r0, [0.6, 1.0, 1.4][place + 1]::DOUBLE AS r1, 3 * source_size AS cap FROM s),
i AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM w),
fill AS (
  SELECT 0 AS n, []::BIGINT[] AS full_places, (SELECT sum(source_size) FROM w)::DOUBLE / (SELECT sum(weight) FROM w) AS level
  UNION ALL
  SELECT n + 1, f2, ((SELECT sum(source_size) FROM w) - coalesce((SELECT sum(cap) FROM i WHERE list_contains(f2, k)), 0))::DOUBLE
      / nullif((SELECT sum(weight) FROM i WHERE NOT list_contains(f2, k)), 0)
  FROM (SELECT n, full_places, (SELECT list(k) FROM i WHERE list_contains(full_places, k) OR level * weight > cap) AS f2 FROM fill) WHERE len(f2) > len(full_places)),
last AS (SELECT level FROM fill ORDER BY n DESC LIMIT 1),
t AS (SELECT source, source_size, r0, r1, least(cap::DOUBLE, coalesce((SELECT level FROM last), 'inf'::DOUBLE) * weight) AS target FROM i),
p AS (
  SELECT doc_id, size, source_size, target, r0, r1,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begins
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (
  SELECT *, CASE WHEN source_size > 0 THEN greatest(least(ceil((target - (begins + size / 2)) / source_size), 3), 0) ELSE 1 END::BIGINT AS copies FROM p)
SELECT doc_id, size::BIGINT AS size, source_size, target, (copies * size)::BIGINT AS taken,
  CASE WHEN copies > 0 THEN round(CASE WHEN target > 0 THEN least(1.0, 2 * (begins / target) / (r0 + sqrt(greatest(r0 * r0 + 2 * (r1 - r0) * (begins / target), 0)))) ELSE 0 END, 9) END AS first_time
FROM c"""
