"""Knowledge graph of formations, phases and styles, and the priors read from it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.events import clean_phase
from touchline.operators.passgraph import perspectives

EDGE = ["src_kind", "src_key", "rel", "dst_kind", "dst_key"]


def counters_edges(fvf: DataFrame) -> DataFrame:
    """COUNTERS edges: summed strength of a candidate formation against an opponent formation and phase."""
    rows = perspectives(fvf).where("our_form IS NOT NULL")
    return rows.groupBy(
        "provider", F.col("our_form").alias("candidate"), F.col("opponent_form").alias("opponent"), clean_phase("opponent_phase").alias("phase")
    ).agg(F.sum(F.coalesce("our_strength", F.lit(0.0))).alias("support"))


def as_edges(counters: DataFrame) -> DataFrame:
    """COUNTERS rows in the graph's edge layout."""
    return counters.select(
        F.lit("Formation").alias("src_kind"), F.col("candidate").alias("src_key"), F.lit("COUNTERS").alias("rel"),
        F.lit("Formation").alias("dst_kind"), F.col("opponent").alias("dst_key"), "phase", "provider", "support",
    )


def counters_nodes(counters: DataFrame) -> DataFrame:
    """Formation and Phase nodes named by COUNTERS rows, without properties."""
    kinds = F.array(
        F.struct(F.lit("Formation").alias("kind"), F.col("candidate").alias("key")),
        F.struct(F.lit("Formation").alias("kind"), F.col("opponent").alias("key")),
        F.struct(F.lit("Phase").alias("kind"), F.col("phase").alias("key")),
    )
    return counters.select(F.inline(kinds)).distinct().withColumn("props", F.create_map().cast("map<string,string>"))


def upsert_nodes(old: DataFrame, new: DataFrame, order: str | None = None) -> DataFrame:
    """Nodes of both by (kind, key); properties merge, the newer value of a property wins.

    ``order`` names a column of ``new`` that says which of its rows is later. Properties are compared one by one, so
    a node named by millions of rows is reduced on the map side.
    """
    old_rows = old.select("kind", "key", "props", F.lit(0).alias("_late"), F.lit(None).cast("string").alias("_at"))
    new_rows = new.select("kind", "key", "props", F.lit(1).alias("_late"), (F.col(order).cast("string") if order else F.lit(None).cast("string")).alias("_at"))
    both = old_rows.unionByName(new_rows)
    single = both.select("kind", "key", "_late", "_at", F.explode_outer("props").alias("_prop", "_value"))
    latest = single.groupBy("kind", "key", "_prop").agg(
        F.max_by("_value", F.struct("_late", F.coalesce("_at", F.lit("")).alias("at"), F.coalesce("_value", F.lit("")).alias("v"))).alias("_value")
    )
    entry = F.when(F.col("_prop").isNotNull(), F.struct(F.col("_prop").alias("key"), F.col("_value").alias("value")))
    return latest.groupBy("kind", "key").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("props"))


def upsert_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """COUNTERS edges of both by endpoints and phase: support adds up, the provider of the first stays."""
    both = old.withColumn("_late", F.lit(0)).unionByName(new.withColumn("_late", F.lit(1)))
    return both.groupBy(*EDGE, "phase").agg(
        F.min_by("provider", F.struct("_late", F.coalesce("provider", F.lit("")).alias("p"))).alias("provider"),
        F.sum(F.coalesce("support", F.lit(0.0))).alias("support"),
    )


def exhibits_edges(recos: DataFrame, limit: int | None = None) -> DataFrame:
    """EXHIBITS edges from the style tags (JSON array text or array) of recommendations, newest first when limited."""
    if limit:
        recos = recos.orderBy(F.col("created_at").desc(), "opponent_form", "opponent_phase").limit(limit)
    tags = F.col("style_tags")
    if dict(recos.dtypes)["style_tags"] == "string":
        tags = F.from_json(tags, "array<string>")
    key = F.concat_ws("|", "opponent_form", clean_phase("opponent_phase"))
    rows = recos.select(key.alias("src_key"), "opponent_form", clean_phase("opponent_phase").alias("opponent_phase"), "created_at", F.explode(tags).alias("dst_key"))
    return rows.select(
        F.lit("TeamPhase").alias("src_kind"), "src_key", F.lit("EXHIBITS").alias("rel"), F.lit("StyleTag").alias("dst_kind"), "dst_key",
        "opponent_form", "opponent_phase", "created_at", F.lit(1.0).alias("weight"),
    )


def exhibits_nodes(edges: DataFrame) -> DataFrame:
    """TeamPhase and StyleTag nodes of EXHIBITS edges."""
    team = F.map_from_arrays(F.array(F.lit("opponent_form"), F.lit("opponent_phase")), F.array("opponent_form", "opponent_phase"))
    kinds = F.array(
        F.struct(F.lit("TeamPhase").alias("kind"), F.col("src_key").alias("key"), team.alias("props")),
        F.struct(F.lit("StyleTag").alias("kind"), F.col("dst_key").alias("key"), F.create_map().cast("map<string,string>").alias("props")),
    )
    nodes = edges.select(F.inline(kinds))
    return nodes.groupBy("kind", "key").agg(F.first("props").alias("props"))


def normalised(value: Column, window: Window) -> Column:
    """Share of the positive values of a window; all equal when there are none."""
    positive = F.when(F.isnan(value) | value.isNull() | (F.abs(value) == float("inf")) | (value < 0), 0.0).otherwise(value)
    total = F.sum(positive).over(window)
    return F.when(total <= 1e-12, 1.0 / F.count(F.lit(1)).over(window)).otherwise(positive / total)


# What a list of counters is for: the phase and provider, the phase, the provider, or neither. Lists without a provider of
# their own hold rows of no provider (PLAIN) or of any provider (NAMED).
PHASE_PROVIDER, PHASE_PLAIN, PHASE_NAMED, PROVIDER, PLAIN, NAMED = range(6)
LIST_KEYS = ["opponent_form", "_list", "_list_phase", "_list_provider"]


def counter_lists(counters: DataFrame, limit: int = 12) -> DataFrame:
    """The ``limit`` best counters per opponent form and list, by support, then name; rows are cut on the map side first.

    A row is in one list per key it has, four at most, so a form that many rows counter has short lists all the same.
    """
    phase, provider = F.replace("edge_phase", F.lit(" "), F.lit("-")), F.col("edge_provider")
    key = lambda kind, p, q: F.struct(F.lit(kind).alias("_list"), p.alias("_list_phase"), q.alias("_list_provider"))
    any_ = F.lit("")
    named = [key(PHASE_PROVIDER, phase, provider), key(PHASE_NAMED, phase, any_), key(PROVIDER, any_, provider), key(NAMED, any_, any_)]
    plain = [key(PHASE_PLAIN, phase, any_), key(PLAIN, any_, any_)]
    rows = counters.select(
        F.col("opponent").alias("opponent_form"), "candidate", F.col("phase").alias("edge_phase"), F.col("provider").alias("edge_provider"), "support"
    )
    listed = rows.select("*", F.inline(F.when(provider.isNull(), F.array(*plain)).otherwise(F.array(*named)))).where("_list_phase IS NOT NULL")
    order = Window.partitionBy(*LIST_KEYS).orderBy(F.col("support").desc(), "candidate", "edge_provider", "edge_phase")
    return listed.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= limit).drop("_nth")


def counter_options(contexts: DataFrame, counters: DataFrame, context: list[str], limit: int = 12, any_phase: bool = True) -> DataFrame:
    """COUNTERS rows that apply to each context, with fallback, ranked and cut to ``limit``.

    Contexts need ``provider`` (NULL for any), ``opponent_form`` and ``opponent_phase``. Tiers: same phase and
    provider, same phase, then (``any_phase``) same provider, then anything. A context uses its lowest tier that has
    rows, so it reads six lists of ``limit`` rows at most, whatever the number of counters of its opponent's form.
    """
    phase, provider = clean_phase("opponent_phase", underscores=True), F.col("provider")
    ask = lambda kind, tier, p, q: F.struct(F.lit(kind).alias("_list"), p.alias("_list_phase"), q.alias("_list_provider"), F.lit(tier).alias("tier"))
    any_ = F.lit("")
    own = [ask(PHASE_PROVIDER, 1, phase, provider), ask(PHASE_PLAIN, 1, phase, any_), ask(PHASE_NAMED, 2, phase, any_)]
    own += [ask(PROVIDER, 3, any_, provider), ask(PLAIN, 3, any_, any_), ask(NAMED, 4, any_, any_)] * any_phase
    free = [ask(PHASE_PLAIN, 1, phase, any_), ask(PHASE_NAMED, 1, phase, any_)]
    free += [ask(PLAIN, 3, any_, any_), ask(NAMED, 3, any_, any_)] * any_phase
    asked = contexts.select("*", F.inline(F.when(provider.isNull(), F.array(*free)).otherwise(F.array(*own))))
    joined = asked.join(counter_lists(counters, limit), LIST_KEYS).drop("_list", "_list_phase", "_list_provider")
    rank = F.when(F.col("edge_provider") == F.col("provider"), 0).when(F.col("edge_provider").isNull(), 1).otherwise(2)
    w = Window.partitionBy(*context)
    ordered = w.orderBy("_rank", F.col("support").desc(), "candidate", "edge_provider", "edge_phase")
    best = joined.withColumn("_rank", rank).withColumn("_lowest", F.min("tier").over(w)).where("tier = _lowest")
    return best.withColumn("position", F.row_number().over(ordered)).where(F.col("position") <= limit).drop("_rank", "_lowest")


def kg_prior(contexts: DataFrame, counters: DataFrame, context: list[str], limit: int = 12) -> DataFrame:
    """Prior of each candidate formation per context: its share of the support of the context's options."""
    options = counter_options(contexts, counters, context, limit)
    summed = options.groupBy(*context, "candidate").agg(
        F.sum(F.greatest("support", F.lit(0.0))).alias("support"), F.max("tier").alias("tier")
    )
    return summed.withColumn("prior", normalised(F.col("support"), Window.partitionBy(*context)))


def counters_layout(options: DataFrame, context: list[str], most: int = 10) -> DataFrame:
    """Places on the unit circle of the first ``most`` distinct candidates round the opponent, with edge widths."""
    first = options.groupBy(*context, "candidate").agg(F.min("position").alias("_first"), F.max("support").alias("support"))
    w = Window.partitionBy(*context)
    numbered = first.withColumn("_i", F.row_number().over(w.orderBy("_first")) - 1).where(F.col("_i") < most)
    angle = 2 * math.pi * F.col("_i") / F.greatest(F.lit(1), F.count(F.lit(1)).over(w))
    return numbered.select(
        *context, "candidate", F.col("_i").alias("place"), F.cos(angle).alias("x"), F.sin(angle).alias("y"), F.greatest(F.lit(1.0), F.log1p("support")).alias("width")
    )
