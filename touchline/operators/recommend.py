"""Formation recommendation for all contexts of a table in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.config import FALLBACK_CLASSES, FUSION_ALPHA, FUSION_BETA, NEGATIVE_METRICS, STRATEGY_WEIGHTS, STYLE_THRESHOLDS, TOP_K
from touchline.operators.knowledge import kg_prior, normalised
from touchline.operators.passgraph import CONTEXT, perspectives
from touchline.session import stored

# Fixed list: metrics read for style tags and for the matchup prior.
STYLE_METRICS = ("ppda", "ppda_press", "press_rate", "avg_press", "width", "depth", "possession_pct", "xt")
PRIOR_METRICS = ("strength", "xt", "ppda", "ppda_press", "press_rate", "avg_press", "width", "depth")
MIN_PAIRS, MIN_CANDIDATES, MODEL_CANDIDATES = 5, 4, 6


def top_context(fvf: DataFrame) -> DataFrame:
    """Opponent context seen most often per provider and side; names break ties."""
    rows = perspectives(fvf)
    rank = F.struct((-F.col("pairs")).alias("p"), F.col("opponent_form").alias("f"), F.col("opponent_phase").alias("h"))
    best = rows.groupBy("provider", "our_side").agg(F.min_by(F.struct("opponent_form", "opponent_phase", "pairs"), rank).alias("_c"))
    return best.select("provider", "our_side", "_c.opponent_form", "_c.opponent_phase", "_c.pairs")


def context_metrics(fvf: DataFrame) -> DataFrame:
    """Mean metrics of the opponent (``opp_``) and of ourselves (``our_``) per context."""
    rows = perspectives(fvf, STYLE_METRICS)
    return rows.groupBy(*CONTEXT).agg(*[F.avg(f"{who}_{m}").alias(f"{who}_{m}") for who in ("opp", "our") for m in STYLE_METRICS])


def style_tags(prefix: str = "opp_", thresholds: dict[str, float] = STYLE_THRESHOLDS, columns: list[str] | None = None) -> Column:
    """Sorted style tags from one row's metrics; an unknown metric switches its rules off."""
    t = {**STYLE_THRESHOLDS, **thresholds}

    def metric(name: str) -> Column:
        if columns is not None and f"{prefix}{name}" not in columns:
            return F.lit(None).cast("double")
        c = F.col(f"{prefix}{name}").try_cast("double")
        return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)

    ppda, rate, press = metric("ppda"), metric("press_rate"), metric("avg_press")
    width, depth, share, xt = metric("width"), metric("depth"), metric("possession_pct"), metric("xt")
    yes = lambda c: F.coalesce(c, F.lit(False))
    high, low = yes(ppda <= t["ppda_low"]), yes(ppda >= t["ppda_high"])
    often = yes(rate >= t["press_rate_high"])
    rules = [
        (yes(press >= t["avg_press_high"]), "physically_intense_press"),
        (yes((width <= t["width_low"]) & (depth <= t["depth_low"])), "compact_block"),
        (yes(share <= t["possession_low"]), "counter_attacking"),
        (yes(xt >= t["xt_high"]), "halfspace_threat"),
        (high & often, "high_block"),
        (high, "high_pressing"),
        (~(high & often) & low, "low_block"),
        (low, "low_pressing"),
        (~(high & often) & ~low, "mid_block"),
        (yes(share >= t["possession_high"]), "possession_play"),
        (often, "press_triggers_often"),
        (yes(depth >= t["depth_high"]), "vertical_stretch"),
        (yes(width >= t["width_high"]), "wide_overloads"),
    ]
    return F.array_sort(F.array_compact(F.array(*[F.when(test, F.lit(tag)) for test, tag in rules])))


def candidate_forms(fvf: DataFrame, contexts: DataFrame, classes: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """Formations considered per context.

    Classes (``form_id``, ``form``) that met the context in at least five pairs, in class order; all classes when
    there are none; fewer than four are filled from the model's six best. ``scores`` has the context, ``form`` and
    ``score``; classes are a short vocabulary, so a context meets a handful of rows. Output: context, ``form``,
    ``position``.
    """
    seen = (
        perspectives(fvf)
        .where((F.col("pairs") >= MIN_PAIRS) & F.col("our_form").isNotNull())
        .select(*CONTEXT, F.col("our_form").alias("form"))
        .distinct()
        .withColumn("_seen", F.lit(True))
    )
    vocabulary = classes.agg(F.array_sort(F.collect_list(F.struct("form_id", "form"))).alias("v"))
    listed = contexts.select(*CONTEXT).withColumn("_v", vocabulary.scalar()).select(*CONTEXT, F.inline("_v"))
    if scores is not None:
        listed = listed.join(scores.select(*CONTEXT, "form", F.col("score").alias("_score")), [*CONTEXT, "form"], "left")
    else:
        listed = listed.withColumn("_score", F.lit(0.0))
    w = Window.partitionBy(*CONTEXT)
    rows = listed.join(seen, [*CONTEXT, "form"], "left").withColumn("_seen", F.coalesce("_seen", F.lit(False)))
    rows = rows.withColumn("_n", F.sum(F.col("_seen").cast("int")).over(w))
    by_score = w.orderBy(F.col("_score").desc_nulls_last(), F.col("form_id").desc())
    rows = rows.withColumn("_rank", F.row_number().over(by_score))
    own = F.col("_seen") | (F.col("_n") == 0)
    fill = ~own & (F.col("_rank") <= MODEL_CANDIDATES)
    rows = rows.withColumns({"_own": own, "_fill": fill})
    kept = F.sum(F.col("_own").cast("int")).over(w)
    nth_fill = F.sum(F.col("_fill").cast("int")).over(w.orderBy("_rank").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"_kept": kept, "_nth": nth_fill})
    rows = rows.where(F.col("_own") | (F.col("_fill") & (F.col("_kept") + F.col("_nth") <= MIN_CANDIDATES)))
    order = w.orderBy(F.when(F.col("_own"), 0).otherwise(1), F.when(F.col("_own"), F.col("form_id")).otherwise(F.col("_rank")))
    return rows.select(*CONTEXT, "form", "form_id", "_score", F.row_number().over(order).alias("position")).withColumnRenamed("_score", "score")


def scores_to_probabilities(scores: DataFrame, context: list[str], score: str = "score", source: str = "logits") -> DataFrame:
    """Add ``prob`` per context: softmax of logits (shifted by the maximum), or given probabilities scaled to one."""
    w = Window.partitionBy(*context)
    if source == "probs":
        return scores.withColumn("prob", normalised(F.col(score), w))
    power = F.exp(F.col(score) - F.max(score).over(w))
    return scores.withColumn("_e", power).withColumn("prob", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def _scaled(value: str, bounds: Column) -> Column:
    low = F.coalesce(F.get(bounds, F.lit(0)), F.lit(0.0))
    high = F.get(bounds, F.lit(1))
    top = F.when(high.isNull() | (high == low), low + 1.0).otherwise(high)
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(value) - low) / (top - low)))
    return F.when(F.col(value).isNotNull(), share)


def matchup_prior(fvf: DataFrame, candidates: DataFrame, tags: DataFrame | None = None, strategies: tuple[str, ...] = ("attack", "defense")) -> DataFrame:
    """Metric-aware prior of the candidate formations per context and strategy.

    Form means are scaled between the context's 5 % and 95 % quantiles (over its few forms), weighted by strategy and
    style tags, and damped for match-ups seen rarely. Output: context, ``strategy``, ``form``, ``composite``,
    ``pairs_w``, ``prior``.
    """
    rows = perspectives(fvf, PRIOR_METRICS)
    means = rows.groupBy(*CONTEXT, F.col("our_form").alias("form")).agg(
        F.avg("pairs").alias("pairs"), *[F.avg(f"our_{m}").alias(m) for m in PRIOR_METRICS]
    )
    kept = means.join(candidates.select(*CONTEXT, "form").distinct(), [*CONTEXT, "form"], "left_semi")
    columns = ["pairs", *[m for m in PRIOR_METRICS if m != "strength"]]
    bounds = kept.groupBy(*CONTEXT).agg(*[F.percentile(c, F.array(F.lit(0.05), F.lit(0.95))).alias(f"_b_{c}") for c in columns])
    z = kept.join(bounds, CONTEXT)
    term = {c: _scaled(c, F.col(f"_b_{c}")) for c in columns}
    z = z.select(
        *CONTEXT,
        "form",
        F.coalesce(term["pairs"], F.lit(0.0)).alias("pairs_w"),
        F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("strength"))), F.lit(0.0)).alias("strength"),
        *[((1.0 - term[m]) if m in NEGATIVE_METRICS else term[m]).alias(m) for m in columns if m != "pairs"],
    )
    z = z.join(tags.select(*CONTEXT, "tags"), CONTEXT, "left") if tags is not None else z.withColumn("tags", F.array().cast("array<string>"))
    has = lambda t: F.coalesce(F.array_contains("tags", t), F.lit(False))
    compact, wide = has("compact_block").cast("double"), (has("wide_overloads") | has("switches_of_play")).cast("double")
    extra = {"width": 0.05 * compact, "depth": 0.05 * compact, "ppda": 0.03 * wide, "press_rate": 0.02 * wide}

    def composite(weights: dict[str, float]) -> Column:
        names = ["strength", "xt", "ppda", "ppda_press", "press_rate", "avg_press", "width", "depth"]
        return sum(((F.lit(weights.get(n, 0.0)) + extra.get(n, F.lit(0.0))) * F.col(n) for n in names), F.lit(0.0))

    options = F.array(
        *[F.struct(F.lit(s).alias("strategy"), composite(STRATEGY_WEIGHTS.get(s, STRATEGY_WEIGHTS["mixed"])).alias("composite")) for s in strategies]
    )
    out = z.select(*CONTEXT, "form", "pairs_w", F.inline(options))
    damped = F.col("composite") * (0.3 + 0.7 * F.col("pairs_w"))
    return out.withColumn("prior", normalised(damped, Window.partitionBy(*CONTEXT, "strategy")))


def fuse(model: DataFrame, prior: DataFrame, context: list[str], alpha: float = FUSION_ALPHA, beta: float = FUSION_BETA) -> DataFrame:
    """Weighted sum of model probability and prior per formation, scaled to one and ranked; missing counts 0."""
    both = model.select(*context, "form", "prob").join(prior.select(*context, "form", "prior"), [*context, "form"], "full_outer")
    raw = both.withColumns({"prob": F.coalesce("prob", F.lit(0.0)), "prior": F.coalesce("prior", F.lit(0.0))})
    raw = raw.withColumn("_raw", alpha * F.col("prob") + beta * F.col("prior"))
    w = Window.partitionBy(*context)
    fused = raw.withColumn("score", normalised(F.col("_raw"), w)).drop("_raw")
    return fused.withColumn("position", F.row_number().over(w.orderBy(F.round(F.col("score"), 12).desc(), "form")))


def coach_note(form: Column, phase: Column, pick: Column, strategy: Column, tags: Column) -> Column:
    """One sentence that says what was recommended and why."""
    seen = F.when(F.size(tags) > 0, F.concat(F.lit(" Opponent style: "), F.array_join(tags, ", "), F.lit("."))).otherwise(F.lit(""))
    return F.concat(F.format_string("Against a %s in %s, deploy a %s (%s).", form, phase, pick, strategy), seen)


def recommend(
    fvf: DataFrame,
    contexts: DataFrame,
    classes: DataFrame,
    counters: DataFrame,
    scores: DataFrame | None = None,
    strategies: tuple[str, ...] = ("attack", "defense"),
    source: str = "logits",
    alpha: float = FUSION_ALPHA,
    beta: float = FUSION_BETA,
    topk: int = TOP_K,
) -> DataFrame:
    """Recommended formation with evidence for every context and strategy.

    ``scores`` (context, ``form``, ``score``) come from a model; without them every class is equally likely. The prior
    is the knowledge graph's where it knows a candidate, else the match-up metrics'. The tables of contexts that several
    parts read are stored on the way.
    """
    picks = stored(candidate_forms(fvf, contexts, classes, scores))
    filled = picks.withColumn("score", F.coalesce("score", F.lit(0.0)))
    model = scores_to_probabilities(filled, CONTEXT, source=source)
    metrics = context_metrics(fvf)
    tagged = stored(
        metrics.select(
            *CONTEXT, style_tags("opp_", columns=metrics.columns).alias("tags"), style_tags("our_", columns=metrics.columns).alias("our_tags")
        )
    )
    matchup = matchup_prior(fvf, picks, tagged, strategies)
    graph = kg_prior(contexts.select(*CONTEXT), counters, CONTEXT).select(*CONTEXT, F.col("candidate").alias("form"), F.col("support"))
    known = graph.join(picks.select(*CONTEXT, "form"), [*CONTEXT, "form"], "left_semi")
    known = stored(known.withColumn("prior", normalised(F.col("support"), Window.partitionBy(*CONTEXT))))
    named = F.array(*[F.lit(s) for s in strategies])
    spread = known.select(*CONTEXT, F.explode(named).alias("strategy"), "form", "prior")
    from_graph = known.select(*CONTEXT).distinct()
    rest = matchup.join(from_graph, CONTEXT, "left_anti").select(*CONTEXT, "strategy", "form", "prior")
    prior = stored(spread.withColumn("prior_source", F.lit("KG.COUNTERS")).unionByName(rest.withColumn("prior_source", F.lit("FVF.prior"))))
    key = [*CONTEXT, "strategy"]
    per_strategy = model.select(*CONTEXT, F.explode(named).alias("strategy"), "form", "prob")
    fused = fuse(per_strategy, prior, key, alpha, beta)
    entry = F.struct("position", F.col("form").alias("formation"), "score")
    rows = fused.groupBy(*key).agg(
        F.array_sort(F.collect_list(entry)).alias("_all"),
        F.array_sort(F.collect_list(F.struct(F.col("form").alias("formation"), F.col("prob").alias("prob")))).alias("gnn_probs"),
        F.array_sort(F.collect_list(F.when(F.col("prior") > 0, F.struct(F.col("form").alias("candidate_form"), F.col("prior").alias("support"))))).alias("kg_prior"),
    )
    sources = prior.groupBy(*key).agg(F.max("prior_source").alias("prior_source"))
    out = rows.join(tagged, CONTEXT, "left").join(sources, key, "left")
    empty = F.array().cast("array<string>")
    out = out.withColumns({"style_tags": F.coalesce("tags", empty), "our_tags": F.coalesce("our_tags", empty)})
    shown = lambda c: F.transform(c, lambda e: F.struct(e["formation"].alias("formation"), e["score"].alias("score")))
    top = F.get("_all", F.lit(0))
    out = out.withColumns({"topk": shown(F.slice("_all", 1, max(1, topk))), "recommended_formation": top["formation"], "confidence": top["score"]})
    note = coach_note(F.col("opponent_form"), F.col("opponent_phase"), F.col("recommended_formation"), F.col("strategy"), F.col("style_tags"))
    out = out.withColumn("suggestion_text", note)
    evidence = F.struct(
        F.struct(*CONTEXT, "strategy", F.lit(alpha).alias("alpha"), F.lit(beta).alias("beta")).alias("context"),
        F.struct(
            "kg_prior", "prior_source", "gnn_probs", F.col("style_tags").alias("style_tags_opponent"), F.col("our_tags").alias("style_tags_ours")
        ).alias("contributions"),
        F.struct(shown(F.col("_all")).alias("fused_scores"), "topk").alias("fusion"),
        F.col("suggestion_text").alias("reason_text"),
    )
    return out.select(*CONTEXT, "strategy", "recommended_formation", "confidence", "topk", "style_tags", "suggestion_text", evidence.alias("evidence"))


def fallback_classes(spark: SparkSession) -> DataFrame:
    """The three default classes for use without a label map."""
    return spark.createDataFrame(list(enumerate(FALLBACK_CLASSES)), "form_id int, form string")


def to_rows(recommendations: DataFrame) -> DataFrame:
    """Recommendation rows for the sink: nested columns as JSON text."""
    return recommendations.withColumns({c: F.to_json(c) for c in ("topk", "style_tags", "evidence")})


# Fixed value: the part of the evidence that panels read.
EVIDENCE_SCHEMA = (
    "contributions STRUCT<kg_prior: ARRAY<STRUCT<candidate_form: STRING, support: DOUBLE>>, "
    "gnn_probs: ARRAY<STRUCT<formation: STRING, prob: DOUBLE>>, style_tags_opponent: ARRAY<STRING>, style_tags_ours: ARRAY<STRING>>, "
    "fusion STRUCT<topk: ARRAY<STRUCT<formation: STRING, score: DOUBLE>>>"
)


def evidence_rows(recos: DataFrame, key: list[str]) -> DataFrame:
    """One row per evidence entry: section (prior, model, fused, tags), name and value; unreadable JSON has none."""
    e = F.from_json("evidence", EVIDENCE_SCHEMA)
    tags = F.coalesce(F.nullif(F.col("_e.contributions.style_tags_opponent"), F.array().cast("array<string>")), F.from_json("style_tags", "array<string>"))

    def section(name: str, items: Column, label: str | None, value: str | None) -> Column:
        return F.transform(
            F.coalesce(items, F.array()),
            lambda i: F.struct(
                F.lit(name).alias("section"),
                (i[label] if label else i).cast("string").alias("name"),
                (i[value] if value else F.lit(None)).cast("double").alias("value"),
            ),
        )

    parts = F.concat(
        section("prior", F.col("_e.contributions.kg_prior"), "candidate_form", "support"),
        section("model", F.col("_e.contributions.gnn_probs"), "formation", "prob"),
        section("fused", F.col("_e.fusion.topk"), "formation", "score"),
        section("opponent_tag", tags, None, None),
        section("our_tag", F.col("_e.contributions.style_tags_ours"), None, None),
    )
    return recos.withColumn("_e", e).select(*key, F.inline(parts))
