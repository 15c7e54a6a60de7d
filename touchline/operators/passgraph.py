"""Passing graphs of teams and their labels from formation match-ups."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.config import DEFAULT_FORMATION, PITCH_LENGTH
from touchline.functions.batches import append_batchwise
from touchline.functions.events import same_value

CONTEXT = ["provider", "our_side", "opponent_form", "opponent_phase"]


def slice_passes(
    events: DataFrame, pass_value: str = "pass", label: str = "original_event", receiver: str = "receiver", match_id=None, team_id=None
) -> DataFrame:
    """Completed-receiver passes of a slice; match and team filter only when given."""
    return events.where(
        (F.lower(label) == pass_value.lower())
        & F.col(receiver).isNotNull()
        & same_value("match_id", match_id)
        & same_value("team_id", team_id)
    )


def modal_team(passes: DataFrame, by: list[str], team: str = "team_id") -> DataFrame:
    """Most frequent team of each slice, the smallest on ties."""
    counts = passes.where(F.col(team).isNotNull()).groupBy(*by, team).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*by).agg(F.min_by(team, F.struct((-F.col("_n")).alias("n"), F.col(team).alias("t"))).alias(team))


def pass_nodes(passes: DataFrame, by: list[str]) -> DataFrame:
    """Six features per player: passes made and received, success rate, mean touch place, mean pass length.

    Every pass counts once for its passer and once for its receiver in a single scan.
    """
    length = F.hypot(F.col("x2") - F.col("x"), F.col("y2") - F.col("y"))
    zero, none = F.lit(0.0), F.lit(None).cast("double")
    role = F.array(
        F.struct(F.col("passer").alias("player"), F.lit(1).alias("made"), F.col("success").cast("double").alias("ok"), F.col("x").alias("tx"), F.col("y").alias("ty"), length.alias("len")),
        F.struct(F.col("receiver").alias("player"), F.lit(0).alias("made"), zero.alias("ok"), F.col("x2").alias("tx"), F.col("y2").alias("ty"), none.alias("len")),
    )
    touches = passes.select(*by, F.inline(role))
    g = touches.groupBy(*by, "player").agg(
        F.sum("made").alias("made"),
        F.sum(1 - F.col("made")).alias("received"),
        F.sum("ok").alias("_ok"),
        (F.sum("tx") / F.count(F.lit(1))).alias("_tx"),
        (F.sum("ty") / F.count(F.lit(1))).alias("_ty"),
        F.sum("len").alias("_len"),
    )
    tries = F.greatest(F.lit(1), F.col("made"))
    return g.select(
        *by,
        "player",
        "made",
        "received",
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("_ok") / tries, zero))).alias("success_rate"),
        F.coalesce("_tx", zero).alias("mean_x"),
        F.coalesce("_ty", zero).alias("mean_y"),
        F.coalesce(F.col("_len") / tries / PITCH_LENGTH, zero).alias("mean_length"),
    )


def pass_edges(passes: DataFrame, by: list[str]) -> DataFrame:
    """Three features per directed pair: share of the slice's passes, success rate, length of the mean vector."""
    g = passes.where(F.col("passer").isNotNull() & F.col("receiver").isNotNull()).groupBy(*by, "passer", "receiver").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col("success").cast("double")).alias("_ok"),
        F.avg(F.col("x2") - F.col("x")).alias("_dx"),
        F.avg(F.col("y2") - F.col("y")).alias("_dy"),
    )
    totals = passes.groupBy(*by).agg(F.count(F.lit(1)).alias("_total"))
    joined = g.join(totals, by)
    return joined.select(
        *by,
        "passer",
        "receiver",
        "n",
        (F.col("n") / F.greatest(F.lit(1), F.col("_total"))).alias("share"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("_ok", F.lit(0.0)))).alias("success_rate"),
        F.coalesce(F.hypot("_dx", "_dy") / PITCH_LENGTH, F.lit(0.0)).alias("mean_length"),
    )


def graph_summary(nodes: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """Number of graphs and their mean node and edge counts."""
    n = nodes.groupBy(*by).agg(F.count(F.lit(1)).alias("_nodes"))
    e = edges.groupBy(*by).agg(F.count(F.lit(1)).alias("_edges"))
    return n.join(e, by).agg(
        F.count(F.lit(1)).alias("num_graphs"), F.avg("_nodes").alias("avg_nodes"), F.avg("_edges").alias("avg_edges")
    )


def graph_pack(nodes: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """One row per graph: node features in player order and edges as node positions with features.

    A graph is one squad, so its lists are short.
    """
    features = F.struct("player", "made", "received", "success_rate", "mean_x", "mean_y", "mean_length")
    n = nodes.groupBy(*by).agg(F.array_sort(F.collect_list(features)).alias("nodes"))
    e = edges.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("passer", "receiver", "share", "success_rate", "mean_length"))).alias("_edges")
    )
    players = F.transform("nodes", lambda p: p["player"])
    placed = F.transform(
        "_edges",
        lambda q: F.struct(
            (F.array_position(players, q["passer"]) - 1).cast("int").alias("source"),
            (F.array_position(players, q["receiver"]) - 1).cast("int").alias("target"),
            q["share"].alias("share"),
            q["success_rate"].alias("success_rate"),
            q["mean_length"].alias("mean_length"),
        ),
    )
    return n.join(e, by).select(*by, "nodes", placed.alias("edges"))


def score_graphs(graphs: DataFrame, model: Callable[[list[dict]], list[list[float]]]) -> DataFrame:
    """Add ``logits`` from a user's model, called on lists of ``{"nodes": ..., "edges": ...}`` inside the tasks."""

    def logits(packed: pa.Array) -> list[pa.Array]:
        return [pa.array([list(map(float, row)) for row in model(packed.to_pylist())], pa.list_(pa.float32()))]

    made = T.StructType().add("logits", T.ArrayType(T.FloatType()))
    return append_batchwise(graphs, F.struct("nodes", "edges"), made, logits)


def perspectives(fvf: DataFrame, metrics: tuple[str, ...] = ("strength",), extra: tuple[str, ...] = ("pairs",)) -> DataFrame:
    """Both sides' view of every match-up in one scan.

    Output: provider, our_side, opponent_form, opponent_phase, our_form, our_phase, ``our_<metric>``,
    ``opp_<metric>`` and the ``extra`` columns. Rows without opponent form or phase go.
    """
    def view(us: str, them: str):
        cols = [
            F.lit(us).alias("our_side"),
            F.col(f"{them}_form").alias("opponent_form"),
            F.col(f"phase_{them}").alias("opponent_phase"),
            F.col(f"{us}_form").alias("our_form"),
            F.col(f"phase_{us}").alias("our_phase"),
        ]
        for m in metrics:
            for name, side in (("our", us), ("opp", them)):
                source = F.col(f"{side}_{m}") if f"{side}_{m}" in fvf.columns else F.lit(None)
                cols.append(source.cast("double").alias(f"{name}_{m}"))
        return F.struct(*cols)

    both = fvf.select("provider", *extra, F.inline(F.array(view("home", "away"), view("away", "home"))))
    return both.where("opponent_form IS NOT NULL AND opponent_phase IS NOT NULL")


def best_counter(rows: DataFrame, context: list[str] = CONTEXT) -> DataFrame:
    """Strongest own formation per context by mean strength, the first by name on ties."""
    means = rows.where("our_form IS NOT NULL").groupBy(*context, "our_form").agg(F.avg("our_strength").alias("_s"))
    known = means.where("_s IS NOT NULL")
    rank = F.struct((-F.col("_s")).alias("s"), F.col("our_form").alias("f"))
    return known.groupBy(*context).agg(
        F.min_by("our_form", rank).alias("best_form"), F.max("_s").alias("best_strength")
    )


def best_counters(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Best formation per provider context and per context over all providers."""
    return best_counter(rows), best_counter(rows, CONTEXT[1:])


def form_ids(best: DataFrame, overall: DataFrame) -> DataFrame:
    """Class ids of the formations in alphabetical order; the vocabulary of formations is a few dozen names."""
    forms = best.select("best_form").unionByName(overall.select("best_form"))
    vocabulary = forms.agg(F.array_sort(F.collect_set("best_form")).alias("v"))
    return vocabulary.select(F.posexplode("v").alias("form_id", "form")).select("form", "form_id")


def slice_labels(rows: DataFrame, best: DataFrame, overall: DataFrame, ids: DataFrame) -> DataFrame:
    """Label of each slice: the provider's best formation, else the overall one, else the first formation."""
    b = best.select(*CONTEXT, F.col("best_form").alias("_b"))
    o = overall.select(*CONTEXT[1:], F.col("best_form").alias("_o"))
    first = ids.agg(F.min("form")).scalar()
    labelled = rows.join(b, CONTEXT, "left").join(o, CONTEXT[1:], "left")
    labelled = labelled.withColumn("label_form", F.coalesce("_b", "_o", first, F.lit(DEFAULT_FORMATION))).drop("_b", "_o")
    return labelled.join(ids.select(F.col("form").alias("label_form"), F.col("form_id").alias("label_id")), "label_form", "left")


def sample_slices(labelled: DataFrame, n: int, keys: list[str], seed: int = 42) -> DataFrame:
    """``n`` slices in a fixed pseudo-random order of their keys."""
    return labelled.orderBy(F.xxhash64(*keys, F.lit(seed)), *keys).limit(n)


def wing_bias(edges: DataFrame, nodes: DataFrame, by: list[str], factor: float = 1.2) -> DataFrame:
    """Left or right bias of a graph: use of edges that touch one half exceeds the other's by ``factor``.

    ``mean_y`` of the nodes must be in metres from the centre line.
    """
    y = nodes.select(*by, "player", F.col("mean_y").alias("_y"))
    u = y.withColumnsRenamed({"player": "passer", "_y": "_uy"})
    w = y.withColumnsRenamed({"player": "receiver", "_y": "_wy"})
    used = edges.join(u, [*by, "passer"]).join(w, [*by, "receiver"])
    left = F.sum(F.when((F.col("_uy") < 0) | (F.col("_wy") < 0), F.col("share")).otherwise(0.0))
    right = F.sum(F.when((F.col("_uy") > 0) | (F.col("_wy") > 0), F.col("share")).otherwise(0.0))
    g = used.groupBy(*by).agg(left.alias("use_left"), right.alias("use_right"))
    tag = F.when(F.col("use_left") > factor * (F.col("use_right") + 1e-6), "left_bias").when(
        F.col("use_right") > factor * (F.col("use_left") + 1e-6), "right_bias"
    )
    return g.withColumn("bias", tag)
