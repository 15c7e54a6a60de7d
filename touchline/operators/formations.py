"""Formation naming: allowed formations, assignment costs, clusters, templates and gates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.config import ALLOWED_FORMATIONS, COST_CAP, K_MAX, K_MIN, MARGIN_FLOOR
from touchline.functions.batches import append_batchwise
from touchline.functions.keys import join_keys
from touchline.functions.shapes import best_counts, bures
from touchline.operators import rounds
from touchline.operators.assignments import best_assignments
from touchline.operators.quantiles import exact_quantiles
from touchline.session import compute_partitions, discard, stored


def project_to_allowed(
    df: DataFrame, counts: str, phase: str, allowed: dict[str, list[str]] = ALLOWED_FORMATIONS, name: str = "formation"
) -> DataFrame:
    """Add the allowed formation of the phase nearest to the line counts.

    Distance: twice the difference in number of lines plus the differences line by line; the first listed wins ties.
    A phase without a list keeps its counts as the name. The lists are constants of the plan.
    """
    raw = F.array_join(F.transform(counts, lambda n: n.cast("string")), "-")

    def distance(form: str) -> Column:
        lines = [int(n) for n in form.split("-")]
        fixed = F.array(*[F.lit(n) for n in lines])
        size = F.least(F.size(counts), F.lit(len(lines)))
        gaps = F.zip_with(F.slice(counts, 1, size), F.slice(fixed, 1, size), lambda a, b: F.abs(a - b))
        return 2 * F.abs(F.size(counts) - len(lines)) + F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

    out = raw
    for key, forms in allowed.items():
        options = F.array(*[F.struct(distance(f).alias("d"), F.lit(i).alias("pos"), F.lit(f).alias("form")) for i, f in enumerate(forms)])
        out = F.when(F.lower(phase) == key, F.array_min(options)["form"]).otherwise(out)
    return df.withColumn(name, out)


BATCH = 1024


def _solve(matrices: pa.Array) -> list[pa.Array]:
    """Costs and chosen columns of a batch of flat square matrices; NULL stays NULL."""
    sizes = np.sqrt(pc.fill_null(pc.list_value_length(matrices), 0).to_numpy(zero_copy_only=False)).round().astype(int)
    costs = np.full(len(matrices), np.nan)
    chosen: list = [None] * len(matrices)
    for n in sorted(set(sizes) - {0}):
        at = np.flatnonzero(sizes == n)
        for part in np.array_split(at, -(-len(at) // BATCH)):
            flat = pc.list_flatten(matrices.take(pa.array(part))).to_numpy(zero_copy_only=False)
            total, columns = best_assignments(flat.reshape(len(part), n, n))
            costs[part] = total
            for i, c in zip(part, columns):
                chosen[i] = c
    return [pa.array(costs, from_pandas=True), pa.array(chosen, pa.list_(pa.int32()))]


def with_assignment(df: DataFrame, matrix: Column, cost: str = "cost", columns: str = "columns") -> DataFrame:
    """Add the minimum total cost and the 0-based column of each row, from a flat row-major square matrix.

    The matrix is built by column expressions; the exact solver runs on Arrow batches inside the tasks.
    """
    made = T.StructType().add(cost, T.DoubleType()).add(columns, T.ArrayType(T.IntegerType()))
    return append_batchwise(df, matrix, made, _solve)


def role_costs(a: Column, b: Column, cov: Column | None = None) -> Column:
    """Flat matrix of Gaussian distances from every role of ``a`` to every role of ``b``.

    ``cov`` holds (xx, xy, yy) structs of ``b``'s roles; without it every role has half the unit matrix.
    """

    def cell(p: Column, q: Column, j: Column) -> Column:
        c = F.get(cov, j) if cov is not None else None
        xx, xy, yy = (c["xx"], c["xy"], c["yy"]) if c is not None else (F.lit(0.5), F.lit(0.0), F.lit(0.5))
        return bures(p["x"], p["y"], q["x"], q["y"], xx, xy, yy)

    return F.flatten(F.transform(a, lambda p: F.transform(b, lambda q, j: cell(p, q, j))))


def square_costs(a: Column, b: Column) -> Column:
    """Flat matrix of squared distances between the points of two arrays."""
    return F.flatten(
        F.transform(a, lambda p: F.transform(b, lambda q: F.pow(p["x"] - q["x"], 2) + F.pow(p["y"] - q["y"], 2)))
    )


def _key_order(block: list[str]) -> list[Column]:
    """A fixed order that does not follow time: the hash of the block's key, then the key."""
    return [F.md5(F.concat_ws("|", *[F.col(b).cast("string") for b in block])), *[F.col(b) for b in block]]


POINTS = "array<struct<x:double,y:double>>"


def start_shapes(blocks: DataFrame, by: list[str], block: list[str], points: str = "pts", k_max: int = K_MAX) -> DataFrame:
    """Up to ``k_max`` start shapes per group: ``c`` from 1 and ``shape``.

    All blocks of a group are walked farthest-first from the first in hash order, so the first k shapes are the start for k clusters. A start is one pass: every block keeps the cost to its
    nearest start, and the group's largest cost comes from partial maxima.
    """
    rows = blocks.where(F.col(points).isNotNull()).select(*by, F.struct(*[k.alias(f"k{i}") for i, k in enumerate(_key_order(block))]).alias("_key"), F.col(points).cast(POINTS).alias("_pts"))
    rows = rows.withColumn("_near", F.lit(float("inf")))
    rows, found = (stored(rows), []) if k_max > 1 else (rows, [])
    for c in range(1, k_max + 1):
        far = rows.where("_near >= 0").groupBy(*by).agg(F.min(F.struct((-F.col("_near")).alias("far"), F.col("_key").alias("key"), F.col("_pts").alias("shape"))).alias("_pick"))
        far = stored(far.select(*by, F.col("_pick.key").alias("_picked"), F.col("_pick.shape").alias("shape")))
        if c > 1 and not far.head(1):
            break
        found.append(far.select(*by, F.lit(c).alias("c"), "shape"))
        if c < k_max:
            # a group all of whose blocks are starts has no further ones
            met = with_assignment(join_keys(rows, far, by), square_costs(F.col("_pts"), F.col("shape")), "_cost", "_role")
            near = F.when(F.col("_key") == F.col("_picked"), -1.0).otherwise(F.least("_near", "_cost"))
            rows = stored(met.withColumn("_near", near).select(*by, "_key", "_pts", "_near"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def shape_costs(blocks: DataFrame, shapes: DataFrame, on: list[str], points: str = "pts") -> DataFrame:
    """Blocks with every shape of the same ``on``: all columns of both, ``cost`` and each point's matched ``role``.

    A group has a handful of shapes, so the work is one exact assignment per block and shape; no blocks are paired.
    """
    spread = blocks.where(F.col(points).isNotNull()).repartition(compute_partitions(blocks.sparkSession))
    met = join_keys(spread, shapes, on)
    return with_assignment(met, square_costs(F.col(points), F.col("shape")), "cost", "role").drop("shape")


def mean_shapes(matched: DataFrame, by: list[str], points: str = "pts") -> DataFrame:
    """Mean point of every role over the blocks of each ``by``, as ``shape``."""
    long = matched.select(*by, F.inline(F.arrays_zip(F.col("role"), F.col(points).cast(POINTS).alias("p"))))
    role = long.groupBy(*by, "role").agg(F.avg("p.x").alias("x"), F.avg("p.y").alias("y"))
    ordered = F.array_sort(F.collect_list(F.struct("role", "x", "y")))
    return role.groupBy(*by).agg(F.transform(ordered, lambda r: F.struct(r["x"].alias("x"), r["y"].alias("y"))).alias("shape"))


def label_shapes(blocks: DataFrame, by: list[str], block: list[str], points: str = "pts", rounds: int = 1) -> DataFrame:
    """Mean shape of each group of given labels (``by`` includes the label).

    Members are matched role by role to the group's first block in hash order, then ``rounds - 1`` times to the mean.
    """
    shapes = start_shapes(blocks, by, block, points, 1).select(*by, "shape")
    for _ in range(rounds):
        shapes = stored(mean_shapes(shape_costs(blocks.select(*by, points), shapes, by, points), by, points))
    return shapes


def silhouette(own: str, near: str) -> Column:
    """How much nearer a block is to its own shape than to the next one, from -1 to 1; without a next one 0."""
    wider = F.greatest(F.col(own), F.col(near))
    return F.when(F.col(near).isNotNull() & (wider > 0), (F.col(near) - F.col(own)) / wider).otherwise(F.lit(0.0))


def _packed_starts(slim: DataFrame, by: list[str], block: list[str], k_min: int, k_max: int) -> DataFrame:
    """The start shapes of every number of clusters, one row per group."""
    starts = stored(start_shapes(slim, by, block, "pts", k_max))
    most = starts.groupBy(*by).agg(F.max("c").alias("_most"))
    sized = join_keys(starts, most, by).withColumn("k", F.explode(F.sequence(F.greatest("c", F.lit(k_min)), F.lit(k_max))))
    shapes = stored(sized.where(F.col("k") <= F.greatest("_most", F.lit(k_min))).select(*by, "k", "c", "shape"))
    return rounds.packed_shapes(shapes, by, k_min, k_max)


def cluster_blocks(
    blocks: DataFrame,
    by: list[str],
    block: list[str],
    points: str = "pts",
    k_min: int = K_MIN,
    k_max: int = K_MAX,
) -> DataFrame:
    """Cluster the blocks of each group around mean shapes, for every number of clusters from ``k_min`` to ``k_max``.

    Each round gives every block its cheapest shape by assignment cost and every shape the mean of its members matched
    role by role, until no block moves. Silhouettes compare the cost of a block's own shape with that of the next one;
    the number of clusters with the best mean wins, the smallest on ties. Groups with fewer blocks than ``k_min`` have
    one cluster per start shape. A round solves the shapes that bounds leave open (``rounds``); groups of up to
    ``rounds.WHOLE`` blocks run theirs in one task per number of clusters. The cost of all falls from
    round to round, so labels that come back differ by ties and rounding alone and end the rounds too.

    Gives back one row per block: ``cluster_label`` (numbered by first member), ``n_blocks_in_cluster``, ``is_medoid``
    (the member nearest to its shape), ``member_cost`` (that cost) and ``silhouette``.
    """
    slim = stored(blocks.where(F.col(points).isNotNull()).select(*by, *block, F.col(points).cast(POINTS).alias("pts")))
    sizes = stored(slim.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")))
    large, small = sizes.where(F.col("_n") > rounds.WHOLE), sizes.where(F.col("_n") <= rounds.WHOLE)
    held = small.agg(F.sum("_n"), F.count(F.lit(1)) * (k_max - k_min + 1)).first()
    trails, shapes = None, None
    if held[0]:
        # a task each for few rows, and for many of them no more blocks than one row may have
        partitions = max(min(held[1], 8 * compute_partitions(slim.sparkSession)), held[0] * (k_max - k_min + 1) // rounds.WHOLE)
        groups = rounds.whole_groups(join_keys(slim, small.select(*by), by), by, F.struct(*[k.alias(f"k{i}") for i, k in enumerate(_key_order(block))]))
        trails = rounds.whole_trails(groups, by, k_min, k_max, partitions)
        longest = trails.agg(F.max(F.size("hashes"))).first()[0]
    sums: list[int] = []

    def hash_of(t: int) -> int:
        """The small groups' labels of round ``t``."""
        if trails is not None and t >= len(sums):
            sums.extend(rounds.trail_hashes(trails, len(sums), max(longest, t) + 8))
        return sums[t] if trails is not None else 0

    state, seen, turn = stored(rounds.sliced(slim, by, block, "pts")), set(), 0
    if large.head(1) or trails is None:
        mine, slices = join_keys(slim, large.select(*by), by), state
        shapes = stored(_packed_starts(mine, by, block, k_min, k_max))
        state = stored(join_keys(slices, large.select(*by), by))
    while True:
        now = hash_of(turn)
        if shapes is not None:
            before, state = state, stored(rounds.next_round(state, shapes, by, block, k_min, k_max))
            discard(before)
            now += int(state.agg(F.sum(F.col("hash").cast("decimal(38,0)"))).first()[0] or 0)
        if now in seen:
            break
        seen.add(now)
        turn += 1
        if shapes is not None:
            before, shapes = shapes, stored(rounds.moved_shapes(state, shapes, by))
            discard(before)
    state = state if shapes is None else slices
    if trails is not None:
        settled = stored(rounds.shapes_at(trails, by, turn))
        shapes = settled if shapes is None else shapes.unionByName(settled)
    near = stored(rounds.unpacked(rounds.next_round(state, shapes, by, block, k_min, k_max, whole=True), by, block, k_min, k_max))
    scored = near.withColumn("silhouette", silhouette("cost", "near"))
    means = scored.groupBy(*by, "k").agg(F.round(F.avg("silhouette"), 9).alias("_mean"))
    best = means.groupBy(*by).agg(F.min(F.struct((-F.col("_mean")).alias("_m"), "k"))["k"].alias("k"))
    chosen = stored(join_keys(scored, stored(best), [*by, "k"]))
    groups = chosen.groupBy(*by, "c").agg(
        F.count(F.lit(1)).cast("int").alias("n_blocks_in_cluster"), F.min(F.struct(*block)).alias("_first"), F.min(F.struct("cost", *block)).alias("_medoid")
    )
    label = F.row_number().over(Window.partitionBy(*by).orderBy("_first")) - 1
    named = stored(groups.withColumn("cluster_label", label).drop("_first"))
    medoid = F.struct("cost", *block).eqNullSafe(F.col("_medoid"))
    return join_keys(chosen, named, [*by, "c"]).select(
        *by, *block, "cluster_label", "n_blocks_in_cluster", medoid.alias("is_medoid"), F.col("cost").alias("member_cost"), "silhouette"
    )


def cluster_templates(blocks: DataFrame, clusters: DataFrame, by: list[str], block: list[str], points: str = "pts") -> DataFrame:
    """Mean shape of each cluster: members are matched role by role to the cluster's medoid.

    Output per group, cluster and role: member count, ``mu_x``, ``mu_y`` and the sample covariance plus 1e-6 on the
    diagonal.
    """
    placed = blocks.join(clusters.select(*by, *block, "cluster_label", "is_medoid"), [*by, *block])
    medoids = placed.where("is_medoid").select(*by, "cluster_label", F.col(points).alias("_ref"))
    met = placed.join(medoids, [*by, "cluster_label"]).select(*by, "cluster_label", F.col(points).alias("p"), "_ref")
    matched = with_assignment(met, square_costs(F.col("p"), F.col("_ref")), columns="role")
    roles = matched.select(*by, "cluster_label", F.inline(F.arrays_zip("role", "p")))
    x, y = F.col("p.x"), F.col("p.y")
    many = F.count(F.lit(1)) > 1
    return roles.groupBy(*by, "cluster_label", (F.col("role") + 1).alias("role")).agg(
        F.count(F.lit(1)).alias("n_members"),
        F.avg(x).alias("mu_x"),
        F.avg(y).alias("mu_y"),
        (F.when(many, F.var_samp(x)).otherwise(0.0) + 1e-6).alias("cov_xx"),
        F.when(many, F.covar_samp(x, y)).otherwise(0.0).alias("cov_xy"),
        (F.when(many, F.var_samp(y)).otherwise(0.0) + 1e-6).alias("cov_yy"),
    )


def named_templates(templates: DataFrame, by: list[str], phase: str, lines: str = "gap") -> DataFrame:
    """Name each cluster's mean shape and merge clusters of the same name.

    Output per group and name: ``members`` and ``roles``, the (x, y, xx, xy, yy) of each role in order.
    """
    role = F.struct("role", F.col("mu_x").alias("x"), F.col("mu_y").alias("y"))
    shape = templates.groupBy(*by, "cluster_label").agg(
        F.array_sort(F.collect_list(role)).alias("_pts"), F.max("n_members").alias("_members")
    )
    counted = shape.withColumn("_counts", best_counts(F.col("_pts"), lines))
    named = project_to_allowed(counted, "_counts", phase).select(*by, "cluster_label", "formation", "_members")
    merged = (
        templates.join(named, [*by, "cluster_label"])
        .groupBy(*by, "formation", "role")
        .agg(
            F.avg("mu_x").alias("x"),
            F.avg("mu_y").alias("y"),
            (F.avg("cov_xx") + 1e-6).alias("xx"),
            F.avg("cov_xy").alias("xy"),
            (F.avg("cov_yy") + 1e-6).alias("yy"),
            F.sum("_members").alias("members"),
        )
    )
    return merged.groupBy(*by, "formation").agg(
        F.array_sort(F.collect_list(F.struct("role", "x", "y", "xx", "xy", "yy"))).alias("roles"),
        F.max("members").alias("members"),
    )


def match_templates(blocks: DataFrame, templates: DataFrame, by: list[str], block: list[str], points: str = "pts") -> DataFrame:
    """Best template of each block, plain or mirrored in x, with its cost and the margin to the second best.

    A group has at most ``K_MAX`` templates, so a block meets a handful of rows. The mirror leaves the template's
    covariance as it is.
    """
    sides = F.explode(F.array(F.lit(0), F.lit(1))).alias("_mirror")
    named = stored(templates.select(*by, F.col("formation").alias("_form"), "roles", "members"))
    spread = blocks.select(*by, *block, F.col(points).alias("_pts")).repartition(compute_partitions(blocks.sparkSession), *by, *block)
    pairs = spread.select("*", sides).join(named, by)
    turned = F.transform(
        "_pts", lambda p: F.struct((p["x"] * F.when(F.col("_mirror") == 1, -1.0).otherwise(1.0)).alias("x"), p["y"].alias("y"))
    )
    staged = pairs.withColumn("_turned", turned)
    slim = staged.select(*by, *block, "_mirror", "_form", "members", role_costs(F.col("_turned"), F.col("roles"), F.col("roles")).alias("_m"))
    costs = with_assignment(slim, F.col("_m"), "_cost", "_columns")
    option = F.struct(F.col("_cost").alias("cost"), F.col("_mirror").alias("mirror"), F.col("_form").alias("form"), "members")
    best = costs.groupBy(*by, *block).agg(F.slice(F.array_sort(F.collect_list(option)), 1, 2).alias("_best"))
    first, second = F.get("_best", F.lit(0)), F.get("_best", F.lit(1))
    return best.select(
        *by,
        *block,
        first["form"].alias("formation"),
        first["mirror"].alias("mirrored"),
        first["cost"].alias("w2_cost"),
        (second["cost"] - first["cost"]).alias("w2_margin"),
        first["members"].alias("members"),
    )


# Scale of the median absolute deviation and the factors of the cost gate.
MAD_SCALE = 1.4826
MAD_FACTOR = 3.0
FLAT_FACTOR = 2.5


def robust_gates(
    matches: DataFrame, by: list[str], cost_cap: float = COST_CAP, margin_floor: float = MARGIN_FLOOR
) -> DataFrame:
    """Largest accepted cost (median + 3 scaled MADs, capped) and smallest accepted margin (10 % quantile) per group."""
    both = F.array(
        F.struct(F.lit("cost").alias("_what"), F.col("w2_cost").alias("_value")),
        F.struct(F.lit("margin").alias("_what"), F.col("w2_margin").alias("_value")),
    )
    long = matches.select(*by, F.inline(both))
    marks = stored(exact_quantiles(long, [*by, "_what"], "_value", {"_median": 0.5, "_p10": 0.1}))
    middle = marks.where("_what = 'cost'").select(*by, "_median")
    margin = marks.where("_what = 'margin'").select(*by, "_p10")
    spread = matches.join(middle, by).withColumn("_dev", F.abs(F.col("w2_cost") - F.col("_median")))
    mad = exact_quantiles(spread, by, "_dev", {"_mad": 0.5})
    scaled = F.col("_mad") * MAD_SCALE
    limit = F.when(scaled > 0, F.col("_median") + MAD_FACTOR * scaled).otherwise(F.col("_median") * FLAT_FACTOR)
    return (
        middle.join(mad, by)
        .join(margin, by, "left")
        .select(
            *by,
            F.least(limit, F.lit(float(cost_cap))).alias("cost_limit"),
            F.greatest(F.coalesce("_p10", F.lit(0.0)), F.lit(float(margin_floor))).alias("margin_limit"),
        )
    )


# How an accepted template and a model fallback are recorded.
TEMPLATE_METHOD = "w2_hungarian_template"
FALLBACK_METHOD = "resnet_fallback_conf_%.3f"


def predict_formations(
    blocks: DataFrame,
    matches: DataFrame,
    gates: DataFrame,
    by: list[str],
    block: list[str],
    clusters: DataFrame | None = None,
    fallback: DataFrame | None = None,
) -> DataFrame:
    """Formation of each block: its template's name when cost and margin pass the gates, else the model's label.

    ``fallback`` has ``block`` keys, ``label`` and ``confidence``; without it the label is ``unknown``.
    """
    out = blocks.join(matches, [*by, *block], "left").join(gates, by, "left")
    if clusters is not None:
        out = out.join(clusters.select(*by, *block, "cluster_label", "n_blocks_in_cluster"), [*by, *block], "left")
    else:
        out = out.withColumns({"cluster_label": F.lit(None).cast("int"), "n_blocks_in_cluster": F.lit(None).cast("int")})
    if fallback is not None:
        out = out.join(fallback.select(*by, *block, F.col("label").alias("_label"), F.col("confidence").alias("_conf")), [*by, *block], "left")
    else:
        out = out.withColumns({"_label": F.lit(None).cast("string"), "_conf": F.lit(None).cast("double")})
    accepted = F.coalesce(
        (F.col("w2_cost") <= F.col("cost_limit")) & (F.col("w2_margin") >= F.col("margin_limit")), F.lit(False)
    )
    out = out.withColumn("_ok", accepted)
    return out.withColumns(
        {
            "predicted_formation": F.when(F.col("_ok"), F.col("formation")).otherwise(F.coalesce("_label", F.lit("unknown"))),
            "method": F.when(F.col("_ok"), F.lit(TEMPLATE_METHOD)).otherwise(
                F.format_string(FALLBACK_METHOD, F.coalesce("_conf", F.lit(0.0)))
            ),
            "chosen_template_size": F.when(F.col("_ok"), F.col("members").cast("int")).otherwise(F.col("n_blocks_in_cluster")),
        }
    ).drop("formation", "mirrored", "members", "cost_limit", "margin_limit", "_label", "_conf", "_ok")
