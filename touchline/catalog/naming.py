"""Queries over assignment costs, clusters, templates and formation predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.catalog import views as v
from touchline.catalog.frames import r6
from touchline.catalog.geometry import r4
from touchline.catalog.views import with_views
from touchline.operators import formations as fm
from touchline.session import stored

ROLES = 10


def _solved(name: str, pairs: str, extra: str = "0", path: bool = True) -> str:
    """SQL for the check engine: exact assignments by a recursion over sets of used roles.

    ``pairs`` selects ``pid`` and the points (ax, ay, i) and (ox, oy, j) of both shapes; ``extra`` adds to a cell's cost.
    The CTE ``name`` has ``pid``, ``cost`` and ``path``, four bits per point of the first shape.
    """
    step = "arg_min(dp.path * 16 + cell.j, dp.cost + cell.c)" if path else "CAST(0 AS BIGINT)"
    return f"""{name}_cell AS (SELECT pid, i, j, pow(ax - ox, 2) + pow(ay - oy, 2) + {extra} AS c FROM ({pairs})),
{name}_dp AS (
  SELECT pid, CAST(0 AS BIGINT) AS step, CAST(0 AS BIGINT) AS used, CAST(0 AS DOUBLE) AS cost, CAST(0 AS BIGINT) AS path FROM (SELECT DISTINCT pid FROM {name}_cell)
  UNION ALL
  SELECT dp.pid, dp.step + 1, dp.used | (CAST(1 AS BIGINT) << (cell.j - 1)), min(dp.cost + cell.c), {step}
  FROM {name}_dp dp JOIN {name}_cell cell ON cell.pid = dp.pid AND cell.i = dp.step + 1 AND (dp.used & (CAST(1 AS BIGINT) << (cell.j - 1))) = 0
  GROUP BY 1, 2, 3),
{name} AS (SELECT pid, cost, path FROM {name}_dp WHERE step = 10)"""


def _recursive(names: str, body: str) -> str:
    return with_views(names, body).replace("WITH ", "WITH RECURSIVE ", 1)


ROLE_OF = "CAST((path >> (4 * (10 - i))) & 15 AS BIGINT)"
WIDE_SQL = "w AS (SELECT side, frame, label, i, x, y, concat(side, '|', CAST(frame AS VARCHAR)) AS bid FROM fx_roles WHERE i <= 10)"


def _blocks(spark, sf_dir):
    return v.role_points(spark, sf_dir, ROLES).withColumnRenamed("frame", "block_id")


def assignment_cost(spark, sf_dir):
    p = v.role_points(spark, sf_dir, 10)
    home = p.where("side = 'home'").select("frame", F.col("pts").alias("a"))
    away = p.where("side = 'away'").select("frame", F.col("pts").alias("b"))
    both = home.join(away, "frame").select("frame", fm.role_costs(F.col("a"), F.col("b")).alias("m"))
    return fm.with_assignment(both, F.col("m")).select("frame", r4("cost", "cost"))


ASSIGNMENT_SQL = with_views("fx_roles", """
WITH cell AS (SELECT a.frame, a.i, b.i AS j, pow(a.x - b.x, 2) + pow(a.y - b.y, 2) AS c
         FROM fx_roles a JOIN fx_roles b ON a.frame = b.frame AND a.side = 'home' AND b.side = 'away' AND a.i <= 10 AND b.i <= 10),
dp AS (SELECT frame, CAST(0 AS BIGINT) AS step, CAST(0 AS BIGINT) AS used, CAST(0 AS DOUBLE) AS cost FROM (SELECT DISTINCT frame FROM cell)
       UNION ALL
       SELECT dp.frame, dp.step + 1, dp.used | (CAST(1 AS BIGINT) << (cell.j - 1)), min(dp.cost + cell.c)
       FROM dp JOIN cell ON cell.frame = dp.frame AND cell.i = dp.step + 1 AND (dp.used & (CAST(1 AS BIGINT) << (cell.j - 1))) = 0
       GROUP BY 1, 2, 3)
SELECT frame, round(cost, 4) AS cost FROM dp WHERE step = 10""").replace("WITH fx_roles AS", "WITH RECURSIVE fx_roles AS", 1)


def _label_costs(spark, sf_dir):
    """Blocks and the cost to the mean shape of every label of their side."""
    b = stored(_blocks(spark, sf_dir))
    shapes = fm.label_shapes(b, ["side", "label"], ["block_id"]).withColumnRenamed("label", "template")
    return b, stored(fm.shape_costs(b, shapes, ["side"]).select("side", "block_id", "label", "template", "cost"))


_LABEL_COSTS = "WITH " + WIDE_SQL + """,
head AS (SELECT side, label, frame FROM (SELECT *, row_number() OVER (PARTITION BY side, label ORDER BY md5(CAST(frame AS VARCHAR)), frame) AS nth FROM w WHERE i = 1) WHERE nth = 1),
""" + _solved("m1", "SELECT a.bid AS pid, a.i, b.i AS j, a.x AS ax, a.y AS ay, b.x AS ox, b.y AS oy FROM w a JOIN head USING (side, label) JOIN w b ON b.side = head.side AND b.frame = head.frame") + """,
sh AS (SELECT side, label AS template, """ + ROLE_OF + """ AS i, avg(x) AS x, avg(y) AS y FROM w JOIN m1 ON bid = pid GROUP BY ALL),
""" + _solved("m2", "SELECT concat(a.bid, '|', b.template) AS pid, a.i, b.i AS j, a.x AS ax, a.y AS ay, b.x AS ox, b.y AS oy FROM w a JOIN sh b USING (side)", path=False) + """,
lc AS (SELECT side, frame, label, template, cost FROM (SELECT DISTINCT side, frame, label, bid FROM w) JOIN (SELECT DISTINCT side, template FROM sh) USING (side)
       JOIN m2 ON pid = concat(bid, '|', template))"""


def block_pairs(spark, sf_dir):
    _, costs = _label_costs(spark, sf_dir)
    return costs.select("side", "block_id", "template", r4("cost", "cost"))


BLOCK_PAIRS_SQL = _recursive("fx_roles", _LABEL_COSTS + "\nSELECT side, frame AS block_id, template, round(cost, 4) AS cost FROM lc")


def silhouette(spark, sf_dir):
    _, costs = _label_costs(spark, sf_dir)
    own = F.col("label") == F.col("template")
    near = costs.groupBy("side", "block_id").agg(F.min(F.when(own, F.col("cost"))).alias("own"), F.min(F.when(~own, F.col("cost"))).alias("near"))
    return near.select("side", "block_id", r6(fm.silhouette("own", "near"), "silhouette"))


SILHOUETTE_SQL = _recursive("fx_roles", _LABEL_COSTS + """,
s AS (SELECT side, frame, min(CASE WHEN label = template THEN cost END) AS own, min(CASE WHEN label <> template THEN cost END) AS near FROM lc GROUP BY ALL)
SELECT side, frame AS block_id, round(CASE WHEN near IS NOT NULL AND greatest(own, near) > 0 THEN (near - own) / greatest(own, near) ELSE 0 END, 6) AS silhouette FROM s""")


def _medoids(costs):
    own = costs.where("label = template")
    best = own.groupBy("side", "label").agg(F.min(F.struct("cost", "block_id")).alias("m"))
    return best.select("side", "label", F.col("m.block_id").alias("block_id"), F.col("m.cost").alias("member_cost"))


def medoid(spark, sf_dir):
    _, costs = _label_costs(spark, sf_dir)
    return _medoids(costs).select("side", "label", "block_id", r4("member_cost", "member_cost"))


_MEDOID = """,
med AS (SELECT side, label, frame, cost FROM (SELECT *, row_number() OVER (PARTITION BY side, label ORDER BY cost, frame) AS nth FROM lc WHERE label = template) WHERE nth = 1)"""
MEDOID_SQL = _recursive("fx_roles", _LABEL_COSTS + _MEDOID + "\nSELECT side, label, frame AS block_id, round(cost, 4) AS member_cost FROM med")


def _label_templates(spark, sf_dir):
    b, costs = _label_costs(spark, sf_dir)
    chosen = _medoids(costs).select("side", "block_id", F.lit(True).alias("_m"))
    clusters = b.join(chosen, ["side", "block_id"], "left").select("side", "block_id", F.col("label").alias("cluster_label"), F.col("_m").isNotNull().alias("is_medoid"))
    return fm.cluster_templates(b.drop("label"), stored(clusters), ["side"], ["block_id"])


def cluster_templates(spark, sf_dir):
    t = _label_templates(spark, sf_dir)
    return t.select("side", F.col("cluster_label").alias("label"), "role", "n_members", *[r4(c, c) for c in ("mu_x", "mu_y", "cov_xx", "cov_xy", "cov_yy")])


_TEMPLATES = _MEDOID + ",\n" + _solved("m3", "SELECT a.bid AS pid, a.i, b.i AS j, a.x AS ax, a.y AS ay, b.x AS ox, b.y AS oy FROM w a JOIN med USING (side, label) JOIN w b ON b.side = med.side AND b.frame = med.frame") + """,
al AS (SELECT side, label, """ + ROLE_OF + """ AS role, x, y FROM w JOIN m3 ON bid = pid),
ct AS (SELECT side, label, role, count(*) AS n_members, avg(x) AS mu_x, avg(y) AS mu_y, coalesce(var_samp(x), 0) + 0.000001 AS cov_xx,
              coalesce(covar_samp(x, y), 0) AS cov_xy, coalesce(var_samp(y), 0) + 0.000001 AS cov_yy FROM al GROUP BY side, label, role)"""
CLUSTER_TEMPLATES_SQL = _recursive("fx_roles", _LABEL_COSTS + _TEMPLATES + """
SELECT side, label, CAST(role AS INTEGER) AS role, n_members, round(mu_x, 4) + 0.0 AS mu_x, round(mu_y, 4) + 0.0 AS mu_y, round(cov_xx, 4) AS cov_xx,
       round(cov_xy, 4) + 0.0 AS cov_xy, round(cov_yy, 4) AS cov_yy FROM ct""")


def block_clusters(spark, sf_dir):
    out = fm.cluster_blocks(_blocks(spark, sf_dir), ["side"], ["block_id"])
    return out.select("side", "block_id", "cluster_label", "n_blocks_in_cluster", "is_medoid", r4("member_cost", "member_cost"), r6("silhouette", "silhouette"))


def named_templates(spark, sf_dir):
    t = _label_templates(spark, sf_dir)
    named = fm.named_templates(t.withColumn("phase", F.lit("mid-block")), ["side", "phase"], "phase")
    return named.select("side", "formation", "members", F.inline("roles")).select("side", "formation", "members", "role", *[r4(c, c) for c in ("x", "y", "xx", "xy", "yy")])


_FORMS = ", ".join(f"({i}, '{f}')" for i, f in enumerate(("4-2-3-1", "4-4-2", "4-1-4-1", "4-3-2-1", "5-3-2", "5-2-3")))
NAMED_SQL = _recursive("fx_roles", _LABEL_COSTS + _TEMPLATES + """,
tg AS (SELECT *, mu_y - lag(mu_y) OVER o AS gap, row_number() OVER o AS pos FROM ct WINDOW o AS (PARTITION BY side, label ORDER BY mu_y)),
tk AS (SELECT tg.*, k, row_number() OVER (PARTITION BY side, label, k ORDER BY gap DESC NULLS LAST, pos) < k AND gap IS NOT NULL AS cut FROM tg, (VALUES (3), (4), (5)) t(k)),
tl AS (SELECT *, sum(CAST(cut AS INT)) OVER (PARTITION BY side, label, k ORDER BY pos) AS line FROM tk),
tn AS (SELECT side, label, k, line, count(*) AS n FROM tl GROUP BY ALL),
tr AS (SELECT side, label, k, list(n ORDER BY line) AS counts, round(var_pop(n), 9) AS v FROM tn GROUP BY side, label, k),
tb AS (SELECT side, label, arg_min(counts, (v, k)) AS counts FROM tr GROUP BY side, label),
fm(pos, form) AS (VALUES """ + _FORMS + """),
td AS (SELECT tb.*, form, pos, CAST(string_split(form, '-') AS INT[]) AS f FROM tb, fm),
ts AS (SELECT *, 2 * abs(len(counts) - len(f)) + list_sum(list_transform(range(1, least(len(counts), len(f)) + 1), lambda k: abs(counts[k] - f[k]))) AS dist FROM td),
tf AS (SELECT side, label, arg_min(form, (dist, pos)) AS formation FROM ts GROUP BY side, label),
tm AS (SELECT side, label, max(n_members) AS members FROM ct GROUP BY side, label),
me AS (SELECT side, formation, role, avg(mu_x) AS x, avg(mu_y) AS y, avg(cov_xx) + 0.000001 AS xx, avg(cov_xy) AS xy, avg(cov_yy) + 0.000001 AS yy, sum(members) AS members
       FROM ct JOIN tf USING (side, label) JOIN tm USING (side, label) GROUP BY side, formation, role)
SELECT side, formation, CAST(members AS BIGINT) AS members, CAST(role AS INTEGER) AS role, round(x, 4) + 0.0 AS x, round(y, 4) + 0.0 AS y, round(xx, 4) AS xx,
       round(xy, 4) + 0.0 AS xy, round(yy, 4) AS yy FROM me""")


def _templates(blocks):
    """Mean shape of each label as the templates of a side."""
    long = blocks.select("side", "label", F.posexplode("pts").alias("role", "p"))
    mean = long.groupBy("side", "label", (F.col("role") + 1).alias("role")).agg(
        F.avg("p.x").alias("x"), F.avg("p.y").alias("y"), F.var_samp("p.x").alias("xx"), F.covar_samp("p.x", "p.y").alias("xy"),
        F.var_samp("p.y").alias("yy"), F.count(F.lit(1)).alias("members"),
    )
    return mean.groupBy("side", F.concat(F.lit("t"), F.col("label").cast("string")).alias("formation")).agg(
        F.array_sort(F.collect_list(F.struct("role", "x", "y", "xx", "xy", "yy"))).alias("roles"), F.max("members").alias("members")
    )


def _matches(spark, sf_dir):
    b = v.role_points(spark, sf_dir, ROLES)
    return b, stored(fm.match_templates(b, _templates(b), ["side"], ["frame"]))


def template_match(spark, sf_dir):
    _, m = _matches(spark, sf_dir)
    return m.select("side", "frame", "formation", "mirrored", r4("w2_cost", "w2_cost"), r4("w2_margin", "w2_margin"), "members")


_MATCH = """WITH """ + WIDE_SQL + """,
t AS (SELECT side, concat('t', label) AS form, i, avg(x) AS x, avg(y) AS y, count(*) AS members,
             1 + var_samp(x) + var_samp(y) - sqrt(2) * sqrt(var_samp(x) + var_samp(y) + 2 * sqrt(greatest(var_samp(x) * var_samp(y) - pow(covar_samp(x, y), 2), 0))) AS k
      FROM w GROUP BY side, label, i),
mi AS (SELECT 0 AS mirrored, CAST(1 AS DOUBLE) AS s UNION ALL SELECT 1, -1),
""" + _solved("mm", "SELECT concat(a.bid, '|', form, '|', mirrored) AS pid, a.i, t.i AS j, s * a.x AS ax, a.y AS ay, t.x AS ox, t.y AS oy, t.k AS k FROM w a JOIN t USING (side), mi", "k", path=False) + """,
cs AS (SELECT ids.side, frame, form, CAST(mirrored AS INTEGER) AS mirrored, members, cost
       FROM (SELECT side, frame, bid FROM w WHERE i = 1) ids JOIN (SELECT side, form, max(members) AS members FROM t GROUP BY ALL) USING (side), mi, mm
       WHERE mm.pid = concat(ids.bid, '|', form, '|', mirrored)),
rk AS (SELECT *, row_number() OVER (PARTITION BY side, frame ORDER BY cost, mirrored, form) AS nth FROM cs),
mt AS (SELECT a.side, a.frame, a.form AS formation, a.mirrored, a.cost AS w2_cost, b.cost - a.cost AS w2_margin, a.members
       FROM rk a JOIN rk b ON a.side = b.side AND a.frame = b.frame AND a.nth = 1 AND b.nth = 2)"""
TEMPLATE_MATCH_SQL = _recursive("fx_roles", _MATCH + """
SELECT side, frame, formation, mirrored, round(w2_cost, 4) AS w2_cost, round(w2_margin, 4) AS w2_margin, members FROM mt""")


def robust_gates(spark, sf_dir):
    _, m = _matches(spark, sf_dir)
    return fm.robust_gates(m, ["side"]).select("side", r4("cost_limit", "cost_limit"), r4("margin_limit", "margin_limit"))


_GATES = """,
md AS (SELECT side, median(w2_cost) AS med, greatest(quantile_cont(w2_margin, 0.1), 50) AS margin_limit FROM mt GROUP BY side),
mad AS (SELECT mt.side, median(abs(w2_cost - med)) * 1.4826 AS mad FROM mt JOIN md USING (side) GROUP BY mt.side),
gt AS (SELECT md.side, least(CASE WHEN mad > 0 THEN med + 3 * mad ELSE med * 2.5 END, 1500) AS cost_limit, margin_limit FROM md JOIN mad USING (side))"""
ROBUST_GATES_SQL = _recursive("fx_roles", _MATCH + _GATES + """
SELECT side, round(cost_limit, 4) AS cost_limit, round(margin_limit, 4) AS margin_limit FROM gt""")


def formation_predict(spark, sf_dir):
    b, m = _matches(spark, sf_dir)
    sizes = b.groupBy("side", "label").agg(F.count(F.lit(1)).cast("int").alias("n_blocks_in_cluster"))
    clusters = b.join(sizes, ["side", "label"]).select("side", "frame", F.col("label").cast("int").alias("cluster_label"), "n_blocks_in_cluster")
    label = F.when(F.col("frame") % 3 == 0, "4-4-2").when(F.col("frame") % 3 == 1, "4-3-3").otherwise("3-5-2")
    fallback = b.select("side", "frame", F.when(F.col("frame") % 4 != 0, label).alias("label"), F.when(F.col("frame") % 4 != 0, F.col("frame") % 100 / 100).alias("confidence"))
    out = fm.predict_formations(b.select("side", "frame"), m, fm.robust_gates(m, ["side"]), ["side"], ["frame"], clusters, fallback)
    return out.select("side", "frame", "predicted_formation", "method", r4("w2_cost", "w2_cost"), r4("w2_margin", "w2_margin"), "cluster_label", "n_blocks_in_cluster", "chosen_template_size")


FORMATION_PREDICT_SQL = _recursive("fx_roles", _MATCH + _GATES + """,
sz AS (SELECT side, frame, label, count(*) OVER (PARTITION BY side, label) AS n FROM w WHERE i = 1),
ok AS (SELECT mt.*, sz.label, n, w2_cost <= cost_limit AND w2_margin >= margin_limit AS ok,
              CASE WHEN frame % 4 <> 0 THEN CASE frame % 3 WHEN 0 THEN '4-4-2' WHEN 1 THEN '4-3-3' ELSE '3-5-2' END END AS guess,
              CASE WHEN frame % 4 <> 0 THEN frame % 100 / 100 ELSE 0 END AS conf
       FROM mt JOIN gt USING (side) JOIN sz USING (side, frame))
SELECT side, frame, CASE WHEN ok THEN formation ELSE coalesce(guess, 'unknown') END AS predicted_formation,
       CASE WHEN ok THEN 'w2_hungarian_template' ELSE printf('resnet_fallback_conf_%.3f', conf) END AS method,
       round(w2_cost, 4) AS w2_cost, round(w2_margin, 4) AS w2_margin, CAST(label AS INTEGER) AS cluster_label, CAST(n AS INTEGER) AS n_blocks_in_cluster,
       CAST(CASE WHEN ok THEN members ELSE n END AS INTEGER) AS chosen_template_size FROM ok""")


QUERIES = {
    "assignment_cost": (assignment_cost, ASSIGNMENT_SQL),
    "block_pairs": (block_pairs, BLOCK_PAIRS_SQL),
    "silhouette": (silhouette, SILHOUETTE_SQL),
    "medoid": (medoid, MEDOID_SQL),
    "cluster_templates": (cluster_templates, CLUSTER_TEMPLATES_SQL),
    "block_clusters": (block_clusters, None),  # rounds until no block moves; held against a plain version
    "named_templates": (named_templates, NAMED_SQL),
    "template_match": (template_match, TEMPLATE_MATCH_SQL),
    "robust_gates": (robust_gates, ROBUST_GATES_SQL),
    "formation_predict": (formation_predict, FORMATION_PREDICT_SQL),
}
