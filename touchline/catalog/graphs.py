"""Queries over passing graphs, match-up labels, the knowledge graph and recommendations."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.catalog import views as v
from touchline.catalog.frames import r6
from touchline.catalog.views import with_views
from touchline.operators import knowledge as kg
from touchline.operators import metrics, panels
from touchline.operators import passgraph as pg
from touchline.operators import recommend as rc
from touchline.session import stored

TEAM = ["team_id"]
CTX = pg.CONTEXT
CTX_SQL = "provider, our_side, opponent_form, opponent_phase"
METRICS = ("ppda", "ppda_press", "press_rate", "avg_press", "width", "depth", "possession_pct", "xt", "strength")

P_SQL = "p AS (" + " UNION ALL ".join(
    f"SELECT provider, pairs, '{us}' AS our_side, {them}_form AS opponent_form, phase_{them} AS opponent_phase, {us}_form AS our_form, phase_{us} AS our_phase, "
    + ", ".join(f"{us}_{m} AS our_{m}, {them}_{m} AS opp_{m}" for m in METRICS) + f" FROM fx_fvf WHERE {them}_form IS NOT NULL AND phase_{them} IS NOT NULL"
    for us, them in (("home", "away"), ("away", "home"))
) + ")"


def _fvf(spark, sf_dir):
    """The match-up table, stored once because the query reads it several times."""
    return stored(v.fvf(spark, sf_dir))


def _slice(spark, sf_dir):
    return v.passes(spark, sf_dir).where("receiver IS NOT NULL")


def slice_passes(spark, sf_dir):
    p = v.passes(spark, sf_dir).withColumn("original_event", F.when(F.col("passer") == F.col("receiver"), "Carry").otherwise("PASS")).withColumn("match_id", F.lit("m0"))
    out = pg.slice_passes(p)
    return out.groupBy("team_id", "passer").agg(F.count(F.lit(1)).alias("n"))


SLICE_SQL = with_views("fx_passes", "SELECT team_id, passer, count(*) AS n FROM fx_passes WHERE receiver IS NOT NULL AND passer <> receiver GROUP BY ALL")


def modal_team(spark, sf_dir):
    return pg.modal_team(_slice(spark, sf_dir), ["passer"])


MODAL_TEAM_SQL = with_views("fx_passes", """
SELECT passer, team_id FROM (SELECT passer, team_id, row_number() OVER (PARTITION BY passer ORDER BY count(*) DESC, team_id) AS nth
FROM fx_passes WHERE receiver IS NOT NULL GROUP BY passer, team_id) WHERE nth = 1""")


def pass_nodes(spark, sf_dir):
    out = pg.pass_nodes(_slice(spark, sf_dir), TEAM)
    return out.select("team_id", "player", "made", "received", *[r6(c, c) for c in ("success_rate", "mean_x", "mean_y", "mean_length")])


_NODES = """
k AS (SELECT * FROM fx_passes WHERE receiver IS NOT NULL),
t AS (SELECT team_id, passer AS player, 1 AS made, CAST(success AS DOUBLE) AS ok, x AS tx, y AS ty, sqrt(pow(x2 - x, 2) + pow(y2 - y, 2)) AS len FROM k
      UNION ALL SELECT team_id, receiver, 0, 0, x2, y2, NULL FROM k),
nd AS (SELECT team_id, player, CAST(sum(made) AS BIGINT) AS made, CAST(sum(1 - made) AS BIGINT) AS received, sum(ok) / greatest(1, sum(made)) AS success_rate,
              avg(tx) AS mean_x, avg(ty) AS mean_y, coalesce(sum(len), 0) / greatest(1, sum(made)) / 105 AS mean_length FROM t GROUP BY ALL),
ed AS (SELECT k.team_id, passer, receiver, count(*) AS n, count(*) / any_value(total) AS share, avg(CAST(success AS DOUBLE)) AS success_rate,
              sqrt(pow(avg(x2 - x), 2) + pow(avg(y2 - y), 2)) / 105 AS mean_length
       FROM k JOIN (SELECT team_id, CAST(count(*) AS DOUBLE) AS total FROM k GROUP BY team_id) USING (team_id) GROUP BY ALL)
"""
NODES_SQL = with_views("fx_passes", "WITH " + _NODES + """
SELECT team_id, player, made, received, round(success_rate, 6) AS success_rate, round(mean_x, 6) AS mean_x, round(mean_y, 6) AS mean_y, round(mean_length, 6) AS mean_length FROM nd""")


def pass_edges(spark, sf_dir):
    out = pg.pass_edges(_slice(spark, sf_dir), TEAM)
    return out.select("team_id", "passer", "receiver", "n", *[r6(c, c) for c in ("share", "success_rate", "mean_length")])


EDGES_SQL = with_views("fx_passes", "WITH " + _NODES + """
SELECT team_id, passer, receiver, n, round(share, 6) AS share, round(success_rate, 6) AS success_rate, round(mean_length, 6) AS mean_length FROM ed""")


def graph_summary(spark, sf_dir):
    p = _slice(spark, sf_dir)
    return pg.graph_summary(pg.pass_nodes(p, TEAM), pg.pass_edges(p, TEAM), TEAM)


SUMMARY_SQL = with_views("fx_passes", "WITH " + _NODES + """
SELECT count(*) AS num_graphs, avg(n) AS avg_nodes, avg(e) AS avg_edges FROM (SELECT team_id, count(*) AS n FROM nd GROUP BY 1) JOIN (SELECT team_id, count(*) AS e FROM ed GROUP BY 1) USING (team_id)""")


def graph_pack(spark, sf_dir):
    p = _slice(spark, sf_dir)
    g = pg.graph_pack(pg.pass_nodes(p, TEAM), pg.pass_edges(p, TEAM), TEAM)
    text = lambda c, f: F.array_join(F.transform(c, f), ",")
    return g.select(
        "team_id",
        text("nodes", lambda n: F.concat_ws(":", n["player"].cast("string"), n["made"].cast("string"))).alias("nodes"),
        text("edges", lambda e: F.concat_ws(">", e["source"].cast("string"), e["target"].cast("string"))).alias("edges"),
    )


PACK_SQL = with_views("fx_passes", "WITH " + _NODES + """,
i AS (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY player) - 1 AS at FROM nd),
e AS (SELECT ed.team_id, string_agg(concat(u.at, '>', w.at), ',' ORDER BY passer, receiver) AS edges FROM ed
      JOIN i u ON u.team_id = ed.team_id AND u.player = passer JOIN i w ON w.team_id = ed.team_id AND w.player = receiver GROUP BY ed.team_id)
SELECT team_id, string_agg(concat(player, ':', made), ',' ORDER BY player) AS nodes, any_value(e.edges) AS edges FROM i JOIN e USING (team_id) GROUP BY team_id""")


def wing_bias(spark, sf_dir):
    p = v.passes(spark, sf_dir).where("receiver IS NOT NULL")
    by = ["team_id", "lane"]
    p = p.withColumn("lane", F.floor(F.col("x") / 21).cast("long")).withColumns({"y": F.col("y") - 20, "y2": F.col("y2") - 48})
    nodes = pg.pass_nodes(p, by)
    return pg.wing_bias(pg.pass_edges(p, by), nodes, by).select(*by, r6("use_left", "use_left"), r6("use_right", "use_right"), "bias")


WING_SQL = with_views("fx_passes", """
WITH k AS (SELECT team_id, CAST(floor(x / 21) AS BIGINT) AS lane, passer, receiver, y - 20 AS y, y2 - 48 AS y2 FROM fx_passes WHERE receiver IS NOT NULL),
n AS (SELECT team_id, lane, player, avg(y) AS y FROM (SELECT team_id, lane, passer AS player, y FROM k UNION ALL SELECT team_id, lane, receiver, y2 FROM k) GROUP BY ALL),
e AS (SELECT team_id, lane, passer, receiver, count(*) AS c FROM k GROUP BY ALL),
w AS (SELECT e.*, c / sum(c) OVER (PARTITION BY team_id, lane) AS share FROM e),
u AS (SELECT w.team_id, w.lane, sum(CASE WHEN a.y < 0 OR b.y < 0 THEN share ELSE 0 END) AS use_left, sum(CASE WHEN a.y > 0 OR b.y > 0 THEN share ELSE 0 END) AS use_right
      FROM w JOIN n a ON a.team_id = w.team_id AND a.lane = w.lane AND a.player = passer JOIN n b ON b.team_id = w.team_id AND b.lane = w.lane AND b.player = receiver GROUP BY ALL)
SELECT team_id, lane, round(use_left, 6) AS use_left, round(use_right, 6) AS use_right,
       CASE WHEN use_left > 1.2 * (use_right + 0.000001) THEN 'left_bias' WHEN use_right > 1.2 * (use_left + 0.000001) THEN 'right_bias' END AS bias FROM u""")


def fvf_perspectives(spark, sf_dir):
    out = pg.perspectives(v.fvf(spark, sf_dir), ("strength", "ppda"))
    return out.select(*CTX, "our_form", "our_phase", "pairs", *[r6(f"{w}_{m}", f"{w}_{m}") for w in ("our", "opp") for m in ("strength", "ppda")]).withColumn("our_phase", F.coalesce("our_phase", F.lit("")))


PERSPECTIVES_SQL = with_views("fx_fvf", "WITH " + P_SQL + f"""
SELECT {CTX_SQL}, our_form, coalesce(our_phase, '') AS our_phase, pairs, round(our_strength, 6) AS our_strength, round(opp_strength, 6) AS opp_strength,
       round(our_ppda, 6) AS our_ppda, round(opp_ppda, 6) AS opp_ppda FROM p""")

_BEST = "WITH " + P_SQL + f""",
mp AS (SELECT {CTX_SQL}, our_form, avg(our_strength) AS s FROM p GROUP BY ALL),
bp AS (SELECT {CTX_SQL}, our_form AS best_form, s AS best_strength FROM (SELECT *, row_number() OVER (PARTITION BY {CTX_SQL} ORDER BY s DESC, our_form) AS nth FROM mp) WHERE nth = 1),
mg AS (SELECT our_side, opponent_form, opponent_phase, our_form, avg(our_strength) AS s FROM p GROUP BY ALL),
bg AS (SELECT our_side, opponent_form, opponent_phase, our_form AS best_form, s AS best_strength
       FROM (SELECT *, row_number() OVER (PARTITION BY our_side, opponent_form, opponent_phase ORDER BY s DESC, our_form) AS nth FROM mg) WHERE nth = 1),
ids AS (SELECT form, CAST(row_number() OVER (ORDER BY form) - 1 AS INTEGER) AS form_id FROM (SELECT best_form AS form FROM bp UNION SELECT best_form FROM bg))
"""


def _best(spark, sf_dir):
    return pg.best_counters(pg.perspectives(_fvf(spark, sf_dir)))


def best_counter(spark, sf_dir):
    best, overall = _best(spark, sf_dir)
    both = best.unionByName(overall.withColumn("provider", F.lit("any")))
    return both.withColumn("best_strength", r6("best_strength"))


BEST_SQL = with_views("fx_fvf", _BEST + f"SELECT {CTX_SQL}, best_form, round(best_strength, 6) AS best_strength FROM bp UNION ALL SELECT 'any', our_side, opponent_form, opponent_phase, best_form, round(best_strength, 6) FROM bg")


def form_ids(spark, sf_dir):
    return pg.form_ids(*_best(spark, sf_dir))


FORM_IDS_SQL = with_views("fx_fvf", _BEST + "SELECT form, form_id FROM ids")


def slice_labels(spark, sf_dir):
    rows = pg.perspectives(_fvf(spark, sf_dir))
    best, overall = pg.best_counters(rows)
    ids = pg.form_ids(best, overall)
    out = pg.slice_labels(rows, best, overall, ids)
    return out.groupBy(*CTX, "label_form", "label_id").agg(F.count(F.lit(1)).alias("n"))


SLICE_LABELS_SQL = with_views("fx_fvf", _BEST + f""",
lb AS (SELECT p.provider, p.our_side, p.opponent_form, p.opponent_phase, coalesce(bp.best_form, bg.best_form, (SELECT min(form) FROM ids)) AS label_form
FROM p LEFT JOIN bp ON bp.provider = p.provider AND bp.our_side = p.our_side AND bp.opponent_form = p.opponent_form AND bp.opponent_phase = p.opponent_phase
LEFT JOIN bg ON bg.our_side = p.our_side AND bg.opponent_form = p.opponent_form AND bg.opponent_phase = p.opponent_phase)
SELECT {CTX_SQL}, label_form, form_id AS label_id, count(*) AS n FROM lb JOIN ids ON form = label_form GROUP BY ALL""")


def kg_counters_edges(spark, sf_dir):
    return kg.counters_edges(v.fvf(spark, sf_dir)).withColumn("support", r6("support"))


_COUNTERS = "WITH " + P_SQL + """,
ce AS (SELECT provider, our_form AS candidate, opponent_form AS opponent, replace(lower(trim(opponent_phase)), ' ', '-') AS phase, sum(coalesce(our_strength, 0)) AS support
       FROM p WHERE our_form IS NOT NULL GROUP BY ALL)
"""
COUNTERS_SQL = with_views("fx_fvf", _COUNTERS + "SELECT provider, candidate, opponent, phase, round(support, 6) AS support FROM ce")


def kg_nodes(spark, sf_dir):
    counters = kg.counters_edges(_fvf(spark, sf_dir))
    old = kg.counters_nodes(counters)
    seen = counters.groupBy(F.col("candidate").alias("key")).agg(F.count(F.lit(1)).cast("string").alias("n"), F.min("phase").alias("phase"))
    first = seen.select(F.lit("Formation").alias("kind"), "key", F.create_map(F.lit("edges"), "n", F.lit("phase"), F.lit("old")).alias("props"), F.lit("1").alias("at"))
    second = seen.select(F.lit("Formation").alias("kind"), "key", F.create_map(F.lit("phase"), "phase").alias("props"), F.lit("2").alias("at"))
    nodes = kg.upsert_nodes(old, first.unionByName(second), "at")
    props = F.array_join(F.transform(F.array_sort(F.map_entries("props")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return nodes.select("kind", "key", props.alias("props"))


NODES_KG_SQL = with_views("fx_fvf", _COUNTERS + """,
nk AS (SELECT 'Formation' AS kind, candidate AS key FROM ce UNION SELECT 'Formation', opponent FROM ce UNION SELECT 'Phase', phase FROM ce),
sn AS (SELECT candidate AS key, count(*) AS n, min(phase) AS phase FROM ce GROUP BY 1)
SELECT kind, nk.key, CASE WHEN kind = 'Formation' AND n IS NOT NULL THEN concat('edges=', n, ';phase=', phase) ELSE '' END AS props
FROM nk LEFT JOIN sn ON sn.key = nk.key AND kind = 'Formation'""")


def kg_edge_upsert(spark, sf_dir):
    edges = kg.as_edges(kg.counters_edges(_fvf(spark, sf_dir)))
    old = edges.where("provider = 'sportec'")
    out = kg.upsert_edges(old, edges)
    return out.select("src_key", "rel", "dst_key", "phase", "provider", r6("support", "support"))


EDGE_UPSERT_SQL = with_views("fx_fvf", _COUNTERS + """,
al AS (SELECT *, 0 AS late FROM ce WHERE provider = 'sportec' UNION ALL SELECT *, 1 FROM ce)
SELECT candidate AS src_key, 'COUNTERS' AS rel, opponent AS dst_key, phase, arg_min(provider, concat(late, provider)) AS provider, round(sum(support), 6) AS support
FROM al GROUP BY candidate, opponent, phase""")


def _recos(spark, sf_dir):
    """Recommendation rows with tags and evidence as JSON text, from the match-up table."""
    f = v.fvf(spark, sf_dir)
    tags = rc.style_tags("home_", columns=f.columns)
    topk = F.array(F.struct(F.col("home_form").alias("formation"), F.round("home_strength", 6).alias("score")), F.struct(F.col("away_form").alias("formation"), F.round("away_strength", 6).alias("score")))
    prior = F.array(F.struct(F.col("away_form").alias("candidate_form"), F.round("home_xt", 6).alias("support")))
    evidence = F.struct(F.struct(prior.alias("kg_prior"), tags.alias("style_tags_opponent")).alias("contributions"), F.struct(topk.alias("topk")).alias("fusion"))
    rows = f.where("phase_away IS NOT NULL").select(
        "provider", F.col("home_form").alias("opponent_form"), F.col("phase_away").alias("opponent_phase"), F.col("away_form").alias("our_form"),
        F.when(F.col("phase_home") == "mid-block", "home").otherwise("away").alias("our_side"), "phase_home",
        F.to_json(tags).alias("style_tags"), F.to_json(evidence).alias("evidence"), F.col("pairs").alias("created_at"),
    )
    return rows


_TAGS_SQL = """
tg AS (SELECT *, list_sort(list_filter([
  CASE WHEN home_ppda <= 7 THEN 'high_pressing' END, CASE WHEN home_ppda >= 12 THEN 'low_pressing' END, CASE WHEN home_press_rate >= 0.33 THEN 'press_triggers_often' END,
  CASE WHEN home_avg_press >= 55 THEN 'physically_intense_press' END,
  CASE WHEN home_ppda <= 7 AND home_press_rate >= 0.33 THEN 'high_block' WHEN home_ppda >= 12 THEN 'low_block' ELSE 'mid_block' END,
  CASE WHEN home_width >= 38 THEN 'wide_overloads' END, CASE WHEN home_width <= 28 AND home_depth <= 30 THEN 'compact_block' END,
  CASE WHEN home_depth >= 40 THEN 'vertical_stretch' END, CASE WHEN home_possession_pct <= 44 THEN 'counter_attacking' END,
  CASE WHEN home_possession_pct >= 56 THEN 'possession_play' END, CASE WHEN home_xt >= 0.25 THEN 'halfspace_threat' END], lambda x: x IS NOT NULL)) AS tags FROM fx_fvf)
"""


def style_tags(spark, sf_dir):
    f = v.fvf(spark, sf_dir)
    tags = rc.style_tags("home_", columns=f.columns)
    return f.select("provider", "phase_home", F.coalesce("phase_away", F.lit("")).alias("phase_away"), "home_form", "away_form", F.array_join(tags, ",").alias("tags"))


STYLE_SQL = with_views("fx_fvf", "WITH " + _TAGS_SQL + """
SELECT provider, phase_home, coalesce(phase_away, '') AS phase_away, home_form, away_form, array_to_string(tags, ',') AS tags FROM tg""")


def kg_exhibits(spark, sf_dir):
    edges = kg.exhibits_edges(_recos(spark, sf_dir))
    return edges.groupBy("src_key", "dst_key").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"), F.max("created_at").alias("last"))


EXHIBITS_SQL = with_views("fx_fvf", "WITH " + _TAGS_SQL + """
SELECT concat(home_form, '|', replace(lower(trim(phase_away)), ' ', '-')) AS src_key, tag AS dst_key, count(*) AS n, CAST(count(*) AS DOUBLE) AS weight, max(pairs) AS last
FROM (SELECT *, unnest(tags) AS tag FROM tg WHERE phase_away IS NOT NULL) GROUP BY ALL""")


def latest_reco(spark, sf_dir):
    recos = _recos(spark, sf_dir).withColumn("tie", F.concat_ws("|", "opponent_form", "opponent_phase", "our_form", "phase_home"))
    out = panels.latest_per_key(recos, ["provider", "our_side"], "created_at", "tie")
    return out.select("provider", "our_side", "opponent_form", "opponent_phase", "created_at", F.array_join(F.from_json("style_tags", "array<string>"), ",").alias("tags"))


LATEST_SQL = with_views("fx_fvf", "WITH " + _TAGS_SQL + """,
r AS (SELECT *, CASE WHEN phase_home = 'mid-block' THEN 'home' ELSE 'away' END AS our_side FROM tg WHERE phase_away IS NOT NULL)
SELECT provider, our_side, home_form AS opponent_form, phase_away AS opponent_phase, pairs AS created_at, array_to_string(tags, ',') AS tags
FROM (SELECT *, row_number() OVER (PARTITION BY provider, our_side ORDER BY pairs DESC, concat_ws('|', home_form, phase_away, away_form, phase_home)) AS nth FROM r) WHERE nth = 1""")


def reco_evidence_rows(spark, sf_dir):
    key = ["provider", "our_side", "opponent_form", "opponent_phase", "our_form", "phase_home"]
    return rc.evidence_rows(_recos(spark, sf_dir), key)


EVIDENCE_SQL = with_views("fx_fvf", "WITH " + _TAGS_SQL + """,
r AS (SELECT provider, CASE WHEN phase_home = 'mid-block' THEN 'home' ELSE 'away' END AS our_side, home_form AS opponent_form, phase_away AS opponent_phase, away_form AS our_form,
             phase_home, home_strength, away_strength, home_xt, tags FROM tg WHERE phase_away IS NOT NULL)
SELECT provider, our_side, opponent_form, opponent_phase, our_form, phase_home, 'prior' AS section, our_form AS name, round(home_xt, 6) AS value FROM r
UNION ALL SELECT provider, our_side, opponent_form, opponent_phase, our_form, phase_home, 'fused', opponent_form, round(home_strength, 6) FROM r
UNION ALL SELECT provider, our_side, opponent_form, opponent_phase, our_form, phase_home, 'fused', our_form, round(away_strength, 6) FROM r
UNION ALL SELECT provider, our_side, opponent_form, opponent_phase, our_form, phase_home, 'opponent_tag', unnest(tags), NULL FROM r""")


def _contexts(fvf):
    return pg.perspectives(fvf).select(*CTX).distinct()


_KG_PRIOR = """,
cx AS (SELECT DISTINCT provider, our_side, opponent_form, opponent_phase FROM p),
kj AS (SELECT cx.*, candidate, support, ce.provider AS edge_provider, ce.phase AS edge_phase,
         CASE WHEN ce.phase = replace(replace(lower(trim(opponent_phase)), ' ', '-'), '_', '-') AND ce.provider = cx.provider THEN 1
              WHEN ce.phase = replace(replace(lower(trim(opponent_phase)), ' ', '-'), '_', '-') THEN 2 WHEN ce.provider = cx.provider THEN 3 ELSE 4 END AS tier
       FROM cx JOIN ce ON ce.opponent = cx.opponent_form),
kt AS (SELECT *, min(tier) OVER (PARTITION BY provider, our_side, opponent_form, opponent_phase) AS low FROM kj),
ko AS (SELECT *, row_number() OVER (PARTITION BY provider, our_side, opponent_form, opponent_phase
         ORDER BY CASE WHEN edge_provider = provider THEN 0 ELSE 2 END, support DESC, candidate, edge_provider, edge_phase) AS position FROM kt WHERE tier = low),
ks AS (SELECT provider, our_side, opponent_form, opponent_phase, candidate, sum(greatest(support, 0)) AS support, max(tier) AS tier FROM ko WHERE position <= 12 GROUP BY ALL),
kp AS (SELECT *, CASE WHEN sum(support) OVER w <= 1e-12 THEN 1.0 / count(*) OVER w ELSE support / sum(support) OVER w END AS prior
       FROM ks WINDOW w AS (PARTITION BY provider, our_side, opponent_form, opponent_phase))
"""


def kg_prior(spark, sf_dir):
    f = _fvf(spark, sf_dir)
    out = kg.kg_prior(_contexts(f), kg.counters_edges(f), CTX)
    return out.select(*CTX, "candidate", "tier", r6("support", "support"), r6("prior", "prior"))


KG_PRIOR_SQL = with_views("fx_fvf", _COUNTERS + _KG_PRIOR + f"SELECT {CTX_SQL}, candidate, tier, round(support, 6) AS support, round(prior, 6) AS prior FROM kp")


def kg_layout(spark, sf_dir):
    f = _fvf(spark, sf_dir)
    options = kg.counter_options(_contexts(f), kg.counters_edges(f), CTX, any_phase=False)
    out = kg.counters_layout(options, CTX)
    return out.select(*CTX, "candidate", "place", r6("x", "x"), r6("y", "y"), r6("width", "width"))


LAYOUT_SQL = with_views("fx_fvf", _COUNTERS + _KG_PRIOR + f""",
lo AS (SELECT {CTX_SQL}, candidate, min(position) AS first, max(support) AS support FROM ko WHERE position <= 12 AND tier <= 2 GROUP BY ALL),
ln AS (SELECT *, row_number() OVER (PARTITION BY {CTX_SQL} ORDER BY first) - 1 AS place FROM lo),
lc AS (SELECT *, count(*) OVER (PARTITION BY {CTX_SQL}) AS c FROM ln WHERE place < 10)
SELECT {CTX_SQL}, candidate, CAST(place AS INTEGER) AS place, round(cos(2 * pi() * place / c), 6) + 0.0 AS x, round(sin(2 * pi() * place / c), 6) + 0.0 AS y,
       round(greatest(1, ln(1 + support)), 6) AS width FROM lc""")


def top_context(spark, sf_dir):
    return rc.top_context(v.fvf(spark, sf_dir))


TOP_SQL = with_views("fx_fvf", "WITH " + P_SQL + """
SELECT provider, our_side, opponent_form, opponent_phase, pairs
FROM (SELECT *, row_number() OVER (PARTITION BY provider, our_side ORDER BY pairs DESC, opponent_form, opponent_phase) AS nth FROM p) WHERE nth = 1""")


def context_metrics(spark, sf_dir):
    out = rc.context_metrics(v.fvf(spark, sf_dir))
    return out.select(*CTX, *[r6(f"{w}_{m}", f"{w}_{m}") for w in ("opp", "our") for m in rc.STYLE_METRICS])


CONTEXT_SQL = with_views("fx_fvf", "WITH " + P_SQL + f"SELECT {CTX_SQL}, " + ", ".join(f"round(avg({w}_{m}), 6) AS {w}_{m}" for w in ("opp", "our") for m in rc.STYLE_METRICS) + " FROM p GROUP BY ALL")


def _scores(f, ids):
    """Model scores per context and class, derived from mean pairs so that every context differs."""
    ctx = pg.perspectives(f).groupBy(*CTX).agg(F.sum("pairs").alias("_n"))
    vocabulary = ids.agg(F.array_sort(F.collect_list(F.struct("form_id", "form"))).alias("v"))
    listed = ctx.withColumn("_v", vocabulary.scalar()).select(*CTX, "_n", F.inline("_v"))
    return listed.select(*CTX, "form", ((F.col("_n") * (F.col("form_id") + 3)) % 17 / 10.0).alias("score"))


_SCORES = f"""
sx AS (SELECT {CTX_SQL}, CAST(sum(pairs) AS BIGINT) AS n FROM p GROUP BY ALL),
so AS (SELECT sx.*, form, form_id, CAST((n * (form_id + 3)) % 17 AS DOUBLE) / 10 AS score FROM sx CROSS JOIN ids),
se AS (SELECT DISTINCT {CTX_SQL}, our_form AS form FROM p WHERE pairs >= 5 AND our_form IS NOT NULL),
sl AS (SELECT so.*, se.form IS NOT NULL AS seen, count(se.form) OVER w AS n_seen, row_number() OVER (PARTITION BY {", ".join("so." + c for c in CTX)} ORDER BY score DESC, form_id DESC) AS rk
       FROM so LEFT JOIN se ON {" AND ".join(f"so.{c} = se.{c}" for c in [*CTX, "form"])} WINDOW w AS (PARTITION BY {", ".join("so." + c for c in CTX)})),
sf AS (SELECT *, seen OR n_seen = 0 AS own, NOT (seen OR n_seen = 0) AND rk <= 6 AS fill FROM sl),
sg AS (SELECT *, sum(CAST(own AS INT)) OVER (PARTITION BY {CTX_SQL}) AS kept, sum(CAST(fill AS INT)) OVER (PARTITION BY {CTX_SQL} ORDER BY rk) AS nth FROM sf),
cf AS (SELECT {CTX_SQL}, form, score, row_number() OVER (PARTITION BY {CTX_SQL} ORDER BY CASE WHEN own THEN 0 ELSE 1 END, CASE WHEN own THEN form_id ELSE rk END) AS position
       FROM sg WHERE own OR (fill AND kept + nth <= 4))
"""


def candidate_forms(spark, sf_dir):
    f = _fvf(spark, sf_dir)
    ids = pg.form_ids(*pg.best_counters(pg.perspectives(f)))
    return rc.candidate_forms(f, _contexts(f), ids, _scores(f, ids)).select(*CTX, "form", "position")


CANDIDATES_SQL = with_views("fx_fvf", _BEST + "," + _SCORES + f"SELECT {CTX_SQL}, form, CAST(position AS INTEGER) AS position FROM cf")


def _tags_frame(f):
    m = rc.context_metrics(f)
    return m.select(*CTX, rc.style_tags("opp_", columns=m.columns).alias("tags"))


def matchup_prior(spark, sf_dir):
    f = _fvf(spark, sf_dir)
    candidates = pg.perspectives(f).select(*CTX, F.col("our_form").alias("form")).where("form IS NOT NULL")
    out = rc.matchup_prior(f, candidates, _tags_frame(f))
    return out.select(*CTX, "strategy", "form", r6("pairs_w", "pairs_w"), r6("composite", "composite"), r6("prior", "prior"))


def _matchup_sql(where: str) -> str:
    cols = ["pairs", "xt", "ppda", "ppda_press", "press_rate", "avg_press", "width", "depth"]
    z = lambda c: f"greatest(0, least(1, (m.{c} - lo_{c}) / (CASE WHEN hi_{c} = lo_{c} THEN 1 ELSE hi_{c} - lo_{c} END)))"
    weights = "(VALUES ('attack', 0.35, 0.35, 0.10, 0.05, 0.05, 0.05), ('defense', 0.25, 0.10, 0.30, 0.15, 0.15, 0.05)) AS wt(strategy, w_s, w_x, w_p, w_q, w_r, w_a)"
    return f""",
zm AS (SELECT {CTX_SQL}, our_form AS form, avg(pairs) AS pairs, avg(our_strength) AS strength, {", ".join(f"avg(our_{c}) AS {c}" for c in cols if c != "pairs")} FROM p GROUP BY ALL),
zk AS (SELECT * FROM zm WHERE {where}),
zb AS (SELECT {CTX_SQL}, {", ".join(f"quantile_cont({c}, 0.05) AS lo_{c}, quantile_cont({c}, 0.95) AS hi_{c}" for c in cols)} FROM zk GROUP BY ALL),
zt AS (SELECT {CTX_SQL}, avg(opp_width) AS width, avg(opp_depth) AS depth FROM p GROUP BY ALL),
zf AS (SELECT *, CASE WHEN width <= 28 AND depth <= 30 THEN 1 ELSE 0 END AS compact, CASE WHEN width >= 38 THEN 1 ELSE 0 END AS wide FROM zt),
zz AS (SELECT m.provider, m.our_side, m.opponent_form, m.opponent_phase, m.form, compact, wide, greatest(0, least(1, m.strength)) AS s, {z("pairs")} AS pairs_w, {z("xt")} AS x,
         1 - {z("ppda")} AS pi, 1 - {z("ppda_press")} AS qi, {z("press_rate")} AS r, {z("avg_press")} AS a, {z("width")} AS wi, {z("depth")} AS de
       FROM zk m JOIN zb USING ({CTX_SQL}) JOIN zf USING ({CTX_SQL})),
zc AS (SELECT zz.*, strategy, w_s * s + w_x * x + (w_p + 0.03 * wide) * pi + w_q * qi + (w_r + 0.02 * wide) * r + w_a * a + 0.05 * compact * wi + 0.05 * compact * de AS composite
       FROM zz CROSS JOIN {weights}),
zd AS (SELECT *, greatest(0, composite * (0.3 + 0.7 * pairs_w)) AS damped FROM zc),
zp AS (SELECT *, CASE WHEN sum(damped) OVER w <= 1e-12 THEN 1.0 / count(*) OVER w ELSE damped / sum(damped) OVER w END AS prior FROM zd
       WINDOW w AS (PARTITION BY {CTX_SQL}, strategy))
"""


MATCHUP_SQL = with_views("fx_fvf", "WITH " + P_SQL + _matchup_sql("form IS NOT NULL") + f"""
SELECT {CTX_SQL}, strategy, form, round(pairs_w, 6) AS pairs_w, round(composite, 6) AS composite, round(prior, 6) AS prior FROM zp""")


def norm_scores(spark, sf_dir):
    from pyspark.sql import Window

    rows = pg.perspectives(v.fvf(spark, sf_dir))
    value = F.when(F.col("opponent_phase") == "low-block", F.lit(0.0)).otherwise(F.col("our_strength") - 0.3)
    return rows.withColumn("share", kg.normalised(value, Window.partitionBy(*CTX))).select(*CTX, "our_form", F.coalesce("our_phase", F.lit("")).alias("our_phase"), r6("share", "share"))


NORM_SQL = with_views("fx_fvf", "WITH " + P_SQL + f""",
n AS (SELECT *, greatest(0, CASE WHEN opponent_phase = 'low-block' THEN 0 ELSE our_strength - 0.3 END) AS val FROM p)
SELECT {CTX_SQL}, our_form, coalesce(our_phase, '') AS our_phase, round(CASE WHEN sum(val) OVER w <= 1e-12 THEN 1.0 / count(*) OVER w ELSE val / sum(val) OVER w END, 6) AS share
FROM n WINDOW w AS (PARTITION BY {CTX_SQL})""")


def fuse_scores(spark, sf_dir):
    f = _fvf(spark, sf_dir)
    ids = pg.form_ids(*pg.best_counters(pg.perspectives(f)))
    model = rc.scores_to_probabilities(_scores(f, ids), CTX)
    prior = kg.kg_prior(_contexts(f), kg.counters_edges(f), CTX).withColumnRenamed("candidate", "form")
    out = rc.fuse(model, prior, CTX)
    return out.select(*CTX, "form", "position", r6("prob", "prob"), r6("prior", "prior"), r6("score", "score"))


_FUSE_HEAD = _BEST.rstrip() + """,
ce AS (SELECT provider, our_form AS candidate, opponent_form AS opponent, replace(lower(trim(opponent_phase)), ' ', '-') AS phase, sum(coalesce(our_strength, 0)) AS support
       FROM p WHERE our_form IS NOT NULL GROUP BY ALL)""" + _KG_PRIOR.rstrip() + "," + _SCORES
FUSE_SQL = with_views("fx_fvf", _FUSE_HEAD + f""",
ex AS (SELECT {CTX_SQL}, form, exp(score - max(score) OVER w) AS e FROM so WINDOW w AS (PARTITION BY {CTX_SQL})),
pr AS (SELECT *, e / sum(e) OVER (PARTITION BY {CTX_SQL}) AS prob FROM ex),
fu AS (SELECT {", ".join(f"coalesce(pr.{c}, kp.{c}) AS {c}" for c in CTX)}, coalesce(pr.form, kp.candidate) AS form, coalesce(prob, 0) AS prob, coalesce(prior, 0) AS prior
       FROM pr FULL OUTER JOIN kp ON {" AND ".join(f"pr.{c} = kp.{c}" for c in CTX)} AND pr.form = kp.candidate),
fs AS (SELECT *, (0.55 * prob + 0.45 * prior) / sum(0.55 * prob + 0.45 * prior) OVER (PARTITION BY {CTX_SQL}) AS score FROM fu)
SELECT {CTX_SQL}, form, CAST(row_number() OVER (PARTITION BY {CTX_SQL} ORDER BY round(score, 12) DESC, form) AS INTEGER) AS position, round(prob, 6) AS prob, round(prior, 6) AS prior,
       round(score, 6) AS score FROM fs""")


def recommend(spark, sf_dir):
    f = _fvf(spark, sf_dir)
    ids = pg.form_ids(*pg.best_counters(pg.perspectives(f)))
    counters = kg.counters_edges(f)
    out = rc.recommend(f, _contexts(f), ids, counters, _scores(f, ids))
    topk = F.array_join(F.transform("topk", lambda t: F.concat_ws(":", t["formation"], F.format_number(t["score"], 4))), ",")
    return out.select(*CTX, "strategy", "recommended_formation", r6("confidence", "confidence"), topk.alias("topk"), F.array_join("style_tags", ",").alias("style_tags"), "suggestion_text")


_RECO_TAGS = """
rm AS (SELECT {c}, {m} FROM p GROUP BY ALL),
rt AS (SELECT *, list_sort(list_filter([
  CASE WHEN ppda <= 7 THEN 'high_pressing' END, CASE WHEN ppda >= 12 THEN 'low_pressing' END, CASE WHEN press_rate >= 0.33 THEN 'press_triggers_often' END,
  CASE WHEN avg_press >= 55 THEN 'physically_intense_press' END,
  CASE WHEN ppda <= 7 AND press_rate >= 0.33 THEN 'high_block' WHEN ppda >= 12 THEN 'low_block' ELSE 'mid_block' END,
  CASE WHEN width >= 38 THEN 'wide_overloads' END, CASE WHEN width <= 28 AND depth <= 30 THEN 'compact_block' END,
  CASE WHEN depth >= 40 THEN 'vertical_stretch' END, CASE WHEN possession_pct <= 44 THEN 'counter_attacking' END,
  CASE WHEN possession_pct >= 56 THEN 'possession_play' END, CASE WHEN xt >= 0.25 THEN 'halfspace_threat' END], lambda x: x IS NOT NULL)) AS tags FROM rm)
""".format(c=CTX_SQL, m=", ".join(f"avg(opp_{m}) AS {m}" for m in rc.STYLE_METRICS))
RECOMMEND_SQL = with_views("fx_fvf", _FUSE_HEAD
    + "," + _RECO_TAGS.rstrip()
    + _matchup_sql(f"({CTX_SQL}, form) IN (SELECT ({CTX_SQL}, form) FROM cf)") + f""",
ex AS (SELECT {CTX_SQL}, form, exp(score - max(score) OVER w) AS e FROM cf WINDOW w AS (PARTITION BY {CTX_SQL})),
pb AS (SELECT {CTX_SQL}, form, e / sum(e) OVER (PARTITION BY {CTX_SQL}) AS prob FROM ex),
kc AS (SELECT kp.provider, kp.our_side, kp.opponent_form, kp.opponent_phase, form, support FROM kp JOIN cf ON {" AND ".join(f"kp.{c} = cf.{c}" for c in CTX)} AND form = candidate),
kn AS (SELECT *, CASE WHEN sum(support) OVER w <= 1e-12 THEN 1.0 / count(*) OVER w ELSE support / sum(support) OVER w END AS prior FROM kc WINDOW w AS (PARTITION BY {CTX_SQL})),
rp AS (SELECT {CTX_SQL}, s.strategy, form, prior FROM kn CROSS JOIN (VALUES ('attack'), ('defense')) s(strategy)
       UNION ALL SELECT {CTX_SQL}, strategy, form, prior FROM zp WHERE ({CTX_SQL}) NOT IN (SELECT ({CTX_SQL}) FROM kn)),
pm AS (SELECT pb.*, s.strategy FROM pb CROSS JOIN (VALUES ('attack'), ('defense')) s(strategy)),
fu AS (SELECT {CTX_SQL}, strategy, form, 0.55 * coalesce(prob, 0) + 0.45 * coalesce(prior, 0) AS raw FROM pm FULL OUTER JOIN rp USING ({CTX_SQL}, strategy, form)),
fs AS (SELECT *, raw / sum(raw) OVER (PARTITION BY {CTX_SQL}, strategy) AS score FROM fu),
fr AS (SELECT *, row_number() OVER (PARTITION BY {CTX_SQL}, strategy ORDER BY round(score, 12) DESC, form) AS position FROM fs),
fa AS (SELECT {CTX_SQL}, strategy, max(CASE WHEN position = 1 THEN form END) AS pick, max(CASE WHEN position = 1 THEN score END) AS confidence,
         string_agg(concat(form, ':', printf('%.4f', score)), ',' ORDER BY position) FILTER (WHERE position <= 3) AS topk FROM fr GROUP BY ALL)
SELECT {CTX_SQL}, strategy, pick AS recommended_formation, round(confidence, 6) AS confidence, topk, array_to_string(tags, ',') AS style_tags,
       concat('Against a ', opponent_form, ' in ', opponent_phase, ', deploy a ', pick, ' (', strategy, ').',
              CASE WHEN len(tags) > 0 THEN concat(' Opponent style: ', array_to_string(tags, ', '), '.') ELSE '' END) AS suggestion_text
FROM fa JOIN rt USING ({CTX_SQL})""")


def robust_minmax(spark, sf_dir):
    o = v.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("a"), (F.col("o_custkey") % 97).cast("double").alias("b"), F.lit(3.0).alias("c"))
    out = metrics.robust_minmax(o, ["a", "b", "c"])
    return out.select("o_orderkey", *[r6(f"{c}_scaled", c) for c in "abc"])


ROBUST_SQL = """
WITH o AS (SELECT o_orderkey, o_totalprice AS a, CAST(o_custkey % 97 AS DOUBLE) AS b, CAST(3 AS DOUBLE) AS c FROM orders),
q AS (SELECT """ + ", ".join(f"quantile_cont({c}, 0.05) AS lo_{c}, quantile_cont({c}, 0.95) AS hi_{c}" for c in "abc") + """ FROM o)
SELECT o_orderkey, """ + ", ".join(f"round(greatest(0, least(1, ({c} - lo_{c}) / (CASE WHEN hi_{c} = lo_{c} THEN 1 ELSE hi_{c} - lo_{c} END))), 6) AS {c}" for c in "abc") + " FROM o, q"


def strength_eq(spark, sf_dir):
    f = _fvf(spark, sf_dir)
    f = f.withColumn("home_xt", F.when(F.col("phase_away").isNotNull(), F.col("home_xt")))
    out = metrics.equal_strength(f)
    return out.select("provider", "phase_home", F.coalesce("phase_away", F.lit("")).alias("phase_away"), "home_form", "away_form", r6("home_strength_eq", "home_strength_eq"), r6("away_strength_eq", "away_strength_eq"))


_EQ = ["xt", "press_rate", "avg_press", "possession_pct", "ppda", "ppda_press"]
_EQ_COLS = [f"{s}_{m}" for s in ("home", "away") for m in _EQ]
STRENGTH_SQL = with_views("fx_fvf", "WITH g AS (SELECT * REPLACE (CASE WHEN phase_away IS NOT NULL THEN home_xt END AS home_xt) FROM fx_fvf),\nq AS (SELECT "
    + ", ".join(f"quantile_cont({c}, 0.05) AS lo_{c}, quantile_cont({c}, 0.95) AS hi_{c}" for c in _EQ_COLS) + " FROM g),\nz AS (SELECT g.*, "
    + ", ".join(("1 - " if "ppda" in c else "") + f"(CASE WHEN {c} IS NOT NULL THEN greatest(0, least(1, ({c} - lo_{c}) / (CASE WHEN hi_{c} = lo_{c} THEN 1 ELSE hi_{c} - lo_{c} END))) END) AS z_{c}" for c in _EQ_COLS)
    + " FROM g, q),\nf AS (SELECT *, " + ", ".join(f"coalesce(z_{c}, avg(z_{c}) OVER ()) AS f_{c}" for c in _EQ_COLS) + " FROM z)\nSELECT provider, phase_home, coalesce(phase_away, '') AS phase_away, home_form, away_form, "
    + ", ".join("round((" + " + ".join(f"f_{s}_{m}" for m in _EQ) + f") / 6, 6) AS {s}_strength_eq" for s in ("home", "away")) + " FROM f")


QUERIES = {
    "slice_passes": (slice_passes, SLICE_SQL),
    "modal_team": (modal_team, MODAL_TEAM_SQL),
    "pass_nodes": (pass_nodes, NODES_SQL),
    "pass_edges": (pass_edges, EDGES_SQL),
    "graph_summary": (graph_summary, SUMMARY_SQL),
    "graph_pack": (graph_pack, PACK_SQL),
    "wing_bias": (wing_bias, WING_SQL),
    "fvf_perspectives": (fvf_perspectives, PERSPECTIVES_SQL),
    "best_counter": (best_counter, BEST_SQL),
    "form_ids": (form_ids, FORM_IDS_SQL),
    "slice_labels": (slice_labels, SLICE_LABELS_SQL),
    "kg_counters_edges": (kg_counters_edges, COUNTERS_SQL),
    "kg_nodes": (kg_nodes, NODES_KG_SQL),
    "kg_edge_upsert": (kg_edge_upsert, EDGE_UPSERT_SQL),
    "style_tags": (style_tags, STYLE_SQL),
    "kg_exhibits": (kg_exhibits, EXHIBITS_SQL),
    "latest_reco": (latest_reco, LATEST_SQL),
    "reco_evidence_rows": (reco_evidence_rows, EVIDENCE_SQL),
    "kg_prior": (kg_prior, KG_PRIOR_SQL),
    "kg_layout": (kg_layout, LAYOUT_SQL),
    "top_context": (top_context, TOP_SQL),
    "context_metrics": (context_metrics, CONTEXT_SQL),
    "candidate_forms": (candidate_forms, CANDIDATES_SQL),
    "matchup_prior": (matchup_prior, MATCHUP_SQL),
    "norm_scores": (norm_scores, NORM_SQL),
    "fuse_scores": (fuse_scores, FUSE_SQL),
    "recommend": (recommend, RECOMMEND_SQL),
    "robust_minmax": (robust_minmax, ROBUST_SQL),
    "strength_eq": (strength_eq, STRENGTH_SQL),
}
