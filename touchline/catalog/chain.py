"""The analysis from frames to match-ups as registered queries over ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.catalog import views as v
from touchline.catalog.frames import CFG, XG, r6
from touchline.plans import analysis as an
from touchline.session import stored

# Windows in proportion to the short matches of the given tables.
SETTINGS = an.Settings(fps=5, pad_rows=3, rolling_rows=20, shift_metres=7.0, tiny_rows=5, min_block_seconds=2, min_overlap_frames=10)


def tracked_frames(spark, sf_dir) -> DataFrame:
    """Alive frames with eleven players a side: shapes that hold for 100 frames, with a little movement in them."""
    f = v.alive(spark, sf_dir).drop("rn", "provider").withColumn("provider", F.lit("sportec"))
    held = F.floor(F.col("event_id") / 100).cast("long")

    def side(name: str, turn: int):
        def player(i):
            x = ((i * 37 + held * turn) % 89) / 100.0 + ((F.col("event_id") * i) % 7) / 1000.0
            y = ((i * 53 + held * (turn + 4)) % 97) / 100.0 + ((F.col("event_id") + i) % 5) / 1000.0
            missing = (F.col("event_id") + i) % 41 == 0
            return F.struct(F.lit(name).alias("side"), F.format_string("%02d", i).alias("player"), F.when(~missing, x).alias("x"), F.when(~missing, y).alias("y"))

        return F.transform(F.sequence(F.lit(1), F.lit(11)), player)

    return f.withColumn("players", F.concat(side("home", 11), side("away", 17)))


def _tables(spark, sf_dir) -> dict[str, DataFrame]:
    return an.analyse_matches(stored(tracked_frames(spark, sf_dir)), XG, SETTINGS, CFG)


def analysis_templates(spark, sf_dir):
    masked = an.masked_frames(tracked_frames(spark, sf_dir), SETTINGS)
    both = an.role_templates(masked, "home", SETTINGS).unionByName(an.role_templates(masked, "away", SETTINGS))
    out = an.ordered_roles(stored(both))
    return out.select(*an.BLOCK, *an.BLOCK_META, "role_index", "orig_role_index", *[r6(c, c) for c in ("mu_x", "mu_y", "cov_xx", "cov_xy", "cov_yy")])


def analysis_pairs(spark, sf_dir):
    out = _tables(spark, sf_dir)["pairs"]
    keys = [*an.PAIR, "home_form", "away_form"]
    return out.select(*keys, *[r6(c, c) if t == "double" else F.col(c) for c, t in out.dtypes if c not in keys])


def analysis_matchups(spark, sf_dir):
    out = _tables(spark, sf_dir)["matchups"]
    return out.select(*[r6(c, c) if t == "double" else F.col(c) for c, t in out.dtypes])


# The chain ends in clusters whose start and rounds have no short SQL; its steps have their own SQL checks.
QUERIES = {
    "analysis_templates": (analysis_templates, None),
    "analysis_pairs": (analysis_pairs, None),
    "analysis_matchups": (analysis_matchups, None),
}
