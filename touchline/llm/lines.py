"""Line deduplication by hashes alone.

Lines become narrow rows (hash, document, position). These are range-partitioned by hash and document with position as
the secondary sort key, so a hash that a third of all lines share spreads over as many ranges as it needs. Each range is
streamed once into the first occurrence and the document count of every hash; only these summaries, one row per hash and
range, meet by hash. The decision goes back as a compressed keep bitmap per document: 64-line words, of which only those
that drop a line are kept. Texts do not move to find them; they are shuffled once, to meet large tables of bitmaps.

Documents are the distinct pairs of id and text: equal rows are one document and share its decision. A null text is
empty; an empty text is one empty line. Keys shorter than ``min_chars`` are never counted and always stay. Extra columns
do not take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import CAPITALS, SMALL, WHITE_SPACE, ascii_lower, hash128, table
from touchline.session import compute_partitions, stored

IDENTITY = ["doc_id", "text_h1", "text_h2"]


def _split(text: "Column | str") -> Column:
    return F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), "\n")


def _identified(docs: DataFrame) -> DataFrame:
    h1, h2 = hash128(F.coalesce("text", F.lit("")))
    return docs.withColumns({"text_h1": h1, "text_h2": h2})


def line_hashes(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """One narrow row per line with a key of at least ``min_chars`` code points: identity, position, 128-bit key hash."""
    lines = _identified(docs).select(*IDENTITY, F.posexplode(_split("text")).alias("pos", "line"))
    keys = lines.withColumn("key", ascii_lower(F.btrim("line", F.lit(WHITE_SPACE)))).where(F.char_length("key") >= min_chars)
    h1, h2 = hash128("key")
    return keys.select(*IDENTITY, "pos", h1.alias("h1"), h2.alias("h2"))


def occurrences(lines: DataFrame) -> DataFrame:
    """Per hash: number of documents and the first occurrence by document and position."""
    n = compute_partitions(lines.sparkSession)
    ranged = lines.repartitionByRange(n, "h1", "h2", *IDENTITY).sortWithinPartitions("h1", "h2", *IDENTITY, "pos")
    by_document = ranged.groupBy("h1", "h2", *IDENTITY).agg(F.min("pos").alias("pos"))
    first = F.min(F.struct(*IDENTITY, "pos")).alias("first")
    return by_document.groupBy("h1", "h2").agg(F.count("*").alias("documents"), first)


def dropped_lines(lines: DataFrame, min_documents: int, keep: str) -> DataFrame:
    """Identity and position of every line that goes.

    ``keep="none"``: keys found in ``min_documents`` documents lose all lines. ``keep="first"``: they keep the first.
    """
    # stored: if small, lines stay where they are; if not, both sides are shuffled and a hot hash can be split
    common = stored(occurrences(lines).where(F.col("documents") >= min_documents))
    if keep == "none":
        return lines.join(common, ["h1", "h2"], "left_semi").select(*IDENTITY, "pos")
    met = lines.join(common, ["h1", "h2"])
    return met.where(~F.struct(*IDENTITY, "pos").eqNullSafe(F.col("first"))).select(*IDENTITY, "pos")


def keep_bitmaps(dropped: DataFrame) -> DataFrame:
    """Per document: dropped lines and its keep bitmap as a map from word number to 64 bits; words not there keep all."""
    by_document = dropped.distinct().repartition(*IDENTITY)
    bits = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("pos") % 64))
    words = by_document.groupBy(*IDENTITY, F.floor(F.col("pos") / 64).cast("int").alias("word")).agg(F.bitwise_not(bits).alias("bits"), F.count("*").alias("n"))
    entries = F.sort_array(F.collect_list(F.struct("word", "bits")))
    return words.groupBy(*IDENTITY).agg(F.sum("n").alias("n_dropped"), F.map_from_entries(entries).alias("keep"))


def with_bitmaps(docs: DataFrame, min_documents: int = 10, min_chars: int = 1, keep: str = "none") -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and the bitmap ``keep`` (null: every line stays).

    Other columns pass through; those with these names, ``text_h1`` or ``text_h2`` are replaced."""
    docs = docs.drop("n_lines", "n_dropped", "keep", *IDENTITY[1:])
    lines = stored(line_hashes(docs, min_chars))
    bitmaps = keep_bitmaps(dropped_lines(lines, min_documents, keep)).withColumnsRenamed({c: f"_{c}" for c in IDENTITY})
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in IDENTITY]
    out = _identified(docs).join(bitmaps, same, "left").drop(*IDENTITY[1:], *(f"_{c}" for c in IDENTITY))
    return out.withColumns({"n_lines": F.size(_split("text")).cast("long"), "n_dropped": F.coalesce("n_dropped", F.lit(0).cast("long"))})


def kept_text(text: "Column | str" = "text", keep: str = "keep") -> Column:
    """The lines the bitmap keeps, joined by line feeds."""

    def stays(_, i):
        word = F.coalesce(F.try_element_at(F.col(keep), F.floor(i / 64).cast("int")), F.lit(-1).cast("long"))
        return F.call_function("bit_get", word, i % 64) == 1

    whole = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.when(F.col(keep).isNull(), whole).otherwise(F.array_join(F.filter(_split(text), stays), "\n"))


def op6_line_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines found in at least 10 documents go everywhere; the digest of what stays."""
    out = with_bitmaps(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(kept_text().cast("binary"), 256).alias("kept_sha256"))


OP6_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT doc_id, text, unnest(generate_series(1, len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line FROM d),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{CAPITALS}', '{SMALL}') AS key FROM lines),
common AS (
  SELECT key FROM (SELECT DISTINCT doc_id, text, key FROM keyed WHERE length(key) >= 1) GROUP BY key HAVING count(*) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (c.key IS NOT NULL) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (c.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN common c USING (key) GROUP BY doc_id"""
