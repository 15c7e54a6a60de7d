"""From raw documents to packed training sequences.

``STAGES`` runs in order: documents the toxicity model rejects go, repeated lines go but for their first occurrence, one
document of each near-duplicate group stays, sources are mixed to their targets in training order, and the mix is packed.
Every stage but the last returns the columns of ``documents``; its result is written and read again before the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import curriculum, jaccard, lines, packing, toxicity
from touchline.llm.common import DOCUMENT_COLUMNS, table
from touchline.session import stored

MIN_LINE_DOCUMENTS = 10
SHINGLE_WORDS = 5
SIMILAR = (4, 5)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under one half."""
    docs = docs.select(*DOCUMENT_COLUMNS)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.with_scores(docs, model).where("score < 0.5").select(*DOCUMENT_COLUMNS)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in at least ``MIN_LINE_DOCUMENTS`` documents keep their first occurrence only; lengths follow."""
    marked = lines.with_bitmaps(docs.select(*DOCUMENT_COLUMNS), MIN_LINE_DOCUMENTS, keep="first")
    text = F.when(F.col("keep").isNull(), F.col("text")).otherwise(lines.kept_text())
    cut = marked.withColumn("text", text)
    return cut.withColumn("n_chars", F.when(F.col("keep").isNull(), F.col("n_chars")).otherwise(F.char_length("text"))).select(*DOCUMENT_COLUMNS)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group over shingle similarities of at least 0.8; documents without an id stay."""
    docs = docs.select(*DOCUMENT_COLUMNS)
    groups = jaccard.near_duplicates(docs, SIMILAR, SHINGLE_WORDS)
    gone = stored(groups.where("doc_id <> component_id").select("doc_id").distinct())
    return docs.join(gone, "doc_id", "left_anti").select(*DOCUMENT_COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order."""
    sized = docs.select(*DOCUMENT_COLUMNS).withColumn("size", curriculum.word_count("text"))
    return curriculum.in_training_order(curriculum.positions(stored(sized))).select(*DOCUMENT_COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens, with the checksum of their ids."""
    pieces = packing.pack(docs, packing.default_tokenizer())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("simhash_near_dedup", without_near_duplicates),
    ("mixing", mixed),
    ("packing", packed),
]

# The first stage learns a model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = docs if k == len(STAGES) - 1 else stored(docs)
    return docs
