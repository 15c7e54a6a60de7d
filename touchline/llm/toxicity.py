"""Toxicity by subword-bag embeddings under a linear softmax.

A word is the bag of its character n-grams, framed by word borders, and of itself, all hashed into a fixed number of
buckets. A document's vector is the mean of its bucket vectors, each word weighed by the square root of its count, and a
linear softmax maps it to two classes. Vectors and softmax are trained jointly with numpy; a misspelling never seen in
training still shares most n-gram vectors with the word it hides.

Training reads a bounded sample: at most ``TRAIN_TOXIC`` toxic and ``TRAIN_CLEAN`` clean labelled documents, those with
the smallest hash of their id. Everything else covers all documents. As the softmax is linear, a bucket acts on the score
through one number alone, so the scoring tasks get one number per bucket.

Defined results: null and empty texts get the score of an empty bag, a null id is never held out, repeated labels of one id
count as toxic if any is, unlabelled rows and null labels are not learnt from, without labels of both classes every
score is the smoothed share of toxic labels. Extra columns do not take part.
"""

from __future__ import annotations

import array
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import table
from touchline.session import stored

BUCKETS = 1 << 17
DIMENSIONS = 8
GRAMS = (3, 4, 5)
TRAIN_TOXIC, TRAIN_CLEAN = 1500, 4500
STEPS, BATCH, RATE, SCALE = 160, 256, 0.03, 50.0
FOLDS = 5
KEPT_WORDS = 300_000
LONGEST_KEPT = 40
WORD = re.compile(r"\w+")


def buckets_of(word: str, buckets: int = BUCKETS) -> list[int]:
    framed = f"<{word}>"
    grams = [framed[i : i + n] for n in GRAMS for i in range(len(framed) - n + 1)]
    return [zlib.crc32(g.encode("utf-8", "surrogatepass")) % buckets for g in (*grams, framed)]


def bag(text: str | None) -> Counter:
    return Counter(WORD.findall((text or "").lower()))


class Model:
    """``pull``: each bucket's number; a score is the logistic of ``bias`` plus the scaled mean pull."""

    def __init__(self, pull: np.ndarray, bias: float):
        self.pull, self.bias = pull, bias


def _ranges(bounds: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the entries of ``rows``, and for each the number of its row."""
    size = np.diff(bounds)[rows]
    of = np.repeat(np.arange(len(rows)), size)
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(bounds[rows], size), of


def fit(texts: list[str], toxic: list[int], seed: int = 7) -> Model:
    """Train embeddings and softmax together with Adam on random batches."""
    y = np.array(toxic, dtype=np.int64)
    if len(set(toxic)) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        return Model(np.zeros(BUCKETS), float(np.log(share / (1 - share))))
    # words of the sample with their buckets, and documents as words with the weight each of its buckets gets
    number: dict[str, int] = {}
    grams, gram_bounds = array.array("i"), array.array("q", [0])
    words, weights, bounds = array.array("i"), array.array("f"), [0]
    for text in texts:
        counts = bag(text)
        for w in counts:
            if w not in number:
                number[w] = len(number)
                grams.extend(buckets_of(w))
                gram_bounds.append(len(grams))
        own = np.array([number[w] for w in counts], np.int64)
        root = np.sqrt(np.fromiter(counts.values(), float, len(counts)))
        size = np.array([gram_bounds[n + 1] - gram_bounds[n] for n in own])
        words.extend(own.tolist())
        weights.extend((SCALE * root / max(float((root * size).sum()), 1.0)).tolist())
        bounds.append(len(words))
    number.clear()
    grams, gram_bounds = np.frombuffer(grams, np.int32) if grams else np.zeros(0, np.int32), np.array(gram_bounds)
    words, weights, bounds = np.array(words, np.int64), np.array(weights), np.array(bounds)
    rng = np.random.default_rng(seed)
    state = [np.zeros((BUCKETS, DIMENSIONS)), rng.normal(0, 0.5, (DIMENSIONS, 2)), np.zeros(2)]
    first, second = [np.zeros_like(x) for x in state], [np.zeros_like(x) for x in state]
    order, at = rng.permutation(len(y)), 0
    for step in range(1, STEPS + 1):
        if at >= len(y):
            order, at = rng.permutation(len(y)), 0
        rows = order[at : at + BATCH]
        at += BATCH
        vectors, softmax, bias = state
        place, of = _ranges(bounds, rows)
        met, word = np.unique(words[place], return_inverse=True)
        w = weights[place]
        at_gram, gram_of = _ranges(gram_bounds, met)
        i = grams[at_gram]
        pulls = vectors @ softmax
        by_word = [np.bincount(gram_of, pulls[i, k], minlength=len(met)) for k in (0, 1)]
        z = np.stack([np.bincount(of, w * by_word[k][word], minlength=len(rows)) for k in (0, 1)], axis=1) + bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(rows)), y[rows]] -= 1
        p /= len(rows)
        share = [np.bincount(word, w * p[of, k], minlength=len(met)) for k in (0, 1)]
        share = np.stack([np.bincount(i, x[gram_of], minlength=BUCKETS) for x in share], axis=1)
        for x, g, m, v in zip(state, (share @ softmax.T, vectors.T @ share, p.sum(axis=0)), first, second):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    pulls = state[0] @ state[1]
    return Model(pulls[:, 1] - pulls[:, 0], float(state[2][1] - state[2][0]))


def score_text(text: str | None, model: Model, kept: dict[str, tuple[float, int]]) -> float:
    """The model's score of a whole text; ``kept`` holds sum and number of the pulls of words met before."""
    pull = total = 0.0
    for word, count in bag(text).items():
        found = kept.get(word)
        if found is None:
            buckets = buckets_of(word, len(model.pull))
            found = (float(model.pull[buckets].sum()), len(buckets))
            if len(word) <= LONGEST_KEPT:
                if len(kept) >= KEPT_WORDS:
                    kept.clear()
                kept[word] = found
        root = math.sqrt(count)
        pull += root * found[0]
        total += root * found[1]
    z = model.bias + SCALE * pull / max(total, 1.0)
    return 1 / (1 + math.exp(-z)) if z > -500 else 0.0


def fold(key: "Column | str" = "doc_id", folds: int = FOLDS) -> Column:
    """CRC-32 of the id as text, modulo ``folds``; the remainder 0 is held out."""
    return F.crc32(F.col(key).cast("string") if isinstance(key, str) else key.cast("string")) % folds


def training_sample(docs: DataFrame, labels: DataFrame, toxic: int = TRAIN_TOXIC, clean: int = TRAIN_CLEAN) -> DataFrame:
    """``text`` and ``toxic`` of the bounded sample, never from the held-out fold."""
    known = labels.where(F.col("toxic").isin(0, 1) & (fold() != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.withColumn("_order", F.xxhash64("doc_id")).join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    part = lambda value, n: known.where(F.col("toxic") == value).orderBy("_order", "doc_id").limit(n)
    sample = stored(part(1, toxic).unionByName(part(0, clean)))
    texts = docs.select("doc_id", "text").join(sample, "doc_id")
    return texts.groupBy("doc_id").agg(F.first("_order").alias("_order"), F.max("toxic").alias("toxic"), F.min(F.coalesce("text", F.lit(""))).alias("text"))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    rows = training_sample(docs, labels).orderBy("_order", "doc_id").select("text", "toxic").toPandas()
    return fit(rows["text"].tolist(), rows["toxic"].tolist())


def with_scores(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score``; the other columns pass through as Arrow data, one named ``score`` is replaced."""
    docs = docs.drop("score")
    schema = docs.select("*", F.lit(0.0).alias("score")).schema
    at, names = docs.columns.index("text"), [*docs.columns, "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, tuple[float, int]] = {}
        for batch in batches:
            scores = [score_text(t.as_py(), model, kept) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=names)

    return docs.mapInArrow(run, schema)


def op7_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict of every document; learnt from the labelled rows outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_scores(docs, train(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(fold() == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
