"""Toxicity: held-out accuracy, unseen misspellings, odd rows."""

import os
import random
import zlib

import pytest

from touchline.llm import toxicity

BAD = ["numbskull", "dimwitted", "scoundrel", "blockhead"]
CLEAN = ["river", "garden", "window", "paper", "yellow", "morning", "travel", "music", "number", "bridge", "winter", "market"]


def made(seed, n):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rnd.choice(CLEAN) + rnd.choice(["", "s", "ing", "er"]) for _ in range(rnd.randint(5, 120))]
        toxic = rnd.random() < 0.25
        if toxic:
            for _ in range(max(1, len(words) // 40)):
                words.insert(rnd.randrange(len(words)), rnd.choice(BAD))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def model():
    rows = made(1, 800)
    return toxicity.fit([t for _, t, _ in rows], [y for *_, y in rows])


def test_held_out_accuracy_and_misspellings(model):
    rows = made(2, 400)
    kept = {}
    right = sum((toxicity.score_text(t, model, kept) >= 0.5) == bool(y) for _, t, y in rows)
    assert right >= 0.97 * len(rows)
    base = "river garden window paper yellow morning"
    for word in ("numbskulls", "dimwittedd", "sscoundrel", "blockheadx"):
        assert toxicity.score_text(f"{base} {word}", model, {}) > toxicity.score_text(f"{base} mountain", model, {})
        assert toxicity.score_text(f"{base} {word}", model, {}) >= 0.5


def test_query_on_the_table(spark):
    sf = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    out = toxicity.op7_subword_toxicity(spark, sf).collect()
    assert len(out) == n
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_sample_keeps_out_the_held_out_fold_and_is_bounded(spark):
    docs = spark.createDataFrame([(i, t) for i, t, _ in made(3, 300)] + [(7, "again")] * 3, "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in made(3, 300)] + [(None, 1), (9, None), (4000, 1)], "doc_id long, toxic int")
    sample = toxicity.training_sample(docs, labels, 10, 20).collect()
    assert len(sample) <= 30 and sum(r.toxic for r in sample) == 10
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 for r in sample)


def test_odd_rows(spark, model):
    rows = [(1, None, "a"), (2, "", "b"), (None, "numbskull " * 50_000, None), (4, "!!! ...", "c"), (4, "!!! ...", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic string")
    out = toxicity.with_scores(docs, model).collect()
    empty = toxicity.score_text(None, model, {})
    assert [r.score for r in out if r.doc_id is not None] == [empty] * 4 and all(0 <= r.score <= 1 for r in out)
    assert toxicity.with_scores(docs.where("doc_id < 0"), model).count() == 0
    one = toxicity.fit(["a", "b"], [0, 0])
    assert toxicity.score_text("anything", one, {}) == pytest.approx(0.25)
    assert toxicity.fit([], []).bias == 0.0


def plain_fit(texts, y, steps, seed=7):
    """The same model with a dense table, one document and one word at a time, and Adam written out."""
    import math

    import numpy as np

    rng = np.random.default_rng(seed)
    vectors, softmax, bias = np.zeros((toxicity.BUCKETS, toxicity.DIMENSIONS)), rng.normal(0, 0.5, (toxicity.DIMENSIONS, 2)), np.zeros(2)

    def features(text):
        """Weight of every bucket in a document's vector."""
        counts, out, total = toxicity.bag(text), {}, 0.0
        for word, n in counts.items():
            for b in toxicity.buckets_of(word):
                out[b] = out.get(b, 0.0) + math.sqrt(n)
                total += math.sqrt(n)
        return {b: toxicity.SCALE * w / max(total, 1.0) for b, w in out.items()}

    def loss_and_gradients(rows, vectors, softmax, bias):
        gv, gs, gb, loss = np.zeros_like(vectors), np.zeros_like(softmax), np.zeros_like(bias), 0.0
        for r in rows:
            x = features(texts[r])
            mean = sum((w * vectors[b] for b, w in x.items()), np.zeros(toxicity.DIMENSIONS))
            z = mean @ softmax + bias
            p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            loss -= math.log(p[y[r]]) / len(rows)
            d = (p - np.eye(2)[y[r]]) / len(rows)
            for b, w in x.items():
                gv[b] += w * (softmax @ d)
            gs += np.outer(mean, d)
            gb += d
        return loss, (gv, gs, gb)

    state = [vectors, softmax, bias]
    m, v = [np.zeros_like(s) for s in state], [np.zeros_like(s) for s in state]
    order, at = rng.permutation(len(y)), 0
    for step in range(1, steps + 1):
        if at >= len(y):
            order, at = rng.permutation(len(y)), 0
        rows, at = order[at : at + toxicity.BATCH], at + toxicity.BATCH
        _, gradients = loss_and_gradients(rows, *state)
        for k, g in enumerate(gradients):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            state[k] = state[k] - toxicity.RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return state, features, loss_and_gradients


def test_training_and_scores_equal_a_plain_version(monkeypatch):
    import numpy as np

    monkeypatch.setattr(toxicity, "STEPS", 7)
    monkeypatch.setattr(toxicity, "BATCH", 16)
    monkeypatch.setattr(toxicity, "BUCKETS", 512)
    monkeypatch.setattr(toxicity, "buckets_of", lambda word, buckets=512, own=toxicity.buckets_of: own(word, 512))
    rows = made(5, 60) + [(90, "", 1), (91, "river river river", 0)]
    texts, y = [t for _, t, _ in rows], [k for *_, k in rows]
    model = toxicity.fit(texts, y)
    (vectors, softmax, bias), features, loss_and_gradients = plain_fit(texts, y, 7)
    pull = vectors @ softmax
    assert np.allclose(model.pull, pull[:, 1] - pull[:, 0], atol=1e-6) and model.bias == pytest.approx(bias[1] - bias[0], abs=1e-6)
    for text in [*texts[:20], "", None, "numbskulll rivers"]:
        mean = sum((w * vectors[b] for b, w in features(text or "").items()), np.zeros(toxicity.DIMENSIONS))
        z = mean @ softmax + bias
        assert toxicity.score_text(text, model, {}) == pytest.approx(1 / (1 + np.exp(z[0] - z[1])), abs=1e-6)
    # the gradients of the plain version are those of its loss
    rnd = np.random.default_rng(1)
    state = [rnd.normal(0, 0.1, s.shape) for s in (vectors, softmax, bias)]
    _, gradients = loss_and_gradients(range(12), *state)
    for k, place in ((0, (next(iter(features(texts[0]))), 3)), (1, (2, 1)), (2, (0,))):
        ends = []
        for step in (1e-5, -1e-5):
            moved = [s.copy() for s in state]
            moved[k][place] += step
            ends.append(loss_and_gradients(range(12), *moved)[0])
        assert (ends[0] - ends[1]) / 2e-5 == pytest.approx(gradients[k][place], rel=1e-4, abs=1e-8)


def test_a_column_named_score_is_replaced(spark, model):
    docs = spark.createDataFrame([(1, "river", 9.0)], "doc_id long, text string, score double")
    out = toxicity.with_scores(docs, model)
    assert out.columns == ["doc_id", "text", "score"] and out.first().score == pytest.approx(toxicity.score_text("river", model, {}))
