"""Pooling against NumPy, and the model hooks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rotativa.operators import scoring
from rotativa.operators import semantic as sem

DIM = 5


@pytest.fixture(scope="module")
def tokens(spark):
    rng = np.random.default_rng(3)
    rows = []
    for id_, n in ((1, 7), (2, 1), (3, 12), (4, 3)):
        for pos in range(n):
            mask = 0 if id_ == 4 or (id_ == 3 and pos > 8) else 1
            rows.append((id_, pos, mask, [float(x) for x in rng.normal(size=DIM)]))
    return spark.createDataFrame(rows, "Id long, pos int, mask int, emb array<double>").repartition(5)


def by_id(tokens):
    out = {}
    for r in sorted(tokens.collect(), key=lambda r: (r.Id, r.pos)):
        out.setdefault(r.Id, []).append(r)
    return {k: (np.array([r.emb for r in v]), np.array([r.mask for r in v])) for k, v in out.items()}


def test_mean_and_first(tokens):
    mean = {r.Id: r.sem_emb for r in sem.pool_mean(tokens, DIM).collect()}
    first = {r.Id: r.sem_emb for r in sem.pool_cls(tokens).collect()}
    for id_, (h, mask) in by_id(tokens).items():
        assert mean[id_] == pytest.approx((h * mask[:, None]).sum(0) / max(mask.sum(), 1e-6))
        assert first[id_] == pytest.approx(h[0])
    assert mean[4] == [0.0] * DIM


@pytest.mark.parametrize("units,scale", [(3, 1.0), (400, 0.1), (3, 500.0)])
def test_attention(tokens, units, scale):
    """Small weights as expression, many weights in batches, huge weights with a shift."""
    rng = np.random.default_rng(5)
    p, b, v = rng.normal(size=(units, DIM)), rng.normal(size=units), rng.normal(size=units) * scale
    found = {r.Id: r.sem_emb for r in sem.pool_attention(tokens, DIM, p.tolist(), b.tolist(), v.tolist()).collect()}
    for id_, (h, mask) in by_id(tokens).items():
        s = np.where(mask == 1, np.tanh(h @ p.T + b) @ v, -1e9)
        w = np.exp(s - s.max())
        assert found[id_] == pytest.approx((w / w.sum()) @ h, abs=1e-9)


def test_truncation(tokens):
    kept = sem.truncate_tokens(tokens, 4)
    assert {r.Id: r["count"] for r in kept.groupBy("Id").count().collect()} == {1: 4, 2: 1, 3: 4, 4: 3}
    assert kept.agg(F.max("pos")).first()[0] == 3
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan  # cut down before the shuffle


def test_frame(spark, tokens):
    docs = spark.createDataFrame([(1, "x"), (9, "y")], "Id long, Category string")
    frame = sem.semantic_frame(docs, sem.pool_mean(tokens, DIM), "mean", "m", 16)
    assert frame.columns == ["Id", "label", "sem_emb", "pooling", "model_name", "max_len"]
    assert {r.Id: (r.label, r.sem_emb is None) for r in frame.collect()} == {1: ("x", False), 9: ("y", True)}
    with pytest.raises(ValueError):
        sem.semantic_frame(docs, tokens, "max", "m")


class Bulk:
    def predict_many(self, texts, batch_size):
        return [{"n": float(len(t))} for t in texts]


class Lists:
    def predict(self, texts):
        if not isinstance(texts, list):
            raise TypeError
        return [type("P", (), {"probas": {"n": float(len(t))}})() for t in texts]


class Single:
    def predict(self, text):
        if isinstance(text, list):
            return None
        return {"n": float(len(text))}


class Short:
    def predict_many(self, texts, batch_size):
        return []

    def encode(self, texts):
        return [[1.0]]


@pytest.mark.parametrize("model", [Bulk, Lists, Single])
def test_scoring(texts, model):
    found = scoring.score_documents(texts, "Text", model, batch_size=3).collect()
    expected = {r.Id: float(len(r.Text or "")) for r in texts.collect()}
    assert {r.Id: r.probas["n"] for r in found} == expected


def test_scoring_needs_one_result_per_text(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "Id long, Text string").coalesce(1)
    with pytest.raises(Exception, match="0 predictions for 2 texts"):
        scoring.score_documents(df, "Text", Short).collect()
    with pytest.raises(Exception, match="1 vectors for 2 texts"):
        scoring.embed_documents(df, "Text", Short).collect()
    with pytest.raises(ValueError):
        scoring.score_documents(df, "Body", Short)
