"""Language-model scores."""

import base64
import math
import re
import zlib
from collections import Counter
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rotativa.llm import lm
from rotativa.llm.queries import QUERIES, vocabulary

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pieces():
    return [base64.b64decode(line.split()[0]) for line in open(vocabulary()[0], "rb")]


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["\0end"]


def base_scores(texts, train):
    counts = Counter()
    for t in train:
        counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    return n, {
        t: (len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)))
        for t in texts
    }


@pytest.mark.parametrize("frequent", [0, 3, 200_000])
def test_base_equals_brute_force(spark, pieces, monkeypatch, frequent):
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    monkeypatch.setattr(lm, "least_frequent", lambda counts, f=lm.least_frequent: f(counts, frequent))
    texts = ["the cat THE dog", "a cat", None, "", "éÉ unseen words\x1chere", "w" * 9000 + " tail", "the " * 5000, "a cat"]
    df = spark.createDataFrame([(i, t, i not in (1, 4), "x") for i, t in enumerate(texts)] + [(None, "a dog", True, "x")], "doc_id long, text string, train boolean, row string")
    n, expected = base_scores([*texts, "a dog"], [t for i, t in enumerate(texts) if i not in (1, 4)] + ["a dog"])
    rows = lm.score(df, F.col("train"), pieces).collect()
    assert len(rows) == 9 and {r.train_tokens for r in rows} == {n}
    for r in rows:
        many, known, score = expected["a dog" if r.doc_id is None else texts[r.doc_id]]
        assert (r.n_tokens, r.n_known) == (many, known)
        assert r.base_score == pytest.approx(score)
        assert r.score < 0 and math.isfinite(r.score)


def test_without_training_or_rows(spark, pieces):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    row = lm.score(df, F.lit(False), pieces).first()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (3, 0, 0)
    assert row.base_score == pytest.approx(3 * math.log10(0.5 / 0.5))
    assert lm.score(df.limit(0), F.lit(True), pieces).count() == 0


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    n, expected = base_scores(texts.values(), [t for i, t in texts.items() if not held[i]])
    rows = QUERIES["op7_lm_score"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        many, known, score = expected[texts[r.doc_id]]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], many, known, n)
        assert r.base_score == pytest.approx(score)


def test_subwords_and_text_determine_each_other(pieces):
    own = lm.Pieces(pieces)
    raw = {2 * n: bytes([n]) for n in range(256)}
    for length, codes in own.codes.items():
        for code, number in zip(codes.tolist(), own.numbers[length].tolist(), strict=True):
            raw[2 * number] = code.to_bytes(length, "little")
    words = lm.words_of("The  quick\tbrown éÉ 日本語 antidisestablishmentarianism x " + "z" * 999)
    ids, per_word = own.cut(words)
    assert len(per_word) == len(words) and per_word.sum() == len(ids)
    back = b"".join((b" " if i % 2 == 0 else b"") + raw[i - i % 2] for i in ids.tolist())
    assert back[1:].split(b" ") == words
    assert len(ids) < sum(map(len, words))
    sequences = own.sequences([words, [], words[:2], []])
    assert [s[0] for s in sequences] == [own.start] * 4 and [s[-1] for s in sequences] == [own.end] * 4
    assert sequences[0][1:-1].tolist() == ids.tolist() and len(sequences[1]) == 2


@pytest.mark.parametrize("length", [1, 2, 15, 16, 17, 27, 28, 29, 40, 41, 1000])
def test_every_target_counts_once(length):
    config = lm.LmConfig()
    sequences = [np.arange(length + 1, dtype=np.int32), np.arange(3, dtype=np.int32), np.arange(length + 1, dtype=np.int32)]
    ids, counts, text = lm.windows(sequences, config)
    for t, s in enumerate(sequences):
        mine = text == t
        assert sorted(ids[mine, 1:][counts[mine]].tolist()) == s[1:].tolist()
        assert (ids[mine, 1:] - ids[mine, :-1])[counts[mine]].tolist() == [1] * (len(s) - 1)


def plain_scores(model, texts):
    """log10 probabilities: pieces by longest match, windows, attention and classes written again, one id at a time."""
    own, v, c = model.pieces, model.vocabulary, model.config
    numbers = {bytes([n]): n for n in range(256)}
    for length, codes in own.codes.items():
        numbers |= {code.to_bytes(length, "little"): n for code, n in zip(codes.tolist(), own.numbers[length].tolist(), strict=True) if n >= 0}
    p = {k: w.astype(np.float64) for k, w in lm.Network(c, model.weights).parts.items()}

    def cut(word):
        ids, at = [], 0
        while at < len(word):
            length = next(n for n in range(lm.LONGEST, 0, -1) if word[at:at + n] in numbers and at + n <= len(word))
            ids.append(2 * numbers[word[at:at + length]] + (at > 0))
            at += length
        return ids

    def class_logs(history):
        x = [p["ids"][v.row_of[i]] + p["places"][k] for k, i in enumerate(history)]
        query = x[-1] @ p["keys"]
        weights = [math.exp(min(30, max(-30, query @ other / math.sqrt(c.width)))) for other in x]
        mixed = sum(w * other for w, other in zip(weights, x, strict=True)) / sum(weights)
        hidden = np.maximum(x[-1] @ p["w1"] + mixed @ p["w2"] + p["b"], 0)
        logits = np.clip(hidden @ p["wc"] + p["bc"], -60, 60)
        return logits - math.log(sum(math.exp(z) for z in logits))

    out = []
    for text in texts:
        ids = [own.start, *(i for word in tokens(text)[:-1] for i in cut(word.encode())), own.end]
        total = 0.0
        for target in range(1, len(ids)):
            window = 0 if target <= c.context else -(-(target - c.context) // c.stride)
            total += class_logs(ids[window * c.stride:target])[v.class_of[ids[target]]] + v.log_within[ids[target]]
        out.append(total / math.log(10))
    return out


def test_scores_equal_brute_force(spark, pieces):
    random = np.random.default_rng(5)
    words = ["the", "house", "éÉ", "日本語", "antidisestablishmentarianism", "x", "running", "z" * 70, "Garden"]
    texts = [" ".join(random.choice(words, n)) for n in (1, 4, 9, 10, 25, 60, 200)] + [None, "", " \t", "unseen wordstock"]
    training = spark.createDataFrame([(t,) for t in texts[:-1]], "text string")
    config = lm.LmConfig(rounds=((0, lm.SHARES),) * 4, batch=8)
    own = lm.Pieces(pieces)
    model = lm.train(training, lm.gather(training, own), own, config)
    assert not np.array_equal(model.weights, lm.Network(config).flat)
    assert model.score_all([lm.words_of(t) for t in texts]) == pytest.approx(plain_scores(model, texts), rel=1e-4)


def test_every_id_of_every_text_is_trained_on_once(pieces, monkeypatch):
    """In all rounds together, at any size: rounds share the texts out, and workers leave no window over."""
    own, config = lm.Pieces(pieces), lm.LmConfig(batch=64)
    assert sorted(n for low, high in config.rounds for n in range(low, high)) == list(range(lm.SHARES))
    learner, steps = lm.Adam(lm.Network(config), 0.01), []
    monkeypatch.setattr(learner, "step", lambda *some: steps.append(some))
    texts = [f"text {n} " + "of words " * (n % 40) for n in range(200)]
    targets = 0
    for at in range(0, 200, 30):
        sequences = own.sequences([lm.words_of(t) for t in texts[at:at + 30]])
        ids, counts, _ = lm.windows(sequences, replace(config, stride=config.context))
        targets += sum(len(s) - 1 for s in sequences)
        learner.learn(ids[:, :-1], ids[:, 1:], counts)
    learner.end()
    assert sum(counts.sum() for _, _, counts in steps) == targets
    assert all(len(rows) == config.batch for rows, _, _ in steps[:-1]) and sum(len(rows) for rows, _, _ in steps) == learner.seen


def test_attention_is_causal_and_a_distribution():
    config = lm.LmConfig(context=6, stride=4, width=8, classes=5, own=10)
    network = lm.Network(config)
    rows = np.random.default_rng(1).integers(0, 15, (4, 6))
    every = np.ones((4, 6), bool)
    whole = sum(np.exp(network.log_probabilities(rows, np.full(24, c), every)) for c in range(5))
    assert np.allclose(whole, 1, atol=1e-5)
    changed = rows.copy()
    changed[:, 4:] = (changed[:, 4:] + 1) % 15
    target = np.zeros(24, int)
    before, after = (network.log_probabilities(r, target, every).reshape(4, 6) for r in (rows, changed))
    assert np.allclose(before[:, :4], after[:, :4]) and not np.allclose(before[:, 4:], after[:, 4:])


def test_gradient():
    config = lm.LmConfig(context=5, stride=3, width=4, classes=3, own=6)
    random = np.random.default_rng(2)
    network = lm.Network(config)
    network.flat += random.standard_normal(len(network.flat)).astype(np.float32) * 0.3
    rows, classes, counts = random.integers(0, 9, (3, 5)), random.integers(0, 3, (3, 5)), random.random((3, 5)) < 0.8

    def loss():
        return -network.log_probabilities(rows, classes[counts], counts).sum() / counts.sum()

    g = network.gradient(rows, classes, counts)
    for i in random.choice(len(g), 60, replace=False):
        kept = network.flat[i]
        network.flat[i] = kept + 1e-2
        up = loss()
        network.flat[i] = kept - 1e-2
        down = loss()
        network.flat[i] = kept
        assert g[i] == pytest.approx((up - down) / 2e-2, abs=3e-3)


def test_the_network_learns_order(spark, pieces):
    """Held-out text in the order of the training text is likelier than the same words shuffled."""
    random = np.random.default_rng(3)
    cycle = [f"{a}{b}" for a in "bdfg" for b in "aeio"]
    texts = [" ".join(cycle[(s + k) % 16] for k in range(60)) for s in random.integers(0, 16, 300)]
    shuffled = [" ".join(random.permutation(t.split())) for t in texts[:20]]
    rows = [(i, t, i >= 20) for i, t in enumerate(texts)] + [(1000 + i, t, False) for i, t in enumerate(shuffled)]
    df = spark.createDataFrame(rows, "doc_id long, text string, train boolean")
    found = {r.doc_id: r.score for r in lm.score(df, F.col("train"), pieces, config=lm.LmConfig(rounds=((0, lm.SHARES),) * 8)).collect()}
    assert all(found[i] > found[1000 + i] + 10 for i in range(20))


ODD_TEXTS = ["the cat THE dog", "a cat", None, "", "cat", "cat", "éÉ unseen words\x1chere", " x", "y\t", "\x0b\x0c\r\n", "w" * 90 + " tail", "the " * 50, "q"]


@pytest.mark.parametrize("texts", [
    pa.array(ODD_TEXTS), pa.array(["left out", *ODD_TEXTS]).slice(1), pa.array(ODD_TEXTS).slice(2, 3), pa.array([], pa.string()), pa.array([None], pa.string()), pa.array([" "]),
])
def test_words_of_an_array(texts):
    """As those of each text by itself, found without an object a word; neighbouring texts don't run together."""
    expected = [lm.words_of(t) for t in texts.to_pylist()]
    words = lm.Words.of(texts)
    assert words.per_text.tolist() == [len(t) for t in expected]
    assert words.array().to_pylist() == [w for t in expected for w in t]
    for size in (1, 5, 1000):
        groups = list(words.groups(size))
        assert [n for g in groups for n in g.per_text.tolist()] == words.per_text.tolist()
        assert [w for g in groups for w in g.array().to_pylist()] == words.array().to_pylist()


def test_counting_cuts_each_different_word_once(pieces, monkeypatch):
    own, cut = lm.Pieces(pieces), []
    texts = [" ".join(f"word{n % 7}" for n in range(500)), "éÉ word1 antidisestablishmentarianism", ""] * 3
    expected = np.bincount(own.cut([w for t in texts for w in lm.words_of(t)])[0], minlength=own.end + 1)
    monkeypatch.setattr(lm, "BATCH_CHARACTERS", 20)
    monkeypatch.setattr(own, "cut_words", lambda words, f=own.cut_words: (cut.extend(words.array().to_pylist()), f(words))[1])
    counted = lm.Words.of(pa.array(texts)).array().value_counts()
    assert own.counted(counted.field(0), counted.field(1).to_numpy()).tolist() == expected.tolist()
    assert len(cut) == len(set(cut)) == 9


@pytest.mark.parametrize("frequent", [[], [b"the", b"cat", b"never"]])
def test_frequent_and_other_words_of_each_text(frequent):
    logs = np.arange(1.0, len(frequent) + 1)
    many, base, rare = lm.Frequent(pa.array(frequent, pa.binary()), logs).found(lm.Words.of(pa.array(ODD_TEXTS)))
    for t, n, total, others in zip(ODD_TEXTS, many, base, rare.to_pylist(), strict=True):
        words = lm.words_of(t)
        assert n == sum(w in frequent for w in words)
        assert total == pytest.approx(sum(logs[frequent.index(w)] for w in words if w in frequent))
        assert {r["word"]: r["n"] for r in others} == Counter(w for w in words if w not in frequent) and all(r["n"] for r in others)


@pytest.mark.parametrize("size", [1, 30, 1000])
def test_logits_beyond_the_cut(size):
    """Summed in one pass where no logit needs the cut to 60, and cut where one does."""
    random = np.random.default_rng(4)
    network = lm.Network(lm.LmConfig(width=4, classes=5, own=6))
    network.flat *= size
    hidden, classes = np.maximum(random.standard_normal((50, 4)), 0).astype(np.float32), random.integers(0, 5, 50)
    logits = np.clip(hidden @ network.parts["wc"] + network.parts["bc"], -60, 60).astype(np.float64)
    powers, total, chosen = network.output(hidden, classes)
    assert np.allclose(powers / total, np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True), atol=1e-6)
    assert np.allclose(chosen, logits[np.arange(50), classes], rtol=1e-5) and np.isfinite(np.log(total)).all()
    assert network.output(hidden[:0], classes[:0])[0].shape == (0, 5)
