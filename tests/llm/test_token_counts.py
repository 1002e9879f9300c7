"""Token counts beside the library that owns the vocabulary, and rank-synchronous merging beside merging one by one."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rotativa.llm import token_counts
from rotativa.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " ", "\n\n\t x", "a" * 20_000, "日本語 テキスト 😀👍🏽 " * 5, "I'll  DON'T\n\n x\t\ty \x1c\x1d z\x85w\xa0v", "ab\x00c", "ﬁ é é ́ x́ 　 z 12१",
    "\U000323b0 ok \U0001e5f1 7", "ΑΣ ΣΑΣ Σ İstanbul ǅ ẞ", "x " * 3000, "<|endoftext|>", "a<|startoftext|>b<|endoftext|><|endoftext|>", "<|ENDOFTEXT|> <|endoftext| >",
    "''s 's'T'll'''re", "abcdefghij" * 3000, "!?#$%" * 999, "     x", "가나다 각", "zz\x0b\x0cq", "mississippi aaaaaaab",
]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: len(tokenizer.encode(text or "", add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def counter(spark):
    return token_counts.Counter(token_counts.read_tokenizer(spark, PATH))


def test_odd_texts_in_spark(spark, library):
    rows = [(i, t, "clash", 7) for i, t in enumerate(ODD)] + [(None, "a b", None, 1), (1, "a b", None, 1), (1, "a b", None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_bytes string, n_tokens int").repartition(3)
    found = token_counts.TokenCounter(spark, PATH).count(df)
    assert found.columns == df.columns and dict(found.dtypes)["n_tokens"] == "bigint"
    for r in found.collect():
        assert r.n_tokens == library(r.text), r.text[:80]
    assert token_counts.TokenCounter(spark, PATH).count(df.limit(0)).count() == 0


def test_every_character(counter, library):
    texts = [chr(c) for c in range(0x3400) if not 0xD800 <= c < 0xE000] + [f"a{chr(c)}B" for c in range(0x110000) if c % 7 == 0 and not 0xD800 <= c < 0xE000][:30_000]
    assert counter.count_all([t.encode() for t in texts]) == [library(t) for t in texts]


def test_random_texts(counter, library):
    random.seed(5)
    ranges = [(32, 127), (32, 127), (97, 123), (0xA0, 0x250), (0x250, 0xD800), (0xE000, 0x33000)]
    texts = ["".join(chr(random.randrange(*random.choice(ranges))) for _ in range(random.randrange(40))) for _ in range(4000)]
    assert counter.count_all([t.encode() for t in texts]) == [library(t) for t in texts]


def one_by_one(ranks, symbols):
    symbols = list(symbols)
    while True:
        pairs = [(ranks[p], i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in ranks]
        if not pairs:
            return len(symbols)
        _, i = min(pairs)
        symbols[i:i + 2] = [symbols[i] + symbols[i + 1]]


@pytest.mark.parametrize("ordered", [True, False])
def test_merging_beside_one_by_one(ordered):
    random.seed(int(ordered))
    for _ in range(60):
        known, rules = ["a", "b", "c"], []
        for _ in range(random.randrange(12)):
            rule = random.choice(known), random.choice(known)
            if rule not in rules and (not ordered or rule[0] + rule[1] not in known):
                rules.append(rule)
                known = list(dict.fromkeys([*known, "".join(rule)]))
        if not ordered:
            random.shuffle(rules)
        vocab = {s: i for i, s in enumerate(known)}
        merges = token_counts.Merges(vocab, rules, "")
        assert merges.ordered or not ordered
        tokens = ["".join(random.choices("abc", weights=[5, 2, 1], k=random.randrange(1, 30))) for _ in range(40)]
        ranks = {rule: i for i, rule in enumerate(rules)}
        assert merges.counts(tokens).tolist() == [one_by_one(ranks, t) for t in tokens]


def test_words_are_forgotten(spark, library, monkeypatch):
    monkeypatch.setattr(token_counts, "WORDS", 5)
    own = token_counts.Counter(token_counts.read_tokenizer(spark, PATH))
    texts = ["one two three four five six seven eight", "two three", "x" * 100 + " nine ten"]
    for _ in range(2):
        assert own.count_all([t.encode() for t in texts]) == [library(t) for t in texts]
        assert len(own.known) <= 8


def test_query(spark, library):
    rows = QUERIES["op12_token_counts"](spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        n = library(texts[r.doc_id])
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((texts[r.doc_id] or "").encode()), n > 2048)
