"""Token counts by rank-synchronous merging of ragged arrays.

A vocabulary of merges with word ends (the JSON form of the tokenizers library) is applied to many pre-tokens at once.
Their symbols lie in one flat array beside the row they belong to. In each round every row finds its own lowest-rank
pair, all rows apply theirs at the same time, and rows without a pair left drop out; what survives is counted. Ranks of
pairs are kept and looked up again only beside a merge, so a long row costs array passes, not lookups.

All places of a row's pair are merged in one round where that is what merging one by one gives: every rule stands after
the rules that make its parts, and no two make the same symbol. Otherwise a round merges a row's leftmost place alone.

Normalisation and the cut into pre-tokens are those of the library. Pre-tokens hold no white space, so a text is a list
of words between ASCII white space, a worker remembers a bounded number of words, and equal words of a batch are merged
once. Special tokens in a text count as one each, as the library does by default; none are added. Null text is the empty
text with no tokens. Work is local to a row: no shuffle, no hot key. Other columns are left alone; a column of the name
of the result is replaced.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import kept_by_worker, with_workers

WORDS = 500_000  # words a worker remembers, about 75 MB
LONG_WORD = 64  # bytes; longer ones are merged each time
BYTES_AT_ONCE = 1_000_000  # texts cut together
NONE = np.iinfo(np.int32).max  # rank of a pair that doesn't merge


def read_tokenizer(spark: SparkSession, path: str) -> str:
    """The tokenizer file as one string; the path is one that Spark reads."""
    return spark.read.text(path if "://" in path else f"file://{path}", wholetext=True).first().value


class Merges:
    """The rules of a vocabulary as sorted arrays: pair of symbols, its rank, the symbol it becomes."""

    def __init__(self, vocab: dict[str, int], rules: list[tuple[str, str]], suffix: str):
        self.size = max(vocab.values(), default=0) + 1
        made = {a + b: rank for rank, (a, b) in enumerate(rules)}
        self.ordered = len(made) == len(rules) and all(
            made.get(part, -1) < rank for rank, rule in enumerate(rules) for part in rule
        )
        pairs = {vocab[a] * self.size + vocab[b]: (rank, vocab[a + b]) for rank, (a, b) in enumerate(rules)}
        self.pairs = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.pairs.tolist()], np.int32)
        self.becomes = np.array([pairs[k][1] for k in self.pairs.tolist()], np.int32)
        self.inner, self.last = np.full(0x200, -1, np.int32), np.full(0x200, -1, np.int32)
        for symbol, number in vocab.items():
            if len(symbol) == 1:
                self.inner[ord(symbol)] = number
            if len(symbol) == 1 + len(suffix) and symbol.endswith(suffix):
                self.last[ord(symbol[0])] = number

    def symbols(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """First symbols of all pre-tokens in one array, and the number of each pre-token's."""
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        codes = np.frombuffer("".join(tokens).encode("utf-32-le"), np.uint32)
        flat = self.inner[codes]
        ends = np.cumsum(lengths) - 1
        flat[ends] = self.last[codes[ends]]
        if len(flat) and flat.min() < 0:
            raise ValueError("the vocabulary has no symbol for a byte")
        return flat, lengths

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.pairs):
            return np.full(len(left), NONE, np.int32), np.zeros(len(left), np.int32)
        pair = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        found = self.pairs[at] == pair
        return np.where(found, self.ranks[at], NONE), self.becomes[at]

    def counts(self, tokens: list[str]) -> np.ndarray:
        """Surviving symbols of each pre-token (none is empty)."""
        left = np.zeros(len(tokens), np.int64)
        if not tokens:
            return left
        flat, lengths = self.symbols(tokens)
        rows = np.arange(len(tokens))  # rows still at work, and their symbols: flat, owner, rank, becomes
        owner = np.repeat(rows, lengths)
        rank, becomes = self._pairs(flat, owner, np.arange(len(flat)))
        while True:
            starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            lowest = np.minimum.reduceat(rank, starts)
            done = lowest == NONE
            if done.any():
                left[rows[done]] = lengths[done]
                if done.all():
                    return left
                stay = np.repeat(~done, lengths)
                rows, lengths, lowest = rows[~done], lengths[~done], lowest[~done]
                flat, rank, becomes = flat[stay], rank[stay], becomes[stay]
                owner = np.repeat(np.arange(len(rows)), lengths)
            places = np.flatnonzero(rank == lowest[owner])
            if not self.ordered:
                places = places[np.unique(owner[places], return_index=True)[1]]
            # Of places that overlap (a pair of one symbol twice), every second counts from the left.
            opens = np.concatenate(([True], np.diff(places) > 1)) | np.concatenate(([True], np.diff(owner[places]) > 0))
            since = np.arange(len(places)) - np.maximum.accumulate(np.where(opens, np.arange(len(places)), 0))
            places = places[since % 2 == 0]
            flat[places] = becomes[places]
            stay = np.ones(len(flat), bool)
            stay[places + 1] = False
            lengths = lengths - np.bincount(owner[places], minlength=len(rows))
            places = places - np.arange(len(places))
            flat, owner, rank, becomes = flat[stay], owner[stay], rank[stay], becomes[stay]
            touched = np.zeros(len(flat), bool)
            touched[places] = touched[places[places > 0] - 1] = True
            beside = np.flatnonzero(touched)
            rank[beside], becomes[beside] = self._pairs(flat, owner, beside)

    def _pairs(self, flat: np.ndarray, owner: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of the pairs that begin at the places given; the last symbol of a row begins none."""
        after = np.minimum(at + 1, len(flat) - 1)
        rank, becomes = self.look_up(flat[at], flat[after])
        return np.where((after > at) & (owner[after] == owner[at]), rank, NONE), becomes


class Counter:
    """Counts tokens of texts inside a worker."""

    def __init__(self, file: str):
        import regex
        import tokenizers

        spec = json.loads(file)
        model = spec["model"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or odd:
            raise ValueError(f"only plain merges are counted here, not {odd or model['type']}")
        rules = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merges = Merges(model["vocab"], rules, model["end_of_word_suffix"] or "")
        special = spec["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in special):
            raise ValueError("special tokens that depend on what surrounds them aren't counted here")
        names = sorted((t["content"] for t in special), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, names))) if names else None
        self.marks = tuple(name.encode() for name in names)
        steps = tokenizers.Tokenizer.from_str(json.dumps(
            spec | {"added_tokens": [], "post_processor": None, "model": model | {"vocab": {}, "merges": []}}
        ))
        normal, cut = steps.normalizer, steps.pre_tokenizer
        self.normal = normal.normalize_str if normal else str
        self.cut = cut.pre_tokenize_str
        if self.pre_tokens("a \t\n\r\x0b\x0c b") != self.pre_tokens("a") + self.pre_tokens("b"):
            raise ValueError("pre-tokens of this vocabulary hold white space")
        self.known: dict[bytes, int] = {}

    def pre_tokens(self, text: str) -> list[str]:
        return [token for token, _ in self.cut(self.normal(text))]

    def learn(self, words: set[bytes]) -> dict[bytes, int]:
        """Tokens of each word; equal pre-tokens of all words are merged once."""
        marked = [word for word in words if any(mark in word for mark in self.marks)] if self._marked(words) else []
        spelled = [word.decode() for word in words.difference(marked)]
        plain = [word for word in spelled if len(word.split()) == 1]
        found = self._together(plain)
        if found is None:
            found, plain = {}, []
        alone = {word: (0, self.pre_tokens(word)) for word in set(spelled).difference(plain)}
        for word in marked:
            pieces = self.special.split(word.decode())
            alone[word.decode()] = len(pieces) - 1, list(chain.from_iterable(map(self.pre_tokens, pieces)))
        counted = self._counted(list(chain.from_iterable(tokens for _, tokens in alone.values())))
        found |= {word: special + sum(map(counted.__getitem__, tokens)) for word, (special, tokens) in alone.items()}
        return {word.encode(): n for word, n in found.items()}

    def _marked(self, words: set[bytes]) -> bool:
        whole = b" ".join(words)
        return any(mark in whole for mark in self.marks)

    def _counted(self, tokens: Sequence[str]) -> dict[str, int]:
        different = list(set(tokens))
        return dict(zip(different, self.merges.counts(different).tolist(), strict=True))

    def _together(self, words: list[str]) -> dict[str, int] | None:
        """Words cut as one text; None where its pieces can't be told apart again."""
        normal = self.normal(" ".join(words))
        pieces = normal.split(" ")
        if not words or len(pieces) != len(words):
            return None
        cut = self.cut(normal)
        tokens = [token for token, _ in cut]
        counted = self._counted(tokens)
        begins = np.cumsum([0, *(len(piece) + 1 for piece in pieces)])
        word_of = np.searchsorted(begins, np.fromiter((span[0] for _, span in cut), np.int64, len(cut)), "right") - 1
        sizes = np.fromiter(map(counted.__getitem__, tokens), np.int64, len(tokens))
        found = np.bincount(word_of, weights=sizes, minlength=len(words)).astype(np.int64)
        return dict(zip(words, found.tolist(), strict=True))

    def count_all(self, texts: list[bytes]) -> list[int]:
        split = [text.split() for text in texts]  # bytes are cut at ASCII white space only
        words = set().union(*split)
        new = words.difference(self.known)
        if len(self.known) + len(new) > WORDS:
            self.known, new = {}, words
        self.known |= self.learn(new)
        found = [sum(map(self.known.__getitem__, words)) for words in split]
        if len(self.known) > WORDS:
            self.known = {}
        else:
            for word in new:
                if len(word) > LONG_WORD:
                    del self.known[word]
        return found


class TokenCounter:
    """Counts the tokens of a text column; the tokenizer file goes to the workers as one broadcast (a few MB)."""

    def __init__(self, spark: SparkSession, path: str):
        self.shared = with_workers(spark).sparkContext.broadcast(read_tokenizer(spark, path))

    def count(self, df: DataFrame, text: str = "text", result: str = "n_tokens") -> DataFrame:
        """Adds the number of tokens of each whole text."""
        shared = self.shared

        @F.arrow_udf(T.LongType())
        def counted(texts: pa.Array) -> pa.Array:
            counter = kept_by_worker("token-counts", shared.value, lambda: Counter(shared.value))
            found, some, size = [], [], 0
            for value in texts.cast(pa.large_binary()):
                some.append(value.as_py() or b"")
                size += len(some[-1])
                if size > BYTES_AT_ONCE:
                    found += counter.count_all(some)
                    some, size = [], 0
            return pa.array(found + counter.count_all(some), pa.int64())

        return df.withColumn(result, counted(F.col(text)))


def n_bytes(text: str = "text") -> Column:
    """UTF-8 bytes of the whole text."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
