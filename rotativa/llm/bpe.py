"""Byte-level BPE encoding and decoding through a sentencepiece model written from a vocabulary of ranks.

A ranked byte-level vocabulary and a sentencepiece BPE model describe the same merges: a piece is scored by its
negative rank, so the merge of the lowest rank always comes first, the leftmost on ties. Bytes are mapped to one
character each, since pieces are strings; normalisation is the identity. The model is serialised field by field, never
trained. Texts are cut into pre-tokens by the vocabulary's pattern, and each pre-token is encoded by itself: a piece
that is in the vocabulary as a whole is that piece, as in the usual implementation of such vocabularies.

Work is local to a row, so there is no shuffle and no hot key; a worker keeps a bounded table of pre-tokens seen.
Null text is the empty text: no ids, decoded to no bytes. Ids outside the vocabulary raise on decoding; null ids
decode to null. Other columns are left alone; a column of the name of the result is replaced.
"""

from __future__ import annotations

import base64
import functools
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import kept_by_worker, with_workers

FIRST = 0x100  # byte b is the character FIRST + b: letters without white space or special meaning
KNOWN_TOKENS = 100_000  # pre-tokens a worker remembers
TEXTS_AT_ONCE = 1_000_000  # characters cut together
LONG_TOKEN = 64  # longer pre-tokens are encoded each time
NORMAL, UNKNOWN, BPE = 1, 2, 2  # values of the model format


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | float | bytes) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


BYTE_CHARACTERS = {b: FIRST + b for b in range(256)}


def mapped(raw: bytes) -> str:
    return raw.decode("latin-1").translate(BYTE_CHARACTERS)


def read_ranks(spark: SparkSession, path: str) -> list[tuple[bytes, int]]:
    """(piece, rank) by rank, from lines of base64 and rank; the path is one that Spark reads."""
    lines = spark.read.text(path if "://" in path else f"file://{path}").collect()  # a vocabulary: tens of thousands
    pairs = (line.value.split() for line in lines if line.value.strip())
    return sorted(((base64.b64decode(a), int(b)) for a, b in pairs), key=lambda p: p[1])


def serialise(ranks: list[tuple[bytes, int]]) -> bytes:
    """The sentencepiece model: pieces in the order of rank, the obligatory unknown piece last."""
    pieces = [_field(1, mapped(raw).encode()) + _field(2, -float(rank)) + _field(3, NORMAL) for raw, rank in ranks]
    pieces.append(_field(1, b"<unk>") + _field(2, 0.0) + _field(3, UNKNOWN))
    trainer = _field(3, BPE) + _field(4, len(pieces)) + _field(40, len(ranks))
    trainer += b"".join(_field(n, (1 << 64) - 1) for n in (41, 42, 43))  # -1: no begin, end or padding piece
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normaliser)


@functools.lru_cache(maxsize=1)
def newer_characters() -> str:
    """Letters and digits the regex library knows and the Unicode tables of the tiktoken library don't, as ranges."""
    import regex
    import tiktoken

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    single = {bytes([b]): b for b in range(256)}
    newer: set[str] = set()
    for kind in (r"\p{L}", r"\p{N}"):
        probe = tiktoken.Encoding("probe", pat_str=kind, mergeable_ranks=single, special_tokens={})
        newer |= set(regex.findall(kind, every)) - set(probe.decode(probe.encode_ordinary(every)))
    points, ranges = sorted(map(ord, newer)), []
    for c in points:
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


def narrowed(pattern: str, newer: str) -> str:
    """The pattern with letters and digits that leave out the newer characters."""
    other = "[^\\s\\p{L}\\p{N}]"
    parts = [
        part.replace("\\p{L}", f"[\\p{{L}}--[{newer}]]").replace("\\p{N}", f"[\\p{{N}}--[{newer}]]")
        for part in pattern.split(other)
    ]
    return "(?V1)" + f"[^\\s[[\\p{{L}}\\p{{N}}]--[{newer}]]]".join(parts)


class Coder:
    """Encoder and decoder of one vocabulary inside a worker."""

    def __init__(self, ranks: list[tuple[bytes, int]], pattern: str, newer: str = ""):
        import regex
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(ranks))
        self.ids = {raw: rank for raw, rank in ranks}
        self.order = [rank for _, rank in ranks]
        self.same = self.order == list(range(len(ranks)))
        self.raw = {rank: raw for raw, rank in ranks}
        self.cut = regex.compile(pattern).findall
        self.cut_rare = regex.compile(narrowed(pattern, newer)).findall if newer else self.cut
        self.known: dict[str, tuple[int, ...]] = {}

    def pre_tokens(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")  # far cheaper than a search for rare characters
        except UnicodeEncodeError:
            return self.cut_rare(text)
        return self.cut(text)

    def _learn(self, tokens: set[str]) -> None:
        known, ids, rest = self.known, self.ids, []
        for token in tokens:
            whole = ids.get(token.encode())
            if whole is None:
                rest.append(token)
            else:
                known[token] = (whole,)
        # One NUL between tokens, so that all are mapped at once; tokens that hold one are mapped by themselves.
        plain = [t for t in rest if "\0" not in t]
        rest = plain + [t for t in rest if "\0" in t]
        strings = mapped("\0".join(plain).encode()).split(chr(FIRST)) if plain else []
        strings += [mapped(t.encode()) for t in rest[len(plain):]]
        for token, found in zip(rest, self.model.encode(strings, num_threads=1), strict=True):
            known[token] = tuple(found) if self.same else tuple([self.order[i] for i in found])

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; new pre-tokens of all of them are encoded together."""
        cut = [self.pre_tokens(text or "") for text in texts]
        new = set().union(*cut).difference(self.known)
        if len(self.known) + len(new) > KNOWN_TOKENS:
            self.known = {}
            new = set().union(*cut)
        self._learn(new)
        found = [np.fromiter(chain.from_iterable(map(self.known.__getitem__, tokens)), np.int32) for tokens in cut]
        if len(self.known) > KNOWN_TOKENS:
            self.known = {}
        else:
            for token in new:
                if len(token) > LONG_TOKEN:
                    del self.known[token]
        return found

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids))


class ByteLevelBpe:
    """``encode`` and ``decode`` for DataFrames; the vocabulary goes to the workers as one broadcast (under 2 MB)."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        with_workers(spark)
        self.shared = spark.sparkContext.broadcast((read_ranks(spark, path), pattern, newer_characters()))

    def encode(self, df: DataFrame, text: str = "text", ids: str = "ids") -> DataFrame:
        """Adds the ids of each whole text as array<int>."""
        shared = self.shared

        @F.arrow_udf(T.ArrayType(T.IntegerType()))
        def encoded(texts: pa.Array) -> pa.Array:
            coder = coder_of(shared)
            return _lists([row for some in by_size(texts) for row in coder.encode_all(some)])

        # Marked so that a query that also decodes doesn't encode twice inside one worker.
        return df.withColumn(ids, encoded.asNondeterministic()(F.col(text)))

    def round_trip(self, df: DataFrame, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
        """Adds the ids and the bytes they decode to, by one worker a task instead of one for each direction."""
        shared, both = self.shared, _unused(df, "_round_trip")

        @F.arrow_udf(T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())]))
        def there_and_back(texts: pa.Array) -> pa.Array:
            coder, rows, bytes_ = coder_of(shared), [], []
            for some in by_size(texts):
                found = coder.encode_all(some)
                bytes_ += [coder.decode(row.tolist()) for row in found]
                rows += found
            return pa.StructArray.from_arrays([_lists(rows), pa.array(bytes_, pa.binary())], ["ids", "decoded"])

        coded = df.withColumn(both, there_and_back.asNondeterministic()(F.col(text)))
        return coded.withColumns({ids: F.col(both)["ids"], decoded: F.col(both)["decoded"]}).drop(both)

    def decode(self, df: DataFrame, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
        """Adds the bytes the ids stand for. Its workers hold the list of bytes alone, no encoder."""
        shared = self.shared

        @F.arrow_udf(T.BinaryType())
        def joined(lists: pa.Array) -> pa.Array:
            raw = kept_by_worker("bytes", shared.value, lambda: {rank: piece for piece, rank in shared.value[0]})
            return pa.array([None if x is None else b"".join(map(raw.__getitem__, x)) for x in map(_listed, lists)], pa.binary())

        return df.withColumn(decoded, joined(F.col(ids)))


def by_size(texts: pa.Array) -> Iterator[list[str | None]]:
    """Lists of texts of about a million characters, so that memory follows the longest text and not the batch."""
    some, size = [], 0
    for text in texts:
        some.append(text.as_py())
        size += len(some[-1] or "")
        if size > TEXTS_AT_ONCE:
            yield some
            some, size = [], 0
    if some:
        yield some


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int64).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *rows])))


def _unused(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name += "_"
    return name


def _listed(value) -> list[int] | None:
    return value.values.to_numpy(zero_copy_only=False).tolist() if value.is_valid else None


def coder_of(shared) -> Coder:
    """One coder per worker process; the broadcast value is one object in a worker."""
    return kept_by_worker("coder", shared.value, lambda: Coder(*shared.value))
