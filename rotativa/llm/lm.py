"""Language-model scores of whole texts: a causal self-attention model in numpy on subword ids, and a unigram base.

Text model. Words (A-Z lower-cased, split at ASCII white space) are cut into subwords by longest match from the pieces
of up to four bytes of a public byte-level vocabulary; whether a piece begins a word is part of its id, so the ids and
the words of a text determine each other. After each text stands one end id. The next id is predicted in two steps: the
network gives the probability of its class, counts over the whole training corpus that of the id within the class.
Classes are equal shares of those counts, so common ids are a class each. The network is one causal self-attention
layer over ``context`` ids. Long texts are covered by overlapping windows: each begins with the last ``context - stride``
ids of the one before and scores only what follows, so every id is scored once, and windows are computed in batches.

Training. Spark counts words and subwords of all training texts. Then every training text is learned from once: a hash
of the text deals texts to ``rounds``, each a share of the corpus that is the same at every size. In a round, the worker
of each partition begins with the common weights and runs Adam over all windows of its texts as they stream by (there
windows follow each other without an overlap, so that each id is a target once); Spark averages the weights by windows
seen. Nothing is gathered. Training and scoring read ``df`` once a round and twice more, so it should be a stored table.

Base. Counts of words are split by size: words above a count that leaves at most ``FREQUENT`` of them are sent to the
workers (the number is measured), the rest, each rare by construction, are joined by word. So no key is hot.

Null text is the empty text: only its end is scored. A null key is a training row. Rows that repeat are trained on and
scored as often as they stand there. Without training rows counts are zero and the network keeps its first weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, with_workers

FREQUENT = 200_000  # words of which every worker knows the count
PARTIAL_BYTES = 16_000_000  # of words that a worker counts before it hands them on
BATCH_CHARACTERS = 400_000
BATCH_WINDOWS = 160  # layers stay in the processor's cache
LONGEST = 4  # bytes of a piece
SHARES = 16  # equal shares of the training texts by hash
CHUNK = 4096  # weights in a row while they are averaged


@dataclass(frozen=True)
class LmConfig:
    context: int = 16
    stride: int = 13
    width: int = 16
    classes: int = 64
    own: int = 4096  # ids with an embedding of their own; others share that of their class
    rounds: tuple[tuple[int, int], ...] = ((0, 1), (1, 4), (4, SHARES))  # shares from, to; repeat them for more passes
    rate: float = 0.02
    batch: int = 128
    smoothing: float = 0.5
    seed: int = 42


LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
IN_WORD = np.array([bool(bytes([n]).split()) for n in range(256)])


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


@dataclass
class Words:
    """The words of some texts in a row: their bytes, the length of each, and how many each text has."""
    raw: np.ndarray
    lengths: np.ndarray
    per_text: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array) -> Words:
        """As ``words_of`` finds them in each text."""
        begin, data = pieces_of(texts.fill_null("").cast(pa.binary()))
        inside = IN_WORD[data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edges = begin[(begin > 0) & (begin < len(data))]  # a word ends with its text
        first[edges], last[edges - 1] = inside[edges], inside[edges - 1]
        starts = np.flatnonzero(first)
        return cls(LOWER[data[inside]], np.flatnonzero(last) + 1 - starts, np.diff(np.searchsorted(starts, begin)))

    @classmethod
    def listed(cls, texts: list[list[bytes]]) -> Words:
        lengths = [len(word) for text in texts for word in text]
        raw = np.frombuffer(b"".join(chain.from_iterable(texts)), np.uint8)
        return cls(raw, np.array(lengths, np.int64), np.array([len(text) for text in texts], np.int64))

    def array(self) -> pa.Array:
        offsets = np.concatenate([[0], np.cumsum(self.lengths)]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(self.lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(self.raw))])

    def groups(self, size: int) -> Iterator[Words]:
        """Some texts at a time, of about ``size`` bytes, so that memory follows the longest text and not the batch."""
        word, byte = np.concatenate([[0], np.cumsum(self.per_text)]), np.concatenate([[0], np.cumsum(self.lengths)])
        turn = byte[word[:-1]] // size
        for low, high in pairwise([0, *(np.flatnonzero(np.diff(turn)) + 1).tolist(), len(turn)]):
            if low < high:
                a, b = word[low], word[high]
                yield Words(self.raw[byte[a]:byte[b]], self.lengths[a:b], self.per_text[low:high])


def pieces_of(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each value of a binary array without nulls begins and the last ends, and the bytes of all."""
    _, offsets, data = values.buffers()
    if not len(values):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(offsets, np.int32)[values.offset:values.offset + len(values) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0]:offsets[-1]]


class Pieces:
    """Ids of the subwords: twice the piece's number, one more inside a word; then the end, then the start."""

    def __init__(self, pieces: list[bytes]):
        short = sorted({p for p in pieces if 2 <= len(p) <= LONGEST and p == p.lower() and len(p.split()) == 1 and p.split()[0] == p})
        self.end, self.start = 2 * (256 + len(short)), 2 * (256 + len(short)) + 1
        self.codes, self.numbers = {}, {}
        for n in range(2, LONGEST + 1):
            of_n = sorted((int.from_bytes(p, "little"), 256 + i) for i, p in enumerate(short) if len(p) == n)
            self.codes[n] = np.array([c for c, _ in of_n] or [0], np.uint32)
            self.numbers[n] = np.array([i for _, i in of_n] or [-1], np.int32)
        self.tables = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"tables": None}  # workers make their own

    def _lookups(self) -> tuple:
        """Tables from bytes to numbers: by value for two and three bytes, by a multiplicative hash without collisions
        for four. Reading a place costs a fraction of a binary search."""
        if self.tables is None:
            pairs, triples, fours = (np.full(1 << bits, -1, np.int16) for bits in (16, 24, 24))
            pairs[self.codes[2]] = self.numbers[2]
            triples[self.codes[3]] = self.numbers[3]
            random = np.random.default_rng(0)
            while True:
                factor = np.uint32(random.integers(1 << 31, 1 << 32) | 1)
                slots = (self.codes[4] * factor) >> np.uint32(8)
                if len(np.unique(slots)) == len(slots):
                    break
            fours[slots] = self.numbers[4]
            of_number = np.zeros(max(256, self.end // 2), np.uint32)
            of_number[self.numbers[4][self.numbers[4] >= 0]] = self.codes[4][self.numbers[4] >= 0]
            self.tables = pairs, triples, fours, factor, of_number
        return self.tables

    def cut(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each word has."""
        return self.cut_words(Words.listed([words]))

    def cut_words(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        if not len(words.lengths):
            return np.empty(0, np.int32), np.empty(0, np.int64)
        left = words.lengths
        at = np.cumsum(left) - left
        starts = at
        raw = np.concatenate([words.raw, np.zeros(LONGEST, np.uint8)])
        size = len(raw) - LONGEST
        four = np.ascontiguousarray(raw[:size + 1]).astype(np.uint32)
        for k in range(1, LONGEST):
            four |= raw[k:size + 1 + k].astype(np.uint32) << np.uint32(8 * k)
        found, inside = np.full(size, -1, np.int32), 0
        pairs, triples, fours, factor, of_number = self._lookups()
        while len(at):
            code = four[at]
            number, length = (code & 255).astype(np.int32), np.ones(len(at), np.int64)
            quad = fours[(code * factor) >> np.uint32(8)]
            checked = np.where(of_number[quad] == code, quad, -1)
            for n, own in ((2, pairs[code & 0xFFFF]), (3, triples[code & 0xFFFFFF]), (4, checked)):
                hit = (own >= 0) & (left >= n)
                np.copyto(number, own, where=hit)
                np.copyto(length, n, where=hit)
            found[at] = 2 * number + inside
            at, left, inside = at + length, left - length, 1
            rest = np.flatnonzero(left)
            at, left = at[rest], left[rest]
        marked = found >= 0
        upto = np.concatenate([[0], np.cumsum(marked)])
        return found[marked], np.diff(np.append(upto[starts], upto[-1]))

    def counted(self, words: pa.Array, n: np.ndarray) -> np.ndarray:
        """How often each id stands in words that stand ``n`` times each."""
        of_ids, (begin, raw) = np.zeros(self.end + 1), pieces_of(words)
        every = Words(raw, np.diff(begin), np.ones(len(words), np.int64))
        at = 0
        for some in every.groups(BATCH_CHARACTERS):
            ids, per_word = self.cut_words(some)
            of_ids += np.bincount(ids, np.repeat(n[at:at + len(per_word)], per_word), len(of_ids))
            at += len(per_word)
        return of_ids.astype(np.int64)

    def sequences(self, texts: list[list[bytes]] | Words) -> list[np.ndarray]:
        """start, ids, end of each text."""
        words = texts if isinstance(texts, Words) else Words.listed(texts)
        ids, per_word = self.cut_words(words)
        ends = np.concatenate([[0], np.cumsum(per_word)])[np.cumsum(words.per_text)]
        parts = np.split(ids, ends[:-1])
        first, last = np.array([self.start], np.int32), np.array([self.end], np.int32)
        return [np.concatenate([first, part, last]) for part in parts]


def windows(sequences: list[np.ndarray], config: LmConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inputs and the next id, which targets count, text of each window): every target counts in one window."""
    targets = np.array([len(s) - 1 for s in sequences])
    many = 1 + np.maximum(0, -(-(targets - config.context) // config.stride))
    text = np.repeat(np.arange(len(sequences)), many)
    begin = (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)) * config.stride
    offsets = np.cumsum(targets + 1) - (targets + 1)
    inside = np.arange(config.context + 1)
    place = begin[:, None] + inside
    flat = np.concatenate([*sequences, np.zeros(1, np.int32)])
    ids = flat[np.minimum(place, targets[text][:, None]) + offsets[text][:, None]]
    counts = (place[:, :-1] < targets[text][:, None]) & ((begin[:, None] == 0) | (inside[:-1] >= config.context - config.stride))
    return ids, counts, text


def times(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """x @ w as one product instead of one per window."""
    return (x.reshape(-1, x.shape[-1]) @ w).reshape(*x.shape[:-1], w.shape[1])


def sums(x: np.ndarray) -> np.ndarray:
    """Over the last axis, which stays; a product with ones is several times faster than a sum of short rows."""
    return times(x, np.ones((x.shape[-1], 1), x.dtype))


class Network:
    """class of the next id = softmax(relu(x W1 + attention(x) W2 + b) Wc + bc); queries and keys share one matrix."""

    def __init__(self, config: LmConfig, weights: np.ndarray | None = None):
        d, c = config.width, config.classes
        self.shapes = {
            "ids": (config.own + c + 1, d), "places": (config.context, d), "keys": (d, d), "w1": (d, d), "w2": (d, d),
            "b": (d,), "wc": (d, c), "bc": (c,),
        }
        self.config = config
        self.mask = np.tril(np.ones((config.context, config.context), np.float32))
        if weights is None:
            random = np.random.default_rng(config.seed)
            weights = np.concatenate([
                (random.standard_normal(int(np.prod(s))) * (0.0 if len(s) == 1 else 0.1 if n in ("ids", "places") else s[0] ** -0.5)) for n, s in self.shapes.items()
            ])
        self.flat = weights.astype(np.float32)
        self.parts, at = {}, 0
        for name, shape in self.shapes.items():
            self.parts[name] = self.flat[at:at + int(np.prod(shape))].reshape(shape)
            at += int(np.prod(shape))

    def forward(self, rows: np.ndarray) -> tuple:
        """All layers up to the hidden one."""
        p = self.parts
        x = np.take(p["ids"], rows, axis=0)
        x += p["places"]
        query = times(x, p["keys"])
        scores = query @ x.transpose(0, 2, 1)
        scores *= np.float32(self.config.width ** -0.5)
        np.clip(scores, -30, 30, out=scores)
        np.exp(scores, out=scores)
        scores *= self.mask
        scores /= sums(scores)
        mixed = scores @ x
        hidden = times(x, p["w1"])
        hidden += times(mixed, p["w2"])
        hidden += p["b"]
        np.maximum(hidden, 0, out=hidden)
        return x, query, scores, mixed, hidden

    def output(self, hidden: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each place: exp() of the logits, their sum, and the logit of its class. So that nothing overflows, logits are
        cut to 60 either way; that takes a pass of its own only where it would change the sum."""
        p = self.parts
        out = hidden @ p["wc"]
        out += p["bc"]
        chosen = np.clip(out.reshape(-1)[np.arange(0, out.size, out.shape[1]) + classes], -60, 60)
        with np.errstate(over="ignore"):
            total = sums(np.exp(out, out=out))
        if len(out) and not (total.min() > 1e-9 and total.max() < 1e26):
            np.matmul(hidden, p["wc"], out=out)
            out += p["bc"]
            total = sums(np.exp(np.clip(out, -60, 60, out=out), out=out))
        return out, total, chosen

    def log_probabilities(self, rows: np.ndarray, classes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Natural logarithm of the probability of the class of each target that counts; ``classes`` are of those."""
        hidden = self.forward(rows)[-1]
        _, total, chosen = self.output(np.take(hidden.reshape(-1, hidden.shape[2]), np.flatnonzero(counts), axis=0), classes)
        return chosen - np.log(total[:, 0])

    def gradient(self, rows: np.ndarray, classes: np.ndarray, counts: np.ndarray, out: Network | None = None) -> np.ndarray:
        """Of the mean loss over the targets that count; written into the weights of ``out``."""
        p, c = self.parts, self.config
        x, query, scores, mixed, hidden = self.forward(rows)
        out = out or Network(c, self.flat)
        g = out.parts
        flat = lambda a: a.reshape(-1, a.shape[-1])
        classes, share = classes.reshape(-1), counts.reshape(-1, 1) * np.float32(1 / max(1, counts.sum()))
        slopes, total, _ = self.output(flat(hidden), classes)
        slopes *= share / total
        slopes.reshape(-1)[np.arange(0, slopes.size, c.classes) + classes] -= share[:, 0]
        np.matmul(flat(hidden).T, slopes, out=g["wc"])
        ones = np.ones(classes.size, np.float32)
        np.matmul(ones, slopes, out=g["bc"])
        dh = times(slopes, p["wc"].T).reshape(hidden.shape)
        dh *= hidden > 0
        np.matmul(ones, flat(dh), out=g["b"])
        np.matmul(flat(x).T, flat(dh), out=g["w1"])
        np.matmul(flat(mixed).T, flat(dh), out=g["w2"])
        dx, dmixed = times(dh, p["w1"].T), times(dh, p["w2"].T)
        dx += scores.transpose(0, 2, 1) @ dmixed
        ds = dmixed @ x.transpose(0, 2, 1)
        ds -= sums(ds * scores)
        ds *= scores
        ds *= np.float32(c.width ** -0.5)
        dq = ds @ x
        dx += times(dq, p["keys"].T) + ds.transpose(0, 2, 1) @ query
        np.matmul(flat(x).T, flat(dq), out=g["keys"])
        np.sum(dx, axis=0, out=g["places"])
        cells = rows.reshape(-1, 1) * c.width + np.arange(c.width)
        g["ids"][:] = np.bincount(cells.reshape(-1), dx.reshape(-1), g["ids"].size).reshape(g["ids"].shape)
        return out.flat


class Adam:
    """Steps over a stream of windows; those that don't fill a batch wait for the next ones."""

    def __init__(self, network: Network, rate: float):
        self.network, self.rate, self.steps, self.seen, self.waiting = network, rate, 0, 0, None
        self.first, self.second = np.zeros_like(network.flat), np.zeros_like(network.flat)
        self.slope = Network(network.config, network.flat)

    def step(self, *some: np.ndarray) -> None:
        self.steps += 1
        t, g = self.steps, self.network.gradient(*some, self.slope)
        rate = self.rate * (1 + t / 500) ** -0.5 * (1 - 0.99 ** t) ** 0.5 / (1 - 0.9 ** t)
        self.first *= 0.9  # both moments are kept without their factors 0.1 and 0.01, which cancel out
        self.first += g
        self.second *= 0.99
        self.second += np.square(g, out=g)
        change = np.sqrt(self.second, out=g)
        change += 1e-5
        np.divide(self.first, change, out=change)
        change *= rate
        self.network.flat -= change

    def learn(self, *new: np.ndarray) -> None:
        """rows, classes, counts of windows; taken in mixed order, since neighbours come from one text."""
        self.seen += len(new[0])
        order = np.random.default_rng(self.seen).permutation(len(new[0]))
        new = [part[order] for part in new]
        if self.waiting is not None:
            new = [np.concatenate(pair) for pair in zip(self.waiting, new)]
        batch = self.network.config.batch
        whole = len(new[0]) // batch * batch
        for at in range(0, whole, batch):
            self.step(*(part[at:at + batch] for part in new))
        self.waiting = [part[whole:] for part in new]

    def end(self) -> None:
        if self.waiting is not None and len(self.waiting[0]):
            self.step(*self.waiting)
        self.waiting = None


class Vocabulary:
    """What the counts of ids give: classes, embeddings' rows, and the probability of an id within its class."""

    def __init__(self, counts: np.ndarray, config: LmConfig):
        order = np.argsort(-counts, kind="stable")
        mass = counts + config.smoothing
        upto = np.cumsum(mass[order])
        self.class_of = np.empty(len(counts), np.int64)
        self.class_of[order] = np.minimum((upto - mass[order] / 2) / upto[-1] * config.classes, config.classes - 1).astype(np.int64)
        self.log_within = np.log(mass / np.bincount(self.class_of, mass, config.classes)[self.class_of])
        self.row_of = config.own + self.class_of
        self.row_of[order[:config.own]] = np.arange(min(config.own, len(order)))
        self.row_of = np.append(self.row_of, config.own + config.classes)  # the start


@dataclass
class Model:
    pieces: Pieces
    vocabulary: Vocabulary
    weights: np.ndarray
    config: LmConfig

    def score_all(self, texts: list[list[bytes]] | Words) -> np.ndarray:
        """log10 of the model's probability of each text."""
        network, v = Network(self.config, self.weights), self.vocabulary
        ids, counts, text = windows(self.pieces.sequences(texts), self.config)
        many = len(texts.per_text if isinstance(texts, Words) else texts)
        total = np.zeros(many)
        for at in range(0, len(ids), BATCH_WINDOWS):
            some = slice(at, at + BATCH_WINDOWS)
            used = counts[some]
            nexts = ids[some, 1:][used]
            found = network.log_probabilities(np.take(v.row_of, ids[some, :-1]), np.take(v.class_of, nexts), used)
            found = found + np.take(v.log_within, nexts)
            total += np.bincount(np.repeat(text[some], used.sum(axis=1)), found, many)
        return total / np.log(10)


GATHERED = "kind string, word binary, id int, n long"


def gather(training: DataFrame, pieces: Pieces) -> DataFrame:
    """Partial counts of words and ids of all ``training`` texts (column text); stored."""
    shared = with_workers(training.sparkSession).sparkContext.broadcast(pieces)
    shape = pa.schema([("kind", pa.string()), ("word", pa.binary()), ("id", pa.int32()), ("n", pa.int64())])

    def rows(kind: str, n: np.ndarray, word: pa.Array | None = None, ids: np.ndarray | None = None) -> pa.RecordBatch:
        columns = [pa.array([kind] * len(n)), pa.nulls(len(n), pa.binary()) if word is None else word]
        columns += [pa.nulls(len(n), pa.int32()) if ids is None else pa.array(ids, pa.int32()), pa.array(n, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, schema=shape)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, waiting, size = shared.value, [], 0
        of_ids, texts_seen = np.zeros(own.end + 1, np.int64), 0
        for texts in chain((batch.column(0) for batch in batches), [None]):
            if texts is not None:
                texts_seen += len(texts)
                words = Words.of(texts)
                waiting.append(words.array())
                size += len(words.raw)
            if waiting and (texts is None or size > PARTIAL_BYTES):
                counted = pa.chunked_array(waiting).value_counts()
                different, n = counted.field(0), counted.field(1).to_numpy()
                of_ids += own.counted(different, n)
                yield rows("word", n, word=different)
                waiting, size = [], 0
        of_ids[own.end] = texts_seen
        seen = np.flatnonzero(of_ids)
        yield rows("id", of_ids[seen], ids=seen)
        yield rows("text", np.array([texts_seen]))

    return stored(training.select("text").mapInArrow(read, GATHERED), "gathered")


def train(training: DataFrame, gathered: DataFrame, pieces: Pieces, config: LmConfig) -> Model:
    counted = gathered.where("kind = 'id'").groupBy("id").agg(F.sum("n").alias("n")).collect()  # the vocabulary
    counts = np.zeros(pieces.end + 1)
    for r in counted:
        counts[r["id"]] = r["n"]
    vocabulary = Vocabulary(counts, config)
    spark, weights = training.sparkSession, Network(config).flat
    given = spark.sparkContext.broadcast((pieces, vocabulary))
    share = F.pmod(F.xxhash64("text"), F.lit(SHARES))
    for turn, (low, high) in enumerate(config.rounds):
        shared = spark.sparkContext.broadcast(weights)

        def learn(batches: Iterator[pa.RecordBatch], shared=shared, turn=turn) -> Iterator[pa.RecordBatch]:
            own, v = given.value
            learner = Adam(Network(config, shared.value.copy()), config.rate * (1 + turn) ** -0.5)
            for some in (s for batch in batches for s in Words.of(batch.column(0)).groups(BATCH_CHARACTERS)):
                ids, counts, _ = windows(own.sequences(some), replace(config, stride=config.context))
                learner.learn(v.row_of[ids[:, :-1]], v.class_of[np.where(counts, ids[:, 1:], 0)], counts)
            learner.end()
            if learner.seen:
                flat = learner.network.flat
                cut = [flat[a:a + CHUNK].astype(np.float64).tolist() for a in range(0, len(flat), CHUNK)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(len(cut)), pa.int32()), pa.array(cut, pa.list_(pa.float64())), pa.array([float(learner.seen)] * len(cut))],
                    ["chunk", "weights", "seen"],
                )

        chosen = training.where((share >= low) & (share < high)).select("text")
        learned = chosen.mapInArrow(learn, "chunk int, weights array<double>, seen double")
        mean = learned.groupBy("chunk").agg(Summarizer.mean(array_to_vector("weights"), F.col("seen")).alias("mean"))
        found = sorted(mean.select("chunk", vector_to_array("mean").alias("mean")).collect())  # one network
        if found:
            weights = np.concatenate([r["mean"] for r in found]).astype(np.float32)
    return Model(pieces, vocabulary, weights, config)


@dataclass
class Frequent:
    words: pa.Array
    logs: np.ndarray

    def found(self, words: Words) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Of each text: how many of its words are frequent, the sum of their logs, and the other words with their counts."""
        texts, every = len(words.per_text), words.array()
        text = np.repeat(np.arange(texts), words.per_text)
        place = pc.index_in(every, value_set=self.words).fill_null(-1).to_numpy()
        hit = place >= 0
        other = every.filter(pa.array(~hit)).dictionary_encode()
        size = max(1, len(other.dictionary))
        pairs, n = np.unique(text[~hit] * size + other.indices.to_numpy(), return_counts=True)
        rare = pa.StructArray.from_arrays([other.dictionary.take(pa.array(pairs % size)), pa.array(n, pa.int64())], ["word", "n"])
        upto = np.searchsorted(pairs, np.arange(texts + 1) * size)
        return (
            np.bincount(text[hit], minlength=texts), np.bincount(text[hit], self.logs[place[hit]], texts),
            pa.ListArray.from_arrays(pa.array(upto, pa.int32()), rare),
        )


def word_counts(gathered: DataFrame) -> DataFrame:
    return stored(gathered.where("kind = 'word'").groupBy("word").agg(F.sum("n").alias("c")), "words")


def least_frequent(counts: DataFrame, most: int = FREQUENT) -> int:
    """The smallest power of two such that at most ``most`` words have this count or more."""
    by_size = sorted(counts.groupBy(F.floor(F.log2("c")).cast("int").alias("size")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True)
    words, least = 0, (by_size[0]["size"] + 1 if by_size else 0)
    for r in by_size:
        words += r["n"]
        if words > most:
            break
        least = r["size"]
    return 1 << least


def score(df: DataFrame, train_on, pieces: list[bytes], key: str = "doc_id", text: str = "text", config: LmConfig = LmConfig()) -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score) of every row; ``train_on`` is the condition of a training row."""
    spark = with_workers(df.sparkSession)
    own = Pieces(pieces)
    training = df.where(train_on).select(F.col(text).alias("text"))
    gathered = gather(training, own)
    counts = word_counts(gathered)
    texts = gathered.where("kind = 'text'").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    tokens, different = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    tokens, different = tokens + texts, different + bool(texts)
    below = tokens + 0.5 * (different + 1)
    end_log = float(np.log10((texts + 0.5) / below))
    least = least_frequent(counts)
    common = counts.where(F.col("c") >= least).collect()  # at most FREQUENT words
    frequent = Frequent(pa.array([bytes(r["word"]) for r in common], pa.binary()), np.log10((np.array([r["c"] for r in common], float) + 0.5) / below))
    shared = spark.sparkContext.broadcast((train(training, gathered, own, config), frequent))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = shared.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            words = Words.of(batch.column(1))
            many = len(words.per_text)
            of_frequent, base, rare = known.found(words)
            scores = [model.score_all(some) for some in words.groups(BATCH_CHARACTERS)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(np.arange(row, row + many)), pa.array(words.per_text + 1), pa.array(of_frequent), pa.array(base, pa.float64()), rare,
                pa.array(np.concatenate([np.zeros(0), *scores])),
            ], ["key", "row", "n_tokens", "frequent", "base", "rare", "score"])
            row += many

    shape = "key long, row long, n_tokens long, frequent long, base double, rare array<struct<word:binary,n:bigint>>, score double"
    scored = stored(df.select(F.col(key).cast("long"), F.col(text)).mapInArrow(read, shape), "scored")
    rare = scored.select("row", F.inline("rare")).join(counts.where(F.col("c") < least), "word", "left")
    of_row = rare.groupBy("row").agg(
        F.sum(F.col("n") * F.log10((F.coalesce("c", F.lit(0)) + 0.5) / F.lit(below))).alias("rest"),
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known"),
    )
    return scored.drop("rare").join(of_row, "row", "left").select(
        F.col("key").alias(key), "n_tokens",
        (F.col("frequent") + F.coalesce("known", F.lit(0)) + int(texts > 0)).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest", F.lit(0.0)) + F.lit(end_log)).alias("base_score"), "score",
    )
