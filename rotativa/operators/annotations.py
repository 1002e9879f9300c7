"""Aggregates over token annotations: ``Id, sent_id, tok_id, text, upos, head_id, is_space, is_alpha``.

``tok_id`` numbers the tokens of a sentence and may leave gaps. ``head_id`` is the ``tok_id`` of the head. A token is a
root if it is its own head, if it has none, or if its head is not in the sentence. Of rows with the same ``tok_id`` in
one sentence, the one with the smallest head counts as a head.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

import rotativa

from ..functions import lexicons
from ..functions.style import StyleConfig
from ..session import ship, stored
from .corpus import ID, require_columns
from .skew import salted_join

COLUMNS = ("sent_id", "tok_id", "text", "upos", "head_id", "is_space", "is_alpha")
NO_TAG = "X"

# Fixed value: heads are followed this far.
MAX_DEPTH = 200
DOUBLINGS = 8  # 2**8 > MAX_DEPTH

# Sentences whose token ids lie from 0 to below this are solved as arrays in one row, others in chunks of as many ids,
# between which joins lead: the same depths.
ARRAY_TOKENS = 20_000

FORMAL = ("NOUN", "PROPN", "ADJ", "ADP", "DET")
INFORMAL = ("PRON", "VERB", "AUX", "ADV", "INTJ")


def token_table(tokens: DataFrame, id_col: str = ID) -> DataFrame:
    """Tokens that are no spaces; a missing tag reads ``X``."""
    require_columns(tokens, [id_col, *COLUMNS])
    return tokens.filter(~F.col("is_space")).withColumn("upos", F.coalesce("upos", F.lit(NO_TAG)))


def pos_counts(tokens: DataFrame, id_col: str = ID) -> DataFrame:
    return token_table(tokens, id_col).groupBy(id_col, "upos").agg(F.count(F.lit(1)).alias("n"))


def sentence_counts(config: StyleConfig) -> dict:
    """What is counted in the tokens of a sentence."""
    c = F.col
    real, word = ~c("is_space"), F.lower("text")
    is_word = real & c("is_alpha")
    tag = F.coalesce("upos", F.lit(NO_TAG))

    def count(condition):
        return F.count(F.when(condition, 1))

    return {
        "n_tokens": count(real),
        "n_words": count(is_word),
        "word_chars": F.coalesce(F.sum(F.when(is_word, F.length(word))), F.lit(0)),
        "n_long": count(is_word & (F.length(word) >= lexicons.LONG_WORD)),
        "n_stop": count(is_word & word.isin(*config.stopwords)),
        "n_intensifier": count(is_word & word.isin(*config.intensifiers)),
        "n_hedge": count(is_word & word.isin(*lexicons.HEDGES)),
        "n_se": count(is_word & (word == lexicons.IMPERSONAL)),
        **{
            f"n_{name.lower()}": count(real & (tag == name))
            for name in sorted({*FORMAL, *INFORMAL, "SCONJ"})
        },
    }


def token_stats(
    tokens: DataFrame, config: StyleConfig = StyleConfig(), id_col: str = ID, array_tokens: int = ARRAY_TOKENS
) -> DataFrame:
    """One row per text: counts, sentences, distinct words, mean depth.

    Counts are added up by text before the shuffle. Heads are shuffled by sentence, four bytes a token, of which a row of
    numbers remains. Distinct words are shuffled by text and word and then counted, so that no row holds the words of a
    text, however long it or one of its sentences is. Only sentences too long for one row are read again.
    """
    require_columns(tokens, [id_col, *COLUMNS])
    keys = [id_col, "sent_id"]
    counted = sentence_counts(config)
    is_word = ~F.col("is_space") & F.col("is_alpha")
    links = tokens.select(*keys, "tok_id", "head_id", "is_space")
    stats = tokens.groupBy(id_col).agg(*[expr.alias(name) for name, expr in counted.items()])
    solved = _solved(_sentences(links, keys, array_tokens), [id_col], {"_depth": T.LongType(), "_deep": T.LongType()}, _sums)
    depths = solved.groupBy(F.col(id_col).alias("_of")).agg(
        F.count(F.lit(1)).alias("n_sents"), F.sum("_depth").alias("_depth"), F.sum("_deep").alias("_deep"),
    )
    stats = stats.join(depths, F.col(id_col).eqNullSafe(F.col("_of")), "left")
    words = tokens.filter(is_word & F.col("text").isNotNull()).select(F.col(id_col).alias("_text"), F.lower("text").alias("_word")).distinct()
    different = words.groupBy("_text").agg(F.count("_word").alias("_different"))
    stats = stats.join(different, F.col(id_col).eqNullSafe(F.col("_text")), "left").withColumn("n_distinct", F.coalesce("_different", F.lit(0)))
    depth, deep = F.coalesce("_depth", F.lit(0)), F.coalesce("_deep", F.lit(0))
    long = _long_sentences(links, keys, array_tokens)
    if long is not None:
        more = long.filter(~F.col("is_space")).groupBy(F.col(id_col).alias("_id")).agg(
            F.sum("depth").alias("_more"), F.count("depth").alias("_many")
        )
        stats = stats.join(more, F.col(id_col).eqNullSafe(F.col("_id")), "left")
        depth, deep = depth + F.coalesce("_more", F.lit(0)), deep + F.coalesce("_many", F.lit(0))
    mean = F.when(deep > 0, depth / deep)
    return stats.withColumn("avg_dep_depth", mean).select(
        id_col, *counted, "n_sents", "n_distinct", "avg_dep_depth"
    )


def _outside(array_tokens: int):
    return (F.col("tok_id") < 0) | (F.col("tok_id") >= array_tokens)


# A token in 31 bits: its id, a code for its head, whether it is a space. In this order, heads within an id ascend.
ID_BITS, HEAD_BITS = 16, 1
NO_HEAD, LOW_HEAD, FIRST_HEAD = 0, 1, 2  # missing, below all ids, and the code of head 0
MOST_ARRAY_TOKENS = (1 << (ID_BITS - HEAD_BITS)) - FIRST_HEAD - 1

# So many tokens, or one sentence, are solved at a time.
TOKENS_AT_ONCE = 1 << 20


def _packed(array_tokens: int):
    """A token as an integer; null beyond the limit, where it is left to the joins."""
    if array_tokens > MOST_ARRAY_TOKENS:
        raise ValueError(f"at most {MOST_ARRAY_TOKENS} tokens of a sentence go into one row")
    head = F.col("head_id")
    code = (
        F.when(head.isNull(), NO_HEAD).when(head < 0, LOW_HEAD).when(head >= array_tokens, array_tokens + FIRST_HEAD)
        .otherwise(head.cast("int") + FIRST_HEAD)
    )
    packed = F.shiftleft(F.col("tok_id").cast("int"), ID_BITS) + F.shiftleft(code, HEAD_BITS) + F.coalesce("is_space", F.lit(True)).cast("int")
    return F.when(~_outside(array_tokens), packed)


def _sentences(links: DataFrame, keys: list[str], array_tokens: int) -> DataFrame:
    """``keys, _s, _far``: the tokens of each sentence, and whether some of them are left to the joins."""
    far = F.coalesce(_outside(array_tokens), F.lit(False))
    return _gathered(links.select(*keys, _packed(array_tokens).alias("_t"), far.alias("_far")), keys)


def _gathered(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, _s, _far`` from ``keys, _t, _far``: one row per key, with its numbers ``_t`` as a list of lists in no order.

    A batch's tokens are put together by key before the shuffle. Spark's own partial lists would sort and spill every
    token once a task has seen more than a few keys.
    """
    ship(rows.sparkSession, rotativa)
    kept = [rows.schema[k] for k in keys]
    schema = T.StructType([*kept, T.StructField("_s", T.ArrayType(rows.schema["_t"].dataType)), T.StructField("_far", T.BooleanType())])
    return rows.mapInArrow(_gather, schema).groupBy(*keys).agg(F.collect_list("_s").alias("_s"), F.max("_far").alias("_far"))


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        *keys, links, far = batch.columns
        code = np.zeros(batch.num_rows, np.int64)
        for key in keys:
            encoded = pc.dictionary_encode(key, null_encoding="encode")
            code = code * len(encoded.dictionary) + encoded.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        code = code[order]
        starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        links = links.take(pa.array(order))
        sizes = np.add.reduceat(links.is_valid().to_numpy(zero_copy_only=False).astype(np.int32), starts)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), links.drop_null())
        any_far = np.logical_or.reduceat(far.to_numpy(zero_copy_only=False)[order], starts)
        heads = pa.array(order[starts])
        yield pa.RecordBatch.from_arrays([*[key.take(heads) for key in keys], lists, pa.array(any_far)], names=[*batch.schema.names[:-2], "_s", "_far"])


def _solved(gathered: DataFrame, keep: Sequence[str], found: dict[str, T.DataType], solve: Callable) -> DataFrame:
    """``keep`` and what ``solve`` finds: it takes the columns of a batch's rows, the row of each token and the tokens of
    all rows, in order within a row, and returns the row of each result, or None for one a row, and the results."""
    ship(gathered.sparkSession, rotativa)
    schema = T.StructType([*[gathered.schema[k] for k in keep], *[T.StructField(name, kind) for name, kind in found.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("_s")
            ends = lists.values.offsets.to_numpy()[lists.offsets.to_numpy()]
            at = 0
            while at < batch.num_rows:
                to = max(int(np.searchsorted(ends, int(ends[at]) + TOKENS_AT_ONCE, "right")) - 1, at + 1)
                of = np.repeat(np.arange(to - at), np.diff(ends[at:to + 1]))
                links = lists.values.values.to_numpy()[ends[at]:ends[to]].astype(np.int64)
                if ((links[1:] < links[:-1]) & (of[1:] == of[:-1])).any():
                    links = links[np.lexsort((links, of))]
                part = batch.slice(at, to - at)
                rows, results = solve(part, of, links)
                kept = [part.column(k) if rows is None else part.column(k).take(pa.array(rows)) for k in keep]
                yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, results)], names=schema.names)
                at = to

    return gathered.mapInArrow(run, schema)


def _walked(of, ids, head, span: int):
    """Steps of each token to its root, and the place of that root where they are below the most, by pointer doubling:
    after k rounds a pointer has gone 2**k heads up. Rounds end when no depth changes.

    Ids ascend within a row ``of`` and lie from 0 to below ``span``; heads beyond that are in no row. Of tokens that share an id
    the first counts as a head.
    """
    if not len(ids):
        return ids, ids
    here, places = np.arange(len(ids)), of * span + ids
    wanted = of * span + head
    at = np.minimum(np.searchsorted(places, wanted), len(ids) - 1)
    up = np.where((head >= 0) & (head < span) & (places[at] == wanted) & (head != ids), at, here)
    depth = (up != here).astype(np.int64)
    for _ in range(DOUBLINGS):
        further = np.minimum(depth + depth[up], MAX_DEPTH)
        up = up[up]
        if (further == depth).all():
            break
        depth = further
    return depth, up


def _short_depths(of, links):
    """Ids, whether they are spaces, and depths of tokens as ``_packed``."""
    ids = links >> ID_BITS
    head = ((links & ((1 << ID_BITS) - 1)) >> HEAD_BITS) - FIRST_HEAD
    return ids, (links & 1) == 1, _walked(of, ids, head, 1 << (ID_BITS - HEAD_BITS))[0]


def _sums(part, of, links):
    """For each sentence without far tokens the sum of its depths and their number, spaces aside."""
    _, space, depth = _short_depths(of, links)
    near = ~part.column("_far").to_numpy(zero_copy_only=False)
    counted = of[~space]
    sums = np.bincount(counted, depth[~space], part.num_rows).astype(np.int64)
    return None, [np.where(near, sums, 0), np.where(near, np.bincount(counted, minlength=part.num_rows), 0)]


def _token_depths(part, of, links):
    ids, space, depth = _short_depths(of, links)
    return of[~space], [ids[~space].astype(np.int32), depth[~space].astype(np.int32)]


def _long_sentences(links: DataFrame, keys: list[str], array_tokens: int) -> DataFrame | None:
    """Depths of the sentences that arrays leave out; None if there are none, found by one filter without a shuffle."""
    beyond = links.filter(_outside(array_tokens))
    if beyond.isEmpty():
        return None
    long = beyond.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return _chunked_depths(links.join(long, same, "left_semi"), keys, array_tokens)


# A token of a chunk in 63 bits: its id within the chunk, its head (0: missing), whether it is a space.
CHUNK_HEAD_BITS, FIRST_CHUNK_HEAD = 33, (1 << 31) + 1


def _chunk_packed(array_tokens: int):
    head = F.coalesce(F.col("head_id").cast("int").cast("long") + FIRST_CHUNK_HEAD, F.lit(0).cast("long"))
    within = F.pmod(F.col("tok_id").cast("long"), F.lit(array_tokens))
    return F.shiftleft(within, CHUNK_HEAD_BITS + 1) + F.shiftleft(head, 1) + F.coalesce("is_space", F.lit(True)).cast("long")


CHUNK_FIELDS = {
    "tok_id": T.IntegerType(), "is_space": T.BooleanType(), "first": T.BooleanType(), "depth": T.IntegerType(), "out": T.IntegerType(),
}


def _chunk_depths(array_tokens: int) -> Callable:
    """(tok_id, is_space, first, depth, out) of each token: the steps within the chunk, and the head in another chunk to
    which the last of them leads, if any. Of tokens that share an id the first counts as a head."""
    def solve(part, of, links):
        base = part.column("_c").to_numpy()[of] * array_tokens
        ids, code = links >> (CHUNK_HEAD_BITS + 1), (links >> 1) & ((1 << CHUNK_HEAD_BITS) - 1)
        head = code - FIRST_CHUNK_HEAD
        depth, root = _walked(of, ids, np.where(code > 0, head - base, -1), array_tokens)
        first = np.ones(len(ids), bool)
        first[1:] = (of[1:] != of[:-1]) | (ids[1:] != ids[:-1])
        last = head[root]
        out = (depth < MAX_DEPTH) & (code[root] > 0) & ((last < base) | (last >= base + array_tokens))
        return of, [
            (base + ids).astype(np.int32), (links & 1) == 1, first, depth.astype(np.int32),
            pa.array(np.where(out, last, 0).astype(np.int32), mask=~out),
        ]

    return solve


def _chunked_depths(links: DataFrame, keys: list[str], array_tokens: int) -> DataFrame:
    """Depths in sentences of any length, of which no row holds more than a chunk of ids.

    Chunks are solved as arrays. Of a walk that leaves its chunk only the head it leads to is looked up, and only such
    heads, one row for each, are followed from chunk to chunk by joins.
    """
    size = max(array_tokens, 1)
    chunk = F.floor(F.col("tok_id") / size)
    rows = links.filter(F.col("tok_id").isNotNull()).select(*keys, chunk.alias("_c"), _chunk_packed(size).alias("_t"), F.lit(False).alias("_far"))
    tokens = stored(_solved(_gathered(rows, [*keys, "_c"]), keys, CHUNK_FIELDS, _chunk_depths(size)), "chunks")
    sentence = [F.hash(*keys).alias("_k"), F.xxhash64(*keys).alias("_h")]  # so that null keys meet as well
    columns = [*keys, "tok_id", "is_space", "depth"]
    away = tokens.filter(F.col("out").isNotNull())
    wanted = stored(away.select(*sentence, F.col("out").alias("up")).distinct(), "heads")
    if wanted.isEmpty():
        return tokens.select(*columns)
    on = ["_k", "_h", "up"]
    firsts = tokens.filter("first").select(*sentence, F.col("tok_id").alias("up"), "out", "depth")
    met = _resolved(stored(firsts.join(wanted, on, "left_semi"), "entries"))
    found = salted_join(away.select(*columns, *sentence, F.col("out").alias("up")), met.withColumnRenamed("depth", "more"), on, "left", ["tok_id"])
    further = F.least(F.col("depth") + F.coalesce(F.col("more") + 1, F.lit(0)), F.lit(MAX_DEPTH)).alias("depth")
    return tokens.filter(F.col("out").isNull()).select(*columns).unionByName(found.select(*keys, "tok_id", "is_space", further))


def _resolved(heads: DataFrame) -> DataFrame:
    """(_k, _h, up, depth): the depths of heads ``up``, by the same doubling, one join per round.

    ``heads`` has one row for each with the steps up to ``out``, the next head, which may be missing. Heads that reached their root
    leave the join, and rounds end when none is left. Many heads under one make a hot key: hence the salted join. Each
    round is written, as it is read twice.
    """
    on = ["_k", "_h", "next"]
    known = heads.select("_k", "_h", F.col("up").alias("next"), F.lit(True).alias("known"))
    linked = salted_join(heads.withColumnRenamed("out", "next"), known, on, "left", ["up"])
    there = F.col("known").isNotNull()
    nodes = stored(linked.select(
        "_k", "_h", "up", F.when(there, F.col("next")).alias("next"), F.least(F.col("depth") + there.cast("int"), F.lit(MAX_DEPTH)).alias("depth"),
    ), "depths")
    for _ in range(DOUBLINGS):
        open_ = nodes.filter(F.col("next").isNotNull())
        if open_.isEmpty():
            break
        to = nodes.select("_k", "_h", F.col("up").alias("next"), F.col("next").alias("then"), F.col("depth").alias("more"))
        moved = salted_join(open_, to, on, "inner", ["up"]).withColumn("depth", F.least(F.col("depth") + F.col("more"), F.lit(MAX_DEPTH)))
        further = moved.select("_k", "_h", "up", F.when(F.col("depth") < MAX_DEPTH, F.col("then")).alias("next"), "depth")
        nodes = stored(nodes.filter(F.col("next").isNull()).unionByName(further), "depths")
    return nodes.select("_k", "_h", "up", "depth")


def dep_depth(tokens: DataFrame, id_col: str = ID, array_tokens: int = ARRAY_TOKENS) -> DataFrame:
    """Depth of every token that is no space: steps to the root, at most 200."""
    keys = [id_col, "sent_id"]
    links = require_columns(tokens, [id_col, *COLUMNS]).select(*keys, "tok_id", "head_id", "is_space")
    if links.filter(_outside(array_tokens)).isEmpty():
        return _solved(_sentences(links, keys, array_tokens), keys, {"tok_id": T.IntegerType(), "depth": T.IntegerType()}, _token_depths)
    # The short sentences are chunks like any other: nothing has to be read again to part them from the long ones.
    return _chunked_depths(links, keys, array_tokens).filter(~F.col("is_space")).drop("is_space")


def mean_depth(tokens: DataFrame, id_col: str = ID, array_tokens: int = ARRAY_TOKENS) -> DataFrame:
    depths = dep_depth(tokens, id_col, array_tokens)
    return depths.groupBy(id_col).agg((F.sum("depth") / F.count("depth")).alias("avg_dep_depth"))
