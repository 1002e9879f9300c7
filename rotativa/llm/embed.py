"""Near duplicates among embeddings: Euclidean p-stable hashing, then exact cosines.

Vectors of length one with a cosine of at least c are at most sqrt(2 - 2c) apart. Each of ``tables`` hash tables cuts
``projections`` random Gaussian projections of the vector into cells of ``width``; vectors that share all cells of a
table share its bucket. In the distance of cosine 0.9 two vectors share a cell with probability 0.84, a bucket with
0.12, and at least one of 24 buckets with 0.95; at cosine 0.95 with 0.998. Within buckets every pair is compared in
double precision, so nothing below the threshold is linked. A pair that shares several buckets is written for the first.

Equal vectors are one class with a weight, so copies are compared once. Buckets above ``chunk`` vectors are cut into
chunks, and every pair of chunks is a task of its own, so no bucket has a cap and no task more than two chunks. What is
written are links, not pairs of a bucket.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of different
length neither. Rows that repeat an id are vectors of their own. Rows with a null id take part and name no component.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, with_workers
from .graph import components, smallest_names

PAIR = "a long, b long, cosine double"


@dataclass(frozen=True)
class PStableConfig:
    cosine: float = 0.9
    tables: int = 24
    projections: int = 12
    width: float = 2.2
    chunk: int = 2000
    seed: int = 42


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # so that no square overflows
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def buckets(vectors: np.ndarray, config: PStableConfig) -> np.ndarray:
    """The bucket of each vector in each table."""
    random = np.random.default_rng([config.seed, vectors.shape[1]])
    shape = (config.tables, config.projections)
    lines = random.standard_normal((vectors.shape[1], config.tables * config.projections))
    offsets = random.uniform(0, config.width, config.tables * config.projections)
    mix = random.integers(1, 1 << 62, shape, dtype=np.int64) | 1
    cells = np.floor((unit(vectors) @ lines + offsets) / config.width).astype(np.int64)
    return (cells.reshape(-1, *shape) * mix).sum(axis=2)  # wraps: a 64-bit hash of the cells


def matrix(lists: pa.ListArray) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def linked(ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, chunks: np.ndarray, table: int, config: PStableConfig):
    """Pairs of one bucket, or of two of its chunks, that no earlier table has: (smaller id, larger id, cosine)."""
    order = np.lexsort((ids, chunks))
    ids, codes, own, chunks = ids[order], codes[order], unit(vectors[order]), chunks[order]
    split = int(np.searchsorted(chunks, chunks[0], "right"))
    left, right = (slice(0, split), slice(split, None)) if split < len(ids) else (slice(None), slice(None))
    cosines = own[left] @ own[right].T
    i, j = np.nonzero(cosines >= config.cosine)
    cosines = cosines[i, j]
    j = j + (right.start or 0)
    if left == right:
        i, j, cosines = (x[i < j] for x in (i, j, cosines))
    new = ~(codes[i, :table] == codes[j, :table]).any(axis=1)
    a, b = ids[i[new]], ids[j[new]]
    return np.minimum(a, b), np.maximum(a, b), cosines[new]


def spanning(ids: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Some of the links (left, right) that connect what all of them connect, fewer than there are ``ids`` (sorted)."""
    i, j = np.searchsorted(ids, left), np.searchsorted(ids, right)
    order = np.argsort(np.concatenate((i, j)), kind="stable")
    ends, starts = np.concatenate((j, i))[order], np.searchsorted(np.concatenate((i, j))[order], np.arange(len(ids) + 1))
    seen, a, b = np.zeros(len(ids), bool), [], []
    for root in range(len(ids)):
        front = [] if seen[root] else [root]
        seen[root] = True
        while front:
            node = front.pop()
            near = ends[starts[node]:starts[node + 1]]
            near = np.unique(near[~seen[near]])
            seen[near] = True
            a += [node] * len(near)
            b += near.tolist()
            front += near.tolist()
    return ids[a], ids[b]


def links(classes: DataFrame, config: PStableConfig = PStableConfig()) -> DataFrame:
    """(a, b, cosine), a < b: linked pairs of distinct usable vectors (class_id, vector), as many as there are."""
    def pairs(a: np.ndarray, b: np.ndarray, cosines: np.ndarray, ids: np.ndarray, weights: np.ndarray) -> pa.Table:
        return pa.table({"a": a, "b": b, "cosine": cosines})

    return _met(classes.select("class_id", "vector", F.lit(1).cast("long").alias("weight")), pairs, PAIR, config)


def neighbours(classes: DataFrame, config: PStableConfig = PStableConfig()) -> DataFrame:
    """(a, b, others) from classes (class_id, vector, weight): of each bucket or pair of chunks the weight of what a is
    linked with there (b null), and links that connect what is linked there (others null).

    A pair counts in the first table in which both share a bucket, so the weights of a class add up to all its links.
    No more than two rows per vector of a bucket come out, however many pairs are linked.
    """
    def sums(a: np.ndarray, b: np.ndarray, cosines: np.ndarray, ids: np.ndarray, weights: np.ndarray) -> pa.Table:
        order = np.argsort(ids, kind="stable")
        ids, first = np.unique(ids[order], return_index=True)
        weights = weights[order][first]
        i, j = np.searchsorted(ids, a), np.searchsorted(ids, b)
        others = np.bincount(i, weights[j], len(ids)) + np.bincount(j, weights[i], len(ids))
        linked_ = np.flatnonzero(others)
        tied = spanning(ids, a, b)
        none = [None] * len(linked_), [None] * len(tied[0])
        return pa.table({
            "a": pa.array(np.concatenate((ids[linked_], tied[0])), pa.int64()), "b": pa.array([*none[0], *tied[1].tolist()], pa.int64()),
            "others": pa.array([*others[linked_].astype(np.int64).tolist(), *none[1]], pa.int64()),
        })

    return _met(classes, sums, "a long, b long, others long", config)


def _met(classes: DataFrame, result, schema: str, config: PStableConfig) -> DataFrame:
    """``result`` of the new linked pairs of every bucket, or pair of its chunks."""
    with_workers(classes.sparkSession)

    @F.arrow_udf("array<long>")
    def hashed(vectors: pa.Array) -> pa.Array:
        sizes = np.diff(vectors.offsets.to_numpy())
        found = np.empty((len(vectors), config.tables), np.int64)
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            found[at] = buckets(matrix(vectors.take(pa.array(at))), config)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(vectors) + 1, dtype=np.int32) * config.tables), pa.array(found.ravel()))

    def compared(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids, weights = group["class_id"].to_numpy(), group["weight"].to_numpy()
        if group.num_rows < 2:
            return result(ids[:0], ids[:0], np.empty(0), ids, weights)
        pairs = linked(
            ids, matrix(group["vector"].chunk(0)), group["codes"].chunk(0).flatten().to_numpy().reshape(group.num_rows, -1),
            group["chunk"].to_numpy(), group["table"][0].as_py(), config,
        )
        return result(*pairs, ids, weights)

    coded = stored(classes.select("class_id", "weight", "vector", hashed.asNondeterministic()("vector").alias("codes")), "codes")
    placed = coded.select("class_id", F.size("vector").alias("width"), F.posexplode("codes").alias("table", "bucket"))
    sizes = stored(placed.groupBy("table", "bucket", "width").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")

    rows = coded.select("class_id", "weight", "vector", "codes", F.size("vector").alias("width"), F.posexplode("codes").alias("table", "bucket"))
    kept = rows.join(sizes, ["table", "bucket", "width"])
    chunks = F.ceil(F.col("n") / config.chunk).cast("int")
    chunk = F.pmod(F.xxhash64("class_id"), chunks).cast("int")
    # Chunk c meets every chunk, itself included: as (least, greatest), one copy for each.
    spread = kept.withColumn("chunk", chunk).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    grouped = spread.select(
        "class_id", "weight", "vector", "codes", "chunk", "table", "bucket", "width",
        F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"),
    ).groupBy("table", "bucket", "width", "low", "high")
    return grouped.applyInArrow(lambda group: compared(group), schema)


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", config: PStableConfig = PStableConfig()) -> DataFrame:
    """(key, n_links, component_id, kept) of every row."""
    rows = df.select(F.col(key), F.col(vector).alias("vector")).withColumn("vector", F.when(usable(F.col("vector")), F.col("vector")))
    counted = rows.where(F.col("vector").isNotNull()).groupBy("vector").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("weight"))
    classes = stored(counted.withColumn("class_id", F.monotonically_increasing_id()), "vectors")
    found = stored(neighbours(classes.select("class_id", "vector", "weight"), config), "links")
    degrees = found.where("b IS NULL").groupBy(F.col("a").alias("class_id")).agg(F.sum("others").alias("others"))
    names = smallest_names(classes, components(found.where("b IS NOT NULL").select("a", "b")), "class_id", "first")
    labels = classes.join(names, "class_id").join(degrees, "class_id", "left").select(
        "vector", (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id"
    )
    found = rows.join(labels, "vector", "left")
    component = F.when(F.col("vector").isNull(), F.col(key)).otherwise(F.col("component_id"))
    return found.select(key, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn(
        "kept", F.col(key).eqNullSafe(F.col("component_id"))
    )
