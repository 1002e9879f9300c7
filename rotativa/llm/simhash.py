"""Near duplicates by SimHash, neighbours found by meet-in-the-middle ball hashing.

A fingerprint bit is 1 where more than half of the shingle hashes (XXH64, seed 42, repeats included) have it set.
Fingerprints within an even radius 2h are found by the balls of radius h around them: both write down all their
variants within h bits, and two fingerprints that share a variant differ in at most 2h bits. So the fingerprints of a
variant all link to the smallest of them, and no pairs are written. For an odd radius 2h + 1 one side's ball has to be
one wider. An even number of set bits takes the small ball, an odd number the wide one, and the fingerprints of a
variant link to the smallest that is within h of it. All links are exact by construction and still verified.

The wide ball of radius 2 around 64 bits has 2,017 variants, too many for every fingerprint. So for an odd radius a first
round takes the odd bit away: of the blocks the bits fall into, one that holds a differing bit is left out, which leaves
an even radius, and every fingerprint writes its variants within h of the rest, once per block left out: 196 for four
blocks. Fingerprints that share none of these with another have no neighbour, and only the others write wide balls.

Fingerprints are made distinct first, so copies, however many, are one; no group is gathered.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, join_spread, small_side, stored, with_workers
from .graph import components, smallest_names

SEED = 42
BLOCKS = 4
BYTE_PLACES = np.arange(8) * 256
BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)


def shingle_hashes(text: str, size: int, seed: int = SEED) -> np.ndarray:
    """Hashes of all word shingles of the text, A-Z lower-cased; of the whole sequence where it is shorter."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, size = b" ".join(words), min(size, len(words))
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words]).tolist()
    return np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, (ends[size - 1:] - 1).tolist())], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Majority of each bit, as a signed 64-bit number; no hashes: zero."""
    if not len(hashes):
        return 0
    bytes_ = np.ascontiguousarray(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    counts = np.bincount((bytes_ + BYTE_PLACES).ravel(), minlength=2048).reshape(8, 256)
    majority = (counts @ BITS_OF_BYTE * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(majority, axis=1, bitorder="little").ravel().view("<i8")[0])


def fingerprints(df: DataFrame, size: int, text: str = "text", result: str = "fingerprint", seed: int = SEED) -> DataFrame:
    """Adds the fingerprint of each whole text as a long; null text counts as empty and has fingerprint 0."""
    with_workers(df.sparkSession)

    @F.arrow_udf("long")
    def made(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(shingle_hashes(t.as_py() or "", size, seed)) for t in texts], pa.int64())

    return df.withColumn(result, made.asNondeterministic()(F.col(text)))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def flips(places: Sequence[int], counts: Sequence[int]) -> list[int]:
    """All ways to flip as many of these bits, as masks."""
    return [sum(1 << i for i in some) for n in counts for some in combinations(places, n)]


def longs(values: Sequence[int]) -> Column:
    return F.lit(np.array([signed(v) for v in values], np.int64))


def with_company(fps: DataFrame, bits: int, half: int) -> DataFrame:
    """Fingerprints that share a variant with another, once a block of bits is left out: all that have a neighbour
    within 2 half + 1, and few others."""
    masks, width = [], -(-bits // BLOCKS)
    for block in range(BLOCKS):
        out = set(range(block * width, min(bits, (block + 1) * width)))
        kept = [i for i in range(bits) if i not in out]
        keep, mark = sum(1 << i for i in kept), (block + 1) << (block * width)  # the block's number in its own place
        masks += [(keep, mark ^ flip) for flip in flips(kept, range(half + 1))]
    pairs = F.arrays_zip(longs([k for k, _ in masks]).alias("keep"), longs([f for _, f in masks]).alias("flip"))
    keyed = fps.select("fp", F.explode(pairs).alias("m")).select(
        "fp", F.col("fp").bitwiseAND(F.col("m.keep")).bitwiseXOR(F.col("m.flip")).alias("key")
    )
    shared = Window.partitionBy("key")
    found = keyed.select("fp", F.min("fp").over(shared).alias("low"), F.max("fp").over(shared).alias("high"))
    return found.where(F.col("low") != F.col("high")).select("fp").distinct()


def links(fps: DataFrame, bits: int = 64, radius: int = 3) -> DataFrame:
    """(a, b): star links that connect all distinct fingerprints ``fp`` within the radius, and no others."""
    half, odd = divmod(radius, 2)
    places = range(bits)
    if odd:
        near = stored(with_company(fps, bits, half), "company")
        even = F.bit_count("fp") % 2 == 0
        balls = [
            near.where(even).select("fp", F.explode(longs(flips(places, range(half % 2, half + 1, 2)))).alias("flip")),
            near.where(~even).select("fp", F.explode(longs(flips(places, range((half + 1) % 2, half + 2, 2)))).alias("flip")),
        ]
        ball = balls[0].union(balls[1])
    else:
        ball = fps.select("fp", F.explode(longs(flips(places, range(half + 1)))).alias("flip"))
    of_variant = Window.partitionBy("variant")
    met = ball.select(
        "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"), (F.bit_count("flip") <= half).alias("inner")
    ).select("fp", F.min(F.when(F.col("inner"), F.col("fp"))).over(of_variant).alias("to"))
    pairs = met.where(F.col("fp") != F.col("to")).select(F.col("fp").alias("a"), F.col("to").alias("b")).distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, radius: int = 3) -> DataFrame:
    """(key, fingerprint long, component_id): each row's fingerprint and the smallest key its component reaches.

    Texts without words share fingerprint 0 and link like any other. Rows with a null key take part, but give a
    component no name: one of nulls only has a null id. Repeated rows are repeated.
    """
    made = fingerprints(df.select(F.col(key), F.col(text).alias("text")), size)
    rows = stored(made.select(key, "fingerprint"), "fingerprints")
    classes = stored(rows.groupBy(F.col("fingerprint").alias("fp")).agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("rows")), "classes")
    roots = components(links(classes.select("fp"), 64, radius))
    names = smallest_names(classes, roots, "fp", "first").join(classes.select("fp", "rows"), "fp")
    labels = stored(names.withColumnRenamed("fp", "fingerprint"), "labels")
    return join_spread(rows, labels, "fingerprint", "rows", rows.count()).select(key, "fingerprint", "component_id")


# Copies and near copies of whole documents, by similarity of word shingles.

SIZE, RADIUS = 3, 3  # fingerprints: words of a shingle, differing bits
SIMILARITY = 0.8
SHINGLE = 5
BANDS, ROWS = 20, 5
MULTIPLIERS = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
CHUNK_SHINGLES = 500_000  # of a bucket's part whose pairs one task compares
BLOCK = 512  # shingles at a time, so that their products stay in the cache
SKETCH = "key binary, fp long, shingles int, bands array<bigint>"


def bands(shingles: np.ndarray) -> list[int]:
    """A key of each band of a set of shingle hashes; none of the empty set.

    The smallest of the products with one multiplier belongs to the same shingle in two sets with a probability equal to
    their Jaccard similarity, wherever they differ. A band is ``ROWS`` such smallest products, so two sets of similarity
    J share one of the bands with probability 1 - (1 - J ** ROWS) ** BANDS: 0.9996 at 0.8.
    """
    if not len(shingles):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), BLOCK):
        np.minimum(least, (shingles[at:at + BLOCK, None] * MULTIPLIERS[0]).min(axis=0), out=least)
    mixed = (least ^ least >> np.uint64(32)) * MULTIPLIERS[1]
    return (mixed ^ mixed >> np.uint64(32)).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64).view(np.int64).tolist()


def shingle_set(text: str) -> np.ndarray:
    return np.unique(shingle_hashes(text, SHINGLE))


def sketch(text: str) -> tuple[bytes, int, int, list[int]]:
    """(digest of the words, fingerprint, number of different shingles, keys of their bands)."""
    from hashlib import blake2b

    words, shingles = text.encode("utf-8", "surrogatepass").lower().split(), shingle_set(text)
    return blake2b(b" ".join(words), digest_size=16).digest(), fingerprint(shingle_hashes(text, SIZE)), len(shingles), bands(shingles)


def fingerprint_groups(classes: DataFrame) -> DataFrame:
    """(class_id, shingles, bucket): classes whose fingerprints the balls connect, of equal ones too; the bucket is the
    group's root. Groups of one class are left out."""
    fps = stored(classes.groupBy("fp").agg(F.count(F.lit(1)).alias("rows")), "fps")
    roots = components(links(fps.select("fp"), 64, RADIUS))
    stars = roots.union(roots.select("root", "root").distinct())  # a root is no node of its own
    named = fps.join(stars.withColumnRenamed("node", "fp"), "fp", "left").where(F.col("root").isNotNull() | (F.col("rows") > 1))
    groups = small_side(named.select("fp", F.coalesce("root", "fp").alias("bucket")), "groups")
    return classes.join(groups, "fp").select("class_id", "shingles", "bucket")


def candidates(classes: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): the buckets of classes whose fingerprints are connected or that share a band, and in each the class
    with the smallest id beside every other one whose number of shingles allows the similarity."""
    placed = fingerprint_groups(classes).unionByName(classes.select("class_id", "shingles", F.explode("bands").alias("bucket")))
    shared = stored(
        placed.groupBy("bucket").agg(
            F.min(F.struct("class_id", "shingles")).alias("hub"), F.count(F.lit(1)).alias("n"), F.sum("shingles").alias("size"),
            F.sum(F.xxhash64("class_id").cast("decimal(38,0)")).alias("of"),
        ).where("n > 1").dropDuplicates(["hub", "n", "of"]), "buckets",  # bands of the same classes count once
    )
    members = stored(placed.join(shared.drop("of", "n"), "bucket"), "members")
    least, most = F.least("shingles", "hub.shingles"), F.greatest("shingles", "hub.shingles")
    pairs = members.where((F.col("class_id") != F.col("hub.class_id")) & (least >= similarity * most))
    return members, pairs.select(F.col("hub.class_id").alias("a"), F.col("class_id").alias("b")).distinct()


def shingle_sets(docs: DataFrame, classes: DataFrame, members: DataFrame) -> DataFrame:
    """(class_id, shingles): the sets of all classes in ``members``, stored."""

    @F.arrow_udf("array<bigint>")
    def sets(texts: pa.Array) -> pa.Array:
        return pa.array([shingle_set(t.as_py() or "").view(np.int64) for t in texts], pa.list_(pa.int64()))

    # Texts stay where they are as long as few of them are wanted.
    wanted = small_side(classes.join(members.select("class_id").distinct(), "class_id").select(
        "class_id", F.col("own.doc_id").alias("doc_id"), F.col("own.text_hash").alias("text_hash")
    ), "wanted")
    rows = docs.select(F.col("doc_id").alias("id"), "text").join(
        wanted, F.col("id").eqNullSafe(F.col("doc_id")) & (F.xxhash64("text") == F.col("text_hash"))
    )
    one = rows.select("class_id", "text").dropDuplicates(["class_id"])
    return stored(one.select("class_id", sets.asNondeterministic()("text").alias("shingles")), "shingles")


def verified(sets: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs of classes whose shingle sets have the similarity (Jaccard), exactly."""
    met = pairs.join(sets.select(F.col("class_id").alias("a"), F.col("shingles").alias("shingles_a")), "a").join(
        sets.select(F.col("class_id").alias("b"), F.col("shingles").alias("shingles_b")), "b"
    )
    shared = F.size(F.array_intersect("shingles_a", "shingles_b"))
    union = F.size("shingles_a") + F.size("shingles_b") - shared
    return met.where(shared >= similarity * union).select("a", "b")


def joined(ids: np.ndarray, components: np.ndarray, offsets: np.ndarray, shingles: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links between sets of different components that have the similarity: every such pair ends in one component, and
    there are fewer links than sets. All sets are compared with each one by a list of the sets that hold a shingle, until
    one component is left."""
    sizes = np.diff(offsets)
    place = np.unique(shingles, return_inverse=True)[1]
    order = np.argsort(place, kind="stable")
    holders = np.repeat(np.arange(len(ids)), sizes)[order]
    starts = np.append(0, np.cumsum(np.bincount(place)))
    label = np.unique(components, return_inverse=True)[1]
    found = []
    for i in range(len(ids)):
        if (label == label[0]).all():
            break
        mine = place[offsets[i]:offsets[i + 1]]
        many = starts[mine + 1] - starts[mine]
        at = np.repeat(starts[mine] - np.cumsum(many) + many, many) + np.arange(many.sum())
        shared = np.bincount(holders[at], minlength=len(ids))
        for j in np.flatnonzero((shared >= similarity * (sizes[i] + sizes - shared)) & (label != label[i])).tolist():
            if label[j] != label[i]:
                found.append((int(ids[i]), int(ids[j])))
                label[label == label[j]] = label[i]
    return found


def missed(members: DataFrame, sets: DataFrame, links: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links of pairs that share a bucket and the similarity, but aren't connected by ``links`` to its hub.

    Every member was compared with the hub. Where the others lie in several components, all pairs of the bucket are
    compared, as pairs of chunks of about ``CHUNK_SHINGLES`` each; written are links, not pairs.
    """
    roots = components(links).select(F.col("node").alias("class_id"), "root")
    placed = stored(members.join(roots, "class_id", "left").withColumn("component", F.coalesce("root", "class_id")), "placed")
    other = F.when(F.col("class_id") != F.col("hub.class_id"), F.col("component"))
    open_ = placed.groupBy("bucket").agg(F.min(other).alias("low"), F.max(other).alias("high")).where("low < high").select("bucket")
    left = placed.join(open_, "bucket", "left_semi")
    chunks = F.ceil(F.col("size") / CHUNK_SHINGLES).cast("int")
    # Chunk c meets every chunk, itself included: as (least, greatest), one copy for each.
    spread = left.withColumn("chunk", F.pmod(F.xxhash64("class_id"), chunks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    keyed = spread.select("class_id", "bucket", "component", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"))

    def compared(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        found = []
        if group.num_rows > 1:
            lists = group["shingles"].chunk(0)
            offsets = np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
            found = joined(group["class_id"].to_numpy(), group["component"].to_numpy(), offsets, lists.flatten().to_numpy(), similarity)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return keyed.join(sets, "class_id").groupBy("bucket", "low", "high").applyInArrow(lambda group: compared(group), "a long, b long")


def near_links(docs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links that connect all classes that share a bucket and whose sets have the similarity."""
    members, pairs = candidates(classes, similarity)
    sets = shingle_sets(docs, classes, members)
    links = stored(verified(sets, pairs, similarity), "links")
    return links.union(missed(members, sets, links, similarity)).distinct()


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` (doc_id, text and any other columns) without copies and near copies: one row of each group stays.

    Texts with the same words are copies. Near copies are linked where their sets of five-word shingles have a Jaccard
    similarity of at least ``similarity``. Fingerprints connected by the balls propose pairs; as 0.8 can lie further apart
    than their radius, bands of smallest hashes propose more; the sets decide. Of a connected
    group the smallest id stays, null ids last, the smaller text hash on ties; of rows that repeat id and
    text, one. Null texts and texts without words are copies of the empty text.
    """
    with_workers(docs.sparkSession)

    @F.arrow_udf(SKETCH)
    def sketches(texts: pa.Array) -> pa.Array:
        keys, fps, sizes, found = zip(*[sketch(t.as_py() or "") for t in texts], strict=True) if len(texts) else ((), (), (), ())
        return pa.StructArray.from_arrays(
            [pa.array(keys, pa.binary()), pa.array(fps, pa.int64()), pa.array(sizes, pa.int32()), pa.array(found, pa.list_(pa.int64()))],
            ["key", "fp", "shingles", "bands"],
        )

    text_hash = F.xxhash64("text")
    sketched = docs.select("doc_id", text_hash.alias("text_hash"), sketches.asNondeterministic()("text").alias("s"))
    rows = stored(sketched.select("doc_id", "text_hash", "s.key", "s.fp", "s.shingles", "s.bands"), "sketches")
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash").alias("own")
    classes = stored(
        rows.groupBy("key").agg(F.min(own).alias("own"), F.first("fp").alias("fp"), F.first("shingles").alias("shingles"), F.first("bands").alias("bands"))
        .withColumn("class_id", F.monotonically_increasing_id()), "classes",
    )
    named = classes.select("class_id", F.struct("own.no_id", "own.doc_id", "own.text_hash", "class_id").alias("name"))
    found = smallest_names(named, components(near_links(docs, classes, similarity)), "class_id", "name")
    winners = classes.join(found, "class_id").where(F.col("component_id.class_id") == F.col("class_id")).select("key", "own")
    id_, hash_ = fresh(docs, "gone_id"), fresh(docs, "gone_hash")
    this = F.col("doc_id").eqNullSafe(F.col(id_)) & (text_hash == F.col(hash_))
    gone = small_side(
        rows.select("doc_id", "text_hash", "key", own).join(winners.withColumnRenamed("own", "kept"), "key", "left")
        .where(F.col("kept").isNull() | (F.col("own") != F.col("kept"))).select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_)).distinct(),
        "copies",
    )
    left = docs.join(gone, this, "left_anti")
    repeated = small_side(
        rows.groupBy(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_)).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"),
        "repeated",
    )
    if repeated.isEmpty():
        return left
    # Only texts that repeat are shuffled, and those of one task once.
    return left.join(repeated, this, "left_anti").unionByName(left.join(repeated, this, "left_semi").dropDuplicates(["doc_id", "text"]))
