"""A Merkle manifest of a dataset, with proofs of all rows by multiproofs of leaf partitions.

Every row is a leaf. The leaves of a source, in order, are hashed in runs of ``FAN`` until one node remains, its
subroot; the subroots, in the order of the sources, are hashed alike into the root. A proof of a row is the list of the
other members of its run on every level up to the root.

Places come from a layout by ranges of (source, order): each task numbers its rows, and the counts of the tasks before
are added, so no source meets in one task. ``SPAN`` consecutive leaves of a source are a leaf partition, one stored row
of bounded size. From it three levels are hashed locally; nodes above take part in the next round, in which again
``SPAN`` of them meet in a row, so the number of rounds is the logarithm of the rows to the base 4096.

For the proofs, a leaf partition computes the coordinates of the nodes it can't derive itself: the siblings of its
ancestors. They are the same for all its leaves, so their union is minimal and is fetched once, by one join on
coordinates. Nodes inside are derived from the leaves, each sibling list is built once for the leaves that share it,
and every leaf's proof is expanded and folded on the spot.

Null values are hashed as ``-``. Null sources come first, then the others bytewise; null orders come first in a source.
Rows with the same source and order stand by their digest, so equal rows give equal trees wherever they are stored, and
repeated rows are leaves of their own. An empty table gives no rows. Extra columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, small_side, stored, with_workers
from ..operators.skew import salted_join

FAN = 16
HEIGHT = 3  # levels hashed at once
SPAN = FAN**HEIGHT
FETCHED_ROWS = 10_000  # leaf partitions whose fetched nodes (a few KB each) are broadcast

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_digest(*fields: Column) -> Column:
    """SHA-256 of the fields, each ``-`` if null, else its length in bytes, a colon and its text."""
    def framed(field: Column) -> Column:
        text = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[framed(f) for f in fields]).cast("binary"), 256)


def node_digest(parts: Sequence[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# Places

def numbered(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """Adds ``place`` among the rows of the group, from 0, and ``width``, their number; ``order`` has no ties that matter."""
    laid_out = rows.repartitionByRange(partitions(rows.sparkSession), group, *order).sortWithinPartitions(group, *order)
    counted = stored(laid_out.withColumn("_row", F.monotonically_increasing_id()), "places")  # task and row within it
    task = F.shiftright("_row", 33)
    of_task = counted.groupBy(F.col(group).alias("_group"), task.alias("_task")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first")
    )
    before = Window.partitionBy("_group").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = small_side(of_task.select(  # a group has at most one row per task here
        "_group", "_task", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_n").over(Window.partitionBy("_group")).alias("width"),
    ), "offsets")
    same = (F.col(group) == F.col("_group")) & (task == F.col("_task"))
    return counted.join(offsets, same).withColumn("place", F.col("_row") + F.col("_shift")).drop("_row", "_group", "_task", "_shift")


# Levels

def levels_of(digests: list[str], whole: bool) -> list[list[str]]:
    """The nodes of each level above consecutive ones: up to a single node, or ``HEIGHT`` levels of a part of a tree."""
    levels = [digests]
    while len(levels[-1]) > 1 if whole else len(levels) <= HEIGHT:
        now = levels[-1]
        levels.append([node_digest(now[i:i + FAN]) for i in range(0, len(now), FAN)])
    return levels


def height_of(width: int) -> int:
    n = 0
    while width > 1:
        width, n = -(-width // FAN), n + 1
    return n


def spans(nodes: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(tree, level, width, span, digests): ``SPAN`` consecutive nodes of a tree and level in one row, in order.

    ``nodes`` has tree, level, width (the nodes of the level), place and digest; ``keep`` are columns that go along.
    """
    rows = nodes.groupBy("tree", "level", "width", F.floor(F.col("place") / SPAN).alias("span")).agg(
        F.array_sort(F.collect_list(F.struct("place", "digest", *keep))).alias("_rows")
    )
    return rows.select("tree", "level", "width", "span", *[F.col("_rows")[c].alias(f"{c}s") for c in ("digest", *keep)])


NODE = "tree long, level int, width long, place long, digest string, top boolean"


def lifted(groups: DataFrame) -> DataFrame:
    """The nodes above each span; ``top`` marks the highest of them."""
    names = [name.split()[0] for name in NODE.split(", ")]

    def lift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                width, place, out = row["width"], row["span"] * SPAN, []
                levels = levels_of(row["digests"], width <= SPAN)
                for up, level in enumerate(levels):
                    if up:
                        width, place = -(-width // FAN), place // FAN
                    if up or len(levels) == 1:
                        out += [(row["tree"], row["level"] + up, width, place + i, d, up == len(levels) - 1) for i, d in enumerate(level)]
                yield pa.RecordBatch.from_pylist([dict(zip(names, node, strict=True)) for node in out], LIFTED)

    return groups.select("tree", "level", "width", "span", "digests").mapInArrow(lift, NODE)


LIFTED = pa.schema([
    ("tree", pa.int64()), ("level", pa.int32()), ("width", pa.int64()), ("place", pa.int64()), ("digest", pa.string()), ("top", pa.bool_()),
])


def grown(groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes above the spans from their tops on, roots): round by round, each round's nodes stored."""
    below = stored(lifted(groups), "nodes")
    nodes, tops = below.where("top"), below.where("top AND width > 1")
    roots = below.where("top AND width = 1")
    while not tops.isEmpty():
        now = stored(lifted(spans(tops)), "nodes")
        nodes, roots = nodes.unionByName(now), roots.unionByName(now.where("top AND width = 1"))
        tops = now.where("top AND width > 1")
    return nodes, roots


# Proofs

def siblings(place: int, width: int) -> list[int]:
    first = place - place % FAN
    return [p for p in range(first, min(first + FAN, width)) if p != place]


def missing(tree: int, level: int, place: int, width: int) -> list[tuple[int, int, int]]:
    """Coordinates of the siblings of a node and of its ancestors."""
    out = []
    while width > 1:
        out += [(tree, level, p) for p in siblings(place, width)]
        level, place, width = level + 1, place // FAN, -(-width // FAN)
    return out


TOP_TREE = -1  # the tree of the subroots; the others are the places of their sources


def path_above(tree: int, span: int, width: int, trees: int) -> list[tuple[int, int, int, int]]:
    """(tree, level, place, width) of the nodes on the way up from the top of a leaf partition."""
    path = []
    if width > SPAN:
        level, place = HEIGHT, span
        for _ in range(HEIGHT):
            width = -(-width // FAN)
        while width > 1:
            path.append((tree, level, place, width))
            level, place, width = level + 1, place // FAN, -(-width // FAN)
    level, place, width = 0, tree, trees
    while width > 1:
        path.append((TOP_TREE, level, place, width))
        level, place, width = level + 1, place // FAN, -(-width // FAN)
    return path


def fetched(groups: DataFrame, nodes: DataFrame, trees: int) -> DataFrame:
    """(_tree, _span, found): the nodes each leaf partition lacks, by one join on their coordinates."""
    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("_tree", "_span", "tree", "level", "place")
        schema = pa.schema([(name, pa.int64()) for name in names])
        for batch in batches:
            out = [
                (row["tree"], row["span"], tree, level, p)
                for row in batch.to_pylist()
                for tree, level, place, width in path_above(row["tree"], row["span"], row["width"], trees)
                for p in siblings(place, width)
            ]
            yield pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True)) for row in out], schema)

    requests = groups.select("tree", "span", "width").mapInArrow(wanted, "_tree long, _span long, tree long, level long, place long")
    upper = small_side(nodes.select("tree", F.col("level").cast("long").alias("level"), "place", "digest"), "upper-nodes")
    joined = requests.join(upper, ["tree", "level", "place"])
    return joined.groupBy("_tree", "_span").agg(F.collect_list(F.struct("tree", "level", "place", "digest")).alias("found"))


def beside(levels: list[list[str]]) -> list[list[tuple[str, str]]]:
    """For each node of each level, what stands before and after it in its run."""
    out = []
    for level in levels:
        around = []
        for first in range(0, len(level), FAN):
            run = level[first:first + FAN]
            around += [("".join(run[:i]), "".join(run[i + 1:])) for i in range(len(run))]
        out.append(around)
    return out


PROVED = (
    "tree long, place long, id long, leaf string, subroot string, root string, proof array<array<string>>, proof_sha256 string, "
    "folded_root string, verified boolean"
)


def proved(groups: DataFrame, root: str, trees: int, with_proofs: bool) -> DataFrame:
    """One row per leaf: ``groups`` are stored leaf partitions with the nodes fetched for them."""
    fields = [f.rsplit(" ", 1)[0] for f in PROVED.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.list_(pa.string())), pa.string(), pa.string(), pa.bool_()]
    schema = pa.schema(list(zip(fields, kinds, strict=True)))

    def expanded(row: dict) -> list[tuple]:
        tree, span, leaves = row["tree"], row["span"], row["digests"]
        levels = levels_of(leaves, row["width"] <= SPAN)
        around = beside(levels[:-1])  # the top has no sibling in here
        found = {(n["tree"], n["level"], n["place"]): n["digest"] for n in row["found"] or []}
        above, top, subroot = [], levels[-1][0], None  # (before, after) of each ancestor, folded on the way
        for at, level, place, width in path_above(tree, span, row["width"], trees):
            if at == TOP_TREE and subroot is None:
                subroot = top
            first = place - place % FAN
            run = [found.get((at, level, p), "") if p != place else None for p in range(first, min(first + FAN, width))]
            middle = run.index(None)
            above.append(("".join(run[:middle]), "".join(run[middle + 1:])))
            top = node_digest([above[-1][0], top, above[-1][1]])
        subroot = top if subroot is None else subroot
        shared = "".join(a + b for a, b in above)
        out = []
        for i, (leaf, other) in enumerate(zip(leaves, row["others"], strict=True)):
            own = [around[up][i // FAN**up] for up in range(len(around))]
            folded = top  # an unchanged leaf folds into the interiors all leaves here share
            if other is not None:
                folded = other
                for before, after in own + above:
                    folded = node_digest([before, folded, after])
            proof = None
            if with_proofs:
                proof = [[s[j:j + 64] for j in range(0, len(s), 64)] for s in (a + b for a, b in own + above)]
            digest = node_digest([*(a + b for a, b in own), shared])
            out.append((tree, span * SPAN + i, row["ids"][i], leaf, subroot, root, proof, digest, folded, folded == root))
        return out

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                columns = zip(*expanded(row), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], schema=schema)

    return groups.mapInArrow(expand, PROVED)


def manifest(leaves: DataFrame, with_proofs: bool = False) -> DataFrame:
    """(tree, place, id, leaf, subroot, root, proof, proof_sha256, folded_root, verified) of every leaf.

    ``leaves`` has source, id, leaf and other: what arrives in place of the leaf, null if it is unchanged. ``tree`` is
    the place of the source. ``proof`` has the siblings of each level, from the leaf up; it is null unless asked for.
    """
    spark: SparkSession = with_workers(leaves.sparkSession)
    name = F.coalesce(F.concat(F.lit("="), "source"), F.lit("-"))  # "-" sorts before "="
    rows = stored(leaves.select(name.alias("name"), "id", "leaf", "other"), "leaves")
    names = numbered(rows.select("name").distinct().withColumn("all", F.lit(0)), "all", ["name"])
    sources = small_side(names.select("name", F.col("place").alias("tree"), F.col("width").alias("trees")), "sources")
    trees = sources.agg(F.max("trees")).first()[0] or 0
    placed = numbered(
        salted_join(rows, sources.select("name", "tree"), ["name"], "inner", ["leaf"]).select("tree", "id", "leaf", "other"),
        "tree", ["id", "leaf", "other"],
    )
    nodes = placed.select("tree", F.lit(0).alias("level"), "width", "place", F.col("leaf").alias("digest"), "other", "id")
    groups = stored(spans(nodes, ["other", "id"]), "leaf-partitions")
    upper, subroots = grown(groups)
    tops = subroots.select(F.lit(TOP_TREE).cast("long").alias("tree"), F.lit(0).alias("level"), F.lit(trees).cast("long").alias("width"), F.col("tree").alias("place"), "digest")
    bottom = stored(tops, "subroots")
    above, roots = _top_tree(bottom)
    root = roots.select("digest").first()
    found = stored(fetched(groups, upper.select("tree", "level", "place", "digest").unionByName(above), trees), "multiproofs")
    small = F.broadcast(found) if found.count() <= FETCHED_ROWS else found
    same = (F.col("tree") == F.col("_tree")) & (F.col("span") == F.col("_span"))
    whole = groups.join(small, same, "left").drop("_tree", "_span")
    return proved(whole, root.digest if root else "", trees, with_proofs)


def _top_tree(bottom: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all nodes of the tree of subroots, its root)."""
    nodes, now = bottom, bottom
    while True:
        lifted_ = stored(lifted(spans(now)), "top-nodes")
        nodes = nodes.unionByName(lifted_.drop("top"))
        now = lifted_.where("top AND width > 1").drop("top")
        if now.isEmpty():
            return nodes.select("tree", "level", "place", "digest"), lifted_.where("top AND width = 1")


def document_leaves(documents: DataFrame, changed: Column | None = None) -> DataFrame:
    """Leaves of documents, in one pass over the texts; where ``changed`` holds, what arrives has its capitals lowered."""
    def leaf(text: Column) -> Column:
        return leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)

    lowered = leaf(F.translate("text", CAPITALS, SMALL))
    other = F.lit(None).cast("string") if changed is None else F.when(changed, lowered)
    return documents.select("source", F.col("doc_id").alias("id"), leaf(F.col("text")).alias("leaf"), other.alias("other"))
