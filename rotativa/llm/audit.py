"""Which filter of a chain removes what, in every order of the filters, from sorted posting lists.

The rows of a part (a source, say) are laid out by id and cut into ranges of at most ``RANGE`` rows. For each range and
filter a posting list keeps the sorted numbers of the rows that fail it; numbers count the rows of the range by id, so
that repeated and null ids stay apart. The rows lost to a group (good or toxic ones, say) are lists as well. Unions over
the filters of a prefix, and what a filter fails outside of such a union, come from galloping merges: a list that lies
behind the others is taken as a slice up to the next head, found by doubling steps. Sizes are summed over the ranges;
all orders follow from the sums, since a prefix removes the same rows in whatever order its filters stand.

Ranges hold consecutive ids, so a part with a third of all rows lies in many tasks, and no task holds more than a range.

Null conditions count as passed. A null part is the empty string, null ids come first. Every row counts, repeated ones
too. An empty table has no parts. Extra columns don't matter.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Mapping, Sequence
from itertools import combinations, permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, small_side, stored, with_workers

RANGE = 1 << 16
HOT_SHARE = 1_000  # a digest with one in so many rows is hot; there are at most so many


# Galloping merges of sorted lists without repeats

def gallop(ids: Sequence[int], target: int, start: int = 0) -> int:
    """The first place from ``start`` on whose id is not below ``target``."""
    step, end = 1, len(ids)
    while start + step < end and ids[start + step] < target:
        step *= 2
    return bisect_left(ids, target, start + step // 2 if step > 1 else start, min(start + step, end))


def union(lists: Sequence[Sequence[int]]) -> list[int]:
    """All ids of k lists, sorted."""
    out: list[int] = []
    at = [[ids, 0] for ids in lists if ids]
    while len(at) > 1:
        at.sort(key=lambda run: run[0][run[1]])
        (ids, place), (others, head) = at[0], at[1]
        first, next_ = ids[place], others[head]
        if first == next_:
            at[0][1] += 1  # the other list still brings it
        else:
            at[0][1] = gallop(ids, next_, place)
            out += ids[place:at[0][1]]
        if at[0][1] == len(ids):
            del at[0]
    for ids, place in at:
        out += ids[place:]
    return out


def difference(ids: Sequence[int], other: Sequence[int]) -> list[int]:
    """The ids that ``other`` lacks."""
    out: list[int] = []
    i = j = 0
    while i < len(ids):
        j = gallop(other, ids[i], j) if j < len(other) else j
        if j == len(other):
            out += ids[i:]
            break
        if other[j] == ids[i]:
            i += 1
        else:
            k = gallop(ids, other[j], i)
            out += ids[i:k]
            i = k
    return out


def overlap(ids: Sequence[int], other: Sequence[int]) -> int:
    """How many ids both lists have."""
    n = i = j = 0
    while i < len(ids) and j < len(other):
        if ids[i] == other[j]:
            n, i, j = n + 1, i + 1, j + 1
        elif ids[i] < other[j]:
            i = gallop(ids, other[j], i)
        else:
            j = gallop(other, ids[i], j)
    return n


# Posting lists and sums in Spark

def postings(rows: DataFrame, n_filters: int, n_losses: int, size: int = RANGE) -> DataFrame:
    """(part, n_rows, first_id, last_id, fails, lost): the posting lists of each id range.

    ``rows`` has part, id, tie, fails and lost; the last two are bit masks of the filters failed and the groups a row
    belongs to. ``tie`` spreads rows of one id, or without one.
    """
    with_workers(rows.sparkSession)
    laid_out = rows.repartitionByRange(partitions(rows.sparkSession), "part", "id", "tie").sortWithinPartitions("part", "id", "tie")

    def listed(part: str, ids: list, fails: list[int], lost: list[int]) -> dict:
        def numbers(masks: list[int], n: int) -> list[list[int]]:
            return [[row for row, mask in enumerate(masks) if mask >> bit & 1] for bit in range(n)]

        return {
            "part": part, "n_rows": len(ids), "first_id": ids[0], "last_id": ids[-1],
            "fails": numbers(fails, n_filters), "lost": numbers(lost, n_losses),
        }

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("part", pa.string()), ("n_rows", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()),
            ("fails", pa.list_(pa.list_(pa.int32()))), ("lost", pa.list_(pa.list_(pa.int32()))),
        ])
        now, held = None, ([], [], [])
        for batch in batches:
            columns = [batch.column(name).to_pylist() for name in ("part", "id", "fails", "lost")]
            for part, *values in zip(*columns, strict=True):
                if held[0] and (part != now or len(held[0]) == size):
                    yield pa.RecordBatch.from_pylist([listed(now, *held)], schema)
                    held = ([], [], [])
                now = part
                for column, value in zip(held, values, strict=True):
                    column.append(value)
        if held[0]:
            yield pa.RecordBatch.from_pylist([listed(now, *held)], schema)

    return laid_out.mapInArrow(
        ranges, "part string, n_rows long, first_id long, last_id long, fails array<array<int>>, lost array<array<int>>"
    )


def sizes(lists: DataFrame, n_filters: int, losses: Sequence[str]) -> DataFrame:
    """(part, filter, prior, n_rows, before, removed, losses ...) of each range, for every filter and set of others.

    ``prior`` is the bit mask of the filters that stand before; ``before`` is the size of their union, ``removed`` what
    the filter fails outside of it, and a loss how much of that belongs to the group.
    """
    names = ("filter", "prior", "n_rows", "before", "removed", *losses)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("part", pa.string()), *((name, pa.int64()) for name in names)])
        for batch in batches:
            for part, n_rows, fails, lost in zip(
                *(batch.column(name).to_pylist() for name in ("part", "n_rows", "fails", "lost")), strict=True
            ):
                out = []
                for n_prior in range(n_filters):
                    for prior in combinations(range(n_filters), n_prior):
                        together = union([fails[f] for f in prior])
                        mask = sum(1 << f for f in prior)
                        for f in set(range(n_filters)).difference(prior):
                            alone = difference(fails[f], together)
                            values = (f, mask, n_rows, len(together), len(alone), *(overlap(alone, ids) for ids in lost))
                            out.append({"part": part} | dict(zip(names, values, strict=True)))
                yield pa.RecordBatch.from_pylist(out, schema)

    return lists.mapInArrow(counted, "part string, " + ", ".join(f"{name} long" for name in names))


def audit(
    rows: DataFrame, filters: Mapping[str, Column], losses: Mapping[str, Column], part: str = "part", id_col: str = "id",
    tie: Column | None = None,
) -> DataFrame:
    """One row per part, order of the filters and step: part, filter_order, step, kept, removed, redundant, unique_fails,
    the losses, shapley.

    ``filters`` name, by one letter each, the conditions under which a row fails; ``losses`` the groups whose removed
    rows are counted.
    """
    spark, letters, n = rows.sparkSession, list(filters), len(filters)

    def mask(conditions: Mapping[str, Column]) -> Column:
        bits = [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions.values())]
        return sum(bits[1:], bits[0]) if bits else F.lit(0)

    masks = stored(rows.select(
        F.coalesce(part, F.lit("")).alias("part"), F.col(id_col).cast("long").alias("id"),
        (F.xxhash64(id_col) if tie is None else tie).alias("tie"), mask(filters).alias("fails"), mask(losses).alias("lost"),
    ), "audit-rows")  # written, since laying out by ranges reads its input twice
    lists = stored(postings(masks, n, len(losses)), "audit-postings")
    sums = sizes(lists, n, list(losses)).groupBy("part", "filter", "prior").agg(
        *[F.sum(name).alias(name) for name in ("n_rows", "before", "removed", *losses)]
    )
    sums = stored(sums, "audit-sums")
    others = F.get(F.array(*[F.lit((1 << n) - 1 - (1 << f)) for f in range(n)]), F.col("filter").cast("int"))
    weights = F.array(*[F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n)])
    totals = sums.groupBy("part", "filter").agg(
        F.sum(F.when(F.col("prior") == 0, F.col("removed"))).alias("failed"),
        F.sum(F.when(F.col("prior") == others, F.col("removed"))).alias("unique_fails"),
        F.sum(F.col("removed") * F.get(weights, F.bit_count("prior"))).alias("shapley"),
    )
    steps = spark.createDataFrame([
        ("".join(letters[f] for f in order), step + 1, f, sum(1 << g for g in order[:step]))
        for order in permutations(range(n)) for step, f in enumerate(order)
    ], "filter_order string, step int, filter long, prior long")  # as many rows as there are orders and steps
    found = sums.join(totals, ["part", "filter"]).join(F.broadcast(steps), ["filter", "prior"])
    return found.select(
        "part", "filter_order", "step", (F.col("n_rows") - F.col("before") - F.col("removed")).alias("kept"), "removed",
        (F.col("failed") - F.col("removed")).alias("redundant"), "unique_fails", *losses, "shapley",
    )


# Filters on whole texts

def later_copies(rows: DataFrame, id_col: str = "id", digest: str = "digest", result: str = "later_copy") -> DataFrame:
    """Adds whether a row of the same digest has a smaller id anywhere in the table; null ids neither are nor have one.

    ``rows`` has to be stored, as it is read twice. Only ids and digests move. A digest with a thousandth of all rows
    or more is hot: there are at most a thousand, so they are broadcast; all other digests meet by a shuffle.
    """
    total = rows.count()
    copies = stored(
        rows.where(F.col(id_col).isNotNull()).groupBy(digest).agg(
            F.min(id_col).alias("_first"), F.max(id_col).alias("_last"), F.count(F.lit(1)).alias("_n")
        ).where("_first < _last").drop("_last"), "copies",
    )
    hot = F.col("_n") * HOT_SHARE >= total
    few = F.broadcast(copies.where(hot).select(digest, F.col("_first").alias("_hot")))
    rest = copies.where(~hot).select(F.col(digest).alias("_key"), "_first")
    marked = rows.join(few, digest, "left")
    # Rows that have met a hot digest are dealt out by their id; no digest looks like that.
    key = F.when(F.col("_hot").isNull(), F.col(digest)).otherwise(F.concat(F.lit("#"), F.col(id_col).cast("string")))
    joined = marked.withColumn("_key", F.coalesce(key, F.lit("#"))).join(rest, "_key", "left")
    smaller = F.col(id_col) > F.coalesce("_hot", "_first")
    return joined.withColumn(result, F.coalesce(smaller, F.lit(False))).drop("_key", "_hot", "_first")


def text_filters(text: Column) -> dict[str, Column]:
    """Few words, repeated words, capitals, markup characters: the conditions A to D under which a text fails."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    marks = F.lit(False)
    for character in "#$%&*|":
        marks = marks | F.contains(text, F.lit(character))
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * capitals > 5 * F.length(text),
        "D": marks,
    }


def document_audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of filters A to E on documents (doc_id, text, source): E fails copies of a smaller id's text.

    ``labels`` (doc_id, quality, toxic) mark good and toxic documents; of repeated labels of an id, one suffices.
    """
    text = F.coalesce("text", F.lit(""))
    rows = stored(documents.select(F.col("source").alias("part"), F.col("doc_id").alias("id"), text.alias("_t")).select(
        "part", "id", F.sha2(F.col("_t").cast("binary"), 256).alias("digest"),
        *[F.coalesce(c, F.lit(False)).alias(name) for name, c in text_filters(F.col("_t")).items()],
    ), "audit-texts")
    marked = later_copies(rows, result="E")
    of_id = small_side(labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_label")).agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"),
    ), "audit-labels")
    labelled = marked.join(of_id, F.col("id") == F.col("_label"), "left")
    return audit(
        labelled, {name: F.col(name) for name in "ABCDE"},
        {"good_lost": F.col("good"), "toxic_lost": F.col("toxic")}, tie=F.xxhash64("digest"),
    )
