"""What a table looks like: schema, likely text and label columns, distributions, samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .corpus import ID

# Names that text and label columns usually go by.
TEXT_NAMES = ("text", "content", "body", "article", "news", "title", "headline", "message")
LABEL_NAMES = ("label", "labels", "y", "target", "class", "category")

TEXT_GUESSES = 3
LABEL_GUESSES = 3
MAX_LABELS = 50
SHOWN_COLUMNS = 8
SHOWN_CHARS = 240
TOP = 20


def profile_schema(df: DataFrame) -> DataFrame:
    """One row per column: position, name, type, and the number of rows of the table."""
    counted = df.agg(F.count(F.lit(1)).alias("n_rows"))
    entries = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(name).alias("column"), F.lit(kind).alias("dtype"))
        for i, (name, kind) in enumerate(df.dtypes)
    ])
    return counted.select(F.inline(entries), "n_rows")


def _stacked(aggregated: DataFrame, names: Sequence[str], value: str) -> DataFrame:
    """One row of per-column results, turned to one row per column."""
    pairs = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(n).alias("column"), F.col(f"`{n}`").alias(value))
        for i, n in enumerate(names)
    ])
    return aggregated.select(F.explode(pairs).alias("e")).select("e.position", "e.column", f"e.{value}")


def text_lengths(df: DataFrame) -> DataFrame:
    """Mean length of every string column, in one pass."""
    names = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    means = df.agg(*[F.avg(F.length(F.col(f"`{n}`"))).alias(n) for n in names])
    return _stacked(means, names, "avg_len").filter(F.col("avg_len").isNotNull())


def guess_text_columns(df: DataFrame) -> DataFrame:
    """``rank, column, avg_len``: columns with a usual name, else the three string columns with the longest values."""
    named = [c for c in df.columns if c.lower() in TEXT_NAMES]
    if named:
        means = df.agg(*[F.avg(F.length(F.col(f"`{n}`").cast("string"))).alias(n) for n in named])
        return _stacked(means, named, "avg_len").select(
            (F.col("position") + 1).alias("rank"), "column", "avg_len"
        )
    longest = text_lengths(df).orderBy(F.desc("avg_len"), "position").limit(TEXT_GUESSES)
    by_length = F.struct((-F.col("avg_len")).alias("shortness"), "position", "column")
    listed = longest.agg(F.array_sort(F.collect_list(by_length)).alias("l"))
    return listed.select(F.posexplode("l").alias("i", "e")).select(
        (F.col("i") + 1).alias("rank"), "e.column", (-F.col("e.shortness")).alias("avg_len")
    )


def few_values(c: Column, at_most: int = MAX_LABELS) -> Column:
    """The exact number of different values as long as there are at most ``at_most``, else some number beyond it.

    An aggregate whose state is a set of at most twice as many hashes: it merges across tasks, and a column of billions
    of values costs no more than one of a hundred. Null doesn't count.
    """
    hashed = F.when(c.isNotNull(), F.xxhash64(c))
    return F.theta_sketch_estimate(F.theta_sketch_agg(hashed, F.lit(max(4, (2 * at_most).bit_length()))))


def is_scalar(kind: T.DataType) -> bool:
    """Whether values can be labels; maps and untyped values can't even be compared."""
    if isinstance(kind, T.ArrayType):
        return is_scalar(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(is_scalar(f.dataType) for f in kind)
    return not isinstance(kind, (T.MapType, T.VariantType))


def column_cardinality(df: DataFrame, names: Sequence[str], at_most: int = MAX_LABELS) -> DataFrame:
    """``position, column, n_distinct`` of the columns with at most ``at_most`` different values, in one job."""
    names = [n for n in names if is_scalar(df.schema[n].dataType)]
    if not names:
        return df.sparkSession.createDataFrame([], "position int, column string, n_distinct long")
    counted = df.agg(*[F.coalesce(few_values(F.col(f"`{n}`"), at_most), F.lit(0)).cast("long").alias(n) for n in names])
    return _stacked(counted, names, "n_distinct").filter(F.col("n_distinct") <= at_most)


def guess_label_columns(df: DataFrame, text_columns: Sequence[str] = ()) -> DataFrame:
    """``rank, column, n_distinct``: columns with a usual name, else the first three with 2 to 50 values."""
    named = [c for c in df.columns if c.lower() in LABEL_NAMES]
    if named:
        exact = df.agg(*[F.count_distinct(F.col(f"`{n}`")).alias(n) for n in named])
        found = _stacked(exact, named, "n_distinct")
    else:
        others = [c for c in df.columns if c not in text_columns]
        found = column_cardinality(df, others).filter(F.col("n_distinct") > 1)
        found = found.orderBy("position").limit(LABEL_GUESSES)
    listed = found.agg(F.array_sort(F.collect_list(F.struct("position", "column", "n_distinct"))).alias("l"))
    return listed.select(F.posexplode("l").alias("i", "e")).select(
        (F.col("i") + 1).alias("rank"), "e.column", "e.n_distinct"
    )


def label_distribution(df: DataFrame, column: str, top: int = TOP) -> DataFrame:
    """The most frequent values, null among them; ties by value."""
    counts = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), F.asc_nulls_first("value")).limit(top)


def shortened(c: Column, limit: int = SHOWN_CHARS) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("…"))).otherwise(c)


def head_sample(
    df: DataFrame, n: int, text_columns: Sequence[str], label_columns: Sequence[str], order: str = ID
) -> DataFrame:
    """The first rows: text and label columns, then the first five of the table, eight at most, long texts cut."""
    shown = list(dict.fromkeys([*text_columns, *label_columns, *df.columns[:5]]))[:SHOWN_COLUMNS]
    first = df.orderBy(order).limit(n)
    return first.select(*[
        shortened(F.col(c)).alias(c) if isinstance(df.schema[c].dataType, T.StringType) else F.col(c) for c in shown
    ])


def record_keys(df: DataFrame, json: str, n: int | None = None, order: str = ID) -> DataFrame:
    """Keys that occur in the records, sorted; with ``n`` those of the first n records only."""
    first = df if n is None else df.orderBy(order).limit(n)
    return first.select(F.explode(F.json_object_keys(json)).alias("key")).distinct().orderBy("key")


def nested_profile(df: DataFrame, column: str) -> DataFrame:
    """Profile of the records in an array of structs: one row per field, as for a table of its own."""
    return profile_schema(records(df, column))


def records(df: DataFrame, column: str | None = None) -> DataFrame:
    """The records of a table as rows: those of an array of structs, the fields of a struct, or the rows themselves.

    Everything that profiles a table (guesses, distributions, samples, keys) then profiles the records.
    """
    if column is None:
        return df
    if isinstance(df.schema[column].dataType, T.ArrayType):
        return df.select(F.inline(column))
    return df.select(f"{column}.*")


# Nested values

ELEMENT = "[]"
ENTRIES = "{}"
PREVIEW_CHARS = 500


def record_sources(df: DataFrame, path: str = "") -> dict[str, DataFrame]:
    """The tables inside a table, by path: the rows themselves, and the elements of every array and the entries of every
    map in them, at any depth.

    Structs are no tables of their own: their fields stand beside the others under dotted names. Elements of an array
    of structs have their fields as columns, other elements are in ``value``; a map gives ``key`` and ``value``. Null and
    empty arrays have no elements.
    """
    leaves, inner = [], []

    def walk(fields: Sequence[T.StructField], column: Column | None, prefix: str) -> None:
        for f in fields:
            c = F.col(f"`{f.name}`") if column is None else column[f.name]
            name = f"{prefix}{f.name}"
            if isinstance(f.dataType, T.StructType):
                walk(f.dataType.fields, c, f"{name}.")
            elif isinstance(f.dataType, (T.ArrayType, T.MapType)):
                inner.append((name, c, f.dataType))
            else:
                leaves.append(c.alias(name))

    walk(df.schema.fields, None, "")
    found = {path: df.select(*leaves)}
    for name, c, kind in inner:
        here = f"{path}.{name}" if path else name
        here = here.removesuffix(".value") if here.endswith((f"{ELEMENT}.value", f"{ENTRIES}.value")) else here
        if isinstance(kind, T.MapType):
            found |= record_sources(df.select(F.explode(c).alias("key", "value")), here + ENTRIES)
        else:
            elements = df.select(F.explode(c).alias("value"))
            whole = isinstance(kind.elementType, T.StructType)
            found |= record_sources(elements.select("value.*") if whole else elements, here + ELEMENT)
    return found


PROFILE = (
    "path string, position int, column string, dtype string, n_rows long, n_present long, avg_len double, n_distinct long, "
    "example string"
)


def deep_profile(df: DataFrame) -> DataFrame:
    """``path, position, column, dtype, n_rows, n_present, avg_len, n_distinct, example, text_rank, label_rank``: one row per
    field of the table and of every table inside it, from one aggregate per path.

    ``n_present`` counts values that are there: a key occurs in the records if it is above 0. ``n_distinct`` is null
    beyond 50. ``example`` is the smallest value as text, at most 500 characters. The ranks are the guesses of
    ``guess_text_columns`` and ``guess_label_columns`` within each path, by the last part of a name.
    """
    parts = None
    for path, rows in record_sources(df).items():
        entries, kinds = [], dict(rows.dtypes)
        for i, f in enumerate(rows.schema):
            c = F.col(f"`{f.name}`")
            text = F.to_json(c) if isinstance(f.dataType, T.VariantType) else c.cast("string")
            missing = F.lit(None)
            entries.append(F.struct(
                F.lit(path).alias("path"), F.lit(i).alias("position"), F.lit(f.name).alias("column"), F.lit(kinds[f.name]).alias("dtype"),
                F.count(F.lit(1)).alias("n_rows"), F.count(c).alias("n_present"),
                (F.avg(F.length(c)) if isinstance(f.dataType, T.StringType) else missing.cast("double")).alias("avg_len"),
                (F.coalesce(few_values(c), F.lit(0)) if is_scalar(f.dataType) else missing).cast("long").alias("n_distinct"),
                F.min(shortened(text, PREVIEW_CHARS)).alias("example"),
            ))
        if not entries:  # only nested fields
            continue
        one = rows.agg(F.array(*entries).alias("e")).select(F.inline("e"))
        parts = one if parts is None else parts.unionByName(one)
    if parts is None:
        parts = df.sparkSession.createDataFrame([], PROFILE)
    few = F.when(F.col("n_distinct") <= MAX_LABELS, F.col("n_distinct"))
    return _with_guesses(parts.withColumn("n_distinct", few)).select(*[f.split(" ")[0] for f in PROFILE.split(", ")], "text_rank", "label_rank")


def _with_guesses(parts: DataFrame) -> DataFrame:
    """Ranks within each path; the rows are as many as the schema has fields."""
    name = F.lower(F.element_at(F.split("column", "[.]"), -1))
    of_path, any_of = Window.partitionBy("path"), lambda c: F.max(c).over(Window.partitionBy("path"))

    def ranked(chosen: Column, *order: Column | str) -> Column:
        return F.when(chosen, F.sum(chosen.cast("int")).over(of_path.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)).cast("int"))

    texts = parts.withColumns({"_named": name.isin(*TEXT_NAMES), "_long": F.col("avg_len").isNotNull()})
    texts = texts.withColumn("_any", any_of(F.col("_named")))
    by_name = ranked(F.col("_named"), "position")
    by_length = ranked(F.col("_long"), F.desc_nulls_last("avg_len"), "position")
    texts = texts.withColumn("text_rank", F.when(F.col("_any"), by_name).when(by_length <= TEXT_GUESSES, by_length))
    labels = texts.withColumns({
        "_named": name.isin(*LABEL_NAMES), "_few": F.col("text_rank").isNull() & F.coalesce(F.col("n_distinct") > 1, F.lit(False)),
    })
    labels = labels.withColumn("_any", any_of(F.col("_named")))
    by_name, by_number = ranked(F.col("_named"), "position"), ranked(F.col("_few"), "position")
    return labels.withColumn("label_rank", F.when(F.col("_any"), by_name).when(by_number <= LABEL_GUESSES, by_number))


def deep_distribution(df: DataFrame, top: int = TOP) -> DataFrame:
    """``path, column, value, n``: the most frequent values of the first label guess of every path that has one."""
    guesses = deep_profile(df).where("label_rank = 1").select("path", "column").collect()  # at most one per path
    sources, found = record_sources(df), None
    for path, column in guesses:
        one = label_distribution(sources[path].select(F.col(f"`{column}`").alias("v")), "v", top).select(
            F.lit(path).alias("path"), F.lit(column).alias("column"), "value", "n"
        )
        found = one if found is None else found.unionByName(one)
    return found if found is not None else df.sparkSession.createDataFrame([], "path string, column string, value string, n long")


def full_profile(df: DataFrame, column: str | None = None, order: str | None = None, shown: int = 3) -> dict[str, DataFrame]:
    """``schema, text, labels, keys, distribution, sample`` of the records, each a DataFrame.

    ``distribution`` is that of the first label guess, left out where there is none. ``sample`` needs ``order``.
    """
    rows = records(df, column)
    text = guess_text_columns(rows)
    names = [r["column"] for r in text.collect()]  # three at most, or those with usual names
    labels = guess_label_columns(rows, names)
    guesses = [r["column"] for r in labels.orderBy("rank").collect()]
    # Keys of records: the fields that are not null in at least one of them.
    counted = rows.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in rows.columns])
    found = {
        "schema": profile_schema(rows), "text": text, "labels": labels,
        "keys": _stacked(counted, rows.columns, "n").filter("n > 0").select(F.col("column").alias("key")),
    }
    if guesses:
        found["distribution"] = label_distribution(rows, guesses[0])
    if order is not None:
        found["sample"] = head_sample(rows, shown, names, guesses, order)
    return found


# Positions

PIVOTS = 127
SORTED_ROWS = 1 << 16


def row_at(df: DataFrame, k: int, order: str | Sequence[str] = ID, sorted_rows: int = SORTED_ROWS) -> DataFrame:
    """The row at position ``k``, from 0, in ascending order, nulls first; a hash of the row decides ties.

    The rows are narrowed down before anything is sorted: a few of them, drawn at random, divide the order into ranges,
    the rows of each range are counted, and the range that holds the position is divided further until it has at most
    ``sorted_rows``. Only these are sorted, so no task ever holds the k rows before the one looked for. A round is two
    scans of what is left; with 127 dividers it leaves about a hundredth. Equal rows can't be told apart, so a
    range of one value is not divided: any of its rows is the answer.
    """
    names = [order] if isinstance(order, str) else list(order)
    keys = {f"_k{i}": _comparable(df, name) for i, name in enumerate(names)} | {"_tie": _row_hash(df)}
    rows, key = df.withColumns(keys), F.struct(*keys)
    kinds = {name: rows.schema[name].dataType for name in keys}
    low = high = None  # bounds, the lower one included

    def literal(pivot) -> Column:
        return F.struct(*[F.lit(pivot[name]).cast(kind).alias(name) for name, kind in kinds.items()])

    def within(frame: DataFrame) -> DataFrame:
        if low is not None:
            frame = frame.where(key >= literal(low)).where(_reaches(low, kinds, lower=True))
        if high is not None:
            frame = frame.where(key < literal(high)).where(_reaches(high, kinds, lower=False))
        return frame

    left = k
    while True:
        divided = within(rows) if low is None else within(rows).where(key > literal(low))
        pivots = divided.select(*keys).orderBy(F.rand(17)).limit(PIVOTS).distinct().orderBy(*keys).collect()  # PIVOTS rows at most
        if not pivots:  # equal rows only, or none
            return within(rows).limit(1 if low is not None else 0).select(*df.columns)
        counts = within(rows).groupBy(_range_of(key, [literal(p) for p in pivots]).alias("range")).count().collect()
        sizes = {r["range"]: r["count"] for r in counts}  # PIVOTS + 1 rows at most
        for i in range(len(pivots) + 1):
            if left < sizes.get(i, 0):
                break
            left -= sizes.get(i, 0)
        else:
            return df.limit(0)
        low, high = (pivots[i - 1] if i else low), (pivots[i] if i < len(pivots) else high)
        if sizes[i] <= sorted_rows:
            return within(rows).orderBy(*keys).offset(left).limit(1).select(*df.columns)


def _comparable(df: DataFrame, name: str) -> Column:
    """A column as a value that comes to the driver and back unchanged."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType, T.VariantType)):
        raise ValueError(f"rows are ordered by plain values, not by {name}: {kind.simpleString()}")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(F.col(f"`{name}`"))
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(F.from_utc_timestamp(F.col(f"`{name}`").cast("timestamp"), F.current_timezone()))
    return F.col(f"`{name}`")


def _row_hash(df: DataFrame) -> Column:
    plain = [F.to_json(F.struct(f"`{f.name}`")) if not is_scalar(f.dataType) else F.col(f"`{f.name}`") for f in df.schema]
    return F.xxhash64(*plain)


def _reaches(pivot, kinds: dict[str, T.DataType], lower: bool) -> Column:
    """The same bound on the first key alone, which a file scan can use; it is implied by the bound itself."""
    name, kind = next(iter(kinds.items()))
    value, key = F.lit(pivot[name]).cast(kind), F.col(name)
    if isinstance(kind, (T.FloatType, T.DoubleType)):  # statistics of cached columns leave out that NaN is the largest
        return F.lit(True)
    if pivot[name] is None:  # nulls come first: every key is beyond, and up to it there are nulls only
        return F.lit(True) if lower else key.isNull()
    return (key >= value) if lower else (key.isNull() | (key <= value))


def _range_of(key: Column, pivots: Sequence[Column], first: int = 0) -> Column:
    """How many pivots are at most the key, by halving."""
    if not pivots:
        return F.lit(first)
    middle = len(pivots) // 2
    return F.when(key < pivots[middle], _range_of(key, pivots[:middle], first)).otherwise(
        _range_of(key, pivots[middle + 1:], first + middle + 1)
    )
