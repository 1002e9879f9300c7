"""Profiles of nested tables, untyped records, positions: against plain Python."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from rotativa.operators import corpus as co
from rotativa.operators import profile as pr
from rotativa.session import scratch_path
from rotativa.sources import files

DEEP = (
    "id long, info struct<lang:string, more:struct<label:string, tags:array<string>>>, "
    "talks array<struct<title:string, turns:array<struct<role:string, n:int, scores:map<string,array<double>>>>>>, grid array<array<int>>, `a.b` int"
)


def deep(spark):
    def talk(i, j):
        turns = [("user" if k % 2 else "bot", k, {"x": [0.5 * k, None], "y": []} if k % 3 == 0 else None) for k in range(j)]
        return (f"title {i} {'long' * j}", turns if j != 1 else None)

    rows = [
        (i, ("es" if i % 2 else None, (str(i % 3), ["a", "b", None][:i % 4])), [talk(i, j) for j in range(i % 4 + 1)] if i % 5 else None, [[i, i], []] if i % 2 else None, 7)
        for i in range(60)
    ]
    return spark.createDataFrame(rows, DEEP).repartition(3), rows


def test_sources_of_a_nested_table(spark):
    df, rows = deep(spark)
    found = pr.record_sources(df)
    talks = [t for r in rows for t in r[2] or []]
    turns = [u for t in talks for u in t[1] or []]
    scores = [e for u in turns for e in (u[2] or {}).items()]
    want = {
        "": (["id", "info.lang", "info.more.label", "a.b"], 60),
        "info.more.tags[]": (["value"], sum(len(r[1][1][1]) for r in rows)),
        "talks[]": (["title"], len(talks)),
        "talks[].turns[]": (["role", "n"], len(turns)),
        "talks[].turns[].scores{}": (["key"], len(scores)),
        "talks[].turns[].scores{}[]": (["value"], sum(len(v) for _, v in scores)),
        "grid[]": ([], 60), "grid[][]": (["value"], 60),
    }
    assert {path: (rows.columns, rows.count()) for path, rows in found.items()} == want


def test_deep_profile(spark):
    df, rows = deep(spark)
    got = {(r.path, r.column): r for r in pr.deep_profile(df).collect()}
    assert [k for k in got if k[0] == ""] == [("", c) for c in ("id", "info.lang", "info.more.label", "a.b")]
    root = got["", "id"]
    assert (root.n_rows, root.n_present, root.n_distinct, root.example, root.dtype) == (60, 60, None, "0", "bigint")
    assert (got["", "info.lang"].n_present, got["", "info.lang"].n_distinct, got["", "info.lang"].avg_len) == (30, 1, 2.0)
    # Both strings are texts by length; the label goes by its name.
    assert [got["", c].text_rank for c in ("info.lang", "info.more.label")] == [1, 2]
    assert [got["", c].label_rank for c in ("id", "info.lang", "info.more.label", "a.b")] == [None, None, 1, None]
    titles = [t[0] for r in rows for t in r[2] or []]
    title = got["talks[]", "title"]
    assert (title.n_rows, title.text_rank, title.label_rank, title.example) == (len(titles), 1, None, min(titles))
    assert title.avg_len == pytest.approx(sum(map(len, titles)) / len(titles))
    assert (got["talks[].turns[]", "n"].n_distinct, got["talks[].turns[]", "n"].label_rank) == (3, 1)
    assert got["talks[].turns[].scores{}", "key"].n_distinct == 2
    value = got["talks[].turns[].scores{}[]", "value"]
    assert value.n_present < value.n_rows and value.dtype == "double"
    counts = {(r.path, r.column, r.value): r.n for r in pr.deep_distribution(df).collect()}
    assert counts["", "info.more.label", "0"] == 20
    numbers = [u[1] for r in rows for t in r[2] or [] for u in t[1] or []]
    assert {v: n for (p, c, v), n in counts.items() if (p, c) == ("talks[].turns[]", "n")} == {str(k): numbers.count(k) for k in set(numbers)}
    flat = spark.createDataFrame([(1, "x" * 700)], "Id long, body string")
    assert {r.column: len(r.example) for r in pr.deep_profile(flat).collect()} == {"Id": 1, "body": 501}
    empty = pr.deep_profile(df.limit(0)).collect()
    assert len(empty) == len(got) and all(r.n_rows == 0 and r.label_rank in (None, 1) for r in empty)
    only = spark.createDataFrame([([],)], "x array<array<int>>")
    assert [r.path for r in pr.deep_profile(only).collect()] == ["x[][]"]


def test_few_values(spark):
    df = spark.range(20_000).select(
        (F.col("id") % 50).alias("fifty"), (F.col("id") % 51).cast("string").alias("more"), F.col("id").alias("many"), F.lit(None).cast("int").alias("none"),
        F.when(F.col("id") % 2 == 0, float("nan")).otherwise(F.when(F.col("id") % 3 == 0, -0.0).otherwise(0.0)).alias("zeros"),
        F.array((F.col("id") % 3).cast("int")).alias("arrays"), F.create_map(F.lit("a"), F.lit(1)).alias("maps"), F.lit("x").alias("a.b"),
    ).repartition(7)
    found = {r.column: r.n_distinct for r in pr.column_cardinality(df, df.columns).collect()}
    assert found == {"fifty": 50, "none": 0, "zeros": 2, "arrays": 3, "a.b": 1}
    assert [r.column for r in pr.guess_label_columns(df).collect()] == ["fifty", "zeros", "arrays"]
    plan = pr.column_cardinality(df, df.columns)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange SinglePartition") == 1
    for n in (49, 50, 51, 52, 99, 100, 127, 128, 129, 5000):
        exact = spark.range(n).repartition(5).agg(pr.few_values(F.col("id")).alias("n")).first().n
        assert exact == n if n <= 51 else exact > 51


PAYLOADS = {
    "list": ('[{"t": "a", "i": 1}, {"i": "x"}, {"t": null, "i": null}, {"t": ""}]', [("a", "1"), ("", "x"), ("", None), ("", None)]),
    "wrapped": ('{"n": 2, "data": [{"t": 5, "i": 1.5}, {"t": true}, {"t": {"z": [1, null]}}, {"t": [1, "b"]}]}', [("5", "1.5"), ("true", None), ('{"z":[1,null]}', None), ('[1,"b"]', None)]),
    "single": ('{"t": "é\\u00ed \\n", "i": 7}', [("éí \n", "7")]),
    "no list in data": ('{"t": "own", "data": {"t": "other"}}', [("own", None)]),
    "empty": ("[]", []), "wrapped empty": ('{"data": [], "t": "unused"}', []), "null": (None, []), "null first": ('[{"t": null}]', [("", None)]),
    "odd names": ('[{"t": "q", "a.b": 1, "$": 2, "\'": 3}]', [("q", None)]),
}


def test_untyped_records(spark):
    df = spark.createDataFrame([(name, payload, "clash") for name, (payload, _) in PAYLOADS.items()], "name string, payload string, text string")
    found = co.json_records_to_rows(df, "payload", "t", "i", keep=["name"])
    assert found.columns == ["name", "text", "id"]
    got = {name: [] for name in PAYLOADS}
    for r in found.collect():
        got[r.name].append((r.text, r.id))
    assert {k: sorted(v, key=str) for k, v in got.items()} == {k: sorted(v, key=str) for k, (_, v) in PAYLOADS.items()}
    odd = co.json_records_to_rows(df.where("name = 'odd names'"), "payload", "a.b", "'").first()
    assert tuple(odd) == ("1", "3")
    assert co.json_records_to_rows(df.limit(0), "payload", "t").columns == ["text"]
    for payload, message in (
        ('[{"x": 1}, {"t": 2}]', "missing field 't'; available: x"), ('{"x": 1, "y": 2}', "available: x, y"), ("[1, 2]", "no object"), ('[{"t": 1}, "s"]', "no object"),
        ("5", "no object"), ('{"t": ', "MALFORMED|malformed|Malformed"),
    ):
        bad = spark.createDataFrame([(payload,)], "payload string")
        with pytest.raises(Exception, match=message):
            co.json_records_to_rows(bad, "payload", "t").collect()


def shuffled(rows):
    random.seed(4)
    return random.sample(rows, len(rows))


CASES = {
    "numbers": ("k long, v int", [(i * 3 % 1009, i) for i in range(1000)]),
    "ties": ("k long, v int", [(i % 3, i) for i in range(1000)]),
    "one value": ("k long, v int", [(5, 5)] * 300 + [(6, 6)] * 2),
    "nulls": ("k string, v int", [(None if i % 2 else f"s{i % 100:03}", i) for i in range(600)]),
    "floats": ("k double, v int", [(float("nan") if i % 5 == 0 else -float(i), i) for i in range(400)]),
    "times": ("k timestamp, v int", [(datetime(2024, 3, 31, i % 24, i % 60), i) for i in range(500)]),
    "local times": ("k timestamp_ntz, v int", [(datetime(2024, 3, 31, i % 24, i % 60), i) for i in range(500)]),
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("sorted_rows", [20, 1 << 16])
def test_row_at(spark, case, sorted_rows):
    schema, rows = CASES[case]
    df = spark.createDataFrame(shuffled(rows), schema).repartition(5).cache()
    order = [r.k for r in df.orderBy("k").collect()]
    for k in (0, 1, len(rows) // 3, len(rows) - 1):
        found = pr.row_at(df, k, "k", sorted_rows).collect()
        assert len(found) == 1 and str(found[0].k) == str(order[k])
        assert tuple(found[0]) in {tuple(r) for r in df.collect()} or "nan" in str(found[0])
    assert pr.row_at(df, len(rows), "k", sorted_rows).count() == 0
    assert pr.row_at(df, len(rows), "k", sorted_rows).columns == df.columns


def test_every_row_has_one_place(spark):
    """Ties are ordered too, so all positions together give all rows."""
    df = spark.createDataFrame([(i % 4, i) for i in range(40)], "k long, v int").repartition(3).cache()
    rows = [tuple(pr.row_at(df, k, "k", sorted_rows=3).first()) for k in range(0, 40, 3)]
    assert len(set(rows)) == len(rows) and [k for k, _ in rows] == [k // 10 for k in range(0, 40, 3)]
    both = spark.createDataFrame([(i // 10, 9 - i % 10, i) for i in range(100)], "a long, b long, v int")
    assert [pr.row_at(both, k, ["a", "b"], sorted_rows=4).first().v for k in (0, 55, 99)] == [9, 54, 90]
    assert pr.row_at(df.limit(0), 0, "k").count() == 0
    with pytest.raises(ValueError, match="plain values"):
        pr.row_at(df.select(F.struct("k").alias("s")), 0, "s")


def test_csv_keeps_every_character(spark):
    values = ["a\0b", "\0", "\\0", "\\\0", "\\\\n", "\\n\n", "\r\\r", "\\", "\\\\", "", None, " x ", '"', "\\N", "\0\\0\\\\0", ",\u2028"]
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    path = scratch_path(spark, "characters")
    files.export_csv(df, path)
    assert {r.i: r.t for r in files.read_csv(spark, path, "i int, t string").collect()} == dict(enumerate(values))
