"""Filter audit beside brute force over all orders; galloping merges beside sets."""

import random
import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from rotativa.llm import audit

DOCS = "doc_id long, text string, source string, part string, E string, good int"


def test_galloping_merges():
    random.seed(1)
    for _ in range(400):
        top = random.choice([5, 40, 2000])
        lists = [sorted(random.sample(range(top), random.randrange(min(top, 60)))) for _ in range(random.randrange(6))]
        assert audit.union(lists) == sorted(set().union(*lists))
        a, b = (lists + [[], []])[:2]
        assert audit.difference(a, b) == sorted(set(a) - set(b))
        assert audit.overlap(a, b) == len(set(a) & set(b))
        for target in (0, top // 2, top):
            start = random.randrange(len(a) + 1)
            assert audit.gallop(a, target, start) == next((i for i in range(start, len(a)) if a[i] >= target), len(a))
    assert audit.union([[1, 2], list(range(3, 1000)), [1000]]) == list(range(1, 1001))


def failing(text):
    words = [w for w in re.split(r"[ \t-\r]+", text) if w]
    return (
        len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text),
        any(c in "#$%&*|" for c in text),
    )


def brute(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    parts = {}
    for i, text, source, *_ in docs:
        text = text or ""
        later = i is not None and any(j is not None and j < i and (t or "") == text for j, t, *_ in docs)
        parts.setdefault(source or "", []).append((i, dict(zip("ABCDE", (*failing(text), later), strict=True))))
    out = {}
    for part, rows in parts.items():
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = list(rows)
            for step, f in enumerate(order):
                hit = [i for i, fails in left if fails[f]]
                left = [r for r in left if not r[1][f]]
                shapley[f] += len(hit)
                out[part, "".join(order), step + 1] = [
                    len(left), len(hit), sum(fails[f] for _, fails in rows) - len(hit),
                    sum(fails[f] and sum(fails.values()) == 1 for _, fails in rows), sum(i in good for i in hit), sum(i in toxic for i in hit), f,
                ]
        for key, row in out.items():
            if key[0] == part:
                row[-1] = shapley[row[-1]]
    return {key: tuple(row) for key, row in out.items()}


def rows_of(found):
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    rows = found.collect()
    got = {(r.part, r.filter_order, r.step): tuple(r[n] for n in names) for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.fixture
def docs():
    random.seed(2)
    long = [" ".join(f"w{i * k % 97}" for i in range(60)) for k in (1, 2, 3)]
    texts = [None, "", "a b c", "A B C", "x # y", long[0], long[0], long[1] + " |", long[2].upper(), "word " * 60, "WORD % " * 60, "a\x85b\x1cc " * 60, long[0] + " "]
    rows = [(i * 7 % 61, random.choice(texts), random.choice(["s", "s", "t", "ü", "", None]), "clash", "clash", 5) for i in range(61)]
    nulls = [(None, t, s, None, None, None) for t in (None, "", long[0]) for s in ("s", None)]
    return rows + nulls + rows[:4] + [rows[5], (rows[5][0], "another text", *rows[5][2:])]


@pytest.mark.parametrize("size", [2, 1 << 16])
def test_equals_brute_force(spark, docs, size, monkeypatch):
    monkeypatch.setattr(audit.postings, "__defaults__", (size,))
    labels = [(i, random.choice([0, 1, None]), random.choice([0, 1, None])) for i in range(0, 61, 2)] + [(None, 1, 1), (4, 1, 0), (4, 0, 1)]
    found = audit.document_audit(
        spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    )
    assert rows_of(found) == brute(docs, labels)


@pytest.mark.parametrize("share", [1, 1_000])
def test_copies_by_both_ways(spark, docs, share, monkeypatch):
    monkeypatch.setattr(audit, "HOT_SHARE", share)
    rows = spark.createDataFrame([(i, t or "") for i, t, *_ in docs], "id long, digest string")
    found = audit.later_copies(rows).collect()
    assert len(found) == len(docs)
    for r in found:
        assert r.later_copy == (r.id is not None and any(i is not None and i < r.id and (t or "") == r.digest for i, t, *_ in docs))


def test_empty(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.document_audit(spark.createDataFrame([], DOCS), labels).count() == 0


def test_other_filters_and_ranges(spark):
    rows = spark.range(1000).select(F.col("id"), F.lit(None).cast("string").alias("part"))
    filters = {"X": F.col("id") % 2 == 0, "Y": F.col("id") % 3 == 0}
    found = audit.audit(rows, filters, {"fives": F.col("id") % 5 == 0}).collect()
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.fives, r.shapley) for r in found}
    assert got == {
        ("", "XY", 1): (500, 500, 0, 333, 100, 833), ("", "XY", 2): (333, 167, 167, 167, 33, 501),
        ("", "YX", 1): (666, 334, 0, 167, 67, 501), ("", "YX", 2): (333, 333, 167, 333, 66, 833),
    }
    lists = audit.postings(rows.select(
        F.lit("p").alias("part"), "id", F.lit(0).alias("tie"), (F.col("id") % 2).cast("int").alias("fails"), F.lit(0).alias("lost")
    ), 1, 1, size=64).collect()
    assert sum(r.n_rows for r in lists) == 1000 and max(r.n_rows for r in lists) <= 64
    ids = sorted(r.first_id + n for r in lists for n in r.fails[0])
    assert ids == list(range(1, 1000, 2))
