"""Rows the driver tables lack: gaps, missing heads, null and repeated ids, wrong lengths, odd file names."""

import random
import time
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from rotativa.functions import text as tx
from rotativa.operators import annotations as ann
from rotativa.operators import context as cx
from rotativa.operators import emotion as emo
from rotativa.operators import lexicon as lx
from rotativa.operators import merge as mg
from rotativa.operators import profile as pr
from rotativa.operators import semantic as sem
from rotativa.operators import style as sty
from rotativa.session import scratch_path
from rotativa.sources import files

TOKENS = "Id long, sent_id int, tok_id int, text string, upos string, head_id int, is_space boolean, is_alpha boolean"


def walked(heads, i):
    """Steps to the root by the rule: no head in the sentence, no step."""
    d = 0
    while heads[i] is not None and heads[i] != i and heads[i] in heads and d < 200:
        i, d = heads[i], d + 1
    return d


SENTENCES = {
    (1, 0): {0: 0, 2: 0, 5: 2, 9: 5},  # gaps
    (1, 1): {0: 7, 1: 0, 2: None, 3: 2, 4: -1},  # heads out of the sentence, or none
    (2, 0): {0: 1, 1: 0, 2: 1},  # a cycle
    (2, 5): {i: max(i - 1, 0) for i in range(260)},  # a chain over the limit
    (None, 0): {3: 3, 4: 3},
    (3, None): {1: 1, 2: 1, 4: 2},
}


@pytest.mark.parametrize("array_tokens", [20_000, 4, 0])
def test_depth_is_the_same_on_every_path(spark, array_tokens):
    rows = [(i, s, t, "w", "X", h, False, True) for (i, s), heads in SENTENCES.items() for t, h in heads.items()]
    tokens = spark.createDataFrame(rows, TOKENS).repartition(3)
    expected = {(i, s, t): walked(heads, t) for (i, s), heads in SENTENCES.items() for t in heads}
    found = ann.dep_depth(tokens, array_tokens=array_tokens).collect()
    assert {(r.Id, r.sent_id, r.tok_id): r.depth for r in found} == expected and len(found) == len(rows)
    stats = {r.Id: r for r in ann.token_stats(tokens, array_tokens=array_tokens).collect()}
    for key in (1, 2, 3, None):
        depths = [d for (i, _, _), d in expected.items() if i == key]
        assert stats[key].avg_dep_depth == pytest.approx(sum(depths) / len(depths))
        assert (stats[key].n_tokens, stats[key].n_distinct) == (len(depths), 1)
        assert stats[key].n_sents == sum(i == key for i, _ in SENTENCES)


def test_long_sentences_are_written_once(spark, monkeypatch):
    """Chunks of ids between which walks lead: every token is stored once, not once a round of joins."""
    rng, sizes, stored = random.Random(5), [], ann.stored
    heads = {t: rng.choice([None, t, t + 40, -7, 10**6]) if t % 29 == 3 else max(t - rng.choice([1, 1, 2, 9]), 0) for t in range(-30, 600)}
    rows = [(1, 0, t, "w", "X", h, False, True) for t, h in heads.items()]
    rows += [(1, 0, t, "w", "X", h + 1, False, True) for t, h in heads.items() if t % 4 == 0 and h is not None]  # copies

    def counted(df, name):
        kept = stored(df, name)
        sizes.append(kept.count())
        return kept

    monkeypatch.setattr(ann, "stored", counted)
    tokens = spark.createDataFrame(rows, TOKENS).repartition(3).cache()
    found = ann.dep_depth(tokens, array_tokens=100).collect()
    assert sum(sizes) < 2 * len(rows) and len(found) == len(rows)
    firsts = {(r.tok_id, r.depth) for r in found}
    assert {(t, walked(heads, t)) for t in heads} <= firsts


@pytest.mark.parametrize("case", ["dense", "gaps", "copies"])
def test_depth_of_a_long_sentence(spark, case):
    """8,000 tokens in one sentence, with heads missing and out of the sentence."""
    random.seed(case)
    ids = {"dense": range(8000), "gaps": [2 * i + i // 7 % 2 for i in range(8000)], "copies": range(8000)}[case]
    heads = {t: None if k % 40 == 7 else random.choice([*ids[:k + 1][-30:], -5, 30_000] + [ids[-1] + 1] * (k % 9 == 0)) for k, t in enumerate(ids)}
    rows = [(1, 0, t, "w", "X", h, False, True) for t, h in heads.items()]
    if case == "copies":  # the smallest head of an id counts as a head
        rows += [(1, 0, t, "w", "X", h + 1, False, True) for t, h in heads.items() if t % 3 == 0 and h is not None and 0 <= h < t]
    tokens = spark.createDataFrame(rows, TOKENS).cache()
    tokens.count()
    ann.dep_depth(tokens.limit(10)).collect()
    started = time.perf_counter()
    found = ann.dep_depth(tokens).collect()
    assert time.perf_counter() - started < 5
    assert len(found) == len(rows)
    if case == "copies":
        depths = {t: {walked(heads, t)} for t in ids}
        for _, _, t, _, _, h, _, _ in rows[8000:]:
            depths[t].add(0 if h == t else 1 + walked(heads, h))
        assert all(r.depth in depths[r.tok_id] for r in found)
    else:
        assert {r.tok_id: r.depth for r in found} == {t: walked(heads, t) for t in ids}


def test_token_table_is_valid_input(spark):
    rows = [(1, 0, t, "w", None, h, t in (0, 2), True) for t, h in enumerate([1, 1, 1, 1, 3])]
    cleaned = ann.token_table(spark.createDataFrame(rows, TOKENS))
    for array_tokens in (100, 2):
        assert {r.tok_id: r.depth for r in ann.dep_depth(cleaned, array_tokens=array_tokens).collect()} == {1: 0, 3: 1, 4: 2}
    assert ann.token_stats(cleaned).first().n_sents == 1


def block(spark, name, rows, order=None, dim=2):
    df = spark.createDataFrame(rows, f"Id long, features array<double>{', ord int' if order else ''}")
    return mg.Block(name, df, tuple(f"{name}{i}" for i in range(dim)), order)


def test_merge_keeps_null_ids_and_null_orders(spark):
    base = block(spark, "sem", [(1, [1.0, 1.0], None), (1, [2.0, 2.0], 5), (None, [3.0, 3.0], 1), (2, [4.0, 4.0], None), (2, [4.0, 4.0], None)], "ord")
    side = block(spark, "ctx", [(1, [7.0, 7.0], None), (1, [8.0, 8.0], -9), (2, [9.0, 9.0], None), (None, [6.0, 6.0], 1)], "ord")
    rows = sorted((tuple(r.features), r.Id) for r in mg.merge_blocks([base, side]).collect())
    assert rows == sorted([
        ((2.0, 2.0, 8.0, 8.0, 1.0, 1.0), 1), ((2.0, 2.0, 8.0, 8.0, 1.0, 1.0), 1), ((3.0, 3.0, 0.0, 0.0, 1.0, 0.0), None),
        ((4.0, 4.0, 9.0, 9.0, 1.0, 1.0), 2), ((4.0, 4.0, 9.0, 9.0, 1.0, 1.0), 2),
    ], key=lambda r: r[0])
    assert sorted(r.Id for r in mg.merge_blocks([base, side], "drop").collect()) == [1, 1, 2, 2]


def test_merge_without_order(spark):
    base = block(spark, "sem", [(1, [1.0, 1.0]), (None, [2.0, 2.0]), (1, [3.0, 3.0])])
    once = block(spark, "ctx", [(1, [7.0, 7.0])])
    twice = block(spark, "ctx", [(1, [7.0, 7.0]), (1, [8.0, 8.0])])
    assert mg.merge_blocks([base, once]).count() == 3
    with pytest.raises(Exception, match="repeated id=1 in block 'ctx'"):
        mg.merge_blocks([base, twice]).collect()


def test_last_row_of_equal_orders_is_the_same_on_any_rerun(spark):
    rows = [(1, f"v{i}", 3) for i in range(50)] + [(2, "x", None), (2, "y", None)]
    df = spark.createDataFrame(rows, "k long, v string, ord int")
    found = {tuple(sorted((r.k, r.v) for r in mg.dedupe_last(df.repartition(n), "k", "ord").collect())) for n in (1, 3, 7)}
    assert len(found) == 1


def test_the_base_runs_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    rows = spark.createDataFrame([(i % 40, [1.0], i) for i in range(200)], "Id long, features array<double>, ord int")
    base = mg.Block("sem", rows.mapInPandas(counted, rows.schema), ("a",), "ord")
    assert mg.merge_blocks([base, block(spark, "ctx", [(1, [7.0, 7.0])])]).count() == 200
    assert seen.value == 200


def test_vectors_of_wrong_length(spark):
    wide = spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "Id long, features array<double>")
    with pytest.raises(Exception, match="2 names for a vector of length 3"):
        mg.vector_to_columns(wide, ["a", "b"]).collect()
    assert mg.vector_to_columns(spark.createDataFrame([(1, None)], wide.schema), ["a", "b"]).first().a is None
    tokens = "Id long, pos int, mask int, emb array<float>"
    for odd in ([1.0, 2.0, 3.0], [1.0], None):
        df = spark.createDataFrame([(1, 0, 1, [1.0, 2.0]), (1, 1, 0, odd)], tokens)
        pooled = [sem.pool_mean(df, 2)] + [
            sem.pool_attention(df, 2, [[0.1, 0.2]] * n, [0.0] * n, [s] * n) for n, s in ((2, 0.1), (2, 500.0), (600, 0.1))
        ]
        for one in pooled:
            with pytest.raises(Exception, match="not 2 dimensions"):
                one.collect()
    masked = spark.createDataFrame([(1, 0, 0, [1.0, 2.0]), (2, 0, None, [1.0, 2.0]), (3, 0, 1, [1.0, 2.0]), (3, 1, 0, [9.0, 9.0])], tokens)
    assert {r.Id: r.sem_emb for r in sem.pool_mean(masked, 2).collect()} == {1: [0, 0], 2: [0, 0], 3: [1, 2]}


@pytest.mark.parametrize("rows", [1000, 0])
def test_rates_and_scores_per_row(spark, rows):
    df = spark.createDataFrame([(1, "rare rare"), (1, "usual usual"), (None, "rare"), (None, "usual"), (1, "usual usual")], "Id long, Text string")
    lexicon = spark.createDataFrame([("usual", 6.0)], "word string, zipf double")
    found = [(r.Id, r.n_words, r.error_rate) for r in lx.oov_rate(df, "Text", lexicon, broadcast_rows=rows).collect()]
    assert sorted(found, key=str) == sorted([(1, 2, 1.0), (1, 2, 0.0), (1, 2, 0.0), (None, 1, 1.0), (None, 1, 0.0)], key=str)
    style = sorted(((r.Id, r.error_rate) for r in sty.style_features(df, lexicon=lexicon).collect()), key=str)
    assert style == sorted([(1, 1.0), (1, 0.0), (1, 0.0), (None, 1.0), (None, 0.0)], key=str)
    weights = spark.createDataFrame([("rare", "sad", 1.0), ("usual", "joy", 2.0)], "word string, class string, weight double")
    scores = [r.probas for r in emo.lexicon_scores(df, "Text", weights, ["joy", "sad"], broadcast_rows=rows).collect()]
    assert sorted(p["sad"] for p in scores) == [0.0, 0.0, 0.0, 1.0, 1.0]


def test_lexicon_by_language(spark):
    df = spark.createDataFrame([(1, "gift", "en"), (2, "gift", "de"), (3, "gift", None)], "Id long, Text string, lang string")
    lexicon = spark.createDataFrame([("gift", "en", 6.0)], "word string, lang string, zipf double")
    found = {r.Id: r.error_rate for r in lx.oov_rate(df, "Text", lexicon, language="lang").collect()}
    assert found == {1: 0.0, 2: 1.0, 3: 1.0}


def test_csv_keeps_nulls_and_line_feeds(spark):
    rows = [(1, None), (2, ""), (3, "a\nb\r\n\\n \\N \\\\"), (4, '"q", \\'), (5, "\\N"), (6, " pad "), (7, "\\\n")]
    df = spark.createDataFrame(rows, "i long, t string")
    path = scratch_path(spark, "odd-csv")
    files.export_csv(df, path)
    assert sorted((r.i, r.t) for r in files.read_csv(spark, path, "i long, t string").collect()) == rows


def test_stems_are_file_names(spark, tmp_path):
    for name in ("a=b", "x y", "p%20q", "c+d", "ñ"):
        (tmp_path / f"{name}.json").write_text('{"v": 1}\n')
    paths = files.convert_folder(spark, str(tmp_path), "*.json", f"{tmp_path}/out", "v int")
    assert len(paths) == 5
    back = spark.read.option("basePath", f"{tmp_path}/out").parquet(*paths).collect()
    assert {str(r.stem) for r in back} == {"a=b", "x y", "p%20q", "c+d", "ñ"}


def test_naive_as_of_is_utc(spark, monkeypatch):
    df = spark.createDataFrame([("t", "s", "l", "2024-01-01T00:00:00Z")], "Topic string, Source string, Link string, Date string")
    for as_of in (datetime(2024, 1, 2), datetime(2024, 1, 2, tzinfo=timezone.utc)):
        config = cx.ContextConfig(as_of=as_of, date="Date")
        assert config.as_of.tzinfo is not None
        assert cx.with_context_fields(df, config).first()["_cx_age"] == pytest.approx(1.0)


def test_adjoining_addresses(spark):
    df = spark.createDataFrame([("a@b.c-d@e.f",), ("x.y@z.w .@a.b -q@r.s",)], "t string")
    assert [r[0] for r in df.select(tx.mask_emails(F.col("t"))).collect()] == ["<EMAIL><EMAIL>", "<EMAIL> .@a.b -<EMAIL>"]


def test_record_keys_of_all_rows(spark):
    df = spark.range(200).select(F.col("id").alias("Id"), F.when(F.col("id") == 150, '{"late": 1}').otherwise('{"k": 2}').alias("j"))
    assert [r.key for r in pr.record_keys(df, "j").collect()] == ["k", "late"]
    assert [r.key for r in pr.record_keys(df, "j", n=3).collect()] == ["k"]


def test_full_profile_of_records_in_both_shapes(spark):
    rows = spark.createDataFrame([(i, f"text {i} " * 9, "ab"[i % 2], None) for i in range(20)], "Id long, Text string, Category string, gone string")
    nested = rows.groupBy((F.col("Id") % 3).alias("part")).agg(F.collect_list(F.struct("*")).alias("data"))
    for df, column in ((rows, None), (nested, "data"), (rows.select(F.struct("*").alias("data")), "data")):
        found = pr.full_profile(df, column, order="Id")
        assert found["schema"].first().n_rows == 20
        assert [r.column for r in found["text"].collect()] == ["Text"] and [r.column for r in found["labels"].collect()] == ["Category"]
        assert sorted(r.key for r in found["keys"].collect()) == ["Category", "Id", "Text"]
        assert {r.value: r.n for r in found["distribution"].collect()} == {"a": 10, "b": 10}
        assert [r.Category for r in found["sample"].collect()] == ["a", "b", "a"]


def test_numbers_as_they_are(spark):
    df = spark.createDataFrame([(1, float("nan"), None)], "Id long, a double, b double")
    row = mg.align_features(df, ["a", "b", "c"], safe_numeric=False).first()
    assert row.a != row.a and row.b is None and row.c == 0
    assert tuple(mg.align_features(df, ["a", "b", "c"]).first()) == (1, 0.0, 0.0, 0.0)
