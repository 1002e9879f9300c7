"""Merging blocks under each policy, against dictionaries; skewed keys."""

import pytest
from pyspark.sql import functions as F

from rotativa.operators import corpus as co
from rotativa.operators import merge as mg
from rotativa.operators import skew

SEM = [(1, "a", 0, [1.0, 2.0]), (2, "b", 1, [3.0, 4.0]), (2, "c", 2, [5.0, 6.0]), (3, "d", 3, [7.0, 8.0])]
STY = [(1, 0, [0.1]), (1, 1, [0.2]), (2, 2, [0.3]), (9, 3, [0.9])]


def blocks(spark, order=True):
    sem = spark.createDataFrame(SEM, "Id long, label string, ord int, sem_emb array<double>")
    sty = spark.createDataFrame(STY, "Id long, ord int, features array<double>")
    return [mg.semantic_block(sem, 2, "ord" if order else None),
            mg.Block("sty", sty, ("sty_x",), "ord" if order else None)]


def rows(df):
    return sorted((r.Id, r.label, [round(x, 5) for x in r.features]) for r in df.collect())


def test_fill_zero_keeps_every_base_row(spark):
    found = rows(mg.merge_blocks(blocks(spark)))
    # Copies of an id all get the last vector, and keep their own label.
    assert found == [(1, "a", [1, 2, 0.2, 1, 1]), (2, "b", [5, 6, 0.3, 1, 1]), (2, "c", [5, 6, 0.3, 1, 1]),
                     (3, "d", [7, 8, 0, 1, 0])]
    assert mg.merged_names(blocks(spark)) == ["sem_sem_emb_0", "sem_sem_emb_1", "sty_x", "has_sem", "has_sty"]
    assert mg.block_slices(blocks(spark)) == [("sem", 0, 2), ("sty", 2, 3), ("flags", 3, 5)]


def test_drop_keeps_complete_ids(spark):
    found = rows(mg.merge_blocks(blocks(spark), "drop", flags=False))
    assert found == [(1, "a", [1, 2, 0.2]), (2, "c", [5, 6, 0.3]), (2, "c", [5, 6, 0.3])]


def test_error_names_id_and_block(spark):
    with pytest.raises(Exception, match="missing id=3 in block 'sty'"):
        mg.merge_blocks(blocks(spark), "error").collect()
    with pytest.raises(ValueError, match="policy"):
        mg.merge_blocks(blocks(spark), "ignore")


def test_wrong_length_fails(spark):
    sem, _ = blocks(spark)
    bad = mg.Block("sty", spark.createDataFrame([(1, [1.0, 2.0])], "Id long, features array<double>"), ("sty_x",))
    with pytest.raises(Exception, match="expected 1, got 2"):
        mg.merge_blocks([sem, bad]).collect()
    assert mg.dim_violations(bad).collect()[0].asDict() == {"dim": 2, "n": 1}
    with pytest.raises(ValueError, match="missing columns"):
        mg.Block("sty", bad.df.drop("features"), ("x",))


def test_labels_of_a_later_block_are_taken_by_id(spark):
    sem, _ = blocks(spark)
    bare = mg.semantic_block(sem.df.drop("label"), 2, "ord")
    emo = spark.createDataFrame([(2, "two", [0.5]), (1, "one", [0.25])], "Id long, label string, features array<double>")
    found = mg.merge_blocks([bare, mg.Block("emo", emo, ("emo_x",))], flags=False)
    assert sorted((r.Id, r.label) for r in found.collect() if r.label) == [(1, "one"), (2, "two"), (2, "two")]
    unlabelled = mg.merge_blocks([bare, mg.Block("emo", emo.drop("label"), ("emo_x",))])
    assert unlabelled.columns == ["Id", "features"]


def test_merge_is_one_exchange_per_block(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frames = [spark.range(100).select(F.col("id").alias("Id"), F.array(F.rand(1)).alias("features")) for _ in range(4)]
        parts = [mg.Block(n, f, ("x",)) for n, f in zip(("sem", "emo", "sty", "ctx"), frames)]
        merged = mg.merge_blocks(parts)
        merged.collect()
        plan = merged._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("Exchange hashpartitioning") == 4


def test_names_and_vectors(spark):
    assert mg.prefix_names(["a", "b"], "sty_") == ["sty_a", "sty_b"]
    assert mg.prefix_names(["sty_a", "b"], "sty_") == ["sty_a", "b"]
    assert mg.prefix_names(["sem_a"], "sem_", always=True) == ["sem_sem_a"]
    df = spark.createDataFrame([(1, 2.0, None)], "Id long, b double, a double")
    assert mg.align_features(df, ["a", "b", "c"]).first() == (1, 0.0, 2.0, 0.0)
    packed = mg.columns_to_vector(df, ["b", "b"])
    assert mg.vector_to_columns(packed, ["x", "y"]).first() == (1, 2.0, 2.0)


def test_emotion_names(spark):
    df = spark.createDataFrame([(1, [0.1], [0.2], [0.3, 0.4])],
                               "Id long, emo_probs array<double>, sent_probs array<double>, signals array<double>")
    block = mg.emotion_block(df, 4)
    assert block.names == ("emo_emo_feat_0", "emo_emo_feat_1", "emo_emo_feat_2", "emo_emo_feat_3")
    assert block.df.first().features == [0.1, 0.2, 0.3, 0.4]
    with pytest.raises(ValueError):
        mg.emotion_block(df)


@pytest.mark.parametrize("how", ["left", "inner"])
def test_salted_join_equals_plain_join(spark, how):
    """A third of all rows has one key, a tenth another, a few have none."""
    left = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 10 == 1, 8).when(F.col("id") % 50 != 2, F.col("id")).alias("k"),
        F.col("id").alias("row"))
    right = spark.range(2000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    heavy = skew.heavy_hitters(left, ["k"])
    assert sorted(heavy.values())[-1] == 1001  # the key itself is an id as well
    assert not skew.heavy_hitters(spark.range(200_000), ["id"])
    plain = sorted(left.join(right, "k", how).collect(), key=str)
    assert sorted(skew.salted_join(left, right, ["k"], how, ["row"]).collect(), key=str) == plain
    copies = skew.copies_of({1: 1000, 2: 99, 3: 10**9}, 100)
    assert copies == {1: 10, 2: 2, 3: skew.SALTS}


def test_broadcast_needs_few_rows_and_bytes(spark):
    df = spark.createDataFrame([("a" * 100,), ("b",), (None,)], "w string")
    assert skew.is_small(df)
    assert not skew.is_small(df, rows=2) and not skew.is_small(df, rows=0)
    assert not skew.is_small(df, size=100) and skew.is_small(df, size=149)
    for wide in ("array(1.0)", "map('a', 1)", "struct(1 AS x)", "cast('a' AS binary)"):
        assert not skew.is_small(df.selectExpr("w", f"{wide} AS v"))


def test_merge_with_a_hot_base_id(spark):
    base = spark.range(900).select(
        F.when(F.col("id") < 300, 0).otherwise(F.col("id")).alias("Id"), F.col("id").alias("ord"),
        F.array(F.col("id").cast("double")).alias("sem_emb"))
    side = spark.range(900).select(F.col("id").alias("Id"), F.array(F.lit(1.0)).alias("features"))
    merged = mg.merge_blocks([mg.semantic_block(base, 1, "ord"), mg.Block("sty", side, ("x",))], flags=False)
    found = merged.collect()
    assert len(found) == 900
    assert {tuple(r.features) for r in found if r.Id == 0} == {(299.0, 1.0)}


def test_corpus_checks(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (2, None)], "Id long, Category string")
    with pytest.raises(ValueError, match=r"\['Text'\].*Category"):
        co.require_columns(df, ["Id", "Text"])
    assert co.id_integrity(df).first().asDict() == {"n_rows": 4, "n_ids": 2, "n_null": 1, "n_duplicated": 1}
    assert co.id_integrity(df.limit(0)).first().n_rows == 0
    assert co.with_label(df).columns == ["Id", "Category", "label"]
    assert co.with_label(df.withColumn("label", F.lit(1))).select("label").distinct().first()[0] == 1
    assert "label" not in co.with_label(df.drop("Category")).columns
    nested = spark.createDataFrame([(0, [("x", 5), (None, 6)]), (1, [])], "k int, data array<struct<Text:string,Id:long>>")
    assert sorted(co.records_to_rows(nested, "Text", "Id", "data").collect()) == [("", 6), ("x", 5)]
    assert co.records_to_rows(df, "Category", "Nope").columns == ["text"]
    with pytest.raises(ValueError):
        co.records_to_rows(nested, "Body", data="data")


def test_presence_computes_no_vectors(spark):
    """The flags of the merged vectors, with null vectors, missing and null ids, without computing a vector that can't be null."""
    failing = F.array(F.raise_error(F.lit("computed")).cast("double"), F.lit(0.0))

    def blocks_with(vector):
        base = spark.createDataFrame([(1, [1.0]), (2, None), (2, [2.0]), (None, [3.0]), (4, [4.0])], "Id long, features array<double>")
        ids = spark.createDataFrame([(1,), (2,), (None,)], "Id long")
        null = spark.createDataFrame([(1, None), (4, [1.0])], "Id long, features array<double>")
        return [mg.Block("sem", base, ("a",)), mg.Block("sty", ids.select("Id", vector.alias("features")), ("b", "c")), mg.Block("ctx", null, ("d",))]

    names = ["has_sem", "has_sty", "has_ctx"]
    whole = [(r.Id, *r.features[-3:]) for r in mg.merge_blocks(blocks_with(F.array(F.lit(0.0), F.lit(0.0)))).collect()]
    found = [(r.Id, *[r[n] for n in names]) for r in mg.presence(blocks_with(failing)).collect()]
    assert sorted(found, key=str) == sorted(whole, key=str) and len(found) == 5
    repeated = mg.Block("emo", spark.createDataFrame([(1, [1.0]), (1, [2.0])], "Id long, features array<double>"), ("e",))
    with pytest.raises(Exception, match="repeated id=1"):
        mg.presence([blocks_with(failing)[0], repeated]).collect()
