"""Files, blocks, whole runs, streams and profiles."""

import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from rotativa.functions.style import StyleConfig
from rotativa.operators import context as cx
from rotativa.operators import corpus as co
from rotativa.operators import merge as mg
from rotativa.operators import profile as pr
from rotativa.plans import features as plans
from rotativa.session import scratch_path
from rotativa.sources import blocks as bl
from rotativa.sources import files, splits
from rotativa.streaming.features import stream_features

CONTEXT = cx.ContextConfig(as_of=datetime(2024, 1, 1, tzinfo=timezone.utc))


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, f"Titular {i}", f"Cuerpo {i}. ¡Increíble!", str(i % 2), "tema", f"medio{i % 3}", f"http://m{i % 3}.es/{i}")
            for i in range(30)]
    return spark.createDataFrame(
        rows, "Id long, Headline string, Text string, Category string, Topic string, Source string, Link string")


def test_aliases(spark, corpus):
    folder = scratch_path(spark, "aliases")
    with pytest.raises(FileNotFoundError):
        splits.read_splits(spark, folder)
    corpus.write.parquet(f"{folder}/train.parquet")
    corpus.limit(1).write.parquet(f"{folder}/validation.parquet")
    corpus.limit(2).write.parquet(f"{folder}/development.parquet")
    assert splits.resolve_split(spark, folder, "val").endswith("/validation.parquet")
    assert splits.resolve_split(spark, folder, "val", splits.FEATURE_ALIASES).endswith("/development.parquet")
    with pytest.raises(ValueError):
        splits.resolve_split(spark, folder, "dev")
    with pytest.raises(FileNotFoundError, match="test"):
        splits.read_splits(spark, folder)
    found = splits.read_splits(spark, folder, skip_missing=True).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in found} == {"train": 30, "val": 1}


def test_folder(spark, corpus, tmp_path):
    for name in ("b", "a"):
        (tmp_path / f"{name}.csv").write_text(f'Id,Text\n1,"{name}, ""x""\ny"\n2,z\n', encoding="utf-8")
    out = scratch_path(spark, "converted")
    paths = files.convert_folder(spark, str(tmp_path), "*.csv", out, "Id long, Text string", lines_in_values=True)
    assert [p.rsplit("=", 1)[1] for p in paths] == ["a", "b"]
    assert sorted(spark.read.parquet(paths[0]).collect()) == [(1, 'a, "x"\ny'), (2, "z")]
    with pytest.raises(FileNotFoundError):
        files.convert_folder(spark, str(tmp_path), "*.json", out)
    (tmp_path / "c.xlsx").write_text("")
    with pytest.raises(ValueError, match="xlsx"):
        files.convert_folder(spark, str(tmp_path), "*.xlsx", out)


def test_csv(spark):
    df = spark.createDataFrame([(1, 'a "b"\n,é', [1.5, 2.0]), (2, None, None)], "Id long, t string, v array<double>")
    path = scratch_path(spark, "csv")
    files.export_csv(df, path)
    back = {r.Id: (r.t, r.v) for r in files.read_csv(spark, path, "Id long, t string, v string").collect()}
    assert back[1] == ('a "b"\n,é', "[1.5,2.0]")


def test_block_round_trip(spark, corpus):
    block = plans.context_block(corpus, CONTEXT)
    path = scratch_path(spark, "block")
    log = bl.write_block(block, path, plans.settings_of(CONTEXT)).first()
    assert (log.step, log.num_samples) == ("ctx", 30) and json.loads(log.settings)["feature_dim"] == 103
    back = bl.read_block(spark, path)
    assert (back.name, back.names) == ("ctx", block.names)
    assert sorted(back.df.collect()) == sorted(block.df.collect())
    with pytest.raises(FileNotFoundError):
        bl.read_block(spark, path + "-none")
    short = mg.Block("sty", block.df, ("x",))
    with pytest.raises(Exception, match="expected 1 features, got 103"):
        bl.write_block(short, path + "-short")


def test_bucketed_blocks_merge_without_shuffle(spark):
    root = scratch_path(spark, "buckets")
    parts = []
    for name in plans.BLOCKS:
        df = spark.range(200).select(F.col("id").alias("Id"), F.array(F.col("id").cast("double")).alias("features"))
        parts.append(bl.save_bucketed(mg.Block(name, df, ("x",)), f"block_{name}", f"{root}/{name}", 4))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        merged = mg.merge_blocks(parts, flags=False)
        assert "Exchange" not in merged._jdf.queryExecution().executedPlan().toString()
        assert {r.Id: r.features for r in merged.collect()} == {i: [float(i)] * 4 for i in range(200)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        for name in plans.BLOCKS:
            spark.sql(f"DROP TABLE block_{name}")


def split_blocks(spark, root, tag, n=300):
    """Four blocks over three splits, the same ids in each; bucketed and partitioned by split."""
    kept = []
    for k, name in enumerate(plans.BLOCKS):
        df = spark.range(n).crossJoin(spark.createDataFrame([("train", 0.0), ("val", 1000.0), ("test", 2000.0)], "split string, x double"))
        df = df.where((F.col("id") + k) % 7 != 0 if k else F.lit(True)).select(
            "split", F.col("id").alias("Id"), F.array(F.col("id") + F.col("x") + k).alias("features"))
        kept.append(bl.save_bucketed(mg.Block(name, df, ("x",), within=("split",)), f"split_{tag}_{name}", f"{root}/{name}", 4))
    return kept


def expected(n=300, bias=0.0):
    return {
        (split, i): [i + x + bias, *[(i + x + k if (i + k) % 7 else 0.0) for k in (1, 2, 3)], 1.0, *[float((i + k) % 7 != 0) for k in (1, 2, 3)]]
        for split, x in (("train", 0.0), ("val", 1000.0), ("test", 2000.0)) for i in range(n)
    }


def vectors(block):
    rows = block.df.collect()
    found = {(r.split, r.Id): r.features for r in rows}
    assert len(found) == len(rows)
    return found


def test_all_splits_merge_in_one_job_without_shuffle(spark):
    root = scratch_path(spark, "one-job")
    kept = split_blocks(spark, root, "job")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.sparkContext.setJobGroup("one-job", "")
    try:
        log = plans.merge_all(kept, f"{root}/merged").first()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    tracker = spark.sparkContext.statusTracker()
    stages = [len(tracker.getJobInfo(j).stageIds) for j in tracker.getJobIdsForGroup("one-job")]
    assert set(stages) == {1} and len(stages) <= 4  # vectors, description, and the row of metrics
    assert log.num_samples == 900
    merged = bl.read_block(spark, f"{root}/merged")
    assert merged.names == ("x",) * 4 + ("has_sem", "has_emo", "has_sty", "has_ctx") and vectors(merged) == expected()
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_one_split_again(spark):
    root = scratch_path(spark, "again")
    sem, *rest = split_blocks(spark, root, "again")
    plans.merge_all([sem, *rest], f"{root}/merged")
    newer = sem.df.where("split = 'val'").withColumn("features", F.transform("features", lambda v: v + 0.5))
    sem = bl.replace_parts(mg.Block("sem", spark.createDataFrame(newer.collect(), newer.schema), ("x",), within=("split",)), "split_again_sem", 4)
    plans.merge_all([sem, *rest], f"{root}/merged", ["val"])
    found = vectors(bl.read_block(spark, f"{root}/merged"))
    want = expected() | {k: v for k, v in expected(bias=0.5).items() if k[0] == "val"}
    assert found == want
    assert bl.finished_versions(spark, f"{root}/merged") == [1, 2]
    assert bl.drop_old_versions(spark, f"{root}/merged") == []  # train and test are in the first
    assert vectors(bl.read_block(spark, f"{root}/merged", parts=["val"])) == {k: v for k, v in want.items() if k[0] == "val"}
    plans.merge_all([sem, *rest], f"{root}/merged", ["train", "test"], policy="drop")
    assert bl.drop_old_versions(spark, f"{root}/merged") == [1]
    left = vectors(bl.read_block(spark, f"{root}/merged"))
    assert left == {k: v for k, v in want.items() if k[0] == "val" or 0.0 not in v[-3:]}
    with pytest.raises(FileNotFoundError, match="dev"):
        bl.read_block(spark, f"{root}/merged", parts=["dev"])
    plans.merge_all([sem, *rest], f"{root}/merged", ["none"])  # a split without rows
    assert bl.read_block(spark, f"{root}/merged", parts=["none"]).df.count() == 0


def test_a_block_is_all_or_nothing(spark, monkeypatch):
    path = scratch_path(spark, "whole")
    frame = lambda *rows: spark.createDataFrame(rows, "Id long, features array<double>")
    old, new = mg.Block("sem", frame((1, [1.0])), ("a",)), mg.Block("sem", frame((2, [2.0, 3.0])), ("b", "c"))

    def state():
        block = bl.read_block(spark, path)
        return block.names, [tuple(r) for r in block.df.collect()]

    monkeypatch.setattr(bl, "_meta", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        bl.write_block(old, path)
    with pytest.raises(FileNotFoundError, match="finished description"):
        bl.read_block(spark, path)
    monkeypatch.undo()
    bl.write_block(old, path)
    assert state() == (("a",), [(1, [1.0])])
    monkeypatch.setattr(bl, "_meta", lambda *_: 1 / 0)  # fails between vectors and description
    with pytest.raises(ZeroDivisionError):
        bl.write_block(new, path)
    assert state() == (("a",), [(1, [1.0])])
    monkeypatch.undo()
    with pytest.raises(Exception, match="expected 1 features, got 2"):  # fails while vectors are written
        bl.write_block(mg.Block("sem", new.df, ("b",)), path)
    assert state() == (("a",), [(1, [1.0])])
    bl.write_block(new, path)
    assert state() == (("b", "c"), [(2, [2.0, 3.0])])
    finished = bl.finished_versions(spark, path)
    assert finished == [2, 5] and bl.drop_old_versions(spark, path) == [2] and state()[0] == ("b", "c")


def test_parts_of_different_names(spark):
    path = scratch_path(spark, "parts")
    for part, names in (("a", ("x",)), ("b", ("y",))):
        df = spark.createDataFrame([(part, 1, [1.0])], "split string, Id long, features array<double>")
        bl.write_block(mg.Block("sem", df, names, within=("split",)), path, partition_by=["split"], parts=[part])
    with pytest.raises(ValueError, match="different names"):
        bl.read_block(spark, path)
    assert bl.read_block(spark, path, parts=["b"]).names == ("y",)
    with pytest.raises(ValueError, match="partition column"):
        bl.write_block(mg.Block("sem", df, ("y",)), path, parts=["b"])


@pytest.mark.parametrize("order", [None, "ord"])
def test_ids_within_a_split(spark, order):
    base = spark.createDataFrame([("a", 1, 0, "l", [1.0]), ("b", 1, 0, "m", [2.0]), ("b", 2, 0, "n", [3.0])], "split string, Id long, ord int, label string, features array<double>")
    side = spark.createDataFrame([("a", 1, 0, [5.0]), ("b", 2, 0, [6.0]), ("c", 1, 0, [7.0])], "split string, Id long, ord int, features array<double>")
    parts = [mg.Block("sem", base, ("x",), order, within=("split",)), mg.Block("sty", side, ("y",), order, within=("split",))]
    merged = mg.merge_blocks(parts)
    assert merged.columns == ["split", "Id", "label", "features"]
    assert sorted(tuple(r) for r in merged.collect()) == [("a", 1, "l", [1, 5, 1, 1]), ("b", 1, "m", [2, 0, 1, 0]), ("b", 2, "n", [3, 6, 1, 1])]
    with pytest.raises(ValueError, match="unique within"):
        mg.merge_blocks([parts[0], mg.Block("sty", side, ("y",))])
    twice = mg.Block("sty", side.unionByName(side.where("split = 'b'")), ("y",), within=("split",))
    with pytest.raises(Exception, match="repeated id=2 in block 'sty'"):
        mg.merge_blocks([parts[0], twice]).collect()


def test_preprocess_one_split_again(spark, corpus):
    root = scratch_path(spark, "one-split")
    for name in ("train", "dev", "test"):
        corpus.withColumn("Headline", F.lit(name)).write.parquet(f"{root}/raw/{name}.parquet")
    plans.preprocess_corpus(spark, f"{root}/raw", f"{root}/clean")
    before = {r.split: r for r in spark.read.parquet(f"{root}/clean").withColumn("file", F.input_file_name()).groupBy("split").agg(F.collect_set("file").alias("files")).collect()}
    corpus.limit(4).withColumn("Headline", F.lit("newer")).write.mode("overwrite").parquet(f"{root}/raw/dev.parquet")
    clean = plans.preprocess_corpus(spark, f"{root}/raw", f"{root}/clean", ["val"])
    counts = {(r.split, r.Headline): r["count"] for r in clean.groupBy("split", "Headline").count().collect()}
    assert counts == {("train", "train"): 30, ("test", "test"): 30, ("val", "newer"): 4}
    after = {r.split: r for r in clean.withColumn("file", F.input_file_name()).groupBy("split").agg(F.collect_set("file").alias("files")).collect()}
    for split in ("train", "test"):
        assert set(after[split].files) == set(before[split].files)
    assert not set(after["val"].files) & set(before["val"].files)


def test_whole_run(spark, corpus):
    root = scratch_path(spark, "run")
    part = F.when(F.col("Id") % 10 < 8, "train").when(F.col("Id") % 10 == 8, "dev").otherwise("test")
    for name in ("train", "dev", "test"):
        corpus.filter(part == name).write.parquet(f"{root}/raw/{name}.parquet")
    clean = plans.preprocess_corpus(spark, f"{root}/raw", f"{root}/clean")
    assert clean.count() == 30 and clean.filter("split = 'val'").count() == 3
    assert clean.filter("Id = 3").first().text_xlmr == "Titular 3 Cuerpo 3. ¡Increíble!"
    signals = plans.FeatureConfig(CONTEXT).signals
    for split in ("train", "val", "test"):
        here = clean.filter(F.col("split") == split)
        vectors = here.select("Id", "label", F.array(F.col("Id").cast("float")).alias("features"))
        emo = here.select("Id", F.array(F.lit(0.5)).alias("features"))
        bl.write_block(mg.Block("sem", vectors, ("sem_sem_emb_0",)), f"{root}/sem/{split}")
        bl.write_block(mg.Block("emo", emo, ("emo_x",)), f"{root}/emo2/{split}")
        bl.write_block(plans.style_block(here), f"{root}/sty/{split}")
        bl.write_block(plans.context_block(here, CONTEXT), f"{root}/ctx/{split}")
    folders = {n: [f"{root}/{n}", f"{root}/{n}2"] for n in plans.BLOCKS}
    targets = plans.merge_splits(spark, folders, f"{root}/merged")
    merged = bl.read_block(spark, targets[1])
    assert len(merged.names) == 1 + 1 + 35 + 103 + 4
    assert merged.names[2] == "sty_ifsz" and merged.names[37] == "ctx_source_emb_0"
    rows = merged.df.collect()
    assert sorted(r.Id for r in rows) == [8, 18, 28] and all(r.features[-4:] == [1, 1, 1, 1] for r in rows)
    settings = json.loads(spark.read.parquet(f"{targets[1]}/meta").first().settings)
    assert settings["dims"] == {"sem": 1, "emo": 1, "sty": 35, "ctx": 103, "total": 144}
    assert settings["blocks"][-1] == ["flags", 140, 144] and settings["sources"]["emo"].endswith("emo2/val")
    with pytest.raises(FileNotFoundError):
        plans.merge_splits(spark, folders | {"sty": [f"{root}/none"]}, f"{root}/merged2")
    with pytest.raises(ValueError, match="ctx"):
        plans.merge_splits(spark, {k: v for k, v in folders.items() if k != "ctx"}, f"{root}/merged2")
    assert signals.extra


def test_stream_equals_batch(spark, corpus):
    root = scratch_path(spark, "stream")
    corpus.repartition(3).write.parquet(f"{root}/in")
    config = plans.FeatureConfig(CONTEXT)
    articles = spark.readStream.schema(corpus.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    query = stream_features(articles, config, f"{root}/out", f"{root}/checkpoint")
    query.awaitTermination(120)
    batch = plans.local_features(co.preprocess(corpus), config)
    assert sorted(spark.read.parquet(f"{root}/out").collect()) == sorted(batch.collect())


def test_local_features_do_not_shuffle(spark, corpus):
    plan = plans.local_features(co.preprocess(corpus), plans.FeatureConfig(CONTEXT))._jdf.queryExecution().executedPlan()
    assert "Exchange" not in plan.toString() and "Python" not in plan.toString()


def test_blocks_agree_with_local_features(spark, corpus):
    config = plans.FeatureConfig(CONTEXT, style=StyleConfig(extra_signals=False))
    together = {r.Id: r for r in plans.local_features(co.preprocess(corpus), config).collect()}
    for r in plans.style_block(corpus, config.style).df.collect():
        assert together[r.Id]["style"] == r.features
    for r in plans.context_block(corpus, CONTEXT).df.collect():
        assert together[r.Id]["context"] == r.features


def test_profiles(spark, corpus):
    assert [r.column for r in pr.guess_text_columns(corpus).orderBy("rank").collect()] == ["Headline", "Text"]
    plain = corpus.select("Id", F.col("Text").alias("cuerpo"), F.col("Source").alias("medio"), F.col("Link").alias("enlace"),
                          F.col("Category").alias("clase"))
    texts = [r.column for r in pr.guess_text_columns(plain).orderBy("rank").collect()]
    assert texts == ["cuerpo", "enlace", "medio"]
    assert [(r.column, r.n_distinct) for r in pr.guess_label_columns(plain, texts).orderBy("rank").collect()] == [
        ("Id", 30), ("clase", 2)]
    assert [r.column for r in pr.guess_label_columns(corpus).collect()] == ["Category"]
    wide = spark.range(5000).select("id", (F.col("id") % 50).alias("fifty"), (F.col("id") % 51).alias("more"), F.lit(1).alias("one"))
    assert [r.column for r in pr.guess_label_columns(wide).collect()] == ["fifty"]
    counts = pr.label_distribution(spark.createDataFrame([("b",), (None,), ("a",), ("b",), (None,)], "c string"), "c", 2)
    assert [tuple(r) for r in counts.collect()] == [(None, 2), ("b", 2)]
    long = spark.createDataFrame([(2, "x" * 241, "k"), (1, "y" * 240, "l")], "Id long, Text string, label string")
    head = pr.head_sample(long, 5, ["Text"], ["label"]).collect()
    assert [len(r.Text) for r in head] == [240, 241] and head[1].Text.endswith("…")
    keys = spark.createDataFrame([(1, '{"b":1}'), (2, '{"a":1,"b":2}')], "Id long, j string")
    assert [r.key for r in pr.record_keys(keys, "j").collect()] == ["a", "b"]
    assert pr.row_at(long, 1).first().Id == 2
    assert [tuple(r)[1:] for r in pr.profile_schema(long).orderBy("position").collect()] == [
        ("Id", "bigint", 2), ("Text", "string", 2), ("label", "string", 2)]
