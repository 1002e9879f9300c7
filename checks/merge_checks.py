"""Blocks with gaps in them, merged under each policy; numeric safety."""

import uuid

from pyspark.sql import functions as F

from rotativa.functions.numeric import safe, safe_vector
from rotativa.functions.style import CORE_NAMES, SIGNAL_NAMES
from rotativa.operators import context as cx
from rotativa.operators import merge as mg
from rotativa.operators import style as sty
from rotativa.plans import features as plans
from rotativa.session import scratch_path
from rotativa.sources.blocks import read_block, save_bucketed, write_block
from rotativa.streaming import features as streaming

from .common import NEWS, PLAIN, documents, news, q, register, s_round, table
from .common import stored as checks_stored
from .context_checks import context_sql
from .emotion_checks import CLASSES, EMO_LIST, EMOTION_SQL, TONES, emotion_frame
from .emotion_checks import NAMES as SIGNALS
from .style_checks import CORE_SQL, SIGNALS_SQL, ZERO, counts_sql

DIM = 64
BUCKETS = 16
STYLE_NAMES = CORE_NAMES + SIGNAL_NAMES
CONTEXT = cx.ContextConfig()


def sem_frame(spark, sf):
    vectors = table(spark, sf, "embeddings", "vec_id", "label", "embedding")
    return vectors.select(F.col("vec_id").alias("Id"), "label", F.col("embedding").alias("sem_emb"))


def blocks(spark, sf, keep=lambda df: df):
    """Vectors of ``embeddings`` are the base. Emotions exist for labelled texts, contexts for texts with a link."""
    corpus = news(spark, sf)
    emo = emotion_frame(spark, sf).filter(F.col("label").isNotNull())
    return [
        mg.semantic_block(keep(sem_frame(spark, sf)), DIM),
        mg.emotion_block(keep(emo)),
        plans.style_block(keep(corpus.select("Id", "Text"))),
        plans.context_block(keep(corpus.filter(F.col("Link").isNotNull())), CONTEXT),
    ]


LINKED = f"(SELECT *, '' AS Author, CAST(NULL AS TIMESTAMP) AS day FROM {NEWS} n WHERE Link IS NOT NULL)"
STYLE_LIST = ", ".join(f"CAST({(CORE_SQL | SIGNALS_SQL).get(n, ZERO)} AS DOUBLE)" for n in STYLE_NAMES)
DIMS = {"sem": DIM, "emo": len(EMO_LIST) + len(SIGNALS), "sty": len(STYLE_NAMES), "ctx": len(CONTEXT.names)}
BLOCKS_SQL = f"""{EMOTION_SQL}, {counts_sql(PLAIN)}, {context_sql(LINKED)},
  b_sem AS (SELECT vec_id AS Id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
  b_emo AS (SELECT Id, label, [{", ".join(f"CAST({c} AS DOUBLE)" for c in [*EMO_LIST, *SIGNALS])}] AS v FROM emotion
    WHERE label IS NOT NULL),
  b_sty AS (SELECT Id, [{STYLE_LIST}] AS v FROM facts),
  b_ctx AS (SELECT Id, list(CAST(x AS DOUBLE) ORDER BY i) AS v FROM vectors GROUP BY Id),
  sides AS (SELECT s.Id, s.label, s.v AS sem, e.v AS emo, t.v AS sty, c.v AS ctx, e.label AS emo_label FROM b_sem s
    LEFT JOIN b_emo e USING (Id) LEFT JOIN b_sty t USING (Id) LEFT JOIN b_ctx c USING (Id))"""
FLAGS = ", ".join(f"CASE WHEN {b} IS NULL THEN 0.0 ELSE 1.0 END" for b in DIMS)
PARTS_LIST = " || ".join(
    f"coalesce({b}, list_transform(range({d}), lambda x: CAST(0 AS DOUBLE)))" for b, d in DIMS.items())
CELLS = """SELECT Id, {label} AS label, unnest(range(len(f))) AS i, round(CAST(CAST(unnest(f) AS FLOAT) AS DOUBLE), 5) AS x
  FROM (SELECT *, {parts} AS f FROM sides {where})"""


def merged_sql(parts: str, where: str = "", label: str = "label") -> str:
    return f"WITH {BLOCKS_SQL} " + CELLS.replace("{label}", label).replace("{parts}", parts).replace("{where}", where)


def cells(df, *keep):
    long = df.select("Id", *keep, F.posexplode(mg.VECTOR).alias("i", "x"))
    return long.select("Id", *keep, F.col("i").cast("long").alias("i"), F.round(F.col("x").cast("double"), 5).alias("x"))


@register("merge_fill_zero", merged_sql(f"{PARTS_LIST} || [{FLAGS}]"))
def merge_fill_zero(spark, sf):
    return cells(mg.merge_blocks(blocks(spark, sf)), "label")


@register("merge_drop", merged_sql(
    f"{PARTS_LIST} || [{FLAGS}]", "WHERE emo IS NOT NULL AND sty IS NOT NULL AND ctx IS NOT NULL"))
def merge_drop(spark, sf):
    return cells(mg.merge_blocks(blocks(spark, sf), "drop"), "label")


@register("merge_error", f"""WITH {EMOTION_SQL}, {counts_sql(PLAIN)}, sides AS (
    SELECT e.Id, e.label, [{", ".join(f"CAST({c} AS DOUBLE)" for c in [*EMO_LIST, *SIGNALS])}] || [{STYLE_LIST}] AS v
    FROM emotion e JOIN facts f ON f.Id = e.Id)
  """ + CELLS.replace("{label}", "label").replace("{parts}", "v").replace("{where}", ""))
def merge_error(spark, sf):
    """The passing case: every text has both blocks, so nothing is missing."""
    style = plans.style_block(documents(spark, sf), text="text")
    return cells(mg.merge_blocks([mg.emotion_block(emotion_frame(spark, sf)), style], "error", flags=False), "label")


@register("presence_flags", f"""WITH {BLOCKS_SQL} SELECT Id, {", ".join(
    f"CASE WHEN {b} IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS has_{b}" for b in DIMS)} FROM sides""")
def presence_flags(spark, sf):
    return mg.presence(blocks(spark, sf))


@register("merge_labels", merged_sql(
    f"sem || coalesce(emo, list_transform(range({DIMS['emo']}), lambda x: CAST(0 AS DOUBLE)))"
    " || [1.0, CASE WHEN emo IS NULL THEN 0.0 ELSE 1.0 END]", label="emo_label"))
def merge_labels(spark, sf):
    """The base has no labels, so those of the emotion block count, by id."""
    sem, emo, *_ = blocks(spark, sf)
    bare = mg.semantic_block(sem.df.drop("label"), DIM)
    return cells(mg.merge_blocks([bare, emo]), "label")


@register("block_slices", f"""WITH {BLOCKS_SQL}, dims AS (
    SELECT 0 AS ord, 'sem' AS block, max(len(v)) AS dim FROM b_sem UNION ALL SELECT 1, 'emo', max(len(v)) FROM b_emo
    UNION ALL SELECT 2, 'sty', max(len(v)) FROM b_sty UNION ALL SELECT 3, 'ctx', max(len(v)) FROM b_ctx
    UNION ALL SELECT 4, 'flags', 4)
  SELECT block, CAST(sum(dim) OVER (ORDER BY ord) - dim AS BIGINT) AS start, CAST(sum(dim) OVER (ORDER BY ord) AS BIGINT) AS "end",
    CAST(dim AS BIGINT) AS dim FROM dims""")
def block_slices(spark, sf):
    """Slices as the block description gives them, next to the vector length found in the data of each block."""
    parts = blocks(spark, sf)
    found = [b.df.agg(F.max(F.size(b.vector)).cast("long").alias("dim")).withColumn("block", F.lit(b.name)) for b in parts]
    dims = found[0]
    for one in found[1:]:
        dims = dims.unionByName(one)
    dims = dims.unionByName(spark.range(1).select(F.lit(len(parts)).cast("long").alias("dim"), F.lit("flags").alias("block")))
    slices = spark.createDataFrame(mg.block_slices(parts), "block string, start long, end long")
    return slices.join(dims, "block").select("block", "start", "end", "dim")


@register("merge_last_wins", """WITH last AS (SELECT label AS Id, arg_max(embedding, vec_id) AS v FROM embeddings GROUP BY label)
  SELECT CAST(e.label AS BIGINT) AS Id, e.vec_id AS label, unnest(range(67)) AS i,
    round(CAST(unnest(l.v || [CAST(coalesce(d.n_chars, 0) AS FLOAT), 1.0::FLOAT, CASE WHEN d.doc_id IS NULL THEN 0.0::FLOAT ELSE 1.0::FLOAT END])
      AS DOUBLE), 5) AS x
  FROM embeddings e JOIN last l ON l.Id = e.label LEFT JOIN documents d ON d.doc_id = e.label""")
def merge_last_wins(spark, sf):
    """Ten base ids with many copies each: vectors of the last copy, labels of each row."""
    rows = table(spark, sf, "embeddings", "vec_id", "label", "embedding").select(
        F.col("label").cast("long").alias("Id"), F.col("vec_id").alias("label"), F.col("vec_id").alias("ord"),
        F.col("embedding").alias("sem_emb"))
    lengths = table(spark, sf, "documents", "doc_id", "n_chars").withColumnRenamed("doc_id", "Id")
    side = mg.block_from_columns("sty", lengths, ["n_chars"])
    return cells(mg.merge_blocks([mg.semantic_block(rows, DIM, order="ord"), side]), "label")


@register("merge_last_wins_drop", """WITH last AS (SELECT label AS Id, max(vec_id) AS label, arg_max(embedding, vec_id) AS v
    FROM embeddings GROUP BY label)
  SELECT CAST(e.label AS BIGINT) AS Id, l.label, unnest(range(67)) AS i,
    round(CAST(unnest(l.v || [CAST(b.quality AS FLOAT), 1.0::FLOAT, 1.0::FLOAT]) AS DOUBLE), 5) AS x
  FROM embeddings e JOIN last l ON l.Id = e.label JOIN labels b ON b.doc_id = e.label""")
def merge_last_wins_drop(spark, sf):
    """Only ids that have a quality label stay; all copies get the label of the last."""
    rows = table(spark, sf, "embeddings", "vec_id", "label", "embedding").select(
        F.col("label").cast("long").alias("Id"), F.col("vec_id").alias("label"), F.col("vec_id").alias("ord"),
        F.col("embedding").alias("sem_emb"))
    quality = table(spark, sf, "labels", "doc_id", "quality").withColumnRenamed("doc_id", "Id")
    side = mg.block_from_columns("sty", quality, ["quality"])
    return cells(mg.merge_blocks([mg.semantic_block(rows, DIM, order="ord"), side], "drop"), "label")


@register("dedupe_last", """SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type,
  arg_max(value, event_id) AS value FROM events GROUP BY user_id""")
def dedupe_last(spark, sf):
    events = table(spark, sf, "events", "user_id", "event_id", "event_type", "value")
    return mg.dedupe_last(events, "user_id", "event_id")


@register("block_prefix", f"""SELECT Id, {", ".join(f"round(CAST(v[{i + 1}] AS DOUBLE), 6) AS sem_sem_emb_{i}" for i in range(DIM))}
  FROM (SELECT vec_id AS Id, embedding AS v FROM embeddings)""")
def block_prefix(spark, sf):
    block = mg.semantic_block(sem_frame(spark, sf), DIM)
    wide = mg.vector_to_columns(block.df, block.names, block.vector)
    return wide.select("Id", *[F.round(F.col(n).cast("double"), 6).alias(n) for n in block.names])


PRICE_NAMES = ["sty_price", "discount", "tax"]


@register("block_prefix_kept", f"""SELECT l_orderkey AS Id, l_linenumber AS line, l_extendedprice AS sty_price,
  l_discount AS discount, l_tax AS tax FROM lineitem""")
def block_prefix_kept(spark, sf):
    """The first name has the prefix already, so none is prefixed."""
    lines = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax")
    names = mg.prefix_names(PRICE_NAMES, "sty_")
    return lines.toDF("Id", "line", *names)


@register("vector_to_columns", f"""SELECT vec_id AS Id, {", ".join(f"round(CAST(embedding[{i + 1}] AS DOUBLE), 6) AS d{i}" for i in range(DIM))}
  FROM embeddings""")
def vector_to_columns(spark, sf):
    names = [f"d{i}" for i in range(DIM)]
    wide = mg.vector_to_columns(sem_frame(spark, sf), names, "sem_emb")
    back = mg.vector_to_columns(mg.columns_to_vector(wide, names), names)
    return back.select("Id", *[F.round(n, 6).alias(n) for n in names])


@register("align_features", "SELECT o_orderkey AS Id, 0.0::DOUBLE AS absent, o_totalprice AS o_totalprice FROM orders")
def align_features(spark, sf):
    orders = table(spark, sf, "orders", "o_orderkey", "o_totalprice").withColumnRenamed("o_orderkey", "Id")
    return mg.align_features(orders, ["absent", "o_totalprice"])


@register("safe_numeric", """SELECT event_id, CASE WHEN event_type IN ('click', 'view', 'error') THEN 0.0 ELSE value END AS value,
  CASE WHEN event_type IN ('click', 'view', 'error') THEN 0.0 ELSE value END AS element FROM events""")
def safe_numeric(spark, sf):
    """Values that are missing, not a number or infinite for some kinds of events."""
    events = table(spark, sf, "events", "event_id", "event_type", "value")
    kind, zero = F.col("event_type"), F.lit(0.0)
    bad = (
        F.when(kind == "click", F.lit(None).cast("double"))
        .when(kind == "view", F.lit(float("nan")))
        .when(kind == "error", F.lit(float("-inf")))
        .otherwise(F.col("value"))
    )
    return events.select("event_id", safe(bad).alias("value"), safe_vector(F.array(zero, bad))[1].alias("element"))


@register("dim_check", """SELECT CAST(n AS INT) AS dim, count(*) AS n FROM (SELECT len(string_split(url, '/')) AS n FROM pages)
  WHERE n <> 5 GROUP BY n""")
def dim_check(spark, sf):
    """Vectors of uneven length: one element per segment of a link."""
    pages = table(spark, sf, "pages", "page_id", "url")
    lengths = F.transform(F.split("url", "/"), lambda s: F.length(s).cast("double"))
    block = mg.Block("ctx", pages.select(F.col("page_id").alias("Id"), lengths.alias("features")), tuple("abcde"))
    return mg.dim_violations(block)


SPLIT = "CASE WHEN Id % 10 < 8 THEN 'train' WHEN Id % 10 = 8 THEN 'val' ELSE 'test' END"


@register("merge_all", f"""WITH {BLOCKS_SQL} SELECT {SPLIT} AS split, Id, label, unnest(range(len(f))) AS i,
  round(CAST(CAST(unnest(f) AS FLOAT) AS DOUBLE), 5) AS x FROM (SELECT *, {PARTS_LIST} || [{FLAGS}] AS f FROM sides)""")
def merge_all(spark, sf):
    """Each block stored once, bucketed by id and partitioned by split; all splits merged in one job, one of them again,
    and read back."""
    root, tag = scratch_path(spark, "merge-all"), uuid.uuid4().hex
    part = F.when(F.col("Id") % 10 < 8, "train").when(F.col("Id") % 10 == 8, "val").otherwise("test")
    kept = []
    for block in blocks(spark, sf):
        df = block.df.withColumnRenamed(block.vector, mg.VECTOR).withColumn("split", part)
        columns = [c for c in ("split", "Id", "label", mg.VECTOR) if c in df.columns]
        own = mg.Block(block.name, df.select(*columns), block.names, within=("split",))
        kept.append(save_bucketed(own, f"merge_all_{block.name}_{tag}", f"{root}/{block.name}", BUCKETS))
    plans.merge_all(kept, f"{root}/merged")
    plans.merge_all(kept, f"{root}/merged", ["val"])
    return cells(read_block(spark, f"{root}/merged").df, "label", "split")


@register("merge_splits", f"""WITH {BLOCKS_SQL} SELECT {SPLIT} AS split, Id, label, unnest(range(len(f))) AS i,
  round(CAST(CAST(unnest(f) AS FLOAT) AS DOUBLE), 5) AS x FROM (SELECT *, {PARTS_LIST} || [{FLAGS}] AS f FROM sides)""")
def merge_splits(spark, sf):
    """Each block of each split written, merged split by split, and read back; one block lies in its alternate folder."""
    root = scratch_path(spark, "merge-splits")
    part = F.when(F.col("Id") % 10 < 8, "train").when(F.col("Id") % 10 == 8, "val").otherwise("test")
    splits = ("train", "val", "test")
    for block in blocks(spark, sf):
        whole = checks_stored(block.df.withColumnRenamed(block.vector, mg.VECTOR).withColumn("split", part), block.name)
        folder = "emo-alternate" if block.name == "emo" else block.name
        for split in splits:
            here = whole.filter(F.col("split") == split).drop("split")
            write_block(mg.Block(block.name, here, block.names), f"{root}/{folder}/{split}")
    folders = {name: [f"{root}/{name}", f"{root}/{name}-alternate"] for name in plans.BLOCKS}
    targets = plans.merge_splits(spark, folders, f"{root}/merged")
    out = None
    for split, target in zip(splits, targets):
        one = cells(read_block(spark, target).df, "label").withColumn("split", F.lit(split))
        out = one if out is None else out.unionByName(one)
    return out


LOCAL_SQL = f"""WITH {EMOTION_SQL}, {counts_sql(PLAIN)}, {context_sql(f"(SELECT *, '' AS Author, CAST(NULL AS TIMESTAMP) AS day FROM {NEWS} n)")},
  all_rows AS (SELECT n.Id, n.split, [{", ".join(f"s.{c}" for c in SIGNALS)}] || l.v || c.v AS f
    FROM {NEWS} n JOIN signals s USING (Id) JOIN (SELECT Id, [{STYLE_LIST}] AS v FROM facts) l USING (Id)
    JOIN (SELECT Id, list(CAST(x AS DOUBLE) ORDER BY i) AS v FROM vectors GROUP BY Id) c USING (Id))
  SELECT Id, split, unnest(range(len(f))) AS i, round(unnest(f), 6) AS x FROM all_rows"""


@register("local_features", LOCAL_SQL)
def local_features(spark, sf):
    """Signals, style and context of an article in one scan, without a shuffle."""
    found = plans.local_features(news(spark, sf), plans.FeatureConfig(CONTEXT, signal_text="Text"))
    long = found.select("Id", "split", F.posexplode(F.concat("signals", "style", "context")).alias("i", "x"))
    return long.select("Id", "split", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


@register("stream_features", LOCAL_SQL)
def stream_features(spark, sf):
    """Articles that arrive as files, in two runs with one checkpoint: the second goes on where the first ended."""
    root = scratch_path(spark, "stream")
    articles = checks_stored(news(spark, sf), "articles")
    config = plans.FeatureConfig(CONTEXT, signal_text="Text")
    for run in (0, 1):
        articles.where(F.pmod(F.xxhash64("Id"), F.lit(2)) == run).write.mode("append").parquet(f"{root}/in")
        arriving = spark.readStream.schema(articles.schema).parquet(f"{root}/in")
        streaming.stream_features(arriving, config, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    found = spark.read.parquet(f"{root}/out")
    long = found.select("Id", "split", F.posexplode(F.concat("signals", "style", "context")).alias("i", "x"))
    return long.select("Id", "split", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))
