"""Profiling and files."""

from pyspark.sql import functions as F

from rotativa.operators import corpus as co
from rotativa.operators import merge as mg
from rotativa.operators import profile as pr
from rotativa.plans import features as plans
from rotativa.session import scratch_path
from rotativa.sources import blocks as bl
from rotativa.sources import files, splits

from .common import NEWS, documents, news, register, s_clean, s_round, s_strip, table


def schema_sql(name: str, columns: dict[str, str]) -> str:
    values = ", ".join(f"({i}, '{c}', '{t}')" for i, (c, t) in enumerate(columns.items()))
    return f"""SELECT v.*, n_rows FROM (VALUES {values}) v(position, "column", dtype)
      CROSS JOIN (SELECT count(*) AS n_rows FROM {name})"""


@register("profile_schema", schema_sql("orders", dict(
    o_orderkey="bigint", o_custkey="bigint", o_orderstatus="string", o_totalprice="double", o_orderdate="timestamp_ntz",
    o_orderpriority="string")))
def profile_schema(spark, sf):
    return pr.profile_schema(spark.read.parquet(f"{sf}/orders.parquet"))


@register("nested_profile", schema_sql("conversations", dict(turn="bigint", role="string", text="string")))
def nested_profile(spark, sf):
    turns = table(spark, sf, "conversations")
    nested = turns.groupBy("conv_id", F.floor(F.col("turn") / 64).alias("chunk")).agg(
        F.collect_list(F.struct("turn", "role", "text")).alias("data"))
    return pr.nested_profile(nested, "data")


def nested_twice(spark, sf):
    """Turns in conversations in groups of sixteen conversations."""
    turns = table(spark, sf, "conversations").withColumn("chunk", F.floor(F.col("turn") / 64))
    talks = turns.groupBy("conv_id", "chunk").agg(F.collect_list(F.struct("turn", "role", "text")).alias("turns"))
    return talks.groupBy(F.floor(F.col("conv_id") / 16).alias("part"), "chunk").agg(F.collect_list(F.struct("conv_id", "turns")).alias("data"))


def field_sql(path: str, position: int, column: str, source: str, text: bool = False, dtype: str = "bigint") -> str:
    cut_ = f"CASE WHEN length({column}) > 500 THEN {column}[1:500] || '…' ELSE {column} END" if text else f"CAST({column} AS VARCHAR)"
    return f"""SELECT '{path}' AS path, {position} AS position, '{column}' AS "column", '{dtype}' AS dtype, count(*) AS n_rows, count({column}) AS n_present,
      {f'avg(length({column}))' if text else 'CAST(NULL AS DOUBLE)'} AS avg_len, count(DISTINCT {column}) AS n, min({cut_}) AS example FROM {source}"""


NESTED_SQL = f"""talks AS (SELECT DISTINCT conv_id // 16 AS part, turn // 64 AS chunk, conv_id FROM conversations),
  parts AS (SELECT DISTINCT part, chunk FROM talks),
  fields AS ({field_sql('', 0, 'part', 'parts')} UNION ALL {field_sql('', 1, 'chunk', 'parts')} UNION ALL {field_sql('data[]', 0, 'conv_id', 'talks')}
    UNION ALL {field_sql('data[].turns[]', 0, 'turn', 'conversations')} UNION ALL {field_sql('data[].turns[]', 1, 'role', 'conversations', True, 'string')}
    UNION ALL {field_sql('data[].turns[]', 2, 'text', 'conversations', True, 'string')}),
  guessed AS (SELECT *, CASE WHEN n <= 50 THEN n END AS n_distinct, CASE WHEN "column" = 'text' THEN 1 END AS text_rank,
    CASE WHEN n > 1 AND n <= 50 AND "column" <> 'text' THEN CAST(sum(CASE WHEN n > 1 AND n <= 50 AND "column" <> 'text' THEN 1 ELSE 0 END)
      OVER (PARTITION BY path ORDER BY position) AS INT) END AS label_rank FROM fields)"""


@register("nested_profile_deep", f"""WITH {NESTED_SQL} SELECT path, position, "column", dtype, n_rows, n_present, round(avg_len, 6) AS avg_len, n_distinct,
  example, text_rank, label_rank FROM guessed""")
def nested_profile_deep(spark, sf):
    return pr.deep_profile(nested_twice(spark, sf)).withColumn("avg_len", F.round("avg_len", 6))


@register("nested_distribution", f"""WITH {NESTED_SQL},
  long AS (SELECT '' AS path, 'part' AS "column", CAST(part AS VARCHAR) AS value FROM parts UNION ALL SELECT '', 'chunk', CAST(chunk AS VARCHAR) FROM parts
    UNION ALL SELECT 'data[]', 'conv_id', CAST(conv_id AS VARCHAR) FROM talks UNION ALL SELECT 'data[].turns[]', 'turn', CAST(turn AS VARCHAR) FROM conversations
    UNION ALL SELECT 'data[].turns[]', 'role', role FROM conversations),
  counts AS (SELECT path, "column", value, count(*) AS n FROM long JOIN (SELECT path, "column" FROM guessed WHERE label_rank = 1) USING (path, "column") GROUP BY ALL)
  SELECT path, "column", value, n FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY n DESC, value NULLS FIRST) AS r FROM counts) WHERE r <= 20""")
def nested_distribution(spark, sf):
    return pr.deep_distribution(nested_twice(spark, sf))


@register("full_profile", """SELECT 'schema' AS part, c AS name, t AS value, (SELECT count(*) FROM documents) AS n
    FROM (VALUES ('doc_id', 'bigint'), ('text', 'string'), ('lang', 'string'), ('source', 'string'), ('n_chars', 'bigint')) v(c, t)
  UNION ALL SELECT 'text', 'text', NULL, 1
  UNION ALL SELECT 'labels', c, CAST(row_number() OVER (ORDER BY p) AS VARCHAR), n FROM (SELECT * FROM (
    SELECT 'lang' AS c, 1 AS p, count(DISTINCT lang) AS n FROM documents UNION ALL SELECT 'source', 2, count(DISTINCT source) FROM documents) WHERE n > 1 AND n <= 50)
  UNION ALL SELECT 'keys', c, NULL, NULL FROM (VALUES ('doc_id'), ('text'), ('lang'), ('source'), ('n_chars')) v(c)
  UNION ALL (SELECT 'distribution', 'lang', lang, count(*) FROM documents GROUP BY lang ORDER BY count(*) DESC, lang NULLS FIRST LIMIT 20)""")
def full_profile(spark, sf):
    """Everything the profile of a table says, one line each."""
    found = pr.full_profile(table(spark, sf, "documents"))
    none, text = F.lit(None), "string"

    def lines(part, name, value=none, n=none):
        return found[part].select(F.lit(part).alias("part"), name.alias("name"), value.cast(text).alias("value"), n.cast("long").alias("n"))

    label = found["labels"].orderBy("rank").first()["column"]
    return (
        lines("schema", F.col("column"), F.col("dtype"), F.col("n_rows"))
        .unionByName(lines("text", F.col("column"), n=F.col("rank")))
        .unionByName(lines("labels", F.col("column"), F.col("rank"), F.col("n_distinct")))
        .unionByName(lines("keys", F.col("key")))
        .unionByName(lines("distribution", F.lit(label), F.col("value"), F.col("n")))
    )


@register("records_to_rows_json", """SELECT conv_id, CAST(turn AS VARCHAR) AS id,
    md5(CASE WHEN (turn % 64) % 5 = 4 THEN '' WHEN (turn % 64) % 5 = 3 THEN CAST(length(text) AS VARCHAR) ELSE text END) AS text_md5
  FROM conversations WHERE conv_id % 10 <> 9""")
def records_to_rows_json(spark, sf):
    """Conversations as JSON: lists and wrapped lists by turns, texts missing or numbers in some records, some lists empty."""
    place = F.col("turn") % 64 % 5
    turns = table(spark, sf, "conversations").withColumn("chunk", F.floor(F.col("turn") / 64))
    number, named = F.struct("turn", F.length("text").alias("text")), F.struct("turn", F.when(place != 4, F.col("text")).alias("text"))
    record = F.when(place == 3, F.to_json(number)).otherwise(F.to_json(named))
    lists = turns.groupBy("conv_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("turn", record.alias("json")))).alias("l"))
    list_ = F.concat(F.lit("["), F.array_join(F.col("l.json"), ","), F.lit("]"))
    payload = F.when(F.col("conv_id") % 10 == 9, F.lit("[]")).when(F.col("conv_id") % 2 == 0, list_).otherwise(F.concat(F.lit('{"n": 1, "data": '), list_, F.lit("}")))
    rows = co.json_records_to_rows(lists.select("conv_id", payload.alias("payload")), "payload", "text", "turn", keep=["conv_id"])
    return rows.select("conv_id", "id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@register("records_to_rows_props", "SELECT event_id, json_extract_string(props, '$.k') AS text FROM events")
def records_to_rows_props(spark, sf):
    """Each event's properties are a record by themselves."""
    return co.json_records_to_rows(table(spark, sf, "events", "event_id", "props"), "props", "k", keep=["event_id"])


@register("row_at_middle", """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice FROM lineitem ORDER BY l_orderkey, l_linenumber
  OFFSET (SELECT count(*) // 2 FROM lineitem) LIMIT 1""")
def row_at_middle(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    return pr.row_at(lines, lines.count() // 2, ["l_orderkey", "l_linenumber"], sorted_rows=256)


@register("guess_text_columns", f"SELECT 1 AS rank, 'text' AS \"column\", {s_round('avg(length(text))')} AS avg_len FROM documents")
def guess_text_columns(spark, sf):
    return pr.guess_text_columns(spark.read.parquet(f"{sf}/documents.parquet")).withColumn("avg_len", F.round("avg_len", 6))


@register("guess_text_columns_by_length", f"""SELECT CAST(row_number() OVER (ORDER BY l DESC, p) AS INT) AS rank, c AS "column",
  {s_round('l')} AS avg_len FROM (
    SELECT avg(length(c_name)) AS l, 1 AS p, 'c_name' AS c FROM customer
    UNION ALL SELECT avg(length(c_mktsegment)), 4, 'c_mktsegment' FROM customer)""")
def guess_text_columns_by_length(spark, sf):
    return pr.guess_text_columns(table(spark, sf, "customer")).withColumn("avg_len", F.round("avg_len", 6))


@register("guess_label_columns", """SELECT CAST(row_number() OVER (ORDER BY p) AS INT) AS rank, c AS "column", n AS n_distinct FROM (
    SELECT count(DISTINCT o_orderstatus) AS n, 2 AS p, 'o_orderstatus' AS c FROM orders
    UNION ALL SELECT count(DISTINCT o_orderpriority), 5, 'o_orderpriority' FROM orders
    UNION ALL SELECT count(DISTINCT o_custkey), 1, 'o_custkey' FROM orders
    UNION ALL SELECT count(DISTINCT o_orderkey), 0, 'o_orderkey' FROM orders
    UNION ALL SELECT count(DISTINCT o_totalprice), 3, 'o_totalprice' FROM orders
    UNION ALL SELECT count(DISTINCT o_orderdate), 4, 'o_orderdate' FROM orders) WHERE n > 1 AND n <= 50 LIMIT 3""")
def guess_label_columns(spark, sf):
    return pr.guess_label_columns(table(spark, sf, "orders"))


@register("guess_label_columns_by_name", "SELECT 1 AS rank, 'label' AS \"column\", count(DISTINCT label) AS n_distinct FROM embeddings")
def guess_label_columns_by_name(spark, sf):
    return pr.guess_label_columns(spark.read.parquet(f"{sf}/embeddings.parquet"))


@register("label_distribution", f"""SELECT Category AS value, count(*) AS n FROM {NEWS} n GROUP BY Category
  ORDER BY n DESC, value NULLS FIRST LIMIT 20""")
def label_distribution(spark, sf):
    return pr.label_distribution(news(spark, sf), "Category")


@register("label_distribution_top", """SELECT CAST(user_id AS VARCHAR) AS value, count(*) AS n FROM events GROUP BY user_id
  ORDER BY n DESC, value NULLS FIRST LIMIT 20""")
def label_distribution_top(spark, sf):
    return pr.label_distribution(spark.read.parquet(f"{sf}/events.parquet"), "user_id")


def cut(c: str) -> str:
    return f"CASE WHEN length({c}) > 240 THEN {c}[1:240] || '…' ELSE {c} END AS {c}"


@register("head_sample", f"SELECT {cut('Text')}, {cut('Headline')}, Category, Id, Topic FROM {NEWS} n ORDER BY Id LIMIT 5")
def head_sample(spark, sf):
    return pr.head_sample(news(spark, sf), 5, ["Text", "Headline"], ["Category"])


@register("record_keys", "SELECT DISTINCT unnest(json_keys(props)) AS key FROM events")
def record_keys(spark, sf):
    return pr.record_keys(spark.read.parquet(f"{sf}/events.parquet"), "props", order="event_id")


@register("row_at", "SELECT doc_id, text, lang, source, n_chars FROM documents ORDER BY doc_id OFFSET 17 LIMIT 1")
def row_at(spark, sf):
    return pr.row_at(spark.read.parquet(f"{sf}/documents.parquet"), 17, "doc_id")


# --- files ------------------------------------------------------------------------------------------------------

@register("read_splits", f"SELECT Id, split, md5(Text) AS text_md5, Topic FROM {NEWS} n")
def read_splits(spark, sf):
    """Written as one dataset per split under an alias, and found again by it."""
    folder = scratch_path(spark, "splits")
    for split, name in {"train": "train", "val": "development", "test": "test"}.items():
        part = news(spark, sf).filter(F.col("split") == split).select("Id", "Text", "Topic")
        part.write.parquet(f"{folder}/{name}.parquet")
    return splits.read_splits(spark, folder).select("Id", "split", F.md5(F.col("Text").cast("binary")).alias("text_md5"), "Topic")


JOINED = s_strip("coalesce(Headline, '') || chr(10) || chr(10) || coalesce(Text, '')")


@register("preprocess_corpus", f"SELECT Id, split, md5({s_clean(JOINED)}) AS text_md5, Category AS label FROM {NEWS} n")
def preprocess_corpus(spark, sf):
    folder = scratch_path(spark, "corpus")
    for split in ("train", "val", "test"):
        part = news(spark, sf).filter(F.col("split") == split).drop("split")
        part.write.parquet(f"{folder}/{split}.parquet")
    cleaned = plans.preprocess_corpus(spark, folder, f"{folder}/out")
    return cleaned.select("Id", "split", F.md5(F.col("text_xlmr").cast("binary")).alias("text_md5"), "label")


@register("convert_folder", "SELECT 'part of ' || role || '=1' AS stem, conv_id, turn, md5(text) AS text_md5 FROM conversations")
def convert_folder(spark, sf):
    """JSON files named after the role, one folder for each part of a table, become one dataset per role; the stems have
    to be told from the paths."""
    folder = scratch_path(spark, "folder")
    turns, schema = table(spark, sf, "conversations"), "conv_id long, turn long, text string, role string"
    turns.withColumn("by", F.col("role")).write.partitionBy("by").json(f"{folder}-parts")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    system = hadoop(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for role in [r["role"] for r in turns.select("role").distinct().collect()]:
        for n, part in enumerate(files.matching_files(spark, f"{folder}-parts/by={role}", "*.json")):
            system.mkdirs(hadoop(f"{folder}/{n}"))
            system.rename(hadoop(part), hadoop(f"{folder}/{n}/part of {role}=1.json"))
    paths = files.convert_folder(spark, folder, "*/*.json", f"{folder}-out", schema)
    out = spark.read.option("basePath", f"{folder}-out").schema(f"{schema}, stem string").parquet(*paths)
    return out.select("stem", "conv_id", "turn", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@register("export_csv", "SELECT doc_id AS Id, md5(text) AS text_md5, lang, source, n_chars FROM documents")
def export_csv(spark, sf):
    path = scratch_path(spark, "csv")
    files.export_csv(documents(spark, sf, "lang", "source", "n_chars"), path)
    back = files.read_csv(spark, path, "Id long, text string, lang string, source string, n_chars long")
    return back.select("Id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "lang", "source", "n_chars")


BLOCK_SQL = """SELECT Id, 'sem_sem_emb_' || i AS name, round(CAST(x AS DOUBLE), 6) AS x FROM (
  SELECT vec_id AS Id, unnest(range(64)) AS i, unnest(embedding) AS x FROM embeddings)"""


@register("write_block", BLOCK_SQL)
def write_block(spark, sf):
    """Round trip of vectors and names."""
    vectors = table(spark, sf, "embeddings", "vec_id", "embedding").toDF("Id", "features")
    path = scratch_path(spark, "block")
    names = mg.prefix_names([f"sem_emb_{i}" for i in range(64)], "sem_", always=True)
    bl.write_block(mg.Block("sem", vectors, tuple(names)), path, {"pooling": "mean"})
    block = bl.read_block(spark, path)
    named = block.df.select("Id", F.posexplode("features").alias("i", "x"))
    listed = spark.read.parquet(f"{path}/meta").select(F.col("position").alias("i"), "name")
    return named.join(F.broadcast(listed), "i").select("Id", "name", F.round(F.col("x").cast("double"), 6).alias("x"))


@register("run_log", """SELECT 'style' AS step, count(*) AS num_samples, 3 AS num_columns FROM documents""")
def run_log(spark, sf):
    logged = bl.run_log(documents(spark, sf, "lang"), scratch_path(spark, "log"), "style", {"lang": "es"})
    return logged.select("step", "num_samples", "num_columns")
