"""Pooling of token vectors and the semantic frame. Texts are the labels of ``embeddings``, tokens its rows."""

from pyspark.sql import functions as F

from rotativa.operators import scoring
from rotativa.operators import semantic as sem

from .common import NEWS, documents, news, register, s_round, table, with_workers

DIM = 64
WEIGHTS = [((i * 7) % 5 - 2) / 10 for i in range(DIM)]
BIAS, V = 0.05, 1.5


def token_vectors(spark, sf):
    return table(spark, sf, "embeddings", "label", "vec_id", "embedding").select(
        F.col("label").cast("long").alias("Id"), F.col("vec_id").alias("pos"),
        F.when(F.col("vec_id") % 7 != 0, 1).otherwise(0).alias("mask"), F.col("embedding").alias("emb"))


TOKENS = """tokens AS (SELECT CAST(label AS BIGINT) AS Id, vec_id AS pos, CASE WHEN vec_id % 7 <> 0 THEN 1 ELSE 0 END AS mask,
  embedding AS emb FROM embeddings),
  cells AS (SELECT Id, pos, mask, unnest(range(64)) AS i, CAST(unnest(emb) AS DOUBLE) AS x FROM tokens)"""


def exploded(df):
    return df.select("Id", F.posexplode("sem_emb").alias("i", "x")).select(
        "Id", F.col("i").cast("long").alias("i"), F.round(F.col("x").cast("double"), 6).alias("x"))


@register("pool_mean", f"""WITH {TOKENS} SELECT Id, i, {s_round('sum(x * mask) / greatest(sum(mask), 1e-6)')} AS x
  FROM cells GROUP BY Id, i""")
def pool_mean(spark, sf):
    return exploded(sem.pool_mean(token_vectors(spark, sf), DIM))


WIDE = 12


@register("pool_mean_768", f"""WITH {TOKENS} SELECT Id, i + 64 * k AS i, {s_round('sum(x * mask) / greatest(sum(mask), 1e-6)')} AS x
  FROM cells CROSS JOIN range({WIDE}) r(k) GROUP BY Id, i, k""")
def pool_mean_768(spark, sf):
    """As many dimensions as usual encoders have: each vector twelve times."""
    wide = token_vectors(spark, sf).withColumn("emb", F.flatten(F.array_repeat("emb", WIDE)))
    return exploded(sem.pool_mean(wide, DIM * WIDE))


@register("pool_cls", f"WITH {TOKENS} SELECT Id, i, {s_round('arg_min(x, pos)')} AS x FROM cells GROUP BY Id, i")
def pool_cls(spark, sf):
    return exploded(sem.pool_cls(token_vectors(spark, sf)))


SCORES = f"""dots AS (SELECT Id, pos, mask, sum(x * (((i * 7) % 5 - 2) / 10)) + {BIAS} AS dot FROM cells GROUP BY ALL),
  scores AS (SELECT Id, pos, CASE WHEN mask = 1 THEN {V} * tanh(dot) ELSE -1e9 END AS s FROM dots),
  weights AS (SELECT Id, pos, exp(s - max(s) OVER (PARTITION BY Id)) AS w FROM scores)"""
ATTENTION_SQL = f"""WITH {TOKENS}, {SCORES} SELECT c.Id, c.i, {s_round('sum(c.x * w.w) / sum(w.w)')} AS x
  FROM cells c JOIN weights w ON w.Id = c.Id AND w.pos = c.pos GROUP BY c.Id, c.i"""


@register("pool_attention", ATTENTION_SQL)
def pool_attention(spark, sf):
    return exploded(sem.pool_attention(token_vectors(spark, sf), DIM, [WEIGHTS], [BIAS], [V]))


@register("pool_attention_wide", ATTENTION_SQL)
def pool_attention_wide(spark, sf):
    """The same scores from twenty units: too many weights for an expression, so Arrow batches do the product."""
    units = 20
    return exploded(sem.pool_attention(
        token_vectors(spark, sf), DIM, [WEIGHTS] * units, [BIAS] * units, [V / units] * units))


@register("truncate_tokens", f"""WITH {TOKENS} SELECT Id, pos FROM (SELECT Id, pos,
  row_number() OVER (PARTITION BY Id ORDER BY pos) AS r FROM tokens) WHERE r <= 16""")
def truncate_tokens(spark, sf):
    return sem.truncate_tokens(token_vectors(spark, sf), 16).select("Id", "pos")


class CountingEncoder:
    """A stand-in for an encoder: length, words and vowels of a text."""

    def encode(self, texts):
        return [[len(t), t.count(" ") + 1, sum(t.count(c) for c in "aeiou")] for t in texts]


ENCODED = """(SELECT doc_id AS Id, length(text) AS a, length(text) - length(replace(text, ' ', '')) + 1 AS b,
  length(text) - length(regexp_replace(text, '[aeiou]', '', 'g')) AS c FROM documents)"""


def encoded(spark, sf):
    with_workers(spark)
    return scoring.embed_documents(documents(spark, sf), "text", CountingEncoder)


def cells(column="sem_emb"):
    return [F.col(column)[i].cast("double").alias(n) for i, n in enumerate("abc")]


@register("embed_documents", f"SELECT Id, CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, CAST(c AS DOUBLE) AS c FROM {ENCODED} e")
def embed_documents(spark, sf):
    return encoded(spark, sf).select("Id", *cells())


@register("semantic_frame", f"""WITH {TOKENS}, pooled AS (SELECT Id, i, {s_round('sum(x * mask) / greatest(sum(mask), 1e-6)')} AS x
    FROM cells GROUP BY Id, i)
  SELECT n.Id, n.Category AS label, i, x, 'mean' AS pooling, 'table' AS model_name, 256 AS max_len FROM {NEWS} n LEFT JOIN pooled p USING (Id)""")
def semantic_frame(spark, sf):
    """Pooled token vectors beside every article; most have none."""
    frame = sem.semantic_frame(news(spark, sf), sem.pool_mean(token_vectors(spark, sf), DIM), "mean", "table")
    long = frame.select("Id", "label", F.posexplode_outer("sem_emb").alias("i", "x"), "pooling", "model_name", "max_len")
    return long.withColumn("i", F.col("i").cast("long")).withColumn("x", F.round("x", 6))
