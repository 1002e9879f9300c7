"""Links, authors, dates and hashed embeddings."""

from datetime import datetime, timezone

from pyspark.sql import functions as F

from rotativa.functions import context as ctx
from rotativa.operators import context as cx

from .common import NEWS, S_SPACE, news, q, register, rounded, s_round, s_strip, s_sub, table

AS_OF = datetime(2024, 6, 1, 12, 0, 0, tzinfo=timezone.utc)
AS_OF_SQL = "TIMESTAMP '2024-06-01 12:00:00'"

# Each page's link in the forms links come in: Spark and SQL expression by form.
FORMS = {
    "plain": (lambda u, k: u, "url"),
    "upper": (lambda u, k: F.upper(u), "upper(url)"),
    "bare": (lambda u, k: F.regexp_replace(u, "^https?://", "www."), "regexp_replace(url, '^https?://', 'www.')"),
    "relative": (lambda u, k: F.regexp_replace(u, "^https?:", ""), "regexp_replace(url, '^https?:', '')"),
    "login": (lambda u, k: F.regexp_replace(u, "^https?://", "http://Ana:Pw@WWW."),
              "regexp_replace(url, '^https?://', 'http://Ana:Pw@WWW.')"),
    "author_path": (lambda u, k: F.concat(F.regexp_replace(u, "[?#].*$", ""), F.lit("/Autor/Juan-P_rez--"), k, F.lit("/x")),
                    "regexp_replace(url, '[?#].*$', '') || '/Autor/Juan-P_rez--' || page_id || '/x'"),
    "author_query": (lambda u, k: F.concat(F.regexp_replace(u, "[?#].*$", ""), F.lit("?a=1&Author=ana__m"), k),
                     "regexp_replace(url, '[?#].*$', '') || '?a=1&Author=ana__m' || page_id"),
    "short_author": (lambda u, k: F.concat(F.regexp_replace(u, "[?#].*$", ""), F.lit("/author/-/?author=bob")),
                     "regexp_replace(url, '[?#].*$', '') || '/author/-/?author=bob'"),
    "broken": (lambda u, k: F.concat(F.lit("http://["), F.regexp_replace(u, "^https?://", "")),
               "'http://[' || regexp_replace(url, '^https?://', '')"),
    "port_only": (lambda u, k: F.concat(F.lit("example.com:8080/"), k), "'example.com:8080/' || page_id"),
}


def links(spark, sf):
    pages = table(spark, sf, "pages", "page_id", "url")
    forms = [
        F.struct(F.lit(name).alias("form"), make(F.col("url"), F.col("page_id").cast("string")).alias("link"))
        for name, (make, _) in FORMS.items()
    ]
    return pages.select("page_id", F.inline(F.array(*forms)))


LINKS = "(" + " UNION ALL ".join(
    f"SELECT page_id, {q(name)} AS form, {sql} AS link FROM pages" for name, (_, sql) in FORMS.items()) + ")"

PARTS = f"""parts AS (SELECT *, regexp_extract(rest, '^//([^/?#]*)', 1) AS netloc,
  regexp_extract(rest, '^(?://[^/?#]*)?([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*[?]([^#]*)', 1) AS query
  FROM (SELECT *, regexp_replace(link, '^[A-Za-z][A-Za-z0-9+.-]*:', '') AS rest FROM {{}} l)),
  urls AS (SELECT *, contains(netloc, '[') <> contains(netloc, ']') AS broken FROM parts)"""
DOMAIN = f"""CASE WHEN broken THEN '' ELSE regexp_replace({s_strip("lower(CASE WHEN netloc <> '' THEN netloc "
  "WHEN contains(split_part(path, '/', 1), '.') THEN split_part(path, '/', 1) ELSE '' END)")}, '^www\\.', '') END"""


def cleaned(x: str) -> str:
    name = s_strip(s_sub(f"translate({x}, '-_', '  ')", f"[{S_SPACE}]+", " "))
    return f"CASE WHEN length({name}) < 2 THEN '' ELSE {name} END"


IN_PATH = "regexp_extract(trim(path, '/'), '(?i)(?:^|/)(?:author|autor)/([^/]+)', 1)"
IN_QUERY = "regexp_extract(query, '(?i)(?:^|&)(?:author|autor)=([^&]+)', 1)"
AUTHOR = f"""CASE WHEN broken THEN '' WHEN {IN_PATH} <> '' THEN {cleaned(IN_PATH)} ELSE {cleaned(IN_QUERY)} END"""


@register("url_domain", f"WITH {PARTS.format(LINKS)} SELECT page_id, form, {DOMAIN} AS domain FROM urls")
def url_domain(spark, sf):
    return links(spark, sf).select("page_id", "form", ctx.url_domain(F.col("link")).alias("domain"))


@register("url_author", f"WITH {PARTS.format(LINKS)} SELECT page_id, form, {AUTHOR} AS author FROM urls")
def url_author(spark, sf):
    return links(spark, sf).select("page_id", "form", ctx.url_author(F.col("link")).alias("author"))


@register("given_author", f"""WITH {PARTS.format(LINKS)} SELECT page_id, form,
  CASE WHEN page_id % 2 = 0 THEN {s_strip("' Redacción ' || page_id || chr(160)")} ELSE {AUTHOR} END AS author FROM urls""")
def given_author(spark, sf):
    given = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit(" Redacción "), F.col("page_id"), F.lit(" ")))
    return links(spark, sf).select("page_id", "form", ctx.author(ctx.url_parts(F.col("link")), given).alias("author"))


@register("clean_author", f"SELECT doc_id AS Id, {cleaned('source')} AS author FROM (SELECT doc_id, source || '-_' || lang || '__' AS source FROM documents)")
def clean_author(spark, sf):
    docs = table(spark, sf, "documents", "doc_id", "source", "lang")
    raw = F.concat("source", F.lit("-_"), "lang", F.lit("__"))
    return docs.select(F.col("doc_id").alias("Id"), ctx.clean_author(raw).alias("author"))


def md5_key(field: str, j, value: str) -> str:
    return f"md5({q(field + '|')} || {j} || '|' || {s_strip(f'lower({s_strip(value)})')})"


def s_index(key: str, dim: int) -> str:
    return f"CAST(('0x' || substr({key}, 1, 8))::BIGINT % {dim} AS INT)"


def s_sign(key: str) -> str:
    return f"CASE WHEN ('0x' || substr({key}, 9, 1))::BIGINT % 2 = 1 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END"


@register("hash_index_sign", f"""SELECT DISTINCT source AS value, j, {s_index(md5_key('source', 'j', 'source'), 32)} AS idx,
  {s_sign(md5_key('source', 'j', 'source'))} AS sign, 1.0::DOUBLE AS unsigned
  FROM documents CROSS JOIN (SELECT unnest([0, 1, 2]) AS j)""")
def hash_index_sign(spark, sf):
    values = table(spark, sf, "documents", "source").distinct()
    rows = []
    for j in range(3):
        key = ctx.hash_key(F.col("source"), "source", j)
        rows.append(F.struct(
            F.lit(j).alias("j"), ctx.hash_index(key, 32).alias("idx"), ctx.hash_sign(key).alias("sign"),
            ctx.hash_sign(key, signed=False).alias("unsigned")))
    return values.select(F.col("source").alias("value"), F.inline(F.array(*rows)))


def embed_sql(field: str, value: str, dim: int, source: str, n: int = 2, key: str = "Id") -> str:
    """One row per id and dimension, signs summed and divided by their norm; values must be unique per key."""
    return f"""(SELECT {key}, i, CASE WHEN norm > 0 THEN s / norm ELSE 0.0 END AS x FROM (
    SELECT *, sqrt(sum(s * s) OVER (PARTITION BY {key})) AS norm FROM (
      SELECT v.{key}, r.i, coalesce(sum(h.sign), 0.0) AS s FROM {source} v
      CROSS JOIN (SELECT unnest(range({dim})) AS i) r
      LEFT JOIN (SELECT {key}, {s_index(md5_key(field, 'j', value), dim)} AS idx, {s_sign(md5_key(field, 'j', value))} AS sign
        FROM {source} w CROSS JOIN (SELECT unnest(range({n})) AS j) js WHERE {s_strip(f"coalesce({value}, '')")} <> '') h
      ON h.{key} = v.{key} AND h.idx = r.i GROUP BY v.{key}, r.i)))"""


def exploded(df, vector, key="Id"):
    long = df.select(key, F.posexplode(vector).alias("i", "x"))
    return long.select(key, F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


FIELD_SOURCES = {
    "source": ("Source", 32, f"(SELECT Id, Source FROM {NEWS} n)", "Source"),
    "domain": ("_d", 32, f"(WITH {PARTS.format('(SELECT Id, Link AS link FROM ' + NEWS + ' n WHERE Link IS NOT NULL)')} "
               f"SELECT n.Id, coalesce({DOMAIN}, '') AS d FROM {NEWS} n LEFT JOIN urls USING (Id))", "d"),
    "topic": ("Topic", 16, f"(SELECT Id, Topic FROM {NEWS} n)", "Topic"),
    "author": ("_a", 16, f"(SELECT Id, upper(Source) || ' ' || Topic AS a FROM {NEWS} n)", "a"),
}


def with_fields(spark, sf):
    return news(spark, sf).withColumns({
        "_d": ctx.url_domain(F.col("Link")), "_a": F.concat(F.upper("Source"), F.lit(" "), "Topic")})


def one_field(field):
    column, dim, source, value = FIELD_SOURCES[field]

    @register(f"hash_{field}", f"SELECT Id, CAST(i AS BIGINT) AS i, {s_round('x')} AS x FROM {embed_sql(field, value, dim, source)} e")
    def run(spark, sf):
        return exploded(cx.hash_embed(with_fields(spark, sf), {field: (column, dim)}), f"{field}_emb")


for name in FIELD_SOURCES:
    one_field(name)


@register("hash_embed", f"""SELECT word AS value, CAST(i AS BIGINT) AS i, {s_round('x')} AS x FROM {embed_sql(
    'word', 'word', 8, "(SELECT DISTINCT unnest(string_split(text, ' ')) AS word FROM benchmark)", 4, 'word')} e""")
def hash_embed(spark, sf):
    """Many values in few dimensions: signs meet and cancel."""
    words = table(spark, sf, "benchmark", "text").select(F.explode(F.split("text", " ")).alias("value")).distinct()
    return exploded(cx.hash_embed(words, {"word": ("value", 8)}, n_hashes=4), "word_emb", "value")


# --- dates ------------------------------------------------------------------------------------------------------

DATES = {
    "iso": ("yyyy-MM-dd'T'HH:mm:ss'Z'", "epoch_us"),
    "iso_offset": ("yyyy-MM-dd HH:mm:ss'+02:00'", "epoch_us - 7200000000"),
    "iso_day": ("yyyy-MM-dd", "epoch_us"),
    "dmy": ("dd/MM/yyyy", "epoch_us"),
    # Month first is only read as such where the day cannot be a month.
    "mdy": ("M/d/yyyy", "CASE WHEN day(o_orderdate) <= 12 THEN epoch_us(make_timestamp(year(o_orderdate), "
                        "day(o_orderdate), month(o_orderdate), 0, 0, 0.0)) ELSE epoch_us END"),
    "dashes": ("d-M-yyyy", "epoch_us"),
    "ymd": ("yyyy/MM/dd", "epoch_us"),
    "compact": ("yyyyMMdd", "epoch_us"),
    "text": ("'el' d 'de' MMMM", "NULL"),
    "blank": ("' '", "NULL"),
}


def dates(spark, sf):
    orders = table(spark, sf, "orders", "o_orderkey", "o_orderdate")
    day = F.col("o_orderdate").cast("timestamp")
    forms = [F.struct(F.lit(n).alias("form"), F.date_format(day, pattern).alias("date")) for n, (pattern, _) in DATES.items()]
    seconds = F.unix_seconds(day)
    forms += [
        F.struct(F.lit("epoch").alias("form"), F.lpad(seconds.cast("string"), 10, "0").alias("date")),
        F.struct(F.lit("millis").alias("form"), F.lpad((seconds * 1000 + 999).cast("string"), 13, "0").alias("date")),
        F.struct(F.lit("null").alias("form"), F.lit(None).cast("string").alias("date")),
    ]
    return orders.select("o_orderkey", F.inline(F.array(*forms)))


EXPECTED = {name: sql for name, (_, sql) in DATES.items()} | {"epoch": "epoch_us", "millis": "epoch_us", "null": "NULL"}
DATES_SQL = "(" + " UNION ALL ".join(
    f"SELECT o_orderkey, {q(name)} AS form, CAST({sql} AS BIGINT) AS us FROM "
    "(SELECT *, epoch_us(o_orderdate) AS epoch_us FROM orders)" for name, sql in EXPECTED.items()) + ")"


@register("parse_date", f"SELECT o_orderkey, form, us FROM {DATES_SQL} d")
def parse_date(spark, sf):
    return dates(spark, sf).select("o_orderkey", "form", F.unix_micros(ctx.parse_date(F.col("date"))).alias("us"))


def s_age(us: str, cap: str = "3650") -> str:
    days = f"CAST(epoch_us({AS_OF_SQL}) - {us} AS DOUBLE) / 1e6 / 86400.0"
    return f"CASE WHEN {us} IS NULL THEN -1.0 ELSE greatest(least({days}, {cap}), -{cap}) END"


@register("age_days", f"SELECT o_orderkey, form, {s_round(s_age('us'))} AS age FROM {DATES_SQL} d")
def age_days(spark, sf):
    age = ctx.age_days(F.col("date"), F.lit(AS_OF))
    return rounded(dates(spark, sf).select("o_orderkey", "form", age.alias("age")), "age")


@register("age_days_events", f"SELECT event_id, {s_round(s_age('epoch_us(ts)', '60'))} AS age FROM events")
def age_days_events(spark, sf):
    events = table(spark, sf, "events", "event_id", "ts")
    date = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return rounded(events.select("event_id", ctx.age_days(date, F.lit(AS_OF), cap=60).alias("age")), "age")


# --- the block --------------------------------------------------------------------------------------------------

CONFIG = cx.ContextConfig(as_of=AS_OF, author="Author", date="Date")


def dated_news(spark, sf):
    """News with an author where there is no link, and the date of the order with the same key."""
    orders = table(spark, sf, "orders", "o_orderkey", "o_orderdate")
    day = orders.select(
        F.col("o_orderkey").alias("Id"), F.date_format(F.col("o_orderdate").cast("timestamp"), "dd/MM/yyyy").alias("Date"))
    linked = news(spark, sf).join(day, "Id", "left")
    return linked.withColumn("Author", F.when(F.col("Link").isNull(), F.concat(F.lit(" Ana "), "Source"))).withColumn(
        "Link", F.concat("Link", F.lit("/author/x-"), "Source"))


DATED = f"""(SELECT n.* EXCLUDE (Link), n.Link || '/author/x-' || n.Source AS Link,
  CASE WHEN n.Link IS NULL THEN 'Ana ' || n.Source ELSE '' END AS Author, o.o_orderdate AS day
  FROM {NEWS} n LEFT JOIN orders o ON o.o_orderkey = n.Id)"""


def context_sql(dated: str) -> str:
    """CTEs up to ``vectors (Id, i, x)``; ``dated`` has Id, Link, Source, Topic, Author and day."""
    return f"""dated AS (SELECT * FROM {dated} x),
  {PARTS.format("(SELECT Id, coalesce(Link, '') AS link FROM dated)")},
  fields AS (SELECT d.Id, coalesce(d.Link, '') AS link, coalesce(Source, '') AS source, coalesce(Topic, '') AS topic,
    day, {DOMAIN} AS domain, CASE WHEN Author <> '' THEN Author ELSE {AUTHOR} END AS author
    FROM dated d JOIN urls USING (Id)),
  vectors AS (
    SELECT Id, i, x FROM {embed_sql('source', 'source', 32, 'fields')} a
    UNION ALL SELECT Id, i + 32, x FROM {embed_sql('domain', 'domain', 32, 'fields')} b
    UNION ALL SELECT Id, i + 64, x FROM {embed_sql('topic', 'topic', 16, 'fields')} c
    UNION ALL SELECT Id, i + 80, x FROM {embed_sql('author', 'author', 16, 'fields')} d
    UNION ALL SELECT Id, 96, {s_age('epoch_us(day)')} FROM fields
    UNION ALL SELECT Id, 97 + f.i, CASE WHEN f.v <> '' THEN 1.0 ELSE 0.0 END FROM (SELECT Id,
      unnest([link, domain, source, topic, author, coalesce(CAST(day AS VARCHAR), '')]) AS v, unnest(range(6)) AS i FROM fields) f)"""


CONTEXT_SQL = context_sql(DATED)


@register("context_features", f"""WITH {CONTEXT_SQL} PIVOT (SELECT Id, {s_round('x')} AS x,
  ({list(CONFIG.names)})[i + 1] AS name FROM vectors) ON name IN ({', '.join(map(q, CONFIG.names))}) USING sum(x) GROUP BY Id""")
def context_features(spark, sf):
    return rounded(cx.context_features(dated_news(spark, sf), CONFIG), *CONFIG.names)


@register("context_flags", f"""WITH {CONTEXT_SQL} PIVOT (SELECT Id, x, ({list(CONFIG.names)})[i + 1] AS name FROM vectors WHERE i > 96)
  ON name IN ({', '.join(map(q, cx.FLAG_NAMES))}) USING sum(x) GROUP BY Id""")
def context_flags(spark, sf):
    fields = cx.with_context_fields(dated_news(spark, sf), CONFIG)
    return fields.select("Id", *[c.alias(name) for name, c in cx.flags().items()])
