"""The operators bound to the driver tables: queries ``opN_<name>`` and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, bpe, decontam, embed, html_text, langid, lm, manifest, pii, secret_scan, simhash, token_counts, warc
from .common import fold_of, span_digest, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


# SQL. Patterns are spelled out here, not taken from the operators.

# Base spans of one kind: pieces between matches add up to the places.
PLACES_SQL = """{name} AS (SELECT doc_id, place AS s, place + length(hit) AS e, hit FROM (
    SELECT doc_id, hit, sum(length(piece)) OVER w + coalesce(sum(length(hit)) OVER (PARTITION BY doc_id ORDER BY i
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
    FROM (SELECT doc_id, unnest(string_split_regex(t, '{pattern}')) AS piece,
        unnest(list_append(regexp_extract_all(t, '{pattern}'), NULL)) AS hit, unnest(range(len(string_split_regex(t, '{pattern}')))) AS i
      FROM texts) WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE hit IS NOT NULL)"""
TEXTS_SQL = "texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)"


def places(name: str, pattern: str) -> str:
    return PLACES_SQL.replace("{name}", name).replace("{pattern}", pattern.replace("'", "''"))


def digest_sql(kinds: tuple[str, ...], order: str) -> str:
    counts = ", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in kinds)
    sums = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in kinds)
    listed = f"string_agg(kind || ':' || s || ':' || e, ',' ORDER BY {order})"
    return f"""SELECT doc_id, {counts}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
  FROM texts LEFT JOIN (SELECT doc_id, {sums}, {listed} FILTER (WHERE rank < {len(kinds)}) AS base, {listed} AS spans
    FROM found GROUP BY doc_id) USING (doc_id)"""


ASSIGN_KEYS = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
ASSIGN_SQL = ASSIGN_KEYS + """["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ENTROPY_SQL = """{kind} AS (SELECT doc_id, min(s) AS s, max(e) AS e FROM (
    SELECT *, sum(CASE WHEN s > last THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM (
      SELECT doc_id, s, s + 20 AS e, max(s + 20) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last
      FROM (SELECT doc_id, c.s + i AS s, -sum(n / 20.0 * log2(n / 20.0)) AS bits FROM (
          SELECT doc_id, s, i, ch, count(*) AS n FROM (SELECT doc_id, s, i, unnest(string_split(hit[i + 1:i + 20], '')) AS ch FROM (
            SELECT doc_id, s, hit, unnest(range(length(hit) - 19)) AS i FROM c_{kind} JOIN texts USING (doc_id)
            WHERE NOT regexp_matches(hit, '^[^0-9]*$|^[^A-Za-z]*$|^[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$|(?i:0123456789abcdef|abcdefghijklmnop|example)')
              AND NOT regexp_matches(t[greatest(s - 15, 1):s], '(?i)(?:sha(?:1|256|384|512)[-:=]\\x20?|md5[:=]\\x20?|commit\\x20|checksum[:=]?\\x20)$')))
          GROUP BY ALL) c GROUP BY doc_id, c.s, i HAVING bits >= {bits} - 1e-6))) GROUP BY doc_id, run)"""


def entropy_sql(kind: str, characters: str, bits: float) -> str:
    return places(f"c_{kind}", f"[{characters}]{{20,}}") + ",\n" + ENTROPY_SQL.replace("{kind}", kind).replace("{bits}", str(bits))


SECRETS_SQL = f"""WITH {TEXTS_SQL}, {places("p_assign", ASSIGN_SQL)}, {places("p_access", "AKIA[A-Z0-9]+")}, {places("p_hex", "[0-9a-f]{{32,}}".replace("{{", "{").replace("}}", "}"))},
  {entropy_sql("entropy_hex", "0-9A-Fa-f", 3.0)}, {entropy_sql("entropy_base64", "A-Za-z0-9+/_=-", 3.75)},
  base AS (SELECT doc_id, 'assign' AS kind, 0 AS rank, s, e FROM p_assign WHERE length(regexp_extract(hit, '{ASSIGN_SQL.replace("'", "''")}', 2)) >= 8
    UNION ALL SELECT doc_id, 'access', 1, s, e FROM p_access WHERE e - s >= 16 UNION ALL SELECT doc_id, 'hex', 2, s, e FROM p_hex),
  more AS (SELECT doc_id, 'entropy_hex' AS kind, 3 AS rank, s, e FROM entropy_hex UNION ALL SELECT doc_id, 'entropy_base64', 4, s, e FROM entropy_base64),
  found AS (SELECT * FROM base UNION ALL SELECT * FROM more m WHERE NOT EXISTS (
    FROM base b WHERE b.doc_id = m.doc_id AND b.s <= m.s AND m.e <= b.e))
  {digest_sql(("assign", "access", "hex"), "s, rank")}"""

LUHN_SQL = "list_sum([CASE WHEN i % 2 = 0 THEN CAST(d[-i - 1] AS INT) ELSE CAST(d[-i - 1] AS INT) * 2 - CASE WHEN CAST(d[-i - 1] AS INT) > 4 THEN 9 ELSE 0 END END FOR i IN range(length(d))]) % 10 = 0"
# The generated documents hold none of the kinds that the method adds, so their spans are those of the patterns.
PERSONAL_SQL = f"""WITH {TEXTS_SQL}, {places("p_email", "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+")},
  {places("p_ip", "[0-9]+(?:[.][0-9]+)(?:[.][0-9]+)(?:[.][0-9]+)")}, {places("p_card", "[0-9](?:[ -]?[0-9])+")}, {places("p_phone", "[+][0-9][ ().0-9-]+[0-9]")},
  found AS (SELECT doc_id, 'email' AS kind, 0 AS rank, s, e FROM p_email
    UNION ALL SELECT doc_id, 'ip', 1, s, e FROM p_ip WHERE list_max([CAST(p AS HUGEINT) FOR p IN string_split(hit, '.')]) <= 255
    UNION ALL SELECT doc_id, 'card', 2, s, e FROM (SELECT *, regexp_replace(hit, '[^0-9]', '', 'g') AS d FROM p_card) WHERE length(d) BETWEEN 16 AND 19 AND {LUHN_SQL}
    UNION ALL SELECT doc_id, 'phone', 3, s, e FROM p_phone WHERE length(regexp_replace(hit, '[^0-9]', '', 'g')) BETWEEN 8 AND 15)
  {digest_sql(("email", "ip", "card", "phone"), "rank, s")}"""

WARC_SQL = """WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
  d AS (SELECT *, sha256(h) AS payload_digest, CAST(strlen(h) AS BIGINT) AS payload_bytes, min(page_id) OVER (PARTITION BY h) AS first FROM p),
  r AS (SELECT *, payload_bytes >= 100 AND page_id <> first AS again FROM d)
  SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN again THEN first END AS refers_to, url FROM r"""

# The generated pages have one article of h1, p, b and br.
PAGE_SQL = r"""WITH blocks AS (SELECT page_id, url, list_filter(list_transform(
      string_split_regex(regexp_replace(replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '<br>', ' '), '</?b>', '', 'g'), '</?(?:p|h1)>'),
      lambda b: trim(regexp_replace(regexp_replace(regexp_replace(b, '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda b: b <> '') AS b FROM pages)
  SELECT page_id, url, coalesce(array_to_string(b, chr(10) || chr(10)), '') AS text, CAST(length(coalesce(array_to_string(b, chr(10) || chr(10)), '')) AS BIGINT) AS n_chars FROM blocks"""

EMBEDDINGS_SQL = """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
  links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
  reached(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b)
  SELECT a AS vec_id, (SELECT count(*) FROM links WHERE links.a = r.a) AS n_links, min(b) AS component_id, a = min(b) AS kept
  FROM reached r GROUP BY a"""

WORDS_SQL = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
GRAMS_SQL = "[array_to_string(words[i:i + k - 1], ' ') FOR i IN range(1, len(words) - k + 2)]"
LEAKS_SQL = f"""WITH d AS (SELECT doc_id, {WORDS_SQL} AS words, 5 AS k FROM documents),
  i AS (SELECT item_id, words, len(words) AS w, least(len(words), 5) AS k FROM (SELECT item_id, {WORDS_SQL} AS words FROM benchmark) WHERE len(words) > 0),
  ig AS (SELECT item_id, w, k, {GRAMS_SQL} AS grams FROM i),
  dg AS (SELECT doc_id, words, {GRAMS_SQL} AS grams FROM d),
  shared AS (SELECT DISTINCT doc_id, item_id FROM (SELECT doc_id, unnest(grams) AS g FROM dg) JOIN (SELECT item_id, unnest(grams) AS g FROM ig) USING (g)),
  wins AS (SELECT doc_id, item_id, st, grams[st + 1:st + w - k + 1] AS grams FROM (
    SELECT doc_id, item_id, w, k, dg.grams, unnest(range(greatest(len(words) - w, 0) + 1)) AS st
    FROM shared JOIN dg USING (doc_id) JOIN (SELECT item_id, w, k FROM ig) USING (item_id))),
  counts AS (SELECT doc_id, item_id, st, g, count(*) AS n FROM (SELECT doc_id, item_id, st, unnest(grams) AS g FROM wins) GROUP BY ALL),
  own AS (SELECT item_id, g, count(*) AS m FROM (SELECT item_id, unnest(grams) AS g FROM ig) GROUP BY ALL),
  total AS (SELECT item_id, len(grams) AS size FROM ig),
  overlap AS (SELECT doc_id, item_id, st, sum(n) AS size, sum(least(n, coalesce(m, 0))) AS common FROM counts LEFT JOIN own USING (item_id, g) GROUP BY ALL),
  alike AS (SELECT doc_id, item_id, st, CAST(common AS DOUBLE) / (b.size + t.size - common) AS similarity FROM overlap b JOIN total t USING (item_id))
  SELECT doc_id, item_id, max(similarity) AS similarity, CAST(arg_min(st, (-similarity, st)) AS BIGINT) AS first_word, count(*) AS windows
  FROM alike WHERE similarity >= 0.8 GROUP BY doc_id, item_id"""


AUDIT_SQL = r"""WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
  w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY t) AS first FROM t),
  f AS (SELECT part, doc_id, len(words) < 50 AS fa, 100 * len(list_distinct(words)) < 65 * len(words) AS fb,
      100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS fc, regexp_matches(t, '[#$%&*|]') AS fd, coalesce(doc_id > first, false) AS fe FROM w),
  l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
  m AS (SELECT part, fa::INT + 2 * fb::INT + 4 * fc::INT + 8 * fd::INT + 16 * fe::INT AS mask, count(*) AS n,
      count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
  x AS (SELECT i, chr(CAST(65 + i AS INT)) AS c, CAST(1 << i AS INT) AS b FROM range(5) r(i)),
  o AS (SELECT p.c || q.c || r.c || s.c || u.c AS filter_order, unnest([p.b, q.b, r.b, s.b, u.b]) AS b,
      unnest([0, p.b, p.b + q.b, p.b + q.b + r.b, p.b + q.b + r.b + s.b]) AS prior, unnest([1, 2, 3, 4, 5]) AS step
    FROM x p JOIN x q ON p.i <> q.i JOIN x r ON r.i NOT IN (p.i, q.i) JOIN x s ON s.i NOT IN (p.i, q.i, r.i) JOIN x u ON u.i NOT IN (p.i, q.i, r.i, s.i)),
  s AS (SELECT part, filter_order, step, b, sum(CASE WHEN mask & (prior | b) = 0 THEN n ELSE 0 END) AS kept,
      sum(CASE WHEN mask & prior = 0 AND mask & b > 0 THEN n ELSE 0 END) AS removed, sum(CASE WHEN mask & prior > 0 AND mask & b > 0 THEN n ELSE 0 END) AS redundant,
      sum(CASE WHEN mask = b THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN mask & prior = 0 AND mask & b > 0 THEN good ELSE 0 END) AS good_lost,
      sum(CASE WHEN mask & prior = 0 AND mask & b > 0 THEN toxic ELSE 0 END) AS toxic_lost FROM m, o GROUP BY ALL)
  SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
    CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
    CAST(sum(removed) OVER (PARTITION BY part, b) AS BIGINT) AS shapley FROM s"""


def level_sql(name: str, below: str, group: str) -> str:
    """Nodes of the next level and what stands beside each node; a group with one node stays as it is."""
    return f"""b_{name} AS MATERIALIZED (SELECT *, i // 16 AS up, count(*) OVER (PARTITION BY {group}) AS many FROM {below}),
  r_{name} AS MATERIALIZED (SELECT {group}, up AS i, CASE WHEN many = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM b_{name} GROUP BY {group}, up, many),
  s_{name} AS MATERIALIZED (SELECT {group}, i, up, many, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS pre,
      coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS post FROM b_{name} WINDOW w AS (PARTITION BY {group}, up ORDER BY i))"""


SOURCE_LEVELS, TOP_LEVELS = 5, 3  # a million documents a source, 4,096 sources


def manifest_sql() -> str:
    field = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || {0} END"
    fields = [field.replace("{0}", c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    arrives = "CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END"
    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ord(c)::BIGINT)), lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])), 4294967295::BIGINT)"
    parts = [f"""WITH tab AS (SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda a, z: xor(a >> 1, 3988292384::BIGINT * (a & 1))) ORDER BY i) AS crc FROM (SELECT CAST(i AS BIGINT) AS i FROM range(256) r(i))),
  leaves AS MATERIALIZED (SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS src, sha256({" || ".join(fields)}) AS leaf,
      CASE WHEN {crc} % 5 = 0 THEN sha256({" || ".join([*fields[:-1], arrives])}) END AS other FROM documents, tab),
  l0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY src ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS h FROM leaves)"""]
    below, path, folds = "l0", [], []
    for n in range(SOURCE_LEVELS):
        parts.append(level_sql(f"l{n}", below, "src"))
        below = f"r_l{n}"
        path.append((f"s_l{n}", f"d.src = s_l{n}.src AND d.i // {16**n} = s_l{n}.i"))
    parts.append(f"sub AS MATERIALIZED (SELECT 0 AS g, src AS i, h FROM {below})")
    below = "sub"
    for n in range(TOP_LEVELS):
        parts.append(level_sql(f"t{n}", below, "g"))
        below = f"r_t{n}"
        path.append((f"s_t{n}", f"d.src // {16**n} = s_t{n}.i"))
    joins = " ".join(f"JOIN {name} ON {on}" for name, on in path)
    proof = " || ".join(f"{name}.pre || {name}.post" for name, _ in path)
    prior = "coalesce(other, leaf)"
    for name, _ in path:  # one level after the other, each a step of its own
        folds.append((name, prior, f"f_{name}"))
        prior = f"f_{name}"
    parts.append(f"""p AS MATERIALIZED (SELECT d.doc_id, d.src, d.leaf, d.other, sha256({proof}) AS proof_sha256, {", ".join(f"{n}.pre AS a_{n}, {n}.post AS z_{n}, {n}.many AS m_{n}" for n, _ in path)} FROM l0 d {joins})""")
    last = "p"
    for name, now, then in folds:
        parts.append(f"q_{name} AS (SELECT *, CASE WHEN m_{name} = 1 THEN {now} ELSE sha256(a_{name} || {now} || z_{name}) END AS {then} FROM {last})")
        last = f"q_{name}"
    return ",\n  ".join(parts) + f"""
  SELECT doc_id, leaf, sub.h AS subroot, {below}.h AS root, proof_sha256, {prior} AS folded_root, {prior} = {below}.h AS verified
  FROM {last} JOIN sub ON sub.i = {last}.src JOIN {below} ON true"""


def vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@register("op3_byte_bpe")
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coder = bpe.ByteLevelBpe(spark, *vocabulary())
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return coder.round_trip(documents).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@register("op1_secrets", SECRETS_SQL)
def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.col("secrets")["base"]

    def count(kind: str):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(span_digest(base).cast("binary"), 256).alias("base_sha256"),
        span_digest(F.col("secrets")["spans"]).alias("spans"),
    )


LANGUAGE_FOLDS, LANGUAGE_HELD_OUT = 4, 2


def language_model(docs: DataFrame) -> langid.Model:
    return langid.train(docs.where(fold_of("doc_id", LANGUAGE_FOLDS) != LANGUAGE_HELD_OUT))


@register("op5_language")
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.predict(docs, language_model(docs)).select(
        "doc_id", (fold_of("doc_id", LANGUAGE_FOLDS) == LANGUAGE_HELD_OUT).alias("held_out"),
        F.col("language")["lang"].alias("lang_pred"), F.col("language")["score"].alias("score"),
    )


@register("op6_personal", PERSONAL_SQL)
def op6_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(pii.of_kinds(F.col("personal"), [k])).cast("long").alias(f"n_{k}") for k in pii.BASE_KINDS]
    return found.select(
        "doc_id", *counts,
        F.sha2(span_digest(pii.of_kinds(F.col("personal"), pii.BASE_KINDS)).cast("binary"), 256).alias("base_sha256"),
        span_digest(F.col("personal")).alias("spans"),
    )


@register("op2_warc", WARC_SQL)
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(table(spark, sf_dir, "pages"), warc.archive_folder(spark))
    return warc.read_archives(archives, payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"
    )


@register("op4_page_text", PAGE_SQL)
def op4_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@register("op8_simhash")
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), size=3, radius=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@register("op10_decontaminate", LEAKS_SQL)
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op9_embeddings", EMBEDDINGS_SQL)
def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.near_duplicates(table(spark, sf_dir, "embeddings"))


LM_FOLDS, LM_HELD_OUT = 5, 1


@register("op7_lm_score")
def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = [raw for raw, _ in bpe.read_ranks(spark, vocabulary()[0])]
    held_out = fold_of("doc_id", LM_FOLDS) == LM_HELD_OUT
    return lm.score(docs, ~held_out, pieces).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


@register("op11_filter_audit", AUDIT_SQL)
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.document_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


TOKEN_LIMIT = 2048


@register("op12_token_counts")
def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counter = token_counts.TokenCounter(spark, public_tokenizers.path("word_bpe_49k.json"))
    counted = counter.count(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return counted.select(
        "doc_id", token_counts.n_bytes().alias("n_bytes"), "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit")
    )


TAMPER_FOLDS = 5


@register("op13_manifest", manifest_sql())
def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    leaves = manifest.document_leaves(documents, changed=fold_of("doc_id", TAMPER_FOLDS) == 0)
    return manifest.manifest(leaves).select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"
    )
