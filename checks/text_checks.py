"""Text preparation and tokenizers."""

from pyspark.sql import functions as F

from rotativa.functions import context as ctx
from rotativa.functions import text, tokens
from rotativa.operators import corpus as co

from .common import (
    CONTROLS, EMAIL, NEWS, S_SPACE, TAILED, URL, W, documents, news, q, register, s_clean, s_lower_words, s_sentences,
    s_strip, s_sub, s_words, table, tailed,
)


def one_column(name, expr, sql, source=tailed, source_sql=TAILED):
    """Apply one column function to whole texts."""

    @register(name, f"SELECT Id, {sql} AS out FROM {source_sql} s")
    def run(spark, sf):
        return source(spark, sf).select("Id", expr(F.col("Text")).alias("out"))


def html(spark, sf):
    return table(spark, sf, "pages", "page_id", "html").toDF("Id", "Text")


HTML = "(SELECT page_id AS Id, html AS Text FROM pages)"

one_column("strip_controls", text.strip_controls, s_sub("Text", CONTROLS, " "))
one_column("mask_urls", text.mask_urls, s_sub("Text", URL, "<URL>"))
one_column("mask_urls_html", text.mask_urls, s_sub("Text", URL, "<URL>"), html, HTML)
one_column("mask_emails", text.mask_emails, s_sub("Text", EMAIL, "<EMAIL>"))
one_column("normalize_whitespace", text.squeeze_spaces, s_strip(s_sub("Text", f"[{S_SPACE}]+", " ")))
one_column("clean_text", text.clean_text, s_clean("Text"))
one_column("clean_text_html", text.clean_text, s_clean("Text"), html, HTML)
one_column("clean_text_unmasked", lambda c: text.clean_text(c, urls=False, emails=False),
           s_strip(s_sub(s_sub("Text", CONTROLS, " "), f"[{S_SPACE}]+", " ")))
one_column("normalize_text", text.normalize_text, s_strip("Text"))
one_column("str_field", ctx.str_field, s_strip("coalesce(CAST(Text AS VARCHAR), '')"),
           lambda spark, sf: news(spark, sf).select("Id", F.col("Link").alias("Text")),
           f"(SELECT Id, Link AS Text FROM {NEWS})")
one_column("null_text", text.clean_text, s_clean("coalesce(Text, '')"),
           lambda spark, sf: news(spark, sf).select("Id", F.col("Link").alias("Text")),
           f"(SELECT Id, Link AS Text FROM {NEWS})")

one_column("word_tokens", lambda c: F.array_join(tokens.words(c), " "), f"array_to_string({s_words('Text')}, ' ')")
one_column("signal_tokens", lambda c: F.array_join(tokens.signal_words(c), " "),
           f"array_to_string({s_words('lower(Text)')}, ' ')")
one_column("lower_tokens", lambda c: F.array_join(tokens.lower_words(c), " "),
           f"array_to_string({s_lower_words('Text')}, ' ')")
one_column("symbol_tokens", lambda c: F.array_join(tokens.symbols(c), " "),
           f"array_to_string(regexp_extract_all(Text, {q(r'[\p{L}\p{N}_]+|[^' + S_SPACE + ']')}), ' ')")
one_column("whitespace_tokens", lambda c: tokens.chunk_count(c).cast("long"),
           f"CAST(len(regexp_extract_all(Text, {q(f'[^{S_SPACE}]+')})) AS BIGINT)")
one_column("sentences", lambda c: F.array_join(tokens.sentences(c), " | "),
           f"array_to_string({s_sentences('Text')}, ' | ')")
one_column("sentence_lengths", lambda c: F.array_join(tokens.sentence_lengths(c).cast("array<string>"), " "),
           f"array_to_string(list_transform({s_sentences('Text')}, lambda s: CAST(len(regexp_extract_all(s, {W})) AS VARCHAR)), ' ')")

JOINED = s_strip("coalesce(Headline, '') || chr(10) || chr(10) || coalesce(Text, '')")


@register("concat_headline_body", f"SELECT Id, {JOINED} AS text_raw FROM {NEWS} n")
def concat_headline_body(spark, sf):
    return news(spark, sf).select("Id", text.join_headline_body(F.col("Headline"), F.col("Text")).alias("text_raw"))


@register("preprocess_split", f"""SELECT Id, Headline, Topic, Source, split, {JOINED} AS text_raw,
  {s_clean(JOINED)} AS text_xlmr, Category AS label FROM {NEWS} n""")
def preprocess_split(spark, sf):
    return co.preprocess(news(spark, sf)).drop("Text", "Category", "Link")


@register("label_column", f"SELECT Id, Category AS label FROM {NEWS} n")
def label_column(spark, sf):
    return co.with_label(news(spark, sf)).select("Id", "label")


@register("require_columns", f"SELECT Topic, count(*) AS n FROM {NEWS} n GROUP BY Topic")
def require_columns(spark, sf):
    checked = co.require_columns(news(spark, sf), ["Headline", "Text", "Category", "Topic"])
    return checked.groupBy("Topic").agg(F.count(F.lit(1)).alias("n"))


@register("id_integrity", """SELECT count(*) AS n_rows, count(DISTINCT doc_id) AS n_ids,
  count(*) - count(doc_id) AS n_null,
  (SELECT count(*) FROM (SELECT doc_id FROM documents GROUP BY doc_id HAVING count(*) > 1)) AS n_duplicated
  FROM documents""")
def id_integrity(spark, sf):
    return co.id_integrity(documents(spark, sf))


@register("id_integrity_repeated", """SELECT count(*) AS n_rows, count(DISTINCT user_id) AS n_ids,
  count(*) - count(user_id) AS n_null,
  (SELECT count(*) FROM (SELECT user_id FROM events GROUP BY user_id HAVING count(*) > 1)) AS n_duplicated
  FROM events""")
def id_integrity_repeated(spark, sf):
    return co.id_integrity(table(spark, sf, "events", "user_id"), "user_id")


@register("records_to_rows", "SELECT conv_id AS id, text FROM conversations")
def records_to_rows(spark, sf):
    turns = table(spark, sf, "conversations", "conv_id", "turn", "text")
    # Records in arrays of at most 64: a conversation of any length stays split over rows.
    nested = turns.groupBy("conv_id", F.floor(F.col("turn") / 64).alias("chunk")).agg(F.collect_list(F.struct("conv_id", "turn", "text")).alias("data"))
    return co.records_to_rows(nested, "text", "conv_id", data="data")
