"""Links, authors, dates and hashed vectors."""

import hashlib
import math
import re
from datetime import datetime, timezone
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from rotativa.functions import context as ctx
from rotativa.operators import context as cx

DOMAINS = {
    "http://www.Foo.com/a": "foo.com",
    "http://user:pw@WWW.Foo.com:80/a?b#c": "user:pw@www.foo.com:80",
    "example.com/a": "example.com",
    "www.foo.com": "foo.com",
    "example.com:8080/x": "",
    "//h.com/p": "h.com",
    "HTTP://www.www.com": "www.com",
    "http://[bad": "",
    "http://bad]": "",
    "http://[::1]:80/x": "[::1]:80",
    "http://[nonsense]/x": "",
    "": "",
    None: "",
    "nodots/a.b": "",
    "?a=b.c": "",
    "a.b?x#y": "a.b",
    "mailto:a@b.c": "a@b.c",
    "h.com;p": "h.com",
    "http://h.com\n/x": "h.com",
}
AUTHORS = {
    "http://h.com/autor/Juan-P_rez/x": "Juan P rez",
    "http://h.com/a?x=1&Author=ana__m": "ana m",
    "http://h.com/author/a?author=bob": "",
    "http://h.com/xauthor/z": "",
    "http://h.com/AUTHOR/Eva": "Eva",
    "http://h.com/author/": "",
    "h.com/author/Li-Po;v=1": "Li Po",
    "http://[bad/author/Eva": "",
    None: "",
}


def test_domains(spark):
    df = spark.createDataFrame([(k,) for k in DOMAINS], "link string")
    assert {r.link: r.d for r in df.select("link", ctx.url_domain(F.col("link")).alias("d")).collect()} == DOMAINS


def test_domains_like_urllib(spark):
    links = [k for k in DOMAINS if k] + [
        f"{scheme}{host}{path}" for scheme in ("http://", "HTTPS://", "//", "", "ftp:", "x-y:", "1a:")
        for host in ("a.b", "www.A.b:1", "u@h", "é.es", "a b.c") for path in ("", "/", "/p/q?x=1", "?q", "#f", "/a;b/c;d")]
    df = spark.createDataFrame([(k,) for k in links], "link string")
    for r in df.select("link", ctx.url_domain(F.col("link")).alias("d")).collect():
        try:
            parsed = urlparse(r.link.strip())
            host = parsed.netloc
            first = parsed.path.split("/")[0]
            host = host or (first if "." in first else "")
        except ValueError:
            host = ""
        assert r.d == re.sub(r"^www\.", "", host.lower().strip()), r.link


def test_authors(spark):
    df = spark.createDataFrame([(k,) for k in AUTHORS], "link string")
    assert {r.link: r.a for r in df.select("link", ctx.url_author(F.col("link")).alias("a")).collect()} == AUTHORS


DATES = {
    "1704164645": 1704164645, "1704164645000": 1704164645, "1704164645999": 1704164645, "12345678901": 12345678901,
    "999999999999": None, "2024-01-02T03:04:05Z": 1704164645, "2024-01-02 03:04:05": 1704164645,
    "2024-01-02T03:04:05+01:00": 1704161045, "2024-01-02T03:04:05+0100": 1704161045, "2024-01-02T03:04": 1704164640,
    "2024-01-02": 1704153600, "2024-1-2": 1704153600, "01/02/2024": 1706745600, "1/2/2024": 1706745600,
    "02/13/2024": 1707782400, "31-12-2023": 1703980800, "2024/1/2": 1704153600, "20240102": 1704153600,
    "20240102T030405": 1704164645, "20240102T0304Z": 1704164640, "20240102 03": 1704164400, "20240102T030405.5+0100": 1704161045,
    "2024-01-02T030405": 1704164645, "2024-W01-2": 1704153600, "2024W012": 1704153600, "2024-W01": 1704067200,
    "2024-W01-2T03:04:05Z": 1704164645, "2020-W53-5": 1609459200, "2024-W53-1": None, "2024-W00-1": None, "2024-W01-8": None,
    "2024": None, "x": None, "": None, None: None, "30/02/2024": None, " 2024-01-02 ": 1704153600, "2024-13-01": None,
}


@pytest.mark.parametrize("zone", ["UTC", "America/Mexico_City"])
def test_dates(spark, zone):
    df = spark.createDataFrame([(k,) for k in DATES], "d string")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = df.select("d", F.unix_seconds(ctx.parse_date(F.col("d"))).alias("s")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert {r.d: r.s for r in rows} == DATES


def test_age(spark):
    df = spark.createDataFrame([("2024-01-01",), ("2024-01-03T12:00:00Z",), ("1990-01-01",), ("x",), (None,)], "d string")
    as_of = F.lit(datetime(2024, 1, 2, tzinfo=timezone.utc))
    assert [r[0] for r in df.select(ctx.age_days(F.col("d"), as_of)).collect()] == [1.0, -1.5, 3650.0, -1.0, -1.0]
    uncapped = df.select(ctx.age_days(F.col("d"), as_of, cap=None, missing=-7)).collect()
    assert [r[0] for r in uncapped] == [1.0, -1.5, 12419.0, -7.0, -7.0]
    with pytest.raises(ValueError):
        cx.ContextConfig(date="Date")


def expected_vector(field, value, dim, n, signed=True, l2=True):
    out = [0.0] * dim
    v = (value or "").strip().lower()
    if v:
        for j in range(max(n, 1)):
            digest = hashlib.md5(f"{field}|{j}|{v}".encode()).hexdigest()
            out[int(digest[:8], 16) % dim] += -1.0 if signed and int(digest[8], 16) % 2 else 1.0
        norm = math.sqrt(sum(x * x for x in out))
        if l2 and norm:
            out = [x / norm for x in out]
    return out


@pytest.mark.parametrize("n,signed,l2", [(2, True, True), (0, True, True), (4, False, True), (3, True, False)])
def test_hashed_vectors(spark, n, signed, l2):
    values = [None, "", " El País ", "el país", *[f"v{i}" for i in range(60)]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "Id int, v string")
    rows = {r.Id: list(r.f_emb) for r in cx.hash_embed(df, {"f": ("v", 4)}, n, signed, l2).collect()}
    for i, v in enumerate(values):
        assert rows[i] == pytest.approx(expected_vector("f", v, 4, n, signed, l2)), v
    if n == 2:
        assert any(v and not any(rows[i]) for i, v in enumerate(values)), "some signs should cancel"


def test_context_block(spark):
    rows = [(1, "Política", "El País", "http://www.a.es/autor/Ana-Ruiz", None), (2, None, " ", None, "x"),
            (3, "T", "S", "a.b", "01/01/2024")]
    df = spark.createDataFrame(rows, "Id long, Topic string, Source string, Link string, Date string")
    config = cx.ContextConfig(as_of=datetime(2024, 1, 2, tzinfo=timezone.utc), date="Date")
    found = {r.Id: r for r in cx.context_features(df, config).collect()}
    assert list(found[1].__fields__) == ["Id", *config.names] and len(config.names) == 103
    assert [found[1][f"ctx_domain_emb_{i}"] for i in range(32)] == pytest.approx(expected_vector("domain", "a.es", 32, 2))
    assert [found[1][f"ctx_author_emb_{i}"] for i in range(16)] == pytest.approx(expected_vector("author", "Ana Ruiz", 16, 2))
    assert found[1].ctx_age_days == -1 and found[3].ctx_age_days == 1
    assert [found[2][n] for n in cx.FLAG_NAMES] == [0, 0, 0, 0, 0, 1]
    assert [found[3][n] for n in cx.FLAG_NAMES] == [1, 1, 1, 1, 0, 1]
    small = cx.ContextConfig(source_dim=0, domain_dim=2, topic_dim=0, author_dim=-1)
    assert len(small.names) == 2 + 1 + 6
    assert [len(r.features) for r in cx.context_vectors(df, small).collect()] == [9, 9, 9]
    with pytest.raises(ValueError, match="Nope"):
        cx.context_features(df, cx.ContextConfig(topic="Nope"))
