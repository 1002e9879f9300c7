"""Web archives and page text."""

import gzip
import hashlib
import html
import io
import re

import pytest
from pyspark.sql import functions as F

from rotativa.llm import html_text, warc
from rotativa.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
LONG = "<p>" + "long text " * 40_000


def test_archives_round_trip(spark):
    same, small = "<p>" + "copy " * 30, "tiny"
    rows = [
        (1, "http://a.b/ü x\r\nEvil: 1", same), (2, None, same), (3, "http://a.b/", small), (4, "http://a.b/", small), (5, "", None),
        (6, "u", ""), (None, "n", same), (7, "l", LONG), (7, "l", LONG), (8, "l", LONG), (9, "u", "é\r\n\r\nWARC/1.1\x00" * 20),
    ]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "page_id long, url string, html string, digest string, refers_to long").repartition(3)
    archives = warc.write_archives(df, warc.archive_folder(spark), roll=2000)
    assert archives.count() >= 3
    found = sorted(warc.read_archives(archives).collect(), key=lambda r: (r.page_id is None, r.page_id or 0))
    assert [r.page_id for r in found] == [1, 2, 3, 4, 5, 6, 7, 7, 8, 9, None]
    assert [r.refers_to for r in found] == [None, 1, None, None, None, None, None, None, 7, None, 1]
    source = {r[0]: (r[2] or "").encode() for r in rows}
    for r in found:
        payload = source[r.page_id]
        assert r.record_type == ("response" if r.refers_to is None else "revisit")
        assert (r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha256(payload).hexdigest())
        assert r.payload == (payload if r.refers_to is None else None)
    assert found[0].url == "http://a.b/ü%20x%0D%0AEvil:%201"
    assert found[1].url is None
    none = warc.write_archives(df.limit(0), warc.archive_folder(spark))
    assert none.count() == 0 and warc.read_archives(none).count() == 0


def test_every_archive_has_a_task(spark):
    df = spark.range(60).selectExpr("id AS page_id", "'u' AS url", "repeat(cast(id AS string), 50) AS html").repartition(4)
    archives = warc.write_archives(df, warc.archive_folder(spark), roll=1)
    assert archives.count() == 60
    read = warc.read_archives(archives, payload=False).groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert [r["count"] for r in read] == [1] * 60


def packed(*payloads):
    return b"".join(warc.member(warc.record(i, "u", p, hashlib.sha256(p).hexdigest(), None)) for i, p in enumerate(payloads))


def test_reader_is_incremental_and_strict():
    raw = packed(b"one", b"", b"x" * 300_000)
    assert [p for _, _, p in warc.read_records(io.BytesIO(raw))] == [b"one", b"", b"x" * 300_000]
    assert gzip.decompress(raw).count(b"WARC/1.1") == 3
    assert list(warc.read_records(io.BytesIO(b""))) == []
    for damaged in (raw[:-9], raw[:40], raw + b"junk", raw[:30] + bytes([raw[30] ^ 255]) + raw[31:]):
        with pytest.raises(ValueError):
            list(warc.read_records(io.BytesIO(damaged)))
    good = warc.record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None)
    for wrong in (good.replace(b"payload\r", b"paYload\r"), good.replace(b"Content-Length: 7", b"Content-Length: 8"), good[:-1], good + b"x"):
        with pytest.raises(ValueError):
            list(warc.read_records(io.BytesIO(warc.member(wrong))))


def test_archive_query(spark):
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in QUERIES["op2_warc"](spark, SF).collect():
        payload = pages[r.page_id]
        first = min(i for i, p in pages.items() if p == payload)
        expected = None if first == r.page_id or len(payload) < 100 else first
        assert (r.payload_bytes, r.payload_digest, r.refers_to) == (len(payload), hashlib.sha256(payload).hexdigest(), expected)


@pytest.mark.parametrize(("page", "text"), [
    ("", ""), ("  \n ", ""), ("plain &amp; simple", "plain & simple"),
    ("<p>a<p>b<div>c <b>d</b>e<ul><li>x<li>y</ul>", "a\n\nb\n\nc de\n\nx\n\ny"),
    ("a &lt;b&gt; &am &copy; &#x41;&#66;<br>z", "a <b> &am © AB z"),
    ("<table><tr><td>1<td>2<tr><th>3</table>", "1\n\n2\n\n3"),
    ("<nav>n</nav><article><h1> T\n t </h1><p><b>x<br><p>y</article><footer>f</footer>", "T t\n\nx\n\ny"),
    ("<article><div class='ad-box'>no</div><p>yes<section id=comments>c</section></article><main>m</main>", "yes\n\nm"),
    ("<header>h</header><div role=navigation>r</div><p>x</p><form>f</form><aside>s</aside><div class='cookie-notice'>c</div>", "x"),
    ("<script>a<b></script><style>p{}</style>t<!-- c --><noscript>n</noscript>u", "tu"),
    ("<article><p>uploads and headers</p><p class='lead adult'>kept</p></article>", "uploads and headers\n\nkept"),
    ("<article>open <p>end", "open\n\nend"), ("</div></p>stray", "stray"), ("<div " * 3, ""),
    ("<article><header><h1>Title</h1></header>body</article>", "Title\n\nbody"),
])
def test_page_text(page, text):
    assert html_text.main_text(html_text.parse(page), set()) == text


@pytest.mark.parametrize(("page", "text"), [
    *((f"<div class='layout {name}'><article>a</article></div>", "a") for name in ("has-sidebar", "no-sidebar", "with-header", "search-enabled", "widget-area", "comments-open")),
    ("<article>a</article><div id=comments><article>c</article></div>", "a"),
    ("<html><head><title>t</title><meta charset=x><body><article>a</article>", "a"), ("<head><title>t</title><p>a", "a"), ("<head><script>s</script>a", "a"),
    ("<head><title>t</title></head><body>a", "a"), ("<article><h1 class='entry-header'><a>T</a></h1><div class='legal-text'>law</div>", "T\n\nlaw"),
    ("<article>x <math><mi>y</mi><annotation>tex</annotation></math></article>", "x y"), ("<article>a<ul class=social><li><a>f</a></ul></article>", "a"),
])
def test_whole_articles(page, text):
    assert html_text.main_text(html_text.parse(page), set()) == text


def test_deep_and_long_pages():
    assert html_text.main_text(html_text.parse("<div>" * 20_000 + "x"), set()) == "x"
    assert html_text.candidates(html_text.parse("<div>" * 20_000 + "<article>x</article>")) == set()
    assert html_text.main_text(html_text.parse(LONG), set()) == ("long text " * 40_000).strip()


def test_templates_are_removed(spark):
    """Pages without an article: what recurs on a host goes, what recurs on copies of one page stays."""
    bar, line = "<div class=top>Home <a href=/>Start</a></div>", "<div>Call us today</div>"
    rows = [(i, f"http://h.com/{i}", f"{bar}<div>story {i}</div>{line}") for i in range(20)]
    rows += [(100 + i, "http://copies.com/x", f"<div>same</div>{line}") for i in range(50)]
    rows += [(200 + i, f"http://article.com/{i}", f"{bar}<article><p>license<p>story {i}</article>") for i in range(20)]
    rows += [(300, None, f"{bar}<div>alone</div>"), (301, "odd", None), (None, "http://h.com/0", f"{bar}<div>no id</div>")]
    df = spark.createDataFrame([(*r, "x", [1]) for r in rows], "page_id long, url string, html string, host string, templates array<int>")
    found = {r.page_id: r.text for r in html_text.extract(df).collect()}
    assert len(found) == len(rows)
    assert [found[i] for i in range(20)] == [f"story {i}" for i in range(20)]
    assert {found[100 + i] for i in range(50)} == {"same\n\nCall us today"}
    assert [found[200 + i] for i in range(20)] == [f"license\n\nstory {i}" for i in range(20)]
    assert (found[300], found[301], found[None]) == ("Home Start\n\nalone", "", "no id")
    assert html_text.extract(df.limit(0)).count() == 0


def test_templates_inside_of_articles(spark):
    """A box of every article of a host goes under any name; a shared passage, copies of one article and text that differs stay."""
    box, line = "<div class=x7><b>Join</b> our list</div>", "<p class=z>All rights with us</p>"
    passage = "<div class=quote>said by many</div>"
    rows = [(i, f"http://h.com/{i}", f"<article><p>license<p>story {i}{passage if i < 8 else ''}{box}{line}</article>") for i in range(20)]
    rows += [(100 + i, "http://copies.com/x", f"<nav>{i}</nav><article><div class=x7>one text</div></article>") for i in range(20)]
    rows += [(200 + i, "http://names.com/x", f"<main><div class=legal-text>law {i}</div><div class=notice>Read this</div></main>") for i in range(20)]
    found = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [found[i] for i in range(20)] == [f"license\n\nstory {i}" + ("\n\nsaid by many" if i < 8 else "") for i in range(20)]
    assert {found[100 + i] for i in range(20)} == {"one text"}
    assert [found[200 + i] for i in range(20)] == [f"law {i}" for i in range(20)]


def disagreeing_pages(i):
    """(host, page, text) of pages on which what recurs and what is declared differ; the text is that without the template."""
    bar, story = "<div class=top><a href=/>Home</a> <a href=/n>News</a></div>", f"<h2>Head {i}</h2><p>story {i} " + f"of {i} days and nights " * 5 + "</p>"
    told = f"Head {i}\n\n" + " ".join(f"story {i} {f'of {i} days and nights ' * 5}".split())
    passage = "<p>said by many</p>" if i < 8 else ""
    more = "\n\nsaid by many" if i < 8 else ""
    return [
        # teasers are declared as articles and recur; the story is declared by nothing
        ("teaser.com", f"{bar}<article class=card>Read our best</article><article class=card>Read all</article><div class=c9>{story}{passage}</div>", told + more),
        # main holds the sign, the story stands beside it
        ("sign.com", f"<main><p>Members only</p></main><div class=c9>{story}</div><div class=z>Our town</div>", told),
        # a name that would delete the wrapper of everything
        ("wrap.com", f"{bar}<div class='layout has-sidebar'>{story}{passage}</div><div class=z>Our town</div>", told + more),
        # one teaser differs from page to page and is smaller than the story
        ("differs.com", f"{bar}<article class=card>Next: {i + 1}</article><div class=c9>{story}</div>", f"Next: {i + 1}\n\n{told}"),
        # the declaration holds
        ("right.com", f"{bar}<article>{story}{passage}</article><div class=views>{i} views</div>", told + more),
        # copies of one article, declared, among changing counters
        ("copies.com", f"{bar}<article><p>One text of all pages</p></article><div class=views>{i} views</div>", "One text of all pages"),
    ]


def test_recurrence_decides_against_declarations(spark):
    rows, texts = [], {}
    for i in range(20):
        for k, (host, page, text) in enumerate(disagreeing_pages(i)):
            rows.append((100 * k + i, f"http://{host}/{i}", page))
            texts[100 * k + i] = text
    found = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    assert found == texts
    declared = {i: html_text.main_text(html_text.parse(page), set()) for i, _, page in rows}
    assert [sum(declared[100 * k + i] != texts[100 * k + i] for i in range(20)) for k in range(6)] == [20, 20, 20, 20, 0, 0]


def counted_by_hand(pages, config):
    """The templates of one host, from sets of pages and articles in plain Python."""
    on_pages, in_articles, all_pages, all_articles = {}, {}, set(), set()
    for root in map(html_text.parse, pages):
        all_pages.add(root.hash)
        for h in html_text.candidates(root) | {html_text.whole(a) for a in html_text.article_of(root)}:
            on_pages.setdefault(h, set()).add(root.hash)
        for article in html_text.article_of(root):
            all_articles.add(article.hash)
            for h in html_text.article_candidates(article):
                in_articles.setdefault(h, set()).add(article.hash)
    found = set()
    for h, seen in [*on_pages.items(), *in_articles.items()]:
        kind = h & 3
        total, share = {0: (all_pages, config.share), 1: (all_articles, config.article_share), 2: (all_pages, config.article_share)}[kind]
        if len(seen) >= config.pages and len(seen) >= share * len(total):
            found.add(h)
    return found


def test_templates_equal_counts_by_hand(spark):
    pages = [("h.com", page) for i in range(30) for _, page, _ in disagreeing_pages(i % 23)]
    pages += [(r.url.split("/")[2], r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    df = spark.createDataFrame([(f"http://{host}/", page) for host, page in pages], "url string, html string").repartition(5)
    config = html_text.TemplateConfig(pages=3)
    found = {r.host: set(r.templates) for r in html_text.templates(df, config).collect()}
    by_hand = {host: counted_by_hand([p for h, p in pages if h == host], config) for host in {h for h, _ in pages}}
    assert found == {host: t for host, t in by_hand.items() if t}


def test_page_text_query(spark):
    """The generated pages have one article of h1 and p: read here by patterns."""
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = QUERIES["op4_page_text"](spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search("<article>(.*)</article>", pages[r.page_id], re.S)[1]
        parts = re.split("</?(?:p|h1)>", re.sub("</?b>", "", article.replace("<br>", " ")))
        blocks = [" ".join(html.unescape(p).split()) for p in parts]
        assert r.text == "\n\n".join(b for b in blocks if b)
        assert r.n_chars == len(r.text)
