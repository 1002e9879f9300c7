"""Main text of web pages by removal of site templates.

1. Every page is parsed into its element subtrees. Each subtree is hashed by tags, classes, ids and text.
2. Spark counts on how many different pages of a host each hash stands, equal pages counting once; inside of ``article``
   or ``main``, in how many different articles.
3. Subtrees that recur on many pages of the host are its template and are deleted from the page; an ``article`` or
   ``main`` as a whole, if half the host's different pages have it. Inside of an article only boxes (containers, and
   paragraphs with a class or id) can be template, and only those of half the host's different articles: copies of an
   article and passages that many articles share recur as well, but are text.
4. What doesn't recur says where the article is. A declared ``article`` or ``main`` counts as long as the rest of the
   page holds no more text of its own, text that neither recurs nor stands in an element of another role; otherwise, or
   without a declaration, the article is the smallest container of all such text, and inside of it only boxes are
   template. Hosts without templates have nothing but the declaration.
5. Elements that declare another role (navigation, header, footer, aside, form, advert, notice, comments; by tag, role,
   class or id) go too, since some of them never recur. Inside of an article a class or id that doesn't name advertising,
   comments or the like deletes only what holds little but links; elsewhere it spares what holds four fifths of the
   page's text. Then character references are decoded and white space is folded block by block.

The templates of a host are few: each takes at least ``share`` of its pages, so there are at most
subtrees-per-page / share of them. They are stored and joined by host; Spark broadcasts them where their file is
small, and splits a hot host otherwise. Counting adds up before it shuffles.

Null html is the empty page: empty text. A null or odd url has the host "". Repeated rows come back repeated. Other
columns are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, with_workers

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th "
    "thead tr ul".split()
)
ENDS_PARAGRAPH = BLOCKS - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "legend", "figcaption", "dt", "dd", "li", "summary"} | {"li", "dt", "dd"}
CLOSED_BY = {  # an open element that one of these start tags ends
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot", "thead"},
    "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option", "optgroup"},
    "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"},
}
SCOPES = frozenset("article aside body div footer form header html main nav section table td th ul ol dl blockquote".split())
NO_TEXT = frozenset("script style noscript template head title iframe object svg annotation annotation-xml canvas audio video select option textarea button".split())
OTHER_ROLE = frozenset("nav footer aside form menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alertdialog alert".split())
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumb\w*|header|footer|sidebar|side-?bar|aside|"
    r"cookie\w*|consent|gdpr|notice|alert|popup|modal|newsletter|subscribe|signup|login|search\w*|share|sharing|social\w*|"
    r"related\w*|recommend\w*|comment\w*|disqus|repl(?:y|ies)|pagination|pager|skip\w*|widget\w*|toolbar|copyright|legal)(?:$|[\s_-])",
    re.I,
)
OWN_NAMES = re.compile(  # of what is never part of an article, wherever it stands
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|sponsor\w*|cookie\w*|gdpr|comment\w*|disqus|related\w*|recommend\w*)(?:$|[\s_-])", re.I
)
BOXES = frozenset("aside details dialog div dl fieldset figure footer form header menu nav ol section table ul".split())
CONTAINERS = BOXES | {"article", "main", "center", "td", "tr", "tbody"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
IN_HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
LINKS = frozenset("a button form label".split())
SPACE = re.compile(r"\s+")
UNFINISHED = re.compile(r"<[a-zA-Z/!?]")


@dataclass(frozen=True)
class TemplateConfig:
    pages: int = 5  # a template stands on so many different pages of its host
    share: float = 0.05  # and on this share of them
    article_share: float = 0.5  # articles as a whole: on this share of the pages; inside: in this share of the different articles


@dataclass
class Node:
    tag: str
    names: str = ""  # class and id
    role: str = ""
    children: list[Node | str] = field(default_factory=list)
    hash: int = 0
    chars: int = 0  # of text
    linked: int = 0  # of these in links and forms


class TreeBuilder(HTMLParser):
    """A forgiving tree: unclosed paragraphs, list items and cells end where the next begins, stray ends are ignored."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html")
        self.open = [self.root]

    def _close(self, at: int) -> None:
        del self.open[max(1, at):]

    def _within_scope(self, tags: frozenset[str] | set[str]) -> int | None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                return i
            if self.open[i].tag in SCOPES:
                return None
        return None

    def handle_starttag(self, tag, attrs):
        if tag not in IN_HEAD and tag != "html":
            self._end_head()
        if tag in ("html", "body"):
            return
        if tag in ENDS_PARAGRAPH and (at := self._within_scope({"p"})) is not None:
            self._close(at)
        ended = {open_tag for open_tag, by in CLOSED_BY.items() if tag in by}
        if ended and (at := self._within_scope(ended)) is not None:
            self._close(at)
        given = dict(attrs)
        node = Node(tag, f"{given.get('class') or ''} {given.get('id') or ''}".strip(), (given.get("role") or "").lower())
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # a slash closes void elements only

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                self._close(i)
                return
            if self.open[i].tag in SCOPES and tag not in SCOPES:
                return

    def _end_head(self) -> None:
        """The end tag of a head may be left out: whatever can't stand in it ends it."""
        if self.open[-1].tag == "head":
            self.open.pop()

    def handle_data(self, data):
        if data.strip():
            self._end_head()
        self.open[-1].children.append(data)


def parse(html: str) -> Node:
    builder = TreeBuilder()
    builder.feed(html)
    if UNFINISHED.match(builder.rawdata):  # a tag or comment that the page's end cuts off
        builder.rawdata = ""
    builder.close()
    hash_tree(builder.root)
    return builder.root


def in_post_order(root: Node) -> Iterator[Node]:
    waiting = [(root, False)]
    while waiting:
        node, entered = waiting.pop()
        if entered:
            yield node
        else:
            waiting.append((node, True))
            waiting += [(c, False) for c in reversed(node.children) if isinstance(c, Node)]


def hash_tree(root: Node) -> None:
    """64-bit hashes from the leaves up; white space around text doesn't matter."""
    for node in in_post_order(root):
        parts = [node.tag, node.names, node.role]
        for c in node.children:
            if isinstance(c, Node):
                parts.append(str(c.hash))
                node.chars += c.chars
                node.linked += c.linked
            elif c.strip():
                parts.append(f"={' '.join(c.split())}")
                node.chars += len(parts[-1]) - 1
        if node.tag in NO_TEXT:
            node.chars = node.linked = 0
        elif node.tag in LINKS:
            node.linked = node.chars
        digest = hashlib.blake2b("\0".join(parts).encode("utf-8", "replace"), digest_size=8).digest()
        node.hash = int.from_bytes(digest, "big", signed=True)


def article_of(root: Node) -> list[Node]:
    """The outermost article or main elements, outside of elements of another role. A class name is no such role unless
    it names advertising, comments or recommendations, and not even then where the page has no other article."""
    for skipped in (never_article, other_tag):
        found: list[Node] = []
        waiting = [root]
        while waiting:
            node = waiting.pop()
            if (node.tag in ("article", "main") or node.role == "main") and not skipped(node):
                found.append(node)
            elif not skipped(node):
                waiting += [c for c in reversed(node.children) if isinstance(c, Node)]
        if found:
            return found
    return []


def other_tag(node: Node) -> bool:
    return node.tag in NO_TEXT or node.tag in OTHER_ROLE or node.role in ROLES


def never_article(node: Node) -> bool:
    return other_tag(node) or bool(node.names and node.tag not in HEADINGS and OWN_NAMES.search(node.names))


def other_role(node: Node) -> bool:
    return other_tag(node) or bool(node.names and NAMES.search(node.names))


def dropped_inside(node: Node, templates: set[int]) -> bool:
    """Whether an element of an article isn't its text: by role, by recurrence, or by name if it holds little but links."""
    if never_article(node) or inside(node) in templates:
        return True
    return 2 * node.linked >= node.chars and bool(node.names and node.tag not in HEADINGS and NAMES.search(node.names))


# The last bits of a hash tell elements outside of articles, elements inside and whole articles apart; the hashes 0 and 1
# count pages and articles.
OUTSIDE, INSIDE, WHOLE = range(3)


def outside(node: Node) -> int:
    return node.hash & ~3 | OUTSIDE


def inside(node: Node) -> int:
    return node.hash & ~3 | INSIDE


def whole(node: Node) -> int:
    return node.hash & ~3 | WHOLE


def recurs(node: Node, templates: set[int]) -> bool:
    return outside(node) in templates or whole(node) in templates or inside(node) in templates


def is_box(node: Node) -> bool:
    """A container, or a paragraph with a class or id: what may be a template inside of an article."""
    return node.tag in BOXES or (node.tag in ("p", "address") and bool(node.names))


def article_candidates(article: Node) -> set[int]:
    """Hashes of the elements of an article that may be templates: boxes, and paragraphs with a class or id."""
    found, waiting = set(), [c for c in article.children if isinstance(c, Node)]
    while waiting:
        node = waiting.pop()
        if node.tag in NO_TEXT:
            continue
        if node.chars and is_box(node):
            found.add(inside(node))
        waiting += [c for c in node.children if isinstance(c, Node)]
    return found


def candidates(root: Node) -> set[int]:
    """Hashes of the subtrees with content that may be templates: all outside of the article."""
    kept, holding, found = {id(n) for n in article_of(root)}, set(), set()
    for node in in_post_order(root):
        if id(node) in kept or any(id(c) in holding for c in node.children if isinstance(c, Node)):
            holding.add(id(node))
    waiting = [c for c in root.children if isinstance(c, Node)]
    while waiting:
        node = waiting.pop()
        if id(node) in kept:
            continue
        if node.children and node.tag not in NO_TEXT and id(node) not in holding:
            found.add(outside(node))
        waiting += [c for c in node.children if isinstance(c, Node)]
    return found


def own_text(node: Node) -> int:
    """Characters of text that stands in the element itself."""
    return sum(len(" ".join(c.split())) for c in node.children if isinstance(c, str))


def text_beside(root: Node, articles: list[Node], templates: set[int]) -> int:
    """Characters outside of the articles that neither recur on the host nor stand in an element of another role."""
    skipped, found, waiting = {id(a) for a in articles}, 0, [root]
    while waiting:
        node = waiting.pop()
        if id(node) in skipped or other_role(node) or node.tag == "header" or recurs(node, templates):
            continue
        found += own_text(node)
        waiting += [c for c in node.children if isinstance(c, Node)]
    return found


def sizes(root: Node, templates: set[int]) -> dict[int, int]:
    """For each element the characters that don't recur on the host, by id of the element; 0 in elements of another role."""
    found: dict[int, int] = {}
    for node in in_post_order(root):
        own = 0 if never_article(node) or recurs(node, templates) else own_text(node) + sum(found[id(c)] for c in node.children if isinstance(c, Node))
        found[id(node)] = own
    return found


def dropped_outside(node: Node, all_chars: int, fresh: dict[int, int]) -> bool:
    """By role, or by a name alone, which spares what holds most of the page's text (four fifths) and isn't made of links."""
    if never_article(node) or node.tag == "header":
        return True
    if not other_role(node):
        return False
    return 5 * fresh[id(node)] < 4 * all_chars or 2 * node.linked >= node.chars


def container(root: Node, dropped: set[int], fresh: dict[int, int]) -> Node:
    """The smallest container of all text that doesn't recur, outside of elements that are dropped."""
    kept: dict[int, int] = {}
    for node in in_post_order(root):
        kept[id(node)] = 0 if id(node) in dropped or not fresh[id(node)] else own_text(node) + sum(kept[id(c)] for c in node.children if isinstance(c, Node))
    at = root
    while inner := [c for c in at.children if isinstance(c, Node) and c.tag in CONTAINERS and kept[id(c)] and kept[id(c)] == kept[id(at)]]:
        at = inner[0]
    return at


def main_text(root: Node, templates: set[int]) -> str:
    """Blocks of the article, in page order; of the whole page if nothing tells where the article is."""
    starts = article_of(root)
    if starts and not (templates and text_beside(root, starts, templates) > sum(a.chars for a in starts)):
        def drops(node: Node) -> bool:
            return dropped_inside(node, templates)
    else:
        fresh = sizes(root, templates)
        dropped = {id(n) for n in in_post_order(root) if dropped_outside(n, fresh[id(root)], fresh)}
        start = container(root, dropped, fresh)
        for node in in_post_order(start):
            if node is not start and recurs(node, templates) and (start is root or is_box(node) or whole(node) in templates):
                dropped.add(id(node))
        starts = [start]

        def drops(node: Node) -> bool:
            return id(node) in dropped

    return "\n\n".join(block for start in starts for block in blocks_of(start, drops))


def blocks_of(start: Node, drops: Callable[[Node], bool]) -> list[str]:
    blocks, line = [], []

    def end_block() -> None:
        text = SPACE.sub(" ", "".join(line)).strip()
        line.clear()
        if text:
            blocks.append(text)

    waiting: list[Node | str | None] = [start]
    while waiting:
        node = waiting.pop()
        if node is None:
            end_block()
        elif isinstance(node, str):
            line.append(node)
        elif node.tag in ("br", "wbr"):
            line.append(" " if node.tag == "br" else "")
        elif node is start or not drops(node):
            if node.tag in BLOCKS:
                end_block()
                waiting.append(None)
            waiting += reversed(node.children)
    end_block()
    return blocks


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def templates(pages: DataFrame, config: TemplateConfig = TemplateConfig()) -> DataFrame:
    """(host, templates): hashes of the subtrees that recur on a host, stored."""
    with_workers(pages.sparkSession)

    def subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, page, hashes = [], [], []
            for host, html in zip(batch.column(0), batch.column(1), strict=True):
                root = parse(html.as_py())
                articles = article_of(root)
                own = candidates(root) | {whole(a) for a in articles if a.chars} | {0}  # 0 counts the pages
                for unit, found in [(root, own), *((a, article_candidates(a) | {1}) for a in articles)]:
                    hosts += [host.as_py()] * len(found)
                    page += [unit.hash] * len(found)
                    hashes += found
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(page, pa.int64()), pa.array(hashes, pa.int64())], ["host", "page", "hash"])

    html = pages.select(host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    different = html.mapInArrow(subtrees, "host string, page long, hash long").groupBy("host", "hash", "page").agg(F.lit(1).alias("one"))
    counts = stored(different.groupBy("host", "hash").agg(F.count("one").alias("pages")).where(F.col("pages") >= config.pages), "subtrees")
    of = F.col("hash").bitwiseAND(F.lit(INSIDE))  # whole articles are counted in pages too
    per_host = counts.where("hash in (0, 1)").select("host", of.alias("of"), F.col("pages").alias("all"))
    share = F.when(F.col("hash").bitwiseAND(F.lit(3)) == OUTSIDE, config.share).otherwise(config.article_share)
    recurring = (
        counts.where("hash not in (0, 1)").withColumn("of", of).join(per_host, ["host", "of"]).where(F.col("pages") >= F.col("all") * share)
        .groupBy("host").agg(F.collect_set("hash").alias("templates"))
    )
    return stored(recurring, "templates")


def extract(pages: DataFrame, config: TemplateConfig = TemplateConfig()) -> DataFrame:
    """(page_id, url, text) of every row of ``pages`` (page_id, url, html)."""
    found = templates(pages, config)

    @F.arrow_udf("string")
    def cleaned(htmls: pa.Array, known: pa.Array) -> pa.Array:
        return pa.array([main_text(parse(h.as_py() or ""), set(k.as_py() or ())) for h, k in zip(htmls, known, strict=True)], pa.string())

    hosted = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host")).join(found, "host", "left")
    return hosted.select("page_id", "url", cleaned.asNondeterministic()("html", "templates").alias("text"))
