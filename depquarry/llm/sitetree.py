"""Main text of web pages by a site style tree.

The pages of a host are merged by presentation: a node of the tree is a path of elements with their
classes, ids and roles. Over the host's pages a node has the styles (sequences of child elements) and
contents (texts of its blocks) that occur under it. Contents that are spread evenly over the pages have
a high entropy and a low importance, contents of one page alone a high one; so have varied styles.
Both combine to a node's importance. Branches of low importance are removed from each page, and with
them those that their elements name as menus, headers, footers, asides, notices, adverts, forms and
comments: a host of few pages has no statistics to tell. A name removes no branch that holds the page's
only articles or, on a page without any, most of its text: it is a wrapper named by what stands beside.

Where a page has an article (``article``, ``main``), its text is that of the articles; there the tree judges
named containers, and blocks by their own words: one that stands on most of a host's pages, whose other text
differs, is of the site and goes. Pages that share their longest block are copies and count once, so an
article's copies vouch for none of its blocks, and a page that would lose most of its text loses none. Else
the text is that of the whole body. What few pages say counts less, by weights that grow with their number.
A page that is left with nothing keeps none.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depquarry.llm.common import sliced, small_batches, written

# Element names of HTML by what they do to text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style noscript template textarea select button iframe head title datalist".split())
RAW = frozenset("script style textarea title iframe noscript".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul head title".split())
CLOSES_P = BLOCK - {"html", "body", "head", "title"}
ARTICLE = frozenset(["article", "main"])
FURNITURE = frozenset("nav aside footer form menu dialog search".split())
CONTENT = frozenset("p h1 h2 h3 h4 h5 h6 li td th dd dt blockquote pre figure figcaption article main body html".split())
#: What an open element of the first name is closed by.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table body html div section article td th form nav".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alertdialog alert".split())
#: Words of a class or id that name what is no part of an article, and words that say how a box is laid out by such.
NAMED = re.compile(
    r"ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner\w*|cookie\w*|consent|gdpr|notice\w*|popup|modal|overlay|newsletter|subscri\w*|signup|login"
    r"|nav\w*|menu\w*|breadcrumb\w*|pagination|pager|sidebar\w*|widget\w*|rail|footer\w*|masthead|topbar|toolbar|share|sharing|social\w*"
    r"|related|recommend\w*|trending|comments?|commentlist|disqus|replies|respond|discussion|skiplink|hidden",
    re.I,
)
LAYOUT = frozenset("has have with without no not is are open opened closed expanded collapsed active enabled disabled visible print sticky fixed below above".split())
WHOLE = frozenset(["skip-link", "sr-only", "is-hidden"])


def names_furniture(name: str) -> int:
    """2: a token of a class or id is a furniture word; 1: one is a compound that begins or ends with one; 0: none, or only of a layout by one."""
    how = 0
    for token in name.lower().split():
        words = [w for w in re.split(r"[-_\d]+", token) if w]
        if token in WHOLE or len(words) == 1 and NAMED.fullmatch(words[0]):
            return 2
        if words and not LAYOUT.intersection(words) and (NAMED.fullmatch(words[0]) or NAMED.fullmatch(words[-1])):
            how = 1
    return how


TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")

GAMMA = 0.9
LEAST_IMPORTANCE = 0.2
#: Pages that a host is taken to have beside its own, on which nothing of its own stands; and the part of the pages from which on a block is the site's.
PRIOR = 4
MOST_PAGES = 0.5


class Node:
    __slots__ = ("article", "named", "off", "path", "style", "tag")

    def __init__(self, tag: str, path: int, article: int, off: bool, named: int = 0):
        self.tag, self.path, self.article, self.off, self.named, self.style = tag, path, article, off, named, xxhash.xxh3_64()


def attributes(raw: str) -> dict[str, str]:
    return {k.lower(): entities.unescape(v.strip("\"'")) for k, v in ATTRIBUTE.findall(raw)}


def below(path: int, name: str) -> int:
    return xxhash.xxh64_intdigest(name, path & (1 << 64) - 1) - (1 << 63)


class Page:
    """A page's blocks in order as (path, text, in an article), and each path's style and whether it is a named container.

    Elements that close themselves, tags that are left open and end tags without a start are taken as
    browsers take them.
    """

    def __init__(self, source: str):
        self.blocks: list[tuple[int, str, bool]] = []
        self.styles: dict[int, int] = {}
        self.container: dict[int, int] = {}  # path: the innermost named container on it
        self._text: list[tuple[Node, str]] = []
        self._said: list[list[tuple[Node, str]]] = []
        self.named = [0]  # of each branch that its name removes, the one that it stands in
        self.plain = [True]  # of each such branch, whether a furniture word is all of a token
        self.articles = [0]  # of each article, the named branch that it stands in
        self.stack = [Node("", 0, 0, False)]
        self.box = [0]
        pos, size = 0, len(source)
        for m in self._tokens(source):
            if m.start() > pos:
                self._say(source[pos : m.start()])
            pos = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                self._end(tag)
            else:
                pos = self._start(tag, m[3] or "", source, pos)
        if pos < size:
            self._say(source[pos:])
        self._flush()
        while len(self.stack) > 1:
            self._pop()
        spared = self._spared()
        for said in self._said:
            said = [(node, text) for node, text in said if node.named in spared]
            text = " ".join("".join(entities.unescape(t) if "&" in t else t for _, t in said).split())
            if text:
                self.blocks.append((said[0][0].path, text, bool(said[0][0].article)))
        del self._said

    def _spared(self) -> set[int]:
        """The named branches that stay, and 0: those around the longest article if all are in such, and those with most of the page's text, but no plain comments and the like beside an article."""
        if len(self.named) == 1:
            return {0}
        size, of_article = [0] * len(self.named), [0] * len(self.articles)
        for said in self._said:
            for node, text in said:
                n = len("".join(text.split()))
                if node.article and node.named == self.articles[node.article]:
                    of_article[node.article] += n
                size[node.named] += n
        for i in range(len(size) - 1, 0, -1):  # inner ones come later
            size[self.named[i]] += size[i]
        spared = {0}
        longest = max(range(len(of_article)), key=lambda i: (of_article[i], -i))
        outside = any(n and not at for n, at in zip(of_article, self.articles))
        if longest and not outside:
            at = self.articles[longest]
            while at:
                spared.add(at)
                at = self.named[at]
        for i in range(1, len(size)):  # outer ones come first
            if self.named[i] in spared and 2 * size[i] > size[0] and not (self.plain[i] and longest):
                spared.add(i)
        return spared

    @staticmethod
    def _tokens(source: str):
        pos = 0
        while m := TOKEN.search(source, pos):
            yield m
            pos = m.end()
            if m[2] and not m[1] and (tag := m[2].lower()) in RAW:
                end = re.compile(rf"</{tag}\b", re.I).search(source, pos)
                pos = end.start() if end else len(source)

    def _say(self, text: str) -> None:
        top = self.stack[-1]
        if not top.off:
            self._text.append((top, text))

    def _flush(self) -> None:
        if self._text:
            self._said.append(self._text)
            self._text = []

    def _pop(self) -> None:
        node = self.stack.pop()
        self.box.pop()
        self.styles.setdefault(node.path, node.style.intdigest() - (1 << 63))

    def _close(self, depth: int) -> None:
        while len(self.stack) > depth:
            self._pop()

    def _end(self, tag: str) -> None:
        if tag == "br":
            self._say(" ")
        if tag in BLOCK:
            self._flush()
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                self._close(i)
                return
            if tag not in BLOCK and self.stack[i].tag in BLOCK:
                return

    def _start(self, tag: str, raw: str, source: str, pos: int) -> int:
        if tag in BLOCK:
            self._flush()
        if tag in CLOSES_P:
            self._open_end({"p"})
        if tag in SIBLINGS:
            self._open_end(SIBLINGS[tag])
        if tag in VOID or raw.rstrip().endswith("/") and tag not in BLOCK:
            if tag == "br":
                self._say(" ")
            return pos
        up = self.stack[-1]
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(source, pos)
            return end.start() if end else len(source)
        if tag not in BLOCK and tag not in UNSEEN and not raw.strip():
            node = Node(tag, up.path, up.article, up.off, up.named)
            node.style = up.style
        else:
            a = attributes(raw)
            name = f"{a.get('class', '')} {a.get('id', '')}".strip()
            role = a.get("role", "").lower()
            furniture = tag in FURNITURE or tag == "header" and not up.article or role in FURNITURE_ROLES
            off = up.off or tag in UNSEEN or furniture or "hidden" in a or a.get("aria-hidden") == "true"
            named, article = up.named, up.article
            if not off and tag not in ("html", "body", "main") and (how := names_furniture(name)):
                named = len(self.named)
                self.named.append(up.named)
                self.plain.append(how == 2)
            elif not off and (tag in ARTICLE or role == "main") and not article:
                article = len(self.articles)
                self.articles.append(named)
            shown = f"{tag}.{'.'.join(sorted(name.split()))}.{role}"
            node = Node(tag, below(up.path, shown) if tag in BLOCK else up.path, article, off, named)
            up.style.update(shown.encode("utf-8", "surrogatepass"))
            if name and tag in BLOCK and tag not in CONTENT:
                self.container.setdefault(node.path, node.path)
        self.stack.append(node)
        self.box.append(0)
        if tag in BLOCK:
            self.container.setdefault(node.path, self.container.get(up.path, 0))
        return pos

    def _open_end(self, tags: set[str]) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[i].tag
            if tag in tags:
                self._close(i)
                return
            if tag in SCOPE:
                return


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


PARSED = "url string, host string, template long, longest long, blocks array<struct<path:long,what:long,text:string,article:boolean>>, paths array<long>, boxes array<long>, seen array<struct<path:long,style:boolean,what:long,n:long>>"


def parsed(pages: DataFrame) -> DataFrame:
    """Every page, parsed once, as a written table (page_id, url, host, template, longest, blocks, paths, boxes, seen).

    ``template`` names the page's nodes, ``longest`` its longest block; ``seen`` has what its nodes show and
    say, a row for each node and style or content.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = pages.schema["page_id"].dataType
    arrow_id = to_arrow_type(id_type)

    def columns(names: tuple[str, ...], rows: list[tuple]) -> pa.Array:
        types = {"path": pa.int64(), "what": pa.int64(), "text": pa.string(), "article": pa.bool_(), "style": pa.bool_(), "n": pa.int64()}
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], types[c]) for i, c in enumerate(names)], list(names))

    def lists(sizes: list[int], values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)

    def run(batches):
        for batch in sliced(batches, 500):
            flat: list[tuple] = []
            blocks, paths, boxes, seen = [], [], [], []
            sizes: list[tuple[int, int, int]] = []
            for url, source in zip(batch.column("url").to_pylist(), batch.column("html")):
                page = Page(source.as_py() or "")
                own = [(path, xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63), text, article) for path, text, article in page.blocks]
                nodes = sorted({b[0] for b in own})
                held = [page.container.get(p, 0) for p in nodes]
                said = [(path, False, what, n) for (path, what), n in Counter(b[:2] for b in own).items()] + [(path, True, what, 1) for path, what in page.styles.items()]
                template = xxhash.xxh64_intdigest(np.array(nodes + held, np.int64).tobytes()) - (1 << 63)
                flat.append((url, host_of(url), template, max(own, key=lambda b: len(b[2]))[1] if own else 0))
                sizes.append((len(own), len(nodes), len(said)))
                blocks += own
                paths += nodes
                boxes += held
                seen += said
            each = [pa.array([r[i] for r in flat], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))]
            n = list(zip(*sizes)) or [(), (), ()]
            each += [lists(n[0], columns(("path", "what", "text", "article"), blocks)), lists(n[1], pa.array(paths, pa.int64())), lists(n[1], pa.array(boxes, pa.int64())), lists(n[2], columns(("path", "style", "what", "n"), seen))]
            yield pa.RecordBatch.from_arrays([batch.column("page_id").cast(arrow_id), *each], ["page_id", "url", "host", "template", "longest", "blocks", "paths", "boxes", "seen"])

    small_batches(pages)
    return written(pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {id_type.simpleString()}, {PARSED}"), "site-pages")


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, path, importance) of every node of every host's tree, from :func:`parsed` pages.

    Rows of pages are summed to counts of (host, path, style) and (host, path, content) before they are
    dealt out, so a host with most of the pages costs as many rows as its tree has nodes and contents.
    """
    rows = pages.select("host", F.explode("seen").alias("s")).select("host", "s.*")
    each = rows.groupBy("host", "path", "style", "what").agg(F.sum("n").alias("c"), F.sum(F.col("n") * F.log(F.col("n").cast("double"))).alias("l"))
    # a content's entropy over the pages it is on; a style's part of its node's entropy
    entropy = F.log(F.col("c").cast("double")) - F.col("l") / F.col("c")
    node = each.groupBy("host", "path").agg(
        F.sum(F.when(F.col("style"), F.col("c"))).alias("m"),
        F.sum(F.when(F.col("style"), F.col("c") * F.log(F.col("c").cast("double")))).alias("cl"),
        F.count_if(F.col("style")).alias("styles"),
        F.avg(F.when(~F.col("style"), entropy)).alias("spread"),
    )
    m = F.coalesce(F.col("m"), F.lit(1)).cast("double")
    shown = F.when(m > 1, (F.log(m) - F.col("cl") / m) / F.log(m)).otherwise(1.0)
    said = F.when(F.col("spread").isNull(), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col("spread") / F.log(m + PRIOR)))
    share = F.pow(F.lit(GAMMA), F.greatest(F.col("styles"), F.lit(1)))
    return node.select("host", "path", ((1 - share) * shown + share * said).alias("importance"))


def site_blocks(pages: DataFrame, most: float = MOST_PAGES) -> DataFrame:
    """(host, path, what) of the blocks that stand on at least ``most`` of a host's other pages, copies counted once."""
    each = pages.select("host", "longest", F.explode("blocks").alias("b")).select("host", "longest", "b.path", "b.what").distinct()
    often = each.groupBy("host", "path", "what").agg(F.count("*").alias("k")).where("k > 1")
    kinds = pages.where(F.size("blocks") > 0).select("host", "longest").distinct().groupBy("host").agg(F.count("*").alias("m"))
    return often.join(kinds, "host").where((F.col("k") - 1) / (F.col("m") - 1 + PRIOR) >= most).select("host", "path", "what")


def extract(pages: DataFrame, least_importance: float = LEAST_IMPORTANCE, most_pages: float = MOST_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html, any others).

    Null or empty html gives an empty text. Rows without a host (null or odd url) form one host. Repeated rows
    give repeated rows, and are copies; a null page_id stays null; no rows give none. Form controls count as
    forms; formulas, drawings and what stands in for players are text.
    """
    pages = parsed(pages)
    low = style_tree(pages).where(F.col("importance") < least_importance).select("host", "path")
    # pages of one host with the same nodes are judged once
    kinds = pages.groupBy("host", "template").agg(F.first("paths").alias("paths"), F.first("boxes").alias("boxes"))
    nodes = kinds.select("host", "template", F.explode(F.array_distinct(F.concat("paths", "boxes"))).alias("path"))
    low = nodes.join(low, ["host", "path"]).groupBy("host", "template").agg(F.sort_array(F.collect_list("path")).alias("low"))
    site = kinds.select("host", "template", F.explode("paths").alias("path")).join(site_blocks(pages, most_pages), ["host", "path"])
    site = site.groupBy("host", "template").agg(F.collect_set("what").alias("site"))
    judged = kinds.join(low, ["host", "template"], "left").join(site, ["host", "template"], "left").where("low is not null or site is not null")
    # written, so both sides of the join are dealt out for it and a host with most of the pages is split
    judged = written(judged.select("host", "template", "paths", "boxes", "low", "site"), "site-judged")
    x = pages.select("page_id", "url", "host", "template", "blocks").join(judged, ["host", "template"], "left")
    box = F.map_from_arrays("paths", "boxes")
    within = lambda b: F.array_contains("low", F.element_at(box, b.path))

    def kept(b):
        return F.when(F.col("low").isNull(), F.lit(True)).when(F.col("any_article"), ~within(b)).otherwise(~(within(b) | F.array_contains("low", b.path)))

    size = lambda c: F.aggregate(c, F.lit(0), lambda n, b: n + F.char_length(b.text))
    x = x.withColumn("any_article", F.exists("blocks", lambda b: b.article))
    x = x.select("page_id", "url", "site", F.filter("blocks", lambda b: (b.article | ~F.col("any_article")) & kept(b)).alias("main"))
    x = x.withColumn("own", F.when(F.col("site").isNotNull(), F.filter("main", lambda b: ~F.array_contains("site", b.what))))
    x = x.select("page_id", "url", F.when(F.col("own").isNull() | (2 * size(F.col("own")) < size(F.col("main"))), F.col("main")).otherwise(F.col("own")).alias("main"))
    x = x.select("page_id", "url", F.array_join(F.transform("main", lambda b: b.text), "\n").alias("text"))
    return x.withColumn("n_chars", F.char_length("text").cast("long"))
