"""Main text of web pages by site template removal.

Every element subtree of every page is hashed, the pages of each host that
hold a subtree are counted in Spark, and subtrees recurring across many pages
of that host are deleted: lists of links from a few pages on, other parts that
are no prose from a share of the host or a number of pages, prose (paragraphs,
headings, list items, quotations, and whatever reads as a sentence) only where
half of the host's pages, or of those in one leading path section of it, hold
it; table cells inside an article go with their row.

Besides, elements that say what they are (menus, page headers, footers,
sidebars, notices, adverts, forms, scripts, comments; by tag, role, class or
id) are left out, and of a page with ``article`` or ``main`` elements only
these count. Inside them a class or id must be that of comments, adverts or
notices, or the element be made of links; no class leaves a page without text.

Only hashes are shuffled to count; a page is parsed again when its text is
written (its blocks, kept for that, would be as large as the pages), and
joined with the hashes to delete, if it has any.

Defined results: a null html counts as empty and gives an empty text; a null
url has the empty host; copies of a page count once for their host; repeated
rows give a row each; an empty table gives an empty result; other columns
stay in ``row`` whatever their names.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mkpulse.llm.common import materialize, packed
from mkpulse.llm.url_filter import host_and_path
from mkpulse.session import release

#: Kinds of subtrees, the two lowest bits of a hash: made of links; prose inside a landmark; prose elsewhere; others.
LINKS, PROSE_INSIDE, PROSE_OUTSIDE, OTHER = range(4)
#: Links are template on this many pages of a host that differ in their html; others on so many that are this share of
#: the host's pages as well, or on MANY_PAGES, however many the host has.
MIN_PAGES, MIN_SHARE, MANY_PAGES = 5, 0.2, 20
#: Prose, of the pages of the host or of one leading path section of it: share, and least number inside a landmark.
PROSE_PAGES, PROSE_SHARE = 20, 0.5

MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>?|<[!?/][^>]*+>?""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt blockquote pre td th caption figcaption".split())
CELLS = frozenset("td th".split())
BLOCK = PROSE | frozenset("address article aside body center details dialog div dl fieldset figure footer form header hgroup hr html legend "
                          "main menu nav ol option section summary table tbody tfoot thead tr ul".split())
DROPPED = frozenset("head script style noscript template iframe object embed svg canvas audio video nav footer aside form button select "
                    "textarea input dialog menu xmp noembed noframes title".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
DROPPED_MARKS = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr "
                          "notice notices popup modal newsletter subscribe subscription sidebar menu navbar nav navigation breadcrumb breadcrumbs "
                          "pagination pager footer header masthead topbar toolbar share sharing social related recommended comments comment "
                          "respond replies disqus login signup search skip banner".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Whole names that mark adverts and notices inside an article too, unless they are a third of it or hold its title.
PAID = re.compile(r"(?:.*[-_])?(?:ads?|adverts?|advertisements?|advertising|adsense|sponsor(?:ed)?|promo|promotion|cookies?|consent|gdpr|notices?|"
                  r"newsletter|popup|modal)(?:[-_](?:box|block|banner|bar|wrap|wrapper|container|slot|unit|area|notice|consent|signup|form|text|message|top|bottom|\d+))*")
PAID_SHARE = 1 / 3
#: A class that begins so tells of a state, not of a content: "has-comments".
STATE = re.compile(r"(?:no|has|with|without|is|show|shows|hide|hides|open|closed|enable|enabled|disable|disabled)[-_].*")
#: A sentence has so many words and one of these ends, before closing marks; a text so long is prose anyway.
SENTENCE_WORDS, ENDS, CLOSERS, LONG_TEXT = 4, ".!?\u2026\u3002", " \t\n'\")]\u201d\u2019\u00bb", 1000
#: Words that also name the head of an article, which holds its title.
HEADS = frozenset("header masthead".split())
#: Whole names of lists of comments, and of links to other pages.
LISTS = r"(?:[-_]?(?:list|area|section|thread|form|body|posts?|articles?|stories|items?|links|pages|content|box|block|wrap|wrapper|container))*"
COMMENTS = re.compile(rf"(?:.*[-_])?(?:comments?|respond|replies|disqus){LISTS}")
TALK = re.compile(rf"(?:.*[-_])?(?:comments?|respond|replies|disqus|related|recommended){LISTS}")
#: Inside a landmark, a class or id marks an element with at least this share of its text in links.
LINK_SHARE = 0.5
#: Elements are nested at most so deep; deeper ones count as their parent's content, without those left out by tag or role.
DEEPEST = 400
#: An opening tag closes the nearest open element of these names, unless one of the second names is open inside.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
          "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
          "body": ({"head"}, set())}


class Node:
    __slots__ = ("tag", "attrs", "kids", "text_n", "link_n", "said")

    def __init__(self, tag: str, attrs: str):
        self.tag, self.attrs, self.kids = tag, attrs, []
        self.text_n = self.link_n = -1  # counted once, when the page is whole
        self.said: str | None = None


def parse(html: str) -> Node:
    """Elements and texts of a page; open ends are closed as browsers do for the common cases."""
    root = Node("html", "")
    stack, at, end = [root], 0, len(html)
    muted: list[str] = []  # open elements below the deepest level whose content is left out
    below: list[str] = []  # the others there
    open_below: dict[str, int] = {}

    def put(text: str):
        if not muted:
            stack[-1].kids.append(entities.unescape(text))

    def close(names, within=frozenset()):
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in names:
                del stack[k:]
                return
            if stack[k].tag in within:
                return

    while at < end:
        m = MARKUP.search(html, at)
        if not m:
            put(html[at:])
            break
        if m.start() > at:
            put(html[at : m.start()])
        at = m.end()
        slash, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if muted:
            if tag == muted[-1]:
                if slash:
                    muted.pop()
                else:
                    muted.append(tag)
            elif tag in RAW and not slash:
                stop = re.compile(rf"</{tag}[\s/>]", re.I).search(html, at)
                at = stop.start() if stop else end
            continue
        if slash and open_below.get(tag):
            while (last := below.pop()) != tag:
                open_below[last] -= 1
            open_below[tag] -= 1
            if tag in BLOCK:
                stack[-1].kids.append(Node(tag, ""))  # ends a block of text
            continue
        if slash:
            # an inline end tag does not close a block around it
            close({tag}, frozenset() if tag in BLOCK else BLOCK)
            continue
        if tag == "html":
            continue
        if tag in CLOSES:
            close(*CLOSES[tag])
        elif tag in BLOCK:
            close({"p"}, {"td", "th", "li", "div", "section", "article", "blockquote", "button", "table"} if tag != "p" else
                  {"td", "th", "button", "table", "div", "section", "article", "blockquote", "li"})
        node = Node(tag, attrs or "")
        if len(stack) >= DEEPEST and tag not in VOID and tag not in RAW and (tag in DROPPED or hidden(node)):
            muted.append(tag)
            continue
        stack[-1].kids.append(node)
        if tag in RAW:
            stop = re.compile(rf"</{tag}[\s/>]", re.I).search(html, at)
            at = stop.start() if stop else end
            stack.append(node)
        elif tag in VOID:
            continue
        elif len(stack) < DEEPEST:
            stack.append(node)
        else:
            node.attrs = ""
            below.append(tag)
            open_below[tag] = open_below.get(tag, 0) + 1
    return root


def attributes(node: Node) -> dict[str, str]:
    return {name.lower(): (a or b or c).lower() for name, a, b, c in reversed(ATTRIBUTE.findall(node.attrs))}  # the first of a name holds


def hidden(node: Node) -> bool:
    """Whether the role or the attribute hidden say that the element is no main text."""
    if not node.attrs:
        return False
    found = attributes(node)
    return "hidden" in found or not DROPPED_ROLES.isdisjoint(found.get("role", "").split())


def named(node: Node) -> bool:
    """Whether class or id hint that the element is no main text. Headings, and sections by their id, are named after what they tell."""
    if not node.attrs or node.tag in HEADINGS:
        return False
    found = attributes(node)
    own = found.get("id", "").strip()
    words = set(re.split(r"[^a-z0-9]+", found.get("class", "")))
    words |= {own} if node.tag == "section" else set(re.split(r"[^a-z0-9]+", own))
    words &= DROPPED_MARKS
    return bool(words) and (not words <= HEADS or not titled(node))


def talk(node: Node, names: re.Pattern = TALK) -> bool:
    """Whether class or id say that the element holds comments or links to other pages."""
    if not node.attrs or node.tag == "body" or node.tag in HEADINGS:
        return False
    found = attributes(node)
    return any(names.fullmatch(x) and not STATE.fullmatch(x) for x in [*found.get("class", "").split(), found.get("id", "").strip()])


def link_length(node: Node) -> int:
    if node.link_n < 0:
        node.link_n = sum(0 if isinstance(k, str) or k.tag in DROPPED else text_length(k) if k.tag == "a" else link_length(k) for k in node.kids)
    return node.link_n


def text_length(node: Node) -> int:
    if node.text_n < 0:
        node.text_n = sum(len(k.strip()) if isinstance(k, str) else 0 if k.tag in DROPPED else text_length(k) for k in node.kids)
    return node.text_n


def linked(node: Node) -> bool:
    """Whether the element's text is mostly links."""
    n = text_length(node)
    return n > 0 and link_length(node) >= LINK_SHARE * n


def squeezed(text: str) -> str:
    """Each run of white space as one space."""
    return f"{' ' if text[:1].isspace() else ''}{' '.join(text.split())}{' ' if text[-1:].isspace() else ''}"


def full_text(node: Node) -> str:
    """The text of an element whose length is bounded (:func:`sentence`): kept at each node, so each is read once."""
    if node.said is None:
        node.said = squeezed("".join(squeezed(k) if isinstance(k, str) else "" if k.tag in DROPPED else full_text(k) for k in node.kids))
    return node.said


def sentence(node: Node) -> bool:
    """Whether the element's text reads as prose."""
    if text_length(node) >= LONG_TEXT:
        return True
    text = full_text(node).rstrip(CLOSERS)
    return text[-1:] in tuple(ENDS) and len(text.split(None, SENTENCE_WORDS)) >= SENTENCE_WORDS


def titled(node: Node) -> bool:
    """Whether the element is or holds an h1."""
    nodes = [node]
    while nodes:
        n = nodes.pop()
        if n.tag == "h1":
            return True
        nodes += [k for k in n.kids if not isinstance(k, str)]
    return False


def main_roots(root: Node) -> tuple[list[Node], bool]:
    """The articles and main elements of a page in page order, else the page; and whether they are such landmarks.

    Those in lists of comments or related pages, and empty ones, do not count. A main element stands for the articles
    in it unless these hold most of its text. Where no article has an ``h1``, those beside them count too.
    """
    length = text_length

    def longest(node: Node) -> list[Node]:
        """The way down to the longest landmark, whatever the elements on it are named."""
        best: list[Node] = []
        for k in node.kids:
            if not isinstance(k, str) and k.tag not in DROPPED and length(k):
                way = longest(k)
                best = max(best, way, key=lambda w: length(w[-1]) if w else 0)
        landmark = node.tag in ("article", "main") or "main" in attributes(node).get("role", "").split()
        return [node, *best] if best else [node] if landmark else []

    def walk(node: Node, trusted: frozenset[int] = frozenset()) -> list[Node]:
        if talk(node) and id(node) not in trusted:
            return []
        main = node.tag == "main" or "main" in attributes(node).get("role", "").split()
        if (main or node.tag == "article") and not length(node):
            return []
        if node.tag == "article":
            return [node]
        found = [n for k in node.kids if not isinstance(k, str) and k.tag not in DROPPED for n in walk(k, trusted)]
        return [node] if main and 2 * sum(map(length, found)) <= length(node) else found

    def with_titles(node: Node) -> list[Node]:
        if node.tag == "h1" or id(node) in landmarks:
            return [node]
        return [n for k in node.kids if not isinstance(k, str) and k.tag not in DROPPED and not hidden(k) and not named(k) for n in with_titles(k)]

    # what holds the only landmark of a page is no list of comments, whatever its name
    found = walk(root) or walk(root, frozenset(map(id, longest(root))))
    if not found:
        return [root], False
    if any(titled(n) for n in found):
        return found, True
    landmarks = {id(n) for n in found}
    with_h1 = with_titles(root)
    # a mark around a landmark hides the titles there, never the landmark
    return (with_h1 if landmarks <= {id(n) for n in with_h1} else found), True


class Page:
    """A parsed page: its blocks of main text, and the hashes of all its subtrees."""

    def __init__(self, html: str):
        self.root = parse(html)
        self.starts, self.landmark = main_roots(self.root)
        self.total = sum(map(text_length, self.starts))
        self.digests: dict[int, bytes] = {}

    def kept(self, node: Node, by_name: bool = True) -> bool:
        """Whether tag, role, class and id let the element count."""
        if node.tag in DROPPED or node.tag == "header" and not self.landmark or hidden(node):
            return False
        if node.tag == "body" or not by_name or not node.attrs:
            return True
        if self.landmark:
            if talk(node, COMMENTS):
                return False
            if talk(node, PAID) and text_length(node) <= PAID_SHARE * self.total and not titled(node):
                return False
            # any other name needs links to mark an element, or the counts
            return not (named(node) and link_length(node) >= LINK_SHARE * max(1, text_length(node)))
        # a page's wrapper may be named after what it also holds ("with-sidebar")
        return not named(node) and not talk(node) or not talk(node) and 2 * text_length(node) > self.total

    def digest(self, node: Node) -> bytes:
        if id(node) not in self.digests:
            h = hashlib.blake2b(node.tag.encode(), digest_size=8)
            for k in node.kids:
                if isinstance(k, str):
                    h.update(b"\0" + " ".join(k.split()).encode("utf-8", "surrogatepass"))
                elif k.tag not in RAW:
                    h.update(b"\1" + self.digest(k))
            self.digests[id(node)] = h.digest()
        return self.digests[id(node)]

    def mark(self, node: Node, inside: bool) -> int:
        """The hash of a subtree, its kind in the lowest bits."""
        if linked(node):
            kind = LINKS
        elif (node.tag in PROSE and not named(node)) or sentence(node):
            kind = PROSE_INSIDE if inside else PROSE_OUTSIDE
        else:
            kind = OTHER
        return int.from_bytes(self.digest(node), "little", signed=True) & ~3 | kind

    def countable(self, node: Node, inside: bool) -> bool:
        # a table's cells may hold the same figure on every page
        return node.tag in BLOCK and node.tag != "body" and not (inside and node.tag in CELLS)

    def hashes(self) -> set[int]:
        """Of every subtree with text, marked elements and what lies beside the landmarks included."""
        out: set[int] = set()
        landmarks = {id(n) for n in self.starts if n.tag != "h1"} if self.landmark else set()

        def walk(node: Node, inside: bool):
            for k in node.kids:
                if not isinstance(k, str) and k.tag not in RAW and k.tag != "head":
                    within = inside or id(k) in landmarks
                    if self.countable(k, within) and id(k) not in landmarks and (text_length(k) or k.tag in DROPPED):
                        out.add(self.mark(k, within))
                    walk(k, within)

        walk(self.root, False)
        return out

    def blocks(self, by_name: bool = True) -> list[tuple[str, tuple[int, ...]]]:
        """The blocks of the main text in page order: text, and the hashes of the subtrees around it."""
        blocks: list[tuple[str, tuple[int, ...]]] = []
        buffer: list[str] = []

        def flush(hashes: tuple[int, ...]):
            text = " ".join("".join(buffer).split())
            buffer.clear()
            if text:
                blocks.append((text, hashes))

        def walk(node: Node, hashes: tuple[int, ...], inside: bool):
            for k in node.kids:
                if isinstance(k, str):
                    buffer.append(k)
                elif k.tag == "br":
                    buffer.append(" ")
                elif self.kept(k, by_name):
                    own = (*hashes, self.mark(k, inside)) if self.countable(k, inside) else hashes
                    if k.tag in BLOCK:
                        flush(hashes)
                        walk(k, own, inside)
                        flush(own)
                    else:
                        walk(k, own, inside)

        for start in self.starts:
            # a title beside the landmarks may be the site's own
            beside = self.landmark and start.tag == "h1"
            own = (self.mark(start, False),) if beside else ()
            walk(start, own, self.landmark and not beside)
            flush(own)
        if not blocks and by_name and self.total:
            return self.blocks(by_name=False)  # no class or id leaves a page without text
        return blocks


def main_text(html: str, template: frozenset[int] | set[int] = frozenset()) -> str:
    return "\n\n".join(t for t, hashes in Page(html).blocks() if template.isdisjoint(hashes))


def templates(pages: DataFrame, url: str = "url", html: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE,
              many_pages: int = MANY_PAGES) -> DataFrame:
    """Per page content with something to delete: ``content`` (md5 of url and html) and ``template``, the hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted(Page(x.as_py() or "").hashes()) for x in b.column(5)]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(found, pa.list_(pa.int64()))],
                                             ["host", "section", "content", "page", "body", "hashes"])

    host, section = place(F.col(url))
    held = pages.select(host.alias("host"), section.alias("section"), content(F.col(url), F.col(html)).alias("content"),
                        F.xxhash64(F.col(url), F.col(html)).alias("page"), F.xxhash64(F.col(html)).alias("body"), F.col(html).alias("html"))
    held = materialize(held.mapInArrow(run, "host string, section string, content string, page long, body long, hashes array<long>"), "page-hashes")

    def counted(once: DataFrame, keys: list[str], kinds: tuple[int, ...], least: int) -> DataFrame:
        often = once.select(*keys, F.explode("hashes").alias("hash")).where(F.col("hash").bitwiseAND(F.lit(3)).isin(*kinds))
        return often.groupBy(*keys, "hash").agg(F.count("*").alias("n")).where(F.col("n") >= least)

    def recurring(keys: list[str], kind: int, least: int, share: float) -> DataFrame:
        # a content once for its host or section; the copies fall together before the hashes are counted
        once = held.dropDuplicates([*keys, "page"])
        pages_of = once.groupBy(*keys).agg(F.count("*").alias("pages"))
        often = counted(once, keys, (kind,), least).join(pages_of, keys).where(F.col("n") >= share * F.col("pages"))
        return often.select("host", (F.col("section") if "section" in keys else F.lit(None).cast("string")).alias("section"), "hash")

    often = recurring(["host"], OTHER, min_pages, min_share)
    for keys in (["host"], ["host", "section"]):
        often = often.unionByName(recurring(keys, PROSE_INSIDE, PROSE_PAGES, PROSE_SHARE)).unionByName(recurring(keys, PROSE_OUTSIDE, min_pages, PROSE_SHARE))
    # copies under other addresses make no template of a page's own text, so these pages differ in their html
    different = counted(held.dropDuplicates(["host", "body"]), ["host"], (LINKS, OTHER), min_pages)
    different = different.where((F.col("n") >= many_pages) | (F.col("hash").bitwiseAND(F.lit(3)) == LINKS))
    often = often.unionByName(different.select("host", F.lit(None).cast("string").alias("section"), "hash")).distinct()
    often = materialize(often.toDF("h", "s", "x"), "page-templates")
    seen = held.dropDuplicates(["content"]).select("host", "section", "content", F.explode("hashes").alias("hash"))
    hit = seen.join(often, (F.col("host") == F.col("h")) & (F.col("hash") == F.col("x")) & F.coalesce(F.col("section") == F.col("s"), F.lit(True)), "left_semi")
    out = materialize(hit.groupBy("content").agg(F.collect_set("hash").alias("template")), "page-deletions")
    release(held, often)
    return out


def place(url: Column) -> tuple[Column, Column]:
    """Host, and the first folder of the path (empty if there is none)."""
    host, path = host_and_path(url)
    return host, F.regexp_extract(path, "^/+([^/]+)/", 1)


def content(url, html):
    return F.md5(F.concat_ws("|", F.coalesce(F.concat(F.lit("="), url), F.lit("")), F.coalesce(F.concat(F.lit("="), html), F.lit(""))))


def extract(pages: DataFrame, url: str = "url", html: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE,
            many_pages: int = MANY_PAGES) -> DataFrame:
    """``row`` (without the html) and ``text`` of every page."""
    deletions = templates(pages, url, html, min_pages, min_share, many_pages).withColumnRenamed("content", "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py() or "", frozenset(t.as_py() or ())) for x, t in zip(b.column(1), b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["row", "text"])

    rows = packed(pages).select("row", F.col("row")[html].alias("html"), content(F.col("row")[url], F.col("row")[html]).alias("content"))
    rows = rows.withColumn("row", F.col("row").dropFields(html)) if len(pages.columns) > 1 else rows
    rows = rows.join(deletions, F.col("content") == F.col("k"), "left").select("row", "html", "template")
    return rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("text", T.StringType())]))
