"""Main text of web pages, with site templates removed by counting.

Pass 1 parses each page and hashes its element subtrees (tag, class, id, text
and children). Spark counts, per host, the pages each subtree is on: one row
per page and distinct subtree, summed per task before the shuffle, so a host
holding a third of all pages costs no more than its distinct subtrees.
Subtrees on many pages of their host may be its template. Pass 2 looks what else
those pages say: copies of an article are on many pages too, but those pages say
nothing of their own. A subtree that stands beside different texts is template.
Pass 3 deletes the templates and reads the text that is left.

What may be template: a subtree on at least ``min_pages`` pages and ``min_share``
of the host's pages, or, on hosts of ``LARGE`` pages or more, a container that is
on ``GROWTH * (log10(pages) - 1)`` pages in different surroundings (the nearest
subtree around it that could be a template itself). It is template if, on hosts of
any size, at least ``min_pages`` different texts stand beside it: the text of a
page outside all subtrees that may be template, if it is ``OWN_SHARE`` of the
page's text or more. What encloses the page's text is never a template. Paragraphs and headings inside an article are never taken for
one, since articles quote and repeat each other; menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles and reader comments go by
their tag, role, class or id on any page, also where a host has few pages.

The text: of the ``article`` elements (of several side by side the longest and
those of ``LIKE`` its length: teasers of other articles are short), else of ``main``, else of the body; one
block per block element, white space in a block as one space, blocks joined by
an empty line.

Edge cases. Null or empty html: empty text. Null urls, or urls without a host,
have no template. Unclosed, unknown or wrongly nested tags are closed as browsers
do in the common cases; a lone ``<`` is text. Depth and length are not
bounded. Repeated rows count as pages each. Other columns pass through.
"""

from __future__ import annotations

import html
import re

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitlens.llm.common import broadcast_if_small, materialise, table

MIN_PAGES, MIN_SHARE = 5, 0.3
#: Pages of a host from which surroundings count, and how many are needed: 30 of 100 pages, 60 of 1,000, 150 of 1,000,000.
LARGE, GROWTH = 100, 30
#: Share of a page's text that must be its own for the page to count, and of the longest article that others must have.
OWN_SHARE, LIKE = 0.1, 0.25
#: Most (host, subtree) rows whose hosts are broadcast; beyond it pages are joined by a shuffle.
BROADCAST_ROWS = 1_000_000

# HTML's void, raw-text and block elements, and the elements,
# roles and names that are not main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noframes".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                   "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
BOXES = frozenset("address aside center details dialog div dl fieldset figure footer form header hgroup menu nav ol section table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCKS - frozenset("li dd dt caption tbody thead tfoot tr body html".split()) | frozenset(["li", "dd", "dt"])
DROPPED = frozenset("script style noscript template iframe object embed svg canvas audio video nav footer aside form button select option "
                    "textarea input label head title menu dialog".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
DROPPED_NAMES = frozenset("ad ads advert adverts advertisement advertising adsense banner banners sponsor sponsored promo promotion cookie cookies consent gdpr "
                          "notice notices popup modal overlay newsletter subscribe subscription sidebar menu nav navbar navigation breadcrumb breadcrumbs footer "
                          "masthead comment comments disqus respond reply replies share sharing social related recommended widget widgets toolbar pagination "
                          "pager login signup register search".split())
COMMENT_NAMES = frozenset("comment comments disqus respond reply replies related recommended".split())
#: Parts of a name before or after such a name that make it one of a wrapper.
BEFORE, AFTER = frozenset("has no with without not layout".split()), frozenset("open closed off enabled disabled none".split())
HEADER_NAMES = frozenset("header site-header page-header top-header siteheader pageheader topbar top-bar".split())
#: What an open element of the same kind is closed by, and what its search stops at.
SIBLINGS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)),
            "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|\b(hidden)\b""")
BREAK = "\0"


class Node:
    __slots__ = ("tag", "names", "role", "hidden", "children", "digest", "in_article", "chars", "paragraphs", "holds_main")

    def __init__(self, tag: str, attributes: str = "", in_article: bool = False):
        self.tag, self.children, self.digest = tag, [], 0
        self.names, self.role, self.hidden = "", "", False
        self.chars, self.paragraphs, self.holds_main = 0, 0, tag == "main"
        self.in_article = in_article
        for name, a, b, c, flag in ATTRIBUTE.findall(attributes) if attributes else ():
            name, value = name.lower(), (a or b or c).lower()
            if name in ("class", "id"):
                self.names += " " + value
            elif name == "role":
                self.role = value
            elif flag or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
                self.hidden = True

    def named(self, names: frozenset) -> bool:
        """Whether a part of a class or id is one of the names, apart from
        those that only say whether there is such a thing (has-sidebar)."""
        for w in self.names.split():
            parts = re.split(r"[^a-z0-9]+", w)
            if any(x in names and not (k and parts[k - 1] in BEFORE or parts[-1] in AFTER and k < len(parts) - 1) for k, x in enumerate(parts)):
                return True
        return False

    def encloses(self, page: Node) -> bool:
        """Whether it is around the page's text: holds ``main``, or most of
        the text in paragraphs and articles (without any: most of the text)."""
        if page.paragraphs:
            return self.holds_main or 2 * self.paragraphs > page.paragraphs and 4 * self.chars >= page.chars
        return self.holds_main or 2 * self.chars > page.chars

    def dropped(self, page: Node) -> bool:
        if self.tag in DROPPED and self.tag != "form" or self.hidden or self.role in DROPPED_ROLES - {"form"} or self.tag == "header" and not self.in_article:
            return True
        if self.tag == "form" or self.role == "form":
            return not self.encloses(page)
        if not self.names or self.tag in ("html", "body", "article", "main") and not self.in_article:
            return False
        return (any(w in HEADER_NAMES for w in self.names.split()) or self.named(DROPPED_NAMES)) and not self.encloses(page)

    def countable(self) -> bool:
        """Whether it may be a template: not a text block of an article."""
        return not self.in_article or self.tag not in HEADINGS and self.tag not in ("p", "blockquote", "pre", "li", "td", "th", "figcaption", "b", "i", "em", "strong", "a", "span", "article")

    def box(self) -> bool:
        """Whether it is a container, not a piece of running text."""
        return self.tag in BOXES and (bool(self.names) or any(isinstance(c, Node) for c in self.children))

    def close(self) -> None:
        """Hash the subtree from its parts, once its children are hashed."""
        h = xxhash.xxh3_64(f"{self.tag}|{self.names}|")
        for c in self.children:
            h.update(f"#{c.digest}" if isinstance(c, Node) else " ".join(c.split()))
        self.digest = h.intdigest() - (1 << 63)
        if self.tag in DROPPED and self.tag != "form" or self.hidden:
            self.holds_main = False
            return
        for c in self.children:
            if isinstance(c, Node):
                self.chars += c.chars
                self.paragraphs += c.paragraphs
                self.holds_main |= c.holds_main
            else:
                self.chars += len("".join(c.split()))
        self.holds_main |= self.role == "main"
        if self.names and self.named(COMMENT_NAMES):
            self.paragraphs = 0
        elif self.tag in ("p", "pre", "blockquote", "article", "main"):
            self.paragraphs = self.chars


def parse(source: str) -> Node:
    """The element tree of a page; every element is hashed when it closes."""
    root = Node("")
    stack, at = [root], 0

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            stack.pop().close()

    def open_at(tags, stops=()) -> int:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                return i
            if stack[i].tag in stops:
                return 0
        return 0

    for m in iter(lambda: TAG.search(source, at), None):
        if m.start() > at:
            stack[-1].children.append(html.unescape(source[at:m.start()]))
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag = name.lower()
        if m[1] or m[4]:
            if i := open_at((tag,), () if tag in BLOCKS else ("article", "td", "table")):
                pop_to(i)
            continue
        if tag in CLOSES_P and (i := open_at(("p",), ("article", "td", "th", "table", "div", "section", "li", "blockquote"))):
            pop_to(i)
        if tag in SIBLINGS and (i := open_at(*SIBLINGS[tag])):
            pop_to(i)
        top = stack[-1]
        node = Node(tag, m[3] or m[6] or "", top.in_article or top.tag == "article")
        top.children.append(node)
        if tag in VOID:
            node.close()
        elif tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(source, at)
            node.children.append(source[at:end.start() if end else len(source)])
            at = end.start() if end else len(source)
            stack.append(node)
        else:
            stack.append(node)
    if at < len(source):
        stack[-1].children.append(html.unescape(source[at:]))
    pop_to(0)
    return root


def nodes(root: Node, skip=lambda n: False):
    """The elements in page order, without those skipped and what is in them."""
    todo = [root]
    while todo:
        n = todo.pop()
        if skip(n):
            continue
        yield n
        todo += [c for c in reversed(n.children) if isinstance(c, Node)]


def subtrees(source: str) -> dict[int, int | None]:
    """Distinct hashes of the subtrees that may be a template; of containers
    with the hash of their surroundings (the smallest on the page)."""
    out: dict = {}
    root = parse(source) if source else Node("")
    todo = [(root, root.digest)]
    while todo:
        n, around = todo.pop()
        if n.children and n.tag not in ("", "html", "head", "body") and n.countable():
            own = around if n.box() else None
            seen = out.get(n.digest)
            out[n.digest] = own if seen is None else seen if own is None else min(seen, own)
            around = n.digest
        elif n.tag == "body":
            around = n.digest
        todo += [(c, around) for c in n.children if isinstance(c, Node)]
    return out


def own_text(source: str, candidates: frozenset) -> tuple[list[int], int | None]:
    """(the candidates on a page, the hash of what it says outside them); no hash
    if that is too little to tell the page from a copy."""
    root = parse(source) if source else Node("")
    found, said = set(), []
    todo: list = [root]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            said += n.split()
        elif n.digest in candidates and n.countable():  # what recurs is not the page's own, also around its whole text
            todo_in = [n]
            while todo_in:  # candidates inside candidates stand beside the same text
                x = todo_in.pop()
                if x.digest in candidates and x.countable() and not x.encloses(root):
                    found.add(x.digest)
                todo_in += [c for c in x.children if isinstance(c, Node)]
        elif not n.dropped(root):
            todo += reversed(n.children)
    own = sum(map(len, said))
    return list(found), xxhash.xxh3_64_intdigest(" ".join(said)) - (1 << 63) if own and own >= OWN_SHARE * root.chars else None


def main_text(source: str, template: frozenset) -> str:
    if not source:
        return ""

    def skip(n):
        return n.dropped(root) or n.digest in template and n.countable() and not n.encloses(root)

    root = parse(source)
    kept = list(nodes(root, skip))
    articles = [n for n in kept if n.tag == "article" and not n.in_article]
    if len(articles) > 1:
        longest = max(n.chars for n in articles)
        articles = [n for n in articles if n.chars >= LIKE * longest]
    mains = articles or [n for n in kept if n.tag == "main" or n.role == "main"][:1] or [root]
    out: list[str] = []
    todo: list = [x for n in reversed(mains) for x in (BREAK, n)]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            out.append(n)
        elif not skip(n):
            edge = [BREAK] if n.tag in BLOCKS else [" "] if n.tag in ("br", "td", "th") else []
            todo += edge
            todo += [c if isinstance(c, Node) else c.replace(BREAK, " ") for c in reversed(n.children)]
            todo += edge
    return "\n\n".join(b for b in (" ".join(x.split()) for x in "".join(out).split(BREAK)) if b)


def host_column(url_col: str):
    """Lower-case host of a url; null without one."""
    host = F.lower(F.regexp_extract(F.col(f"`{url_col}`"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.when(host != "", host)


def site_templates(pages: DataFrame, url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, hash) of the subtrees that recur on a host."""
    hosted = pages.select(host_column(url_col).alias("host"), F.col(f"`{html_col}`").alias("html")).where("host IS NOT NULL AND html IS NOT NULL")

    def count(batches):
        """Partial counts: of pages (null hash) and of subtrees per host."""
        for batch in batches:
            seen: dict = {}
            for host, source in zip(batch["host"], batch["html"]):
                for key in [(host, None, None), *((host, *x) for x in subtrees(source).items())]:
                    seen[key] = seen.get(key, 0) + 1
            yield pd.DataFrame({"host": [k[0] for k in seen], "hash": pd.array([k[1] for k in seen], dtype="Int64"), "around": pd.array([k[2] for k in seen], dtype="Int64"), "n": list(seen.values())})

    counts = materialise(hosted.mapInPandas(count, "host string, hash bigint, around bigint, n bigint").groupBy("host", "hash", "around").agg(F.sum("n").alias("n"))
                         .groupBy("host", "hash").agg(F.sum("n").alias("n"), F.count("around").alias("places")).where(f"hash IS NULL OR n >= {int(min_pages)}"), "subtrees")
    totals = counts.where("hash IS NULL").select("host", F.col("n").alias("pages"))
    candidates = materialise(counts.where("hash IS NOT NULL").join(totals, "host").where(
        (F.col("n") >= min_share * F.col("pages")) | (F.col("pages") >= LARGE) & (F.col("places") >= F.greatest(F.lit(min_pages), GROWTH * (F.log10("pages") - 1)))).select("host", "hash"), "candidates")

    def beside(batches):
        for batch in batches:
            rows = set()
            for host, source, own in zip(batch["host"], batch["html"], batch["hashes"]):
                found, text = own_text(source, frozenset(own.tolist()))
                if text is not None:
                    rows.update((host, h, text) for h in found)
            yield pd.DataFrame(sorted(rows), columns=["host", "hash", "text"]).astype({"host": object, "hash": "int64", "text": "int64"})

    texts = with_hashes(hosted, "host", candidates).where("hashes IS NOT NULL").mapInPandas(beside, "host string, hash bigint, text bigint").distinct()
    return texts.groupBy("host", "hash").agg(F.count("*").alias("texts")).where(F.col("texts") >= min_pages).select("host", "hash")


def with_hashes(pages: DataFrame, host_col: str, found: DataFrame) -> DataFrame:
    """``pages`` with ``hashes``, those found on their host (null: none). Bounded
    per host: each is on a share of its pages, or in many places."""
    by_host = found.groupBy("host").agg(F.collect_list("hash").alias("hashes")).withColumnRenamed("host", "of_host")
    joined = pages.join(broadcast_if_small(by_host, found.count(), BROADCAST_ROWS), F.col(host_col) == F.col("of_host"), "left")
    return joined.drop("of_host")


def extract_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """``pages`` with ``text``, the main text of each (an older one is replaced)."""
    found = materialise(site_templates(pages, url_col, html_col, min_pages, min_share), "templates")
    # the caller's columns in one struct, so that no name clashes
    carried = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), host_column(url_col).alias("host"), F.col(f"`{html_col}`").alias("html"))
    read = F.pandas_udf(lambda sources, templates: pd.Series(
        [main_text(s or "", frozenset(t.tolist()) if t is not None else frozenset()) for s, t in zip(sources, templates)], dtype=object), "string")
    done = with_hashes(carried, "host", found).select("row", read("html", "hashes").alias("read"))
    return done.select(*[F.col("row").getField(c).alias(c) for c in pages.columns if c != "text"], F.col("read").alias("text"))


def op6_html_text(spark, sf_dir: str) -> DataFrame:
    read = extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return read.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))
