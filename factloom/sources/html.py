"""Rendered HTML pages as articles: root choice, Markdown, metadata and image candidates.

Spark has no HTML functions, so a page is parsed once by an Arrow UDF that yields everything an
article needs as one struct; choices among candidates are left to columns where they can be.
"""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser
from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.udf import arrow_udf

#: Tags that begin a block, and tags whose contents are no text of the article: fixed values.
BLOCKS = frozenset(
    "address article aside blockquote div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table ul".split()
)
SKIPPED = frozenset("button canvas form input nav noscript script select style svg textarea".split())
#: Parts of test ids of page controls, a fixed value.
CONTROLS = ("caret", "like", "reply", "retweet", "bookmark", "share")
#: Phrases of challenge and login pages; a short page with one is none of ours. Fixed values.
CHALLENGES = (
    r"(?i)log in to x",
    r"(?i)sign in to x",
    r"(?i)javascript is not available",
    r"(?i)something went wrong",
    r"(?i)verify you are human",
    r"(?i)account suspended",
)
ARTICLE = (
    "struct<title:string,author:string,published:string,description:string,markdown:string,characters:int,"
    "root_tag:string,root_score:int,images:array<struct<token:string,url:string,alt:string>>>"
)
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_HEADING = re.compile(r"h[1-6]")
#: A p element ends where one of these begins, as browsers have it.
_ENDS_P = BLOCKS - {"figcaption", "li"}
#: Elements that end where another begins, and the element that keeps them open: fixed values.
_IMPLIED = {
    "li": [("li", ("ul", "ol"))],
    "td": [("td", ("tr", "table")), ("th", ("tr", "table"))],
    "th": [("td", ("tr", "table")), ("th", ("tr", "table"))],
    "tr": [("tr", ("table",))],
    "tbody": [("thead", ("table",)), ("tbody", ("table",))],
    "dt": [("dd", ("dl",)), ("dt", ("dl",))],
    "dd": [("dd", ("dl",)), ("dt", ("dl",))],
    "option": [("option", ("select",))],
}


class Node:
    __slots__ = ("tag", "attrs", "kids", "parent")

    def __init__(self, tag, attrs=None, parent=None):
        self.tag, self.attrs, self.kids, self.parent = tag, attrs or {}, [], parent

    def walk(self):
        stack = [self]
        while stack:
            n = stack.pop()
            if isinstance(n, Node):
                yield n
                stack += reversed(n.kids)

    def find(self, *tags):
        return [n for n in self.walk() if n.tag in tags and n is not self]


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#document")

    def handle_starttag(self, tag, attrs):
        if tag in _ENDS_P:
            self._close("p", stop=("td", "th", "button", "li"))
        for open_tag, stop in _IMPLIED.get(tag, ()):
            self._close(open_tag, stop)
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.kids.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and self.at.tag == tag:
            self.at = self.at.parent

    def handle_endtag(self, tag):
        self._close(tag)

    def handle_data(self, data):
        self.at.kids.append(data)

    def _close(self, tag, stop=()):
        n = self.at
        while n.parent is not None and n.tag != tag:
            if n.tag in stop:
                return
            n = n.parent
        if n.parent is not None:
            self.at = n.parent


def parse(html: str) -> Node:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


def clean(text: str | None) -> str:
    text = re.sub(r"[ \t\f\v]+", " ", (text or "").replace("\xa0", " "))
    return re.sub(r" *\n *", "\n", text).strip()


def escape(text: str) -> str:
    text = re.sub(r"\s*\n\s*", " ", re.sub(r"[\t\f\v ]+", " ", text.replace("\xa0", " ")))
    return re.sub(r"([`*_\[\]<>])", r"\\\1", text.replace("\\", "\\\\"))


def _text_of(node: Node) -> str:
    """Text as a reader sees it: blocks on lines of their own, hidden elements left out."""
    out: list[str] = []

    def visit(n):
        if isinstance(n, str):
            out.append(re.sub(r"\s+", " ", n))
        elif n.tag == "br":
            out.append("\n")
        elif n.tag not in ("script", "style", "noscript", "template", "head"):
            block = n.tag in BLOCKS
            out.append("\n" * block)
            for k in n.kids:
                visit(k)
            out.append("\n" * block)

    for k in node.kids:
        visit(k)
    return re.sub(r"\s*\n\s*", "\n", re.sub(r" +", " ", "".join(out))).strip()


def _inside(node: Node | None, *tags: str) -> bool:
    while node is not None:
        if node.tag in tags:
            return True
        node = node.parent
    return False


def candidates(doc: Node, adapter: str) -> list[Node]:
    """Possible article roots in document order, by site adapter."""
    out = []
    for n in doc.walk():
        classes, test = n.attrs.get("class", "").split(), n.attrs.get("data-testid", "")
        in_main = _inside(n.parent, "main")
        if adapter == "x-article":
            fits = in_main and (test in ("twitterArticleReadView", "article-content") or n.tag == "article")
        elif adapter == "recursive":
            fits = "richtext" in classes
        elif adapter == "langchain-blog":
            up = n.parent
            while up is not None and "blog-post-content" not in up.attrs.get("class", "").split():
                up = up.parent
            fits = "w-richtext" in classes and ("text-rich-text-v2-blog-post" in classes or up is not None)
        else:
            fits = n.attrs.get("itemprop") == "articleBody" or n.tag in ("article", "main") or (in_main and n.attrs.get("role") == "article")
        if fits:
            out.append(n)
    return out


#: What parts of a root are worth beside its characters, fixed values.
HEADING_POINTS, IMAGE_POINTS, BODY_POINTS = 500, 250, 120_000
VIEW_POINTS = {"twitterArticleReadView": 100_000, "article-content": 80_000}
TAG_POINTS = {"article": 100_000, "main": 10_000}


def score(node: Node, adapter: str) -> int:
    total = len(_text_of(node)) + HEADING_POINTS * len(node.find("h1", "h2", "h3", "h4", "h5", "h6")) + IMAGE_POINTS * len(node.find("img"))
    if adapter == "x-article":
        return total + VIEW_POINTS.get(node.attrs.get("data-testid", ""), 0)
    total += BODY_POINTS * (node.attrs.get("itemprop") == "articleBody")
    return total + TAG_POINTS.get(node.tag, 0)


def pick_root(doc: Node, adapter: str) -> tuple[Node | None, int]:
    """The candidate of greatest score, the first of equals, refined upwards from its heading to the
    nearest of six ancestors that still holds most of its text and images."""
    found = candidates(doc, adapter)
    if not found:
        mains = doc.find("main")
        return (mains[0], 0) if mains else (None, 0)
    scores = [score(n, adapter) for n in found]
    best = found[scores.index(max(scores))]
    heads = best.find("h1")
    if heads:
        size, images = len(_text_of(best)), len(best.find("img"))
        up = heads[0].parent
        for _ in range(6):
            if up is None:
                break
            if len(_text_of(up)) >= max(1, size * 0.7) and len(up.find("img")) >= max(0, images - 1):
                return up, max(scores)
            up = up.parent
    return best, max(scores)


class Renderer:
    """Markdown of a tree; images become tokens that a later step replaces."""

    def __init__(self, base: str, adapter: str):
        self.base, self.adapter, self.images, self.by_url = base, adapter, [], {}

    def image_url(self, raw: str) -> str:
        try:
            u = urlsplit(urljoin(self.base, raw))
        except ValueError:
            return raw
        if u.hostname == "pbs.twimg.com" and u.path.startswith("/media/"):
            query = [(k, v) for k, v in parse_qsl(u.query, keep_blank_values=True) if k != "name"] + [("name", "orig")]
            return urlunsplit(u._replace(query=urlencode(query)))
        return urlunsplit(u)

    def register(self, raw: str, alt: str, node: Node | None, force: bool) -> str:
        if not raw or raw.startswith(("data:", "blob:")):
            return ""
        url = self.image_url(raw)
        low = url.lower()
        attrs = node.attrs if node is not None else {}
        size = [int(m[0]) if (m := re.match(r"\d+", attrs.get(k, ""))) else 0 for k in ("width", "height")]
        content = "pbs.twimg.com/media/" in low or (size[0] >= 240 and size[1] >= 120) or _inside(node, "figure", "article")
        decoration = "/profile_images/" in low or "/emoji/" in low or "abs.twimg.com" in low
        if not force and (not content or decoration):
            return ""
        if url not in self.by_url:
            self.by_url[url] = "{{KNOWLEDGE_IMAGE_%03d}}" % len(self.images)
            self.images.append((self.by_url[url], url, clean(alt)))
        return self.by_url[url]

    def image(self, node: Node, force: bool = False) -> str:
        return self.register(node.attrs.get("src", ""), node.attrs.get("alt", ""), node, force)

    def skip(self, n: Node) -> bool:
        test = n.attrs.get("data-testid", "").lower()
        return n.tag in SKIPPED or n.attrs.get("aria-hidden") == "true" or n.attrs.get("role") == "button" or any(c in test for c in CONTROLS)

    def inline(self, n, without: tuple[str, ...] = ()) -> str:
        if isinstance(n, str):
            return escape(n)
        if self.skip(n):
            return ""
        if n.tag == "br":
            return "\n"
        if n.tag == "img":
            token = self.image(n)
            return f"\n\n{token}\n\n" if token else ""
        text = "".join(self.inline(k) for k in n.kids if not (isinstance(k, Node) and k.tag in without))
        if not clean(text):
            return ""
        marks = {"strong": "**", "b": "**", "em": "*", "i": "*", "s": "~~", "del": "~~"}
        if n.tag == "a":
            return f"[{text}]({urljoin(self.base, n.attrs['href'])})" if n.attrs.get("href") else text
        if n.tag == "code":
            return "`" + text.replace("`", "\\`") + "`"
        mark = marks.get(n.tag, "")
        return mark + text + mark

    def container(self, n: Node) -> str:
        parts, run = [], ""
        for k in n.kids:
            if isinstance(k, Node) and k.tag in BLOCKS:
                parts += [clean(run), self.block(k)]
                run = ""
            else:
                run += self.inline(k)
        return "\n\n".join(p for p in [*parts, clean(run)] if p)

    def listing(self, n: Node, depth: int) -> str:
        first = re.match(r"\s*([+-]?\d+)", n.attrs.get("start", "")) if n.tag == "ol" else None
        lines = []
        for i, item in enumerate(k for k in n.kids if isinstance(k, Node) and k.tag == "li"):
            mark = f"{(int(first[1]) if first else 1) + i}." if n.tag == "ol" else "-"
            lines.append("  " * depth + f"{mark} {clean(self.inline(item, without=('ul', 'ol')))}")
            lines += filter(None, (self.listing(k, depth + 1) for k in item.kids if isinstance(k, Node) and k.tag in ("ul", "ol")))
        return "\n".join(lines)

    def table(self, n: Node) -> str:
        rows = [[clean(self.inline(c)).replace("|", "\\|") for c in r.kids if isinstance(c, Node) and c.tag in ("td", "th")] for r in n.find("tr")]
        rows = [r for r in rows if r]
        if not rows:
            return ""
        width = max(map(len, rows))
        rows = [r + [""] * (width - len(r)) for r in rows]
        if not n.find("th"):
            rows.insert(0, [""] * width)
        return "\n".join("| " + " | ".join(r) + " |" for r in [rows[0], ["---"] * width, *rows[1:]])

    def block(self, n: Node) -> str:
        if self.skip(n):
            return ""
        if _HEADING.fullmatch(n.tag):
            text = clean(self.inline(n))
            while len(text) >= 4 and text[:2] == text[-2:] and text[:2] in ("**", "__"):
                text = text[2:-2].strip()
            return "#" * int(n.tag[1]) + " " + text
        if n.tag == "p":
            return clean(self.inline(n))
        if n.tag == "pre":
            codes = n.find("code")
            language = re.search(r"language-([\w-]+)", codes[0].attrs.get("class", "")) if codes else None
            body = "".join(k for m in n.walk() for k in m.kids if isinstance(k, str)) if not codes else "".join(_raw(n))
            return f"```{language[1] if language else ''}\n{body.rstrip(chr(10))}\n```"
        if n.tag == "blockquote":
            return "\n".join(f"> {line}".rstrip() for line in self.container(n).split("\n"))
        if n.tag in ("ul", "ol"):
            return self.listing(n, 0)
        if n.tag == "figure":
            parts = [self.image(i, True) for i in n.find("img")]
            captions = n.find("figcaption")
            text = clean(self.inline(captions[0])) if captions else ""
            return "\n\n".join(dict.fromkeys(p for p in [*parts, f"*{text}*" if text else ""] if p))
        if n.tag == "hr":
            return "---"
        if n.tag == "table":
            return self.table(n)
        return self.container(n)


def _raw(n: Node):
    for k in n.kids:
        if isinstance(k, str):
            yield k
        elif k.tag == "br":
            yield "\n"
        else:
            yield from _raw(k)


def _structured(doc: Node) -> dict:
    """The first article among the page's JSON-LD items."""
    for script in doc.find("script"):
        if script.attrs.get("type") != "application/ld+json":
            continue
        try:
            data = json.loads("".join(_raw(script)) or "null")
        except ValueError:
            continue
        items = data if isinstance(data, list) else data["@graph"] if isinstance(data, dict) and isinstance(data.get("@graph"), list) else [data]
        for item in items:
            kinds = item.get("@type") if isinstance(item, dict) else None
            if {"Article", "BlogPosting", "NewsArticle"} & set(kinds if isinstance(kinds, list) else [kinds]):
                return item
    return {}


def article(html: str | None, url: str | None, adapter: str) -> tuple | None:
    """The article of a page, or None where no container is found."""
    if not html:
        return None
    doc = parse(html)
    root, points = pick_root(doc, adapter)
    if root is None:
        return None
    meta: dict[str, str] = {}
    for m in doc.find("meta"):
        for key in ("property", "name"):
            if key in m.attrs:
                meta.setdefault(f"{key}:{m.attrs[key]}", m.attrs.get("content", ""))
    item = _structured(doc)
    by = item.get("author")
    people = by if isinstance(by, list) else [by]
    author = ", ".join(filter(None, (p if isinstance(p, str) else (p or {}).get("name") for p in people)))
    heads, titles = root.find("h1"), doc.find("title")
    first = lambda *values: next((v for v in map(clean, values) if v), "")
    page_title = re.sub(r"\s*/\s*X\s*$", "", _text_of(titles[0])) if titles else ""
    title = first(_text_of(heads[0]) if heads else "", item.get("headline"), meta.get("property:og:title"), page_title)
    handle = next((t for a in root.find("a") if a.attrs.get("href", "").startswith("/") and (t := _text_of(a)).startswith("@")), "")
    author = first(meta.get("name:twitter:creator"), author, meta.get("property:article:author"), meta.get("name:author"), handle)
    around = root
    while around.parent is not None and around.tag != "article":
        around = around.parent
    times = [t.attrs["datetime"] for scope in (root, around if around.tag == "article" else None) if scope for t in scope.find("time") if t.attrs.get("datetime")]
    published = (times or [""])[0] or meta.get("property:article:published_time") or item.get("datePublished")
    description = first(meta.get("name:description"), meta.get("property:og:description"), item.get("description"))

    r = Renderer(url or "", adapter)
    text = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", r.block(root))).strip()
    cover = meta.get("property:og:image") or meta.get("name:twitter:image")
    generic = adapter != "x-article"
    if cover and (generic or "pbs.twimg.com/media/" in cover):
        token = r.register(cover, title, None, True)
        if token and token not in text:
            text = f"{token}\n\n{text}"
    if title and not re.search(r"^#\s+", text, re.M):
        text = f"# {escape(title)}\n\n{text}"
    if generic and description and description not in clean(text):
        head, line, rest = text.partition("\n")
        text = f"{head}\n\n{escape(description)}\n\n{rest.lstrip()}" if line and text.startswith("# ") else f"{escape(description)}\n\n{text}"
    return title or None, author or None, published or None, description or None, text.strip(), len(clean(_text_of(root))), root.tag, points, r.images


@arrow_udf(ARTICLE)
def extract(html: pd.Series, url: pd.Series, adapter: pd.Series) -> pd.DataFrame:
    names = ["title", "author", "published", "description", "markdown", "characters", "root_tag", "root_score", "images"]
    rows = [article(h, u, a) or (None,) * 9 for h, u, a in zip(html, url, adapter)]
    return pd.DataFrame([(*r[:8], None if r[8] is None else [dict(zip(("token", "url", "alt"), i)) for i in r[8]]) for r in rows], columns=names)


def ended_references(html: Column) -> Column:
    """html in which only references with their semicolon are references, as strict writers mean them.

    Browsers, and ``extract``, read a bare &amp as a reference too; text that was escaped and then cut
    may end in one. Raw text such as scripts' is changed like any other, so this is for pages without.
    """
    return F.regexp_replace(html, r"&(?!(?:[A-Za-z][A-Za-z0-9]*|#[0-9]+|#[xX][0-9A-Fa-f]+);)", "&amp;")


def is_challenge(page_text: Column, characters: Column, least: int = 200) -> Column:
    """A page that is a challenge and not an article: too short, with one of the phrases."""
    found = F.lit(False)
    for pattern in CHALLENGES:
        found = found | page_text.rlike(pattern)
    return found & (characters < least)


def card_score(text: Column, headings: Column, href: Column) -> Column:
    """How likely a card leads to the article: length to 300, heading, article or status link; less
    for handles and short texts. Only positive scores count."""
    size = F.length(F.trim(text))
    article_link = F.when(href.contains("/i/article/"), 700).otherwise(0) + F.when(href.rlike(r"/status/\d+"), 250).otherwise(0)
    return F.least(size, F.lit(300)) + F.when(headings > 0, 600).otherwise(0) + article_link - F.when(F.trim(text).startswith("@") | (size < 20), 800).otherwise(0)
