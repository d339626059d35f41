"""HTML functions: a small element tree from the standard parser, and what is read from it, as Arrow UDFs.

The tree follows tags as they are written: nothing closes a paragraph but its end tag or
the end of what holds it, so unclosed elements nest.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlparse

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements without content; selectors that extraction and cleaning remove, and where main content is sought.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "keygen", "link", "menuitem", "meta", "param", "source", "track", "wbr"}
EXTRACT_EXCLUDED = ["script", "style", "nav", "footer", "header", ".advertisement", ".ads", ".sidebar"]
CLEAN_REMOVED = ["nav", "footer", "header", ".navigation", ".nav", ".menu", ".cookie-banner", ".cookie-notice", ".cookie-consent", ".breadcrumb", ".breadcrumbs", ".sidebar", ".aside", ".advertisement", ".ads", ".ad", ".social-media", ".social-links", ".share-buttons", ".sharing", "script", "style", "noscript"]
CONTENT = ["article", "main", ".content", ".post", "p"]
TITLE = ["title", "h1"]

LINK = "struct<url:string,text:string>"
IMAGE = "struct<url:string,alt:string,title:string>"
FIELDS = {"title": "string", "content": "string", "domain": "string", "word_count": "int", "links": f"array<{LINK}>", "images": f"array<{IMAGE}>", "description": "string", "keywords": "array<string>"}
PAGE = ", ".join(f"{name} {kind}" for name, kind in FIELDS.items())
#: Characters of pages whose fields are held at a time, if one page has no more.
TOGETHER = 1 << 22



class Node:
    __slots__ = ("tag", "attrs", "parts", "parent")

    def __init__(self, tag: str, attrs: dict[str, str | None], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.parts: list[Node | str] = []

    def walk(self):
        """All elements below, in document order."""
        stack = [p for p in reversed(self.parts) if isinstance(p, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack += [p for p in reversed(node.parts) if isinstance(p, Node)]

    def strings(self):
        stack: list[Node | str] = list(reversed(self.parts))
        while stack:
            part = stack.pop()
            if isinstance(part, str):
                yield part
            else:
                stack += reversed(part.parts)

    def text(self, separator: str = "", strip: bool = False) -> str:
        found = (s.strip() for s in self.strings()) if strip else self.strings()
        return separator.join(s for s in found if s or not strip)

    def is_a(self, selector: str) -> bool:
        if selector.startswith("."):
            return selector[1:] in (self.attrs.get("class") or "").split()
        return self.tag == selector

    def any_of(self, selectors: list[str]) -> bool:
        return any(self.is_a(s) for s in selectors)

    def without(self, selectors: list[str]) -> Node:
        """Remove every matching element, with what it holds."""
        stack = [self]
        while stack:
            node = stack.pop()
            node.parts = [p for p in node.parts if isinstance(p, str) or not p.any_of(selectors)]
            stack += [p for p in node.parts if isinstance(p, Node)]
        return self


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, dict(reversed(attrs)), self.at)
        self.at.parts.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.at = self.at.parent

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.parts.append(data)


def parse(html: str | None) -> Node:
    """The tree of a page; comments and declarations are left out."""
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def joined(base: str | None, link: str) -> str:
    try:
        return urljoin(base or "", link)
    except ValueError:
        return link


def extract(url: str | None, html: str | None, fields: list[str] | None = None) -> dict:
    """Title, content and metadata of a page, or some fields of these; nested matches repeat their text."""
    root = parse(html).without(EXTRACT_EXCLUDED)
    nodes = list(root.walk())
    meta = {}
    for n in nodes:
        if n.tag == "meta" and n.attrs.get("name") in ("description", "keywords") and n.attrs.get("content") is not None:
            meta.setdefault(n.attrs["name"], n.attrs["content"])

    def domain() -> str:
        try:
            return urlparse(url or "").netloc
        except ValueError:
            return ""

    made = {
        "title": lambda: next((n.text(strip=True) for n in nodes if n.any_of(TITLE)), ""),
        "content": lambda: "\n\n".join(t for t in (n.text(strip=True) for n in nodes if n.any_of(CONTENT)) if t),
        "domain": domain,
        "word_count": lambda: len(root.text().split()),
        "links": lambda: [{"url": joined(url, n.attrs["href"] or ""), "text": n.text(strip=True)} for n in nodes if n.tag == "a" and "href" in n.attrs],
        "images": lambda: [{"url": joined(url, n.attrs["src"] or ""), "alt": n.attrs.get("alt") or "", "title": n.attrs.get("title") or ""} for n in nodes if n.tag == "img" and "src" in n.attrs],
        "description": lambda: meta.get("description"),
        "keywords": lambda: meta["keywords"].split(",") if "keywords" in meta else None,
    }
    return {name: made[name]() for name in fields or FIELDS}


def main_content(root: Node) -> str:
    """Text of the first main, article or main-role element in this order of preference, else of the body, else of all."""
    nodes = list(root.walk())
    for wanted in (lambda n: n.tag == "main", lambda n: n.tag == "article", lambda n: n.attrs.get("role") == "main", lambda n: n.tag == "body"):
        for node in nodes:
            if wanted(node):
                return node.text("\n").strip()
    return root.text("\n").strip()


def cleaned(html: str | None) -> str:
    """Main content without navigation, adverts and the like, before clean_text."""
    return main_content(parse(html).without(CLEAN_REMOVED))


def crawl_links(url: str | None, html: str | None) -> list[str]:
    """Absolute links without parameters and fragment, each once, in order."""
    found: dict[str, None] = {}
    for node in parse(html).walk():
        if node.tag == "a" and node.attrs.get("href") is not None:
            try:
                u = urlparse(urljoin(url or "", node.attrs["href"]))
            except ValueError:
                continue
            found[f"{u.scheme}://{u.netloc}{u.path}" + (f"?{u.query}" if u.query else "")] = None
    return list(found)


def visible_text(html: str | None) -> str:
    """All text but that of scripts and styles."""
    return re.sub("\r\n?", "\n", parse(html).without(["script", "style"]).text())


def runs(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs [lo, hi) of rows with no more than `most` in all, or of one row."""
    lo = held = 0
    for i, n in enumerate(sizes):
        if i > lo and held + n > most:
            yield lo, i
            lo, held = i, 0
        held += n
    if lo < len(sizes):
        yield lo, len(sizes)


def extracted(batches: Iterator[tuple[pd.Series, pd.Series]], names: list[str]) -> Iterator[pd.DataFrame]:
    """Some fields of batches of (urls, pages), a few pages at a time."""
    for urls, pages in batches:
        for lo, hi in runs([len(h or "") for h in pages], TOGETHER):
            yield pd.DataFrame([extract(u, h, names) for u, h in zip(urls[lo:hi], pages[lo:hi], strict=True)], columns=names)


def extract_udf(url: Column | str, html: Column | str, fields: list[str] | None = None) -> Column:
    """extract() as a column of type PAGE, or of some of its fields."""
    names = fields or list(FIELDS)

    @F.pandas_udf(", ".join(f"{name} {FIELDS[name]}" for name in names))
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        yield from extracted(batches, names)

    return run(url, html)


def _mapped(f, kind: str, *columns: Column | str) -> Column:
    @F.pandas_udf(kind)
    def run(*series: pd.Series) -> pd.Series:
        return pd.Series([f(*row) for row in zip(*series, strict=True)], dtype=object)

    return run(*columns)


def cleaned_udf(html: Column | str) -> Column:
    return _mapped(cleaned, "string", html)


def crawl_links_udf(url: Column | str, html: Column | str) -> Column:
    return _mapped(crawl_links, "array<string>", url, html)


def visible_text_udf(html: Column | str) -> Column:
    return _mapped(visible_text, "string", html)


def urljoin_udf(base: Column | str, link: Column | str) -> Column:
    return _mapped(lambda b, x: None if x is None else joined(b, x), "string", base, link)
