"""Main text of web pages: suffix arrays over a host's token streams, and the pages' own structure.

The pages of a host, at most a bounded number at a time, become one stream of tokens: tags
with their classes, and pieces of text. A suffix array, sorted by as many tokens as a run
must have to count, shows the runs that distinct pages share. The parts of a larger host
also exchange the 64-bit hashes of their runs, once for each part, so that a run which two
pages of different parts hold is shared like any other. In pages that mark no
article or main part, covered runs are boilerplate and the unique runs are kept (a page
that is covered as a whole is a copy and keeps its text). Repetition can't tell a copied
article from a menu, nor see a menu that stands on one page only, so structure is heard as
well: text inside an article or main part stays although it is repeated, text of other
parts of such a page goes, and menus, headers, footers, side bars, notices, adverts, forms,
scripts, styles and reader comments go everywhere; their words are no part of the stream,
so that a menu with other words is still the same template.

Defined results: a null or empty html has an empty text; a null or unreadable url has the
empty host; unclosed elements end with what holds them, and an unclosed comment, script or
style with the page; repeated rows each return a row; an empty table gives an empty
result; other columns are left behind.
"""

from __future__ import annotations

import hashlib
import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.llm import text

#: Tokens that a repeated run has at least.
LEAST = 8
#: Pages of one host that meet in one group, about.
GROUP_PAGES = 256
#: Hosts whose page counts are sent to all executors at most; any other host has fewer than one in as many of all pages.
COUNTED_HOSTS = 1 << 16

# Element names.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
DROPPED = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "textarea", "script", "style", "noscript", "template", "iframe", "object", "svg", "canvas", "head", "title"}
MAIN = {"article", "main"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul"}
SPACED = {"br", "td", "th"}
_CELLS, _PARTS = {"td", "th"}, {"tbody", "thead", "tfoot"}
# Which open elements a start tag ends where their end tags are left out, and the elements that it doesn't look beyond.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": (_CELLS, {"tr", "table"}), "th": (_CELLS, {"tr", "table"}), "tr": ({"tr", *_CELLS}, {"table", *_PARTS}),
    **{part: ({"tr", *_PARTS, *_CELLS}, {"table"}) for part in _PARTS}, "option": ({"option"}, {"select", "datalist", "optgroup"}), "optgroup": ({"option", "optgroup"}, {"select"}),
}
# Elements whose start ends a paragraph.
P_ENDS = {"address", "article", "aside", "blockquote", "details", "dialog", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
_P_SCOPE = ({"p"}, {"button", "caption", "table", "object", "template", *_CELLS})
CONTAINERS = {"div", "section", "article", "main", "ul", "ol", "dl", "table", "tr", "caption", *_CELLS, *_PARTS}
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe")
#: Words in class, id and role that mark what isn't the article.
MARKS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary", "contentinfo", "cookie", "cookies", "consent", "disqus", "footer", "form", "header", "masthead", "menu", "nav", "navbar", "navigation", "newsletter", "notice", "popup", "promo", "promoted", "respond", "search", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar"}

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{'|'.join(RAW)})\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-zA-Z][^>]*>|<[!?/][^>]*>",
    re.S | re.I,
)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
_MAIN_ROLE = re.compile(r"\brole\s*=\s*[\"']?main\b", re.I)

CHROME, OTHER, ARTICLE = 0, 1, 2


def _marked(attrs: str) -> bool:
    for groups in _NAMED.findall(attrs):
        if not MARKS.isdisjoint(_WORD.findall("".join(groups).lower())):
            return True
    return False


def _endings(tag: str) -> list[tuple[set[str], set[str]]]:
    """What a start tag ends, and what it doesn't look beyond."""
    return [*([IMPLIED[tag]] if tag in IMPLIED else []), *([_P_SCOPE] if tag in P_ENDS else [])]


def page_tokens(page: str) -> tuple[list[str], list[tuple[int, str, int, int]]]:
    """A page's token stream, and its pieces of text as (place in the stream, text, zone, block number)."""
    stream: list[str] = []
    pieces: list[tuple[int, str, int, int]] = []
    open_: list[tuple[str, int]] = []  # containers, and everything inside what is dropped
    zone, block, at = OTHER, 0, 0

    def add(raw: str) -> None:
        words = entities.unescape(raw)
        if words and not words.isspace():
            stream.append("#" if zone == CHROME else "#" + " ".join(words.split()))
            pieces.append((len(stream) - 1, words, zone, block))
        elif words and pieces:
            pieces.append((len(stream) - 1, " ", zone, block))

    for m in _MARKUP.finditer(page):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            stream.append("<" + (m["raw"] or "!").lower())
            continue
        tag = tag.lower()
        if m["end"]:
            stream.append("/" + tag)
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] == tag:
                    zone = open_[k][1]
                    del open_[k:]
                    break
            block += tag in BLOCKS
            continue
        attrs = m["attrs"]
        marked = len(attrs) > 3 and _marked(attrs)
        stream.append(tag + "*" if marked else tag)
        for ended, beyond in _endings(tag) if open_ else ():
            cut = None
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] in beyond:
                    break
                if open_[k][0] in ended:
                    cut = k
            if cut is not None:
                zone = open_[cut][1]
                del open_[cut:]
        if tag in BLOCKS:
            block += 1
        elif tag in SPACED and pieces:
            pieces.append((len(stream) - 1, " ", zone, block))
        if tag in VOID or attrs.endswith("/"):
            continue
        dropped = marked or tag in DROPPED
        if dropped or zone == CHROME or tag in CONTAINERS:
            open_.append((tag, zone))
        if dropped:
            zone = CHROME
        elif zone == OTHER and (tag in MAIN or attrs and _MAIN_ROLE.search(attrs)):
            if open_ and open_[-1][0] != tag:
                open_.append((tag, zone))
            zone = ARTICLE
    if at < len(page):
        add(page[at:])
    return stream, pieces


def shared_runs(streams: list[list[str]], least: int = LEAST) -> np.ndarray:
    """Whether a run of `least` tokens that another page has too starts at each place of the joined pages, with one place behind each page."""
    ids: dict[str, int] = {}
    total = sum(len(s) for s in streams) + len(streams)
    token, page, k = np.zeros(total, np.int64), np.zeros(total, np.int64), 0
    for i, s in enumerate(streams):
        token[k : k + len(s)] = [ids.setdefault(t, len(ids)) for t in s]
        page[k : k + len(s) + 1] = i
        token[k + len(s)] = -1 - i  # ends a page, unlike any other token
        k += len(s) + 1
    rank = np.unique(token, return_inverse=True)[1].astype(np.int64)
    order, reach = np.argsort(rank, kind="stable"), 1
    while reach < least:  # suffixes in order of twice as many tokens, up to `least`
        step = min(reach, least - reach)
        later = np.zeros(total, np.int64)
        later[: total - step] = rank[step:] + 1
        key = rank * (total + 2) + later
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
        rank[order] = np.cumsum(np.concatenate([[0], sorted_[1:] != sorted_[:-1]]))
        reach += step
    by_rank = page[order]
    first = np.flatnonzero(np.concatenate([[True], rank[order][1:] != rank[order][:-1]]))
    return (np.maximum.reduceat(by_rank, first) != np.minimum.reduceat(by_rank, first))[rank] if total else np.zeros(0, bool)


def run_hashes(streams: list[list[str]], least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """The hash of the run of `least` tokens at each place of the joined pages, and whether the page holds all of that run."""
    ids: dict[str, int] = {}
    total = sum(len(s) for s in streams) + len(streams)
    token, left, k = np.zeros(total, np.int64), np.zeros(total, np.int64), 0
    for s in streams:
        token[k : k + len(s)] = [ids.setdefault(t, len(ids)) for t in s]
        left[k : k + len(s) + 1] = np.arange(len(s), -1, -1)
        k += len(s) + 1
    names = b"".join(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest() for t in ids) or bytes(8)
    hashes = np.zeros(total, np.int64)
    found = text.sequences(np.frombuffer(names, "<u8").astype(np.uint64)[token], least).astype(np.int64)
    hashes[: len(found)] = found
    return hashes, left >= least


def repeated_runs(streams: list[list[str]], least: int = LEAST, elsewhere: np.ndarray | None = None) -> list[np.ndarray]:
    """Which tokens of each page lie in a run of `least` tokens that another page has too, or whose hash is among `elsewhere`."""
    sizes = [len(s) for s in streams]
    total = sum(sizes) + len(streams)
    shared = shared_runs(streams, least)
    if elsewhere is not None and len(elsewhere):
        hashes, whole = run_hashes(streams, least)
        shared = shared | (whole & np.isin(hashes, elsewhere))
    edge = np.zeros(total + least + 1, np.int64)
    edge[:total] += shared
    edge[least : least + total] -= shared
    covered = np.cumsum(edge[:total]) > 0
    starts = np.cumsum([0, *(n + 1 for n in sizes)])
    return [covered[a : a + n] for a, n in zip(starts[:-1].tolist(), sizes, strict=True)]


def main_text(pieces: list[tuple[int, str, int, int]], covered: np.ndarray) -> str:
    """The kept pieces, white space as one space, a line for each block."""
    kept = [p for p in pieces if p[2] == ARTICLE]
    if not any(not p[1].isspace() for p in kept):
        kept = [p for p in pieces if p[2] == OTHER and not covered[p[0]]]
        if not any(not p[1].isspace() for p in kept):
            kept = [p for p in pieces if p[2] == OTHER]
    lines: list[str] = []
    held, block = [], None
    for _, words, _, b in [*kept, (0, "", 0, -1)]:
        if b != block:
            if line := " ".join("".join(held).split()):
                lines.append(line)
            held, block = [], b
        held.append(words)
    return "\n".join(lines)


def extract(pages: DataFrame, least: int = LEAST, group_pages: int = GROUP_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars, n_tokens, n_repeated) of every page."""
    spark = pages.sparkSession
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.coalesce(F.regexp_extract("url", "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")).alias("host"))
    counts = pages.groupBy("host").agg(F.count("*").alias("n"))
    floor = max(group_pages, pages.count() // COUNTED_HOSTS)
    # At most COUNTED_HOSTS rows, since each stands for more than that share of all pages.
    large, base = [], 0
    for r in counts.where(F.col("n") > floor).orderBy("host").collect():
        large.append((r.host, base, -(-r.n // group_pages)))
        base += large[-1][2]
    # The parts of large hosts are numbered through, from `base` on for each host; any other host is a group by its name.
    parts = spark.createDataFrame(large, "_host string, base long, parts long")
    dealt = pages.join(F.broadcast(parts), F.col("host") == F.col("_host"), "left")
    dealt = dealt.withColumn("part", F.coalesce(F.col("base") + F.pmod(F.xxhash64("page_id", "url"), F.col("parts")), F.lit(-1).cast("long")))
    dealt = dealt.select("page_id", "url", "html", "base", F.when(F.col("part") < 0, F.col("host")).otherwise("").alias("host"), "part")

    def read(table: pa.Table) -> tuple[list, list]:
        streams, pieces = [], []
        for page in table.column("html"):
            s, p = page_tokens(page.as_py() or "")
            streams.append(s)
            pieces.append(p)
        return streams, pieces

    def result(table: pa.Table, elsewhere: np.ndarray | None = None) -> pa.Table:
        streams, pieces = read(table)
        covered = repeated_runs(streams, least, elsewhere)
        texts = [main_text(p, c) for p, c in zip(pieces, covered, strict=True)]
        return pa.table(
            {
                "page_id": table.column("page_id"), "url": table.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64()),
                "n_tokens": pa.array([len(s) for s in streams], pa.int64()), "n_repeated": pa.array([int(c.sum()) for c in covered], pa.int64()),
            }
        )

    def held(table: pa.Table) -> pa.Table:
        """The hashes of a part's runs, each once; those that several of its pages share, which need no answer, with -1 - part."""
        part = table.column("part")[0].as_py() if table.num_rows else -1
        if part < 0:
            return pa.table({"hash": pa.array([], pa.int64()), "base": pa.array([], pa.int64()), "part": pa.array([], pa.int64())})
        streams, _ = read(table)
        shared, (hashes, whole) = shared_runs(streams, least), run_hashes(streams, least)
        many, once = np.unique(hashes[shared]), np.unique(hashes[whole & ~shared])
        places = np.repeat(np.array([-1 - part, part], np.int64), [len(many), len(once)])
        return pa.table({"hash": np.concatenate([many, once]), "base": np.full(len(places), table.column("base")[0].as_py(), np.int64), "part": places})

    def joined(table: pa.Table, asked: pa.Table) -> pa.Table:
        return result(table, asked.column("hash").to_numpy())

    kind = "page_id long, url string, text string, n_chars long, n_tokens long, n_repeated long"
    grouped = dealt.groupBy("host", "part")
    if not large:
        return grouped.applyInArrow(lambda table: result(table), kind)
    runs = grouped.applyInArrow(held, "hash long, base long, part long")
    # A part names a run once, so a run's rows are at most the parts of its host.
    asked = runs.withColumn("n", F.count("*").over(Window.partitionBy("base", "hash"))).where("n > 1 AND part >= 0").select("hash", F.lit("").alias("host"), "part")
    return grouped.cogroup(asked.groupBy("host", "part")).applyInArrow(joined, kind)
