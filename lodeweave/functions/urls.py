"""URL functions as column expressions: parts, categories, features, crawl and freshness rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Categories in order of precedence, and the words that show them.
CATEGORIES = {
    "studium": ["studium", "bachelor", "master", "study", "studies", "programme"],
    "bewerbung": ["bewerbung", "application", "admission", "zulassung"],
    "fakultaet": ["fakultaet", "faculty", "dekanat", "departments", "department"],
    "forschung": ["forschung", "research", "publikationen", "publications"],
    "services": ["services", "it-services", "support", "beratung"],
    "international": ["international", "ausland", "exchange", "abroad"],
    "pruefungen": ["pruefung", "exam", "klausur", "thesis"],
    "pruefungsordnungen": ["pruefungsordnung", "po-", "po_", "modulhandbuch"],
    "kontakt": ["kontakt", "contact", "ansprechpartner"],
}
NO_CATEGORY = "allgemein"
# Study programmes, document types and degrees by the words in a PDF's address.
PROGRAMMES = {"bwl": "Betriebswirtschaftslehre", "vwl": "Volkswirtschaftslehre", "winfo": "Wirtschaftsinformatik", "sowi": "Sozialwissenschaften", "gesundheitsoekonomie": "Gesundheitsökonomie", "wirtschaftspaedagogik": "Wirtschaftspädagogik"}
DOCUMENT_TYPES = {"Prüfungsordnung": ["pruefungsordnung", "po-", "po_"], "Modulhandbuch": ["modulhandbuch"], "Studienordnung": ["studienordnung"], "Verlaufsplan": ["verlaufsplan"]}
DEGREES = {"Bachelor": ["bachelor"], "Master": ["master"]}
# What a crawl leaves out.
EXCLUDED = [r"\.(jpg|jpeg|png|gif|css|js|ico|xml)$", r"(calendar|print|rss|feed)", r"/(de|en)/api/"]
# Days until a cached page is stale, by address, then by category; the re-fetch rules with their priorities; base scores.
CACHE_AGE = {1: ["/news/", "/aktuelles/", "/event/", "/veranstaltung"], 90: ["pruefungsordnung", "/po-", "/po_", "modulhandbuch"]}
CATEGORY_AGE = {"news": 1, "events": 1, "pruefungsordnungen": 90, "modulhandbuch": 90, "faculty": 30, "research": 30, "contact": 90, "static": 30, "default": 7}
DEFAULT_AGE = 7
REFETCH = [(["/news/", "/aktuelles/"], 1, "high"), (["/event/", "/veranstaltung"], 1, "high"), (["pruefungsordnung", "/po-"], 90, "low"), (["modulhandbuch"], 90, "low"), (["/kontakt", "/contact"], 90, "low"), (["/forschung", "/research"], 30, "medium")]
REFETCH_ELSE = (30, "medium")
SCORES = [(["/news/", "/aktuelles/"], 90), (["/event/", "/veranstaltung"], 85), (["/bewerbung", "/application", "/admission"], 80), (["/studium", "/studies"], 70), (["/pruefung", "/exam"], 70), (["/forschung", "/research"], 60), (["/fakultaet", "/faculty"], 55), (["/kontakt", "/contact"], 40), (["pruefungsordnung"], 30)]
BASE_SCORE = 50


def any_of(text: Column, keys: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(k) for k in keys])


def first_match(text: Column, rules: list[tuple[list[str], object]], otherwise: object = None) -> Column:
    """The value of the first rule one of whose words occurs in the text."""
    out = None
    for keys, value in rules:
        hit = any_of(text, keys)
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return out.otherwise(F.lit(otherwise))


def category(url: Column) -> Column:
    return first_match(F.lower(url), [(keys, name) for name, keys in CATEGORIES.items()], NO_CATEGORY)


def pdf_category(url: Column, document_type: Column) -> Column:
    return F.when(url.contains("pruefungsordnung") | document_type.isNotNull(), F.lit("pruefungsordnungen")).otherwise(category(url))


def language(url: Column) -> Column:
    return F.when(url.contains("/de"), F.lit("de")).when(url.contains("/en"), F.lit("en")).otherwise(F.lit("unknown"))


_AFTER_SCHEME = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?"


def netloc(url: Column) -> Column:
    """What stands between // and the next / ? or #, with user and port."""
    return F.regexp_extract(url, _AFTER_SCHEME + r"//([^/?#]*)", 1)


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def path(url: Column) -> Column:
    """Path without parameters behind a semicolon in its last part."""
    raw = F.regexp_extract(url, _AFTER_SCHEME + r"(?://[^/?#]*)?([^?#]*)", 1)
    return F.regexp_replace(raw, r";[^/]*$", "")


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def path_parts(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda p: p != "")


def url_path(url: Column) -> Column:
    return F.array_join(path_parts(url), "/")


def url_depth(url: Column) -> Column:
    return F.size(path_parts(url))


def normalised(url: Column) -> Column:
    """scheme://netloc/path?query, without parameters and fragment."""
    q = query(url)
    return F.concat(scheme(url), F.lit("://"), netloc(url), path(url), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")))


def is_pdf(url: Column) -> Column:
    return F.lower(url).endswith(".pdf")


def is_allowed(url: Column, domains: list[str], robots: Column | None = None) -> Column:
    """In an allowed domain, not excluded by pattern nor by robots rules."""
    ok = netloc(url).isin(domains)
    for pattern in EXCLUDED:
        ok = ok & ~F.lower(url).rlike(pattern)
    return ok if robots is None else ok & robots


def link_kind(url: Column, domains: list[str]) -> Column:
    """pdf, page or null for a link that isn't followed; PDFs need only be in an allowed domain."""
    return F.when(is_pdf(url), F.when(netloc(url).isin(domains), F.lit("pdf"))).when(is_allowed(url, domains), F.lit("page"))


def filename(url: Column) -> Column:
    return F.element_at(F.split(path(url), "/"), -1)


def pdf_filename(url: Column) -> Column:
    """The last path part without .pdf, and the start of the address's md5."""
    return F.concat(F.replace(filename(url), F.lit(".pdf"), F.lit("")), F.lit("_"), F.left(F.md5(url), F.lit(12)), F.lit(".pdf"))


def study_programme(url: Column) -> Column:
    return first_match(F.lower(url), [([k], v) for k, v in PROGRAMMES.items()])


def document_type(url: Column) -> Column:
    return first_match(F.lower(url), [(keys, v) for v, keys in DOCUMENT_TYPES.items()])


def degree(url: Column) -> Column:
    return first_match(F.lower(url), [(keys, v) for v, keys in DEGREES.items()])


def source_label(url: Column, own: str, label: str) -> Column:
    """`label` for hosts that hold `own`; others are named as external."""
    host = netloc(url)
    return F.when(host.contains(own), F.lit(label)).otherwise(F.concat(F.lit("Externe Quelle: "), host))


def document_id(url: Column, index: Column) -> Column:
    return F.left(F.sha2(F.concat(url, F.lit("#"), index.cast("string")), 256), F.lit(16))


def max_age_days(url: Column, category: Column) -> Column:
    """Days a cached page stays fresh: by address first, then by category."""
    by_category = F.lit(DEFAULT_AGE)
    for name, days in CATEGORY_AGE.items():
        by_category = F.when(F.lower(category) == name, F.lit(days)).otherwise(by_category)
    out = by_category
    for days, keys in reversed(CACHE_AGE.items()):
        out = F.when(any_of(F.lower(url), keys), F.lit(days)).otherwise(out)
    return out


def refetch_days(url: Column) -> Column:
    return first_match(F.lower(url), [(k, d) for k, d, _ in REFETCH], REFETCH_ELSE[0])


def refetch_priority(url: Column) -> Column:
    return first_match(F.lower(url), [(k, p) for k, _, p in REFETCH], REFETCH_ELSE[1])


def base_score(url: Column) -> Column:
    return first_match(F.lower(url), SCORES, BASE_SCORE)
