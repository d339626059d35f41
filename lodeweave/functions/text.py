"""Text functions as column expressions: white space, words, hashes, cleaning, measures and snippets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What Python's str.isspace calls white space, as a class of Java and RE2 patterns.
WS = r"[\t-\r\x1c-\x20\x85\p{Z}]"
_IN = WS[1:-1]

# Boilerplate patterns, deleted in this order whatever the case.
BOILERPLATE = [
    r"Cookie[s]?[\s-]*(Richtlinie|Policy|Hinweis|Notice)",
    r"Datenschutz[\s-]*(erklärung|hinweis|bestimmungen)?",
    r"Impressum",
    r"©\s*\d{4}.*Universität",
    r"Alle Rechte vorbehalten",
    r"Diese Seite verwendet Cookies",
    r"Um unsere Webseite.*zu verbessern",
    r"Kontakt\s*\|\s*Impressum\s*\|\s*Datenschutz",
]
# Topics and the words that show them.
TOPICS = {
    "bewerbung": ["bewerbung", "application", "fristen", "deadline"],
    "pruefung": ["prüfung", "klausur", "exam", "thesis"],
    "praktikum": ["praktikum", "internship"],
    "ausland": ["ausland", "international", "exchange", "abroad"],
    "bachelor": ["bachelor"],
    "master": ["master"],
    "promotion": ["promotion", "phd", "doktor"],
}
MIN_CONTENT, MIN_WORDS, MIN_MEAN_WORD = 100, 20, 3
LINE_LENGTH, LINE_REPEATS = 10, 3


def portable(pattern: str) -> str:
    """A pattern with \\s spelled out, so that it means the same everywhere."""
    return pattern.replace(r"[\s-]", f"[{_IN}-]").replace(r"\s", WS)


def bound(value: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it inside of lambdas."""
    return F.element_at(F.transform(F.array(value), f), 1)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def words(text: Column) -> Column:
    """The words between white space; none for a text of white space."""
    return F.filter(F.split(text, f"{WS}+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def dedupe_hash(text: Column) -> Column:
    """sha256 of the lower-cased, stripped text."""
    return F.sha2(strip(F.lower(text)), 256)


def content_hash(text: Column) -> Column:
    """sha256 of the text as it is."""
    return F.sha2(text, 256)


def shingles(text: Column, k: int = 3) -> Column:
    """The set of k-word shingles of the lower-cased text; empty with fewer words."""

    def made(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.array_join(F.slice(w, i, F.lit(k)), " "))
        return F.when(F.size(w) >= k, runs).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(bound(words(F.lower(text)), made))


def shingle_hashes(text: Column, k: int = 3) -> Column:
    """The set of shingles as 64-bit hashes, without making a text of each."""

    def made(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - k)
        return F.when(F.size(w) >= k, F.transform(at, lambda i: F.xxhash64(*[w[i + j] for j in range(k)]))).otherwise(F.array().cast("array<bigint>"))

    return F.array_distinct(bound(words(F.lower(text)), made))


def shingle_hash(text: Column, k: int = 3) -> Column:
    return F.md5(F.array_join(F.array_sort(shingles(text, k)), ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def clean_text(text: Column, preserve_newlines: bool = False) -> Column:
    """Boilerplate deleted and white space collapsed; optionally line breaks stay, and at most one blank line between lines."""
    for pattern in BOILERPLATE:
        text = F.regexp_replace(text, "(?iud)" + portable(pattern), "")
    if preserve_newlines:
        text = F.regexp_replace(text, r"[^\S\n]+", " ")
        text = F.regexp_replace(text, rf"\n{WS}*\n", "\n\n")
    else:
        text = F.regexp_replace(text, f"{WS}+", " ")
    return strip(text)


def drop_repeated_lines(text: Column) -> Column:
    """Without the lines whose stripped form is longer than 10 characters and occurs three times or more."""
    lines = F.split(text, "\n", -1)

    def kept(bare: Column) -> Column:
        long_ = F.filter(bare, lambda x: F.length(x) > LINE_LENGTH)
        often = bound(long_, lambda b: F.filter(F.array_distinct(b), lambda x: F.size(F.filter(b, lambda y: y == x)) >= LINE_REPEATS))
        return bound(often, lambda gone: F.filter(lines, lambda line: ~F.array_contains(gone, strip(line))))

    return F.array_join(bound(F.transform(lines, strip), kept), "\n")


def mean_word_length(text: Column) -> Column:
    def mean(w: Column) -> Column:
        return F.when(F.size(w) > 0, F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x)) / F.size(w)).otherwise(F.lit(0.0))

    return bound(words(text), mean)


def is_substantial(text: Column) -> Column:
    """Long enough in characters, words and mean word length."""
    return F.coalesce((F.length(text) >= MIN_CONTENT) & (word_count(text) >= MIN_WORDS) & (mean_word_length(text) >= MIN_MEAN_WORD), F.lit(False))


def is_long(text: Column) -> Column:
    return F.length(text) > 500


def topics(text: Column) -> Column:
    low = F.lower(text)
    found = []
    for topic, keys in TOPICS.items():
        hit = F.lit(False)
        for key in keys:
            hit = hit | low.contains(key)
        found.append(F.when(hit, F.lit(topic)))
    return F.array_compact(F.array(*found))


def optimal_chunk_size(text: Column) -> Column:
    n = F.length(text)
    return F.when(n < 1000, n).when(n < 5000, F.lit(1000)).otherwise(F.lit(1500))


def preview(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)


def trim_snippet(text: Column, least: int = 200, tail: int = 200, gate: int = 0) -> Column:
    """A text longer than `least` ends at the next sentence end within `tail` characters, else at `least` with an ellipsis."""
    window = F.substring(text, least + 1, tail)
    # Fixed value: what ends a sentence.
    stop = F.regexp_extract(window, rf"(?ds)^(.*?[.!?…](?:['\")\]]+)?)(?={WS}|\z)", 1)
    rstrip = lambda c: F.regexp_replace(c, f"{WS}+$", "")
    cut = F.when(stop != "", rstrip(F.concat(F.left(text, F.lit(least)), stop))).otherwise(F.concat(rstrip(F.left(text, F.lit(least))), F.lit("…")))
    return F.when(F.length(text) <= F.greatest(F.lit(least), F.lit(gate)), text).otherwise(cut)


def phrases(text: Column) -> Column:
    """Lines stripped, then cut at double spaces; non-empty pieces on lines of their own."""
    lines = F.transform(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]", -1), strip)
    pieces = F.flatten(F.transform(lines, lambda line: F.transform(F.split(line, "  ", -1), strip)))
    return F.array_join(F.filter(pieces, lambda p: p != ""), "\n")


def page_text(text: Column, cap: int = 2000) -> Column:
    body = phrases(text)
    return F.when(F.length(body) > cap, F.concat(F.left(body, F.lit(cap)), F.lit("... (Text gekürzt)"))).otherwise(body)


def is_email(address: Column) -> Column:
    # Fixed value: the pattern of addresses.
    return F.coalesce(address.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\n?\z"), F.lit(False))


def padded(text: Column, n: int) -> Column:
    """At least n characters wide; never shortened."""
    return F.when(F.length(text) < n, F.rpad(text, n, " ")).otherwise(text)


def clean_document(docs: DataFrame, content: str = "content") -> DataFrame:
    """`docs` with the text cleaned, repeated lines dropped, and is_substantial, word_count and char_count of what is left; a null text stays null."""
    cleaned = drop_repeated_lines(clean_text(F.col(content)))
    c = F.col(content)
    return docs.withColumn(content, cleaned).withColumns({"is_substantial": is_substantial(c), "word_count": F.when(c.isNotNull(), word_count(c)), "char_count": F.length(c)})


def merged(left: Column, right: Column) -> Column:
    """Two maps as one; where both have a key, the right one's value holds. A null map is empty."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    a, b = F.coalesce(left, empty), F.coalesce(right, empty)
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def scalars_only(rows: DataFrame, key: str, metadata: str, fixed: list[str]) -> DataFrame:
    """(key, name, value) of the entries of a JSON object that are texts, numbers or booleans; names in `fixed` are left to others."""
    spark = rows.sparkSession
    parsed = rows.select(F.col(key).alias("_key"), F.try_parse_json(metadata).alias("_v"))
    out = spark.sql("SELECT p._key, v.key AS name, schema_of_variant(v.value) AS kind, v.value AS value FROM {p} AS p, LATERAL variant_explode(p._v) AS v", p=parsed)
    scalar = F.col("kind").rlike("^(STRING|BIGINT|DOUBLE|FLOAT|BOOLEAN|DECIMAL)")
    return out.where(scalar & ~F.col("name").isin(fixed)).select(F.col("_key").alias(key), "name", F.col("value").cast("string").alias("value"))
