"""Reports as rows: every report is a table of (section, name, value), and text reports are tables of ordered lines.

A report lists urls and chunks without bound, so it is never put together in one place: sinks
write its rows as they are, a section after another.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.functions import retry as R
from lodeweave.functions import text as T


def as_rows(df: DataFrame, section: str) -> DataFrame:
    """The columns of a one-row table as rows of a report; values as text."""
    fields = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in df.columns])
    return df.select(F.lit(section).alias("section"), F.explode(fields).alias("f")).select("section", "f.name", "f.value")


def listed(df: DataFrame, section: str, name: str | Column, value: str | Column) -> DataFrame:
    """Rows of a report from a column of names and one of values."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return df.select(F.lit(section).alias("section"), col(name).cast("string").alias("name"), col(value).cast("string").alias("value"))


def together(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def judged_attempts(attempts: DataFrame) -> DataFrame:
    """Fetch attempts (url, attempt, success, kind, status, message) with error_type, and whether another try is due."""
    kind, status = F.col("kind"), F.col("status")
    failed = ~F.col("success")
    return attempts.withColumns({"error_type": F.when(failed, R.error_name(kind, status)), "retryable": F.when(failed, R.is_retryable(kind, status))})


def failed_urls(attempts: DataFrame, max_retries: int = 3) -> DataFrame:
    """(url, error_type, message) of urls given up: the last attempt failed, and it can't or mustn't be tried again.

    Attempts count from 0; behind an error that can't be tried again, or the last attempt, none follows.
    """
    last = judged_attempts(attempts).groupBy("url").agg(F.max_by(F.struct("attempt", "success", "error_type", "message", "retryable"), "attempt").alias("a"))
    gone = ~F.col("a.success") & (~F.col("a.retryable") | (F.col("a.attempt") >= max_retries - 1))
    return last.where(gone).select("url", "a.error_type", "a.message")


def retry_queue(attempts: DataFrame, max_retries: int = 3, config: R.RetryConfig = R.RetryConfig()) -> DataFrame:  # noqa: B008
    """(url, attempt, delay) of urls whose last attempt failed and may be tried again: the number of the next attempt, and the seconds before it."""
    last = judged_attempts(attempts).groupBy("url").agg(F.max_by(F.struct("attempt", "success", "retryable"), "attempt").alias("a"))
    due = last.where(~F.col("a.success") & F.col("a.retryable") & (F.col("a.attempt") < max_retries - 1))
    return due.select("url", (F.col("a.attempt") + 1).alias("attempt"), R.backoff(F.col("a.attempt"), config).alias("delay"))


def error_statistics(attempts: DataFrame) -> DataFrame:
    """(error_type, cnt) over all failed attempts."""
    return judged_attempts(attempts).where(~F.col("success")).groupBy("error_type").agg(F.count("*").alias("cnt"))


def failed_report(attempts: DataFrame, max_retries: int = 3) -> DataFrame:
    """Sections summary, error_statistics and failed_urls (name: url, value: error type and message)."""
    gone = failed_urls(attempts, max_retries)
    return together(
        as_rows(gone.agg(F.count("*").alias("failed_count")), "summary"), listed(error_statistics(attempts), "error_statistics", "error_type", "cnt"),
        listed(gone, "failed_urls", "url", F.concat("error_type", F.lit(": "), F.coalesce("message", F.lit("")))),
    )


def discovered(urls: DataFrame) -> DataFrame:
    """The urls that a crawl found, and how many."""
    return together(as_rows(urls.agg(F.count("*").alias("total_urls")), "summary"), listed(urls, "urls", "url", F.lit(None).cast("string")))


def change_report(changes: DataFrame, decided: DataFrame, cache_statistics: DataFrame) -> DataFrame:
    """Changed pages, skipped urls, and how many of either; changes as of operators.cache.changes, decided as of decide."""
    changed, skipped = changes.where("changed"), decided.where("NOT should_scrape")
    counts = together(as_rows(changed.agg(F.count("*").alias("changes_detected")), "statistics"), as_rows(skipped.agg(F.count("*").alias("urls_skipped")), "statistics"))
    return together(counts, as_rows(cache_statistics, "cache_stats"), listed(changed, "changes_detected", "url", "change_type"), listed(skipped, "skipped_urls", "url", "reason"))


def metrics_report(log: DataFrame, measures: DataFrame, order: str, last: int | None = 100) -> DataFrame:
    """Measures, counts by category, error and status, and the details of the last urls (all with last=None).

    log: (url, success, category, error, status_code); measures: one row, as of operators.metrics.fetch_metrics.
    """
    from lodeweave.operators.metrics import counts_by

    details = log if last is None else log.orderBy(F.desc(order)).limit(last)
    parts = [as_rows(measures, "summary")]
    parts += [listed(counts_by(log, key), section, key, "cnt") for section, key in (("categories", "category"), ("errors", "error"), ("status_codes", "status_code"))]
    return together(*parts, listed(details, "url_details", F.col(order), F.concat_ws(" ", "url", F.col("success").cast("string"))))


def reprocessed(docs: DataFrame, stored: DataFrame) -> DataFrame:
    """The report on data that was stored once and is processed again: docs (success, category), stored chunks."""
    good = docs.where("success")
    a = docs.agg(F.count("*").alias("total_pages"), F.count_if("success").alias("successful_pages"), F.countDistinct(F.when(F.col("success"), F.col("category"))).alias("categories_found"))
    return together(
        as_rows(a, "results"), as_rows(stored.agg(F.count("*").alias("total_documents_stored")), "results"),
        listed(good.groupBy("category").agg(F.count("*").alias("cnt")), "category_distribution", "category", "cnt"),
    )


def pdf_metadata(pdfs: DataFrame) -> DataFrame:
    """Everything about PDFs but their text."""
    return pdfs.drop("text", "content")


# Text reports


def cache_lines(cache: DataFrame, form: str, unknown: str = "uncategorized") -> DataFrame:
    """(category, place, url, line): the cache as text, in order of the first three; form: simple, detailed, by-category or json.

    A category's header stands before its urls and tells how many they are.
    """
    rows = cache.withColumn("category", F.coalesce(F.nullif("category", F.lit("")), F.lit(unknown)))
    code = F.coalesce(F.nullif(F.col("status_code").cast("string"), F.lit("0")), F.lit("N/A"))
    status = F.concat(F.when(F.col("success"), F.lit("SUCCESS")).otherwise(F.lit("FAILED")), F.lit(" (Code: "), code, F.lit(")"))
    forms = {
        "simple": F.col("url"), "by-category": F.col("url"),
        "detailed": F.concat_ws("\n", F.concat(F.lit("URL:      "), "url"), F.concat(F.lit("Category: "), "category"), F.concat(F.lit("Status:   "), status), F.concat(F.lit("Scraped:  "), F.date_format("last_scraped", "yyyy-MM-dd HH:mm:ss"))),
        "json": F.to_json(F.struct("url", "category", "success", "status_code", F.date_format("last_scraped", "yyyy-MM-dd HH:mm:ss").alias("last_scraped"), "content_hash"), {"ignoreNullFields": "false"}),
    }
    if form not in forms:
        raise ValueError(f"unknown form: {form}")
    lines = rows.select("category", F.lit(1).alias("place"), "url", forms[form].alias("line"))
    if form == "by-category":
        heads = rows.groupBy("category").agg(F.count("*").alias("n"))
        lines = lines.unionByName(heads.select("category", F.lit(0).alias("place"), F.lit("").alias("url"), F.concat(F.lit("## "), F.upper("category"), F.lit(" ("), F.col("n").cast("string"), F.lit(" URLs)")).alias("line")))
    return lines.orderBy("category", "place", "url")


def chunk_lines(store: DataFrame) -> DataFrame:
    """(id, line): every chunk of a store as a block of text."""
    number = F.concat((F.col("chunk_index") + 1).cast("string"), F.lit("/"), F.coalesce(F.col("total_chunks").cast("string"), F.lit("?")))
    block = F.concat_ws(
        "\n", F.concat(F.lit("ID: "), "id"), F.concat(F.lit("Source: "), F.coalesce("source_url", F.lit("Unknown"))), F.concat(F.lit("Chunk: "), number), F.concat(F.lit("Length: "), F.length("text").cast("string"), F.lit(" characters")),
        F.concat(F.lit("Title: "), F.coalesce("title", F.lit("N/A"))), F.repeat(F.lit("-"), F.lit(50)), "text", F.repeat(F.lit("-"), F.lit(50)),
    )
    return store.select("id", block.alias("line"))


def bars(counts: DataFrame, key: str, total: Column) -> DataFrame:
    """Lines 'key   count   share' with padded columns."""
    share = F.format_string("%.1f%%", F.col("cnt") * 100.0 / total)
    return counts.select(key, F.concat(T.padded(F.col(key).cast("string"), 10), F.lit(" "), F.lpad(F.col("cnt").cast("string"), 3, " "), F.lit(" "), share).alias("line"))


def profile_lines(profile: DataFrame, form: str = "markdown", first: int = 10) -> DataFrame:
    """(field_name, line) of the first fields of a structure profile by name, as markdown or html table rows, or json."""
    rate = F.format_string("%.2f", F.col("presence_rate"))
    forms = {
        "markdown": F.concat(F.lit("| "), F.concat_ws(" | ", "field_name", "data_type", rate), F.lit(" |")),
        "html": F.concat(F.lit("<tr><td>"), F.concat_ws("</td><td>", "field_name", "data_type", rate), F.lit("</td></tr>")),
        "json": F.to_json(F.struct("field_name", "data_type", rate.alias("presence_rate"))),
    }
    if form not in forms:
        raise ValueError(f"unknown form: {form}")
    few = profile.orderBy("field_name").limit(first)  # the feature is a short overview
    return few.select("field_name", forms[form].alias("line"))


def ranked_lines(counts: DataFrame, key: str) -> DataFrame:
    """(rank, key, cnt) in order of falling count, ties by key: a few keys, so one window holds them."""
    return counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("cnt"), key)))
