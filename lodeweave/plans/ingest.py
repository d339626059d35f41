"""The ingestion pipeline: pages to cleaned, enriched, de-duplicated, chunked and embedded store rows, and its report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.functions import html as H
from lodeweave.functions import text as T
from lodeweave.functions import urls as U
from lodeweave.operators import chunks, dedupe, retrieval
from lodeweave.plans import tables as D
from lodeweave.session import written


def enriched(docs: DataFrame) -> DataFrame:
    """Documents (url, title, content) with category, path, depth, language, topics and flags."""
    url, content = F.col("url"), F.col("content")
    return docs.withColumns(
        {
            "category": U.category(url), "url_path": U.url_path(url), "url_depth": U.url_depth(url), "language": U.language(url), "topics": T.topics(content),
            "has_title": F.coalesce(F.col("title") != "", F.lit(False)), "content_length": F.length(content), "is_substantial": T.is_long(content),
        }
    )


def scraped_pages(spark: SparkSession, sf_dir: str, html: str = "html") -> DataFrame:
    """(id, url, title, content, word_count, success): extracted and cleaned pages."""
    pages = D.table(spark, sf_dir, "pages")
    rows = pages.select(F.col("page_id").alias("id"), "url", H.extract_udf("url", html).alias("p"))
    return rows.select("id", "url", F.col("p.title").alias("title"), T.clean_text(F.col("p.content")).alias("content"), F.col("p.word_count").alias("word_count"), (F.length("p.content") > 0).alias("success"))


def unique_documents(docs: DataFrame) -> DataFrame:
    """Documents whose url belongs to a kept one."""
    judged = dedupe.greedy(docs.where("success").select("id", "content"))
    urls = docs.join(judged.where("is_unique").select("id"), "id", "left_semi").select("url").distinct()
    return docs.where("success").join(urls, "url", "left_semi")


def store_rows(docs: DataFrame, prefix: str = "") -> DataFrame:
    """Chunked by headers and paragraphs, then by the store's own chunker, embedded, a collection for each category."""
    rows = enriched(docs.where("success"))
    cut = chunks.exploded(rows.select("url", "title", "category", "content"), "content").withColumnRenamed("text", "content_")
    parts = chunks.chunk_documents(cut.withColumnRenamed("content_", "text"))
    stored = chunks.stored_chunks(parts.select("url", "title", "content", "category", F.lit(True).alias("success")))
    return stored.select("id", "text", retrieval.hashing_embedder(64)(F.col("text")).alias("embedding"), "source_url", "title", "category", "chunk_index", "total_chunks", F.concat(F.lit(prefix), F.col("category")).alias("collection"))


def with_pdfs(pages: DataFrame, pdfs: DataFrame) -> DataFrame:
    """Pages and extracted PDFs (url, title, text, num_pages, success, document_type) as one table of documents, with content_type and category.

    A PDF with a known document type, or whose address names examination rules, goes to their category.
    """
    html = pages.where("success").withColumns({"content_type": F.lit("html"), "category": U.category(F.col("url"))})
    files = pdfs.where("success").withColumnRenamed("text", "content").withColumns({"content_type": F.lit("pdf"), "category": U.pdf_category(F.lower("url"), F.col("document_type"))})
    return html.unionByName(files, allowMissingColumns=True)


def chunks_per_category(stored: DataFrame) -> DataFrame:
    return stored.groupBy("category").agg(F.count("*").alias("chunks"))


def measures(discovered: DataFrame, docs: DataFrame, unique: DataFrame, pdfs: DataFrame, stored: DataFrame, log: DataFrame) -> DataFrame:
    """The pipeline's report as (section, name, value).

    discovered (url, kind, skipped), docs and unique (url, success), pdfs (success), stored (collection, category),
    log (success, response_time, content_size, error). Every part is an aggregate of its own.
    """
    from lodeweave.operators.metrics import counts_by, fetch_metrics
    from lodeweave.operators.reports import as_rows, listed, together

    pages = F.col("kind") == "page"
    good = unique.where("success").withColumn("category", U.category(F.col("url")))
    n = lambda c: F.count_if(c)
    parts = [
        discovered.agg(n(pages).alias("urls_discovered"), n(pages & ~F.col("skipped")).alias("urls_scraped"), n(pages & F.col("skipped")).alias("urls_skipped_cache"), n(~pages).alias("pdfs_found")),
        docs.agg(F.count("*").alias("pages_scraped"), n(F.col("success")).alias("successful_scrapes"), n(~F.col("success")).alias("failed_scrapes")),
        docs.agg(n(F.col("success")).alias("_a")).crossJoin(unique.agg(n(F.col("success")).alias("_b"))).select((F.col("_a") - F.col("_b")).alias("duplicates_removed")),  # one row each
        pdfs.agg(n(F.col("success")).alias("pdfs_extracted"), n(~F.col("success")).alias("pdfs_failed")),
        good.agg(F.countDistinct("category").alias("categories_found")),
        stored.agg(F.count("*").alias("total_chunks_created"), F.count("id").alias("total_documents_stored")),
    ]
    rows = [as_rows(p, "results") for p in parts]
    rows.append(listed(good.groupBy("category").agg(F.count("*").alias("cnt")), "category_distribution", "category", "cnt"))
    m = fetch_metrics(log, F.lit(1.0)).select(F.round("success_rate", 6).alias("success_rate"), F.round("avg_response_time", 6).alias("average_response_time"), "total_content_size")
    rows += [as_rows(m, "metrics"), listed(counts_by(log, "error"), "error_summary", "error", "cnt")]
    return together(*rows)


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: pages, failures, duplicates, chunks, categories and the success rate."""
    docs = written(scraped_pages(spark, sf_dir), "scraped")
    unique = written(unique_documents(docs), "unique")
    stored = store_rows(unique)  # only counted below, so Spark leaves the embedding out
    a = docs.agg(F.count("*").alias("total_pages"), F.count_if("success").alias("successful"), F.count_if(~F.col("success")).alias("failed_scrapes"))
    b = unique.agg(F.count("*").alias("unique_documents"))
    c = stored.agg(F.count("*").alias("chunks_stored"), F.countDistinct("collection").alias("collections"))
    one = a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(c))  # one row each
    return one.withColumns({"duplicates_removed": F.col("successful") - F.col("unique_documents"), "success_rate": F.when(F.col("total_pages") > 0, F.col("successful") / F.col("total_pages")).otherwise(F.lit(0.0))})
