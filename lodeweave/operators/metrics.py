"""Aggregates and reports over fetch logs, scraped documents, PDFs, duplicates and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scrape_statistics(docs: DataFrame) -> DataFrame:
    """Of documents (success, content, word_count, domain); lengths, words and domains over successes only."""
    ok = F.col("success")
    return docs.agg(
        F.count("*").alias("total"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"),
        F.coalesce(F.avg(ok.cast("double")), F.lit(0.0)).alias("success_rate"), F.coalesce(F.avg(F.when(ok, F.length("content"))), F.lit(0.0)).alias("avg_content_length"),
        F.coalesce(F.sum(F.when(ok, F.col("word_count"))), F.lit(0)).alias("total_words"), F.countDistinct(F.when(ok, F.col("domain"))).alias("unique_domains"),
    )


def fetch_metrics(log: DataFrame, elapsed_seconds: Column) -> DataFrame:
    """Of a log (success, response_time, content_size); the success rate as a share and in per cent."""
    ok = F.col("success")
    return log.agg(
        F.count("*").alias("urls_crawled"), F.count_if(ok).alias("urls_successful"), F.count_if(~ok).alias("urls_failed"),
        F.coalesce(F.avg(ok.cast("double")), F.lit(0.0)).alias("success_share"), (F.coalesce(F.avg(ok.cast("double")), F.lit(0.0)) * 100).alias("success_rate"),
        F.coalesce(F.avg("response_time"), F.lit(0.0)).alias("avg_response_time"), F.coalesce(F.floor(F.avg("content_size")), F.lit(0)).cast("long").alias("avg_content_size"),
        F.coalesce(F.sum("content_size"), F.lit(0)).cast("long").alias("total_content_size"), (F.count("*") / elapsed_seconds).alias("crawl_rate"),
    )


def counts_by(log: DataFrame, key: str, name: str = "cnt") -> DataFrame:
    """How often each key occurs; empty and zero keys don't count."""
    return log.where(F.col(key).isNotNull() & ~F.col(key).cast("string").isin("", "0")).groupBy(key).agg(F.count("*").alias(name))


def top_counts(log: DataFrame, key: str, n: int = 10) -> DataFrame:
    return counts_by(log, key).orderBy(F.desc("cnt"), key).limit(n)


def prefixed_errors(log: DataFrame, prefix: str, error: str = "error") -> DataFrame:
    """Error counters of PDF or duplicate logs under prefixed names."""
    return log.where(F.col(error).isNotNull()).groupBy(F.concat(F.lit(f"{prefix}_"), F.col(error)).alias("error")).agg(F.count("*").alias("cnt"))


def pdf_metrics(log: DataFrame) -> DataFrame:
    return log.agg(F.count("*").alias("pdfs_found"), F.count_if("success").alias("pdfs_extracted"), F.count_if(~F.col("success")).alias("pdfs_failed"))


def pdf_methods(log: DataFrame) -> DataFrame:
    """How many PDFs each method extracted."""
    return log.where("success").groupBy("extraction_method").agg(F.count("*").alias("cnt"))


def duplicate_metrics(judged: DataFrame) -> DataFrame:
    """How many documents were duplicates, by reason (duplicate_<reason>), and in all."""
    gone = judged.where("NOT is_unique")
    by_reason = gone.groupBy(F.concat(F.lit("duplicate_"), "reason").alias("name")).agg(F.count("*").alias("cnt"))
    return by_reason.unionByName(gone.agg(F.lit("duplicates_removed").alias("name"), F.count("*").alias("cnt")))


def last_rows(log: DataFrame, order: str, n: int = 100) -> DataFrame:
    """The last n rows by order, for reports: the feature is a bounded tail."""
    return log.orderBy(F.desc(order)).limit(n).orderBy(order)


def conversation_summary(turns: DataFrame) -> DataFrame:
    """Per conversation its messages by people and assistants; system messages don't count."""
    return turns.where(F.col("role").isin("user", "assistant")).groupBy("conv_id").agg(F.count("*").alias("total"), F.count_if(F.col("role") == "user").alias("human"), F.count_if(F.col("role") == "assistant").alias("ai"))


def memory(turns: DataFrame, cap: int = 100) -> DataFrame:
    """What a conversation remembers: its last `cap` messages."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.where(F.col("role").isin("user", "assistant")).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= cap).drop("_r")


def recent_messages(turns: DataFrame, n: int = 5, chars: int = 100) -> DataFrame:
    from lodeweave.functions.text import preview

    return memory(turns, n).select("conv_id", "turn", "role", preview(F.col("text"), chars).alias("preview"))


def count_report(log: DataFrame, key: str) -> DataFrame:
    """Lines 'key   count   share' in order of falling count."""
    from lodeweave.functions.text import padded

    total = log.agg(F.count("*").alias("_n"))
    rows = counts_by(log, key).crossJoin(F.broadcast(total))  # one row
    return rows.select(key, F.concat(padded(F.col(key).cast("string"), 20), F.lit(" "), F.lpad(F.col("cnt").cast("string"), 5, " "), F.lit(" ("), F.round(F.col("cnt") * 100 / F.col("_n"), 1).cast("string"), F.lit("%)")).alias("line"))


def profile(df: DataFrame) -> DataFrame:
    """Per column its presence rate, type, distinct values and mean text length: two aggregates over one scan each."""
    aggs = []
    for c, kind in df.dtypes:
        present = F.col(c).isNotNull() & (F.col(c) != "") if kind == "string" else F.col(c).isNotNull()
        aggs += [F.count_if(present).alias(f"p_{c}"), F.avg(F.length(c)).alias(f"l_{c}") if kind == "string" else F.lit(None).cast("double").alias(f"l_{c}")]
    row = df.agg(F.count("*").alias("_n"), *aggs)
    fields = F.array(*[F.struct(F.lit(c).alias("field_name"), F.when(F.col("_n") > 0, F.col(f"p_{c}") / F.col("_n")).otherwise(F.lit(0.0)).alias("presence_rate"), F.lit(kind).alias("data_type"), F.col(f"l_{c}").alias("avg_length")) for c, kind in df.dtypes])
    return row.select(F.explode(fields).alias("f")).select("f.*")


def profile_summary(df: DataFrame, text: str, source: str) -> DataFrame:
    rates = profile(df).agg(F.avg("presence_rate").alias("avg_completeness"))
    rest = df.agg(F.count("*").alias("total_documents"), F.avg(F.length(text)).alias("avg_text_length"), F.countDistinct(source).alias("unique_sources"))
    out = rest.crossJoin(F.broadcast(rates))  # one row each
    hints = F.array_compact(F.array(F.when(F.col("avg_completeness") < 0.8, F.lit("fill missing fields")), F.when(F.col("avg_text_length") > 1500, F.lit("chunk long texts")), F.when(F.col("unique_sources") < 2, F.lit("add sources"))))
    return out.withColumn("optimization_suggestions", F.concat_ws("; ", hints))
