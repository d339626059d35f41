"""The URL cache: upserts, lookups, freshness, change detection, re-fetch decisions and priorities.

A cache is a table (url, content_hash, last_scraped, success, status_code, category,
metadata); `now` is always an argument, so results don't depend on the clock.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.functions import urls as U

DAY = 86_400_000_000


def micros(at: Column | str) -> Column:
    return F.unix_micros((F.col(at) if isinstance(at, str) else at).cast("timestamp"))


def age_days(now: Column, then: Column) -> Column:
    """Whole days, rounded down."""
    return F.floor((micros(now) - micros(then)) / DAY)


def older_than(now: Column, then: Column, days: Column) -> Column:
    return micros(now) - micros(then) >= days * DAY


def latest(rows: DataFrame, order: list[str]) -> DataFrame:
    """The last row of each url; a later put replaces an earlier one. An aggregate, so most rows go before the shuffle."""
    last = F.max_by(F.struct(*rows.columns), F.struct(*order))
    return rows.groupBy("url").agg(last.alias("_last")).select("_last.*")


def put(cache: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """The cache after upserting new rows."""
    return latest(cache.unionByName(new, allowMissingColumns=True), order)


def history(rows: DataFrame) -> DataFrame:
    return rows.select("url", "content_hash", F.col("last_scraped").alias("scraped_at"), "success", F.lit(None).cast("string").alias("error_message"))


def get(cache: DataFrame, url: str) -> DataFrame:
    return cache.where(F.col("url") == url).withColumn("metadata", F.coalesce("metadata", F.lit("{}")))


def without_url(cache: DataFrame, url: str) -> DataFrame:
    return cache.where(~F.col("url").eqNullSafe(F.lit(url)))


def without_category(cache: DataFrame, category: str) -> DataFrame:
    """Rows without a category stay."""
    return cache.where(~F.col("category").eqNullSafe(F.lit(category)))


def without_older(cache: DataFrame, now: Column, days: int = 90) -> DataFrame:
    return cache.where(~F.coalesce(micros("last_scraped") < micros(now) - days * DAY, F.lit(False)))


def metadata_text(metadata: Column) -> Column:
    """A map as JSON text, as the cache keeps it; null for an empty or missing one."""
    return F.when(F.size(metadata) > 0, F.to_json(metadata))


def search(cache: DataFrame, part: str) -> DataFrame:
    """Rows whose url holds `part`, whatever the case of A-Z; % and _ stand for any text and any character."""
    upper, lower = (string.ascii_uppercase, string.ascii_lowercase)
    low = part.translate(str.maketrans(upper, lower))
    return cache.where(F.translate("url", upper, lower).like(f"%{low}%")).orderBy("url")


def is_fresh(now: Column, max_age: Column | None = None) -> Column:
    days = U.max_age_days(F.col("url"), F.col("category")) if max_age is None else max_age
    return F.coalesce(~older_than(now, F.col("last_scraped"), days), F.lit(False))


def statistics(cache: DataFrame, now: Column) -> DataFrame:
    return cache.agg(
        F.count("*").alias("total"), F.count_if(F.col("success")).alias("successful"), F.count_if(~F.col("success")).alias("failed"),
        F.count_if(is_fresh(now)).alias("fresh"), F.count_if(~is_fresh(now)).alias("expired"),
    )


def by_category(cache: DataFrame) -> DataFrame:
    return cache.groupBy("category").agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "category")


def category_bars(cache: DataFrame) -> DataFrame:
    return by_category(cache).withColumn("bar", F.repeat(F.lit("█"), F.floor(F.col("cnt") / 5).cast("int")))


def listing(cache: DataFrame, first: int = 15) -> DataFrame:
    """Per category (none: uncategorized) its name in capitals, how many urls, and the first ones in order."""
    c = F.coalesce("category", F.lit("uncategorized"))
    ranked = cache.withColumn("_c", c).withColumn("_r", F.row_number().over(Window.partitionBy("_c").orderBy("url")))
    counts = cache.groupBy(c.alias("_c")).agg(F.count("*").alias("cnt"))
    heads = ranked.where(F.col("_r") <= first).groupBy("_c").agg(F.array_sort(F.collect_list("url")).alias("urls"))
    return counts.join(heads, "_c").select(F.upper("_c").alias("category"), "cnt", "urls").orderBy("category")


def recent(cache: DataFrame, n: int = 20) -> DataFrame:
    return cache.orderBy(F.desc("last_scraped"), "url").limit(n)


def _with_cache(urls: DataFrame, cache: DataFrame) -> DataFrame:
    known = cache.select(F.col("url").alias("_url"), "content_hash", "last_scraped", "success", "category", F.lit(True).alias("cached"))
    return urls.join(known, urls.url == F.col("_url"), "left").drop("_url").withColumn("cached", F.coalesce("cached", F.lit(False)))


def should_scrape(urls: DataFrame, cache: DataFrame, now: Column, force: bool = False) -> DataFrame:
    """urls with should_scrape: forced, missing or stale; a failed row is fresh as long as any other."""
    return _with_cache(urls, cache).withColumn("should_scrape", F.lit(force) | ~F.col("cached") | ~is_fresh(now)).select(*urls.columns, "should_scrape")


def decide(urls: DataFrame, cache: DataFrame, now: Column, force: bool = False) -> DataFrame:
    """urls with should_scrape, reason, bucket (new, failed_before, expired, forced, skipped), age_days, max_age_days and priority."""
    rows = _with_cache(urls, cache)
    days, age = U.refetch_days(F.col("url")), age_days(now, F.col("last_scraped"))
    stale = older_than(now, F.col("last_scraped"), days)
    reason = F.when(F.lit(force), "forced").when(~F.col("cached"), "new_url").when(~F.col("success"), "previous_failure").when(stale, F.concat(F.lit("expired_cache_"), age.cast("string"), F.lit("d"))).otherwise(F.concat(F.lit("fresh_cache_"), age.cast("string"), F.lit("d")))
    bucket = F.when(F.lit(force), "forced").when(~F.col("cached"), "new").when(~F.col("success"), "failed_before").when(stale, "expired").otherwise("skipped")
    out = rows.withColumns({"reason": reason, "bucket": bucket, "age_days": age, "max_age_days": days, "priority": U.refetch_priority(F.col("url"))})
    return out.withColumn("should_scrape", F.col("bucket") != "skipped").select(*urls.columns, "should_scrape", "reason", "bucket", "age_days", "max_age_days", "priority")


def bucket_counts(decided: DataFrame) -> DataFrame:
    return decided.groupBy("bucket").agg(F.count("*").alias("cnt"))


def prioritised(urls: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """urls with their score from 0 to 100."""
    rows = _with_cache(urls, cache)
    age = age_days(now, F.col("last_scraped"))
    bonus = F.when(~F.col("cached"), 30).when(age > 90, 20).when(age > 30, 10).when(age < 7, -20).otherwise(0)
    score = F.least(F.lit(100), F.greatest(F.lit(0), U.base_score(F.col("url")) + bonus))
    return rows.withColumn("score", score).select(*urls.columns, "score")


def in_order(scored: DataFrame, position: str = "url") -> DataFrame:
    """The larger score first; ties in the order of a column that tells each row's place."""
    return scored.orderBy(F.desc("score"), position)


def changes(docs: DataFrame, cache: DataFrame) -> DataFrame:
    """Documents (url, content, word_count) against the cache: change_type, and word counts for modified ones."""
    known = cache.select(F.col("url").alias("_url"), F.col("content_hash").alias("old_hash"), F.col("word_count").alias("word_count_old"), "last_scraped")
    rows = docs.join(known, docs.url == F.col("_url"), "left").withColumn("new_hash", F.sha2("content", 256))
    kind = F.when(F.col("_url").isNull(), "new").when(F.col("old_hash").eqNullSafe(F.col("new_hash")), "identical").otherwise("modified")
    old, new = F.coalesce("word_count_old", F.lit(0)), F.coalesce("word_count", F.lit(0))
    modified = F.col("change_type") == "modified"
    rows = rows.withColumn("change_type", kind)
    return rows.select(
        "url", "change_type", (F.col("change_type") != "identical").alias("changed"), F.when(modified, old).alias("word_count_old"), F.when(modified, new).alias("word_count_new"),
        F.when(modified, new - old).alias("word_diff"), F.when(modified, F.when(old > 0, (new - old) / old * 100).otherwise(F.lit(0.0))).alias("word_diff_pct"),
    )


def text_report(cache: DataFrame, now: Column) -> DataFrame:
    """(pos, line): the lines of the cache report, in order of pos."""
    s = statistics(cache, now).select(F.posexplode(F.array(*[F.concat(F.lit(f"{name}: "), F.col(name).cast("string")) for name in ("total", "successful", "failed", "fresh", "expired")])).alias("pos", "line"))
    c = by_category(cache).where("category IS NOT NULL AND category <> ''").select((F.row_number().over(Window.orderBy(F.desc("cnt"), "category")) + 100).alias("pos"), F.concat("category", F.lit(": "), F.col("cnt").cast("string")).alias("line"))
    table = cache.sparkSession.createDataFrame([(1000 + i, f"{k}: {v}") for i, (k, v) in enumerate(sorted(U.CATEGORY_AGE.items()))], "pos int, line string")
    return s.unionByName(c).unionByName(table).orderBy("pos")


def incremental_statistics(changed: DataFrame, decided: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """One row: how many pages changed, how many urls were skipped, and the cache's own statistics."""
    a = changed.agg(F.count_if("changed").alias("changes_detected"))
    b = decided.agg(F.count_if(~F.col("should_scrape")).alias("urls_skipped"))
    return a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(statistics(cache, now)))  # one row each
