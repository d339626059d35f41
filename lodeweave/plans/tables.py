"""Inputs of the registered queries: driver tables, and logs and addresses made from them by expression, in both engines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.functions import text as T

NOW = "2024-01-31 00:00:00"
SECTIONS = ["news", "Aktuelles", "event", "veranstaltung-x", "po-2020", "po_2021", "pruefungsordnung", "modulhandbuch", "kontakt", "forschung", "studium/bachelor", "en/studies", "de/dekanat", "api/feed", "en/api", "calendar", "winfo/verlaufsplan", "exam", "fakultaet", "bewerbung", "international", "services", "about"]
CATEGORIES = ["news", "events", "faculty", "other", None]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list[str | None], n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))


def quoted(value: object) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def sql_pick(values: list[str | None], n: str) -> str:
    return f"([{', '.join(map(quoted, values))}])[CAST({n} % {len(values)} + 1 AS BIGINT)]"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, url): one made-up address per document, over all sections and endings."""
    ending = pick(["", "/Plan.PDF", "/a.css", "/x;v=1?q=2", "?page=3#top", "#part", "/list.xml", "/"], F.col("doc_id"))
    host = pick(["https://host.test", "http://user@www.host.test:8080", "https://en.other.test"], F.col("doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(host, F.lit("/"), pick(SECTIONS, F.col("doc_id")), F.lit("/"), F.col("doc_id").cast("string"), ending).alias("url"))


ADDRESSES = f"""addresses AS (SELECT doc_id, {sql_pick(['https://host.test', 'http://user@www.host.test:8080', 'https://en.other.test'], 'doc_id')} || '/' || {sql_pick(SECTIONS, 'doc_id')} || '/' || doc_id
    || {sql_pick(['', '/Plan.PDF', '/a.css', '/x;v=1?q=2', '?page=3#top', '#part', '/list.xml', '/'], 'doc_id')} AS url FROM documents)"""


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, url, content_hash, last_scraped, success, status_code, category, response_time, content_size, word_count, error) from events."""
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    return e.select(
        "event_id", F.concat(F.lit("https://host.test/"), pick(SECTIONS, F.col("user_id")), F.lit("/"), F.col("user_id").cast("string")).alias("url"),
        F.sha2(F.concat(kind, F.lit("-"), (F.col("event_id") % 3).cast("string")), 256).alias("content_hash"), F.col("ts").alias("last_scraped"), (kind != "error").alias("success"),
        F.when(kind == "error", F.lit(500)).when(kind == "signup", F.lit(0)).otherwise(F.lit(200)).alias("status_code"), pick(CATEGORIES, F.col("user_id")).alias("category"),
        F.col("value").alias("response_time"), (F.col("event_id") % 5000).alias("content_size"), (F.col("event_id") % 700).cast("int").alias("word_count"),
        F.when(kind == "error", pick(["timeout", "not_found", "server_error"], F.col("event_id"))).alias("error"), F.lit("{}").alias("metadata"),
    )


FETCH_LOG = f"""fetch_log AS (SELECT event_id, 'https://host.test/' || {sql_pick(SECTIONS, 'user_id')} || '/' || user_id AS url, sha256(event_type || '-' || event_id % 3) AS content_hash, ts AS last_scraped,
    event_type <> 'error' AS success, CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 0 ELSE 200 END AS status_code, {sql_pick(CATEGORIES, 'user_id')} AS category, value AS response_time,
    event_id % 5000 AS content_size, CAST(event_id % 700 AS INTEGER) AS word_count, CASE WHEN event_type = 'error' THEN {sql_pick(['timeout', 'not_found', 'server_error'], 'event_id')} END AS error FROM events)"""
CACHE = f"{FETCH_LOG}, cache AS (SELECT * FROM fetch_log QUALIFY row_number() OVER (PARTITION BY url ORDER BY last_scraped DESC, event_id DESC) = 1)"

WS = T.WS


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def sql_words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda w: w <> '')"


def sql_clean(x: str) -> str:
    for pattern in T.BOILERPLATE:
        x = f"regexp_replace({x}, {quoted(T.portable(pattern))}, '', 'gi')"
    return sql_strip(f"regexp_replace({x}, '{WS}+', ' ', 'g')")


def sql_first_match(x: str, rules: list[tuple[list[str], object]], otherwise: object = None) -> str:
    cases = " ".join(f"WHEN {' OR '.join(f'contains({x}, {quoted(k)})' for k in keys)} THEN {quoted(value)}" for keys, value in rules)
    return f"CASE {cases} ELSE {quoted(otherwise)} END"
