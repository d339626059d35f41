"""Queries over what lasts: search for many questions, the vector index, near duplicates in batches, the cache by url, nested profiles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.operators import dedupe, minhash, profiles, vector_index
from lodeweave.operators.cache_table import CacheTable
from lodeweave.operators.near_index import NearIndex
from lodeweave.operators.vector_index import VectorIndex
from lodeweave.plans import tables as D
from lodeweave.plans.registry import query
from lodeweave.session import shared_dir


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The embeddings as a store, and as questions those whose id is divisible by 100."""
    store = D.table(spark, sf_dir, "embeddings").withColumn("collection", F.col("label").cast("string"))
    return store, store.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), "embedding")


_PAIRS = """v AS (SELECT vec_id, CAST(label AS VARCHAR) AS collection, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
    d AS (SELECT q.vec_id AS query_id, v.vec_id, v.collection, 1 - list_cosine_similarity(v.e, q.e) AS distance FROM v JOIN v q ON q.vec_id % 100 = 0)"""


@query(f"""WITH {_PAIRS}, b AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY query_id, collection ORDER BY distance, vec_id) <= 3),
    t AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, collection, vec_id) AS INTEGER) AS rank FROM b)
    SELECT query_id, rank, collection, vec_id, round(greatest(0, 1 - distance), 6) AS relevance FROM t WHERE rank <= 5 AND greatest(0, 1 - distance) > 0.1""")
def rag_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What `rag_topk` finds, for every hundredth vector as a question."""
    hits = vector_index.across_collections(*_vectors(spark, sf_dir), key="vec_id")
    return hits.select("query_id", "rank", "collection", "vec_id", F.round("relevance", 6).alias("relevance"))


_TEN = f"WITH {_PAIRS}, t AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank FROM d) SELECT query_id, rank, vec_id, round(1 - distance, 6) AS score FROM t WHERE rank <= 10"


@query(_TEN)
def vector_search_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = vector_index.nearest(*_vectors(spark, sf_dir), 10, key="vec_id")
    return hits.select("query_id", "rank", "vec_id", F.round(1 - F.col("distance"), 6).alias("score"))


def _index(spark: SparkSession, store: DataFrame) -> VectorIndex:
    """Trained and filled with the even rows, then given the odd ones as a batch."""
    index = VectorIndex(spark, _folder(spark, "vectors"), "vec_id")
    index.build(store.where(F.col("vec_id") % 2 == 0))
    index.add(store.where(F.col("vec_id") % 2 == 1))
    return index


@query(_TEN)
def vector_index_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through the inverted-file index, whose bounds tell which lists may be left out."""
    store, questions = _vectors(spark, sf_dir)
    return _index(spark, store).search(questions, 10, exact=True).withColumn("score", F.round("score", 6))


@query("SELECT count(*) AS questions, true AS reached FROM embeddings WHERE vec_id % 100 = 0")
def vector_index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the index finds nine of ten of the true ten nearest without looking at all lists."""
    store, questions = _vectors(spark, sf_dir)
    found = _index(spark, store).search(questions, 10)
    truth = vector_index.nearest(store, questions, 10, key="vec_id")
    return vector_index.recall(found, truth, key="vec_id").select("questions", (F.col("recall") >= 0.9).alias("reached"))


def _contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("text").alias("content"))


def batches_through_an_index(spark: SparkSession, docs: DataFrame, batches: int = 3) -> DataFrame:
    """Every document's fate, in batches by ranges of id through an index on disk that is opened anew for each."""
    ends = docs.agg(F.min("id"), F.max("id")).first()
    path, out = _folder(spark, "near"), None
    if ends[0] is None:
        return dedupe.greedy(docs)
    step = (ends[1] - ends[0]) // batches + 1
    for k in range(batches):
        part = docs.where(F.col("id").between(ends[0] + k * step, ends[0] + (k + 1) * step - 1))
        judged = NearIndex(spark, path).add(part)
        out = judged if out is None else out.unionByName(judged)
    return out


@query()
def minhash_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many near pairs there are, how many MinHash bands report wrongly, and whether they find nine of ten."""
    docs = _contents(spark, sf_dir)
    return minhash.recall(minhash.near_pairs(docs), dedupe.near_pairs(docs)).select("pairs", "wrong", (F.col("recall") >= 0.9).alias("reached"))


@query(f"WITH {D.CACHE}, urls AS (SELECT url FROM cache UNION ALL SELECT url || '/new' FROM cache) SELECT urls.url, cache.url IS NOT NULL AS cached, content_hash, status_code, category FROM urls LEFT JOIN cache ON urls.url = cache.url")
def cache_table_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fetch log as three puts into a cache that is laid out by url, and a look-up of its urls and of new ones."""
    log = D.fetch_log(spark, sf_dir)
    # Of a url's rows with one time the last event holds, so the order is put into the time.
    schema = "url string, content_hash string, last_scraped timestamp, event_id bigint, success boolean, status_code int, category string"
    rows = log.select("url", "content_hash", F.timestamp_micros(F.unix_micros(F.col("last_scraped").cast("timestamp")) * 1).alias("last_scraped"), "event_id", "success", "status_code", "category")
    rows = rows.withColumn("last_scraped", F.struct("last_scraped", "event_id"))
    schema = schema.replace("last_scraped timestamp", "last_scraped struct<last_scraped:timestamp,event_id:bigint>")
    table = CacheTable(spark, _folder(spark, "cache"), schema, puts=3)
    for k in range(3):
        table.put(rows.where(F.col("event_id") % 3 == k))
    known = D.fetch_log(spark, sf_dir).select("url").distinct()
    found = table.joined(known.unionByName(known.select(F.concat("url", F.lit("/new")).alias("url"))))
    return found.select("url", "cached", "row.content_hash", "row.status_code", "row.category")


_NESTED = """j AS (SELECT doc_id, text, lang, n_chars, doc_id % 4 AS m FROM documents),
    p AS (SELECT 'info.lang' AS field_name, 'string' AS data_type, lang AS v, doc_id FROM j WHERE m <> 0
        UNION ALL SELECT 'info.size', 'bigint', CAST(n_chars AS VARCHAR), doc_id FROM j WHERE m <> 0
        UNION ALL SELECT 'info.tags[]', 'string', unnest([lang, 't' || m]), doc_id FROM j WHERE m <> 0
        UNION ALL SELECT 'info.deep.' || (['a', 'b'])[CAST(m % 2 + 1 AS BIGINT)], 'boolean', 'true', doc_id FROM j WHERE m <> 0
        UNION ALL SELECT 'marks.' || lang, 'bigint', CAST(doc_id AS VARCHAR), doc_id FROM j
        UNION ALL SELECT 'doc_id', 'bigint', CAST(doc_id AS VARCHAR), doc_id FROM j)"""


@query(f"WITH {_NESTED} SELECT field_name, round(count(DISTINCT doc_id) / (SELECT count(*) FROM documents), 6) AS presence_rate, any_value(data_type) AS data_type, count(*) AS n_values, round(avg(length(v)), 6) AS avg_length, min(TRY_CAST(v AS DOUBLE)) FILTER (data_type = 'bigint') AS minimum, max(TRY_CAST(v AS DOUBLE)) FILTER (data_type = 'bigint') AS maximum FROM p GROUP BY field_name")
def nested_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paths of metadata in JSON and maps, from two halves of the table whose profiles are merged."""
    d, m = D.table(spark, sf_dir, "documents"), F.col("doc_id") % 4
    info = F.struct("lang", F.col("n_chars").alias("size"), F.array("lang", F.concat(F.lit("t"), m.cast("string"))).alias("tags"), F.create_map(F.when(m % 2 == 0, "a").otherwise("b"), F.lit(True)).alias("deep"))
    rows = d.select("doc_id", F.when(m == 0, F.lit("{broken")).otherwise(F.to_json(info)).alias("info"), F.create_map("lang", "doc_id").alias("marks"))
    halves = [profiles.nested_profile(rows.where(F.col("doc_id") % 2 == k), ["info"]) for k in (0, 1)]
    out = profiles.described(profiles.merged(*halves))
    return out.select("field_name", F.round("presence_rate", 6).alias("presence_rate"), "data_type", "n_values", F.round("avg_length", 6).alias("avg_length"), "minimum", "maximum")
