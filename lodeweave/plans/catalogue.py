"""Every registered query of the library, by name, with its SQL twin where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.functions import html as H
from lodeweave.functions import retry as R
from lodeweave.functions import text as T
from lodeweave.functions import urls as U
from lodeweave.operators import cache as C
from lodeweave.functions import mail as M
from lodeweave.operators import chunks, crawl, dedupe, metrics, reports, retrieval
from lodeweave.plans import ingest
from lodeweave.plans import stores
from lodeweave.plans import tables as D
from lodeweave.plans.registry import ORACLE_SQL, QUERIES, query

def now():
    return F.lit(D.NOW).cast("timestamp")


SQL_NOW = f"TIMESTAMP '{D.NOW}'"
SQL_AGE = f"CAST(floor((epoch_us({SQL_NOW}) - epoch_us(last_scraped)) / 86400000000) AS BIGINT)"
SQL_MAX_AGE = f"CASE WHEN {' OR '.join(f'contains(lower(url), {D.quoted(k)})' for k in U.CACHE_AGE[1])} THEN 1 WHEN {' OR '.join(f'contains(lower(url), {D.quoted(k)})' for k in U.CACHE_AGE[90])} THEN 90 {' '.join(f'WHEN lower(category) = {D.quoted(k)} THEN {v}' for k, v in U.CATEGORY_AGE.items())} ELSE {U.DEFAULT_AGE} END"
SQL_FRESH = f"(epoch_us({SQL_NOW}) - epoch_us(last_scraped) < ({SQL_MAX_AGE}) * 86400000000)"


# Retrieval


def _first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    row = D.table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()
    return list(row[0]) if row else []


def _store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.table(spark, sf_dir, "embeddings").withColumn("collection", F.col("label").cast("string"))


_DISTANCE = "1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0))"


@query(f"""WITH d AS (SELECT vec_id, CAST(label AS VARCHAR) AS collection, {_DISTANCE} AS distance FROM embeddings),
    b AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY collection ORDER BY distance, vec_id) <= 3),
    t AS (SELECT *, CAST(row_number() OVER (ORDER BY distance, collection, vec_id) AS INTEGER) AS rank FROM b)
    SELECT vec_id, collection, rank, round(greatest(0, 1 - distance), 6) AS relevance FROM t WHERE rank <= 5 AND greatest(0, 1 - distance) > 0.1""")
def rag_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = retrieval.across_collections(_store(spark, sf_dir), _first_vector(spark, sf_dir), "vec_id")
    return hits.select("vec_id", "collection", "rank", F.round("relevance", 6).alias("relevance"))


@query(f"""WITH d AS (SELECT vec_id, {_DISTANCE} AS distance FROM embeddings WHERE label = 3), t AS (SELECT * FROM d ORDER BY distance, vec_id LIMIT 10)
    SELECT vec_id, round(1 - distance, 6) AS score FROM t WHERE 1 - distance >= 0.1""")
def vector_search_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = retrieval.search(_store(spark, sf_dir), _first_vector(spark, sf_dir), 10, F.col("label") == 3, key="vec_id")
    return hits.select("vec_id", F.round("score", 6).alias("score"))


@query(f"""WITH d AS (SELECT vec_id, CAST(label AS VARCHAR) AS collection, {_DISTANCE} AS distance FROM embeddings),
    b AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY collection ORDER BY distance, vec_id) <= 3),
    t AS (SELECT *, row_number() OVER (ORDER BY distance, collection, vec_id) AS rank FROM b),
    h AS (SELECT rank, 'Result ' || rank || ' (source: https://host.test) [from ' || collection || ']:' || chr(10) || 'vector ' || vec_id AS block FROM t WHERE rank <= 5 AND greatest(0, 1 - distance) > 0.1)
    SELECT CASE WHEN count(*) = 0 THEN 'Nothing that was found on ''Bewerbung für höhere Fachsemester'' is relevant enough.' ELSE 'Found in the knowledge base (collections: 0, 1):' || chr(10) || chr(10)
        || string_agg(block, chr(10) || chr(10) ORDER BY rank) || chr(10) || chr(10) || {D.quoted(retrieval.AnswerText().hint)} END AS answer FROM h""")
def rag_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = retrieval.across_collections(_store(spark, sf_dir), _first_vector(spark, sf_dir), "vec_id")
    rows = hits.withColumns({"text": F.concat(F.lit(" vector "), F.col("vec_id").cast("string")), "title": F.lit(""), "source_url": F.lit("https://host.test")})
    return retrieval.answer(rows, "Bewerbung für höhere Fachsemester", ["0", "1"])


@query("SELECT CAST(label AS VARCHAR) AS collection, count(*) AS document_count FROM embeddings GROUP BY 1")
def collection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir).groupBy("collection").agg(F.count("*").alias("document_count"))


@query(f"""WITH w AS (SELECT doc_id, unnest({D.sql_words('lower(text)')}) AS w FROM documents), h AS (SELECT doc_id, CAST('0x' || md5(w)[1:8] AS BIGINT) AS h FROM w),
    v AS (SELECT doc_id, h % 64 AS d, CAST(sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END) AS DOUBLE) AS x FROM h GROUP BY ALL), n AS (SELECT doc_id, sqrt(sum(x * x)) AS n FROM v GROUP BY doc_id),
    s AS (SELECT v.doc_id AS id, sum(v.x * q.x) / any_value(a.n) / any_value(b.n) AS score FROM v JOIN v q ON q.doc_id = 0 AND q.d = v.d JOIN n a ON a.doc_id = v.doc_id JOIN n b ON b.doc_id = 0 WHERE a.n > 0 AND b.n > 0 GROUP BY v.doc_id)
    SELECT id, round(score, 4) AS score FROM s WHERE score >= 0.1 ORDER BY s.score DESC, id LIMIT 10""")
def embedded_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents embedded by the default provider, and the nearest to document 0's text."""
    embed = retrieval.PROVIDERS["hashing"](64)
    rows = D.docs(spark, sf_dir).select(F.col("doc_id").alias("id"), embed(F.col("text")).alias("embedding"))
    first = rows.where("id = 0").select("embedding").first()
    return retrieval.search(rows, list(first[0]) if first else [0.0] * 64, 10).select("id", F.round("score", 4).alias("score"))


# Text


@query(f"""WITH c AS (SELECT doc_id, {D.sql_clean('text')} AS t FROM documents), w AS (SELECT doc_id, t, {D.sql_words('t')} AS w FROM c)
    SELECT doc_id, length(t) AS char_count, CAST(len(w) AS INTEGER) AS word_count, md5(t) AS digest,
    length(t) >= 100 AND len(w) >= 20 AND list_sum(list_transform(w, lambda x: length(x))) / len(w) >= 3 AS is_substantial FROM w""")
def clean_text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.docs(spark, sf_dir).select("doc_id", T.clean_text(F.col("text")).alias("t"))
    return rows.select("doc_id", F.length("t").cast("long").alias("char_count"), T.word_count(F.col("t")).alias("word_count"), F.md5("t").alias("digest"), T.is_substantial(F.col("t")).alias("is_substantial"))


@query(f"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines, list_transform(string_split(text, chr(10)), lambda x: {D.sql_strip('x')}) AS bare FROM documents),
    k AS (SELECT doc_id, array_to_string(list_filter(lines, lambda x: length({D.sql_strip('x')}) <= 10 OR len(list_filter(bare, lambda b: b = {D.sql_strip('x')})) < 3), chr(10)) AS t FROM l)
    SELECT doc_id, length(t) AS n_chars, md5(t) AS digest FROM k""")
def dup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.docs(spark, sf_dir).select("doc_id", T.drop_repeated_lines(F.col("text")).alias("t"))
    return rows.select("doc_id", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("digest"))


@query("SELECT doc_id, CASE WHEN length(text) < 1000 THEN length(text) WHEN length(text) < 5000 THEN 1000 ELSE 1500 END AS size, length(text) > 500 AS is_long, CASE WHEN length(text) > 100 THEN text[1:100] || '...' ELSE text END AS preview FROM documents")
def text_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return D.docs(spark, sf_dir).select("doc_id", T.optimal_chunk_size(t).cast("long").alias("size"), T.is_long(t).alias("is_long"), T.preview(t, 100).alias("preview"))


@query(f"SELECT doc_id, array_to_string(list_filter([{', '.join('CASE WHEN ' + ' OR '.join(f'contains(lower(text), {D.quoted(k)})' for k in keys) + f' THEN {D.quoted(t)} END' for t, keys in T.TOPICS.items())}], lambda x: x IS NOT NULL), ',') AS topics FROM documents")
def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.docs(spark, sf_dir).select("doc_id", F.array_join(T.topics(F.col("text")), ",").alias("topics"))


@query(f"""WITH s AS (SELECT doc_id, text, regexp_extract(text[201:400], '^((?s:.*?)[.!?…](?:[''")\\]]+)?)({D.WS}|$)', 1) AS stop FROM documents)
    SELECT doc_id, md5(CASE WHEN length(text) <= 300 THEN text WHEN stop <> '' THEN regexp_replace(text[1:200] || stop, '{D.WS}+$', '') ELSE regexp_replace(text[1:200], '{D.WS}+$', '') || '…' END) AS digest FROM s""")
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.docs(spark, sf_dir).select("doc_id", F.md5(T.trim_snippet(F.col("text"), gate=300)).alias("digest"))


def _sql_page_text(key: str, texts: str) -> str:
    """(key, t): the phrases of a table's texts on lines of their own, as CTE p."""
    return f"""p AS (SELECT {key}, array_to_string(list_filter(flatten(list_transform(regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e]'), lambda l: list_transform(string_split({D.sql_strip('l')}, '  '), lambda x: {D.sql_strip('x')}))), lambda x: x <> ''), chr(10)) AS t FROM {texts})"""


_CUT = "CASE WHEN length(t) > 2000 THEN t[1:2000] || '... (Text gekürzt)' ELSE t END"


@query(f"WITH {_sql_page_text('doc_id', 'documents')} SELECT doc_id, md5({_CUT}) AS digest FROM p")
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.docs(spark, sf_dir).select("doc_id", F.md5(T.page_text(F.col("text"))).alias("digest"))


@query("WITH a AS (SELECT doc_id, (['a.b@host.de', 'bad@host', 'x@y.org ', '@host.de', 'ok+1@sub.host.com'])[CAST(doc_id % 5 + 1 AS BIGINT)] AS address FROM documents) SELECT doc_id, regexp_matches(address, '^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}$') AS valid FROM a")
def email_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    address = D.pick(["a.b@host.de", "bad@host", "x@y.org ", "@host.de", "ok+1@sub.host.com"], F.col("doc_id"))
    return D.docs(spark, sf_dir).select("doc_id", T.is_email(address).alias("valid"))


# De-duplication


@query(f"WITH h AS (SELECT doc_id, sha256({D.sql_strip('lower(text)')}) AS content_hash FROM documents) SELECT doc_id, content_hash, min(doc_id) OVER (PARTITION BY content_hash) AS first_id FROM h")
def exact_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return dedupe.exact_duplicates(rows).withColumnRenamed("id", "doc_id")


#: Shingles of a list w; zipped with itself, since a lambda that reads w would get a copy of it for every word.
_SHINGLES = "CASE WHEN len(w) < 3 THEN [] ELSE list_distinct(list_transform(list_zip(w, w[2:], w[3:])[:len(w) - 2], lambda z: z[1] || ' ' || z[2] || ' ' || z[3])) END"


@query(f"WITH w AS (SELECT doc_id, {D.sql_words('lower(text)')} AS w FROM documents), s AS (SELECT doc_id, {_SHINGLES} AS s FROM w) SELECT doc_id, CAST(len(s) AS INTEGER) AS n_shingles, md5(coalesce(array_to_string(list_sort(s), ''), '')) AS shingle_hash FROM s")
def shingle_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.docs(spark, sf_dir)
    return rows.select("doc_id", F.size(T.shingles(F.col("text"))).alias("n_shingles"), T.shingle_hash(F.col("text")).alias("shingle_hash"))


@query(f"""WITH f AS (SELECT doc_id, {D.sql_words('lower(text)')} AS w FROM documents), c AS (SELECT doc_id, {D.sql_words('lower(text[1:5000])')} AS w FROM documents),
    a AS (SELECT doc_id, {_SHINGLES} AS s FROM f), b AS (SELECT doc_id, {_SHINGLES} AS s FROM c),
    x AS (SELECT doc_id AS i, len(s) AS n, unnest(s) AS g FROM a), y AS (SELECT doc_id AS j, len(s) AS m, unnest(s) AS g FROM b),
    p AS (SELECT i, j, count(*) AS k, any_value(n) AS n, any_value(m) AS m FROM x JOIN y USING (g) WHERE j < i GROUP BY i, j)
    SELECT i, j, round(k / (n + m - k), 6) AS jaccard FROM p WHERE k / (n + m - k) >= 0.85""")
def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return dedupe.near_pairs(rows).select("i", "j", F.round("jaccard", 6).alias("jaccard"))


ORACLE_SQL["minhash_recall"] = f"SELECT count(*) AS pairs, CAST(0 AS BIGINT) AS wrong, true AS reached FROM ({ORACLE_SQL['near_dup_pairs']})"
_GREEDY = f"""WITH RECURSIVE f AS (SELECT doc_id, {D.sql_strip('lower(text)')} AS h, {D.sql_words('lower(text)')} AS w FROM documents), c AS (SELECT doc_id, {D.sql_words('lower(text[1:5000])')} AS w FROM documents),
    a AS (SELECT doc_id, h, {_SHINGLES} AS s FROM f), b AS (SELECT doc_id, {_SHINGLES} AS s FROM c),
    x AS (SELECT doc_id AS i, len(s) AS n, unnest(s) AS g FROM a), y AS (SELECT doc_id AS j, len(s) AS m, unnest(s) AS g FROM b),
    p AS (SELECT i, j, count(*) AS k, any_value(n) AS n, any_value(m) AS m FROM x JOIN y USING (g) WHERE j < i GROUP BY i, j),
    e AS (SELECT i, j, false AS exact, k / (n + m - k) AS jaccard FROM p WHERE k / (n + m - k) >= 0.85
        UNION ALL SELECT a.doc_id, b.doc_id, false, 1.0 FROM a JOIN b ON b.doc_id < a.doc_id WHERE len(a.s) = 0 AND len(b.s) = 0
        UNION ALL SELECT a.doc_id, o.doc_id, true, NULL FROM a JOIN a o ON a.h = o.h AND o.doc_id < a.doc_id),
    o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r, coalesce((SELECT list(j) FROM e WHERE i = doc_id), []) AS js FROM documents),
    g AS (SELECT CAST(0 AS BIGINT) AS r, CAST([] AS BIGINT[]) AS kept UNION ALL SELECT o.r, CASE WHEN len(list_intersect(g.kept, o.js)) = 0 THEN list_append(g.kept, o.doc_id) ELSE g.kept END FROM g JOIN o ON o.r = g.r + 1),
    kept AS (SELECT unnest(kept) AS j FROM (SELECT kept FROM g ORDER BY r DESC LIMIT 1)),
    why AS (SELECT i, bool_or(exact) AS exact, min(j) FILTER (exact) AS same, min(j) FILTER (NOT exact) AS near, arg_min(jaccard, j) FILTER (NOT exact) AS jaccard FROM e JOIN kept USING (j) GROUP BY i),
    greedy AS (SELECT doc_id AS id, i IS NULL AS is_unique, CASE WHEN exact THEN same ELSE near END AS duplicate_of,
        CASE WHEN i IS NULL THEN NULL WHEN exact THEN 'exact_duplicate' ELSE 'near_duplicate' END AS reason, round(CASE WHEN NOT exact THEN jaccard END, 6) AS jaccard FROM documents LEFT JOIN why ON why.i = doc_id)"""


def _contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("text").alias("content"))


@query(f"{_GREEDY} SELECT * FROM greedy")
def greedy_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.greedy(_contents(spark, sf_dir)).withColumn("jaccard", F.round("jaccard", 6))


@query(f"{_GREEDY} SELECT count(*) AS total_seen, count(*) FILTER (is_unique) AS unique_urls, 0.85 :: DOUBLE AS similarity_threshold, 3 AS shingle_size FROM greedy")
def dedupe_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.statistics(greedy_dedupe(spark, sf_dir))


@query(f"{_GREEDY} SELECT id, CASE WHEN reason = 'near_duplicate' THEN printf('near_duplicate_%.2f', jaccard) ELSE reason END AS duplicate_reason, duplicate_of FROM greedy WHERE NOT is_unique")
def dedupe_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table in batches, each judged against what an index on disk holds of those before it."""
    judged = stores.batches_through_an_index(spark, _contents(spark, sf_dir)).where("NOT is_unique")
    detail = F.when(F.col("reason") == "near_duplicate", F.format_string("near_duplicate_%.2f", "jaccard")).otherwise(F.col("reason"))
    return judged.select("id", detail.alias("duplicate_reason"), "duplicate_of")


@query(f"{_GREEDY} SELECT 'duplicate_' || reason AS name, count(*) AS cnt FROM greedy WHERE NOT is_unique GROUP BY 1 UNION ALL SELECT 'duplicates_removed', count(*) FROM greedy WHERE NOT is_unique")
def duplicate_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.duplicate_metrics(greedy_dedupe(spark, sf_dir))


# Addresses

_NETLOC = "regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)"
_PATH = "regexp_replace(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1), ';[^/]*$', '')"
_PARTS = f"list_filter(string_split({_PATH}, '/'), lambda p: p <> '')"
_QUERY = "regexp_extract(url, '^[^?#]*\\?([^#]*)', 1)"


@query(f"""WITH {D.ADDRESSES} SELECT doc_id, {D.sql_first_match('lower(url)', [(k, c) for c, k in U.CATEGORIES.items()], U.NO_CATEGORY)} AS category,
    CASE WHEN contains(url, '/de') THEN 'de' WHEN contains(url, '/en') THEN 'en' ELSE 'unknown' END AS language, {_NETLOC} AS netloc, array_to_string({_PARTS}, '/') AS url_path, CAST(len({_PARTS}) AS INTEGER) AS url_depth,
    lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) || '://' || {_NETLOC} || {_PATH} || CASE WHEN {_QUERY} <> '' THEN '?' || {_QUERY} ELSE '' END AS normalised FROM addresses""")
def url_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return D.addresses(spark, sf_dir).select("doc_id", U.category(u).alias("category"), U.language(u).alias("language"), U.netloc(u).alias("netloc"), U.url_path(u).alias("url_path"), U.url_depth(u).alias("url_depth"), U.normalised(u).alias("normalised"))


@query(f"""WITH {D.ADDRESSES} SELECT doc_id, string_split({_PATH}, '/')[-1] AS filename, replace(string_split({_PATH}, '/')[-1], '.pdf', '') || '_' || md5(url)[1:12] || '.pdf' AS pdf_filename,
    {D.sql_first_match('lower(url)', [([k], v) for k, v in U.PROGRAMMES.items()])} AS programme, {D.sql_first_match('lower(url)', [(k, v) for v, k in U.DOCUMENT_TYPES.items()])} AS document_type,
    {D.sql_first_match('lower(url)', [(k, v) for v, k in U.DEGREES.items()])} AS degree FROM addresses""")
def pdf_url_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return D.addresses(spark, sf_dir).select("doc_id", U.filename(u).alias("filename"), U.pdf_filename(u).alias("pdf_filename"), U.study_programme(u).alias("programme"), U.document_type(u).alias("document_type"), U.degree(u).alias("degree"))


_ALLOWED = f"{_NETLOC} IN ('host.test', 'en.other.test') AND {' AND '.join(f'NOT regexp_matches(lower(url), {D.quoted(p)})' for p in U.EXCLUDED)}"


@query(f"WITH {D.ADDRESSES} SELECT doc_id, {_ALLOWED} AS allowed, CASE WHEN lower(url) LIKE '%.pdf' THEN CASE WHEN {_NETLOC} IN ('host.test', 'en.other.test') THEN 'pdf' END WHEN {_ALLOWED} THEN 'page' END AS kind FROM addresses")
def allowed_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    domains = ["host.test", "en.other.test"]
    return D.addresses(spark, sf_dir).select("doc_id", U.is_allowed(F.col("url"), domains).alias("allowed"), U.link_kind(F.col("url"), domains).alias("kind"))


@query(f"SELECT {D.sql_first_match('lower(url)', [(k, c) for c, k in U.CATEGORIES.items()], U.NO_CATEGORY)} AS category, count(*) AS cnt FROM pages GROUP BY 1")
def page_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.table(spark, sf_dir, "pages").groupBy(U.category(F.col("url")).alias("category")).agg(F.count("*").alias("cnt"))


@query(f"WITH {D.ADDRESSES} SELECT {D.sql_first_match('lower(url)', [(k, c) for c, k in U.CATEGORIES.items()], U.NO_CATEGORY)} AS category, count(*) AS cnt FROM addresses GROUP BY 1")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.addresses(spark, sf_dir).groupBy(U.category(F.col("url")).alias("category")).agg(F.count("*").alias("cnt"))


@query(f"WITH {D.ADDRESSES} SELECT doc_id, sha256(url || '#' || doc_id % 7)[1:16] AS id FROM addresses")
def doc_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.addresses(spark, sf_dir).select("doc_id", U.document_id(F.col("url"), F.col("doc_id") % 7).alias("id"))


@query(f"WITH {D.ADDRESSES} SELECT doc_id, CASE WHEN contains({_NETLOC}, 'host') THEN 'own' ELSE 'Externe Quelle: ' || {_NETLOC} END AS label FROM addresses")
def source_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.addresses(spark, sf_dir).select("doc_id", U.source_label(F.col("url"), "host", "own").alias("label"))


# Cache


def _cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.latest(D.fetch_log(spark, sf_dir), ["last_scraped", "event_id"])


def _urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses known to the cache and new ones."""
    known = _cache(spark, sf_dir).select("url")
    return known.unionByName(known.select(F.concat("url", F.lit("/new")).alias("url")))


_URLS = f"{D.CACHE}, urls AS (SELECT url FROM cache UNION ALL SELECT url || '/new' FROM cache), j AS (SELECT urls.url, cache.url IS NOT NULL AS cached, content_hash, last_scraped, success, category FROM urls LEFT JOIN cache ON urls.url = cache.url)"


@query(f"WITH {D.CACHE} SELECT url, event_id, content_hash, success, status_code, category FROM cache")
def cache_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cache(spark, sf_dir).select("url", "event_id", "content_hash", "success", "status_code", "category")


@query(f"WITH {D.CACHE} SELECT count(*) AS total, count(*) FILTER (success) AS successful, count(*) FILTER (NOT success) AS failed, count(*) FILTER ({SQL_FRESH}) AS fresh, count(*) FILTER (NOT {SQL_FRESH}) AS expired FROM cache")
def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.statistics(_cache(spark, sf_dir), now())


@query(f"WITH {D.CACHE} SELECT category, count(*) AS cnt, repeat('█', CAST(floor(count(*) / 5) AS INTEGER)) AS bar FROM cache GROUP BY category")
def cache_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.category_bars(_cache(spark, sf_dir))


@query(f"WITH {D.CACHE} SELECT url, {SQL_AGE} AS age_days, CAST({SQL_MAX_AGE} AS INTEGER) AS max_age_days, {SQL_FRESH} AS fresh FROM cache")
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cache(spark, sf_dir).select("url", C.age_days(now(), F.col("last_scraped")).alias("age_days"), U.max_age_days(F.col("url"), F.col("category")).alias("max_age_days"), C.is_fresh(now()).alias("fresh"))


@query(f"WITH {_URLS} SELECT url, NOT cached OR NOT coalesce({SQL_FRESH}, false) AS should_scrape FROM j")
def cache_should_scrape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.should_scrape(_urls(spark, sf_dir), _cache(spark, sf_dir), now())


_DAYS = D.sql_first_match("lower(url)", [(k, d) for k, d, _ in U.REFETCH], U.REFETCH_ELSE[0])
_STALE = f"epoch_us({SQL_NOW}) - epoch_us(last_scraped) >= ({_DAYS}) * 86400000000"


@query(f"""WITH {_URLS}, r AS (SELECT *, CASE WHEN NOT cached THEN 'new' WHEN NOT success THEN 'failed_before' WHEN {_STALE} THEN 'expired' ELSE 'skipped' END AS bucket, {SQL_AGE} AS age FROM j)
    SELECT url, bucket <> 'skipped' AS should_scrape, CASE bucket WHEN 'new' THEN 'new_url' WHEN 'failed_before' THEN 'previous_failure' WHEN 'expired' THEN 'expired_cache_' || age || 'd' ELSE 'fresh_cache_' || age || 'd' END AS reason,
    bucket, age AS age_days, CAST({_DAYS} AS INTEGER) AS max_age_days, {D.sql_first_match('lower(url)', [(k, p) for k, _, p in U.REFETCH], U.REFETCH_ELSE[1])} AS priority FROM r""")
def rescrape_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.decide(_urls(spark, sf_dir), _cache(spark, sf_dir), now())


@query(f"WITH {_URLS} SELECT CASE WHEN NOT cached THEN 'new' WHEN NOT success THEN 'failed_before' WHEN {_STALE} THEN 'expired' ELSE 'skipped' END AS bucket, count(*) AS cnt FROM j GROUP BY 1")
def bucket_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.bucket_counts(rescrape_plan(spark, sf_dir))


@query(f"""WITH {_URLS}, s AS (SELECT url, {D.sql_first_match('lower(url)', U.SCORES, U.BASE_SCORE)} + CASE WHEN NOT cached THEN 30 WHEN {SQL_AGE} > 90 THEN 20 WHEN {SQL_AGE} > 30 THEN 10 WHEN {SQL_AGE} < 7 THEN -20 ELSE 0 END AS s FROM j)
    SELECT url, CAST(least(100, greatest(0, s)) AS INTEGER) AS score FROM s""")
def priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.in_order(C.prioritised(_urls(spark, sf_dir), _cache(spark, sf_dir), now()))


@query(f"""WITH {D.FETCH_LOG}, cache AS (SELECT * FROM fetch_log WHERE event_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY url ORDER BY last_scraped DESC, event_id DESC) = 1),
    d AS (SELECT url, content_hash AS h, word_count AS n FROM fetch_log QUALIFY row_number() OVER (PARTITION BY url ORDER BY last_scraped DESC, event_id DESC) = 1),
    j AS (SELECT d.url, n, c.word_count AS o, CASE WHEN c.url IS NULL THEN 'new' WHEN c.content_hash = sha256(d.h) THEN 'identical' ELSE 'modified' END AS change_type FROM d LEFT JOIN (SELECT url, word_count, sha256(content_hash) AS content_hash FROM cache) c ON d.url = c.url)
    SELECT url, change_type, change_type <> 'identical' AS changed, CASE WHEN change_type = 'modified' THEN o END AS word_count_old, CASE WHEN change_type = 'modified' THEN n END AS word_count_new,
    CASE WHEN change_type = 'modified' THEN n - o END AS word_diff, round(CASE WHEN change_type = 'modified' THEN CASE WHEN o > 0 THEN (n - o) / o * 100 ELSE 0 END END, 6) AS word_diff_pct FROM j""")
def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = D.fetch_log(spark, sf_dir)
    old = C.latest(log.where("event_id % 2 = 0"), ["last_scraped", "event_id"]).withColumn("content_hash", F.sha2("content_hash", 256))
    new = C.latest(log, ["last_scraped", "event_id"]).select("url", F.col("content_hash").alias("content"), "word_count")
    return C.changes(new, old).withColumn("word_diff_pct", F.round("word_diff_pct", 6))


@query(f"WITH {D.CACHE} SELECT url FROM cache WHERE url ILIKE '%NEWS%'")
def cache_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.search(_cache(spark, sf_dir), "NEWS").select("url")


@query(f"WITH {D.CACHE} SELECT url, category FROM cache WHERE category IS DISTINCT FROM 'news'")
def invalidate_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.without_category(_cache(spark, sf_dir), "news").select("url", "category")


@query(f"WITH {D.CACHE} SELECT url FROM cache WHERE NOT (epoch_us(last_scraped) < epoch_us({SQL_NOW}) - 2 * 86400000000)")
def invalidate_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.without_older(_cache(spark, sf_dir), now(), 2).select("url")


@query(f"WITH {D.CACHE}, r AS (SELECT upper(coalesce(category, 'uncategorized')) AS category, count(*) AS cnt, array_to_string(list_sort(list(url))[1:15], ' ') AS urls FROM cache GROUP BY 1) SELECT * FROM r")
def cache_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.listing(_cache(spark, sf_dir)).withColumn("urls", F.array_join("urls", " "))


@query(f"WITH {D.CACHE} SELECT url, last_scraped FROM cache ORDER BY last_scraped DESC, url LIMIT 20")
def recent_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.recent(_cache(spark, sf_dir)).select("url", "last_scraped")


_STATS = f"SELECT count(*) AS total, count(*) FILTER (success) AS successful, count(*) FILTER (NOT success) AS failed, count(*) FILTER ({SQL_FRESH}) AS fresh, count(*) FILTER (NOT {SQL_FRESH}) AS expired FROM cache"
_STRATEGY = " UNION ALL ".join(f"SELECT {1000 + i} AS pos, {D.quoted(f'{k}: {v}')} AS line" for i, (k, v) in enumerate(sorted(U.CATEGORY_AGE.items())))


@query(f"""WITH {D.CACHE}, s AS ({_STATS}), c AS (SELECT category, count(*) AS cnt FROM cache WHERE category <> '' GROUP BY category)
    SELECT pos, line FROM (SELECT 0 AS pos, 'total: ' || total AS line FROM s UNION ALL SELECT 1, 'successful: ' || successful FROM s UNION ALL SELECT 2, 'failed: ' || failed FROM s UNION ALL SELECT 3, 'fresh: ' || fresh FROM s
    UNION ALL SELECT 4, 'expired: ' || expired FROM s UNION ALL SELECT 100 + CAST(row_number() OVER (ORDER BY cnt DESC, category) AS INTEGER), category || ': ' || cnt FROM c UNION ALL {_STRATEGY})""")
def cache_text_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.text_report(_cache(spark, sf_dir), now())


@query(f"WITH {D.FETCH_LOG} SELECT url, content_hash, last_scraped AS scraped_at, success FROM fetch_log")
def scrape_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.history(D.fetch_log(spark, sf_dir)).drop("error_message")


# Metrics


@query(f"""WITH {D.FETCH_LOG} SELECT count(*) AS urls_crawled, count(*) FILTER (success) AS urls_successful, count(*) FILTER (NOT success) AS urls_failed, round(avg(CAST(success AS INTEGER)), 6) AS success_share, round(avg(CAST(success AS INTEGER)) * 100, 6) AS success_rate,
    round(avg(response_time), 6) AS avg_response_time, CAST(floor(avg(content_size)) AS BIGINT) AS avg_content_size, CAST(sum(content_size) AS BIGINT) AS total_content_size, round(count(*) / 3600.0, 6) AS crawl_rate FROM fetch_log""")
def fetch_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.fetch_metrics(D.fetch_log(spark, sf_dir), F.lit(3600.0))
    return out.withColumns({c: F.round(c, 6) for c in ("success_share", "success_rate", "avg_response_time", "crawl_rate")})


@query(f"WITH {D.FETCH_LOG} SELECT error, count(*) AS cnt FROM fetch_log WHERE error IS NOT NULL GROUP BY error")
def error_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.counts_by(D.fetch_log(spark, sf_dir), "error")


@query(f"WITH {D.FETCH_LOG} SELECT status_code, count(*) AS cnt FROM fetch_log WHERE status_code <> 0 GROUP BY status_code")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.counts_by(D.fetch_log(spark, sf_dir), "status_code").orderBy("status_code")


@query(f"WITH {D.FETCH_LOG} SELECT 'pdf_' || error AS error, count(*) AS cnt FROM fetch_log WHERE error IS NOT NULL GROUP BY error")
def pdf_error_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.prefixed_errors(D.fetch_log(spark, sf_dir), "pdf")


@query(f"WITH {D.FETCH_LOG} SELECT count(*) AS pdfs_found, count(*) FILTER (success) AS pdfs_extracted, count(*) FILTER (NOT success) AS pdfs_failed FROM fetch_log")
def pdf_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.pdf_metrics(D.fetch_log(spark, sf_dir))


@query(f"WITH {D.FETCH_LOG} SELECT category, count(*) AS cnt FROM fetch_log WHERE category IS NOT NULL GROUP BY category ORDER BY cnt DESC, category LIMIT 3")
def category_counts_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.top_counts(D.fetch_log(spark, sf_dir), "category", 3)


@query(f"WITH {D.FETCH_LOG} SELECT event_id, url, success FROM fetch_log ORDER BY event_id DESC LIMIT 100")
def last_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.last_rows(D.fetch_log(spark, sf_dir), "event_id").select("event_id", "url", "success")


@query(f"""WITH d AS (SELECT doc_id % 7 <> 0 AS ok, text, CAST(len({D.sql_words('text')}) AS BIGINT) AS n, source FROM documents)
    SELECT count(*) AS total, count(*) FILTER (ok) AS successful, count(*) FILTER (NOT ok) AS failed, round(avg(CAST(ok AS INTEGER)), 6) AS success_rate, round(avg(length(text)) FILTER (ok), 6) AS avg_content_length,
    CAST(sum(n) FILTER (ok) AS BIGINT) AS total_words, count(DISTINCT source) FILTER (ok) AS unique_domains FROM d""")
def scrape_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.table(spark, sf_dir, "documents").select((F.col("doc_id") % 7 != 0).alias("success"), F.col("text").alias("content"), T.word_count(F.col("text")).alias("word_count"), F.col("source").alias("domain"))
    return metrics.scrape_statistics(rows).withColumns({c: F.round(c, 6) for c in ("success_rate", "avg_content_length")})


@query("SELECT conv_id, count(*) AS total, count(*) FILTER (role = 'user') AS human, count(*) FILTER (role = 'assistant') AS ai FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id")
def memory_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.conversation_summary(D.table(spark, sf_dir, "conversations"))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations WHERE role IN ('user', 'assistant')) SELECT conv_id, turn, role, CASE WHEN length(text) > 100 THEN text[1:100] || '...' ELSE text END AS preview FROM r WHERE k <= 5")
def recent_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.recent_messages(D.table(spark, sf_dir, "conversations"))


@query("""SELECT 'doc_id' AS field_name, count(doc_id) / count(*) AS presence_rate, 'bigint' AS data_type FROM documents UNION ALL SELECT 'text', count(*) FILTER (text IS NOT NULL AND text <> '') / count(*), 'string' FROM documents
    UNION ALL SELECT 'lang', count(*) FILTER (lang IS NOT NULL AND lang <> '') / count(*), 'string' FROM documents UNION ALL SELECT 'source', count(*) FILTER (source IS NOT NULL AND source <> '') / count(*), 'string' FROM documents
    UNION ALL SELECT 'n_chars', count(n_chars) / count(*), 'bigint' FROM documents""")
def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.profile(D.table(spark, sf_dir, "documents")).drop("avg_length")


_RATES = "[count(doc_id) / count(*), count(*) FILTER (text <> '') / count(*), count(*) FILTER (lang <> '') / count(*), count(*) FILTER (source <> '') / count(*), count(n_chars) / count(*)]"


@query(f"""WITH r AS (SELECT count(*) AS total_documents, avg(length(text)) AS l, count(DISTINCT source) AS unique_sources, list_avg({_RATES}) AS c FROM documents)
    SELECT total_documents, round(l, 6) AS avg_text_length, unique_sources, round(c, 6) AS avg_completeness,
    array_to_string(list_filter([CASE WHEN c < 0.8 THEN 'fill missing fields' END, CASE WHEN l > 1500 THEN 'chunk long texts' END, CASE WHEN unique_sources < 2 THEN 'add sources' END], lambda x: x IS NOT NULL), '; ') AS optimization_suggestions FROM r""")
def profile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.profile_summary(D.table(spark, sf_dir, "documents"), "text", "source")
    return out.withColumns({c: F.round(c, 6) for c in ("avg_text_length", "avg_completeness")})


@query("""WITH f AS (SELECT unnest(['doc_id', 'text', 'lang', 'source', 'n_chars']) AS field_name, unnest(['bigint', 'string', 'string', 'string', 'bigint']) AS kind, unnest(%s) AS rate FROM documents)
    SELECT field_name, '| ' || field_name || ' | ' || kind || ' | ' || printf('%%.2f', rate) || ' |' AS line FROM f""" % _RATES)
def profile_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.profile_lines(metrics.profile(D.table(spark, sf_dir, "documents")))


# Retries


@query("""WITH r AS (SELECT event_id, (['connection', 'timeout', 'response', 'other'])[CAST(event_id % 4 + 1 AS BIGINT)] AS kind, ([404, 403, 429, 500, 503, 418])[CAST(event_id % 6 + 1 AS BIGINT)] AS status, event_id % 8 AS n FROM events)
    SELECT event_id, least(pow(2.0, n), 60.0) AS delay, CAST(2 * (n + 1) AS DOUBLE) AS linear, kind IN ('connection', 'timeout') OR (kind = 'response' AND status >= 500) AS retryable,
    CASE kind WHEN 'connection' THEN 'connection_error' WHEN 'timeout' THEN 'timeout' WHEN 'response' THEN CASE WHEN status = 404 THEN 'not_found' WHEN status = 403 THEN 'forbidden' WHEN status = 429 THEN 'rate_limited' WHEN status >= 500 THEN 'server_error' ELSE 'http_' || status END ELSE 'unknown_error' END AS error FROM r""")
def retry_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = D.table(spark, sf_dir, "events")
    kind, n = D.pick(["connection", "timeout", "response", "other"], F.col("event_id")), F.col("event_id") % 8
    status = F.element_at(F.array(*[F.lit(x) for x in (404, 403, 429, 500, 503, 418)]), (F.col("event_id") % 6 + 1).cast("int"))
    return e.select("event_id", R.backoff(n, R.RetryConfig(jitter=False)).alias("delay"), R.linear_backoff(n).alias("linear"), R.is_retryable(kind, status).alias("retryable"), R.error_name(kind, status).alias("error"))


# Chunks


_DONE = f"CASE WHEN a.now <> '' THEN list_append(a.done, {D.sql_strip('a.now')}) ELSE a.done END"
_LONGER = "CASE WHEN a.now <> '' THEN a.now || '. ' || b.now ELSE b.now END"
_FOLD = f"""list_reduce(list_transform(string_split(text, '. '), lambda x: {{'done': CAST([] AS VARCHAR[]), 'now': x}}), lambda a, b: {{'done': CASE WHEN length({_LONGER}) <= 1500 THEN a.done ELSE {_DONE} END,
    'now': CASE WHEN length({_LONGER}) <= 1500 THEN {_LONGER} WHEN len({_DONE}) > 0 THEN right(a.now, 300) || '. ' || b.now ELSE b.now END}})"""
#: Chunks of a table (key, text) by SQL.
_CHUNKS = f"""folded AS (SELECT key, {_FOLD} AS s FROM texts), packed AS (SELECT key, CASE WHEN s.now <> '' THEN list_append(s.done, {D.sql_strip('s.now')}) ELSE s.done END AS chunks FROM folded),
    chunked AS (SELECT key, CAST(len(chunks) AS INTEGER) AS total_chunks, CAST(unnest(range(len(chunks))) AS INTEGER) AS chunk_index, unnest(chunks) AS chunk FROM packed)"""


@query(f"WITH texts AS (SELECT doc_id AS key, text FROM documents), {_CHUNKS} SELECT key AS doc_id, chunk_index, chunk AS text FROM chunked")
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.docs(spark, sf_dir).select("doc_id", F.posexplode(chunks.packed(F.col("text"))).alias("chunk_index", "text"))


_STORED = f"""WITH {D.ADDRESSES}, texts AS (SELECT url AS key, text FROM documents JOIN addresses USING (doc_id) WHERE {D.sql_strip('text')} <> '' AND doc_id % 9 <> 0), {_CHUNKS},
    stored AS (SELECT sha256(key || '#' || chunk_index)[1:16] AS id, key AS source_url, chunk AS text, chunk_index, total_chunks, {D.sql_first_match('lower(key)', [(k, c) for c, k in U.CATEGORIES.items()], U.NO_CATEGORY)} AS category FROM chunked)"""


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store rows of all documents as pages with made-up addresses; every ninth failed to load."""
    pages = D.docs(spark, sf_dir).join(D.addresses(spark, sf_dir), "doc_id")
    return chunks.stored_chunks(pages.select("url", F.col("text").alias("content"), U.category(F.col("url")).alias("category"), F.lit("t").alias("title"), (F.col("doc_id") % 9 != 0).alias("success")))


@query(f"{_STORED} SELECT id, source_url, md5(text) AS digest, chunk_index, total_chunks FROM stored")
def stored_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir).select("id", "source_url", F.md5("text").alias("digest"), "chunk_index", "total_chunks")


@query(f"{_STORED} SELECT category, count(*) AS chunks FROM stored GROUP BY category")
def chunks_per_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.chunks_per_category(_stored(spark, sf_dir))


@query(f"""{_STORED} SELECT id, md5('ID: ' || id || chr(10) || 'Source: ' || source_url || chr(10) || 'Chunk: ' || (chunk_index + 1) || '/' || total_chunks || chr(10) || 'Length: ' || length(text) || ' characters' || chr(10) || 'Title: t' || chr(10)
    || repeat('-', 50) || chr(10) || text || chr(10) || repeat('-', 50)) AS digest FROM stored""")
def chunk_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.chunk_lines(_stored(spark, sf_dir)).select("id", F.md5("line").alias("digest"))


@query(f"""{_STORED}, one AS (SELECT count(*) AS document_count FROM stored) SELECT document_count, 'documents' AS collection_name, 'hashing' AS embedding_provider, 1500 AS chunk_size FROM one""")
def store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.store_statistics(_stored(spark, sf_dir), retrieval.StoreConfig())


def _sql_sentences(x: str) -> str:
    """The chunks of a paragraph that is too long, as a fold over its sentences."""
    pieces = f"list_filter(list_transform(string_split(regexp_replace({x}, '([.!?]){D.WS}+', '\\1' || chr(1), 'g'), chr(1)), lambda y: {D.sql_strip('y')}), lambda y: y <> '')"
    full = "a.used + b.used > 1500"
    fold = f"""list_reduce(list_transform({pieces}, lambda y: {{'done': CAST([] AS VARCHAR[]), 'now': [y], 'used': length(y)}}), lambda a, b: {{'done': CASE WHEN {full} THEN list_append(a.done, array_to_string(a.now, ' ')) ELSE a.done END,
        'now': CASE WHEN {full} THEN [right(a.now[-1], 300), b.now[1]] ELSE list_append(a.now, b.now[1]) END, 'used': CASE WHEN {full} THEN length(right(a.now[-1], 300)) + b.used ELSE a.used + b.used END}})"""
    return f"list_transform([{fold}], lambda s: list_append(s.done, array_to_string(s.now, ' ')))[1]"


def _sql_paragraphs(x: str) -> str:
    """The chunks of a text by paragraphs, as a fold over them; what is left at the end joins the chunk before if it is short."""
    own = f"list_transform(list_filter(list_transform(string_split(regexp_replace({x}, '\\n{D.WS}*\\n', chr(1), 'g'), chr(1)), lambda p: {D.sql_strip('p')}), lambda p: p <> ''), lambda p: {{'done': CASE WHEN length(p) > 1500 THEN {_sql_sentences('p')} ELSE CAST([] AS VARCHAR[]) END, 'now': [p], 'used': length(p)}})"
    long_, full = "b.used > 1500", "len(a.now) > 0 AND a.used + b.used > 1500"
    closed = "CASE WHEN len(a.now) > 0 THEN list_append(a.done, array_to_string(a.now, chr(10) || chr(10))) ELSE a.done END"
    fold = f"""list_reduce({own}, lambda a, b: {{'done': CASE WHEN {long_} THEN list_concat({closed}, b.done) WHEN {full} THEN {closed} ELSE a.done END,
        'now': CASE WHEN {long_} THEN CAST([] AS VARCHAR[]) WHEN {full} THEN [right(a.now[-1], 300), b.now[1]] ELSE list_append(a.now, b.now[1]) END,
        'used': CASE WHEN {long_} THEN 0 WHEN {full} THEN length(right(a.now[-1], 300)) + b.used ELSE a.used + b.used END}}, {{'done': CAST([] AS VARCHAR[]), 'now': CAST([] AS VARCHAR[]), 'used': 0}})"""
    tail = "array_to_string(s.now, chr(10) || chr(10))"
    return f"list_transform([{fold}], lambda s: CASE WHEN len(s.now) = 0 THEN s.done WHEN length({tail}) >= 200 THEN list_append(s.done, {tail}) WHEN len(s.done) > 0 THEN list_append(s.done[:-2], s.done[-1] || chr(10) || chr(10) || {tail}) ELSE s.done END)[1]"


def _sql_chunk_rows(made: str, text: str) -> str:
    return f"WITH t AS (SELECT doc_id, {text} AS text FROM documents), c AS (SELECT doc_id, {made} AS c FROM t) SELECT doc_id, unnest(c) AS text, CAST(NULL AS VARCHAR) AS header, 0 AS header_level, CAST(unnest(range(len(c))) AS INTEGER) AS chunk_index, CAST(len(c) AS INTEGER) AS total FROM c"


@query(_sql_chunk_rows(_sql_paragraphs("text"), D.sql_clean("text")))
def chunk_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.docs(spark, sf_dir).withColumn("text", T.clean_text(F.col("text")))
    return chunks.exploded(rows, "text", preserve_headers=False)


@query(_sql_chunk_rows(_sql_paragraphs("text"), "replace(text, chr(10), chr(10) || chr(10))"))
def chunk_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.docs(spark, sf_dir).withColumn("text", F.regexp_replace("text", "\n", "\n\n"))
    return chunks.exploded(rows, "text", preserve_headers=False)


def _sql_sections(keys: str, texts: str) -> str:
    """(keys, text, header, header_level, chunk_index, total) of the sections below header lines, chunk by chunk, as CTE headed."""
    head = f"'^(#+){D.WS}+(.+)$'"
    return f"""lined AS (SELECT {keys}, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM {texts}),
    sectioned AS (SELECT *, regexp_matches(line, {head}) AS heads, count(*) FILTER (regexp_matches(line, {head})) OVER (PARTITION BY {keys} ORDER BY n) AS part FROM lined),
    sections AS (SELECT {keys}, part, max(CASE WHEN heads THEN regexp_extract(line, {head}, 2) END) AS header, coalesce(max(CASE WHEN heads THEN length(regexp_extract(line, {head}, 1)) END), 0) AS header_level,
        {D.sql_strip("coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT heads), '')")} AS text FROM sectioned GROUP BY {keys}, part),
    cut AS (SELECT {keys}, header, header_level, {_sql_paragraphs('text')} AS c FROM sections),
    headed AS (SELECT {keys}, unnest(c) AS text, header, CAST(header_level AS INTEGER) AS header_level, CAST(unnest(range(len(c))) AS INTEGER) AS chunk_index, CAST(len(c) AS INTEGER) AS total FROM cut)"""


@query(f"WITH t AS (SELECT doc_id, replace(text, chr(10), chr(10) || '# Part' || chr(10)) AS text FROM documents), {_sql_sections('doc_id', 't')} SELECT * FROM headed")
def chunk_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.docs(spark, sf_dir).withColumn("text", F.regexp_replace("text", "\n", "\n# Part\n"))
    return chunks.exploded(rows, "text")


# Pages


#: Elements without content, in SQL.
_VOID = ", ".join(D.quoted(t) for t in sorted(H.VOID))


def _sql_tree(removed: list[str]) -> str:
    """The pages' elements and strings by SQL, without what is removed: a fold over the tags pairs starts with ends."""
    tags = ", ".join(D.quoted(s) for s in removed if not s.startswith("."))
    classes = ", ".join(D.quoted(s[1:]) for s in removed if s.startswith("."))
    marked = f" OR list_has_any(classes, [{classes}])" if classes else ""
    return f"""bits AS (SELECT page_id, url, regexp_extract_all(html, '(?s)<!--.*?-->|<(?:script|style)\\b[^>]*>.*?</(?:script|style)>|<[^>]*>|[^<]+') AS bits FROM pages),
    tags AS (SELECT page_id, bits, list_filter(list_transform(bits, lambda b, i: {{'open': [{{'i': i, 't': lower(regexp_extract(b, '^</?([A-Za-z][A-Za-z0-9]*)', 1))}}], 'shut': CAST([] AS STRUCT(i BIGINT, j BIGINT)[]), 'ends': b LIKE '</%'}}),
        lambda x: x.open[1].t NOT IN ('', 'script', 'style', {_VOID})) AS tags FROM bits),
    paired AS (SELECT page_id, bits, list_reduce(tags, lambda a, b: CASE WHEN NOT b.ends THEN {{'open': list_append(a.open, b.open[1]), 'shut': a.shut, 'ends': false}}
        WHEN list_contains(list_transform(a.open, lambda x: x.t), b.open[1].t) THEN {{'open': a.open[:len(a.open) - list_position(list_reverse(list_transform(a.open, lambda x: x.t)), b.open[1].t)],
            'shut': list_concat(a.shut, list_transform(a.open[len(a.open) - list_position(list_reverse(list_transform(a.open, lambda x: x.t)), b.open[1].t) + 1:], lambda x: {{'i': x.i, 'j': b.open[1].i}})), 'ends': false}}
        ELSE a END, {{'open': CAST([] AS STRUCT(i BIGINT, t VARCHAR)[]), 'shut': CAST([] AS STRUCT(i BIGINT, j BIGINT)[]), 'ends': false}}) AS s FROM tags),
    spans AS (SELECT page_id, bits, unnest(list_concat(s.shut, list_transform(s.open, lambda x: {{'i': x.i, 'j': CAST(1000000000 AS BIGINT)}}))) AS e FROM paired),
    every AS (SELECT page_id, e.i AS i, e.j AS j, lower(regexp_extract(bits[e.i], '^<([A-Za-z][A-Za-z0-9]*)', 1)) AS tag, string_split(regexp_extract(bits[e.i], 'class="([^"]*)"', 1), ' ') AS classes, regexp_extract(bits[e.i], 'role="([^"]*)"', 1) AS role FROM spans),
    gone AS (SELECT * FROM every WHERE tag IN ({tags}){marked}),
    elements AS (SELECT * FROM every e WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.page_id = e.page_id AND e.i BETWEEN g.i AND g.j)),
    parts AS (SELECT page_id, unnest(bits) AS b, unnest(range(1, len(bits) + 1)) AS i FROM bits),
    strings AS (SELECT page_id, i, regexp_replace(replace(replace(replace(replace(replace(b, '&copy;', chr(169)), '&middot;', chr(183)), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g') AS t
        FROM parts p WHERE b NOT LIKE '<%' AND NOT EXISTS (SELECT 1 FROM gone g WHERE g.page_id = p.page_id AND p.i BETWEEN g.i AND g.j))"""


_EXTRACT = f"""{_sql_tree(H.EXTRACT_EXCLUDED)},
    texts_of AS (SELECT e.page_id, e.i, e.tag, e.classes, coalesce(string_agg({D.sql_strip('s.t')}, '' ORDER BY s.i), '') AS t FROM elements e LEFT JOIN strings s ON s.page_id = e.page_id AND s.i BETWEEN e.i AND e.j GROUP BY ALL),
    bodies AS (SELECT page_id, string_agg(t, chr(10) || chr(10) ORDER BY i) AS content FROM texts_of WHERE t <> '' AND (tag IN ('article', 'main', 'p') OR list_has_any(classes, ['content', 'post'])) GROUP BY page_id),
    titles AS (SELECT page_id, arg_min(t, i) AS title FROM texts_of WHERE tag IN ('title', 'h1') GROUP BY page_id),
    counts AS (SELECT page_id, CAST(len({D.sql_words("string_agg(t, '' ORDER BY i)")}) AS INTEGER) AS word_count FROM strings GROUP BY page_id),
    extracted AS (SELECT page_id, url, coalesce(title, '') AS title, coalesce(content, '') AS content, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS domain, coalesce(word_count, 0) AS word_count,
        nullif(regexp_extract(html, '<meta name="description" content="([^"]*)"', 1), '') AS description FROM pages LEFT JOIN titles USING (page_id) LEFT JOIN bodies USING (page_id) LEFT JOIN counts USING (page_id))"""

_MAIN = f"""{_sql_tree(H.CLEAN_REMOVED)},
    main AS (SELECT page_id, arg_min(i, place) AS i, arg_min(j, place) AS j FROM (SELECT *, CASE WHEN tag = 'main' THEN 0 WHEN tag = 'article' THEN 1 WHEN role = 'main' THEN 2 WHEN tag = 'body' THEN 3 END * CAST(1000000000 AS BIGINT) + i AS place FROM elements) WHERE place IS NOT NULL GROUP BY page_id),
    lines AS (SELECT p.page_id, string_agg(s.t, chr(10) ORDER BY s.i) AS t FROM pages p LEFT JOIN main m USING (page_id) LEFT JOIN strings s ON s.page_id = p.page_id AND s.i BETWEEN coalesce(m.i, 0) AND coalesce(m.j, 1000000000) GROUP BY p.page_id)"""
_VISIBLE = f"""{_sql_tree(['script', 'style'])}, seen AS (SELECT p.page_id, coalesce(string_agg(s.t, '' ORDER BY s.i), '') AS text FROM pages p LEFT JOIN strings s USING (page_id) GROUP BY p.page_id)"""


@query(f"WITH {_EXTRACT} SELECT page_id, title, content, domain, word_count, description FROM extracted")
def html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.table(spark, sf_dir, "pages").select("page_id", H.extract_udf("url", "html").alias("p")).select("page_id", "p.title", "p.content", "p.domain", "p.word_count", "p.description")


_ORIGIN = "regexp_extract(url, '^[a-z]+://[^/?#]+')"


def _linked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as pages: of their words some are links and some pictures, beside a menu and an advert that don't count."""
    escaped = lambda w: F.replace(F.replace(F.replace(F.replace(w, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    name = lambda w: F.left(F.md5(w), F.lit(6))
    link = lambda w: F.concat(F.lit('<a class="x" href="/'), name(w), F.lit("?d=1&amp;e=2#part\"> "), escaped(w), F.lit(" </a>"))
    picture = lambda w: F.concat(F.lit('<img src="pics/'), name(w), F.lit('.png" alt="'), escaped(w), F.lit('">'))
    part = lambda w, i: F.when(i % 13 == 5, link(w)).when(i % 17 == 3, picture(w)).otherwise(escaped(w))
    words = T.words(F.col("text"))
    body = F.array_join(F.transform(words, part), " ")
    keywords = F.array_join(F.transform(F.slice(words, 1, 3), escaped), ",")
    html = F.concat(F.lit('<html><head><meta name="keywords" content="'), keywords, F.lit('"></head><body><nav><a href="/menu">m</a></nav><div class="ads"><img src="a.gif"></div><p>'), body, F.lit("</p></body></html>"))
    url = F.concat(F.lit("https://host.test/dir/"), F.col("doc_id").cast("string"))
    return D.docs(spark, sf_dir).select("doc_id", url.alias("url"), html.alias("html"))


def _sql_marked(every: int, at: int) -> str:
    """(doc_id, n, w): the words of the documents whose place leaves `at`, and how many such are before."""
    return f"""words AS (SELECT doc_id, {D.sql_words('text')} AS w FROM documents),
    marked AS (SELECT doc_id, unnest(list_filter(w, lambda x, i: (i - 1) % {every} = {at})) AS w, unnest(range(len(list_filter(w, lambda x, i: (i - 1) % {every} = {at})))) AS n FROM words)"""


@query(f"WITH {_sql_marked(13, 5)} SELECT doc_id, CAST(n AS INTEGER) AS place, 'https://host.test/' || md5(w)[1:6] || '?d=1&e=2#part' AS url, w AS text FROM marked")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _linked_pages(spark, sf_dir).select("doc_id", H.extract_udf("url", "html", ["links"]).alias("p"))
    return pages.select("doc_id", F.posexplode("p.links").alias("place", "l")).select("doc_id", "place", "l.url", "l.text")


@query(f"WITH words AS (SELECT doc_id, {D.sql_words('text')} AS w FROM documents), marked AS (SELECT doc_id, unnest(list_filter(w, lambda x, i: (i - 1) % 17 = 3 AND (i - 1) % 13 <> 5)) AS w FROM words) SELECT doc_id, 'https://host.test/dir/pics/' || md5(w)[1:6] || '.png' AS url, w AS alt FROM marked")
def html_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _linked_pages(spark, sf_dir).select("doc_id", H.extract_udf("url", "html", ["images"]).alias("p"))
    return pages.select("doc_id", F.explode("p.images").alias("i")).select("doc_id", "i.url", "i.alt")


@query(f"WITH words AS (SELECT doc_id, {D.sql_words('text')} AS w FROM documents) SELECT doc_id, replace(array_to_string(w[1:3], ','), ',', '|') AS keywords, 'host.test' AS domain FROM words")
def html_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _linked_pages(spark, sf_dir).select("doc_id", H.extract_udf("url", "html").alias("p"))
    return pages.select("doc_id", F.array_join("p.keywords", "|").alias("keywords"), "p.domain")


#: The pages' own links by SQL: what stands in href, behind comments and scripts.
_HREFS = """bare AS (SELECT page_id, url, regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<(script|style)[^>]*>.*?</(script|style)>', '', 'gs') AS html FROM pages),
    hrefs AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS href FROM bare)"""


_LED = f"{_HREFS}, led AS (SELECT DISTINCT page_id, {_ORIGIN} || regexp_replace(href, '#.*$', '') AS link FROM hrefs)"


@query(f"WITH {_LED}, k AS (SELECT *, CASE WHEN lower(link) LIKE '%.pdf' THEN 'pdf' WHEN NOT ({' OR '.join(f'regexp_matches(lower(link), {D.quoted(p)})' for p in U.EXCLUDED)}) THEN 'page' END AS kind FROM led) SELECT * FROM k WHERE kind IS NOT NULL")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a crawl of each page's own host follows of the page's links, and what kind it is."""
    links = D.table(spark, sf_dir, "pages").select("page_id", "url", F.explode(H.crawl_links_udf("url", "html")).alias("link"))
    return links.select("page_id", "link", U.link_kind(F.col("link"), [U.netloc(F.col("url"))]).alias("kind")).where("kind IS NOT NULL")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE '{\"lang\":\"' || lang || '\"}' END AS metadata FROM documents")
def metadata_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = F.create_map(F.lit("lang"), F.col("lang"))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return D.table(spark, sf_dir, "documents").select("doc_id", C.metadata_text(F.when(F.col("doc_id") % 3 == 0, empty).otherwise(filled)).alias("metadata"))


@query(f"WITH {_MAIN} SELECT page_id, {D.sql_clean(D.sql_strip('t'))} AS text FROM lines")
def html_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.table(spark, sf_dir, "pages").select("page_id", T.clean_text(H.cleaned_udf("html")).alias("text"))


@query(f"WITH {_LED} SELECT * FROM led")
def crawl_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.table(spark, sf_dir, "pages").select("page_id", F.explode(H.crawl_links_udf("url", "html")).alias("link"))


@query(f"WITH {_VISIBLE}, {_sql_page_text('page_id', 'seen')} SELECT page_id, {_CUT} AS text FROM p")
def page_tool_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.table(spark, sf_dir, "pages").select("page_id", T.page_text(H.visible_text_udf("html")).alias("text"))


@query("""WITH RECURSIVE e AS (SELECT 'https://g.test/p/' || doc_id AS src, 'https://g.test/p/' || (2 * doc_id + 1) AS dst FROM documents UNION ALL SELECT 'https://g.test/p/' || doc_id, 'https://g.test/p/' || (3 * doc_id + 2) FROM documents),
    r AS (SELECT 'https://g.test/p/0' AS url, 0 AS depth UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.url)
    SELECT url, min(depth) AS depth FROM r GROUP BY url ORDER BY 2, 1 LIMIT 6000""")
def crawl_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = D.table(spark, sf_dir, "documents").select("doc_id")
    page = lambda n: F.concat(F.lit("https://g.test/p/"), n.cast("string"))
    edges = d.select(page(F.col("doc_id")).alias("src"), page(2 * F.col("doc_id") + 1).alias("dst")).unionByName(d.select(page(F.col("doc_id")).alias("src"), page(3 * F.col("doc_id") + 2).alias("dst")))
    return crawl.crawl(edges, "https://g.test/p/0", ["g.test"]).select("url", "depth")


# The whole pipeline


#: Scraped pages, and the store's rows of a table of pages (page_id, url, title, content), by SQL.
_SCRAPED = f"{_EXTRACT}, scraped AS MATERIALIZED (SELECT page_id, url, title, {D.sql_clean('content')} AS content, content <> '' AS success FROM extracted)"


def _sql_store_rows(pages: str) -> str:
    made = f"""texts AS (SELECT {{'url': url || '#chunk_' || chunk_index, 'title': title || ' (Teil ' || (chunk_index + 1) || '/' || total || ')', 'category': {D.sql_first_match('lower(url)', [(k, c) for c, k in U.CATEGORIES.items()], U.NO_CATEGORY)}}} AS key, text
        FROM headed WHERE {D.sql_strip('text')} <> '')"""
    return f"""good AS (SELECT page_id, url, title, content AS text FROM {pages} WHERE success), {_sql_sections('page_id, url, title', 'good')}, {made}, {_CHUNKS},
    store AS (SELECT sha256(key.url || '#' || chunk_index)[1:16] AS id, chunk AS text, key.url AS source_url, key.title AS title, key.category AS category, chunk_index, total_chunks, key.category AS collection FROM chunked)"""


@query(f"WITH {_SCRAPED}, {_sql_store_rows('scraped')} SELECT * FROM store")
def ingest_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.store_rows(ingest.scraped_pages(spark, sf_dir)).drop("embedding")


@query(f"""WITH RECURSIVE {_SCRAPED}, documents AS MATERIALIZED (SELECT page_id AS doc_id, content AS text FROM scraped WHERE success), {_GREEDY.removeprefix('WITH RECURSIVE ')},
    uniques AS (SELECT * FROM scraped WHERE success AND url IN (SELECT url FROM scraped JOIN greedy ON id = page_id WHERE is_unique)), {_sql_store_rows('uniques')},
    one AS (SELECT count(*) AS total_pages, count(*) FILTER (success) AS successful, count(*) FILTER (NOT success) AS failed_scrapes FROM scraped), two AS (SELECT count(*) AS unique_documents FROM uniques),
    three AS (SELECT count(*) AS chunks_stored, count(DISTINCT collection) AS collections FROM store)
    SELECT *, successful - unique_documents AS duplicates_removed, CASE WHEN total_pages > 0 THEN successful / total_pages ELSE 0.0 END AS success_rate FROM one, two, three""")
def pipeline_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.report(spark, sf_dir)


# Reports, failures and metadata

_KINDS, _STATUS = ["connection", "timeout", "response", "other"], [404, 403, 429, 500, 503, 418]


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One to three attempts for every event's url; all but the last timed out, and the last failed for two of three."""
    e = D.table(spark, sf_dir, "events").select("event_id", F.explode(F.sequence(F.lit(0), (F.col("event_id") % 3).cast("int"))).alias("attempt"))
    n, last = F.col("event_id"), F.col("attempt") == F.col("event_id") % 3
    kind = F.when(last, D.pick(_KINDS, F.floor(n / 3))).otherwise(F.lit("timeout"))
    status = F.element_at(F.array(*[F.lit(x) for x in _STATUS]), (F.floor(n / 12) % 6 + 1).cast("int"))
    return e.select(F.concat(F.lit("https://host.test/"), n.cast("string")).alias("url"), "attempt", (last & (F.floor(n / 2) % 3 == 0)).alias("success"), kind.alias("kind"), F.when(kind == "response", status).alias("status"), F.concat(F.lit("try "), F.col("attempt").cast("string")).alias("message"))


_ATTEMPTS = f"""e AS (SELECT event_id AS n, CAST(unnest(range(event_id % 3 + 1)) AS INTEGER) AS attempt, CAST(event_id % 3 AS INTEGER) AS last FROM events),
    k AS (SELECT 'https://host.test/' || n AS url, attempt, attempt = last AND (n // 2) % 3 = 0 AS success, CASE WHEN attempt = last THEN {D.sql_pick(_KINDS, '(n // 3)')} ELSE 'timeout' END AS kind, ({_STATUS})[CAST((n // 12) % 6 + 1 AS BIGINT)] AS code, 'try ' || attempt AS message FROM e),
    attempts AS (SELECT *, CASE WHEN success THEN NULL ELSE CASE kind WHEN 'connection' THEN 'connection_error' WHEN 'timeout' THEN 'timeout' WHEN 'response' THEN CASE code WHEN 404 THEN 'not_found' WHEN 403 THEN 'forbidden' WHEN 429 THEN 'rate_limited'
        ELSE CASE WHEN code >= 500 THEN 'server_error' ELSE 'http_' || code END END ELSE 'unknown_error' END END AS error_type, kind IN ('connection', 'timeout') OR (kind = 'response' AND code >= 500) AS retryable FROM k),
    final AS (SELECT * FROM attempts QUALIFY row_number() OVER (PARTITION BY url ORDER BY attempt DESC) = 1),
    gone AS (SELECT url, error_type, message FROM final WHERE NOT success AND (NOT retryable OR attempt >= 2)), errors AS (SELECT error_type, count(*) AS cnt FROM attempts WHERE NOT success GROUP BY error_type)"""


@query(f"WITH {_ATTEMPTS} SELECT * FROM gone")
def failed_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.failed_urls(_attempts(spark, sf_dir))


@query(f"WITH {_ATTEMPTS} SELECT url, attempt + 1 AS attempt, least(pow(2.0, attempt), 60.0) AS delay FROM final WHERE NOT success AND retryable AND attempt < 2")
def retry_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.retry_queue(_attempts(spark, sf_dir), config=R.RetryConfig(jitter=False))


@query(f"WITH {_ATTEMPTS} SELECT * FROM errors")
def error_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.error_statistics(_attempts(spark, sf_dir))


@query(f"""WITH {_ATTEMPTS} SELECT 'summary' AS section, 'failed_count' AS name, CAST(count(*) AS VARCHAR) AS value FROM gone UNION ALL SELECT 'error_statistics', error_type, CAST(cnt AS VARCHAR) FROM errors
    UNION ALL SELECT 'failed_urls', url, error_type || ': ' || message FROM gone""")
def failed_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.failed_report(_attempts(spark, sf_dir))


@query(f"WITH {D.ADDRESSES} SELECT 'summary' AS section, 'total_urls' AS name, CAST(count(*) AS VARCHAR) AS value FROM addresses UNION ALL SELECT 'urls', url, NULL FROM addresses")
def discovered_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.discovered(D.addresses(spark, sf_dir))


def _sql_rows(section: str, names: list[str], table: str) -> str:
    """A one-row table's columns as rows of a report."""
    return " UNION ALL ".join(f"SELECT '{section}' AS section, '{n}' AS name, CAST({n} AS VARCHAR) AS value FROM {table}" for n in names)


@query(f"""SELECT count(*) FILTER (changed) AS changes_detected, any_value(s.n) AS urls_skipped, any_value(c.total) AS total, any_value(c.successful) AS successful, any_value(c.failed) AS failed, any_value(c.fresh) AS fresh, any_value(c.expired) AS expired
    FROM ({ORACLE_SQL['changes']}), (SELECT count(*) AS n FROM ({ORACLE_SQL['rescrape_plan']}) WHERE NOT should_scrape) s, ({ORACLE_SQL['cache_stats']}) c""")
def incremental_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.incremental_statistics(changes(spark, sf_dir), rescrape_plan(spark, sf_dir), _cache(spark, sf_dir), now())


@query(f"""SELECT 'statistics' AS section, 'changes_detected' AS name, CAST(count(*) FILTER (changed) AS VARCHAR) AS value FROM ({ORACLE_SQL['changes']}) UNION ALL SELECT 'statistics', 'urls_skipped', CAST(count(*) AS VARCHAR) FROM ({ORACLE_SQL['rescrape_plan']}) WHERE NOT should_scrape
    UNION ALL {_sql_rows('cache_stats', ['total', 'successful', 'failed', 'fresh', 'expired'], f"({ORACLE_SQL['cache_stats']})")}
    UNION ALL SELECT 'changes_detected', url, change_type FROM ({ORACLE_SQL['changes']}) WHERE changed UNION ALL SELECT 'skipped_urls', url, reason FROM ({ORACLE_SQL['rescrape_plan']}) WHERE NOT should_scrape""")
def change_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.change_report(changes(spark, sf_dir), rescrape_plan(spark, sf_dir), C.statistics(_cache(spark, sf_dir), now()))


_MEASURED = ["urls_crawled", "urls_successful", "urls_failed", "success_share", "success_rate", "avg_response_time", "avg_content_size", "total_content_size", "crawl_rate"]
_METRICS = f"""{_sql_rows('summary', _MEASURED, f"({ORACLE_SQL['fetch_metrics']})")} UNION ALL SELECT 'categories', category, CAST(count(*) AS VARCHAR) FROM fetch_log WHERE category <> '' GROUP BY category
    UNION ALL SELECT 'errors', error, CAST(count(*) AS VARCHAR) FROM fetch_log WHERE error IS NOT NULL GROUP BY error UNION ALL SELECT 'status_codes', CAST(status_code AS VARCHAR), CAST(count(*) AS VARCHAR) FROM fetch_log WHERE status_code <> 0 GROUP BY status_code
    UNION ALL SELECT 'url_details', CAST(event_id AS VARCHAR), url || ' ' || success FROM"""


@query(f"WITH {D.FETCH_LOG} {_METRICS} (SELECT * FROM fetch_log ORDER BY event_id DESC LIMIT 100)")
def metrics_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.metrics_report(D.fetch_log(spark, sf_dir), fetch_metrics(spark, sf_dir), "event_id")


@query(f"WITH {D.FETCH_LOG} {_METRICS} fetch_log")
def metrics_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the details of all urls."""
    return reports.metrics_report(D.fetch_log(spark, sf_dir), fetch_metrics(spark, sf_dir), "event_id", None)


_METHODS = ["pdfplumber", "pypdf", "none"]


@query(f"WITH {D.FETCH_LOG} SELECT {D.sql_pick(_METHODS, 'event_id')} AS extraction_method, count(*) AS cnt FROM fetch_log WHERE success GROUP BY 1")
def pdf_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.pdf_methods(D.fetch_log(spark, sf_dir).withColumn("extraction_method", D.pick(_METHODS, F.col("event_id"))))


_DOMAINS = ["host.test", "en.other.test"]
_FIRST_CATEGORY = D.sql_first_match("lower(url)", [(k, c) for c, k in U.CATEGORIES.items()], U.NO_CATEGORY)
_DOCUMENT_TYPE = D.sql_first_match("lower(url)", [(k, v) for v, k in U.DOCUMENT_TYPES.items()])
_SITE = f"""{D.ADDRESSES}, site AS (SELECT doc_id, url, text, CASE WHEN lower(url) LIKE '%.pdf' THEN CASE WHEN {_NETLOC} IN ('host.test', 'en.other.test') THEN 'pdf' END WHEN {_ALLOWED} THEN 'page' END AS kind, doc_id % 5 = 0 AS skipped, doc_id % 7 <> 0 AS success,
    {_FIRST_CATEGORY} AS category, {_DOCUMENT_TYPE} AS document_type FROM addresses JOIN documents USING (doc_id))"""


def _site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as pages and PDFs of a made-up site."""
    u = F.col("url")
    rows = D.addresses(spark, sf_dir).join(D.docs(spark, sf_dir), "doc_id")
    return rows.select("doc_id", "url", "text", U.link_kind(u, _DOMAINS).alias("kind"), (F.col("doc_id") % 5 == 0).alias("skipped"), (F.col("doc_id") % 7 != 0).alias("success"), U.document_type(u).alias("document_type"))


@query(f"""WITH {_SITE} SELECT url, md5(text) AS digest, 'html' AS content_type, category, NULL AS document_type FROM site WHERE kind = 'page' AND success
    UNION ALL SELECT url, md5(text), 'pdf', CASE WHEN contains(lower(url), 'pruefungsordnung') OR document_type IS NOT NULL THEN 'pruefungsordnungen' ELSE category END, document_type FROM site WHERE kind = 'pdf' AND success""")
def all_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    site = _site(spark, sf_dir)
    pages = site.where("kind = 'page'").select("url", F.col("text").alias("content"), "success")
    out = ingest.with_pdfs(pages, site.where("kind = 'pdf'").select("url", "text", "success", "document_type"))
    return out.select("url", F.md5("content").alias("digest"), "content_type", "category", "document_type")


@query(f"WITH {D.ADDRESSES} SELECT url, CASE WHEN contains(lower(url), 'pruefungsordnung') OR {_DOCUMENT_TYPE} IS NOT NULL THEN 'pruefungsordnungen' ELSE {_FIRST_CATEGORY} END AS category FROM addresses")
def pdf_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.addresses(spark, sf_dir).select("url", U.pdf_category(F.lower("url"), U.document_type(F.col("url"))).alias("category"))


@query(f"""{_STORED.replace("WITH ", f"WITH {D.FETCH_LOG}, ", 1)}, {_SITE[len(D.ADDRESSES) + 2 :]}, u AS (SELECT * FROM site WHERE kind = 'page' AND doc_id % 11 <> 0),
    r AS (SELECT count(*) FILTER (kind = 'page') AS urls_discovered, count(*) FILTER (kind = 'page' AND NOT skipped) AS urls_scraped, count(*) FILTER (kind = 'page' AND skipped) AS urls_skipped_cache, count(*) FILTER (kind = 'pdf') AS pdfs_found,
        count(*) FILTER (kind = 'page') AS pages_scraped, count(*) FILTER (kind = 'page' AND success) AS successful_scrapes, count(*) FILTER (kind = 'page' AND NOT success) AS failed_scrapes,
        count(*) FILTER (kind = 'page' AND success AND doc_id % 11 = 0) AS duplicates_removed, count(*) FILTER (kind = 'pdf' AND success) AS pdfs_extracted, count(*) FILTER (kind = 'pdf' AND NOT success) AS pdfs_failed FROM site),
    c AS (SELECT count(DISTINCT category) AS categories_found FROM u WHERE success), t AS (SELECT count(*) AS total_chunks_created, count(*) AS total_documents_stored FROM stored),
    m AS (SELECT round(avg(CAST(success AS INTEGER)) * 100, 6) AS success_rate, round(avg(response_time), 6) AS average_response_time, CAST(sum(content_size) AS BIGINT) AS total_content_size FROM fetch_log)
    {_sql_rows('results', ['urls_discovered', 'urls_scraped', 'urls_skipped_cache', 'pdfs_found', 'pages_scraped', 'successful_scrapes', 'failed_scrapes', 'duplicates_removed', 'pdfs_extracted', 'pdfs_failed'], 'r')}
    UNION ALL {_sql_rows('results', ['categories_found'], 'c')} UNION ALL {_sql_rows('results', ['total_chunks_created', 'total_documents_stored'], 't')} UNION ALL SELECT 'category_distribution', category, CAST(count(*) AS VARCHAR) FROM u WHERE success GROUP BY category
    UNION ALL {_sql_rows('metrics', ['success_rate', 'average_response_time', 'total_content_size'], 'm')} UNION ALL SELECT 'error_summary', error, CAST(count(*) AS VARCHAR) FROM fetch_log WHERE error IS NOT NULL GROUP BY error""")
def pipeline_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All measures of the pipeline's report, over the documents as a made-up site of which every eleventh page is a duplicate."""
    site = _site(spark, sf_dir)
    found, pages = site.where("kind IS NOT NULL"), site.where("kind = 'page'")
    return ingest.measures(found, pages, pages.where("doc_id % 11 <> 0"), site.where("kind = 'pdf'"), _stored(spark, sf_dir), D.fetch_log(spark, sf_dir))


@query(f"""{_STORED}, p AS (SELECT {_FIRST_CATEGORY} AS category, doc_id % 9 <> 0 AS success FROM addresses), r AS (SELECT count(*) AS total_pages, count(*) FILTER (success) AS successful_pages, count(DISTINCT category) FILTER (success) AS categories_found FROM p)
    {_sql_rows('results', ['total_pages', 'successful_pages', 'categories_found'], 'r')} UNION ALL SELECT 'results', 'total_documents_stored', CAST(count(*) AS VARCHAR) FROM stored
    UNION ALL SELECT 'category_distribution', category, CAST(count(*) AS VARCHAR) FROM p WHERE success GROUP BY category""")
def reprocess_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = D.addresses(spark, sf_dir).select(U.category(F.col("url")).alias("category"), (F.col("doc_id") % 9 != 0).alias("success"))
    return reports.reprocessed(docs, _stored(spark, sf_dir))


_CODE = "CASE WHEN coalesce(status_code, 0) = 0 THEN 'N/A' ELSE CAST(status_code AS VARCHAR) END"
_NAMED = f"{D.CACHE}, named AS (SELECT * REPLACE (coalesce(nullif(category, ''), 'uncategorized') AS category), strftime(last_scraped, '%Y-%m-%d %H:%M:%S') AS seen_at FROM cache)"


@query(f"WITH {_NAMED} SELECT category, 1 AS place, url, url AS line FROM named")
def cache_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.cache_lines(_cache(spark, sf_dir), "simple")


@query(f"""WITH {_NAMED} SELECT category, 1 AS place, url, 'URL:      ' || url || chr(10) || 'Category: ' || category || chr(10) || 'Status:   ' || CASE WHEN success THEN 'SUCCESS' ELSE 'FAILED' END || ' (Code: ' || {_CODE} || ')' || chr(10) || 'Scraped:  ' || seen_at AS line FROM named""")
def cache_detailed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.cache_lines(_cache(spark, sf_dir), "detailed")


@query(f"WITH {_NAMED} SELECT category, 1 AS place, url, url AS line FROM named UNION ALL SELECT category, 0, '', '## ' || upper(category) || ' (' || count(*) || ' URLs)' FROM named GROUP BY category")
def cache_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.cache_lines(_cache(spark, sf_dir), "by-category")


@query(f"WITH {_NAMED} SELECT category, 1 AS place, url, CAST(to_json({{'url': url, 'category': category, 'success': success, 'status_code': status_code, 'last_scraped': seen_at, 'content_hash': content_hash}}) AS VARCHAR) AS line FROM named")
def cache_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.cache_lines(_cache(spark, sf_dir), "json")


@query(f"WITH {D.CACHE} SELECT category, rpad(category, greatest(10, CAST(length(category) AS INTEGER)), ' ') || ' ' || lpad(CAST(count(*) AS VARCHAR), 3, ' ') || ' ' || printf('%.1f%%', count(*) * 100.0 / 200) AS line FROM cache WHERE category <> '' GROUP BY category")
def category_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.bars(metrics.counts_by(_cache(spark, sf_dir), "category"), "category", F.lit(200))


@query("""SELECT doc_id, e.key AS name, e.value ->> '$' AS value FROM (SELECT doc_id, json_object('lang', lang, 'n', n_chars, 'half', n_chars / 2 + 0.25, 'even', doc_id % 2 = 0, 'none', NULL, 'tags', [lang, source], 'inner', json_object('a', 1), 'title', 'own') AS j FROM documents) d,
    json_each(d.j) e WHERE e.type IN ('VARCHAR', 'BIGINT', 'UBIGINT', 'DOUBLE', 'BOOLEAN') AND e.key <> 'title'""")
def scalar_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = D.table(spark, sf_dir, "documents")
    fields = [F.col("lang"), F.col("n_chars").alias("n"), (F.col("n_chars") / 2 + 0.25).alias("half"), (F.col("doc_id") % 2 == 0).alias("even"), F.lit(None).cast("string").alias("none"), F.array("lang", "source").alias("tags"), F.struct(F.lit(1).alias("a")).alias("inner"), F.lit("own").alias("title")]
    rows = d.select("doc_id", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("metadata"))
    return T.scalars_only(rows, "doc_id", "metadata", ["title"])


@query("SELECT doc_id, 'a=' || lang || ';b=' || (doc_id % 3) || ';c=' || source AS merged FROM documents")
def metadata_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = D.table(spark, sf_dir, "documents")
    left = F.create_map(F.lit("a"), F.col("lang"), F.lit("b"), F.lit("old"))
    right = F.create_map(F.lit("b"), (F.col("doc_id") % 3).cast("string"), F.lit("c"), F.col("source"))
    entries = F.array_sort(F.map_entries(T.merged(left, right)))
    return d.select("doc_id", F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("merged"))


@query(f"""WITH c AS (SELECT doc_id, {D.sql_clean('text')} AS t FROM documents), w AS (SELECT doc_id, t, {D.sql_words('t')} AS w FROM c)
    SELECT doc_id, md5(t) AS digest, length(t) >= 100 AND len(w) >= 20 AND list_sum(list_transform(w, lambda x: length(x))) / len(w) >= 3 AS is_substantial, CAST(len(w) AS INTEGER) AS word_count, CAST(length(t) AS INTEGER) AS char_count FROM w""")
def clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.clean_document(D.docs(spark, sf_dir), "text").select("doc_id", F.md5("text").alias("digest"), "is_substantial", "word_count", "char_count")


@query("""SELECT doc_id, '[CHATBOT] ' || source AS subject, '[AUTOMATIC MESSAGE]' || chr(10) || 'To: a@host.test' || chr(10) || 'From: automatic sender' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || lang || chr(10) || chr(10) || '---' || chr(10) || 'This message was sent automatically.' AS body,
    doc_id % 3 = 0 AS configured FROM documents""")
def mail_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [F.lit(x) for x in M.SETTINGS]
    settings = F.create_map(names[0], F.lit("s"), names[1], F.lit("25"), names[2], F.lit("u"), names[3], F.when(F.col("doc_id") % 3 == 0, F.lit("p")).when(F.col("doc_id") % 3 == 1, F.lit("")))
    return D.table(spark, sf_dir, "documents").select("doc_id", M.wrapped_subject(F.col("source")).alias("subject"), M.wrapped_body(F.col("lang"), F.lit("a@host.test")).alias("body"), M.is_configured(settings).alias("configured"))


@query(f"WITH {_HREFS} SELECT page_id, href, {_ORIGIN} || href AS joined, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/[^/]*$', '/') || 'sub' || href AS below FROM hrefs")
def joined_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' own links joined with their addresses: as they are, which begin with a slash, and as names below the page's folder."""
    raw = F.col("html")
    for pattern in ("(?s)<!--.*?-->", "(?s)<(script|style)[^>]*>.*?</(script|style)>"):
        raw = F.regexp_replace(raw, pattern, "")
    rows = D.table(spark, sf_dir, "pages").select("page_id", "url", F.explode(F.regexp_extract_all(raw, F.lit('<a [^>]*href="([^"]*)"'), F.lit(1))).alias("href"))
    return rows.select("page_id", "href", H.urljoin_udf("url", "href").alias("joined"), H.urljoin_udf(F.col("url"), F.concat(F.lit("sub"), "href")).alias("below"))
