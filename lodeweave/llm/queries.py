"""The registered queries of this subpackage: thin wrappers that apply one operator each to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.llm import alignment, fingerprints, markup, ngram_join, packing, prefix_trie, quality, segments, substrings, tokenfile, topk, toxicity, warc
from lodeweave.llm.shared import held_out, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.3).cast("int").alias("predicted"),
        F.col("toxic_threshold").alias("threshold"), F.col("toxic").alias("predicted_by_language"),
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.7).cast("int").alias("predicted"))


def op3_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return segments.sampled(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where(topk.usable(F.col("embedding"))).select("vec_id", topk.whole_numbers(F.col("embedding")).alias("v"))
    return topk.top_k(rows, F.col("vec_id") % 20 == 0)


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.extract(table(spark, sf_dir, "pages"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edits(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.through_archives(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(table(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.aligned(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokenfile.through_files(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


QUERIES = {"op1_toxicity": op1_toxicity, "op2_quality": op2_quality, "op3_segments": op3_segments, "op4_topk": op4_topk, "op5_ngram_join": op5_ngram_join, "op6_packing": op6_packing, "op7_markup": op7_markup, "op8_warc": op8_warc, "op9_fingerprints": op9_fingerprints, "op10_substrings": op10_substrings,
    "op11_alignment": op11_alignment, "op12_token_files": op12_token_files, "op13_prefix_trie": op13_prefix_trie,
}
ORACLE_SQL: dict[str, str] = {
    "op4_topk": """
        WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.r AS own, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
              FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 20 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op5_ngram_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                     ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
        n AS (SELECT doc_id, CAST(coalesce(len(s), 0) AS BIGINT) AS n_shingles FROM s),
        e AS (SELECT doc_id, unnest(s) AS g FROM s),
        o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n_shingles + y.n_shingles - shared)),
        r AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.c)
        SELECT r.doc_id, any_value(n_shingles) AS n_shingles, min(c) AS component_id FROM r JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id""",
    "op8_warc": """
        WITH hashed AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
        won AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS winner FROM hashed)
        SELECT page_id, payload_bytes,
               list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   1 + CAST((CAST('0x' || substr(hex, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
               CASE WHEN page_id = winner THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = winner THEN NULL ELSE winner END AS refers_to
        FROM won""",
    "op10_substrings": r"""
        WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
        g AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS k, w FROM w WHERE len(w) >= 35),
        h AS (SELECT doc_id, k, sha256(array_to_string(w[k:k + 34], ' ')) AS h FROM g),
        again AS (SELECT h FROM h GROUP BY h HAVING count(*) > 1),
        p AS (SELECT DISTINCT doc_id, k + unnest(range(35)) AS k FROM h JOIN again USING (h)),
        c AS (SELECT doc_id, count(*) AS n, list(k) AS gone FROM p GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
               sha256(coalesce(array_to_string(CASE WHEN n IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' '), '')) AS kept_sha256
        FROM w LEFT JOIN c USING (doc_id)""",
    "op13_prefix_trie": """
        WITH t AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
        o AS (SELECT conv_id, turn, coalesce(text, '') AS x, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS key FROM conversations WHERE conv_id IS NOT NULL),
        turns AS (SELECT conv_id, key, CAST(strlen(x) AS BIGINT) AS bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key) - 1 AS p FROM o),
        n AS (SELECT conv_id, count(*) AS own,
                     xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 9 AS h
              FROM turns, t GROUP BY conv_id, t),
        c AS (SELECT n.conv_id, n.conv_id - n.conv_id % 5 AS base, n.h, least(n.h, coalesce(b.own, 0)) AS taken FROM n LEFT JOIN n b ON b.conv_id = n.conv_id - n.conv_id % 5),
        q AS (SELECT conv_id, p - h + taken AS p, key, bytes FROM turns JOIN c USING (conv_id) WHERE p >= h UNION ALL SELECT c.conv_id, p, key, bytes FROM c JOIN turns ON turns.conv_id = base WHERE p < taken),
        l AS (SELECT conv_id, p + 1 AS depth, bytes, list(key) OVER (PARTITION BY conv_id ORDER BY p) AS keys FROM q UNION ALL SELECT conv_id, 0, 0, [] FROM n),
        s AS (SELECT conv_id, depth, bytes, array_to_string(keys, ',') AS path, array_to_string(keys[:-2], ',') AS parent, max(depth) OVER (PARTITION BY conv_id) AS size FROM l),
        nodes AS (SELECT path, depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
                         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (depth = size), '')) AS ends_sha256 FROM s GROUP BY path, depth),
        kids AS (SELECT parent AS path, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
        full_nodes AS (SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN kids USING (path, depth)),
        up AS (SELECT s.path, s.depth, CAST(sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves, CAST(sum((n_convs - 1) * f.bytes) AS BIGINT) AS saved_tokens
               FROM full_nodes f JOIN s ON s.conv_id = f.conv_id AND s.depth <= f.depth GROUP BY ALL)
        SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256
        FROM full_nodes f JOIN up USING (path, depth) LEFT JOIN nodes p ON f.depth > 0 AND p.path = f.parent AND p.depth = f.depth - 1""",
}
