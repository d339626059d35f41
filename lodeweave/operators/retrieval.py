"""Vector retrieval: embeddings, cosine top-k with filters, and answers.

Search is exact: distances are SQL expressions over the whole store, filters come before
the limit and thresholds after it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.functions import text as T

PER_COLLECTION, TOTAL, RELEVANT, SIMILAR, RESULTS = 3, 5, 0.1, 0.1, 10
# Words of a question that call for the hint.
HINT_WORDS = ["bewerbung", "fachsemester", "höher"]


@dataclass(frozen=True)
class StoreConfig:
    backend: str = "parquet"
    collection_name: str = "documents"
    persist_directory: str = "data/vectors"
    chunk_size: int = 1500
    chunk_overlap: int = 300
    embedding_provider: str = "hashing"
    dimension: int = 384
    similarity_threshold: float = SIMILAR
    max_results: int = RESULTS

    def __post_init__(self):
        if self.backend not in ("parquet",):
            raise ValueError(f"unknown vector store backend: {self.backend}")
        if self.embedding_provider not in PROVIDERS:
            raise ValueError(f"unknown embedding provider: {self.embedding_provider}")
        if "output/vector_db" in self.persist_directory:
            raise ValueError("stores don't go under output/vector_db")


def _word_hash(word: Column) -> Column:
    """The first 32 bits of a word's md5, as a whole number."""
    return F.conv(F.left(F.md5(word), F.lit(8)), 16, 10).cast("long")


def hashing_embedder(dim: int = 384):
    """A deterministic stand-in for a model: signed word hashes, of length one. It has no sense of meaning.

    Words are split and hashed in SQL; a batch of texts is counted into its vectors at once. Texts that are null or
    without words give a vector of zeros.
    """

    @F.arrow_udf("array<float>")
    def counted(hashes: pa.Array) -> pa.Array:
        h = hashes.flatten().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(hashes)), np.diff(hashes.offsets.to_numpy()))
        v = np.bincount(row * dim + h % dim, np.where(h >> 31, 1.0, -1.0), len(hashes) * dim).reshape(-1, dim)
        n = np.sqrt(np.einsum("ij,ij->i", v, v))
        v = v / np.where(n > 0, n, 1.0)[:, None]  # bincount of nothing counts in whole numbers
        return pa.ListArray.from_arrays(pa.array(np.arange(len(hashes) + 1, dtype=np.int32) * dim), pa.array(v.astype(np.float32).ravel()))

    def encode(text: Column | str) -> Column:
        body = F.col(text) if isinstance(text, str) else text
        return counted(F.transform(T.words(F.coalesce(F.lower(body), F.lit(""))), _word_hash))

    return encode


def hashed_question(text: str | None, dim: int = 384) -> list[float]:
    """What `hashing_embedder` makes of one text, for a question that the driver holds."""
    v = np.zeros(dim)
    for word in (text or "").lower().split():
        h = int(hashlib.md5(word.encode()).hexdigest()[:8], 16)
        v[h % dim] += 1.0 if h >> 31 else -1.0
    n = float(np.sqrt(v @ v))
    return (v / n if n else v).astype(np.float32).tolist()


#: Embedding providers by name; register others here.
PROVIDERS: dict[str, Callable] = {"hashing": hashing_embedder}


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, 1 - dot(a, b) / norms).otherwise(F.lit(1.0))


def relevance(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - distance)


def distances(store: DataFrame, query: list[float]) -> DataFrame:
    """Cosine distances to one query, whose length is taken once; arrow batches, so a row is one numpy dot product."""
    q = np.array(query, np.float64)
    length = float(np.sqrt(q @ q))

    @F.arrow_udf("double")
    def distance(column: pa.Array) -> pa.Array:
        out = np.full(len(column), 1.0)
        sizes = np.diff(column.offsets.to_numpy())
        whole = np.flatnonzero((sizes == len(q)) & column.is_valid().to_numpy(zero_copy_only=False))
        if len(whole):
            v = column.take(pa.array(whole)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(q))
            norms = np.sqrt(np.einsum("ij,ij->i", v, v)) * length
            dots = v @ q
            out[whole] = np.where(norms > 0, 1 - dots / np.where(norms > 0, norms, 1), 1.0)
        return pa.array(out)

    return store.withColumn("distance", distance("embedding"))


def search(store: DataFrame, query: list[float], k: int = RESULTS, where: Column | None = None, threshold: float = SIMILAR, key: str = "id") -> DataFrame:
    """The k nearest rows among those that the condition lets through; then those below the threshold go."""
    rows = distances(store if where is None else store.where(where), query)
    return rows.orderBy("distance", key).limit(k).withColumn("score", 1 - F.col("distance")).where(F.col("score") >= threshold)


def across_collections(store: DataFrame, query: list[float], key: str = "id", per_collection: int = PER_COLLECTION, total: int = TOTAL, relevant: float = RELEVANT) -> DataFrame:
    """The nearest rows of every collection, of these the nearest of all with their rank, and of these the relevant ones."""
    w = Window.partitionBy("collection").orderBy("distance", key)
    best = distances(store, query).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_collection).drop("_r")
    few = best.orderBy("distance", "collection", key).limit(total)
    ranked = few.withColumn("rank", F.row_number().over(Window.orderBy("distance", "collection", key)))  # `total` rows
    return ranked.withColumn("relevance", relevance(F.col("distance"))).where(F.col("relevance") > relevant)


@dataclass(frozen=True)
class AnswerText:
    """The wording of an answer; {} are filled in."""

    head: str = "Found in the knowledge base (collections: {}):"
    block: str = "Result {}{} [from {}]:"
    source: str = " (source: {})"
    unknown: str = "unknown"
    hint: str = "Note: applications for later semesters often need certificates from the examination office."
    nothing: str = "Nothing that was found on '{}' is relevant enough."


def _filled(template: str, *values: Column) -> Column:
    parts = template.split("{}")
    out = [F.lit(parts[0])]
    for value, part in zip(values, parts[1:], strict=True):
        out += [value, F.lit(part)]
    return F.concat(*out)


def answer(hits: DataFrame, question: str, collections: list[str], wording: AnswerText = AnswerText()) -> DataFrame:  # noqa: B008
    """One row with the answer text from hits (rank, text, collection, title, source_url), at most as many as a search gives; ranks keep their gaps."""
    source = F.coalesce(F.nullif("title", F.lit("")), F.nullif("source_url", F.lit("")))
    origin = F.when(source.isNotNull(), _filled(wording.source, source)).otherwise(F.lit(""))
    block = F.concat(_filled(wording.block, F.col("rank").cast("string"), origin, F.coalesce("collection", F.lit(wording.unknown))), F.lit("\n"), T.strip(F.col("text")))
    hint = f"\n\n{wording.hint}" if any(w in question.lower() for w in HINT_WORDS) else ""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))), lambda s: s["b"]), "\n\n")
    head = wording.head.format(", ".join(collections)) + "\n\n"
    none = wording.nothing.format(question)
    return hits.agg(F.when(F.count("*") == 0, F.lit(none)).otherwise(F.concat(F.lit(head), body, F.lit(hint))).alias("answer"))


def store_statistics(store: DataFrame, config: StoreConfig) -> DataFrame:
    return store.agg(F.count("*").alias("document_count"), F.lit(config.collection_name).alias("collection_name"), F.lit(config.embedding_provider).alias("embedding_provider"), F.lit(config.chunk_size).alias("chunk_size"))


def from_environment(env: Mapping[str, str]) -> StoreConfig:
    """A configuration from settings such as VECTOR_STORE_BACKEND or CHUNK_SIZE; what isn't set keeps its default."""
    known = {"backend": "VECTOR_STORE_BACKEND", "collection_name": "COLLECTION_NAME", "persist_directory": "PERSIST_DIRECTORY", "chunk_size": "CHUNK_SIZE", "chunk_overlap": "CHUNK_OVERLAP", "embedding_provider": "EMBEDDING_PROVIDER", "dimension": "EMBEDDING_DIMENSION", "similarity_threshold": "SIMILARITY_THRESHOLD", "max_results": "MAX_RESULTS"}
    plain = StoreConfig()
    given = {name: type(getattr(plain, name))(env[key]) for name, key in known.items() if env.get(key)}
    return replace(plain, **given)


class StoreBackend(Protocol):
    """What a vector store offers; sources.files.ParquetStore is one."""

    def add(self, rows: DataFrame) -> int: ...

    def search(self, query: list[float], k: int = RESULTS, where: Column | None = None, threshold: float = SIMILAR) -> DataFrame: ...

    def delete_by_source(self, source_url: str) -> None: ...

    def count(self) -> int: ...
