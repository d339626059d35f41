"""The corpus pipeline: documents through five operators, each stage over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a table, which is written and read
again as the next one's docs. All but the last return the columns that they were given.
Rows with null text count as empty texts; rows with a null doc_id pass through every
stage on their text alone.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.llm import ngram_join, packing, quality, substrings, toxicity
from lodeweave.llm.shared import table, unused, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects (score below 0.7) go."""
    score = unused(docs, "quality_score")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")), score)
    return scored.where(F.col(score) >= quality.CUT_AT).select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents at or above their language's toxicity threshold go."""
    score, threshold, toxic = (unused(docs, name) for name in ("toxicity", "toxic_threshold", "toxic"))
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), (score, threshold, toxic))
    return scored.where(F.col(toxic) == 0).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies the document with the smallest id stays; so do documents without words."""
    return ngram_join.one_per_group(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Word sequences of 35 and more that occur more than once are cut out of the texts; n_chars follows."""
    out = substrings.deduplicated(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token sequences of 4096: which pieces of which documents each holds, and where."""
    pieces = packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality classifier", keep_quality),
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", one_of_each_group),
    ("substring dedup", cut_repeats),
    ("best-fit packing", pack),
]
#: Trained classifiers and a tokenizer can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
    return docs
