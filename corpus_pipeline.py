"""A corpus from raw documents to token ids, in five stages.

``run`` applies the stages to ``documents``; each stage's rows are written and read
again before the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import decontam, lines, pieces, quality, queries, simhash, store

#: Five-word shingles, and the similarity from which on two documents are near copies.
SHINGLE, SIMILARITY = 5, 0.8


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    known = queries.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return quality.accepted(docs, known)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many sites share; ``n_chars`` follows the text."""
    out = lines.dedup(docs)
    return out.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the least id."""
    return simhash.deduplicate(docs, SHINGLE, SIMILARITY)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark."""
    return decontam.clean(docs, queries.table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document."""
    return pieces.encode(docs, queries.piece_model())


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", line_dedup),
    ("simhash near-dedup", simhash_dedup),
    ("benchmark decontamination", decontaminate),
    ("sentencepiece encoding", encode),
]

#: SQL can't express the classifier, the fingerprints or the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store.materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
