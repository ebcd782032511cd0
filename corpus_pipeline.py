"""The document pipeline: toxicity, near-duplicates, benchmark passages, then sampled SentencePiece segmentations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import decontaminate, minhash, segment, toxicity
from sparkloom.llm.queries import NOT_HELD_OUT, tokenizer_path
from sparkloom.llm.store import kept, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score doesn't reject. The lexicon is learned from the labelled rows of docs."""
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels"), train=NOT_HELD_OUT)
    return toxicity.accepted(docs, lexicon).select(*COLUMNS)


def not_repeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id."""
    return minhash.deduplicated(docs).select(*COLUMNS)


def not_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.removed(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def segmented(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every document that is left, by rank, each decoded again and compared."""
    return segment.sample(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [("toxicity", not_toxic), ("near_dedup", not_repeated), ("decontamination", not_benchmark), ("sentencepiece", segmented)]

#: Learned scores and seeded sampling can't be written in SQL; the tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = kept(docs, f"stage-{name}")
    return docs
