"""The corpus pipeline: documents to token ids in stages, each calling one operator of ``cohortlens.llm``.

Every stage takes the documents its predecessor kept and returns documents, so its result can be written
and read again; ``run`` chains the stages over the ``documents`` table.

Defined results: null and empty texts pass every stage but the first, where they stand or fall by the score of
a document without words; repeated rows are judged alike; texts of any length are read whole; an empty table
stays empty through all stages; further columns of ``documents`` go through unchanged, also where their names
clash with those an operator adds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortlens.llm import bpe, decontaminate, line_dedup, near_dup, quality
from cohortlens.llm.common import prepare, table
from cohortlens.llm.queries import word_tokenizer


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that it rejects go."""
    return quality.drop_rejected(docs, table(spark, sf_dir, "labels"))


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: lines above the boilerplate ratio of their source go."""
    prepare(spark)
    return line_dedup.drop_lines(docs, n_chars="n_chars")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: of each group the document of the smallest id stays."""
    prepare(spark)
    return near_dup.drop_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: contaminated documents go."""
    return decontaminate.drop_contaminated(
        decontaminate.scan(docs, table(spark, sf_dir, "benchmark"))
    )


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE: token ids of every document, with digests of the ids and of the text they decode to."""
    prepare(spark)
    return bpe.encode_documents(docs, word_tokenizer())


STAGES = [
    ("quality", drop_low_quality),
    ("line_dedup", drop_boilerplate_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

# The quality classifier and the tokenizer cannot be stated in SQL; tests hold each stage against a
# brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
