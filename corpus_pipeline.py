"""The corpus pipeline: five stages, each written as Parquet and read again by the next.

Every stage works on all documents that the one before kept. All but the last return the columns of ``documents``: the
quality classifier keeps what it scores at 0.5 or more, exact dedup one document of each group of equal texts, SimHash
near-dedup one of each group of near copies (five-word shingles, Jaccard 0.8 or more), and decontamination what overlaps no
benchmark item. The last stage encodes and decodes the texts that are left and returns their digests.

Null and empty texts are documents like any other: scored, one kept of all equal ones, encoded to no tokens. Very long texts are
read whole; of ties and repeated rows the smallest id stays, null ids last. Empty tables give empty results. Columns beyond those
of ``documents`` are carried through all stages but the last, which returns its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lapforge.llm.bpe import multilingual_digests
from lapforge.llm.common import side_table, table
from lapforge.llm.decontaminate import decontaminate
from lapforge.llm.exact_dedup import exact_dedup
from lapforge.llm.near_copies import drop_near_copies
from lapforge.llm.quality import keep_good


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return multilingual_digests(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("simhash near-dedup", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("byte-level bpe", token_stage),
]

#: The fitted classifier, the fingerprints and the merges have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = side_table(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
