"""A corpus pipeline: five stages, each on all that its predecessor kept, written as Parquet and read again.

run() applies STAGES to the documents table of a folder. No SQL stands beside it: neither the fitted model of the
first stage nor the components of the second can be written as one statement; tests hold it against plain Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import bpe, decontaminate, secret_scan, similarity_join, toxicity
from tracewell.llm._shared import staged, table

#: Near duplicates here: shingles of five words, four fifths in common.
SHINGLE_WORDS, PERCENT = 5, 80


def _sized(docs: DataFrame) -> DataFrame:
    """n_chars follows the text where a stage has changed it."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of linked documents stays."""
    return similarity_join.deduplicate(docs, n=SHINGLE_WORDS, percent=PERCENT)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out; what is left of a document stays."""
    return _sized(decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; all documents stay."""
    return _sized(secret_scan.redact(docs))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, their number, and digests of the ids and of what they decode to."""
    return bpe.round_trip(docs, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", cut_benchmark),
    ("secret scans", redact_secrets),
    ("BPE encoding and decoding", tokenize),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = staged(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
