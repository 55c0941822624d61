"""A training corpus from raw documents: quality, one of each near duplicate, no benchmark
passages, no secrets, token ids. Every stage works on all rows that its predecessor kept."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundcover.llm import bpe, decontaminate, quality, secret_scan, simhash
from groundcover.llm.common import free_name
from groundcover.session import materialize
from groundcover.sources.tables import load_table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on their labels, doesn't reject."""
    labels = load_table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    into = free_name(docs, "score")
    scored = quality.score(docs, quality.train(docs, labels), into)
    return scored.where(F.col(into) >= quality.THRESHOLD).drop(into)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, the one with the smallest id: four-word shingles, at most 4 differing bits."""
    return simhash.one_of_each(docs, width=simhash.WIDTH)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no ten-word passage of a benchmark item occurs."""
    return decontaminate.without_contaminated(docs, load_table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret in the text replaced by a mark."""
    return secret_scan.redacted(docs, secret_scan.train(docs))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids, their number, and the text that the ids decode to."""
    coded = bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return coded.select("doc_id", F.size("ids").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality classifier", good_documents),
    ("SimHash near-dedup", without_near_duplicates),
    ("benchmark decontamination", without_benchmark),
    ("secret scans", without_secrets),
    ("BPE encoding", token_ids),
]

ORACLE_SQL = None  # a trained classifier and a tokenizer; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written to the shared folder and read again."""
    docs = load_table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"corpus-{number}")
    return docs
