"""A training-data pipeline over documents: quality, near-duplicates, secrets, mixture, pieces.

Every stage but the last returns the columns of documents, whatever further columns there are and whatever their names:
rows are carried whole. The stages are written as Parquet and read again by whoever runs them one by one; run() does so in
the shared folder. An empty table gives an empty table in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import mixing, pieces, quality, secret_scan, simhash
from lectern.llm.common import settle
from lectern.llm.queries import tokenizer_file


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the cascade.

    A null, empty or short text has under 50 words and goes. Texts of any length are judged whole. Rows are judged one by
    one, so repeated rows and rows with equal or null doc_ids stay or go alike.
    """
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, with the least doc_id, of each group of near copies: five-word shingles, similarity 0.8 or more.

    Texts without words are one group. Rows with a null doc_id stay, as they cannot be named. Of repeated rows one stays; rows
    that share a doc_id but not their text stay or go with their own groups. Long texts are compared whole.
    """
    return simhash.keep_one(docs, width=5, lanes=4, radius=simhash.RADIUS, distinct=True, min_similarity=0.8)


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced by the kind's name; every row stays.

    Null and empty texts stay as they are. Long texts are scanned whole, repeated rows come out alike, and n_chars follows
    a changed text.
    """
    return secret_scan.redact(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight asks: each at least once, none of a source over twice its share.

    A null source is a source. Null and empty texts cost nothing and come as often as their place in the order says; a
    source without any word has no weight and gives no rows. Repeated rows are rows of their own.
    """
    return mixing.mix(docs, entropy_share=0.9, max_repeats=2.0).select("doc.*")


def sampled_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the sampled piece ids of each document, their number, the text's length, and whether they decode to it.

    Null and empty texts have no ids. The same doc_id and text give the same ids, so repeated rows do; null doc_ids share a
    seed. Long texts are encoded whole.
    """
    return pieces.encode(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("secret_scans", secret_redaction),
    ("source_mixing", source_mixing),
    ("sentencepiece", sampled_pieces),
]

#: Fingerprints and sampled pieces are not SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents in order; what a stage returns is written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = settle(docs)
    return docs
