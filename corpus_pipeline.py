"""A training-corpus pipeline over the documents table: filter, deduplicate, redact, mix, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. Every stage works on all rows its predecessor kept; all but the last return the columns of documents.

Cases, for every stage: an empty table gives an empty result; rows of equal id and text are rows of their own unless the stage
says otherwise; ties are settled by id or by hashes of id and text, so reruns agree; texts of any length are taken whole;
further columns of docs, of any name, are carried along (the last stage returns its own columns alone).
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regimera.llm import jaccard_join, mixing, quality_rules, registry, secret_scan, sentencepiece_ac
from regimera.llm.common import discard, last_written, materialise, n_written, table, written_since

_left: dict[str, list[str]] = {}


def staged(f):
    """Deletes the tables that the stage before wrote for itself: its result has been written by now."""

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        key = spark.sparkContext.applicationId
        discard(spark, _left.pop(key, []))
        mark = n_written()
        out = f(spark, docs, sf_dir)
        _left[key] = written_since(mark)
        return out

    return run_stage


@staged
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the risk-controlled rules.

    A null, empty or blank text has no words and goes. A null language is a stratum of its own; repeated rows are all kept or
    all go. Without labels only the base rule rejects; a null label or one of an unknown id counts for nothing.
    """
    return quality_rules.kept_documents(docs, table(spark, sf_dir, "labels"))


@staged
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    Null and empty texts are in no group and stay; of rows that repeat an id one stays; rows without an id all stay.
    """
    return jaccard_join.one_of_each(docs)


@staged
def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with secrets replaced by a mark; n_chars follows the text.

    A null text stays null, an empty one empty; repeated rows are treated alike; null sources are one owner.
    """
    return secret_scan.redact(docs)


@staged
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the shares of the target weights; repeats are repeated rows, each document three times at most.

    Null, empty and blank texts hold no words and are taken 0 times; a null source is a source of its own, the last.
    """
    return mixing.mixed_documents(docs)


@staged
def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, ids): piece ids of each row; none for a null or empty text."""
    encoded = sentencepiece_ac.encode(docs, sentencepiece_ac.load_pieces(registry.PIECE_MODEL))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids")


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("secret scans", secret_stage),
    ("mixing sources", mixing_stage),
    ("SentencePiece encoding", encoding_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written to the shared folder and read again; a stage's table goes when the next has been written."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        result = stage(spark, docs, sf_dir)
        docs = materialise(result, "stage-" + name.replace(" ", "-"))
        discard(spark, before)
        before = [last_written()]
    return STAGES[-1][1](spark, docs, sf_dir)
