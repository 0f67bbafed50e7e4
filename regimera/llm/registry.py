"""The corpus queries op1 to op10 and their DuckDB equivalents where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import html_template, jaccard_join, lm_lbl, matroska, mixing, oracles, quality_fm, quality_rules, secret_scan, sentencepiece_ac, token_count
from .common import table

try:  # the folder of the public tokenizer files, if it is a package here
    from public_tokenizers import path as _path
except ImportError:
    _path = "/opt/tokenizers/{}".format

#: Vocabulary files; both are parameters of the operators.
BYTE_VOCABULARY = str(_path("byte_bpe_50k.json"))
PIECE_MODEL = str(_path("piece_bpe_32k.model"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality_rules.judge(docs, labels, keep=["doc_id"])


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.drop("found")


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.digest(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_fm.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), token_count.load_vocabulary(BYTE_VOCABULARY))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_ac.digest(table(spark, sf_dir, "documents"), sentencepiece_ac.load_pieces(PIECE_MODEL))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_template.extract(table(spark, sf_dir, "pages"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_lbl.score_corpus(table(spark, sf_dir, "documents"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_html_extraction": op3_html_extraction,
    "op4_mixing": op4_mixing,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_media_columns": op6_media_columns,
    "op7_token_count": op7_token_count,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_secret_scan": op10_secret_scan,
}
ORACLES: dict[str, str] = {
    "op1_quality_rules": oracles.QUALITY_RULES,
    "op2_jaccard_join": oracles.JACCARD_JOIN,
    "op10_secret_scan": oracles.SECRET_SCAN,
}
