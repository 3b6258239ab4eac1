"""Queries of the driver for the operators of this package, and their DuckDB equivalents."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, jaccard_join, langid, line_dedup, mixing, oracle, quality_fm, sentencepiece_viterbi, substring_dedup, topk_search, url_filter

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def piece_model_path() -> str:
    """TESSERA_PIECE_MODEL, or the public model of this machine."""
    return os.environ.get("TESSERA_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(modulus: int):
    return F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(modulus))


def op1_language_id(spark, sf_dir):
    return langid.identify(_table(spark, sf_dir, "documents"), F.coalesce(_fold(5) == 0, F.lit(False)))


def op2_jaccard_join(spark, sf_dir):
    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark, sf_dir):
    kept = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op4_url_filter(spark, sf_dir):
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"), RULES)


def op5_quality_fm(spark, sf_dir):
    return quality_fm.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), F.coalesce(_fold(4) == 2, F.lit(False)))


def op6_line_dedup(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.dedup_lines(docs, count_col="n_removed")
    return kept.select("doc_id", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op7_topk_search(spark, sf_dir):
    return topk_search.top_k(_table(spark, sf_dir, "embeddings"), lambda c: c % 20 == 0)


def op8_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op9_mixing(spark, sf_dir):
    return mixing.mix_report(_table(spark, sf_dir, "documents")).drop("copies")


def op10_sentencepiece(spark, sf_dir):
    model = sentencepiece_viterbi.Model.read(piece_model_path())
    pieces = _table(spark, sf_dir, "documents").select("doc_id", "text", sentencepiece_viterbi.encode_and_decode(F.col("text"), model).alias("p"))
    back = pieces.select("doc_id", "text", F.col("p.ids").alias("ids"), F.col("p.decoded").alias("decoded"))
    return back.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), F.sha2(F.coalesce("decoded", F.lit("")), 256).alias("decoded_sha256"), F.expr("decoded <=> text").alias("round_trip"))


def queries():
    found = [op1_language_id, op2_jaccard_join, op3_substring_dedup, op4_url_filter, op5_quality_fm, op6_line_dedup, op7_topk_search, op8_exact_dedup, op9_mixing, op10_sentencepiece]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
