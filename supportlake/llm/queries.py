"""The registered queries of the operators, with their oracles where SQL
can say them.  Merged into the entry point by ``__spark_entry__`` only."""

from __future__ import annotations

import os
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supportlake.llm import (
    bytebpe, filteraudit, kdtree, langid, linededup, mih, packing, quality, rans, resample, secretscan, simhash, urltrust)
from supportlake.session import ensure_checkpoint_dir

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

#: (host, path, verdict), the rules of the contract
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(_read(spark, sf_dir, "documents"), shingle=3, radius=3)


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urltrust.judge_urls(_read(spark, sf_dir, "pages"), URL_RULES)


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mih.search(_read(spark, sf_dir, "embeddings"), every=50, k=5)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), WORD_BPE, capacity=4096, end_id=1)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_read(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = os.path.join(ensure_checkpoint_dir(spark), "token-files", uuid.uuid4().hex)
    return rans.roundtrip(_read(spark, sf_dir, "documents"), path, WORD_BPE, end_id=1)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = langid.fit(langid.training_rows(docs))
    return langid.identify(docs, model).select(
        "doc_id", (langid.held_out_remainder(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.array_join(F.transform("removed", lambda s: F.concat_ws("-", s["start"].cast("string"), s["stop"].cast("string"))), ",")
    return linededup.remove_repeats(_read(spark, sf_dir, "documents"), whole_lines=True).select(
        "doc_id", "text", F.coalesce(spans, F.lit("")).alias("removed"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.roundtrip_digests(_read(spark, sf_dir, "documents"), BYTE_BPE, public_tokenizers.PATTERN)


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.search(_read(spark, sf_dir, "embeddings"), every=100, k=10, scale=1024)


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.scan(_read(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (
    op1_simhash, op2_url_filters, op3_nearest, op4_packing, op5_quality, op6_token_files, op7_language, op8_repeats,
    op9_byte_bpe, op10_top_k, op11_secrets, op12_filter_audit, op13_resample)}

ORACLES = {
    "op2_url_filters": urltrust.oracle_sql(URL_RULES),
    "op8_repeats": linededup.oracle_sql(),
    "op10_top_k": kdtree.oracle_sql(),
    "op11_secrets": secretscan.oracle_sql(),
    "op12_filter_audit": filteraudit.oracle_sql(),
    "op13_resample": resample.oracle_sql(),
}
