"""The corpus pipeline: quality, language, near-duplicates, repeats, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run``
writes each result as Parquet into the shared folder and reads it back as the
next stage's documents.  All stages but the last return the columns of
``documents``."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from supportlake.llm import langid, linededup, packing, quality, simhash
from supportlake.llm.queries import WORD_BPE
from supportlake.session import ensure_checkpoint_dir, ship_package


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.  Null, empty and short
    texts: the scorer alone decides; rows that repeat stay or go together; an
    empty table gives an empty one; other columns are passed on."""
    ship_package(spark)
    return quality.keep_good(docs)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language (by the fit per n-gram).  Null and
    letterless texts go; where nothing could be learned all stay; rows that repeat
    stay or go together; an empty table gives an empty one; other columns are
    passed on."""
    ship_package(spark)
    return langid.keep_identified(docs, langid.fit(langid.training_rows(docs)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component (3-word shingles, 3 bits): the
    smallest doc_id, null ids last, of several the text with the least hash.  Null
    and wordless texts are one group; rows that repeat id and text are one; an
    empty table gives an empty one; other columns are passed on."""
    ship_package(spark)
    return simhash.keep_one_per_group(docs, shingle=3, radius=3)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one holds (null ids last).
    Every row stays; null texts stay null; rows that repeat id and text are one
    document; an empty table gives an empty one; other columns are passed on, with
    n_chars counted anew."""
    ship_package(spark)
    return linededup.with_repeats_removed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequence and offset.  Null and empty texts are the end
    id alone; very long texts are cut; rows that repeat are packed each; an empty
    table gives an empty one; other columns are not looked at."""
    ship_package(spark)
    return packing.pack(docs, WORD_BPE, capacity=4096, end_id=1)


STAGES = [
    ("quality classifier", keep_quality),
    ("language ID", keep_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("substring dedup", drop_repeats),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = os.path.join(ensure_checkpoint_dir(spark), "pipeline", uuid.uuid4().hex)
        stage(spark, docs, sf_dir).write.mode("error").parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: the quality and language stages learn models, which SQL cannot say
ORACLE_SQL = None
