"""The corpus pipeline: five stages, each over all that its predecessor kept.

Language ID drops documents without a letter; line dedup drops frequent lines; of near
duplicates one stays; documents with a passage of the benchmark go; what is left is encoded into pieces.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import assayline
from assayline.llm import language, line_dedup, near_dup, pieces, winnowing
from assayline.llm.queries import held_out, table, tokenizer_file
from assayline.session import settle

cloudpickle.register_pickle_by_value(assayline)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.learn(docs.where(~held_out()).select("text", "lang"))
    judged = language.predict(docs, model)
    return judged.where(F.col("_lang_pred") != language.UNKNOWN).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(docs)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return winnowing.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = tokenizer_file("piece_bpe_32k.model")
    done = pieces.encode(docs, path)
    return done.select("doc_id", "lang", "source", F.size("_pieces").cast("long").alias("n_pieces"), F.col("_pieces").alias("pieces"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("minhash_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("sentencepiece", encode_pieces),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs
