"""Corpus shards, one shard, the second source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.functions.dates import dotted_year
from assayline.spec import CORPUS, EXTERNAL


def scan_corpus(spark: SparkSession, *globs: str) -> DataFrame:
    """All shards behind the globs, with the fixed schema (no footer is read to plan)."""
    return spark.read.schema(CORPUS).parquet(*globs)


def widen(df: DataFrame) -> DataFrame:
    """Spreads a scan that has fewer parts than the cluster has cores: a few small files with heavy text work.

    A large table has more parts than that and is left as it is, so no shuffle is added to it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def scan_shard(spark: SparkSession, path: str) -> DataFrame:
    """One file with whatever columns it has."""
    return spark.read.parquet(path)


def scan_external(spark: SparkSession, *globs: str) -> DataFrame:
    """The second source; its year comes from the date text."""
    return with_decision_year(spark.read.schema(EXTERNAL).parquet(*globs))


def with_decision_year(df: DataFrame, date: str = "karar_tarihi") -> DataFrame:
    return df.withColumn("decision_year", dotted_year(F.col(date)))
