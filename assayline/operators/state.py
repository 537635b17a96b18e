"""Mergeable state of an audit: what a batch of rows adds, kept as rows, so that a grown corpus is not read again.

A state has four tables. `cells`: counters, sums, ends and a quantile sketch of the lengths for each year and court.
`distincts`: per column that must not repeat (and for the metadata key) rows, rows with a value, and a sketch of distinct
values. `suspicious`: the first `TOP` rows of that list. `sample`: the verification sample. Each is of bounded size whatever
the batch (cells: one row per year and court), and each merges: states of any cut of a corpus into batches, merged in any
order, give the tables of `audits.full_audit` over the whole.

What is exact and what is not: all counters, ends, averages and ranked lists are exact. Quantiles come from KLL sketches of
`QUANTILE_K`: exact for up to that many rows, beyond that the rank is off by less than `RANK_ERROR`. Distinct counts come from
theta sketches of 2^`DISTINCT_BITS` entries: exact up to that many distinct values, beyond that off by a relative standard
error of 1 / sqrt(2^`DISTINCT_BITS`), 0.4 per cent; `distinct_error` is two of these. For exact excess over batches see
`known.py`, which remembers the keys themselves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.operators import profile, sampling
from assayline.operators.profile import quality_flags, row_facts, structural_flags
from assayline.vocabulary import METADATA_KEY

QUANTILE_K, RANK_ERROR = 1600, 0.003
DISTINCT_BITS = 16
TOP = 1000
UNIQUE = ("id", "document_id", "raw_sha256")
KEY = "metadata_key"
TABLES = ("cells", "distincts", "suspicious", "sample")
_GROUP = ("year", "court")

State = dict[str, DataFrame]


def _flag_names(source_name: str | None) -> list[str]:
    return list(structural_flags(source_name) | quality_flags())


def cells(df: DataFrame, source_name: str | None = None) -> DataFrame:
    """One row per year and court, from one scan of the text."""
    flags = structural_flags(source_name) | quality_flags()
    chars = F.col("_chars").cast("bigint")
    return row_facts(df, flags, *_GROUP).groupBy(*_GROUP).agg(
        *profile.counters(flags), F.min(chars).alias("min_chars"), F.max(chars).alias("max_chars"),
        F.sum(chars).alias("sum_chars"), F.count(chars).alias("known_chars"),
        F.kll_sketch_agg_bigint(chars, QUANTILE_K).alias("chars_sketch"))


def distincts(df: DataFrame, columns: tuple[str, ...] = UNIQUE, keys: tuple[str, ...] = METADATA_KEY) -> DataFrame:
    """(column, rows, non_null, sketch). One narrow scan for all columns; a key with NULL parts is a value of its own."""
    key = F.to_json(F.struct(*[F.coalesce(F.col(k).cast("string"), F.lit("")).alias(f"v{i}") for i, k in enumerate(keys)],
                             *[F.col(k).isNull().alias(f"n{i}") for i, k in enumerate(keys)]))
    named = {c: F.col(c).cast("string") for c in columns} | {KEY: key}
    whole = df.agg(F.count("*").alias("rows"), *[x for c, v in named.items() for x in (
        F.count(v).alias(f"{c}_non_null"), F.theta_sketch_agg(v, DISTINCT_BITS).alias(f"{c}_sketch"))])
    return whole.select(F.explode(F.array(*[F.struct(
        F.lit(c).alias("column"), "rows", F.col(f"{c}_non_null").alias("non_null"), F.col(f"{c}_sketch").alias("sketch")) for c in named])).alias("d")).select("d.*")


def audit_state(df: DataFrame, source_name: str | None = None) -> State:
    """The state of a corpus, or of a batch of one."""
    return {
        "cells": cells(df, source_name), "distincts": distincts(df),
        "suspicious": sampling.suspicious_top(df, TOP), "sample": sampling.stratified_sample(df).drop("stratum", "court_group"),
    }


def merge_states(*states: State) -> State:
    """One state out of those of several batches."""
    every = {name: reduce(DataFrame.unionByName, [s[name] for s in states]) for name in TABLES}
    sums = [c for c in every["cells"].columns if c not in (*_GROUP, "min_chars", "max_chars", "chars_sketch")]
    return {
        "cells": every["cells"].groupBy(*_GROUP).agg(*_merged(sums)),
        "distincts": every["distincts"].groupBy("column").agg(
            F.sum("rows").alias("rows"), F.sum("non_null").alias("non_null"), F.theta_union_agg("sketch", DISTINCT_BITS).alias("sketch")),
        "suspicious": sampling.first_k(every["suspicious"], TOP),
        "sample": sampling.stratified_sample(every["sample"]).drop("stratum", "court_group"),
    }


def _merged(sums: list[str]) -> list[Column]:
    return [*[F.sum(c).alias(c) for c in sums], F.min("min_chars").alias("min_chars"), F.max("max_chars").alias("max_chars"),
            F.kll_merge_agg_bigint("chars_sketch", QUANTILE_K).alias("chars_sketch")]


def save_state(state: State, path: str, batch: str) -> None:
    """Writes the state of a batch below `path`; a batch that is written again replaces its former state."""
    for name in TABLES:
        state[name].write.mode("overwrite").parquet(f"{path}/{name}/batch={batch}")


def load_state(spark: SparkSession, path: str) -> State:
    """The merged state of all batches below `path`. Only state rows are read."""
    return merge_states({name: spark.read.parquet(f"{path}/{name}").drop("batch") for name in TABLES})


def state_cube(state: State) -> DataFrame:
    """The cells at the four grains of `profile.audit_cube`, with its columns."""
    sums = [c for c in state["cells"].columns if c not in (*_GROUP, "min_chars", "max_chars", "chars_sketch")]
    grains = [[F.col("year"), F.col("court")], [F.col("year")], [F.col("court")], []]
    cube = state["cells"].withColumn("_year", F.col("year")).groupingSets(grains, *_GROUP).agg(
        (F.grouping("year") == 0).alias("by_year"), (F.grouping("court") == 0).alias("by_court"),
        F.min("_year").alias("min_year"), F.max("_year").alias("max_year"), *_merged(sums))
    flags = [c for c in sums if c not in ("rows", "sum_chars", "known_chars")]

    def at(p: float) -> Column:
        return F.when(F.col("known_chars") > 0, F.kll_sketch_get_quantile_bigint("chars_sketch", F.lit(p))).cast("int")

    return cube.select(
        *_GROUP, "by_year", "by_court", "rows", *flags, "min_year", "max_year", F.col("min_chars").cast("int").alias("min_chars"),
        at(0.01).alias("p01_chars"), at(0.5).alias("median_chars"), at(0.99).alias("p99_chars"), F.col("max_chars").cast("int").alias("max_chars"),
        F.try_divide(F.col("sum_chars").cast("double"), F.col("known_chars").cast("double")).alias("avg_chars"))


def state_excess(state: State) -> DataFrame:
    """(column, rows, distinct_values, excess, distinct_error): distinct values and excess as estimated, and how far they
    may be off; 0 as long as the sketch holds all values."""
    estimate = F.theta_sketch_estimate("sketch").cast("bigint")
    error = F.when(estimate < (1 << DISTINCT_BITS), 0.0).otherwise(2 / (1 << DISTINCT_BITS) ** 0.5)
    return state["distincts"].select(
        "column", "rows", F.least(estimate, "non_null").alias("distinct_values"),
        (F.col("rows") - F.least(estimate, "non_null")).alias("excess"), error.alias("distinct_error"))
