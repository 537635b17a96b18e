"""Mergeable audit state: batches audited one by one give the audit of the whole."""

import random

import pytest
from pyspark.sql import functions as F

from assayline.operators import sampling, state
from assayline.plans import audits
from assayline.spec import CORPUS
from tests.conftest import rows


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("state") / "c")
    df = spark.range(0, 3000, 1, 3).select(
        F.when(F.col("id") % 97 == 5, None).otherwise(F.concat(F.lit("d"), F.col("id") % 2900)).alias("id"),
        F.when(F.col("id") % 10 != 3, F.lit("x")).alias("source"), F.col("id").cast("string").alias("document_id"),
        F.when(F.col("id") % 11 == 0, None).otherwise(F.concat(F.col("id") % 4, F.lit(". Hukuk"))).alias("court"),
        F.concat(F.lit("2001/"), F.col("id") % 700).alias("esas_no"), F.when(F.col("id") % 3 == 0, F.lit("k")).alias("karar_no"),
        F.when(F.col("id") % 13 != 0, (F.lit(1997) + F.col("id") % 30).cast("smallint")).alias("year"),
        F.when(F.col("id") % 50 != 7, F.concat(F.lit("karar "), F.repeat(F.lit("hüküm "), (F.pmod(F.xxhash64("id"), F.lit(300))).cast("int")))).alias("text"),
        F.sha2((F.col("id") % 2990).cast("string"), 256).alias("raw_sha256"))
    named = [F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in CORPUS.fields]
    df.select(*named).write.parquet(path)
    return spark.read.parquet(path)


def batches(df, count, seed):
    rng = random.Random(seed)
    parts = [df.where(F.pmod(F.xxhash64(F.lit(seed), "document_id"), F.lit(count)) == k) for k in range(count)]
    rng.shuffle(parts)
    return parts


def test_state_of_batches_equals_the_audit_of_the_whole(spark, corpus, tmp_path):
    whole = audits.full_audit(corpus, "x")
    path = str(tmp_path / "s")
    for k, part in enumerate([*batches(corpus, 2, 5), corpus.limit(0)]):
        state.save_state(state.audit_state(part, "x"), path, str(k))
    state.save_state(state.audit_state(batches(corpus, 2, 5)[0], "x"), path, "0")  # a batch that is run again replaces itself
    got = audits.audit_from_state(state.load_state(spark, path))
    exact = [c for c in whole["cube"].columns if c not in ("p01_chars", "median_chars", "p99_chars", "avg_chars")]
    assert got["cube"].columns == whole["cube"].columns
    assert rows(got["cube"], *exact) == rows(whole["cube"], *exact)
    near = {tuple(r)[:2]: r for r in whole["by_year_court"].collect()}
    for r in got["by_year_court"].collect():  # few rows a cell: quantiles are exact there
        assert r == near[tuple(r)[:2]]
    for name in ("by_year", "by_court", "duplicates"):
        assert rows(got[name], *whole[name].columns) == rows(whole[name])
    assert got["key_excess"].first()["excess"] == whole["key_excess"].first()["excess"]
    order = [x["severity"] for x in got["suspicious"].collect()]
    assert order == sorted(order) and rows(got["suspicious"].drop("document_id")) == rows(whole["suspicious"].drop("document_id"))
    assert rows(got["verification_sample"], "document_id", "stratum") == rows(whole["verification_sample"], "document_id", "stratum")


@pytest.mark.parametrize("count", [1, 3, 9])
def test_quantiles_stay_within_the_error_and_order_does_not_matter(spark, corpus, count):
    totals = state.state_cube(state.merge_states(*[{**state.audit_state(corpus.limit(0)), "cells": state.cells(p)} for p in batches(corpus, count, count)]))
    r = totals.where("NOT by_year AND NOT by_court").first()
    lengths = sorted(len(x.text) for x in corpus.where("text IS NOT NULL").select("text").collect())
    for p, value in ((0.01, r.p01_chars), (0.5, r.median_chars), (0.99, r.p99_chars)):
        low = sum(x < value for x in lengths) / len(lengths)
        high = sum(x <= value for x in lengths) / len(lengths)
        assert low - state.RANK_ERROR <= p <= high + state.RANK_ERROR
    assert r.rows == 3000 and r.avg_chars == pytest.approx(sum(lengths) / len(lengths))


def test_distinct_values_beyond_the_sketch(spark, monkeypatch):
    monkeypatch.setattr(state, "DISTINCT_BITS", 10)
    df = spark.range(40_000).selectExpr("cast(id % 30000 as string) as id", "cast(null as string) as k")
    parts = [state.distincts(df.where(f"cast(id as int) % 3 = {k}"), ("id",), ("id", "k")) for k in range(3)]
    empty = {name: spark.createDataFrame([], "a int") for name in state.TABLES}
    merged = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("column").agg(
        F.sum("rows").alias("rows"), F.sum("non_null").alias("non_null"), F.theta_union_agg("sketch", 10).alias("sketch"))
    for r in state.state_excess({**empty, "distincts": merged}).collect():
        assert r.rows == 40_000 and r.distinct_error == 2 / 32
        assert abs(r.distinct_values - 30_000) <= 30_000 * r.distinct_error * 1.5


def test_only_state_rows_are_read(spark, corpus, tmp_path):
    path = str(tmp_path / "s")
    state.save_state(state.audit_state(corpus, "x"), path, "all")
    out = audits.audit_from_state(state.load_state(spark, path))
    for name in ("cube", "duplicates", "suspicious", "verification_sample"):
        assert all(path in f or "/cube-" in f or "/excess-" in f or "/picked-" in f or "/addressed-" in f for f in out[name].inputFiles())


def test_empty_corpus(spark, corpus):
    none = state.audit_state(corpus.limit(0))
    out = audits.audit_from_state(state.merge_states(none, none))
    assert out["by_year"].count() == 0 and out["suspicious"].count() == 0
    assert out["totals"].count() == audits.full_audit(corpus.limit(0))["totals"].count() == 0
    assert [r["rows"] for r in out["duplicates"].collect()] == [0, 0, 0]
