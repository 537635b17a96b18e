"""Joins with a second source: one scan a side, distinct names scored once, bounds that hold."""

import random

from pyspark.sql import functions as F

from assayline.functions.similarity import jaro_winkler_bound, jaro_winkler_of
from assayline.operators import matching
from tests.conftest import rows


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_absent_scans_each_side_once(spark, tmp_path):
    data = [(i % 50 if i % 3 else None, f"k{i % 7}" if i % 4 else None, i) for i in range(400)]
    spark.createDataFrame(data, "a int, b string, n int").write.parquet(str(tmp_path / "l"))
    spark.createDataFrame(data[:100:2], "a int, b string, n int").write.parquet(str(tmp_path / "r"))
    left, right = spark.read.parquet(str(tmp_path / "l")), spark.read.parquet(str(tmp_path / "r"))
    got = matching.absent(left, right, ("a", "b"))
    assert scans(got) == 2 and got.columns == ["a", "b", "n"]
    known = {(a, b) for a, b, _ in data[:100:2] if a is not None and b is not None}
    assert rows(got) == sorted(((a, b, n) for a, b, n in data if (a, b) not in known), key=repr)
    assert matching.absent(left, right.limit(0), ("a",)).count() == 400
    assert matching.absent(left.limit(0), right, ("a",)).count() == 0


def test_bound_is_never_passed(spark):
    rng = random.Random(5)
    names = ["", "a", "12 hukuk dairesi", "14 hukuk dairesi", "ceza", "şğı", "ığş", "ş", "ğ"] + [
        "".join(rng.choice("abcş ğ1") for _ in range(rng.randint(0, 9))) for _ in range(60)]
    pairs = [(rng.choice(names), rng.choice(names)) for _ in range(1500)]
    df = spark.createDataFrame(pairs, "a string, b string")
    for a, b, bound in df.select("a", "b", jaro_winkler_bound(F.col("a"), F.col("b"))).collect():
        assert jaro_winkler_of(a, b) <= bound + 1e-12, (a, b)


def test_each_distinct_pair_is_scored_once(spark):
    rng = random.Random(2)
    courts = ["1 hukuk", "11 hukuk", "2 ceza", "", "x", None, "hukuk 1"]
    pairs = spark.createDataFrame([(rng.choice(courts), rng.choice(courts), i) for i in range(900)], "ext_canon string, cand_canon string, n int")
    scored = matching.scored_names(pairs)
    got = {(r.ext_canon, r.cand_canon): r.similarity for r in scored.collect()}
    assert scored.count() == len(got) == 36
    for (a, b), s in got.items():
        exact = jaro_winkler_of(a, b)
        assert s == exact if s is not None else exact < 0.9
    assert any(s is None for s in got.values())
    every = matching.scored_names(pairs, 0.0)
    assert all(r.similarity == jaro_winkler_of(r.ext_canon, r.cand_canon) for r in every.collect())


def test_normal_form_is_worked_out_once_a_side(spark, tmp_path):
    from assayline.operators import duplicates

    for side in "lr":
        spark.createDataFrame([(i, f"Metin {i % 5}" if i % 4 else None) for i in range(40)], "id int, text string").write.parquet(str(tmp_path / side))
    left, right = (spark.read.parquet(str(tmp_path / side)) for side in "lr")
    found = duplicates.text_overlap(left, right).select("id", "in_other")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert scans(found) == 2 and len([x for x in plan.split("\n") if "regexp_replace(" in x]) == 2
    counts = {k: sum(i % 5 == k and i % 4 > 0 for i in range(40)) for k in range(5)}
    assert rows(found) == sorted(((i, counts[i % 5] if i % 4 else 0) for i in range(40)), key=repr)
