"""Near duplicates in the core: groups against a plain version, hot buckets, the gate."""

import itertools
import random

from pyspark.sql import functions as F

from assayline.operators import graph, near
from assayline.plans import audits
from tests.conftest import rows


def _plain(texts):
    """Groups by exact Jaccard over five-word runs, as lists of places."""
    sets = []
    for t in texts:
        w = (t or "").split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    root = list(range(len(texts)))
    for _ in texts:
        for a, b in itertools.combinations(range(len(texts)), 2):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[a] = root[b] = min(root[a], root[b])
    return [len(s) for s in sets], root


def _texts(seed, groups, size):
    rng = random.Random(seed)
    letters = "abcdefghijklmnop"
    out = []
    for _ in range(groups):
        base = ["".join(rng.choices(letters, k=5)) for _ in range(rng.choice([3, 8, 40, 90]))]
        for _ in range(rng.randint(1, size)):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                words[rng.randrange(len(words))] = "".join(rng.choices(letters, k=5))
            out.append(" ".join(words))
    rng.shuffle(out)
    return out


def test_groups_equal_plain_version(spark):
    texts = _texts(3, 14, 7) + [None, "", " \n", "tek", "TEK", "tek  ", "bir iki üç"]
    sizes, root = _plain([(t or "").lower() for t in texts])
    want = sorted((i, sizes[i], root[i] if sizes[i] else None) for i in range(len(texts)))
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(5)
    got = near.near_duplicates(df).select("id", "shingles", "group")
    assert sorted(map(tuple, got.collect())) == want
    excess = near.near_duplicate_excess(df).first()
    alone = sum(s == 0 for s in sizes)
    assert tuple(excess) == (len(texts), len({r for s, r in zip(sizes, root) if s}) + alone, len(texts) - alone - len({r for s, r in zip(sizes, root) if s}))


def test_pairs_across_groups_of_a_bucket(spark, monkeypatch):
    """Classes that the smallest of their bucket does not reach are still compared with each other, piece by piece."""
    buckets = spark.createDataFrame([(1, n) for n in range(40)] + [(2, 50), (2, 51)], "band long, node long")
    roots = spark.createDataFrame([(n, 0) for n in range(0, 40, 2)], "node long, root long")
    for piece in (3, 512):
        got = sorted(map(tuple, near.open_pairs(buckets, roots, piece).collect()))
        assert got == [(a, b) for a in range(1, 40) for b in range(a + 1, 40) if a % 2 or b % 2]


def test_many_copies_make_few_pairs(spark):
    """A crowd of near copies is settled by its smallest member: as many pairs as classes and buckets, not their square."""
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join([*base[:k], "x", *base[k + 1 :]]) for k in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    sets = near._kept_sets(df, "id", "text", near.WIDTH)
    buckets = near.bands(sets.select(F.col("uid").alias("node"), "grams"))
    first = near.first_pairs(buckets)
    assert first.count() <= 150 * near.BANDS
    grams = sets.select(F.col("uid").alias("node"), "grams")
    roots = graph.connected(near.linked(first, grams))
    assert near.open_pairs(buckets, roots).count() == 0
    assert near.near_duplicate_excess(df).first()["groups"] == 1


def test_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, x) for x in range(8, 40)] + [(3, 3), (None, 5), (60, 61), (61, 60)]
    got = rows(graph.connected(spark.createDataFrame(links, "a long, b long")))
    want = [(i, 100) for i in range(100, 161)] + [(x, 7) for x in range(7, 40)] + [(60, 60), (61, 60)]
    assert sorted(got) == sorted(want)
    assert graph.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty_table_and_repeated_ids(spark):
    assert near.near_duplicates(spark.createDataFrame([], "id string, text string")).count() == 0
    assert tuple(near.near_duplicate_excess(spark.createDataFrame([], "id string, text string")).first()) == (0, 0, 0)
    df = spark.createDataFrame([("a", "bir iki"), ("a", "bir iki"), (None, "üç dört"), (None, "beş altı")], "id string, text string")
    got = sorted(map(tuple, near.near_duplicates(df).select("id", "group").collect()), key=repr)
    assert got == [("a", "a"), ("a", "a"), (None, None), (None, None)]
    assert near.near_duplicate_excess(df).first()["excess"] == 1


def test_value_reaches_the_gate(spark):
    df = spark.createDataFrame([(i, f"metin {i % 9} " + "a b c d e") for i in range(10)], "id long, text string")
    totals = spark.createDataFrame([(10, 0, 0, 0)], "rows long, empty_text long, any_known_placeholder long, lt_100_chars long")
    excess = spark.createDataFrame([("id", 10, 10, 0)], "column string, rows long, distinct_values long, excess long")
    gaps = spark.createDataFrame([], "year int")
    metrics = audits.acceptance_metrics(totals, excess, gaps, near=near.near_duplicate_excess(df))
    gate = audits.acceptance(spark, metrics)["gates"].where("metric = 'near_duplicate_rate'").first()
    assert (gate["observed"], gate["state"]) == (0.1, "FAIL")


def test_signatures_agree_as_often_as_sets_do(spark):
    """One pass over the arrays, without a row per shingle: equal minima of two sets are as frequent as common members."""
    rng = random.Random(5)
    members = [rng.getrandbits(64) - (1 << 63) for _ in range(300)]
    sets = [(0, members[:200]), (1, members[20:200]), (2, members[100:]), (3, members[:1]), (4, []), (5, None)]
    df = spark.createDataFrame(sets, "node long, grams array<long>")
    plan = near.bands(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    got = {r.node: r.bands for r in near.signatures(df, 1, 4000).collect()}
    assert sorted(got) == [0, 1, 2, 3]
    assert len(set(got[3])) == 4000
    share = lambda a, b: sum(x == y for x, y in zip(got[a], got[b])) / 4000
    assert abs(share(0, 1) - 0.9) < 0.03 and abs(share(0, 2) - 1 / 3) < 0.04 and share(0, 3) < 0.03


def test_pieces_of_a_batch_do_not_change_its_signatures(spark, monkeypatch):
    df = spark.createDataFrame([(n, [n * 7919 * k for k in range(1, 2 + n % 9)]) for n in range(60)], "node long, grams array<long>").coalesce(1)
    want = rows(near.bands(df))
    monkeypatch.setattr(near, "AT_ONCE", 5)
    assert rows(near.bands(df)) == want and len(want) == 60 * near.BANDS
