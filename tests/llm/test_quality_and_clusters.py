"""Line-first cleaning and centroid clustering."""

import hashlib
import math
import re

import numpy as np
import pytest

from assayline.llm import quality, simplex

WORD = re.compile("[^ \t\n\x0b\x0c\r]+")


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


TEXTS = [
    None, "", " \n\t", "one", "a b c a b c", "a b c\na b c\n\na b c ", "x y z " * 40, "é ü 日本 語. " * 30, "# * $ % & | < >", "a\x1cb c d", "\n\n", "a\r\nb\r\n",
    "End.\nHome | About | Contact | Imprint\nBuy $$$ now %%% ***\nTHIS IS ALL IN CAPITALS.\nWhat!! Now!! Yes!!\nAll rights reserved.\nno mark at the end\nQuoted end.” \n",
    "The quick brown fox jumps. " * 3 + " ".join(f"word{i}" for i in range(60)) + ".",
    "\n".join(f"Home | {i} | About" for i in range(40)) + "\n" + " ".join(f"w{i}" for i in range(55)) + ".",
]


@pytest.mark.parametrize("limit", [16, 1 << 20])
def test_counts_and_verdicts(spark, monkeypatch, limit):
    monkeypatch.setattr(quality, "BLOCK", limit)
    docs = spark.createDataFrame([(i, t, "kept", 3) for i, t in enumerate(TEXTS + TEXTS)], "id int, text string, _KEPT string, n_words int").repartition(2)
    done = quality.clean_lines(docs)
    assert [c for c in done.columns if c.lower() == "_kept"] == ["_kept"] and "n_words" in done.columns
    rows = {r.id: r for r in done.collect()}
    assert len(rows) == 2 * len(TEXTS)
    for i, text in enumerate(TEXTS + TEXTS):
        r = rows[i]
        want = plain_counts(text)
        assert (r._n_words, r._word_chars, r._n_symbols, r._n_dup_lines, r._n_repeat_words) == want, text
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert r._base_failed is failed
        assert r._kept is (not failed and 2 * r._n_lost_words <= want[0])
    r = rows[12]
    assert r._failed_lines == dict.fromkeys(quality.RULES, 1) | {"shouting": 2}
    assert r.text == "End.\nQuoted end.” \n"
    assert rows[0].text is None and rows[1].text == "" and rows[13]._kept and not rows[14]._kept
    assert quality.clean_lines(docs.limit(0)).count() == 0


def test_a_long_text_and_many_words():
    rng = np.random.default_rng(5)
    words = rng.integers(0, 3000, 200_000)
    words[1000:1300] = words[5000:5300]
    doc = np.sort(rng.integers(0, 3, len(words)))
    got = quality.repeated_words(words.astype(np.int32), doc)
    seen = {}
    for i in range(len(words) - 2):
        if doc[i] == doc[i + 2]:
            seen.setdefault((doc[i], *words[i : i + 3].tolist()), []).append(i)
    want = np.zeros(len(words), bool)
    for at in seen.values():
        for i in at if len(at) > 1 else ():
            want[i : i + 3] = True
    assert (got == want).all()
    big = words.astype(np.int32) + (np.arange(len(words)) == 7) * (1 << 22)  # so many numbers that three do not fit
    assert (quality.repeated_words(big, doc) == want).all()
    text = b" ".join(b"w%d" % w for w in words)
    assert (np.diff(np.unique(quality.word_numbers(text), return_index=True)[1]) > 0).all()


def test_most_clean_documents_are_kept(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.clean_lines(docs).join(labels, "doc_id").where("NOT _base_failed").groupBy("quality", "_kept").count().collect()
    count = {(r.quality, r._kept): r["count"] for r in rows}
    assert count[1, True] >= 0.99 * (count[1, True] + count.get((1, False), 0))
    assert count[0, False] >= 0.9 * (count[0, False] + count.get((0, True), 0))


def plain_clusters(rows, count, rounds, size):
    kept = []
    for k, v in rows:
        if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v):
            kept.append((k, [int(x) * 1024 if abs(x) >= 2.0**52 else math.floor(x * 1024) for x in v]))
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [list(v) for _, v in order[:count]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centres)) for _, v in kept]

    for _ in range(rounds):
        at = assign()
        for k in range(len(centres)):
            of = [v for (_, v), (_, c) in zip(kept, at, strict=True) if c == k]
            if of:
                centres[k] = [sum(x) // len(of) for x in zip(*of, strict=True)]
    at = assign()
    fit = lambda x: x if x < 2**63 else None
    inertia = {k: sum(d for d, c in at if c == k) for k in range(len(centres))}
    every = [d for d, _ in at]
    whole = None if any(fit(d) is None for d in every) else fit(sum(every))
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    part = {k: None if any(fit(d) is None for d, c in at if c == k) else fit(v) for k, v in inertia.items()}
    return sorted(((k, c, fit(d), part[c], whole, names[c]) for (k, _), (d, c) in zip(kept, at, strict=True)), key=repr)


def vectors(seed, size, n):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((5, size))
    return [(i, (centres[i % 5] + rng.standard_normal(size) * 0.3).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize(("size", "n", "count"), [(64, 300, 8), (3, 200, 8), (1, 50, 4), (16, 5, 8)])
def test_clusters_equal_plain_version(spark, size, n, count):
    rows = vectors(n, size, n)
    rows += [(1000, None), (1001, [1.0] * (size + 1)), (1002, [None] + [1.0] * (size - 1)), (1003, [float("nan")] * size), (1004, [float("-inf")] * size),
             (1005, []), (None, rows[0][1]), (2, rows[2][1]), (2, rows[3][1]), (1006, rows[0][1]), (1007, [0.0] * size)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, cluster int, APEX string").repartition(3)
    got = simplex.clustered(df, count, 10, size)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_clusters(rows, count, 10, size)


def test_ties_equal_vectors_and_empty_tables(spark):
    schema = "vec_id long, embedding array<float>"
    rows = [(i, [float(i % 2)] * 4) for i in range(40)]
    got = simplex.clustered(spark.createDataFrame(rows, schema), 8, 3, 4)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_clusters(rows, 8, 3, 4)
    assert simplex.clustered(spark.createDataFrame([], schema)).count() == 0
    assert simplex.clustered(spark.createDataFrame([(1, None)], schema)).count() == 0


def test_huge_components(spark):
    rows = [(i, [float(x) * (1e300 if i == 3 else 1e6 if i % 4 else 1.0) for x in v]) for i, v in vectors(1, 4, 30)]
    got = simplex.clustered(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 4, 5, 4)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_clusters(rows, 4, 5, 4)


def test_bounds_keep_the_nearest_and_drop_others():
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((8, 64)) * 1024
    x = np.floor(np.repeat(centres, 50, axis=0) + rng.standard_normal((400, 64)) * 200).astype(np.int64)
    centroids = np.floor(centres).astype(np.int64).astype(object)
    shape = simplex.Simplex.over(centroids)
    may = simplex.may_be_nearest(x, shape.place(x), shape, centroids)
    exact = ((x[:, None, :] - centroids.astype(np.int64)[None]) ** 2).sum(2)
    at, distance, taken = simplex.nearest(x, may, centroids)
    assert (at == exact.argmin(1)).all() and (distance == exact.min(1)).all()
    assert taken < 0.5 * exact.size  # the filter spares most comparisons
    twice = simplex.Simplex.over(np.concatenate([centroids, centroids]))
    assert len(twice.pivots) == 8
