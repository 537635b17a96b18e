"""Line dedup, decontamination and near-dedup against plain versions, with nulls, repeats and empty tables."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from assayline.llm import components, line_dedup, near_dup, winnowing

DOCS = "doc_id long, text string, line string, a string"
LINES = ["  The same line that many pages carry \t", "the SAME line that many pages carry", "short", "", "Another long enough line here é",
         "a line in only two documents, long", "exactly twenty chars", "nineteen characters"]


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "x", None) for i, t in rows], DOCS)


def plain_lines(rows):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    holds = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holds[key(line)].add(i)
    last = {k: max(x for x in v if x is not None) for k, v in holds.items() if len(v) >= 3}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in last or last[key(x)] == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def test_line_dedup_equals_plain_version(spark):
    rnd = random.Random(3)
    rows = [(i, "\n".join(rnd.choices(LINES, k=rnd.randint(1, 6)))) for i in range(40)]
    rows += [(None, LINES[0]), (None, None), (50, ""), (51, None), (3, rows[3][1]), (60, LINES[0] + "\n" + "word " * 40_000)]
    got = line_dedup.dedup_lines(documents(spark, rows)).select("doc_id", "text", "_n_lines", "_n_dropped", "line").collect()
    assert sorted(map(repr, ((*x[:4],) for x in got))) == sorted(map(repr, plain_lines(rows)))
    assert {x.line for x in got} == {"x"}


def test_line_dedup_of_nothing(spark):
    assert line_dedup.dedup_lines(documents(spark, [])).count() == 0


def plain_hits(docs, items):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    words = lambda t: word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        k = min(len(w), 10)
        for s in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[s : s + k])].add(i)
    sizes, out = {len(x) for x in windows}, []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for k in sizes:
            for s in range(len(w) - k + 1):
                if tuple(w[s : s + k]) in windows:
                    hit |= set(range(s, s + k))
                    found |= windows[tuple(w[s : s + k])]
        out.append((i, len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return out


@pytest.mark.parametrize("letters", [2, 3, 40])
def test_contamination_equals_plain_version(spark, letters):
    rnd = random.Random(letters)
    vocabulary = [f"w{i}" for i in range(letters - 1)] + ["Größe"]
    text = lambda n: rnd.choice([" ", ", ", "\n"]).join(rnd.choices(vocabulary, k=n))
    items = [(i, text(rnd.choice([1, 5, 9, 10, 11, 30]) if letters > 3 else rnd.choice([8, 10, 14, 30]))) for i in range(20)]
    items += [(100, None), (101, ""), (102, " .,"), (103, items[0][1]), (None, items[1][1])]
    docs = [(i, text(rnd.randint(0, 60))) for i in range(30)]
    docs += [(40 + i, f"{text(20)} {items[i][1].upper()} {text(20)}") for i in range(20)]
    docs += [(90, None), (91, ""), (None, items[2][1]), (7, docs[7][1]), (92, "_" + items[3][1])]
    frame = spark.createDataFrame(items, "item_id long, text string")
    got = winnowing.contamination(documents(spark, docs), frame)
    assert sorted(map(repr, ((x[0], x[1], x[2], list(x[3])) for x in got.collect()))) == sorted(map(repr, plain_hits(docs, items)))
    clean = [(i, t) for (i, t), (_, _, n, _) in zip(docs, plain_hits(docs, items), strict=True) if n == 0]
    left = winnowing.decontaminate(documents(spark, docs), frame)
    assert left.columns == ["doc_id", "text", "line", "a"]
    assert sorted(map(repr, left.select("doc_id", "text").collect())) == sorted(repr(x) for x in documents(spark, clean).select("doc_id", "text").collect())


def test_contamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert winnowing.contamination(documents(spark, []), none).count() == 0
    assert winnowing.contamination(documents(spark, [(1, "a b c")]), none).first()[:3] == (1, 3, 0)


def plain_components(nodes, links):
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    return {n: top(n) for n in nodes}


def test_components_equal_plain_version(spark):
    rnd = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(rnd.randrange(200, 400), rnd.randrange(200, 400)) for _ in range(120)] + [(500, 500)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == plain_components(nodes, [e for e in edges if e[0] != e[1]])
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_sets(text, width):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in re.split("[\x20\x09-\x0d]+", w) if x]
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def near_copies():
    rnd = random.Random(11)
    base = [[f"w{rnd.randrange(10**6)}" for _ in range(rnd.choice([3, 30, 90, 200]))] for _ in range(15)]
    rows = []
    for words in base:
        for _ in range(8):
            new = [f"x{rnd.randrange(10**6)}" if rnd.random() < rnd.choice([0, 0.01, 0.03]) else w for w in words]
            rows.append((len(rows) * 7 % 1009, " ".join(new)))
    crowd = [f"c{rnd.randrange(10**6)}" for _ in range(100)]  # many that share passages, most of them below the limit
    for _ in range(120):
        rows.append((2000 + len(rows), " ".join(f"y{rnd.randrange(10**6)}" if rnd.random() < 0.035 else w for w in crowd)))
    return [*rows, (900_000, None), (900_001, ""), (900_002, " \n"), (rows[0][0], rows[0][1]), (5_000_000, rows[20][1].upper()), (900_003, "one"), (900_004, "ONE")]


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates_equal_plain_version(spark, width, monkeypatch):
    monkeypatch.setattr(near_dup, "PART", 16)  # crowded buckets are cut
    rows = near_copies()
    sets = [plain_sets(t, width) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    comp = plain_components(range(len(rows)), links)
    least = defaultdict(lambda: 10**9)
    for n, c in comp.items():
        least[c] = min(least[c], rows[n][0])
    want = sorted((rows[n][0], len(sets[n]), least[c]) for n, c in comp.items())
    got = near_dup.near_duplicates(documents(spark, rows), width, 80).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == want
    left = near_dup.drop_near_duplicates(documents(spark, rows), width, 80)
    assert left.columns == ["doc_id", "text", "line", "a"]
    assert sorted(x.doc_id for x in left.collect()) == sorted(set(least.values()))


def test_near_duplicates_of_null_ids_and_nothing(spark):
    text = " ".join(map(str, range(50)))
    got = near_dup.near_duplicates(documents(spark, [(None, text), (4, text), (None, "other words are here now")])).collect()
    assert sorted(map(repr, ((x.doc_id, x.component_id) for x in got))) == ["(4, 4)", "(None, 4)", "(None, None)"]
    assert near_dup.near_duplicates(documents(spark, [])).count() == 0
    assert near_dup.drop_near_duplicates(documents(spark, [(None, text), (4, text), (4, text)])).count() == 1


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    a, b = (np.unique(rng.integers(0, 2**63, 400, dtype=np.uint64)) for _ in range(2))
    ra, rb, both = near_dup.sketches([a, b, np.unique(np.concatenate([a, b]))], 96)
    assert (near_dup.merge(ra, rb) == both).all()
    missed = 0
    for _ in range(200):
        one, two = np.concatenate([a[:350], rng.integers(0, 2**63, 40, dtype=np.uint64)]), a[:350]
        x, y = near_dup.sketches([np.unique(one), two], 96)
        n = np.array([len(one)]), np.array([len(two)])
        missed += not near_dup.likely(*n, np.array([(x > y).sum()]), np.array([(x < y).sum()]), np.array([(x == y).sum()]), 0.8)[0]
    assert not missed
    n = np.array([400])
    assert not near_dup.likely(n, n, *(np.array([v]) for v in ((ra > rb).sum(), (ra < rb).sum(), (ra == rb).sum())), 0.8)[0]
    assert hashlib.sha256(ra.tobytes()).digest() == hashlib.sha256(near_dup.sketches([a], 96)[0].tobytes()).digest()
