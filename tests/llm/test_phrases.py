"""Counting quotient filters and phrase collocations."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from assayline.llm import collocations, quotient
from assayline.llm.quotient import Counts, U


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 42), st.integers(1, 3), st.integers(0, 6), st.integers(0, 2**32))
def test_filters_give_back_keys_and_counters(bits, n, cut, seed):
    rng = np.random.default_rng(seed)
    size = int(rng.integers(1, 300))
    ids = [rng.integers(0, min(1 << bits, 40) if seed % 2 else 1 << bits, size) for _ in range(n)]
    counts = rng.choice([1, 2, 254, 255, 256, 10**12], size)
    width = bits * n
    a, b = quotient.halves(width)
    left, right = quotient.packed(ids, bits)
    assert all((x == y).all() for x, y in zip(quotient.unpacked(left, right, bits, n), ids, strict=True))
    mixed = quotient.permute(left, right, width)
    assert all((x == y).all() for x, y in zip(quotient.restore(*mixed, width), (left, right), strict=True))
    filters = [Counts.from_bytes(Counts.of(*(x[part] for x in mixed), counts[part], a, b).to_bytes()) for part in (slice(0, size // 2), slice(size // 2, size))]
    cut, got = min(cut, a), Counter()
    for f in filters:
        for top, part in f.ranges(cut):
            part = Counts.from_bytes(part.to_bytes())
            full = part.left | (U(top) << U(a - cut) if a - cut < 64 else U(0))
            for *key, c in zip(*quotient.unpacked(*quotient.restore(full, part.right, width), bits, n), part.count, strict=True):
                got[tuple(map(int, key))] += int(c)
    want = Counter()
    for *key, c in zip(*ids, counts, strict=True):
        want[tuple(map(int, key))] += int(c)
    assert got == want
    assert len(Counts.merged(filters)) == len(want)
    each = Counts.of_each(*mixed, a, b)
    assert dict(zip(zip(each.left.tolist(), each.right.tolist(), strict=True), each.count.tolist(), strict=True)) == Counter(zip(*(x.tolist() for x in mixed), strict=True))


def plain(rows, least, longest, share, top):
    f, total = {}, Counter()
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(upper)):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            total[lang] += len(words)
            for k in range(1, longest + 1):
                f.setdefault(lang, Counter()).update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, count in f.items():
        often = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in often.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i : i + m]] = max(inside[p[i : i + m]], a)
        found = []
        for p, a in often.items():
            score, _, left, right = min((10**6 * a * a // (count[p[:k]] * count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
            if not inside[p] or 100 * inside[p] < share * a:
                found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def some_rows(seed):
    rng = random.Random(seed)
    words = ["the", "of", "New", "YORK", "été", "ñu", "a-b", "x1", "日本", "İ", "’s"] + [f"w{i}" for i in range(60)]
    rows = []
    for _ in range(120):
        lang = rng.choice(["en", "de", "und", None, ""])
        text = []
        for _ in range(rng.choice([0, 5, 60])):
            text.append(rng.choice(["new york city", "of the", rng.choice(words), rng.choice(words)]))
            text.append(rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "!?", "\r\n", "\x0b"]))
        rows.append((lang, "".join(text)))
    rows += [("en", None), (None, None), ("de", " ".join(rng.choice(words[:9]) for _ in range(4000))), ("de", "z" * 5000), ("en", "...\n!?")]
    return rows + rows[:20]


@pytest.mark.parametrize(("longest", "top", "block", "chunk"), [(3, 2000, 1 << 19, 1 << 20), (3, 7, 200, 500), (2, 50, 64, 100), (6, 2000, 300, 1000)])
def test_collocations_equal_plain_version(spark, monkeypatch, longest, top, block, chunk):
    monkeypatch.setattr(collocations, "BLOCK", block)
    monkeypatch.setattr(collocations, "CHUNK_WORDS", chunk)
    monkeypatch.setattr(collocations, "CHUNK_VOCABULARY", max(50, chunk // 10))
    monkeypatch.setattr(collocations, "WAITING", 97)
    rows = some_rows(longest)
    docs = spark.createDataFrame([(lang, text, i, "x", 0, "y") for i, (lang, text) in enumerate(rows)], "lang string, text string, id int, Phrase string, n int, word string")
    got = collocations.collocations(docs.repartition(3), least=6, longest=longest, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain(rows, 6, longest, 50, top)


def test_words_that_the_bitmap_lets_through_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(collocations, "MOST_BITS", 64)
    rows = some_rows(9)
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(map(tuple, collocations.collocations(docs, least=6).collect())) == plain(rows, 6, 3, 50, 2000)


def test_keys_as_text_for_very_many_words(spark, monkeypatch):
    monkeypatch.setattr(collocations, "key_of", lambda ids, bits, words, of=collocations.key_of: of(ids, 60, words))
    rows = some_rows(4)
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(map(tuple, collocations.collocations(docs, least=6).collect())) == plain(rows, 6, 3, 50, 2000)


def test_nothing_frequent_and_empty_tables(spark):
    for rows in ([], [("en", None)], [("en", "one two three")], [("en", "word. " * 20)]):
        assert collocations.collocations(spark.createDataFrame(rows, "lang string, text string")).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    a, left, right = 3_000_000_019, 3_000_000_019, 9_000_000_000
    row = spark.createDataFrame([(a, left, right)], "a long, l long, r long").select(collocations.score_of(F.col("a"), F.col("l"), F.col("r"))).first()
    assert row[0] == 10**6 * a * a // (left * right)
