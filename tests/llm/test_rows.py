"""Embeddings, sharding, URL filters, language ID, secrets and the pipeline."""

import base64
import hashlib
import itertools
import json
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from assayline.llm import cap_filters, language, queries, secrets, sharding, url_filter

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize(("part", "complete"), [(8, False), (512, False), (512, True)])
def test_embedding_links_equal_plain_version(spark, part, complete, monkeypatch):
    monkeypatch.setattr(cap_filters, "PART", part)
    rng = np.random.default_rng(part)
    rows = []
    for label in (0, 1):
        for _ in range(6):
            centre = rng.standard_normal(32)
            for _ in range(12):
                rows.append((centre + rng.standard_normal(32) * rng.choice([0.0, 0.1, 0.15, 0.3]), label))
    rows = [(i, v.astype(np.float32).tolist(), label) for i, (v, label) in enumerate(rows)]
    rows += [(1000, None, 0), (1001, [0.0] * 32, 0), (1002, [None] + rows[0][1][1:], 0), (1003, [float("nan")] + rows[0][1][1:], 0), (1004, rows[0][1], None),
             (1005, rows[0][1][:31], 0), (1006, [], 0), (1007, [x * 2 for x in rows[0][1]], 0), (1008, rows[0][1], 1), (1009, [float("inf")] * 32, 1), (5, rows[5][1], 0)]
    good = [k for k, (_, v, label) in enumerate(rows) if v and label is not None and None not in v and np.isfinite(v).all() and any(v)]
    links = []
    for a, b in itertools.combinations(good, 2):
        x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
        if rows[a][2] == rows[b][2] and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
            links.append((a, b))
    comp = {k: k for k in range(len(rows))}
    for _ in rows:
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    least = {}
    for k, c in comp.items():
        least[c] = min(least.get(c, 10**9), rows[k][0])
    want = sorted((rows[k][0], sum(k in x for x in links), least[c]) for k, c in comp.items())
    got = cap_filters.embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), complete=complete)
    assert sorted(map(tuple, got.collect())) == want
    assert cap_filters.embedding_links(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


@pytest.mark.parametrize("side", [32, 128, 400, 1000])
def test_recall_does_not_depend_on_size(side):
    """Pairs at the limit without a common filter: about one in ten a code, at any number of directions."""
    rng, n = np.random.default_rng(side), 1500
    x = cap_filters.unit_rows(rng.standard_normal((n, 64)))
    other = rng.standard_normal((n, 64))
    other = cap_filters.unit_rows(other - (other * x).sum(1, keepdims=True) * x)
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * other
    rates, all_miss, lengths = [], np.ones(n, bool), []
    for k in range(cap_filters.CODES):
        code = cap_filters.ProductCode(64, side, k)
        a, b = code.decode(x), code.decode(y)
        miss = np.array([not set(p.tolist()) & set(q.tolist()) for p, q in zip(a, b, strict=True)])
        rates.append(miss.mean())
        all_miss &= miss
        lengths.append(np.mean([len(p) for p in a]))
    assert np.prod(rates) <= 5e-5 and not all_miss.any()
    assert 0.6 <= np.mean(lengths) / cap_filters.list_length(side) <= 1.6


def test_recall_of_cap_filters():
    codes, rng = [cap_filters.ProductCode(64, 60, k) for k in range(cap_filters.CODES)], np.random.default_rng(3)
    x = cap_filters.unit_rows(rng.standard_normal((2000, 64)))
    other = rng.standard_normal((2000, 64))
    other = cap_filters.unit_rows(other - (other * x).sum(1, keepdims=True) * x)
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * other
    missed = np.ones(len(x), bool)
    for code in codes:
        missed &= [not set(p.tolist()) & set(q.tolist()) for p, q in zip(code.decode(x), code.decode(y), strict=True)]
    assert missed.mean() <= 0.004


@pytest.mark.parametrize("block", [7, 2048])
def test_links_that_no_filter_holds_are_found(spark, block, monkeypatch):
    monkeypatch.setattr(cap_filters, "BLOCK", block)
    codes, rng = [cap_filters.ProductCode(64, 32, k) for k in range(cap_filters.CODES)], np.random.default_rng(5)
    x = cap_filters.unit_rows(rng.standard_normal((20_000, 64)))
    other = rng.standard_normal(x.shape)
    other = cap_filters.unit_rows(other - (other * x).sum(1, keepdims=True) * x)
    y = 0.9801 * x + np.sqrt(1 - 0.9801**2) * other
    missed = np.ones(len(x), bool)
    for code in codes:
        missed &= [not set(p.tolist()) & set(q.tolist()) for p, q in zip(code.decode(x), code.decode(y), strict=True)]
        surely = ~(code.is_open(x, 0.98) & code.is_open(y, 0.98))
        assert surely.any() and not (missed & surely).any()
    assert missed.sum() >= 5
    rows = [(2 * i + k, v.tolist(), 1) for i, pair in enumerate(zip(x[missed], y[missed], strict=True)) for k, v in enumerate(pair)]
    rows.append((len(rows), rows[0][1], 1))  # a copy counts with its weight
    got = sorted(map(tuple, cap_filters.embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()))
    assert got == [(0, 2, 0), (1, 2, 0), *((i, 1, i - i % 2) for i in range(2, len(rows) - 1)), (len(rows) - 1, 2, 0)]


def test_table_is_balanced_and_changes_little():
    names = tuple(f"s{i}" for i in range(7))
    table = sharding.fill(names, 1009)
    counts = np.bincount(table)
    assert counts.max() - counts.min() <= 1
    fewer = sharding.fill(names[:-1], 1009)
    assert sum(a != b for a, b in zip(table, fewer, strict=True) if a != 6) < 0.25 * 1009
    assert sharding.fill(("only",), 5) == [0] * 5
    for bad in ((), ("a", "a")):
        with pytest.raises(ValueError):
            sharding.fill(bad, 11)
    with pytest.raises(ValueError):
        sharding.fill(("a", "b"), 12)


def test_placing(spark):
    df = spark.createDataFrame([(1, "x", 7), (None, None, 7), (1, "y", 7), (10**15, "", 7)], "doc_id long, text string, slot int")
    got = sharding.place(df).collect()
    assert len(got) == 4
    table = sharding.fill(sharding.SHARDS)
    for x in got:
        slot = int(hashlib.md5(("null" if x.doc_id is None else str(x.doc_id)).encode()).hexdigest()[:15], 16) % sharding.SLOTS
        assert (x._slot, x._shard) == (slot, sharding.SHARDS[table[slot]])
    assert sharding.place(df.limit(0)).count() == 0


def test_shard_query(spark):
    docs = dict(map(tuple, queries.table(spark, FOLDER, "documents").select("doc_id", "text").collect()))
    table = sharding.fill(sharding.SHARDS)
    got = queries.op5_sharding(spark, FOLDER).collect()
    assert len(got) == len(docs)
    for x in got:
        assert x.shard == sharding.SHARDS[table[x.slot]] and x.text_sha256 == hashlib.sha256((docs[x.doc_id] or "").encode()).hexdigest()


def test_url_verdicts(spark, monkeypatch):
    urls = ["http://A.Example.NET/en/x", "http://example.net/fr/", "http://badexample.net", "https://x.org/fr/a", "https://x.org/de/", "http://www.example.com/de/1?x#y",
            "http://host.io/a/?utm_source=q&b=2&a=1#f", "https://HOST.io:443/a?a=1&b=2", "http://host.io/a", None, "no scheme", "://", "http://net/", "http://host.io/z", "http://host.io/z"]
    pages = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    listed = spark.createDataFrame([("ftp://www.host.io/a/?b=2&a=1",), ("http://host.io/z",), (None,), ("junk",)], "url string")
    want = [("a.example.net", "/en/x", "example.net/en/", "allow"), ("example.net", "/fr/", "net/", "block"), ("badexample.net", "", None, "allow"),
            ("x.org", "/fr/a", "org/fr/", "allow"), ("x.org", "/de/", None, "allow"), ("www.example.com", "/de/1", "example.com/de/", "block"),
            ("host.io", "/a/", None, "block"), ("host.io:443", "/a", None, "block"), ("host.io", "/a", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
            ("", "", None, "allow"), ("net", "/", "net/", "block"), ("host.io", "/z", None, "block"), ("host.io", "/z", None, "block")]
    for bits in (12, 1):  # with one block all may pass the filter; the join decides
        monkeypatch.setattr(url_filter, "MAX_BLOCKS", bits)
        got = url_filter.judge(pages, listed).orderBy("page_id").select("_host", "_path", "_rule", "_verdict").collect()
        assert [tuple(x) for x in got] == want
    assert url_filter.judge(pages.limit(0), listed.limit(0)).count() == 0


def test_posteriors_equal_enumeration():
    rng = np.random.default_rng(1)
    fits, begin, change = rng.random((9, 3)), rng.random(3), rng.random((3, 3))
    starts = np.array([0, 4, 5, 9])
    post, pairs, log_z = language.forward_backward(fits, starts, begin, change, learn=True)
    total, want_pairs = 0.0, np.zeros((3, 3))
    for a, b in zip(starts, starts[1:], strict=False):
        z, want = 0.0, np.zeros((b - a, 3))
        here = np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=b - a):
            p = begin[path[0]] * np.prod([fits[a + t, y] for t, y in enumerate(path)]) * np.prod([change[x, y] for x, y in zip(path, path[1:], strict=False)])
            z += p
            for t, y in enumerate(path):
                want[t, y] += p
            for x, y in zip(path, path[1:], strict=False):
                here[x, y] += p
        assert np.allclose(post[a:b], want / z)
        total += np.log(z)
        want_pairs += here / z
    assert np.allclose(pairs, want_pairs) and np.isclose(log_z, total)


def test_language_query_on_held_out_rows(spark):
    docs = {x.doc_id: x for x in queries.table(spark, FOLDER, "documents").collect()}
    got = queries.op7_language_id(spark, FOLDER).collect()
    assert len(got) == len(docs)
    held = [x for x in got if x.held_out]
    assert {x.doc_id for x in held} == {i for i in docs if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([x.lang_pred == docs[x.doc_id].lang for x in held]) > 0.97
    assert all(0 <= x.score <= 1 for x in got)


def test_all_languages_are_learned_from(spark, monkeypatch):
    monkeypatch.setattr(language, "fit", lambda rows, languages: (rows, languages))
    rows = [(f"l{i:02}", f"word{'x' * i} {j}") for i in range(80) for j in range(200)]
    rows += [("long", f"begin{j} " + "langes wort\n" * 2000) for j in range(3)] + [("late", "1" * 60_000 + "wort"), ("signs", "12 - 34")]
    rows += [("rare", None)] * 3000 + [("rare", "copy")] * 3000 + [("rare", f"text {j}") for j in range(40)]
    sample, languages = language.learn(spark.createDataFrame(rows, "lang string, text string"))
    assert languages == sorted({*(f"l{i:02}" for i in range(80)), "long", "late", "rare"})
    sizes = {x: sum(lang == x for lang, _ in sample) for x in languages}
    assert sizes.pop("long") == 3 and sizes.pop("late") == 1 and sizes.pop("rare") == 41 and set(sizes.values()) == {int(120 * 64 / 83)}
    assert all(len(text) <= int(20_000 * 64 / 83) and any(map(str.isalpha, text)) for _, text in sample)
    nothing = language.learn(spark.createDataFrame([("signs", "12 - 34"), ("none", None)], "lang string, text string"))
    assert nothing.languages == []


def test_language_of_odd_rows(spark):
    rows = [("en", "the house and the garden of the people"), ("de", "das Haus und der Garten der Leute"), (None, "nothing")] * 10
    model = language.learn(spark.createDataFrame(rows, "lang string, text string"))
    assert model.languages == ["de", "en"]
    texts = ["the garden", "der Garten", "", None, "123 .,", "²", "\n\n", "the people\nund der Garten der Leute", "x" * 100_000, "the " * 50_000]
    df = spark.createDataFrame([(t, "de", i) for i, t in enumerate(texts)], "text string, lang string, score int")
    got = [(x._lang_pred, x._score) for x in language.predict(df, model).orderBy("score").collect()]
    assert [x for x, _ in got][:8] == ["en", "de", "und", "und", "und", "und", "und", "de"] and got[9][0] == "en"
    assert all(s == 0 for x, s in got if x == "und") and all(0 <= s <= 1 for _, s in got)
    nothing = language.learn(df.select("text", "lang").where("lang is null"))
    assert {x._lang_pred for x in language.predict(df, nothing).collect()} == {"und"}
    assert language.predict(df.limit(0), model).count() == 0


def der(tag, body):
    size = bytes([len(body)]) if len(body) < 128 else bytes([0x82, *len(body).to_bytes(2, "big")])
    return bytes([tag]) + size + body


KEY = der(0x30, der(0x02, b"\x00") + der(0x30, der(0x06, b"\x2a\x86\x48")) + der(0x04, bytes(range(200))))


def plain_base(text):
    assign = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = [(m.start(), 0, m.end()) for m in assign.finditer(text or "") if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 24])


def test_structure_decides():
    b64 = base64.b64encode(KEY).decode()
    head = base64.urlsafe_b64encode(json.dumps({"alg": "HS256"}).encode()).decode().rstrip("=")
    ssh = base64.b64encode(b"\x00\x00\x00\x0bssh-ed25519\x00\x00\x00\x20" + bytes(32)).decode()
    pem = "-----BEGIN PRIVATE KEY-----\n" + "\n".join(re.findall(".{1,64}", b64)) + "\n-----END PRIVATE KEY-----"
    kinds = lambda t: [secrets.KINDS[k] for _, k, _ in secrets.confirmed_spans(t)]
    assert kinds(f"é {b64} x") == ["der"] and kinds(KEY.hex().upper()) == ["der"] and kinds(f"x {ssh}") == ["ssh"] and kinds(pem) == ["pem"]
    assert kinds(f"t {head}.eyJ4IjoxfQ.abc") == ["token"]
    assert not kinds(b64[:-8]) and not kinds(base64.b64encode(bytes(range(100))).decode()) and not kinds("eyJhIjoxfQ.eyJ4IjoxfQ.abc") and not kinds("a" * 5000)
    assert not kinds(pem.replace(b64[4:10], "AAAAAA")) and not secrets.der_ends(b"\x30\x80" * 60, 0, 120, set())
    start, _, end = secrets.confirmed_spans(f"é {b64} x")[0]
    assert (start, end) == (2, 2 + len(b64))


def test_secret_query_keeps_base_spans(spark):
    texts = dict(map(tuple, queries.table(spark, FOLDER, "documents").select("doc_id", "text").collect()))
    odd = spark.createDataFrame(
        [(1, None, 0), (2, "", 0), (3, "ſecret=abcdef PASSWORD : 'abc-12' toKen=abcdef api_key=12345", 0), (3, "é token='abcdef' " + "0" * 24 + " AKIA" + "Z" * 16, 0)],
        "doc_id long, text string, spans int")
    for got, want in ((queries.op10_secrets(spark, FOLDER).collect(), texts), (secrets.find_secrets(odd.where("doc_id < 3")).collect(), {1: None, 2: ""})):
        assert len(got) == len(want)
        for x in got:
            base = plain_base(want[x.doc_id])
            assert (x.n_assign, x.n_access, x.n_hex) == tuple(sum(k == kind for _, k, _ in base) for kind in range(3))
            assert x.base_sha256 == hashlib.sha256(secrets.joined(base).encode()).hexdigest()
            assert set(secrets.joined(base).split(",")) <= set(x.spans.split(","))
    got = sorted(x.spans for x in secrets.find_secrets(odd.where("doc_id = 3")).collect())
    assert got == ["assign:14:32", "assign:2:15,hex:17:41,access:42:62"]


def test_pipeline_on_planted_rows(spark, tmp_path):
    docs = queries.table(spark, FOLDER, "documents")
    texts = dict(map(tuple, docs.select("doc_id", "text").collect()))
    long = " ".join(" ".join(t or "" for _, t in sorted(texts.items())[:40]).split()[::7][:200])
    item = queries.table(spark, FOLDER, "benchmark").first().text
    clean = "Quiet harbours wake before dawn while gulls circle patient boats near weathered stone walls."
    more = [(10**6, clean), (10**6 + 1, clean + " " + " ".join(f"n{i}ord" for i in range(60)) + " " + item), (10**6 + 2, "12345 67"), (10**6 + 3, None),
            (10**6 + 4, long + " extra"), (999_999, long), (10**6 + 5, clean)]
    rows = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in more], docs.schema)
    folder = str(tmp_path)
    docs.unionByName(rows).write.parquet(f"{folder}/documents.parquet")
    queries.table(spark, FOLDER, "benchmark").write.parquet(f"{folder}/benchmark.parquet")
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, folder)
        if name != "sentencepiece":
            assert frame.columns == docs.columns
        frame = corpus_pipeline.settle(frame, name)
        kept.append({x.doc_id for x in frame.select("doc_id").collect()})
    assert kept[0] >= kept[1] >= kept[2] >= kept[3] and kept[3] == kept[4]
    assert 10**6 in kept[0] and not kept[0] & {10**6 + 2, 10**6 + 3} and kept[1] == kept[0]
    assert 10**6 in kept[4] and not kept[2] & {10**6 + 4, 10**6 + 5}
    assert 10**6 + 1 in kept[2] and 10**6 + 1 not in kept[3]
    assert all(x.n_pieces == len(x.pieces) for x in frame.collect())
