import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from assayline import CORPUS, CorpusMap
from assayline.functions.similarity import jaro_winkler_of
from assayline.operators import coverage, duplicates, gates, landing, matching, profile, sampling, screening
from assayline.operators import verification
from assayline.plans import audits
from assayline.sources import files, landed, outputs
from assayline.spec import SEARCH_PAGE
from tests.conftest import rows


def corpus(spark, n=60, **over):
    base = [dict(id=f"c:{i}", source="s", document_id=str(i), court=f"{i % 4}. Hukuk", esas_no=f"{2000 + i % 27}/{i}",
                 karar_no=f"2001/{i}", karar_tarihi="2001-01-01", year=2000 + i % 27, month=1, text="karar " * (i + 1),
                 text_len=6 * (i + 1), masked_count=0, raw_sha256=str(i)) for i in range(n)]
    for key, fn in over.items():
        for i, row in enumerate(base):
            row[key] = fn(i)
    return spark.createDataFrame([tuple(r[c] for c in CORPUS.fieldNames()) for r in base], CORPUS)


def test_corpus_map_fills_missing_columns_with_typed_nulls(spark):
    df = CorpusMap({"id": "concat('x', id)"}).apply(spark.range(1))
    assert df.dtypes == spark.createDataFrame([], CORPUS).dtypes and df.first()["id"] == "x0" and df.first()["text"] is None


def test_empty_input_gives_zero_counts(spark):
    empty = corpus(spark, 1).limit(0)
    got = profile.structural_profile(empty, "s").first()
    assert got["rows"] == 0 and got["empty_id"] == 0 and got["max_chars"] is None
    assert duplicates.key_dup_excess(empty).first()[0] == 0
    assert sampling.suspicious_top(empty).count() == 0
    assert sampling.systematic_sample(empty, 10).count() == 0
    assert screening.sanitize_check(empty).first()["passed"]


def test_structure_counts(spark):
    df = corpus(spark, 10, source=lambda i: None if i == 1 else "t" if i == 2 else "s", month=lambda i: None,
                text_len=lambda i: 1 if i == 0 else 6 * (i + 1), id=lambda i: " " if i == 3 else str(i))
    got = profile.structural_profile(df, "s", 10).first()
    assert (got["empty_source"], got["wrong_source"], got["empty_month"], got["text_len_mismatch"], got["empty_id"]) == (
        1, 1, 10, 1, 1)
    assert got["row_count_matches"] and got["lt_100_chars"] == 10


def test_cube_slices_agree_with_plain_counts(spark):
    df = corpus(spark, 50, court=lambda i: None if i % 5 == 0 else "a", year=lambda i: None if i % 7 == 0 else 2000 + i % 3)
    cube = profile.audit_cube(df)
    assert rows(profile.cube_slice(cube, True, False), "year", "rows") == rows(
        df.groupBy("year").agg(F.count("*").alias("rows")), "year", "rows")
    assert rows(profile.cube_slice(cube, False, True), "court", "rows") == rows(
        df.groupBy("court").agg(F.count("*").alias("rows")), "court", "rows")
    assert profile.cube_slice(cube, False, False).first()["rows"] == 50


def test_duplicate_excess_with_nulls(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), (None,)], "v string")
    assert duplicates.dup_excess(df, "v").first()[0] == 3
    assert tuple(duplicates.dup_excess_non_null(df, "v").first()) == (2, 1, 1)
    assert rows(duplicates.column_excess(df, ("v",))) == [("v", 4, 1, 3)]
    assert rows(duplicates.column_excess(df, ("v",), skip_null=True)) == [("v", 2, 1, 1)]


def test_key_groups_hold_nulls(spark):
    df = spark.createDataFrame([("x", "y")] * 3 + [("x", None)] * 2, "a string, b string")
    assert duplicates.key_dup_excess(df, ("a", "b")).first()[0] == 3
    tuples = spark.createDataFrame([(1, 2), (1, None), (1, None), (None, None)], "a int, b int").withColumn("g", F.lit(1))
    assert duplicates.distinct_keys(tuples, "a", "b").first()[0] == 3
    assert rows(duplicates.distinct_tuples(tuples, ("a", "b"), "g")) == [(1, 4, 3)]


def test_gap_is_one_empty_year_between_full_ones(spark):
    cells = [("a", 2017, 3), ("a", 2019, 3), ("b", 2017, 3), ("b", 2018, 1), ("b", 2019, 3), ("c", 2017, 2), ("c", 2019, 3),
             ("d", 2017, 3), ("d", 2020, 3), ("e", 2015, 3), ("e", 2017, 3)]
    df = spark.createDataFrame([(c, y) for c, y, n in cells for _ in range(n)], "court string, year int")
    assert rows(coverage.internal_gaps(df, floor=3)) == [("a", 2018, 3, 3)]


def test_totals_keep_years_without_a_total(spark):
    ours = spark.createDataFrame([(2016, 654309)], "year int, corpus_rows bigint")
    theirs = spark.createDataFrame([(2016, 654396), (2017, None), (2018, 0)], "year int, total bigint")
    got = {r["year"]: r for r in coverage.coverage_vs_totals(ours, theirs).collect()}
    assert round(got[2016]["ratio"], 6) == 0.999867 and got[2017]["status"] == "error" and got[2018]["ratio"] is None
    done = coverage.complete_period_ratio(coverage.coverage_vs_totals(ours, theirs)).first()
    assert (done["years_retrieved"], done["difference"]) == (2, 87)


# --- samples -----------------------------------------------------------------------------------------------


def skewed(spark, parts=9):
    """A third of all rows share one id, and one group holds most rows."""
    items = [("hot" if i % 3 == 0 else f"id{i}", 1 if i % 10 else 0, i) for i in range(900)]
    return spark.createDataFrame(items, "id string, g int, n int").repartition(parts)


@pytest.mark.parametrize("limits", [{1: 40, 0: 10}, {1: 1}, {0: 5000, 1: 5000}, {1: 700}])
def test_ranked_sample_is_the_plain_ranking(spark, limits):
    df = skewed(spark)
    got = rows(sampling.ranked_sample(df, "g", limits), "g", "id", "_rn")
    all_rows = defaultdict(list)
    for r in df.withColumn("h", F.md5("id")).collect():
        all_rows[r["g"]].append((r["h"], r["id"]))
    want = [(g, i, k + 1) for g, n in limits.items() for k, (_, i) in enumerate(sorted(all_rows[g])[:n])]
    assert got == sorted(want, key=repr)


def test_top_k_over_many_parts(spark):
    df = skewed(spark, 30)
    got = [tuple(r) for r in sampling.top_k(df, 50, F.col("id").desc(), F.col("n"), fan_in=3).collect()]
    want = sorted((tuple(r) for r in df.collect()), key=lambda r: r[2])
    want.sort(key=lambda r: r[0], reverse=True)
    assert got == want[:50]


def test_global_rank_with_a_hot_key(spark):
    df = skewed(spark).select("id", "g")
    got = sorted((r["rn"], r["id"]) for r in sampling.global_rank(df, F.col("id")).collect())
    assert [k for k, _ in got] == list(range(1, 901))
    assert [i for _, i in got] == sorted(r["id"] for r in df.collect())


@pytest.mark.parametrize("total,n", [(60, 7), (60, 60), (60, 100), (5, 2)])
def test_systematic_sample(spark, total, n):
    df = corpus(spark, total, esas_no=lambda i: None if i % 5 == 0 else f"2000/{i}", year=lambda i: None if i % 9 == 0 else 2000)
    got = [r["id"] for r in sampling.systematic_sample(df, n).orderBy("rn").collect()]
    def key(r):
        return (r["year"] is None, r["year"] or 0, r["court"], r["esas_no"] or "", r["karar_no"], r["id"])
    ordered = sorted(df.collect(), key=key)
    step = max(total // n, 1)
    assert got == [r["id"] for k, r in enumerate(ordered) if k % step == 0][:n]


def python_pick(items, n):
    if len(items) <= n:
        return items
    if n == 1:
        return [items[len(items) // 2]]
    return [items[round(i * (len(items) - 1) / (n - 1))] for i in range(n)]


@pytest.mark.parametrize("allocation", [{"a": 7, "b": 3}, {"b": 1, "a": 100}, {"a": 2, "b": 2}, {"a": 6}])
def test_evenly_pick_rounds_half_to_even(spark, allocation):
    items = [("a", i) for i in range(46)] + [("b", i) for i in range(8)] + [("z", 1)]
    df = spark.createDataFrame(items, "stratum string, n int").repartition(5)
    got = sampling.evenly_pick(df, allocation, F.col("n")).orderBy("sample_index").collect()
    want = [(s, i) for s, n in allocation.items() for i in python_pick([k for t, k in items if t == s], n)]
    assert [(r["stratum"], r["n"]) for r in got] == want


def test_stratified_sample_sizes(spark):
    df = corpus(spark, 3000, year=lambda i: 1997 + i % 30, text=lambda i: "x").repartition(6)
    got = Counter((r["stratum"], r["year"]) for r in sampling.stratified_sample(df).collect())
    assert all(n == 70 for (s, y), n in got.items() if y >= 2016)
    assert all(n == 19 for (s, y), n in got.items() if 2006 <= y <= 2015)
    assert sum(n for (s, y), n in got.items() if s == "old_pre_2006") == 40


def test_reservoir_sample_follows_its_seed(spark):
    df = corpus(spark, 300)
    ids = [rows(sampling.reservoir_sample(df, 20, seed), "id") for seed in (1, 1, 2)]
    assert ids[0] == ids[1] != ids[2] and len(ids[2]) == 20


def test_suspicious_order(spark):
    texts = ["Deneme Karar Metni " * 40, "x DAVATURU " * 60, "İLGİLİCEZAMAHADI" * 40, "a" * 50, "b" * 200, "c" * 400, "d" * 400]
    df = corpus(spark, 7, text=lambda i: texts[i], court=lambda i: "-" if i == 6 else "x")
    got = [(r["id"], r["severity"]) for r in sampling.suspicious_top(df).collect()]
    assert got == [("c:0", 0), ("c:2", 1), ("c:1", 2), ("c:3", 3), ("c:4", 4), ("c:6", 4)]


def test_page(spark):
    df = spark.range(100).repartition(7)
    assert [r[0] for r in sampling.page(df, 4, 5, F.col("id")).collect()] == [15, 16, 17, 18, 19]
    assert [r[0] for r in sampling.page(df, 12, 9, F.col("id")).collect()] == [99]
    assert sampling.page(df, 30, 9, F.col("id")).count() == 0


def test_group_excess_reaches_the_gate(spark):
    groups = spark.createDataFrame([(1,), (1,), (1,), (2,), (None,), (None,)], "component_id long")
    assert rows(duplicates.group_excess(groups)) == [(6, 4, 2)]
    assert rows(duplicates.group_excess(groups.limit(0))) == [(0, 0, 0)]
    totals = spark.createDataFrame([(6, 0, 0, 0)], "rows long, empty_text long, any_known_placeholder long, lt_100_chars long")
    excess = spark.createDataFrame([(6, 0)], "rows long, excess long")
    gaps = spark.createDataFrame([], "x int")
    metrics = audits.acceptance_metrics(totals, excess, gaps, near=duplicates.group_excess(groups))
    gate = audits.acceptance(spark, metrics)["gates"].where("metric = 'near_duplicate_rate'").first()
    assert (gate.observed, gate.state) == (2 / 6, "FAIL")


# --- second source -----------------------------------------------------------------------------------------


def two_sources(spark, seed, n=250):
    rng = random.Random(seed)
    courts = ["1. Hukuk", "11. Hukuk", "2. Ceza", None, "1.  HUKUK "]

    def key():
        if rng.random() < 0.33:
            return "2000/1"  # one key holds a third of the rows
        return rng.choice(["2000/01", "2000 / 2", f"2001/{rng.randint(1, 9)}", "none", None])

    cand = [(rng.choice([str(rng.randint(1, 90)), "x1", None, "7"]), rng.choice(courts), key(), key(),
             f"20{rng.randint(14, 19)}-01-0{rng.randint(1, 3)}", rng.randint(2014, 2019)) for _ in range(n)]
    ext = [(rng.choice([rng.randint(1, 120), 7, None]), rng.choice(courts), key(), key(),
            f"0{rng.randint(1, 3)}.01.20{rng.randint(14, 19)}") for _ in range(n)]
    c = spark.createDataFrame(cand, "document_id string, court string, esas_no string, karar_no string, "
                                    "karar_tarihi string, year int")
    e = spark.createDataFrame(ext, "document_id bigint, daire string, esas_no string, karar_no string, karar_tarihi string")
    return cand, ext, c, e.withColumn("decision_year", F.substring("karar_tarihi", 7, 4).try_cast("int"))


def number(s):
    return int(s) if s is not None and s.isdigit() else None


@pytest.mark.parametrize("seed", [1, 2])
def test_cross_source_metrics_by_brute_force(spark, seed):
    cand, ext, c, e = two_sources(spark, seed)
    got = dict(rows(matching.cross_source_metrics(c, e)))

    def key(court, a, b):
        return (None if court is None else court.strip(" ").lower(), None if a is None else a.strip(" "),
                None if b is None else b.strip(" "))

    ck, ek = [key(*r[1:4]) for r in cand], [key(*r[1:4]) for r in ext]
    cid, eid = [number(r[0]) for r in cand], [r[0] for r in ext]
    full_c, full_e = {k for k in ck if None not in k}, {k for k in ek if None not in k}
    c_ids, e_ids = Counter(i for i in cid if i is not None), Counter(i for i in eid if i is not None)
    absent = [k for k, i in zip(ek, eid) if i not in c_ids]
    assert got["exact_document_id_overlap"] == sum(n * c_ids[i] for i, n in e_ids.items())
    assert got["external_document_ids_not_in_candidate"] == len(absent)
    assert got["candidate_document_ids_not_in_external"] == sum(1 for i in cid if i not in e_ids)
    assert got["external_missing_docid_but_metadata_key_present"] == sum(k in full_c for k in absent)
    assert got["external_metadata_keys_absent_from_candidate"] == sum(k not in full_c for k in absent)
    assert got["candidate_metadata_keys_absent_from_external"] == sum(k not in full_e for k in ck)
    assert got["candidate_distinct_metadata_key"] == len(set(ck))
    assert got["external_metadata_duplicate_excess"] == len(ek) - len(set(ek))
    assert got["candidate_distinct_document_id"] == len({r[0] for r in cand if r[0] is not None})
    assert got["candidate_non_numeric_document_id"] == sum(i is None for i in cid)
    assert got["external_document_ids_not_in_candidate"] == (
        got["external_missing_docid_but_metadata_key_present"] + got["external_metadata_keys_absent_from_candidate"])


@pytest.mark.parametrize("seed", [3, 4])
def test_reconcile_by_brute_force(spark, seed):
    _, _, c, e = two_sources(spark, seed)
    cr, er = matching.reconcile_candidate(c).collect(), matching.reconcile_external(e).collect()
    full = {(r["court_n"], r["esas_n"], r["karar_n"]) for r in cr}
    residual = [r for r in er if None in (k := (r["court_n"], r["esas_n"], r["karar_n"])) or k not in full]
    met = [(a, b, None if None in (a["canon"], b["canon"]) else jaro_winkler_of(a["canon"], b["canon"]))
           for a in residual for b in cr
           if all(a[k] is not None and a[k] == b[k] for k in matching.NUMERIC_KEY)]

    def ids(test):
        return len({a["document_id"] for a, b, s in met if a["document_id"] is not None and test(a, b, s)})

    close = {a["document_id"] for a, _, s in met if s is not None and s >= 0.9 and a["document_id"] is not None}
    parsed = sum(all(a[k] is not None for k in matching.NUMERIC_KEY) for a in residual)
    want = (len(residual), parsed, ids(lambda a, b, s: True), ids(lambda a, b, s: s is not None and a["canon"] == b["canon"]),
            ids(lambda a, b, s: s is not None and s >= 0.95), ids(lambda a, b, s: s is not None and s >= 0.9),
            ids(lambda a, b, s: a["day"] is not None and a["day"] == b["day"]),
            sum(a["document_id"] not in close for a in residual))
    out = audits.reconcile(c, e)
    assert tuple(out["summary"].first()) == want
    assert out["left_over"].count() == want[-1]
    alias = Counter((a["court"], b["court"]) for a, b, s in met if s is not None and s >= 0.9 and a["canon"] != b["canon"])
    assert {(r["ext_court"], r["cand_court"]): r["n"] for r in out["aliases"].collect()} == dict(alias)


def test_same_number_option_rejects_other_chambers(spark):
    c = spark.createDataFrame([("1", "12. Hukuk Dairesi", "2001/1", "2001/2", "2001-01-01", 2001)],
                              "document_id string, court string, esas_no string, karar_no string, karar_tarihi string, year int")
    e = spark.createDataFrame([(9, "14. Hukuk Dairesi", "2001/1", "2001/2", "01.01.2001")],
                              "document_id bigint, daire string, esas_no string, karar_no string, karar_tarihi string")
    assert audits.reconcile(c, e)["summary"].first()["external_residual_after_fuzzy"] == 0
    strict = audits.reconcile(c, e, require_same_number=True)["summary"].first()
    assert strict["external_residual_after_fuzzy"] == 1 and strict["ids_with_same_numeric_key_and_date"] == 1


# --- texts, entities, pages, files, gates --------------------------------------------------------------------


def test_verification_flags_and_quality(spark):
    sample = corpus(spark, 4, text=lambda i: f"Karar metni {i} " + "uzun " * 50, court=lambda i: "3. Hukuk")
    official = spark.createDataFrame(
        [("0", "text/plain", 10, f"3. HUKUK 2000/0 2001/0 Karar  metni 0 " + "uzun " * 50, "ok"),
         ("1", "text/plain", 10, "başka bir şey", "ok"), ("1", "text/plain", 11, "ikinci", "ok"),
         ("2", None, None, None, "no_content")],
        "document_id string, mime string, raw_bytes int, official_text string, status string")
    out = audits.verify_texts(sample, official)
    got = {r["document_id"]: r for r in out["results"].collect()}
    assert (got["0"]["court_present"], got["0"]["esas_present"], got["0"]["corpus_in_official"]) == (True, True, True)
    assert got["0"]["text_match_ge_0_95"] is False or got["0"]["sequence_ratio"] >= 0.95
    assert got["1"]["court_present"] is False and got["2"]["status"] == "no_content" and got["3"]["status"] == "missing"
    q = out["quality"].first()
    assert (q["requested"], q["official_retrieved"], q["metadata_all_three_present"]) == (4, 2, 1)


def test_percentiles_interpolate(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 5)], "sequence_ratio double").withColumns({
        "status": F.lit("ok"), "court_present": F.lit(True), "esas_present": F.lit(True), "karar_present": F.lit(True),
        "text_match_ge_0_98": F.lit(True), "text_match_ge_0_95": F.lit(True)})
    got = verification.match_quality(df).first()
    assert (round(got["sequence_ratio_p05"], 9), got["sequence_ratio_median"]) == (1.15, 2.5)


def test_failed_detector_makes_no_result(spark):
    df = corpus(spark, 30)

    def broken(chunk):
        raise RuntimeError

    def half(chunk):
        return [("NAME", 0.85), ("NAME", 0.95)]

    assert not audits.entity_audit(df, broken)["quality"].first()["valid"]
    out = audits.entity_audit(df, half)
    assert rows(out["entities"]) == [(0.8, "NAME", 60, 30), (0.9, "NAME", 30, 30)]
    assert rows(out["documents"]) == [(0.8, 30), (0.9, 30)]


def test_sanitize_check_gates_on_residual(spark):
    df = corpus(spark, 2, text=lambda i: ["0532 111 22 33 0533 111 22 33", "a@b.com TR330006100519786457841326"][i])
    got = screening.sanitize_check(df).first()
    assert (got["rows_changed"], got["residual_telefon"], got["residual_sum"], got["passed"]) == (2, 1, 1, False)
    assert screening.sanitize_check(df, guarded=True).first()["passed"]


def test_pages(spark, tmp_path):
    def item(i):
        return {"documentId": str(i), "itemType": {"name": "K"}, "kararTarihi": f"2026-01-0{i}T21:00:00.000+00:00"}

    import json
    pages = [(0, [1, 2]), (2, [3, 4]), (4, [4]), (6, None)]
    lines = [json.dumps({"data": {"start": s, "total": 9, "emsalKararList": None if i is None else [item(k) for k in i]},
                         "requested_page_size": 2}) for s, i in pages]
    (tmp_path / "p.json").write_text("\n".join(lines))
    df = landed.read_search_pages(spark, str(tmp_path))
    assert df.schema == SEARCH_PAGE
    out = audits.delta_page_audit(df)
    assert rows(out["overlap"]) == [(0, 0, True), (2, 1, False), (4, 0, True), (6, 0, True)]
    assert rows(out["repeated"]) == [("4", 2, 2)]
    assert tuple(out["summary"].first()) == (4, 5, 2, 9, 9)
    used = landing.records_in_window(landed.page_items(df), ["K"], "2026-01-01T21:00:00Z", "2026-01-03T21:00:00Z")
    assert sorted(r["documentId"] for r in used.collect()) == ["1", "2", "3"]
    assert set(landing.safe_projection(landed.page_items(df)).columns) == {
        "documentId", "itemType", "kararTarihi", "esasNo", "kararNo", "birimAdi"}
    kinds = landing.field_types(spark.createDataFrame([('{"data":{"emsalKararList":[{"a":1,"b":null,"c":1.5,"d":"x","e":[],'
                                                        '"f":{},"g":true}]}}',)], "value string"))
    assert dict((f, t) for f, t, _ in rows(kinds)) == {
        "a": "int", "b": "null", "c": "float", "d": "str", "e": "list", "f": "dict", "g": "bool"}


def test_payload_statuses(spark):
    import base64
    def b(s):
        return base64.b64encode(s).decode()
    df = spark.createDataFrame(
        [("1", ("text/html", b("<p>ş &amp;</p>".encode()))), ("2", ("text/plain", b(b"a\xffb"))), ("3", ("application/pdf", b(b"x"))),
         ("4", ("text/plain", "")), ("5", ("text/plain", "*bad*")), ("6", (None, b(b"x"))), ("7", None)],
        "document_id string, data struct<mimeType:string,content:string>")
    got = {r["document_id"]: (r["official_text"], r["status"]) for r in landed.decode_payloads(df).collect()}
    assert got == {"1": ("ş &", "ok"), "2": ("a�b", "ok"), "3": ("", "ok"), "4": (None, "no_content"),
                   "5": (None, "bad_content"), "6": ("", "ok"), "7": (None, "no_content")}


def test_files_against_manifest(spark, tmp_path):
    import hashlib
    import json
    spark.range(10).repartition(1).write.parquet(str(tmp_path / "d"))
    part = next((tmp_path / "d").glob("part-*.parquet"))
    sha = hashlib.sha256(part.read_bytes()).hexdigest()
    shards = [{"path": f"x/{part.name}", "size_bytes": part.stat().st_size, "lfs_sha256": sha},
              {"path": "x/other.parquet", "size_bytes": 1, "lfs_sha256": "0"}]
    (tmp_path / "m.json").write_text(json.dumps({"revision": "r", "expected_rows": 10, "expected_shard_count": 1,
                                                 "shards": shards}, indent=1))
    out = audits.verify_source(spark, str(tmp_path / "m.json"), str(tmp_path / "d" / "*.parquet"))
    assert rows(out["files"]) == sorted([(part.name, True, True, True, "matched"), ("other.parquet", False, False, False, "missing")], key=repr)
    assert not out["summary"].first()["verified"]
    whole = audits.file_integrity(spark, str(tmp_path / "m.json"), str(tmp_path / "d" / "*.parquet")).first()
    assert whole["rows_match"] and whole["files_match"] and whole["schemas_identical"] and whole["row_groups"] == 1
    assert rows(files.schema_strings(files.file_schemas(spark, str(tmp_path / "d" / "*.parquet"))), "schema") == [
        ("id int64 false",)]


def test_review_csv_keeps_texts(spark, tmp_path):
    df = spark.createDataFrame([("1", 'a "q"\nb, c\\ d '), ("2", " x"), ("3", None)], "id string, text string")
    outputs.write_csv(df, str(tmp_path / "o"), "id")
    assert rows(outputs.read_sample_csv(spark, str(tmp_path / "o"), df.schema)) == rows(df)


def test_profile_shard_adapts_to_columns(spark):
    assert set(audits.profile_shard(spark.range(3))) == {"nulls", "uniqueness", "sample"}
    texts = spark.createDataFrame([("a",), ("a",), (None,), ("",)], "text string")
    only = audits.profile_shard(texts)
    assert set(only) == {"nulls", "text", "markers", "short_texts"}
    assert rows(only["short_texts"], "chars", "text") == [(0, ""), (1, "a"), (1, "a")]
    no_ids = audits.profile_shard(texts.selectExpr("text", "text AS court"))
    assert rows(no_ids["sample"]) == sorted([("a",), ("a",), (None,), ("",)], key=repr)
    assert {"text", "short_texts", "by_year", "key_excess"} <= set(audits.profile_shard(corpus(spark, 3)))


def test_full_audit_and_decision(spark):
    df = corpus(spark, 40, text=lambda i: "karar esas sonuç " * 40, text_len=lambda i: 680)
    out = audits.full_audit(df, "s")
    assert out["totals"].first()["rows"] == 40 and out["verification_sample"].count() == 40
    assert sum(r["decisions"] for r in out["by_year_court"].collect()) == 40
    gaps = audits.gap_audit(df)["gaps"]
    metrics = audits.acceptance_metrics(out["totals"], out["duplicates"], gaps)
    decided = audits.acceptance(spark, metrics)
    assert decided["decision"].first()["final_state"] == "ACCEPT_WITH_CONDITIONS"  # three gates have no value yet
    extra = spark.createDataFrame([("metadata_accuracy", 1.0), ("official_match_rate", 1.0), ("near_duplicate_rate", 0.0)],
                                  "metric string, value double")
    assert audits.acceptance(spark, metrics.unionByName(extra))["decision"].first()["final_state"] == "ACCEPT"
    bad = extra.withColumn("value", F.lit(0.5))
    assert audits.acceptance(spark, metrics.unionByName(bad))["decision"].first()["final_state"] == "REJECT"
    soft = ("metadata_accuracy", "official_match_rate", "near_duplicate_rate")
    assert audits.acceptance(spark, metrics.unionByName(bad), soft)["decision"].first()["final_state"] == "ACCEPT_WITH_CONDITIONS"
    assert gates.final_state(spark.createDataFrame([], "state string")).first()["final_state"] == "ACCEPT_WITH_CONDITIONS"


@pytest.mark.parametrize("missing", [0, 5, 500, 2000])
def test_samples_keep_their_size_with_null_ids(spark, missing):
    df = spark.range(2000).select(F.when(F.col("id") >= missing, F.col("id").cast("string")).alias("id"), F.lit(2020).alias("year"))
    for got, want in ((sampling.top_n_per_year(df, 200, (2020, 2021)), 200), (sampling.top_n_global(df, 2), 2), (sampling.reservoir_sample(df, 5), 5)):
        found = got.collect()
        assert len(found) == want
        assert sum(x.id is None for x in found) == max(0, want - (2000 - missing))


def test_null_texts_come_last_in_suspicious_lists(spark):
    rows = [("1", None, "-"), ("2", "x" * 150, "-"), (None, "x" * 150, "-")]
    df = spark.createDataFrame(rows, "id string, text string, court string").select(
        "*", *(F.lit(None).cast("string").alias(c) for c in ("document_id", "esas_no", "karar_no", "karar_tarihi")), F.lit(2020).alias("year"))
    assert [x.id for x in sampling.suspicious_top(df, 2).collect()] == ["2", None]
    assert [x.id for x in sampling.first_k(sampling.suspicious_rows(df), 3).collect()] == ["2", None, "1"]


def test_equal_names_in_two_folders_are_two_files(spark, tmp_path):
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "w"))
    data = next((tmp_path / "w").glob("*.parquet")).read_bytes()
    for k in ("1", "2"):
        (tmp_path / "t" / f"k={k}").mkdir(parents=True)
        (tmp_path / "t" / f"k={k}" / "part-0.parquet").write_bytes(data)
    glob = str(tmp_path / "t" / "*" / "*.parquet")
    schemas = files.file_schemas(spark, glob)
    assert files.schemas_identical(schemas).first()[:] == (2, 1, True)
    assert {x.schema for x in files.schema_strings(schemas).collect()} == {"id int64 false"}
    hashes = files.file_hash(spark, glob)
    assert sorted(x.file for x in hashes.collect()) == ["k=1/part-0.parquet", "k=2/part-0.parquet"]
    assert sorted(x.file for x in files.file_inventory(spark, str(tmp_path / "t")).collect()) == ["k=1/part-0.parquet", "k=2/part-0.parquet"]
    first = hashes.first()
    shards = spark.createDataFrame(
        [("r", [(f"train/k={k}/part-0.parquet", first.size_bytes, first.sha256 if k == 1 else "0") for k in (1, 2, 3)])],
        "revision string, shards array<struct<path:string,size_bytes:bigint,lfs_sha256:string>>")
    found = files.match_manifest(hashes, files.manifest_shards(shards)).orderBy("file").collect()
    assert [tuple(x) for x in found] == [
        ("k=1/part-0.parquet", True, True, True, "matched"), ("k=2/part-0.parquet", True, True, False, "matched"),
        ("k=3/part-0.parquet", False, False, False, "missing")]


def test_end_of_page_is_kept():
    from assayline.functions.html import page_text

    assert page_text("<p>a</p> tail AT&T").split() == ["a", "tail", "AT&T"]
    assert page_text("<p>a</p><script>var x = 1;").split() == ["a", "var", "x", "=", "1;"]
    assert page_text("&amp;amp;") == "&"
