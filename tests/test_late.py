"""Late texts: no ranking, sort across the table, or write holds them; the fetched ones are right."""

import re

import pytest
from pyspark.sql import functions as F

from assayline.operators import late, sampling, screening, verification
from assayline.plans import audits
from assayline.plans.tables import Tables
from assayline.spec import CORPUS


@pytest.fixture(scope="module")
def scan(spark, tmp_path_factory):
    """A corpus of several files, with repeated and NULL ids."""
    path = str(tmp_path_factory.mktemp("corpus") / "c")
    rows = spark.range(0, 400, 1, 4).select(
        F.when(F.col("id") % 50 == 7, None).otherwise(F.concat(F.lit("d"), F.col("id") % 390)).alias("id"),
        F.col("id").cast("string").alias("document_id"), F.when(F.col("id") % 9 == 0, "-").otherwise("1. Ceza").alias("court"),
        F.concat(F.lit("2001/"), "id").alias("esas_no"), (F.lit(1997) + F.col("id") % 30).cast("smallint").alias("year"),
        F.concat(F.lit("metin "), F.col("id"), F.repeat(F.lit(" uzun"), (F.col("id") % 90).cast("int"))).alias("text"))
    missing = [f for f in CORPUS.fields if f.name not in rows.columns]
    rows.select(*[F.lit(None).cast(f.dataType).alias(f.name) if f in missing else F.col(f.name) for f in CORPUS.fields]).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture
def written(monkeypatch):
    """The tables that are written by the way."""
    seen = []
    keep = late.settle

    def settle(df, name="table"):
        seen.append(df)
        return keep(df, name)

    for module in (late, sampling):
        monkeypatch.setattr(module, "settle", settle)
    return seen


def holds_text(df):
    """Nodes that order, exchange or write rows with a text column."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    lines = [x for x in plan.split("\n") if re.search(r"(Window|Sort|RepartitionBy|Aggregate)", x)]
    return [x for x in lines if re.search(r"\b(text|official_text)#", x)]


PICKS = {
    "suspicious_top": lambda df: sampling.suspicious_top(df, 20),
    "first_k": lambda df: sampling.first_k(sampling.suspicious_top(df, 50), 5),
    "stratified_sample": sampling.stratified_sample,
    "evenly_pick": lambda df: sampling.evenly_pick(sampling.stratified_sample(df)),
    "top_n_global": lambda df: sampling.top_n_global(df, 9),
    "top_n_per_year": lambda df: sampling.top_n_per_year(df, 3, (2000, 2005)),
    "reservoir_sample": lambda df: sampling.reservoir_sample(df, 11),
    "contextual_sample": lambda df: screening.contextual_sample(df, {0: 10, 1: 20}),
}


@pytest.mark.parametrize("name", PICKS)
def test_texts_are_fetched_for_picked_rows_only(spark, scan, written, name):
    picked = PICKS[name](scan)
    assert written and all("text" not in df.columns for df in written)
    assert not [x for df in written for x in holds_text(df)]
    rows = picked.collect()
    assert rows
    if name == "contextual_sample":
        known = {(r.id, r.year): r.text for r in scan.where("id IS NOT NULL").collect()}
        assert all(r.id is None or known[r.id, r.year] == r.text for r in rows)
    else:
        known = {r.document_id: r.text for r in scan.collect()}
        assert all(known[r.document_id] == r.text for r in rows)


@pytest.mark.parametrize("name", PICKS)
def test_same_rows_as_from_a_table_that_is_no_scan(spark, scan, name):
    plain = spark.createDataFrame(scan.collect(), scan.schema)
    assert late.is_scan(scan.select("id", "text").where("id IS NOT NULL")) and not late.is_scan(plain)
    got, want = (sorted(map(repr, PICKS[name](df).collect())) for df in (scan, plain))
    if name in ("suspicious_top", "first_k", "top_n_global", "reservoir_sample"):  # equal ids at a cut may change places
        assert [re.sub("document_id='[0-9]*'", "", x) for x in got][:3] == [re.sub("document_id='[0-9]*'", "", x) for x in want][:3]
    assert len(got) == len(want)


def test_second_scan_opens_few_files(spark, scan):
    one = scan.where("document_id = '3'")
    picked = late.narrow_first(one, lambda rows: rows.limit(1), "text")
    assert picked.first().text.startswith("metin 3")
    files = {r[0] for r in late.addressed(scan).select("_file").distinct().collect()}
    assert len(files) > 1
    leaf = picked._jdf.queryExecution().optimizedPlan().toString()
    assert "file_path" in leaf and "INSET" in leaf.upper() or " = file:" in leaf


def test_official_texts_are_ranked_without_them(spark, scan, written, tmp_path):
    rows = [(str(i), s, f"resmi {i} {s}", n) for i in range(30) for s, n in (("ok", 5), ("ok", 3), ("no_content", 0))]
    path = str(tmp_path / "official")
    spark.createDataFrame(rows, "document_id string, status string, official_text string, raw_bytes long").write.parquet(path)
    joined = verification.attach_official_text(scan.where("document_id < '2'"), spark.read.parquet(path))
    assert all("official_text" not in df.columns and not holds_text(df) for df in written)
    got = {r.document_id: (r.official_text, r.raw_bytes) for r in joined.where("status = 'ok'").collect()}
    assert got and all(v == (f"resmi {k} ok", 3) for k, v in got.items())


def test_tables_are_made_when_asked_for(spark, scan):
    made = []

    def maker(name):
        made.append(name)
        return spark.range(3)

    out = Tables(a=lambda: maker("a"))
    base = out.shared(lambda: maker("base"))
    out.add("b", lambda: base().where("id > 0"))
    out.add("c", lambda: base().where("id > 1"))
    assert set(out) == {"a", "b", "c"} and made == []
    with out:
        assert (out["c"].count(), out["b"].count(), out["c"].count()) == (1, 2, 1)
        assert made == ["base"]
        path = base()._settled_at
        assert spark.read.parquet(path).count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_full_audit_works_out_what_is_read(spark, scan, monkeypatch):
    monkeypatch.setattr(sampling, "suspicious_top", lambda df: pytest.fail("not asked for"))
    with audits.full_audit(scan) as out:
        assert out["by_year"].count() == 30
        assert out["totals"].first()["rows"] == 400
