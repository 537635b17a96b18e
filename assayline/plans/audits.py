"""The audits a user runs. Each takes DataFrames and gives named DataFrames; nothing prints, nothing stops the session.

A result that leads to a decision has its own row: pass or fail is data (see `acceptance`).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.functions.predicates import project_present
from assayline.functions.text import rate, text_windows
from assayline.operators import coverage, duplicates, gates, landing, matching, profile, sampling, screening
from assayline.operators import state, verification
from assayline.plans.tables import Tables
from assayline.sources import files
from assayline.sources.identity import AMBIGUOUS
from assayline.sources.outputs import to_long
from assayline.vocabulary import CONTEXT_SAMPLE, ENTITY_SAMPLE, METADATA_KEY

SAMPLE_COLUMNS = ("id", "document_id", "source", "court", "esas_no", "karar_no", "karar_tarihi", "year", "text_len")


def verify_source(spark: SparkSession, manifest_path: str, *globs: str) -> Tables:
    """Sizes and hashes of all shards against the manifest."""
    out = Tables()
    shards = files.manifest_shards(files.read_manifest(spark, manifest_path))
    matched = out.shared(lambda: files.match_manifest(files.file_hash(spark, *globs), shards), "matched")
    out.add("files", matched)
    out.add("summary", lambda: matched().agg(
        F.count("*").alias("expected_files"), F.count_if("file_exists").alias("found_files"),
        F.count_if(F.col("size_matches") & F.col("sha256_matches")).alias("verified_files"),
        F.count_if(F.col("state") == AMBIGUOUS).alias("ambiguous_files"),
    ).withColumn("verified", F.col("expected_files") == F.col("verified_files")))
    return out


def file_integrity(spark: SparkSession, manifest_path: str, *globs: str) -> DataFrame:
    """One row: files and rows found against the manifest, and whether all schemas are one."""
    found = files.file_totals(files.file_inventory(spark, *globs))
    schemas = files.schemas_identical(files.file_schemas(spark, *globs)).select("schemas_identical")
    wanted = files.read_manifest(spark, manifest_path).select("expected_rows", "expected_shard_count")
    joined = found.crossJoin(wanted).crossJoin(schemas)  # three tables of one row each
    return joined.withColumns({
        "rows_match": F.col("rows") == F.col("expected_rows"),
        "files_match": F.col("files") == F.col("expected_shard_count"),
    })


def profile_shard(df: DataFrame) -> Tables:
    """All checks that the columns of one file allow."""
    has = set(df.columns)
    out = Tables(nulls=lambda: profile.null_profile(df))
    if "text" in has:
        out.add("text", lambda: profile.text_profile(df))
        out.add("markers", lambda: profile.marker_profile(df))
    unique = [c for c in ("id", "document_id", "raw_sha256") if c in has]
    if unique:
        out.add("uniqueness", lambda: duplicates.column_excess(df, tuple(unique), skip_null=True))
    if set(METADATA_KEY) <= has:
        out.add("key_excess", lambda: duplicates.key_dup_excess(df))
    if "year" in has:
        out.add("by_year", lambda: df.groupBy("year").agg(F.count("*").alias("decisions")))
        out.add("year_range", lambda: df.agg(F.min("year").alias("min_year"), F.max("year").alias("max_year")))
    if "court" in has:
        out.add("by_court", lambda: df.groupBy("court").agg(F.count("*").alias("decisions")))
    if "text" in has:
        out.add("short_texts", lambda: sampling.shortest_texts(df))
    listed = project_present(df, SAMPLE_COLUMNS)
    if "id" in has:
        out.add("sample", lambda: sampling.reservoir_sample(listed))
    elif listed.columns:  # without ids, rows are drawn by what they hold
        whole = listed.withColumn("_row", F.to_json(F.struct(*listed.columns)))
        out.add("sample", lambda: sampling.reservoir_sample(whole, id_column="_row").drop("_row"))
    return out


def _cube_tables(out: Tables, cube: Callable[[], DataFrame]) -> None:
    out.add("cube", cube)
    out.add("totals", lambda: profile.cube_slice(cube(), False, False).drop("year", "court"))
    out.add("by_year", lambda: profile.cube_slice(cube(), True, False).select(
        "year", F.col("rows").alias("decisions"), F.col("lt_300_chars").alias("lt_300"),
        F.col("any_known_placeholder").alias("known_placeholder")))
    out.add("by_court", lambda: profile.cube_slice(cube(), False, True).select(
        "court", F.col("rows").alias("decisions"), F.col("lt_300_chars").alias("lt_300")))
    out.add("by_year_court", lambda: profile.cube_slice(cube(), True, True).select(
        "year", "court", F.col("rows").alias("decisions"), "median_chars", F.col("lt_300_chars").alias("lt_300")))


def full_audit(df: DataFrame, source_name: str | None = None) -> Tables:
    """Structure, quality and coverage from one text scan, duplicates from narrow scans, two samples.

    The cube is small (one row per year and court); it is written once for the tables cut from it.
    """
    out = Tables()
    cube = out.shared(lambda: profile.audit_cube(df, source_name), "cube")
    _cube_tables(out, cube)
    out.add("duplicates", lambda: duplicates.column_excess(df, ("id", "document_id", "raw_sha256")))
    out.add("key_excess", lambda: duplicates.key_dup_excess(df))
    out.add("suspicious", lambda: sampling.suspicious_top(df))
    out.add("verification_sample", lambda: sampling.stratified_sample(df))
    return out


def audit_from_state(kept: state.State) -> Tables:
    """The tables of `full_audit` from the state of its batches alone (`state.load_state`), no row of the corpus being read.

    Quantiles and distinct values are exact up to the sizes that `state` names, and within its errors beyond.
    """
    out = Tables()
    _cube_tables(out, out.shared(lambda: state.state_cube(kept), "cube"))
    excess = out.shared(lambda: state.state_excess(kept), "excess")
    out.add("duplicates", lambda: excess().where(F.col("column") != state.KEY))
    out.add("key_excess", lambda: excess().where(F.col("column") == state.KEY).select("excess", "distinct_error"))
    out.add("suspicious", lambda: kept["suspicious"])
    out.add("verification_sample", lambda: sampling.with_strata(kept["sample"]))
    return out


def coverage_audit(df: DataFrame) -> Tables:
    return Tables(
        by_year=lambda: df.groupBy("year").agg(F.count("*").alias("decisions")),
        by_year_court=lambda: coverage.coverage_stored_length(df))


def gap_audit(df: DataFrame) -> Tables:
    return Tables(gaps=lambda: coverage.internal_gaps(df), active_labels=lambda: coverage.active_labels_by_year(df))


def pii_audit(df: DataFrame, mode: str = "re2") -> Tables:
    """Per year and in total; the text is scanned once for both."""
    out = Tables()
    by_year = out.shared(lambda: screening.pii_by_year(df, mode), "pii")
    out.add("by_year", by_year)
    out.add("totals", lambda: screening.pii_totals(by_year()))
    return out


def contextual_audit(df: DataFrame, limits: dict[int, int] | None = CONTEXT_SAMPLE, mode: str = "re2") -> Tables:
    """Context signals in a sample; `limits=None` reads all rows."""
    out = Tables()
    counts = out.shared(lambda: screening.signal_counts(screening.contextual_sample(df, limits), mode), "signals")
    out.add("sample", lambda: counts().select("rows_sampled", "modern_rows"))
    out.add("signals", lambda: screening.signal_rates(counts()))
    return out


def entity_audit(df: DataFrame, detector: screening.Detector | None = None,
                 limits: dict[int, int] | None = ENTITY_SAMPLE, windows: Callable[[Column], Column] = text_windows,
                 setup: Callable[[], screening.BatchDetector] | None = None) -> Tables:
    """Entities in windows over the whole texts of a sample; `limits=None` reads all rows.

    A detector is a function of one text, or `setup` makes one of a batch of texts, once per worker; then `errors` has the
    most frequent failures. Without either the direct-identifier patterns stand in for one.
    """
    def detected() -> DataFrame:
        chunks = screening.windowed_chunks(screening.entity_sample(df, limits), windows)
        if setup:
            return screening.detect_batches(chunks, setup)
        return screening.detect_entities(chunks, detector) if detector else screening.detect_direct(chunks)

    out = Tables()
    found = out.shared(detected, "detections")
    out.add("detections", found)
    out.add("entities", lambda: screening.entity_counts(found()))
    out.add("documents", lambda: screening.documents_with_entities(found()))
    out.add("quality", lambda: screening.entity_run_quality(found()))
    if setup:
        out.add("errors", lambda: screening.entity_errors(found()))
    return out


def cross_source_audit(cand: DataFrame, ext: DataFrame) -> Tables:
    return Tables(
        metrics=lambda: matching.cross_source_metrics(cand, ext),
        by_year=lambda: matching.cross_source_by_year(cand, ext))


def reconcile(cand: DataFrame, ext: DataFrame, require_same_number: bool = False) -> Tables:
    """Exact residual, numeric key, similar court name. `require_same_number` rejects names of unlike chamber numbers.

    The residual, the name pairs and the summary per id feed several results, so each is written once.
    """
    c, e = matching.reconcile_candidate(cand), matching.reconcile_external(ext)
    out = Tables()
    residual = out.shared(lambda: matching.exact_residual(e, c), "residual")
    pairs = out.shared(lambda: matching.label_matches(residual(), c, require_same_number), "pairs")
    by_id = out.shared(lambda: matching.residual_by_id(residual(), c, pairs()), "by_id")
    out.add("summary", lambda: matching.distinct_matches(by_id()))
    out.add("aliases", lambda: matching.alias_top(matching.alias_pairs(pairs())))
    out.add("alias_pairs", lambda: matching.alias_pairs(pairs()))
    out.add("left_over", lambda: matching.residual_after_fuzzy(residual(), by_id()))
    return out


def verify_texts(sample: DataFrame, official: DataFrame) -> Tables:
    """Sampled rows against official texts, row by row and in sum."""
    def compared() -> DataFrame:
        pairs = verification.attach_official_text(sample, official)
        spread = pairs.repartition(sample.sparkSession.sparkContext.defaultParallelism)  # few rows, much work on each
        return verification.compare_texts(spread)

    out = Tables()
    results = out.shared(compared, "compared")
    out.add("results", results)
    out.add("quality", lambda: verification.match_quality(results()))
    return out


def probe_suspicious(suspicious: DataFrame, official: DataFrame, k: int = 12) -> Tables:
    """Head of the suspicious list: does the official copy carry the same placeholder?"""
    def compared() -> DataFrame:
        pairs = verification.attach_official_text(sampling.first_k(suspicious, k), official)
        return verification.compare_placeholders(verification.compare_texts(pairs.withColumns({
            "_text": F.col("text"), "_official": F.col("official_text")})).withColumnsRenamed(
            {"_text": "text", "_official": "official_text"})).drop("text", "official_text")

    out = Tables()
    results = out.shared(compared, "compared")
    out.add("results", results)
    out.add("quality", lambda: verification.placeholder_quality(results()))
    return out


def coverage_vs_reference_totals(counts: DataFrame, totals: DataFrame) -> Tables:
    compared = coverage.coverage_vs_totals(counts, totals)
    return Tables(by_year=lambda: compared, complete_years=lambda: coverage.complete_period_ratio(compared))


def delta_page_audit(pages: DataFrame) -> Tables:
    return Tables(
        pages=lambda: landing.page_facts(pages), overlap=lambda: landing.page_overlap(pages),
        repeated=lambda: landing.repeated_documents(pages), summary=lambda: landing.page_summary(pages))


def acceptance_metrics(totals: DataFrame, excess: DataFrame, gaps: DataFrame,
                       quality: DataFrame | None = None, near: DataFrame | None = None) -> DataFrame:
    """(metric, value) for the gates, out of finished audits; each input is a short table.

    `near` is `near.near_duplicate_excess` of the corpus, or `duplicates.group_excess` of groups found otherwise; without it
    its gate is pending.
    """
    worst = excess.agg(F.max(rate(F.col("excess"), F.col("rows"))).alias("exact_duplicate_rate"))
    parts = [
        gates.corpus_rates(totals), to_long(worst),
        to_long(gaps.agg(F.count("*").alias("critical_coverage_gaps"))),
    ]
    if quality is not None:
        parts.append(to_long(quality.select(
            F.col("metadata_match_rate").alias("metadata_accuracy"),
            rate(F.col("sequence_ratio_ge_0_95"), F.col("official_retrieved")).alias("official_match_rate"))))
    if near is not None:
        parts.append(to_long(near.select(rate(F.col("excess"), F.col("rows")).alias("near_duplicate_rate"))))
    return reduce(DataFrame.unionByName, parts)


def acceptance(spark: SparkSession, metrics: DataFrame, soft: tuple[str, ...] = ()) -> Tables:
    out = Tables()
    judged = out.shared(lambda: gates.evaluate_gates(metrics, gates.targets_table(spark, soft=soft)), "gates")
    out.add("gates", judged)
    out.add("decision", lambda: gates.final_state(judged()))
    return out


AUDITS: dict[str, Callable[..., object]] = {
    f.__name__: f for f in (
        verify_source, file_integrity, profile_shard, full_audit, audit_from_state, coverage_audit, gap_audit, pii_audit,
        contextual_audit, entity_audit, cross_source_audit, reconcile, verify_texts, probe_suspicious,
        coverage_vs_reference_totals, delta_page_audit, acceptance,
    )
}
