"""Reconciliation with a second source: by id, by normalized key, by numeric key and similar court name.

Sides are reduced to counts per key before they meet, so equal keys on both sides never multiply into row pairs.
Row-level joins have a side with one row per key; adaptive execution splits a hot key of the other side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayline.functions.dates import dotted_date, iso_date
from assayline.functions.predicates import all_not_null, not_castable
from assayline.functions.similarity import jaro_winkler, jaro_winkler_bound
from assayline.functions.text import canonical_name, exact_name, key_number, key_year
from assayline.operators.coverage import compare_year_counts
from assayline.operators.duplicates import distinct_tuples
from assayline.operators.sampling import top_k
from assayline.sources.outputs import to_long
from assayline.vocabulary import MODERN_YEARS, SIMILARITY_LIMITS

KEY = ("court_n", "esas_n", "karar_n")
NUMERIC_KEY = ("ey", "en", "ky", "kn")


def candidate_keys(cand: DataFrame) -> DataFrame:
    return cand.select(
        "document_id", F.col("document_id").try_cast("bigint").alias("id_num"),
        exact_name(F.col("court")).alias("court_n"), F.trim("esas_no").alias("esas_n"),
        F.trim("karar_no").alias("karar_n"), "year",
    )


def external_keys(ext: DataFrame) -> DataFrame:
    return ext.select(
        "document_id", F.col("document_id").cast("bigint").alias("id_num"),
        exact_name(F.col("daire")).alias("court_n"), F.trim("esas_no").alias("esas_n"),
        F.trim("karar_no").alias("karar_n"), "decision_year",
    )


def _per(df: DataFrame, *keys: str, name: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def distinct_rows(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys).distinct()


def overlap_by_id(ext: DataFrame, cand: DataFrame) -> DataFrame:
    """Number of (external, candidate) row pairs with one id, from counts per id."""
    both = _per(ext, "id_num", name="n_e").join(_per(cand, "id_num", name="n_c"), "id_num")
    return both.agg(F.coalesce(F.sum(F.col("n_e") * F.col("n_c")), F.lit(0)).alias("exact_document_id_overlap"))


def ids_not_in(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of `left` whose id `right` does not have. A NULL id is nowhere."""
    return absent(left, right, ("id_num",))


def _dealt(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The rows with `_spread`: 0 where all keys are known, else a number of the row's own. Joined on as well, it deals rows
    that cannot match over all tasks, which NULL keys alone would send to one; the rows are scanned once."""
    return rows.withColumn("_spread", F.when(all_not_null(*keys), F.lit(0).cast("bigint")).otherwise(F.monotonically_increasing_id() + 1))


def absent(rows: DataFrame, others: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows whose keys `others` does not have. A NULL key matches nothing."""
    known = distinct_rows(others.where(all_not_null(*keys)), *keys).withColumn("_spread", F.lit(0).cast("bigint"))
    return _dealt(rows, keys).join(known, [*keys, "_spread"], "left_anti").select(*rows.columns)


def key_present(rows: DataFrame, keyed: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    """Rows whose key the other side has; a key with a NULL part never matches."""
    return rows.join(distinct_rows(keyed, *keys), list(keys), "left_semi")


def key_absent(rows: DataFrame, keyed: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    return absent(rows, keyed, keys)


def id_metrics(ext: DataFrame, cand: DataFrame) -> DataFrame:
    """Overlap and both absences from one full join of the counts per id."""
    n_e, n_c = F.col("n_e"), F.col("n_c")
    both = _per(ext, "id_num", name="n_e").join(_per(cand, "id_num", name="n_c"), "id_num", "full")
    zero = F.lit(0)
    return both.agg(
        F.coalesce(F.sum(n_e), zero).alias("external_rows"),
        F.coalesce(F.sum(n_c), zero).alias("candidate_rows"),
        F.count_if(n_e.isNotNull() & F.col("id_num").isNotNull()).alias("external_distinct_document_id"),
        F.coalesce(F.sum(n_e * n_c), zero).alias("exact_document_id_overlap"),
        F.coalesce(F.sum(F.when(n_c.isNull(), n_e)), zero).alias("external_document_ids_not_in_candidate"),
        F.coalesce(F.sum(F.when(n_e.isNull(), n_c)), zero).alias("candidate_document_ids_not_in_external"),
    )


def key_metrics(ext: DataFrame, cand: DataFrame) -> DataFrame:
    """Distinct keys of both sides and the split of rows without their id, from one full join of counts per key."""
    known = distinct_rows(cand.where(F.col("id_num").isNotNull()), "id_num").withColumns(
        {"_known": F.lit(True), "_spread": F.lit(0).cast("bigint")})
    flagged = _dealt(ext, ("id_num",)).join(known, ["id_num", "_spread"], "left")
    e = flagged.groupBy(*KEY).agg(F.count("*").alias("n_e"), F.count_if(F.col("_known").isNull()).alias("n_absent"))
    both = e.join(_per(cand, *KEY, name="n_c"), list(KEY), "full")
    n_e, n_c, zero = F.col("n_e"), F.col("n_c"), F.lit(0)
    return both.agg(
        F.count(n_c).alias("candidate_distinct_metadata_key"),
        F.count(n_e).alias("external_distinct_metadata_key"),
        (F.coalesce(F.sum(n_e), zero) - F.count(n_e)).alias("external_metadata_duplicate_excess"),
        F.coalesce(F.sum(F.when(n_c.isNotNull(), F.col("n_absent"))), zero)
        .alias("external_missing_docid_but_metadata_key_present"),
        F.coalesce(F.sum(F.when(n_c.isNull(), F.col("n_absent"))), zero)
        .alias("external_metadata_keys_absent_from_candidate"),
        F.coalesce(F.sum(F.when(n_e.isNull(), n_c)), zero).alias("candidate_metadata_keys_absent_from_external"),
    )


def cross_source_metrics(cand: DataFrame, ext: DataFrame) -> DataFrame:
    """(metric, value) over raw candidate and external tables."""
    c, e = candidate_keys(cand), external_keys(ext)
    ids = c.agg(
        F.count_distinct("document_id").alias("candidate_distinct_document_id"),
        F.count_if(not_castable("document_id")).alias("candidate_non_numeric_document_id"),
    )
    parts = [to_long(p, kind="bigint") for p in (id_metrics(e, c), ids, key_metrics(e, c))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def cross_source_by_year(cand: DataFrame, ext: DataFrame, years: tuple[int, int] = MODERN_YEARS) -> DataFrame:
    """Rows of both sides and distinct external keys per year of the window."""
    c = cand.where(F.col("year").between(*years)).groupBy(F.col("year").cast("int").alias("year")).agg(
        F.count("*").alias("candidate_rows"))
    keyed = external_keys(ext).where(F.col("decision_year").between(*years)).withColumnRenamed(
        "decision_year", "year")
    e = distinct_tuples(keyed, KEY, "year", name="external_unique_keys").withColumnRenamed("rows", "external_rows")
    compared = compare_year_counts(c, e.drop("external_rows"), "candidate_rows", "external_unique_keys")
    return compared.withColumnRenamed("difference", "candidate_minus_external_unique_keys").join(
        e.select("year", "external_rows"), "year", "left").fillna(0, ["external_rows"])


# --- fuzzy reconciliation ---------------------------------------------------------------------------------


def _numeric(df: DataFrame, court: str, date: Column) -> DataFrame:
    esas, karar = F.col("esas_no"), F.col("karar_no")
    return df.select(
        "document_id", F.col(court).alias("court"), exact_name(F.col(court)).alias("court_n"),
        canonical_name(F.col(court)).alias("canon"), F.trim(esas).alias("esas_n"), F.trim(karar).alias("karar_n"),
        key_year(esas).alias("ey"), key_number(esas).alias("en"),
        key_year(karar).alias("ky"), key_number(karar).alias("kn"), date.alias("day"),
    )


def reconcile_candidate(cand: DataFrame) -> DataFrame:
    return _numeric(cand, "court", iso_date(F.col("karar_tarihi")))


def reconcile_external(ext: DataFrame) -> DataFrame:
    return _numeric(ext, "daire", dotted_date(F.col("karar_tarihi")))


def exact_residual(ext: DataFrame, cand: DataFrame) -> DataFrame:
    """External rows whose normalized key the candidate lacks (rows found by id are not taken out first)."""
    return key_absent(ext, cand)


def label_matches(residual: DataFrame, cand: DataFrame, require_same_number: bool = False) -> DataFrame:
    """Per numeric key: pairs of court names with the number of row pairs behind them, and their similarity (NULL for NULL names
    and for names that cannot reach the lowest limit).

    Both sides are counted per (numeric key, name) first: rows that share both are one row here.
    """
    parsed = all_not_null(*NUMERIC_KEY)
    e = residual.where(parsed).groupBy(
        *NUMERIC_KEY, F.col("court").alias("ext_court"), F.col("canon").alias("ext_canon")
    ).agg(F.count("*").alias("n_e"))
    c = cand.where(parsed).groupBy(
        *NUMERIC_KEY, F.col("court").alias("cand_court"), F.col("canon").alias("cand_canon")
    ).agg(F.count("*").alias("n_c"))
    pairs = e.join(c, list(NUMERIC_KEY)).withColumn("n_pairs", F.col("n_e") * F.col("n_c"))
    if require_same_number:
        number = [F.regexp_extract(side, "[0-9]+", 0) for side in ("ext_canon", "cand_canon")]
        pairs = pairs.where(number[0] == number[1])
    return pairs.join(scored_names(pairs), ["ext_canon", "cand_canon"], "left")


def scored_names(pairs: DataFrame, least: float = SIMILARITY_LIMITS[-1]) -> DataFrame:
    """(ext_canon, cand_canon, similarity): every distinct pair of names that meets under some key, scored once.

    Equal or empty names need no scoring. Names that cannot reach `least`, which no result asks about, are not scored either and
    have a NULL similarity; NULL names are left out.
    """
    names = distinct_rows(pairs.where(all_not_null("ext_canon", "cand_canon")), "ext_canon", "cand_canon")
    empty = (F.length("ext_canon") == 0) | (F.length("cand_canon") == 0)
    bound = jaro_winkler_bound(F.col("ext_canon"), F.col("cand_canon"))
    state = F.when(empty, "empty").when(F.col("ext_canon") == F.col("cand_canon"), "equal").when(bound < least - 1e-9, "far").otherwise("open")
    judged = names.withColumn("_state", state)
    known = judged.where("_state <> 'open'").select(
        "ext_canon", "cand_canon", F.when(F.col("_state") == "equal", 1.0).when(F.col("_state") == "empty", 0.0).alias("similarity"))
    scored = judged.where("_state = 'open'").select(
        "ext_canon", "cand_canon", jaro_winkler("ext_canon", "cand_canon").alias("similarity"))
    return known.unionByName(scored)


def residual_by_id(residual: DataFrame, cand: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per external id: its residual rows and what they meet on the other side; `pairs` is `label_matches` of the two.

    Columns: rows, parsed_rows (those with a whole numeric key), any_match, canon_match, best (similarity), day_match.
    """
    best = pairs.groupBy(*NUMERIC_KEY, "ext_court").agg(
        F.max(F.coalesce("similarity", F.lit(0.0))).alias("best"),
        F.max(F.coalesce(F.col("ext_canon") == F.col("cand_canon"), F.lit(False))).alias("canon_match"),
    )
    best = best.withColumnsRenamed({k: f"_{k}" for k in NUMERIC_KEY})
    on = [F.col(k) == F.col(f"_{k}") for k in NUMERIC_KEY] + [F.col("court").eqNullSafe(F.col("ext_court"))]
    whole = all_not_null(*NUMERIC_KEY)
    met = residual.where(whole).join(best, on, "left").select("document_id", *NUMERIC_KEY, "day", "best", "canon_match")
    days = distinct_rows(cand.where(all_not_null(*NUMERIC_KEY, "day")), *NUMERIC_KEY, "day").withColumn(
        "day_match", F.lit(True))
    met = met.join(days, [*NUMERIC_KEY, "day"], "left").select(
        "document_id", "best", "canon_match", "day_match", F.lit(True).alias("parsed"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("best", "double"), ("canon_match", "boolean"), ("day_match", "boolean"))]
    met = met.unionByName(  # a NULL key meets nothing
        residual.where(~whole).select("document_id", *none, F.lit(False).alias("parsed")))
    false = F.lit(False)
    return met.groupBy("document_id").agg(
        F.count("*").alias("rows"),
        F.count_if("parsed").alias("parsed_rows"),
        F.max(F.col("best").isNotNull()).alias("any_match"),
        F.max(F.coalesce("canon_match", false)).alias("canon_match"),
        F.coalesce(F.max("best"), F.lit(0.0)).alias("best"),
        F.max(F.coalesce("day_match", false)).alias("day_match"),
    )


def distinct_matches(by_id: DataFrame, limits: tuple[float, ...] = SIMILARITY_LIMITS) -> DataFrame:
    """Distinct external ids under each condition, and the rows left over."""
    has_id = F.col("document_id").isNotNull()
    best = F.col("best")
    last = limits[-1]
    return by_id.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("external_residual_exact_key"),
        F.coalesce(F.sum("parsed_rows"), F.lit(0)).alias("residual_numeric_key_parseable"),
        F.count_if(has_id & F.col("any_match")).alias("ids_with_same_numeric_key"),
        F.count_if(has_id & F.col("canon_match")).alias("ids_with_court_canon_exact"),
        *[F.count_if(has_id & (best >= t)).alias(f"ids_with_similarity_ge_{round(t * 100):03d}") for t in limits],
        F.count_if(has_id & F.col("day_match")).alias("ids_with_same_numeric_key_and_date"),
        F.coalesce(F.sum(F.when(~has_id | (best < last), F.col("rows"))), F.lit(0))
        .alias("external_residual_after_fuzzy"),
    )


def residual_after_fuzzy(residual: DataFrame, by_id: DataFrame, limit: float = SIMILARITY_LIMITS[-1]) -> DataFrame:
    """Residual rows whose id has no similar match."""
    return absent(residual, by_id.where(F.col("best") >= limit), ("document_id",))


def alias_pairs(pairs: DataFrame, limit: float = SIMILARITY_LIMITS[-1]) -> DataFrame:
    """Court names that differ and are similar: number of row pairs, highest similarity."""
    used = pairs.where((F.col("ext_canon") != F.col("cand_canon")) & (F.col("similarity") >= limit))
    return used.groupBy("ext_court", "cand_court").agg(
        F.sum("n_pairs").alias("n"), F.round(F.max("similarity"), 4).alias("similarity"))


def alias_top(aliases: DataFrame, k: int = 50) -> DataFrame:
    return top_k(aliases, k, F.col("n").desc(), F.col("similarity").desc(), F.col("ext_court").asc_nulls_last(), F.col("cand_court").asc_nulls_last())
