"""Structure and quality counters. All of them come from one scan: flags per row first, then one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayline.functions.predicates import (
    contains_any, is_blank, is_null, suspicious_label, wrong_constant,
)
from assayline.functions.text import lower_tr
from assayline.sources.outputs import to_long
from assayline.vocabulary import MARKERS, PLACEHOLDERS, SHORT_LIMITS

ACCURACY = 10_000

BLANK_COUNTERS = {
    "empty_id": "id", "empty_source": "source", "empty_document_id": "document_id", "empty_court": "court",
    "empty_esas": "esas_no", "empty_karar": "karar_no", "empty_date": "karar_tarihi", "empty_text": "text",
    "empty_raw_sha256": "raw_sha256",
}
NULL_COUNTERS = {"empty_year": "year", "empty_month": "month", "empty_text_len": "text_len"}


def with_text_facts(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds `_chars` and `_low`, so that length and lower case are worked out once per row."""
    return df.withColumns({"_chars": F.length(text), "_low": lower_tr(F.col(text))})


def structural_flags(source_name: str | None = None) -> dict[str, Column]:
    """Missing and wrong values, short texts (needs `with_text_facts`)."""
    flags = {n: is_blank(c) for n, c in BLANK_COUNTERS.items()}
    flags |= {n: is_null(c) for n, c in NULL_COUNTERS.items()}
    if source_name is not None:
        flags["wrong_source"] = wrong_constant("source", source_name)
    flags["text_len_mismatch"] = F.col("text_len") != F.col("_chars")
    return flags | short_flags()


def short_flags() -> dict[str, Column]:
    return {f"lt_{n}_chars": F.col("_chars") < n for n in SHORT_LIMITS}


def quality_flags(label: str = "court") -> dict[str, Column]:
    """Placeholders, decision markers, suspicious labels (needs `with_text_facts`)."""
    low = F.col("_low")
    flags = {n: low.contains(word) for n, word in PLACEHOLDERS.items()}
    flags["any_known_placeholder"] = contains_any(low, PLACEHOLDERS.values())
    flags["suspicious_court"] = suspicious_label(label)
    return flags | {n: contains_any(low, words) for n, words in MARKERS.items()}


def row_facts(df: DataFrame, flags: dict[str, Column], *keep: str) -> DataFrame:
    """Narrow rows: the kept columns, `_chars` and one boolean per flag. The text ends here."""
    return with_text_facts(df).select(*keep, "_chars", *[c.alias(n) for n, c in flags.items()])


def counters(flags: dict[str, Column] | list[str]) -> list[Column]:
    return [F.count("*").alias("rows"), *[F.count_if(F.col(n)).alias(n) for n in flags]]


def quantile(c: Column, p: float, accuracy: int = ACCURACY) -> Column:
    """Discrete quantile from a mergeable sketch with a rank error of one in `accuracy`."""
    return F.percentile_approx(c, p, accuracy)


def length_columns() -> list[Column]:
    chars = F.col("_chars")
    return [
        F.min(chars).alias("min_chars"), quantile(chars, 0.01).alias("p01_chars"),
        quantile(chars, 0.5).alias("median_chars"), quantile(chars, 0.99).alias("p99_chars"),
        F.max(chars).alias("max_chars"), F.avg(chars).alias("avg_chars"),
    ]


def conditional_counts(df: DataFrame, **predicates: Column) -> DataFrame:
    """Any number of counters in one scan; a NULL predicate does not count."""
    return df.agg(*[F.count_if(p).alias(n) for n, p in predicates.items()])


def null_profile(df: DataFrame) -> DataFrame:
    """(column, nulls) for every column, from one scan."""
    return to_long(df.agg(*[F.count_if(is_null(c)).alias(c) for c in df.columns]), "column", "nulls", "bigint")


def text_profile(df: DataFrame) -> DataFrame:
    """Empty and short texts and the length profile."""
    flags = {"empty_text": is_blank("text")} | short_flags()
    return row_facts(df, flags).agg(*counters(flags), *length_columns())


def structural_profile(df: DataFrame, source_name: str | None = None, expected_rows: int | None = None) -> DataFrame:
    flags = structural_flags(source_name)
    out = row_facts(df, flags, "year").agg(
        *counters(flags), F.min("year").alias("min_year"), F.max("year").alias("max_year"), *length_columns()
    )
    if expected_rows is None:
        return out
    return out.withColumns({
        "expected_rows": F.lit(expected_rows).cast("bigint"),
        "row_count_matches": F.col("rows") == F.lit(expected_rows),
    })


def stored_length_profile(df: DataFrame, source_name: str) -> DataFrame:
    """The light form: lengths come from the stored column."""
    picked = ("empty_text", "empty_id", "empty_date", "empty_esas", "empty_karar")
    return df.agg(
        F.count("*").alias("rows"),
        *[F.count_if(is_blank(BLANK_COUNTERS[n])).alias(n) for n in picked],
        F.min("text_len").alias("min_text_len"), F.max("text_len").alias("max_text_len"),
        F.avg("text_len").alias("avg_text_len"), F.min("year").alias("min_year"), F.max("year").alias("max_year"),
        F.count_if(wrong_constant("source", source_name)).alias("wrong_source"),
    )


def quality_profile(df: DataFrame) -> DataFrame:
    flags = quality_flags()
    return row_facts(df, flags).agg(*counters(flags))


def marker_profile(df: DataFrame) -> DataFrame:
    flags = {n: contains_any(F.col("_low"), words) for n, words in MARKERS.items()}
    return row_facts(df, flags).agg(*counters(flags))


def audit_cube(df: DataFrame, source_name: str | None = None) -> DataFrame:
    """All counters and length quantiles at four grains (all, year, court, year x court) from ONE scan of the text.

    The grains multiply only the narrow flag rows, and these meet the map-side aggregation in the same stage, so the
    shuffle carries one row per task and group. `by_year` and `by_court` tell the grain.
    """
    flags = structural_flags(source_name) | quality_flags()
    facts = row_facts(df, flags, "year", "court").withColumn("_year", F.col("year"))
    grains = [[F.col("year"), F.col("court")], [F.col("year")], [F.col("court")], []]
    return facts.groupingSets(grains, "year", "court").agg(
        (F.grouping("year") == 0).alias("by_year"), (F.grouping("court") == 0).alias("by_court"),
        *counters(flags), F.min("_year").alias("min_year"), F.max("_year").alias("max_year"), *length_columns(),
    )


def cube_slice(cube: DataFrame, by_year: bool, by_court: bool) -> DataFrame:
    return cube.where((F.col("by_year") == by_year) & (F.col("by_court") == by_court)).drop("by_year", "by_court")
