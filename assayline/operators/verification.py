"""Sampled texts against official copies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayline.functions.similarity import sequence_ratio
from assayline.functions.text import contains_norm, length_ratio, lower_tr, normalize_text, preview, ratio
from assayline.operators.late import is_scan, narrow_first
from assayline.vocabulary import PLACEHOLDERS, RATIO_LIMITS


def attach_official_text(sample: DataFrame, official: DataFrame) -> DataFrame:
    """Sample rows with their official text. A row without a response stays, with a status.

    `official` is cut to the sampled ids first; of several responses for one id the best and then the first counts.
    """
    ids = sample.select("document_id").distinct()
    w = W.partitionBy("document_id").orderBy(F.when(F.col("status") == "ok", 0).otherwise(1), "raw_bytes", "_tie")

    def best(rows: DataFrame) -> DataFrame:
        wanted = rows.join(ids, "document_id", "left_semi")
        return wanted.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_tie")

    hashed = official.withColumn("_tie", F.xxhash64("official_text"))
    if not is_scan(official):  # cut to the sample before it is written
        hashed = hashed.join(ids, "document_id", "left_semi")
    one = narrow_first(hashed, best, "official_text")
    return sample.join(one, "document_id", "left").withColumn("status", F.coalesce("status", F.lit("missing")))


def compare_texts(pairs: DataFrame) -> DataFrame:
    """Adds flags and ratios to rows of `attach_official_text`; rows without an official text get NULLs."""
    norm = pairs.withColumns({
        "_c": F.when(F.col("status") == "ok", normalize_text(F.col("text"))),
        "_o": F.when(F.col("status") == "ok", normalize_text(F.col("official_text"))),
    })
    c, o = F.col("_c"), F.col("_o")
    rated = norm.withColumns({
        "_ratio": sequence_ratio("_c", "_o"),
        "corpus_chars": F.length("text"),
        "official_chars": F.length("official_text"),
        "court_present": contains_norm(normalize_text(F.col("court")), o),
        "esas_present": contains_norm(normalize_text(F.col("esas_no")), o),
        "karar_present": contains_norm(normalize_text(F.col("karar_no")), o),
        "corpus_in_official": contains_norm(c, o, non_empty=True),
        "official_in_corpus": contains_norm(o, c, non_empty=True),
        "normalized_length_ratio": F.when(c.isNotNull(), length_ratio(c, o)),
    })
    limits = {f"text_match_ge_0_{round(t * 100)}": F.col("_ratio") >= t for t in RATIO_LIMITS}
    return rated.withColumns({"sequence_ratio": F.bround("_ratio", 6), **limits}).drop(
        "_c", "_o", "_ratio", "text", "official_text")


def compare_placeholders(pairs: DataFrame) -> DataFrame:
    """Whether a placeholder stands in the corpus text and in the official one, with a short preview."""
    flags = {}
    for side, column in (("corpus", "text"), ("official", "official_text")):
        for name, word in PLACEHOLDERS.items():
            flags[f"{side}_{name.replace('placeholder', 'has')}"] = lower_tr(F.col(column)).contains(word)
    return pairs.withColumns({**flags, "official_preview": preview(F.col("official_text"))})


def match_quality(results: DataFrame) -> DataFrame:
    """One row over the compared sample. Percentiles are exact with linear interpolation: a sample is small."""
    ok = F.col("status") == "ok"
    r = F.when(ok, F.col("sequence_ratio"))
    all_three = F.col("court_present") & F.col("esas_present") & F.col("karar_present")
    out = results.agg(
        F.count("*").alias("requested"),
        F.count_if(ok).alias("official_retrieved"),
        F.count_if(ok & all_three).alias("metadata_all_three_present"),
        *[F.count_if(ok & F.col(f"text_match_ge_0_{round(t * 100)}")).alias(f"sequence_ratio_ge_0_{round(t * 100)}")
          for t in RATIO_LIMITS],
        F.min(r).alias("sequence_ratio_min"),
        F.percentile(r, 0.05).alias("sequence_ratio_p05"),
        F.percentile(r, 0.5).alias("sequence_ratio_median"),
        F.percentile(r, 0.95).alias("sequence_ratio_p95"),
    )
    return out.withColumn("metadata_match_rate", ratio(F.col("metadata_all_three_present"),
                                                       F.col("official_retrieved")))


def placeholder_quality(results: DataFrame) -> DataFrame:
    """Counts over a probe of suspicious rows."""
    ok = F.col("status") == "ok"
    return results.agg(
        F.count("*").alias("requested"), F.count_if(ok).alias("official_retrieved"),
        *[F.count_if(ok & F.col(n.replace("placeholder", "official_has"))).alias(
            n.replace("placeholder", "official_preserves")) for n in PLACEHOLDERS],
    )
