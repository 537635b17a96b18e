"""Personal data: direct identifiers, masking and its check, contextual signals, entity detections."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayline.functions.patterns import context_flags, direct_flags, mask_pii, needle_form
from assayline.functions.predicates import changed, is_masked
from assayline.functions.text import rate, text_windows
from assayline.operators.sampling import modern_flag, top_k, top_n_per_stratum
from assayline.vocabulary import (
    CONTEXT_PATTERNS, CONTEXT_SAMPLE, DIRECT_PATTERNS, ENTITY_SAMPLE, ENTITY_THRESHOLDS, MASK_TOKENS,
)

_NAMES = {label: name for label, name, _ in DIRECT_PATTERNS}


def pii_flags(df: DataFrame, mode: str = "re2", *keep: str) -> DataFrame:
    """Narrow rows: kept columns, one boolean per direct identifier and per mask token. Each pattern runs once."""
    text = F.col("text")
    direct = [c.alias(_NAMES[label]) for label, c in direct_flags(text, mode).items()]
    tokens = [text.contains(token).alias(n) for n, token in MASK_TOKENS.items()]
    return df.select(*keep, "masked_count", *direct, *tokens)


def _pii_counters() -> list[Column]:
    return [
        F.count("*").alias("rows"),
        F.count_if(is_masked("masked_count")).alias("rows_with_dataset_masking"),
        F.coalesce(F.sum("masked_count"), F.lit(0)).alias("total_dataset_masked_count"),
        *[F.count_if(F.col(n)).alias(f"{n}_rows") for n in _NAMES.values()],
        *[F.count_if(F.col(n)).alias(n) for n in MASK_TOKENS],
    ]


def pii_by_year(df: DataFrame, mode: str = "re2") -> DataFrame:
    return pii_flags(df, mode, "year").groupBy("year").agg(*_pii_counters())


def pii_screen(df: DataFrame, mode: str = "re2") -> DataFrame:
    """Totals as one row."""
    return pii_flags(df, mode).agg(*_pii_counters())


def pii_totals(by_year: DataFrame) -> DataFrame:
    """Totals out of the yearly table, so that the text is scanned once for both."""
    return by_year.agg(*[F.sum(c).alias(c) for c in by_year.columns if c != "year"])


def drawn(df: DataFrame, limits: dict[int, int] | None) -> DataFrame:
    """A sample with its texts, which come from the tasks that scan them. None: all rows."""
    rows = df.select("id", "year", "text")
    if limits is None:
        return rows.withColumn("modern", modern_flag())
    return top_n_per_stratum(rows, limits)


def contextual_sample(df: DataFrame, limits: dict[int, int] | None = CONTEXT_SAMPLE) -> DataFrame:
    return drawn(df, limits)


def signal_counts(sample: DataFrame, mode: str = "re2") -> DataFrame:
    """One row: sample size, modern rows, rows per signal."""
    facts = sample.select("modern", "text", needle_form(F.col("text"), mode).alias("_low"))
    flags = facts.select("modern", *[c.alias(n) for n, c in context_flags(F.col("text"), F.col("_low"), mode).items()])
    return flags.agg(
        F.count("*").alias("rows_sampled"), F.count_if(F.col("modern") == 1).alias("modern_rows"),
        *[F.count_if(F.col(n)).alias(n) for n in CONTEXT_PATTERNS],
    )


def signal_rates(counts: DataFrame) -> DataFrame:
    """(signal, rows, rate) out of the one-row counts; a rate over an empty sample is 0."""
    pairs = [F.struct(F.lit(n).alias("signal"), F.col(n).alias("rows"),
                      rate(F.col(n), F.col("rows_sampled")).alias("rate")) for n in CONTEXT_PATTERNS]
    return counts.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")


def contextual_screen(df: DataFrame, limits: dict[int, int] | None = CONTEXT_SAMPLE, mode: str = "re2") -> DataFrame:
    return signal_rates(signal_counts(contextual_sample(df, limits), mode))


def sanitize(df: DataFrame, text: str = "text", out: str = "sanitized", mode: str = "re2",
             guarded: bool = False) -> DataFrame:
    """Adds the masked text. The input column stays as it is."""
    return df.withColumn(out, mask_pii(F.col(text), mode, guarded))


def sanitize_flags(df: DataFrame, mode: str = "re2", guarded: bool = False) -> DataFrame:
    """Per row: pattern found before, text changed, pattern left after.

    A text without a match is its own masked form, so only texts with a match are rewritten and searched again.
    """
    text = F.col("text")
    before = direct_flags(text, mode)
    names = [label.lower() for label in before]
    found = df.select("text", *[c.alias(f"before_{label.lower()}") for label, c in before.items()])
    hit = reduce(or_, [F.col(f"before_{n}") for n in names])
    masked = found.withColumn("sanitized", F.when(hit, mask_pii(text, mode, guarded)).otherwise(text))
    after = direct_flags(F.col("sanitized"), mode)
    return masked.select(
        changed("text", "sanitized").alias("changed"), *[f"before_{n}" for n in names],
        *[(hit & c).alias(f"residual_{label.lower()}") for label, c in after.items()],
    )


def sanitize_check(df: DataFrame, mode: str = "re2", guarded: bool = False) -> DataFrame:
    """rows, rows_changed, before_* and residual_* per label, residual_sum and whether it is 0."""
    flags = sanitize_flags(df, mode, guarded)
    marks = [c for c in flags.columns if c != "changed"]
    out = flags.agg(F.count("*").alias("rows"), F.count_if("changed").alias("rows_changed"),
                    *[F.count_if(F.col(c)).alias(c) for c in marks])
    residual = reduce(lambda a, b: a + b, [F.col(c) for c in marks if c.startswith("residual_")])
    return out.withColumn("residual_sum", residual).withColumn("passed", F.col("residual_sum") == 0)


def windowed_chunks(sample: DataFrame, windows: Callable[[Column], Column] = text_windows) -> DataFrame:
    """One row per text window of a sample; what stands in the overlap of two windows is seen in both."""
    return sample.select("id", "year", "modern", F.posexplode(windows(F.col("text"))).alias("chunk_no", "chunk"))


Detector = Callable[[str], list[tuple[str, float]]]

DETECTIONS = "id string, chunk_no int, label string, score double, failed boolean"


#: What a batch detector's set-up gives: texts in, for each of them its (label, score) pairs out.
BatchDetector = Callable[[list[str]], list[list[tuple[str, float]]]]

ATTEMPTS = DETECTIONS + ", error string"


def _tried(detect: BatchDetector, texts: list[str]) -> list[list[tuple[str, float]] | Exception]:
    """Results of all texts; a batch that fails is halved until only the texts that cause it have failed."""
    try:
        found = detect(texts)
        if len(found) != len(texts):
            raise ValueError(f"{len(found)} results for {len(texts)} texts")
        return found
    except Exception as error:
        if len(texts) == 1:
            return [error]
        half = len(texts) // 2
        return _tried(detect, texts[:half]) + _tried(detect, texts[half:])


def detect_batches(chunks: DataFrame, setup: Callable[[], BatchDetector], size: int = 64) -> DataFrame:
    """Runs a detector over all chunks, `size` texts at a time: `DETECTIONS` and the `error` of a failed chunk.

    `setup` makes the detector (loads a model, say). It is called once in each Python worker, which keeps what it gives for
    later tasks of the same run. Each chunk leaves at least one row, as with `detect_entities`.
    """
    run_name = uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = sys.__dict__.setdefault("_assayline_detectors", {})
        if run_name not in kept:
            kept.clear()  # a worker holds one detector at a time
            kept[run_name] = setup()
        for batch in batches:
            rows = []
            for at in range(0, len(batch), size):
                part = batch.iloc[at : at + size]
                results = _tried(kept[run_name], part["chunk"].tolist())
                for doc, no, found in zip(part["id"], part["chunk_no"], results):
                    if isinstance(found, Exception):
                        rows.append((doc, no, None, None, True, f"{type(found).__name__}: {found}"))
                    else:
                        rows += [(doc, no, label, score, False, None) for label, score in found or [(None, None)]]
            yield pd.DataFrame(rows, columns=["id", "chunk_no", "label", "score", "failed", "error"])

    return chunks.select("id", "chunk_no", "chunk").mapInPandas(run, ATTEMPTS)


def detect_entities(chunks: DataFrame, detector: Detector) -> DataFrame:
    """Runs a detector (text -> [(label, score)]) over all chunks, inside the tasks.

    Each chunk leaves at least one row: a chunk without entity has a NULL label, a failed one is marked.
    """
    def setup() -> BatchDetector:
        return lambda texts: [detector(t) or [] for t in texts]

    return detect_batches(chunks, setup, size=1).drop("error")


def entity_errors(detections: DataFrame, k: int = 20) -> DataFrame:
    """(error, chunks): the most frequent failures of `detect_batches`."""
    counts = detections.where("failed").groupBy("error").agg(F.count("*").alias("chunks"))
    return top_k(counts, k, F.desc("chunks"), F.col("error").asc_nulls_last())


def detect_direct(chunks: DataFrame, mode: str = "re2", score: float = 1.0) -> DataFrame:
    """The direct-identifier patterns as a detector made of expressions: one row per chunk and label."""
    labels = [F.when(c, F.lit(label)) for label, c in direct_flags(F.col("chunk"), mode).items()]
    found = chunks.select("id", "chunk_no", F.array_compact(F.array(*labels)).alias("labels"))
    return found.select(
        "id", "chunk_no", F.explode_outer("labels").alias("label")
    ).withColumns({"score": F.when(F.col("label").isNotNull(), F.lit(score)), "failed": F.lit(False)})


def entity_counts(detections: DataFrame, thresholds: tuple[float, ...] = ENTITY_THRESHOLDS) -> DataFrame:
    """(threshold, label, entities, documents) for labels found at each threshold."""
    passed = F.filter(F.array(*[F.lit(t) for t in thresholds]), lambda t: F.col("score") >= t)
    hits = detections.where(F.col("label").isNotNull()).select("id", "label", F.explode(passed).alias("threshold"))
    per_doc = hits.groupBy("threshold", "label", "id").agg(F.count("*").alias("n"))
    return per_doc.groupBy("threshold", "label").agg(
        F.sum("n").alias("entities"), F.count("*").alias("documents"))


def documents_with_entities(detections: DataFrame, thresholds: tuple[float, ...] = ENTITY_THRESHOLDS) -> DataFrame:
    """(threshold, documents_with_any_entity); a threshold without any shows 0."""
    best = detections.groupBy("id").agg(F.max("score").alias("score"))
    counts = best.agg(*[F.count_if(F.col("score") >= t).alias(f"t{i}") for i, t in enumerate(thresholds)])
    pairs = [F.struct(F.lit(t).alias("threshold"), F.col(f"t{i}").alias("documents_with_any_entity"))
             for i, t in enumerate(thresholds)]
    return counts.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")


def entity_run_quality(detections: DataFrame, max_error_rate: float = 0.05) -> DataFrame:
    """Chunks, failures, and whether the run counts: a run of failures must not read as 'nothing found'."""
    chunks = detections.groupBy("id", "chunk_no").agg(F.max("failed").alias("failed"))
    out = chunks.agg(F.count("*").alias("chunks_scanned"), F.count_if("failed").alias("inference_errors"))
    share = rate(F.col("inference_errors"), F.col("chunks_scanned"))
    return out.withColumn("error_rate", share).withColumn(
        "valid", (F.col("chunks_scanned") > 0) & (F.col("error_rate") <= max_error_rate))


def entity_sample(df: DataFrame, limits: dict[int, int] | None = ENTITY_SAMPLE) -> DataFrame:
    return drawn(df, limits)
