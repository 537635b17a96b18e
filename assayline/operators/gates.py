"""Thresholds over metrics, and the one final state."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.functions.text import rate
from assayline.vocabulary import ACCEPT, CONDITIONAL, REJECT, TARGETS

PASS, FAIL, CONDITION, PENDING = "PASS", "FAIL", "CONDITIONAL_PASS", "PENDING"


def targets_table(spark: SparkSession, targets: Iterable[tuple] = TARGETS, soft: Iterable[str] = ()) -> DataFrame:
    """(metric, op, threshold, hard): a hard gate that fails rejects, a soft one sets a condition."""
    soft = set(soft)
    rows = [(m, op, float(t), m not in soft) for m, op, t in targets]
    return spark.createDataFrame(rows, "metric string, op string, threshold double, hard boolean")


def evaluate_gates(metrics: DataFrame, targets: DataFrame) -> DataFrame:
    """State per gate. `metrics` is (metric, value); a gate without a value is pending. Both tables are short lists."""
    v, t = F.col("value"), F.col("threshold")
    met = F.expr("""CASE op WHEN '>=' THEN value >= threshold WHEN '>' THEN value > threshold
                            WHEN '<=' THEN value <= threshold WHEN '<' THEN value < threshold
                            WHEN '=' THEN value = threshold END""")
    state = F.when(v.isNull() | met.isNull(), PENDING).when(met, PASS).when(F.col("hard"), FAIL).otherwise(CONDITION)
    return targets.join(metrics, "metric", "left").select(
        "metric", "op", t.alias("threshold"), v.alias("observed"), "hard", state.alias("state"))


def final_state(gates: DataFrame) -> DataFrame:
    """REJECT if a hard gate failed, conditions if a gate is soft-failed or pending, else ACCEPT."""
    return gates.agg(
        F.count("*").alias("gates"),
        *[F.count_if(F.col("state") == s).alias(n) for s, n in
          ((PASS, "passed"), (CONDITION, "conditional"), (PENDING, "pending"), (FAIL, "failed"))],
    ).withColumn(
        "final_state",
        F.when(F.col("failed") > 0, REJECT).when(F.col("passed") < F.col("gates"), CONDITIONAL)
        .when(F.col("gates") == 0, CONDITIONAL).otherwise(ACCEPT))


def corpus_rates(profile: DataFrame) -> DataFrame:
    """(metric, value) of a one-row profile with structural and quality counters."""
    rows = F.col("rows")
    usable = rows - F.col("empty_text") - F.col("any_known_placeholder")
    return profile.select(F.explode(F.array(
        F.struct(F.lit("valid_document_rate").alias("metric"), rate(usable, rows).alias("value")),
        F.struct(F.lit("full_text_rate").alias("metric"), rate(rows - F.col("lt_100_chars"), rows).alias("value")),
    )).alias("p")).select("p.*")
