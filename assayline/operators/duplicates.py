"""Duplicate excess. Copies collapse in the map-side aggregation, so a hot value costs no more than a rare one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayline.functions.text import let, normalize_text
from assayline.vocabulary import METADATA_KEY


def dup_excess(df: DataFrame, column: str, name: str = "excess") -> DataFrame:
    """Rows minus distinct values: NULL rows count as excess."""
    return df.agg((F.count("*") - F.count_distinct(column)).alias(name))


def dup_excess_non_null(df: DataFrame, column: str) -> DataFrame:
    """nonnull, distinct_values, duplicate_excess of one column."""
    return df.agg(
        F.count(column).alias("nonnull"), F.count_distinct(column).alias("distinct_values"),
        (F.count(column) - F.count_distinct(column)).alias("duplicate_excess"),
    )


def distinct_count(df: DataFrame, column: str, name: str = "distinct_values") -> DataFrame:
    return df.agg(F.count_distinct(column).alias(name))


def key_dup_excess(df: DataFrame, keys: tuple[str, ...] = METADATA_KEY, name: str = "excess") -> DataFrame:
    """Surplus rows over all key groups; NULL key parts group together."""
    groups = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias(name))


def distinct_keys(df: DataFrame, *keys: str, name: str = "distinct_keys") -> DataFrame:
    """Number of key groups, those with NULL parts included."""
    return df.groupBy(*keys).agg(F.lit(1).alias("one")).agg(F.count("*").alias(name))


def distinct_tuples(df: DataFrame, keys: tuple[str, ...], *by: str, name: str = "distinct_tuples") -> DataFrame:
    """count(DISTINCT (a, b, ..)) per group; a tuple with NULL parts counts.

    Two plain aggregations, so a group that holds a third of the rows is reduced before it meets one task.
    """
    per_tuple = df.groupBy(*by, *keys).agg(F.count("*").alias("_n"))
    return per_tuple.groupBy(*by).agg(F.sum("_n").alias("rows"), F.count("*").alias(name))


def column_excess(df: DataFrame, columns: tuple[str, ...], skip_null: bool = False) -> DataFrame:
    """(column, rows, distinct_values, excess). One narrow scan per column: no row is multiplied, no text is read."""
    parts = []
    for c in columns:
        part = df.select(F.col(c).cast("string").alias("v"))
        part = part.where(F.col("v").isNotNull()) if skip_null else part
        groups = part.groupBy("v").agg(F.count("*").alias("n"))
        parts.append(groups.agg(
            F.lit(c).alias("column"),
            F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("rows"),
            F.count("v").alias("distinct_values"),
        ).withColumn("excess", F.col("rows") - F.col("distinct_values")))
    return reduce(DataFrame.unionByName, parts)


def duplicate_audit(df: DataFrame, id_column: str = "id", hash_column: str = "raw_sha256",
                    keys: tuple[str, ...] = METADATA_KEY) -> DataFrame:
    """(metric, value): rows and the three kinds of excess, in long form."""
    by_id = column_excess(df, (id_column,))
    return by_id.select(F.lit("rows").alias("metric"), F.col("rows").alias("value")).unionByName(
        by_id.select(F.lit("duplicate_id_excess_rows").alias("metric"), F.col("excess").alias("value"))
    ).unionByName(
        column_excess(df, (hash_column,), skip_null=True)
        .select(F.lit("duplicate_raw_sha256_excess_rows").alias("metric"), F.col("excess").alias("value"))
    ).unionByName(
        key_dup_excess(df, keys).select(F.lit("metadata_duplicate_excess_rows").alias("metric"),
                                        F.col("excess").alias("value"))
    )


def group_excess(rows: DataFrame, group: str = "component_id") -> DataFrame:
    """rows, groups and excess of rows that already know their group (near copies, say); a row without one is its own."""
    sizes = rows.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n"))
    alone = rows.where(F.col(group).isNull()).agg(F.count("*").alias("n")).where("n > 0").select("n", F.col("n").alias("g"))
    both = sizes.select("n", F.lit(1).cast("bigint").alias("g")).unionByName(alone)
    return both.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum("g"), F.lit(0)).alias("groups")).withColumn(
        "excess", F.col("rows") - F.col("groups"))


def text_key(column: str = "text") -> Column:
    """Hash of the normal form, which is worked out once; NULL for texts that have none left."""
    return let(normalize_text(F.col(column)), lambda norm: F.when(F.length(norm) > 0, F.sha2(norm, 256)))


def text_overlap(left: DataFrame, right: DataFrame, column: str = "text", name: str = "in_other") -> DataFrame:
    """`left` with the number of rows of `right` that have the same normal form; texts without a normal form meet nothing.

    Only hashes meet, and `right` is counted per hash before, so a text that a third of both sides hold makes no row pairs.
    Rows without a hash get a number of their own to be joined on, so they are dealt over all tasks and meet nothing.
    """
    zero = F.lit(0).cast("bigint")
    one = F.explode(F.array_compact(F.array(text_key(column)))).alias("_key")  # expanded: a filter would work it out again
    there = right.select(one).groupBy("_key").agg(F.count("*").alias(name)).withColumn("_spread", zero)
    keyed = left.withColumn("_key", text_key(column))
    dealt = keyed.withColumn("_spread", F.when(F.col("_key").isNotNull(), zero).otherwise(F.monotonically_increasing_id() + 1))
    met = dealt.join(there, ["_key", "_spread"], "left")
    return met.select(*left.columns, F.coalesce(name, F.lit(0)).cast("bigint").alias(name))
