"""Writers for review files and metrics, and the reader that takes a review file back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_csv(df: DataFrame, path: str, *order: Column | str, single: bool = False) -> None:
    """Ordered CSV with a header; each sorted range is its own file. `single=True` makes one file, for bounded reports."""
    out = df.orderBy(*order) if order else df
    out = out.coalesce(1) if single else out
    out.write.csv(path, header=True, escape='"', mode="errorifexists",
                  ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def read_sample_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header and quoted texts over several lines, of any length."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"', maxCharsPerColumn=-1)


def write_metrics_json(df: DataFrame, path: str) -> None:
    """Each row as one JSON object, NULLs kept."""
    df.write.option("ignoreNullFields", False).json(path, mode="errorifexists")


def union_records(*parts: DataFrame) -> DataFrame:
    """Records with unlike fields in one table: missing ones are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def write_records_csv(path: str, *parts: DataFrame, order: tuple[Column | str, ...] = (), single: bool = False) -> None:
    """Result CSV; its header is the sorted union of all field names."""
    df = union_records(*parts)
    write_csv(df.select(*sorted(df.columns)), path, *order, single=single)


def name_view(df: DataFrame, name: str) -> DataFrame:
    df.createOrReplaceTempView(name)
    return df


def to_long(df: DataFrame, name: str = "metric", value: str = "value", kind: str = "double") -> DataFrame:
    """A one-row table of counters as (metric, value) rows."""
    pairs = [F.struct(F.lit(c).alias(name), F.col(c).cast(kind).alias(value)) for c in df.columns]
    return df.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")
