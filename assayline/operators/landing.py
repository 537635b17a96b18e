"""Audit of landed search responses: page sizes, page overlap, field types, safe projection, time window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayline.functions.dates import local_date
from assayline.functions.predicates import project_present
from assayline.operators.sampling import top_k
from assayline.sources.landed import page_items
from assayline.vocabulary import SAFE_FIELDS


def page_facts(pages: DataFrame) -> DataFrame:
    """Per page: reported start and total, requested size, items in it, first and last document."""
    items = F.col("data.emsalKararList")
    count = F.coalesce(F.size(items), F.lit(0))
    return pages.select(
        F.col("data.start").alias("start"), F.col("data.total").alias("total"), "requested_page_size",
        F.greatest(count, F.lit(0)).alias("returned_count"),
        F.try_element_at(items, F.lit(1))["documentId"].alias("first_document"),
        F.try_element_at(items, F.lit(-1))["documentId"].alias("last_document"),
    )


def page_overlap(pages: DataFrame) -> DataFrame:
    """Per page: documents it shares with the page that follows it (0 = the two are disjoint)."""
    items = pages.select(F.col("data.start").alias("start"),
                         (F.col("data.start") + F.col("requested_page_size")).alias("next_start"),
                         F.explode("data.emsalKararList.documentId").alias("documentId")).distinct()
    here, there = items.alias("a"), items.alias("b")
    shared = here.join(there, (F.col("a.documentId") == F.col("b.documentId")) &
                       (F.col("a.next_start") == F.col("b.start")), "left_semi")
    counts = shared.groupBy("start").agg(F.count("*").alias("shared"))
    starts = pages.select(F.col("data.start").alias("start")).distinct()
    return starts.join(counts, "start", "left").select(
        "start", F.coalesce("shared", F.lit(0)).alias("shared_with_next"),
        F.col("shared").isNull().alias("disjoint"))


def repeated_documents(pages: DataFrame) -> DataFrame:
    """Documents that stand in more than one page."""
    seen = page_items(pages).groupBy("documentId", "start").agg(F.count("*").alias("n"))
    return seen.groupBy("documentId").agg(
        F.count("*").alias("pages"), F.sum("n").alias("items")).where("pages > 1")


def page_summary(pages: DataFrame) -> DataFrame:
    """One row: pages, items, pages short of their size, lowest and highest reported total."""
    facts = page_facts(pages)
    return facts.agg(
        F.count("*").alias("pages"), F.sum("returned_count").alias("items"),
        F.count_if(F.col("returned_count") < F.col("requested_page_size")).alias("short_pages"),
        F.min("total").alias("min_total"), F.max("total").alias("max_total"),
    )


def safe_projection(items: DataFrame, fields: tuple[str, ...] = SAFE_FIELDS) -> DataFrame:
    """Only the allowed fields that exist."""
    return project_present(items, fields)


def first_items(items: DataFrame, k: int = 10) -> DataFrame:
    """Head of the safe projection in page order."""
    ordered = top_k(items, k, F.col("start"), F.col("position"), F.col("documentId"))
    return safe_projection(ordered)


def records_in_window(items: DataFrame, kinds: list[str], start: str, end: str) -> DataFrame:
    """Items of the given types whose instant lies between two instants, both included."""
    at = F.try_to_timestamp(F.col("kararTarihi"))
    return items.where(F.col("itemType.name").isin(kinds) &
                       at.between(F.to_timestamp(F.lit(start)), F.to_timestamp(F.lit(end))))


def with_local_day(items: DataFrame, zone: str = "Europe/Istanbul") -> DataFrame:
    """The calendar day behind an instant that is local midnight."""
    return items.withColumn("decision_day", local_date(F.col("kararTarihi"), zone))


def json_type_name(schema: Column) -> Column:
    """Short type name out of a variant schema."""
    return (
        F.when(schema == "VOID", "null").when(schema == "BOOLEAN", "bool").when(schema == "BIGINT", "int")
        .when(schema.startswith("DOUBLE") | schema.startswith("DECIMAL"), "float").when(schema == "STRING", "str")
        .when(schema.startswith("ARRAY"), "list").when(schema.startswith("OBJECT"), "dict").otherwise(F.lower(schema))
    )


def field_types(raw: DataFrame, value: str = "value", path: str = "$.data.emsalKararList") -> DataFrame:
    """(field, type, items): which JSON type each item field has, over all raw response lines."""
    items = raw.select(F.explode(F.try_variant_get(F.try_parse_json(value), path, "array<variant>")).alias("item"))
    spark = raw.sparkSession
    fields = items.lateralJoin(spark.tvf.variant_explode(F.col("item").outer()).alias("f"))
    return fields.groupBy(F.col("f.key").alias("field"),
                          json_type_name(F.schema_of_variant("f.value")).alias("type")).agg(
        F.count("*").alias("items"))
