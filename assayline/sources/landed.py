"""Landed responses of a search and document service: nested pages to rows, encoded documents to text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.functions.html import html_to_text
from assayline.spec import PAYLOAD, SEARCH_PAGE


def read_search_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row per response page. The schema is fixed: three item fields are NULL in every page seen so far."""
    return spark.read.schema(SEARCH_PAGE).json(path)


def page_items(pages: DataFrame) -> DataFrame:
    """One row per item with the page it came from; a page without items gives none."""
    return pages.select(
        F.col("data.start").alias("start"), F.col("data.total").alias("total"),
        F.posexplode("data.emsalKararList").alias("position", "item"),
    ).select("start", "total", "position", "item.*")


def read_document_payloads(spark: SparkSession, path: str) -> DataFrame:
    return decode_payloads(spark.read.schema(PAYLOAD).json(path))


def decode_payloads(df: DataFrame, mime: Column | None = None, content: Column | None = None) -> DataFrame:
    """document_id, mime, raw_bytes, official_text, status.

    HTML is reduced to its text, other text types are decoded, anything else gives an empty text. A document
    without content, or with content that is not base64, keeps its row with a status.
    """
    mime = F.col("data.mimeType") if mime is None else mime
    content = F.col("data.content") if content is None else content
    raw = df.select("document_id", mime.alias("mime"), content.alias("content"),
                    F.try_to_binary(content, F.lit("base64")).alias("raw"))
    text = F.make_valid_utf8(F.col("raw").cast("string"))
    decoded = raw.select(
        "document_id", "mime",
        F.length("raw").alias("raw_bytes"),
        F.when(F.col("mime") == "text/html", text).alias("page"),
        F.when(F.col("mime").contains("text"), text).otherwise("").alias("plain"),
        F.when(F.coalesce(F.length("content"), F.lit(0)) == 0, "no_content")
        .when(F.col("raw").isNull(), "bad_content").otherwise("ok").alias("status"),
    )
    return decoded.select(
        "document_id", "mime", "raw_bytes",
        F.when(F.col("status") == "ok", F.coalesce(html_to_text(F.col("page")), F.col("plain")))
        .alias("official_text"),
        "status",
    )
