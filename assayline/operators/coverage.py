"""Coverage by year and court, gaps in it, and comparison with the totals of another source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayline.functions.predicates import contains_any, phrase_words
from assayline.functions.text import lower_tr, ratio
from assayline.operators.profile import quantile
from assayline.vocabulary import COMPLETE_YEARS, GAP_FLOOR, GAP_YEARS, PHRASES, PLACEHOLDERS, SHORT_TEXT


def coverage_by_year(df: DataFrame) -> DataFrame:
    low = df.select("year", F.length("text").alias("_chars"), lower_tr(F.col("text")).alias("_low"))
    facts = low.select("year", "_chars", contains_any(F.col("_low"), PLACEHOLDERS.values()).alias("_placeholder"))
    return facts.groupBy("year").agg(
        F.count("*").alias("decisions"), F.count_if(F.col("_chars") < SHORT_TEXT).alias("lt_300"),
        F.count_if("_placeholder").alias("known_placeholder"),
    )


def coverage_by_court(df: DataFrame) -> DataFrame:
    """The label is taken as it is, blanks at its end included."""
    return df.groupBy("court").agg(
        F.count("*").alias("decisions"), F.count_if(F.length("text") < SHORT_TEXT).alias("lt_300")
    )


def coverage_year_court(df: DataFrame) -> DataFrame:
    facts = df.select("year", "court", F.length("text").alias("_chars"))
    return facts.groupBy("year", "court").agg(
        F.count("*").alias("decisions"), quantile(F.col("_chars"), 0.5).alias("median_chars"),
        F.count_if(F.col("_chars") < SHORT_TEXT).alias("lt_300"),
    )


def coverage_stored_length(df: DataFrame) -> DataFrame:
    """Year x court from the stored length: the text column is not read."""
    return df.groupBy("year", "court").agg(
        F.count("*").alias("decisions"), F.min("text_len").alias("min_text_len"),
        quantile(F.col("text_len"), 0.5).alias("median_text_len"), F.max("text_len").alias("max_text_len"),
    )


def active_labels_by_year(df: DataFrame) -> DataFrame:
    """Rows and courts per year, from the year x court counts (a hot court is one row by then)."""
    cells = df.groupBy("year", "court").agg(F.count("*").alias("n"))
    return cells.groupBy("year").agg(F.sum("n").alias("decisions"), F.count("court").alias("active_courts"))


def internal_gaps(df: DataFrame, floor: int = GAP_FLOOR, years: tuple[int, int] = GAP_YEARS) -> DataFrame:
    """Court-years without a row between two years of at least `floor` rows.

    Works on the counts per court and year, where a gap is a step of two between neighbours: no grid of all courts
    and years is made.
    """
    cells = df.where(F.col("year").isNotNull()).groupBy("court", "year").agg(F.count("*").alias("n"))
    w = W.partitionBy("court").orderBy("year")
    pairs = cells.select("court", F.col("year").cast("int").alias("before_year"), F.col("n").alias("before_rows"),
                         F.lead("year").over(w).cast("int").alias("after_year"),
                         F.lead("n").over(w).alias("after_rows"))
    gap = (F.col("after_year") == F.col("before_year") + 2) & (F.col("before_rows") >= floor) & (
        F.col("after_rows") >= floor)
    return pairs.where(gap).select(
        "court", (F.col("before_year") + 1).alias("year"), "before_rows", "after_rows"
    ).where(F.col("year").between(*years))


def compare_year_counts(ours: DataFrame, theirs: DataFrame, our_column: str, their_column: str) -> DataFrame:
    """Two tables of (year, count): all years of either, zeros where one has none, and the difference."""
    return ours.join(theirs, "year", "full").select(
        "year",
        F.coalesce(our_column, F.lit(0)).alias(our_column),
        F.coalesce(their_column, F.lit(0)).alias(their_column),
        (F.coalesce(our_column, F.lit(0)) - F.coalesce(their_column, F.lit(0))).alias("difference"),
    )


def coverage_vs_totals(counts: DataFrame, totals: DataFrame, status: str | None = None) -> DataFrame:
    """counts (year, corpus_rows) against totals (year, total): difference, ratio, and a status per year.

    Years asked for are those of `totals`; a year without a corpus row counts 0, a NULL total keeps its row.
    """
    joined = totals.join(counts, "year", "left")
    rows = F.coalesce("corpus_rows", F.lit(0))
    state = F.when(F.col("total").isNull(), "error").otherwise("ok") if status is None else F.col(status)
    return joined.select(
        "year", rows.alias("corpus_rows"), "total", (F.col("total") - rows).alias("difference"),
        ratio(rows, F.col("total")).alias("ratio"), state.alias("status"),
    )


def complete_period_ratio(compared: DataFrame, years: tuple[int, int] = COMPLETE_YEARS) -> DataFrame:
    """Sums over the complete years that have a total."""
    used = compared.where((F.col("status") == "ok") & F.col("year").between(*years))
    return used.agg(
        F.count("*").alias("years_retrieved"),
        F.coalesce(F.sum("corpus_rows"), F.lit(0)).alias("corpus_rows"),
        F.coalesce(F.sum("total"), F.lit(0)).alias("total"),
    ).withColumns({
        "difference": F.col("total") - F.col("corpus_rows"),
        "ratio": ratio(F.col("corpus_rows"), F.col("total")),
    })


def phrase_totals(df: DataFrame, phrases: tuple[str, ...] = PHRASES) -> DataFrame:
    """(year, phrase, total, corpus_rows, ratio): rows per year that hold any word of the phrase, from one scan."""
    marks = {f"p{i}": contains_any(F.col("_low"), phrase_words(p)) for i, p in enumerate(phrases)}
    low = df.select("year", lower_tr(F.col("text")).alias("_low"))
    flags = low.select("year", *[c.alias(n) for n, c in marks.items()])
    per_year = flags.groupBy("year").agg(
        F.count("*").alias("corpus_rows"), *[F.count_if(F.col(n)).alias(n) for n in marks]
    )
    pairs = F.array(*[F.struct(F.lit(p).alias("phrase"), F.col(f"p{i}").alias("total"))
                      for i, p in enumerate(phrases)])
    return per_year.select("year", "corpus_rows", F.explode(pairs).alias("p")).select(
        "year", "p.phrase", "p.total", "corpus_rows",
        ratio(F.col("corpus_rows"), F.col("p.total")).alias("corpus_over_query_total"),
    )


def phrase_agreement(totals: DataFrame) -> DataFrame:
    """Per year: how many different totals the phrases gave (1 = the phrase does not matter)."""
    return totals.groupBy("year").agg(
        F.count("*").alias("phrases"), F.count_distinct("total").alias("distinct_totals"),
        F.min("total").alias("min_total"), F.max("total").alias("max_total"),
    )
