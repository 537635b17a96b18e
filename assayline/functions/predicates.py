"""Row predicates. Each takes and gives a Column, so Spark can fuse any number of them in one scan."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayline.functions.text import let, lower_tr
from assayline.vocabulary import PLACEHOLDERS, SHORT_TEXT


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_blank(c: Column | str) -> Column:
    """NULL, empty or spaces only (a tab is content)."""
    c = as_col(c)
    return c.isNull() | (F.length(F.trim(c)) == 0)


def is_null(c: Column | str) -> Column:
    return as_col(c).isNull()


def wrong_constant(c: Column | str, value: str) -> Column:
    """Differs from the constant. NULL stays NULL, so `count_if` leaves it out."""
    return as_col(c) != F.lit(value)


def length_mismatch(stored: Column | str, text: Column | str) -> Column:
    return as_col(stored) != F.length(as_col(text))


def shorter_than(text: Column | str, limit: int) -> Column:
    return F.length(as_col(text)) < limit


def contains_any(lowered: Column, words: Iterable[str]) -> Column:
    return reduce(or_, [lowered.contains(w) for w in words])


def has_placeholder(text: Column | str, words: Iterable[str] = tuple(PLACEHOLDERS.values())) -> Column:
    return let(lower_tr(as_col(text)), lambda low: contains_any(low, words))


def has_marker(text: Column | str, words: Iterable[str]) -> Column:
    return let(lower_tr(as_col(text)), lambda low: contains_any(low, words))


def suspicious_label(c: Column | str) -> Column:
    c = as_col(c)
    return (c == "-") | (F.length(F.trim(c)) <= 1)


def suspicious_row(text: Column, lowered: Column, label: Column, limit: int = SHORT_TEXT) -> Column:
    """Short text, known placeholder, or a dash for a label (no length test on the label)."""
    return (F.length(text) < limit) | contains_any(lowered, PLACEHOLDERS.values()) | (label == "-")


def in_years(c: Column | str, years: tuple[int, int]) -> Column:
    return as_col(c).between(*years)


def not_castable(c: Column | str, type_name: str = "bigint") -> Column:
    return as_col(c).try_cast(type_name).isNull()


def is_masked(c: Column | str) -> Column:
    return F.coalesce(as_col(c), F.lit(0)) > 0


def all_not_null(*cols: Column | str) -> Column:
    return reduce(lambda a, b: a & b, [as_col(c).isNotNull() for c in cols])


def changed(before: Column | str, after: Column | str) -> Column:
    return as_col(before) != as_col(after)


def phrase_words(phrase: str) -> list[str]:
    """A phrase is one word or words joined by OR."""
    return [w.strip().lower() for w in phrase.split(" OR ")]


def matches_phrase(text: Column | str, phrase: str) -> Column:
    return let(lower_tr(as_col(text)), lambda low: contains_any(low, phrase_words(phrase)))


def project_present(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    return df.select(*[c for c in cols if c in df.columns])
