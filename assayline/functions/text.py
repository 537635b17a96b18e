"""Text functions made of built-in expressions."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from assayline.vocabulary import KEY_PATTERN, NAME_CHARS, NORMAL_CHARS, WINDOW_CHARS, WINDOW_OVERLAP


def lower_tr(c: Column) -> Column:
    """Lower case with dotted capital I as one letter (plain `lower` gives two code points)."""
    return F.lower(F.replace(c, F.lit("İ"), F.lit("i")))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with the value worked out once per row, wherever the optimizer moves the expression."""
    return F.transform(F.array(value), body)[0]


@lru_cache(maxsize=1)
def _folds() -> tuple[tuple[str, str], ...]:
    """(letter, fold) for each letter whose full case fold keeps a normal letter that lower-casing would lose.

    Rule instead of a table: compare Python's case fold with `lower` over the basic plane.
    """
    kept = set("0123456789abcdefghijklmnopqrstuvwxyzçğıöşü")

    def visible(s: str) -> str:
        return "".join(ch for ch in s if ch in kept)

    pairs = []
    for cp in range(0x80, 0x10000):
        ch = chr(cp)
        folded = visible(ch.casefold())
        if folded and folded != visible(ch.lower()):
            pairs.append((ch, folded))
    return tuple(pairs)


def fold_case(c: Column) -> Column:
    """Full case folding, as far as characters of the normal form are concerned."""
    return lower_tr(reduce(lambda acc, p: F.replace(acc, F.lit(p[0]), F.lit(p[1])), _folds(), c))


# White space of Unicode and the four separator controls.
_SPACES = r"\t-\r\u001c- \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def squeeze(c: Column) -> Column:
    """Runs of white space become one space."""
    return F.regexp_replace(c, f"[{_SPACES}]+", " ")


@lru_cache(maxsize=None)
def _others(kept: str) -> str:
    """The class of all characters outside `kept`, as plain ranges: the engine runs these faster than a negation."""
    ends = re.findall(r"(.)-(.)|(.)", kept)
    members = {c for a, b, one in ends for c in (range(ord(a), ord(b) + 1) if a else [ord(one)])}
    bounds = [-1, *sorted(members), 0x110000]
    gaps = [(a + 1, b - 1) for a, b in zip(bounds, bounds[1:]) if b - a > 1]
    return "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in gaps) + "]"


def normalize_text(c: Column) -> Column:
    """Comparison form: folded case, single spaces, only digits, letters and light punctuation."""
    return F.trim(F.regexp_replace(squeeze(fold_case(c)), f"{_others(NORMAL_CHARS)}+", ""))


def canonical_name(c: Column) -> Column:
    """Court name reduced to words: anything that is no letter or digit is one space."""
    return F.regexp_replace(lower_tr(F.trim(c)), f"{_others(NAME_CHARS)}+", " ")


def exact_name(c: Column) -> Column:
    return lower_tr(F.trim(c))


def key_year(c: Column) -> Column:
    return F.regexp_extract(c, KEY_PATTERN, 1).try_cast("int")


def key_number(c: Column) -> Column:
    return F.regexp_extract(c, KEY_PATTERN, 2).try_cast("bigint")


def contains_norm(needle: Column, haystack: Column, non_empty: bool = False) -> Column:
    """Whether one normal form holds the other; both arguments are normal forms already."""
    found = F.contains(haystack, needle)
    return (F.length(needle) > 0) & found if non_empty else found


def length_ratio(a: Column, b: Column) -> Column:
    """Shorter over longer length, 1.0 for two empty texts, 6 digits."""
    la, lb = F.length(a), F.length(b)
    longest = F.greatest(la, lb)
    return F.when(longest == 0, F.lit(1.0)).otherwise(F.bround(F.least(la, lb) / longest, 6))


def stable_hash(c: Column) -> Column:
    """Order key of samples: the same on every engine and partitioning."""
    return F.md5(c.cast("string"))


def text_windows(c: Column, size: int = WINDOW_CHARS, overlap: int = WINDOW_OVERLAP) -> Column:
    """Array of windows that cover the whole text; each but the last shares its end with the next. Blank ones are left out.

    The text is cut in steps by one pattern, so the work grows with its length; a window is a step and the start of the next.
    """
    step = size - overlap
    text = F.coalesce(c, F.lit(""))

    def joined(steps: Column) -> Column:
        # A last step that the window before holds already is no window of its own.
        held = (F.size(steps) > 1) & (F.length(F.try_element_at(steps, F.lit(-1))) <= overlap)
        following = F.concat(F.slice(steps, F.lit(2), F.size(steps)), F.array(F.lit("")))
        windows = F.zip_with(steps, following, lambda a, b: F.concat(a, F.substring(b, 1, overlap)))
        return F.slice(windows, F.lit(1), F.size(steps) - F.when(held, 1).otherwise(0))

    cut = let(F.regexp_extract_all(text, F.lit(f"(?s)(.{{1,{step}}})"), F.lit(1)), joined)
    return F.filter(cut, lambda w: F.length(F.trim(squeeze(w))) > 0)


def pilot_windows(c: Column, size: int = WINDOW_CHARS) -> Column:
    """The two-piece form of a pilot: the text itself, or its start and a piece around the middle, the rest unread."""
    text = F.coalesce(c, F.lit(""))
    middle = F.greatest(F.lit(0), F.floor(F.length(text) / 2) - size // 2).cast("int") + 1
    cut = F.when(F.length(text) <= size, F.array(text)).otherwise(
        F.array(F.substring(text, F.lit(1), F.lit(size)), F.substring(text, middle, F.lit(size)))
    )
    return F.filter(cut, lambda w: F.length(F.trim(squeeze(w))) > 0)


def preview(c: Column, size: int = 500) -> Column:
    return F.substring(F.trim(squeeze(c)), 1, size)


def rate(part: Column, whole: Column) -> Column:
    """part / whole, 0 for an empty whole."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, NULL for an empty whole."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def court_group(c: Column) -> Column:
    low = lower_tr(c)
    return F.when(low.contains("ceza"), "ceza").when(low.contains("hukuk"), "hukuk").otherwise("other")
