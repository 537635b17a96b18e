"""Regular expressions with the meaning they have in an RE2 engine, on Spark's Java engine.

The two engines fold case and find word edges differently. `portable` spells both out: each letter becomes the class
of its case variants, so no flag is left, and a word edge becomes a pair of look-arounds.

* mode ``re2``: Unicode simple case folding, ASCII word edges: the result of the published patterns.
* mode ``turkish``: dotted and dotless i also meet their capitals, word edges see all letters.
"""

from __future__ import annotations

from collections import defaultdict
from functools import lru_cache, reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from assayline.functions.text import let, lower_tr
from assayline.vocabulary import CONTEXT_PATTERNS, CORES, DIGIT_RUN, DIRECT_PATTERNS, GUARDED_PATTERNS, NEEDLES

_WORD = {"re2": "0-9A-Za-z_", "turkish": r"\p{L}\p{N}_"}
_ESCAPES = {"s": r"\t\n\f\r ", "d": "0-9", "w": "0-9A-Za-z_"}
_TURKISH_I = {"i": "iIİ", "İ": "iIİ", "ı": "ıI", "I": "ıiIİ"}


def _simple_fold(ch: str) -> str:
    for folded in (ch.casefold(), ch.lower()):
        if len(folded) == 1:
            return folded
    return ch


@lru_cache(maxsize=1)
def _orbits() -> dict[str, str]:
    groups: dict[str, list[str]] = defaultdict(list)
    for cp in range(0x10000):
        if not 0xD800 <= cp < 0xE000:
            groups[_simple_fold(chr(cp))].append(chr(cp))
    return {ch: "".join(g) for g in groups.values() if len(g) > 1 for ch in g}


def _variants(ch: str, mode: str) -> str:
    if mode == "turkish" and ch in _TURKISH_I:
        return _TURKISH_I[ch]
    return _orbits().get(ch, ch)


def _fold_class(body: str, mode: str) -> str:
    """Case variants of all members of a class body, added to it. Ranges stay ranges."""
    extra: set[str] = set()
    i = 0
    while i < len(body):
        if body[i] == "\\":
            i += 2
        elif i + 2 < len(body) and body[i + 1] == "-":
            members = [chr(c) for c in range(ord(body[i]), ord(body[i + 2]) + 1)]
            extra.update(v for m in members for v in _variants(m, mode) if v not in members)
            i += 3
        else:
            extra.update(v for v in _variants(body[i], mode) if v != body[i])
            i += 1
    return body + "".join(sorted(extra)) if not body.endswith("-") else "".join(sorted(extra)) + body


def portable(pattern: str, mode: str = "re2") -> str:
    """Java form of an RE2 pattern; a leading ``(?i)`` is the only flag it may hold."""
    fold = pattern.startswith("(?i)")
    rest = pattern[4:] if fold else pattern
    word = _WORD[mode]
    edge = f"(?:(?<![{word}])(?=[{word}])|(?<=[{word}])(?![{word}]))"
    out, i = [], 0
    while i < len(rest):
        ch = rest[i]
        if ch == "\\":
            nxt = rest[i + 1]
            out.append(edge if nxt == "b" else f"[{_ESCAPES[nxt]}]" if nxt in _ESCAPES else ch + nxt)
            i += 2
        elif ch == "[":
            end = rest.index("]", i + 2)
            body = rest[i + 1:end]
            sign = "^" if body.startswith("^") else ""
            body = body[len(sign):]
            out.append(f"[{sign}{_fold_class(body, mode) if fold else body}]")
            i = end + 1
        elif ch == "{" or rest.startswith("(?", i):
            end = i + 1
            while ch == "{" and rest[end - 1] != "}":
                end += 1
            while ch == "(" and rest[end] in "?:=!<":
                end += 1
            out.append(rest[i:end])
            i = end
        else:
            variants = _variants(ch, mode) if fold and ch.isalpha() else ch
            out.append(r"\z" if ch == "$" else f"[{variants}]" if len(variants) > 1 else ch)
            i += 1
    return "".join(out)


def matches(text: Column, pattern: str, mode: str = "re2") -> Column:
    """Unanchored search."""
    return F.rlike(text, F.lit(portable(pattern, mode)))


def _may_match(text: Column, label: str, mode: str = "re2") -> Column:
    """Whether the text holds what every match of that identifier holds, guarded or not: a cheap test."""
    if label in NEEDLES:
        return text.contains(NEEDLES[label])
    return matches(text, CORES[label], mode) if label in CORES else F.rlike(text, F.lit(DIGIT_RUN))


def direct_flags(text: Column, mode: str = "re2") -> dict[str, Column]:
    """Label -> whether the text shows that direct identifier.

    Every match holds a literal or a run of digits and separators; that cheap test comes first and is shared. A match
    with eaten neighbours exists where one with guards exists, so the lighter guarded form is searched.
    """
    digits = F.rlike(text, F.lit(DIGIT_RUN))
    return {
        label: (text.contains(NEEDLES[label]) if label in NEEDLES else digits)
        & matches(text, GUARDED_PATTERNS.get(label, p), mode)
        for label, _, p in DIRECT_PATTERNS
    }


def mask_pii(text: Column, mode: str = "re2", guarded: bool = False) -> Column:
    """Direct identifiers replaced by ``[LABEL]`` in fixed order, so a later pattern sees earlier labels.

    The published patterns for IBAN and TELEFON eat one neighbour on each side; `guarded` leaves neighbours alone. A
    text that shows no sign of an identifier is not rewritten in its step.
    """
    steps = [(label, GUARDED_PATTERNS.get(label, p) if guarded else p) for label, _, p in DIRECT_PATTERNS]

    def masked(acc: Column, label: str, pattern: str) -> Column:
        return let(acc, lambda t: F.when(
            _may_match(t, label, mode), F.regexp_replace(t, F.lit(portable(pattern, mode)), F.lit(f"[{label}]"))).otherwise(t))

    return reduce(lambda acc, step: masked(acc, *step), steps, text)


def needle_form(text: Column, mode: str = "re2") -> Column:
    """The text as word lists are tried on it: lower case, long s as s; Turkish mode makes all kinds of i one."""
    low = F.lower(F.replace(text, F.lit("ſ"), F.lit("s")))
    if mode == "turkish":
        low = F.replace(lower_tr(F.replace(text, F.lit("ſ"), F.lit("s"))), F.lit("ı"), F.lit("i"))
    return low


def needles_of(pattern: str, mode: str = "re2") -> list[str]:
    """Literals of which every match holds one: the plain heads of the first group's alternatives."""
    group = pattern[pattern.index("(", 4) + 1:pattern.index(")", 4)]
    heads = [w.replace("\\", "").split("[")[0] for w in group.split("|")]
    return [h.replace("ı", "i") for h in heads] if mode == "turkish" else heads


def context_flags(text: Column, low: Column, mode: str = "re2") -> dict[str, Column]:
    """Signal -> whether the text shows it. `low` is the text's `needle_form`; the pattern runs where a word is in it."""
    return {
        name: reduce(or_, [low.contains(w) for w in needles_of(p, mode)]) & matches(text, p, mode)
        for name, p in CONTEXT_PATTERNS.items()
    }
