"""Line-first cleaning: rules judge each line, lines that fail are removed, and texts that lose too much go as a whole.

A word is a run of letters that are neither a blank nor \\x09-\\x0D; lines are cut at \\n. A line with a word fails the first of these
rules that fits it (`RULES`, in this order):

- navigation: at least two separators (`SEPARATORS`) and at most eight words for each of them;
- symbols: more than one of `# * $ % & | < >` for every two words;
- shouting: five words or more and capital letters but no small one, or `!!` or `??` three times;
- boilerplate: at most 25 words, and one of the phrases of `BOILERPLATE` in any case;
- punctuation: no sentence mark (`MARKS`) at its end, closing quotes and brackets aside.

Lines without a word always stay. A text is kept if it passes the base rules (at least 50 words; at most half of its words in
three-word windows that occur twice or more in it) and at most half of its words stand in lines that failed.

Null texts have no words, fail, and stay null; empty texts likewise. Equal rows get equal results; empty tables give no
rows. Texts are never cut; memory grows with the longest text (some 40 bytes a word) and else with slices of 3 MB. Other
columns are carried along, whatever their names; those named like the added ones are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayline.llm.common import as_bytes, shelved, slices, with_columns, with_fields

#: Fixed values of the contract.
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS, MOST_REPEATED, WINDOW = 50, 50, 3

#: The method's rules.
RULES = ("navigation", "symbols", "shouting", "boilerplate", "punctuation")
SEPARATORS, WORDS_PER_SEPARATOR = "|»›•·→", 8
MARKS, CLOSERS = ".!?…:;。！？؟।", "\"'”’»)]"
SHOUTED_WORDS, SHOUTED_MARKS = 5, 3
BOILERPLATE_WORDS = 25
BOILERPLATE = (
    "all rights reserved", "licensed under", "released under", "copyright", "©", "cookie", "privacy policy", "terms of use",
    "terms of service", "javascript", "lorem ipsum", "powered by", "skip to content", "alle rechte vorbehalten", "tous droits réservés",
    "todos los derechos reservados")
MOST_LOST = 50

SPACES = " \t\n\x0b\x0c\r"
PHRASE = re.compile("|".join(map(re.escape, BOILERPLATE)), re.IGNORECASE)
BLOCK = 1 << 20
_ADDED = {"_n_words": "long", "_word_chars": "long", "_n_symbols": "long", "_n_dup_lines": "long", "_n_repeat_words": "long",
          "_n_lost_words": "long", "_failed_lines": "map<string,long>"}


def failed_rule(line: str, n_words: int, n_symbols: int) -> str | None:
    """The first rule that a line with a word fails."""
    separators = sum(map(line.count, SEPARATORS))
    if separators >= 2 and n_words <= WORDS_PER_SEPARATOR * separators:
        return "navigation"
    if 2 * n_symbols > n_words:
        return "symbols"
    if n_words >= SHOUTED_WORDS and line.isupper() or line.count("!!") + line.count("??") >= SHOUTED_MARKS:
        return "shouting"
    if n_words <= BOILERPLATE_WORDS and PHRASE.search(line):
        return "boilerplate"
    if not line.rstrip(SPACES).rstrip(CLOSERS).endswith(tuple(MARKS)):
        return "punctuation"
    return None


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        i = self[word] = len(self)
        return i


def word_numbers(data: bytes) -> np.ndarray:
    """Numbers of the words, equal for equal words; read in blocks that end at a space."""
    numbers, parts, at = _Numbers(), [], 0
    while at < len(data):
        end = min(at + BLOCK, len(data))
        if end < len(data):
            cut = max(data.rfind(b" ", at, end), data.rfind(b"\n", at, end))
            end = cut + 1 if cut >= 0 else len(data)
        words = data[at:end].split()
        parts.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.int32)


def repeated_words(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which words stand in a window of three that its document has twice or more."""
    out = np.zeros(len(words), bool)
    if len(words) < WINDOW:
        return out
    size, key = int(words.max()) + 1, words.astype(np.int64)
    pair = key[:-2] * size + key[1:-1]
    if size > 1 << 21:  # three numbers would not fit
        pair = np.unique(pair, return_inverse=True)[1]
    key = pair * size + key[2:]
    key[doc[:-2] != doc[2:]] = -1
    order = np.argsort(key, kind="stable")  # equal windows side by side, in the order of documents
    key, of = key[order], doc[:-2][order]
    same = (key[1:] == key[:-1]) & (of[1:] == of[:-1]) & (key[1:] >= 0)
    twice = np.zeros(len(order), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    for i in range(WINDOW):
        out[i : len(out) - WINDOW + 1 + i] |= twice
    return out


def per_part(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of values from each start to the next; the starts rise strictly."""
    return np.add.reduceat(values, starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)


def judge_texts(texts: list[bytes]) -> tuple[list[str], dict[str, list]]:
    """The cleaned texts, and the values of the added columns."""
    data = b"\n".join(texts) + b"\n"  # so no document and no line is without a letter of its own
    raw = np.frombuffer(data, np.uint8)
    starts = np.zeros(len(texts), np.int64)
    np.cumsum([len(t) + 1 for t in texts[:-1]], out=starts[1:])
    line_starts = np.concatenate([[0], np.flatnonzero(raw == 10)[:-1] + 1])
    space = np.zeros(256, bool)
    space[[32, *range(9, 14)]] = True
    gap, symbol = space[raw], np.isin(raw, np.frombuffer(SYMBOLS, np.uint8))
    begins = ~gap
    begins[1:] &= gap[:-1]
    chars = ~gap & ((raw & 0xC0) != 0x80)
    n_words, line_words, line_symbols = per_part(begins, starts), per_part(begins, line_starts), per_part(symbol, line_starts)
    words, doc = word_numbers(data), np.repeat(np.arange(len(texts)), n_words)
    out = {"_n_words": n_words, "_word_chars": per_part(chars, starts), "_n_symbols": per_part(symbol, starts),
           "_n_repeat_words": np.bincount(doc[repeated_words(words, doc)], minlength=len(texts)),
           "_n_dup_lines": [], "_n_lost_words": [], "_failed_lines": []}
    cleaned, at = [], 0
    counted, marked = line_words.tolist(), line_symbols.tolist()
    for text in texts:
        lines = text.decode().split("\n")
        kept, seen, lost, twice, failed = [], set(), 0, 0, {}
        for line, size, marks in zip(lines, counted[at : at + len(lines)], marked[at : at + len(lines)], strict=True):
            rule = None
            if size:
                twice += line in seen
                seen.add(line)
                rule = failed_rule(line, size, marks)
            if rule:
                failed[rule] = failed.get(rule, 0) + 1
                lost += size
            else:
                kept.append(line)
        at += len(lines)
        cleaned.append("\n".join(kept))
        out["_n_dup_lines"].append(twice)
        out["_n_lost_words"].append(lost)
        out["_failed_lines"].append(list(failed.items()))
    return cleaned, out


def clean_lines(docs: DataFrame) -> DataFrame:
    """All rows and columns of docs (text) with the cleaned text, its counts (of the text as it was), lines removed by rule,
    `_base_failed` and `_kept`."""
    docs, back = shelved(docs, ("text",), (*_ADDED, "_base_failed", "_kept"))
    kinds = {name: pa.map_(pa.string(), pa.int64()) if kind.startswith("map") else pa.int64() for name, kind in _ADDED.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw = as_bytes(batch.column("text"))
            cleaned, out = judge_texts([t or b"" for t in raw])
            text = pa.array([c if t is not None else None for c, t in zip(cleaned, raw, strict=True)], pa.string())
            batch = batch.set_column(batch.schema.get_field_index("text"), "text", text)
            yield with_columns(batch, **{name: pa.array(out[name], kind) for name, kind in kinds.items()})

    done = docs.mapInArrow(run, with_fields(docs, **_ADDED))
    return done.select(*back, *_ADDED, base_failed().alias("_base_failed"), (~base_failed() & (100 * F.col("_n_lost_words") <= MOST_LOST * F.col("_n_words"))).alias("_kept"))


def base_failed() -> Column:
    return (F.col("_n_words") < LEAST_WORDS) | (100 * F.col("_n_repeat_words") > MOST_REPEATED * F.col("_n_words"))
