"""Language ID of code-switched text by a linear-chain conditional random field.

A line is a chain of words. A word's features are the character n-grams of "^word$" (with the marks they are its affixes)
and its entry in the lexicon, if it has one; their learned weights, summed, say how well each language fits. Learned
transitions say how readily the language changes from a word to the next. Forward-backward gives every word its posterior
over languages; a text's language is the one with the largest sum, and its score is that sum per word.

The model is fitted on the driver to a bounded sample of labelled rows of all languages: `PER_LANGUAGE` distinct texts of
each, chosen by hash, and of a text over `SAMPLE_CHARS` a stretch of that length, also chosen by hash. With more than
`LANGUAGES` languages the rows of each and the stretches get shorter, so that the sample's size stays; every language keeps
one text at least. Texts without a letter teach nothing and are not counted. Lines of different languages are put side by
side, as the labels are per document and the chain has to learn changes. Prediction reads whole texts of all rows.

A text that is null or has no letter is "und" with score 0; so is every text if no row is labelled. Ties go to the first
language in order. Repeated rows get the same result. A line of any length is one chain. Other columns are carried along,
whatever their names; those named `_lang_pred` or `_score` are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from assayline.llm.common import WORDS_KEPT, bounds, flat, give_back, mix, shelved, slices, with_columns, with_fields

UNKNOWN = "und"
PER_LANGUAGE = 120
LANGUAGES = 64
SAMPLE_CHARS = 20_000
LEXICON = 20_000
#: Text bytes that a task judges at once, with four languages or fewer.
JUDGED_BYTES = 2 << 20
GRAMS = (1, 2, 3, 4)
BUCKETS = 1 << 16
STEPS = 45
RATE = 0.15
PENALTY = 1e-4
SWITCH = 0.3
#: Letters in a row are a word; a line feed ends the chain.
WORD = re.compile(r"[^\W\d_]+|\n")
#: A letter, in the patterns of Spark.
LETTER = r"\p{L}"


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # (BUCKETS + lexicon + 1, languages); the last row, for words without entry, is 0
    lexicon: np.ndarray  # sorted hashes of words
    start: np.ndarray
    change: np.ndarray  # exponentials, (from, to)


def word_features(words: list[str], lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the weights that belong to each word, one word after the other, and where each word's begin."""
    marked = "".join(f"^{w}$" for w in words)
    points = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(points))  # letters up to the word's end
    owner = np.repeat(np.arange(len(words)), lengths)
    rows, owners, h = [], [], np.zeros(len(points), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        at = len(points) - n + 1
        h = h[: max(at, 0)] * np.uint64(0x100000001B3) + points[n - 1 :] + np.uint64(n)
        if n in GRAMS:
            ok = left[: len(h)] >= n
            rows.append((mix(h[ok]) % np.uint64(BUCKETS)).astype(np.int64))
            owners.append(owner[: len(h)][ok])
    names = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    at = np.searchsorted(lexicon, names)
    found = lexicon[np.minimum(at, len(lexicon) - 1)] == names if len(lexicon) else np.zeros(len(names), bool)
    rows.append(BUCKETS + np.where(found, at, len(lexicon)))
    owners.append(np.arange(len(words)))
    order = np.argsort(np.concatenate(owners), kind="stable")
    counts = np.bincount(np.concatenate(owners), minlength=len(words))
    return np.concatenate(rows)[order], np.concatenate([[0], np.cumsum(counts)])


def word_scores(weights: np.ndarray, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Exponential of the summed weights of each word, the best language's being 1."""
    total = np.add.reduceat(weights[rows], starts[:-1], axis=0)
    return np.exp(total - total.max(axis=1, keepdims=True))


def forward_backward(fits: np.ndarray, starts: np.ndarray, begin: np.ndarray, change: np.ndarray, learn: bool = False):
    """Posteriors of all words of chains that stand one after the other; with learn also expected changes and log Z."""
    lengths = np.diff(starts)
    order = np.argsort(-lengths, kind="stable")
    first, lengths = starts[:-1][order], lengths[order]
    longest = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(longest), side="left")
    alpha, beta, scale = np.empty_like(fits), np.empty_like(fits), np.ones(len(fits))
    for t in range(longest):
        at = first[: active[t]] + t
        a = (begin if t == 0 else alpha[at - 1] @ change) * fits[at]
        scale[at] = s = a.sum(axis=1)
        alpha[at] = a / s[:, None]
    for t in range(longest - 1, -1, -1):
        at = first[: active[t]] + t
        beta[at] = 1.0
        if t + 1 < longest:
            on = first[: active[t + 1]] + t
            beta[on] = ((fits[on + 1] * beta[on + 1]) @ change.T) / scale[on + 1][:, None]
    if not learn:
        alpha *= beta
        alpha /= alpha.sum(axis=1, keepdims=True)
        return alpha
    post = alpha * beta
    post /= post.sum(axis=1, keepdims=True)
    inner = np.ones(len(fits), bool)
    inner[starts[:-1]] = False
    at = np.flatnonzero(inner)
    pairs = (alpha[at - 1].T @ (fits[at] * beta[at] / scale[at][:, None])) * change
    return post, pairs, float(np.log(scale).sum())


def fit(rows: list[tuple[str, str]], languages: list[str]) -> Model:
    """rows: (language, text). Adam on the likelihood, all chains at once."""
    rng = np.random.default_rng(7)
    number = {x: i for i, x in enumerate(languages)}
    chains = [(number[lang], ws) for lang, text in rows for line in text.lower().split("\n") if (ws := [w for w in WORD.findall(line)])]
    chains = [chains[i] for i in rng.permutation(len(chains))]
    joined: list[list[tuple[int, list[str]]]] = []
    for c in chains:
        if joined and rng.random() < SWITCH:
            joined[-1].append(c)
        else:
            joined.append([c])
    words = [w for j in joined for _, ws in j for w in ws]
    label = np.array([lang for j in joined for lang, ws in j for _ in ws], np.int64)
    starts = np.concatenate([[0], np.cumsum([sum(len(ws) for _, ws in j) for j in joined])]).astype(np.int64)
    names, index, counts = np.unique(np.array(words, dtype=object).astype(str), return_inverse=True, return_counts=True)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in names.tolist()), np.uint64, len(names))
    often = np.lexsort((hashes, -counts))[:LEXICON]
    lexicon = np.sort(hashes[often[counts[often] > 1]])
    feats, at = word_features(names.tolist(), lexicon)
    n, size = len(languages), BUCKETS + len(lexicon) + 1
    owner = np.repeat(np.arange(len(names)), np.diff(at))
    seen = np.zeros((len(names), n))
    np.add.at(seen, (index, label), 1.0)
    inner = np.ones(len(label), bool)
    inner[starts[:-1]] = False
    pair_at = np.flatnonzero(inner)
    seen_pairs, seen_first = np.zeros((n, n)), np.bincount(label[starts[:-1]], minlength=n).astype(float)
    np.add.at(seen_pairs, (label[pair_at - 1], label[pair_at]), 1.0)
    params = [np.zeros((size, n)), np.zeros((n, n)), np.zeros(n)]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    for step in range(1, STEPS + 1):
        fits = word_scores(params[0], feats, at)[index]
        change, begin = np.exp(params[1] - params[1].max()), np.exp(params[2] - params[2].max())
        post, pairs, _ = forward_backward(fits, starts, begin, change, learn=True)
        want = np.stack([np.bincount(index, post[:, k], len(names)) for k in range(n)], axis=1)
        miss = (seen - want)[owner]
        up = np.stack([np.bincount(feats, miss[:, k], size) for k in range(n)], axis=1)
        first = post[starts[:-1]].sum(axis=0)
        for p, m, g in zip(params, moments, (up / len(label), (seen_pairs - pairs) / len(label), (seen_first - first) / len(label)), strict=True):
            g = g - PENALTY * p / len(p)
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.99 * m[1] + 0.01 * g * g
            p += RATE * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-9)
        params[0][-1] = 0
    return Model(languages, params[0].astype(np.float32), lexicon, np.exp(params[2] - params[2].max()), np.exp(params[1] - params[1].max()))


class WordFits(dict):
    """Number of a word; new words wait until `settle` scores them together. Number 0 is the line feed."""

    def __init__(self, model: Model):
        super().__init__({"\n": 0})
        self.model, self.waiting = model, []
        self.fits = np.ones((1, len(model.languages)))
        self.letters = np.zeros(1, bool)

    def __missing__(self, word: str) -> int:
        i = self[word] = len(self)
        self.waiting.append(word)
        return i

    def settle(self) -> None:
        if self.waiting:
            rows, starts = word_features(self.waiting, self.model.lexicon)
            self.fits = np.concatenate([self.fits, word_scores(self.model.weights, rows, starts)])
            self.letters = np.concatenate([self.letters, [any(map(str.isalpha, w)) for w in self.waiting]])
            self.waiting = []

    def trim(self) -> None:
        if len(self) > WORDS_KEPT // 4:
            self.clear()
            self["\n"] = 0
            self.fits, self.letters = self.fits[:1], self.letters[:1]


def predict_texts(texts: list[str | None], table: WordFits) -> tuple[list[str], np.ndarray]:
    if not table.model.languages:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    found = [WORD.findall(t.lower()) if t else [] for t in texts]
    ends = bounds(found)
    index = np.fromiter(map(table.__getitem__, flat(found)), np.int64, ends[-1])
    del found
    table.settle()
    doc = np.repeat(np.arange(len(texts)), np.diff(ends))
    is_word = table.letters[index]
    doc, index, line = doc[is_word], index[is_word], np.cumsum(~is_word & (index == 0))[is_word]
    n = len(table.model.languages)
    sums, count = np.zeros((len(texts), n)), np.bincount(doc, minlength=len(texts))
    if len(index):
        cut = np.flatnonzero((np.diff(doc) != 0) | (np.diff(line) != 0)) + 1
        post = forward_backward(table.fits[index], np.concatenate([[0], cut, [len(index)]]), table.model.start, table.model.change)
        sums = np.stack([np.bincount(doc, post[:, k], len(texts)) for k in range(n)], axis=1)
    table.trim()
    best = sums.argmax(axis=1)
    score = np.clip(sums[np.arange(len(texts)), best] / np.maximum(count, 1), 0, 1)
    return [table.model.languages[b] if c else UNKNOWN for b, c in zip(best.tolist(), count.tolist(), strict=True)], score


def stretch(text: Column, chars: int) -> Column:
    """`chars` letters of a longer text from a place chosen by hash, or from its first letter if that part has none."""
    at = F.pmod(F.xxhash64(F.lit("stretch"), text), F.greatest(F.length(text) - chars, F.lit(0)) + 1).cast("int") + 1
    part = F.substring(text, at, F.lit(chars))
    return F.when(F.length(text) <= chars, text).when(part.rlike(LETTER), part).otherwise(
        F.substring(F.regexp_replace(text, r"^\P{L}+", ""), F.lit(1), F.lit(chars)))


def learn(rows: DataFrame) -> Model:
    """rows (text, lang): those that may be learned from. What reaches the driver is bounded by the sample's limits."""
    good = shelved(rows, ("lang", "text"))[0].where(F.col("lang").isNotNull() & F.col("text").rlike(LETTER))
    place = F.xxhash64(F.lit("sample"), "text")
    counts = good.select("lang", place.alias("place")).distinct().groupBy("lang").count().collect()
    none = Model([], np.zeros((1, 0), np.float32), np.zeros(0, np.uint64), np.zeros(0), np.zeros((0, 0)))
    if not counts:
        return none
    crowd = max(1.0, len(counts) / LANGUAGES)
    most, chars = max(1, int(PER_LANGUAGE / crowd)), max(1, int(SAMPLE_CHARS / crowd))
    share = F.create_map(*[x for lang, n in counts for x in (F.lit(lang), F.lit(min(1.0, 4 * PER_LANGUAGE / n)))])
    few = good.where(F.pmod(place, F.lit(1_000_003)) / 1_000_003.0 <= share[F.col("lang")])
    few = few.select("lang", "text").distinct()
    ranked = few.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(place, "text"))).where(F.col("r") <= most)
    sample = sorted((x.lang, x.text) for x in ranked.select("lang", stretch(F.col("text"), chars).alias("text")).collect())
    sample = [(lang, text) for lang, text in sample if any(map(str.isalpha, text.lower()))]
    return fit(sample, sorted({lang for lang, _ in sample})) if sample else none


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """All rows and columns of `docs` with `_lang_pred string` and `_score double`, which depend on the text alone."""
    docs, back = shelved(docs, ("text",), ("_lang_pred", "_score"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    limit = JUDGED_BYTES * 4 // max(4, len(model.languages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordFits(sent.value)
        for batch in slices(batches, limit=limit):
            lang, score = predict_texts(batch.column("text").to_pylist(), table)
            yield with_columns(batch, _lang_pred=pa.array(lang, pa.string()), _score=pa.array(score))
        table.clear()
        give_back()

    return docs.mapInArrow(run, with_fields(docs, _lang_pred="string", _score="double")).select(*back, "_lang_pred", "_score")
