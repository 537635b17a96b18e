"""Phrase collocations per language, counted losslessly with counting quotient filters (`quotient`).

Text is lower-cased in A-Z, cut into pieces at `. , ; : ! ?` and line ends, and pieces into words at blanks and tabs; a phrase is
a run of words of one piece. A first pass counts words. Only words with `least` occurrences can stand in a candidate; they
get numbers for the whole corpus (a word of two languages gets two, so a number also names its language), and a bitmap
of at most `MOST_BITS` bits, which passes all of them and few others, goes to the tasks of the second pass. There each task
numbers the words that pass it within a chunk of texts, packs the numbers of every phrase into one whole number, and counts
these in filters of its own. The corpus's numbers travel to the chunks by a join on the chunk, which is as large as the
chunk's own vocabulary. A chunk's filters are then packed anew with these numbers - what the bitmap let through by
mistake ends here - and cut into ranges of quotients. Ranges of all chunks are merged, one by one, and what is frequent is
unpacked. Texts are never shuffled; a very frequent phrase is one counter per chunk; no dictionary is broadcast or
collected. Memory of a task is bounded by a chunk, or by a range of the quotients, of which there are twice as many as
shuffle partitions.

Candidates are phrases of 2 to `longest` words with at least `least` occurrences a. A cut after the first k words has
l = occurrences of the first part, r = of the rest, and score floor(1000000 * a * a / (l * r)) (in decimals of 38 digits); the
lowest-scoring cut counts, of equal ones the first. A candidate goes if its words lie side by side inside a longer
candidate with 100 * occurrences >= share * a. Of each language the first `top` stay.

Null texts are empty, null languages are `und`, together with the language of that name. Repeated rows count each time. Empty
tables, or texts without a frequent phrase, give no rows. A text of any length is read in blocks, a piece may span
blocks. Columns other than the two named are not read, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayline.llm import quotient
from assayline.llm.common import as_bytes, give_back, rows_per_batch, shelved, shuffle_parts, slices
from assayline.llm.quotient import Counts, Pile, U
from assayline.session import discard, settle

LEAST, LONGEST, SHARE, TOP = 10, 3, 50, 2000
NO_LANGUAGE = "und"
#: Bits of a word's number in its chunk, and what closes a chunk: words in its dictionary, or words read.
LOCAL_BITS = 19
CHUNK_VOCABULARY, CHUNK_WORDS = 1 << 18, 3 << 18
#: Bytes of text read at once, keys that wait before they are counted, and the first bits by which a chunk's filter is cut.
BLOCK, WAITING, CUT = 1 << 19, 1 << 18, 3
#: A range is merged in 2^PILED parts.
PILED = 4
#: Texts and filters that are sent to Python at once.
TEXTS, FILTERS = 1000, 16
#: Size of the bitmap of frequent words.
BITS_PER_WORD, MOST_BITS = 16, 1 << 26
#: Ranges of quotients for each shuffle partition, and parts in which a language's phrases are ranked first.
RANGES, RANKED_IN = 2, 16

#: 0xFF is in no UTF-8 text: it stands for the end of a piece.
END = b"\xff"
_MARKS = bytes.maketrans(b"\t.,;:!?\n\x0b\x0c\r", b" " + END * 10)
_GAP = b" \t.,;:!?\n\x0b\x0c\r"
_COUNTED = "chunk long, n int, part int, lid int, lang string, word string, grams binary"
_SCHEMA = pa.schema([("chunk", pa.int64()), ("n", pa.int32()), ("part", pa.int32()), ("lid", pa.int32()), ("lang", pa.string()), ("word", pa.string()), ("grams", pa.binary())])


def words_of(data: bytes) -> list[bytes]:
    """The words of lower-cased text, with END between pieces."""
    return data.lower().translate(_MARKS).replace(END, b" \xff ").split()


def blocks(text: bytes) -> Iterator[bytes]:
    """A long text in parts that end where a word ends; a longer word is not cut."""
    at = 0
    while len(text) - at > BLOCK:
        end = max(text.rfind(c, at, at + BLOCK) for c in map(bytes, zip(_GAP, strict=True)))
        if end < 0:
            found = [i for c in map(bytes, zip(_GAP, strict=True)) if (i := text.find(c, at + BLOCK)) >= 0]
            end = min(found, default=len(text) - 1)
        yield text[at : end + 1]
        at = end + 1
    yield text[at:]


def texts_by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes], bool]]:
    """(language, words, whether the block goes on where the last one ended) of the rows of (lang, text)."""
    for batch in slices(batches, limit=BLOCK):
        by_lang: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), as_bytes(batch.column("text")), strict=True):
            if text:
                by_lang.setdefault(lang, []).append(text)
        for lang, texts in by_lang.items():
            for i, part in enumerate(blocks(texts[0] if len(texts) == 1 else END.join(texts))):
                yield lang, words_of(part), i > 0


def word_counts(docs: DataFrame, least: int) -> DataFrame:
    """docs (lang, text): (lang, word, f) of the words with f >= least, and of all words together, with a null word."""

    def rows(counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, found in counts.items():
            total = sum(found.values())
            words, f = [None, *found], [total, *found.values()]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(f), pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(f, pa.int64())], names=["lang", "word", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for lang, words, _ in texts_by_language(batches):
            of = counts.setdefault(lang, Counter())
            of.update(words)
            del of[END]
            if sum(map(len, counts.values())) > CHUNK_VOCABULARY:
                yield from rows(counts)
                counts = {}
        yield from rows(counts)
        counts.clear()
        give_back()

    counted = docs.mapInArrow(run, "lang string, word string, f long")
    return counted.groupBy("lang", "word").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | F.col("word").isNull())


def bitmap(words: DataFrame, size: int) -> np.ndarray:
    """The bitmap of words (lang, word), as 64-bit numbers; its length follows their number `size` up to MOST_BITS."""
    length = min(MOST_BITS, max(64, 1 << (size * BITS_PER_WORD - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tags = [tag_of(lang) for lang in batch.column("lang").to_pylist()]
            at = np.array([place_of(tag, w) & (length - 1) for tag, w in zip(tags, as_bytes(batch.column("word")), strict=True)], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.int64(1) << (at & 63))], names=["at", "bits"])

    out = np.zeros(length >> 6, np.int64)
    for row in words.select("lang", "word").mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).collect():
        out[row.at] = row.bits
    return out


def tag_of(lang: str) -> bytes:
    return lang.encode() + END


def place_of(tag: bytes, word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(tag + word)


class _Words(dict):
    """Numbers of one language's words in a chunk, from 1; 0 is the end of a piece, and a word outside the bitmap."""

    def __init__(self, chunk: Chunk, lang: str) -> None:
        self.chunk, self.lang, self.tag = chunk, lang, tag_of(lang)
        self[END] = 0

    def __missing__(self, word: bytes) -> int:
        often, i = self.chunk.often, 0
        at = place_of(self.tag, word) & ((len(often) << 6) - 1)
        if int(often[at >> 6]) >> (at & 63) & 1:
            self.chunk.names.append(word)
            self.chunk.langs.append(self.lang)
            i = len(self.chunk.names)
        self[word] = i
        return i


class Chunk:
    def __init__(self, number: int, longest: int, often: np.ndarray) -> None:
        self.number, self.longest, self.often, self.read = number, longest, often, 0
        self.names: list[bytes] = []
        self.langs: list[str] = []
        self.tables: dict[str, _Words] = {}
        self.waiting: dict[int, list[np.ndarray]] = {n: [] for n in range(2, longest + 1)}
        self.counts: dict[int, Counts | None] = dict.fromkeys(self.waiting)

    def full(self) -> bool:
        return self.read >= CHUNK_WORDS or sum(map(len, self.tables.values())) >= CHUNK_VOCABULARY

    def add(self, lang: str, words: list[bytes], before: list[bytes]) -> None:
        """Counts the phrases that end in `words`; `before` are the words in front, counted earlier."""
        table = self.tables.get(lang)
        if table is None:
            table = self.tables[lang] = _Words(self, lang)
        ids = np.fromiter(map(table.__getitem__, before + words), np.int32, len(before) + len(words))
        self.read += len(words)
        for n in self.waiting:
            first = max(len(before) - n + 1, 0)
            runs = [ids[first + i : max(len(ids) - n + 1 + i, 0)] for i in range(n)]
            whole = np.logical_and.reduce([r[: len(runs[-1])] > 0 for r in runs])
            self.waiting[n].append(np.stack([r[: len(runs[-1])][whole] for r in runs]))
        if sum(x.shape[1] for x in self.waiting[2]) >= WAITING:
            self.count()

    def count(self) -> None:
        for n, runs in self.waiting.items():
            ids = list(np.concatenate(runs, axis=1)) if runs else [np.zeros(0, np.int32)] * n
            left, right = quotient.permute(*quotient.packed(ids, LOCAL_BITS), LOCAL_BITS * n)
            new = Counts.of_each(left, right, *quotient.halves(LOCAL_BITS * n))
            old = self.counts[n]
            self.counts[n] = new if old is None else Counts.merged([old, new])
            self.waiting[n] = []

    def rows(self) -> Iterator[pa.RecordBatch]:
        """Its dictionary (n = 1: lid, lang, word), and its filters in parts (n > 1: part, grams)."""
        self.count()
        size = len(self.names)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(size, self.number)), pa.array(np.ones(size, np.int32)), pa.nulls(size, pa.int32()), pa.array(np.arange(1, size + 1, dtype=np.int32)),
            pa.array(self.langs, pa.string()), pa.array(self.names, pa.binary()).cast(pa.string()), pa.nulls(size, pa.binary())], schema=_SCHEMA)
        for n, counts in self.counts.items():
            for part, few in counts.ranges(CUT) if counts is not None and len(counts) else ():
                yield pa.RecordBatch.from_arrays([
                    pa.array([self.number]), pa.array([n], pa.int32()), pa.array([part], pa.int32()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.string()), pa.nulls(1, pa.string()),
                    pa.array([few.to_bytes()], pa.binary())], schema=_SCHEMA)


def count_chunks(docs: DataFrame, longest: int, often: np.ndarray) -> DataFrame:
    """docs (lang, text): the rows of all chunks."""
    sent = docs.sparkSession.sparkContext.broadcast(often)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, before = Chunk(TaskContext.get().partitionId() << 32, longest, sent.value), []
        for lang, words, goes_on in texts_by_language(batches):
            before = before if goes_on else []
            chunk.add(lang, words, before)
            before = (before + words)[1 - longest :]
            if chunk.full():
                yield from chunk.rows()
                chunk = Chunk(chunk.number + 1, longest, sent.value)
                give_back()
        yield from chunk.rows()
        del chunk, before
        give_back()

    return docs.mapInArrow(run, _COUNTED)


def numbered(words: DataFrame, name: str) -> tuple[DataFrame, int]:
    """The rows with a column of whole numbers from 0 without gaps, and how many there are. One number per task of the writing reaches the driver."""
    place = F.monotonically_increasing_id()
    kept = settle(words.select("*", F.spark_partition_id().alias("_part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")), "words")
    sizes, start, offsets = sorted(kept.groupBy("_part").count().collect()), 0, []
    for part, size in sizes:
        offsets.append((part, start))
        start += size
    table = kept.sparkSession.createDataFrame(offsets, "_part int, _start long")
    return kept.join(F.broadcast(table), "_part").select(*words.columns, (F.col("_start") + F.col("_at")).alias(name)), start


def renumbered(local: Counts, part: int, known: np.ndarray, n: int, bits: int) -> Counts:
    """One part of a chunk's filter with the corpus's numbers; `known` has both numbers of the chunk's frequent words."""
    lid = known & ((1 << LOCAL_BITS) - 1)
    names = np.full(int(lid.max()) + 1, -1, np.int64)
    names[lid] = known >> LOCAL_BITS
    left = local.left | U(part) << U(quotient.halves(LOCAL_BITS * n)[0] - CUT)
    old = quotient.unpacked(*quotient.restore(left, local.right, LOCAL_BITS * n), LOCAL_BITS, n)
    stays = np.logical_and.reduce([x < len(names) for x in old])
    new = [names[np.where(stays, x, 0)] for x in old]
    stays &= np.logical_and.reduce([x >= 0 for x in new])
    left, right = quotient.permute(*quotient.packed([x[stays] for x in new], bits), bits * n)
    return Counts.of(left, right, local.count[stays], *quotient.halves(bits * n))


def repacked(grams: DataFrame, ids: DataFrame, bits: int, ranges: int) -> DataFrame:
    """The chunks' filters with the corpus's numbers, cut into 2**ranges ranges: (n, part, grams)."""

    def rows(n: int, held: list[Counts]) -> pa.RecordBatch:
        counts = Counts.merged(held)
        parts = counts.ranges(min(ranges, counts.a)) if len(counts) else []
        return pa.RecordBatch.from_arrays([
            pa.array(np.full(len(parts), n, np.int32)), pa.array([k for k, _ in parts], pa.int64()),
            pa.array([part.to_bytes() for _, part in parts], pa.binary())], names=["n", "part", "grams"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[Counts]] = {}
        for batch in batches:
            for n, part, raw, ids in zip(batch.column("n").to_pylist(), batch.column("part").to_pylist(), batch.column("grams"), batch.column("ids"), strict=True):
                of = held.setdefault(n, [])
                of.append(renumbered(Counts.from_bytes(raw.as_buffer()), part, ids.values.to_numpy(), n, bits))
                if sum(map(len, of)) >= WAITING:
                    yield rows(n, held.pop(n))
        for n, of in held.items():
            yield rows(n, of)
        held.clear()
        give_back()

    return grams.join(ids, "chunk").select("n", "part", "grams", "ids").mapInArrow(run, "n int, part long, grams binary")


def merged_phrases(parts: DataFrame, bits: int, ranges: int, least: int) -> DataFrame:
    """(ids array<long>, f): phrases with f >= least, from the filters of all chunks, merged range by range."""

    def rows_of(key: tuple[int, int], held: Pile) -> Iterator[pa.RecordBatch]:
        for counts in held.merged():
            n, part = key
            a = quotient.halves(bits * n)[0]
            often = counts.count >= least
            left = counts.left[often] | (U(part) << U(a - min(ranges, a)))
            ids = quotient.unpacked(*quotient.restore(left, counts.right[often], bits * n), bits, n)
            flat = np.stack(ids, axis=1).reshape(-1)
            starts = np.arange(0, len(flat) + 1, n, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(starts), pa.array(flat)), pa.array(counts.count[often])], names=["ids", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, Pile(PILED)
        for batch in batches:
            for n, part, raw in zip(batch.column("n").to_pylist(), batch.column("part").to_pylist(), batch.column("grams"), strict=True):
                if (n, part) != key:
                    yield from rows_of(key, held)
                    key, held = (n, part), Pile(PILED)
                held.add(Counts.from_bytes(raw.as_buffer()))
        yield from rows_of(key, held)
        give_back()

    return parts.repartition("n", "part").sortWithinPartitions("n", "part").mapInArrow(run, "ids array<long>, f long")


def score_of(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), worked out in decimals of 38 digits."""
    whole = a.cast("decimal(38,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(38,0)") * whole * whole, left.cast("decimal(38,0)") * right.cast("decimal(38,0)"))


def key_of(ids: Column, bits: int, words: int) -> Column:
    """One value that names a phrase of up to `words` words: a whole number if they fit, else text."""
    if (bits + 1) * words <= 63:  # no number is 0, so phrases of different length differ
        return F.aggregate(ids, F.lit(0).cast("long"), lambda key, x: F.shiftleft(key, bits + 1).bitwiseOR(x + 1))
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), " ")


def best_cuts(phrases: DataFrame, words: DataFrame, bits: int, longest: int) -> DataFrame:
    """phrases (phrase, ids, f), numbered by `phrase`, words (id, tongue, f): (phrase, f, tongue, l, r, score) of the cut that counts."""

    def key(ids: Column) -> Column:
        return key_of(ids, bits, longest - 1)

    counts = words.select(key(F.array("id")).alias("key"), F.col("f").alias("part"), "tongue").unionByName(
        phrases.where(F.size("ids") < longest).select(key(F.col("ids")).alias("key"), F.col("f").alias("part"), F.lit(None).cast("long").alias("tongue")))
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("ids") - 1))).select(
        "phrase", "f", "k", key(F.slice("ids", F.lit(1), F.col("k"))).alias("head"), key(F.slice("ids", F.col("k") + 1, F.size("ids"))).alias("tail"))
    cuts = cuts.join(counts.select(F.col("key").alias("head"), F.col("part").alias("l"), "tongue").hint("shuffle_hash"), "head")
    cuts = cuts.join(counts.select(F.col("key").alias("tail"), F.col("part").alias("r")).hint("shuffle_hash"), "tail")
    at = [F.col("k") == k for k in range(1, longest)]
    whole = cuts.groupBy("phrase", "f").agg(
        F.max("tongue").alias("tongue"), *[F.max(F.when(on, F.col(c))).alias(f"{c}{k}") for k, on in enumerate(at, 1) for c in "lr"])
    each = [F.struct(score_of(F.col("f"), F.col(f"l{k}"), F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in range(1, longest)]
    there = F.filter(F.array(*each), lambda x: x["score"].isNotNull())
    return whole.withColumn("cut", F.array_min(there)).select("phrase", "f", "tongue", "cut.l", "cut.r", "cut.score")


def contained(phrases: DataFrame, share: int, bits: int, longest: int) -> DataFrame:
    """The numbers of phrases that a longer one holds at least `share` per cent of the time."""
    inner = F.expr("flatten(transform(sequence(2, size(ids) - 1), m -> transform(sequence(1, size(ids) - m + 1), s -> slice(ids, s, m))))")
    longer = phrases.where(F.size("ids") > 2).select("f", F.explode(inner).alias("ids"))
    longer = longer.select("f", key_of(F.col("ids"), bits, longest - 1).alias("key")).groupBy("key").agg(F.max("f").alias("longer"))
    short = phrases.where(F.size("ids") < longest).select("phrase", "f", key_of(F.col("ids"), bits, longest - 1).alias("key"))
    return short.join(longer, "key").where(F.expr(f"100 * longer >= {int(share)} * f")).select("phrase")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """docs (lang, text): per language the first `top` phrases by score, occurrences and UTF-8 order of the phrase:
    (lang, rank, phrase, a, l, r, n, score); n counts all words of the language."""
    if not 2 <= longest <= 126 // LOCAL_BITS:
        raise ValueError(f"longest must be from 2 to {126 // LOCAL_BITS}")
    docs = shelved(docs, ("lang", "text"))[0].select(F.coalesce("lang", F.lit(NO_LANGUAGE)).alias("lang"), "text")
    spark = docs.sparkSession
    with rows_per_batch(spark, TEXTS):
        counted = settle(word_counts(docs, least), "counts")
    words, size = numbered(counted.where("word IS NOT NULL"), "id")
    tongues = numbered(words.select("lang").distinct(), "tongue")[0]
    bits = max(1, (size - 1).bit_length())
    if bits * longest > 126:
        raise ValueError(f"{size} frequent words are too many for phrases of {longest} words")
    ranges = max(1, RANGES * shuffle_parts(docs) - 1).bit_length()
    often = bitmap(words, size)
    with rows_per_batch(spark, TEXTS):
        chunks = settle(count_chunks(docs, longest, often), "chunks")
    name = F.shiftleft(F.col("id"), LOCAL_BITS).bitwiseOR(F.col("lid").cast("long"))
    local = chunks.where("n = 1").select("chunk", "lid", "lang", "word")
    ids = local.join(words.select("lang", "word", "id").hint("shuffle_hash"), ["lang", "word"]).groupBy("chunk").agg(F.collect_list(name).alias("ids"))
    grams = chunks.where("n > 1").select("chunk", "n", "part", "grams")
    merged = merged_phrases(repacked(grams, ids, bits, ranges), bits, ranges, least)
    with rows_per_batch(spark, FILTERS):
        phrases = settle(merged.withColumn("phrase", F.monotonically_increasing_id()), "phrases")
    discard(chunks)

    of_words = words.join(tongues, "lang").select("id", "tongue", "f")
    scored = best_cuts(phrases, of_words, bits, longest).join(contained(phrases, share, bits, longest), "phrase", "left_anti")
    # The best of each language with all ties, part by part, so that few phrases have to be spelled.
    ahead = W.partitionBy("tongue", "part").orderBy(F.desc("score"), F.desc("f"))
    scored = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANKED_IN)))
    scored = scored.withColumn("place", F.rank().over(ahead)).where(F.col("place") <= top).drop("part", "place")
    spelled = scored.join(phrases.select("phrase", "ids"), "phrase").select("*", F.posexplode("ids").alias("at", "id"))
    spelled = spelled.join(words.select("id", "lang", "word"), "id").groupBy("phrase", "f", "l", "r", "score").agg(
        F.first("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("at", "word"))).alias("words"))
    spelled = spelled.withColumn("phrase", F.array_join(F.transform("words", lambda x: x["word"]), " "))
    order = [F.desc("score"), F.desc("f"), F.asc("phrase")]
    spelled = spelled.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANKED_IN)))
    first = spelled.withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    best = first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    total = counted.where("word IS NULL").select("lang", F.col("f").alias("n"))
    return best.join(total, "lang").select("lang", "rank", "phrase", F.col("f").alias("a"), "l", "r", "n", "score")
