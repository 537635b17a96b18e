"""Benchmark decontamination by winnowing: fingerprints of both sides are joined and the hits extended.

A window is 10 consecutive words of an item; an item of fewer words (not none) is one window. Of every 6 neighbouring
5-grams, that is of every 10 words, both sides keep those of least hash, so each shared window has a shared fingerprint.
Around it the words are compared one by one, up to 5 to either side; a run of 10 or more equal words is a run of hit words.
Short items have a class of their own per length, in which every run of that length is a fingerprint.

A bitmap of fixed size (`BITMAP_BITS`, whatever the size of the benchmark) is sent to the tasks, which drop document
fingerprints that cannot be in the benchmark; with a very large benchmark it only lets more through to the join. Equal
surroundings of a fingerprint are one row on the item side, with the items that have them, so passages that many items
share do not multiply. What is left is joined by Spark, which splits hot fingerprints.

Null or empty texts, and texts without words, have no words and no hits. Items with a null id make words hit but are not
listed. Rows with the same id and text get the same result. Other columns are carried along by `decontaminate`,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.llm.common import WordHashes, as_bytes, bounds, flat, row_keys, runs_hash, shelved, slices
from assayline.session import settle

#: Fixed value of the contract: words of a window.
WINDOW = 10
GRAM = 5
SIDE = WINDOW - GRAM
CONTEXT = WINDOW + SIDE
BITMAP_BITS = 1 << 23
#: A-Z become a-z; bytes that cannot be in a word become blanks. Bytes from 0x80 on are parts of letters.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
HIT = "struct<cls:int,fp:long,pos:int,ctx:array<long>>"
_NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)


def words(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


def winnow(grams: np.ndarray, valid: np.ndarray, window: int) -> np.ndarray:
    """Places of the least hash of each run of `window` grams; grams that are not valid never count."""
    g = np.where(valid, grams, _NEVER)
    least = g.copy()
    for s in range(1, window):
        least[:-s] = np.minimum(least[:-s], g[s:])
    most = least.copy()  # the largest minimum of the runs that hold a place: equal to its hash if it is one of the minima
    for s in range(1, window):
        most[s:] = np.maximum(most[s:], least[:-s])
    return np.flatnonzero((most == g) & valid)


def fingerprints(hashes: np.ndarray, starts: np.ndarray, lengths: list[int], bitmap: np.ndarray | None, pad: int, whole: bool):
    """(class, document, place in it, hash, surroundings) of the fingerprints of all documents of a batch.

    Class 0 has the winnowed 5-grams. Class n, for each n of `lengths`, has the runs of n words: all of them, or with
    `whole` only those that are a whole text. `pad` stands in for words beyond the ends of a text.
    """
    sizes = np.diff(starts)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(hashes)) - starts[doc]
    left = sizes[doc] - place
    for cls in (0, *lengths):
        k = cls or GRAM
        grams = runs_hash(hashes, k, 100 + cls) if len(hashes) else hashes
        if cls:
            at = np.flatnonzero((left >= k) & ((sizes[doc] == k) | (not whole)))
        else:
            at = winnow(grams, (left >= k) & (sizes[doc] >= WINDOW), WINDOW - GRAM + 1)
        if bitmap is not None:
            bit = (grams[at] % np.uint64(BITMAP_BITS)).astype(np.int64)
            at = at[(bitmap[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1]
        if not len(at):
            continue
        around = at[:, None] + np.arange(-SIDE, CONTEXT - SIDE)
        inside = (around >= starts[doc[at]][:, None]) & (around < starts[doc[at] + 1][:, None])
        if cls:
            inside &= (np.arange(CONTEXT) >= SIDE) & (np.arange(CONTEXT) < SIDE + k)
        ctx = np.where(inside, hashes[np.clip(around, 0, len(hashes) - 1)], np.uint64(pad))
        yield cls, doc[at], place[at], grams[at], ctx


def _lists(ctx: np.ndarray) -> pa.Array:
    offsets = np.arange(0, ctx.size + 1, CONTEXT, dtype=np.int32) if ctx.size else np.zeros(1, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ctx.ravel().view(np.int64)))


def item_rows(lengths: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordHashes()
        for batch in slices(batches):
            texts = [words(x) for x in as_bytes(batch.column("text"))]
            starts = bounds(texts)
            hashes = np.fromiter(map(table.__getitem__, flat(texts)), np.uint64, starts[-1])
            for cls, doc, _, grams, ctx in fingerprints(hashes, starts, lengths, None, 1, True):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(doc), cls, np.int32)), pa.array(grams.view(np.int64)), _lists(ctx),
                     batch.column("item_id").take(pa.array(doc))], names=["cls", "fp", "ctx", "item_id"])
            table.trim()

    return run


def document_rows(lengths: list[int], bits: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bitmap = WordHashes(), np.frombuffer(bits, np.uint8)
        for batch in slices(batches):
            texts = [words(x) for x in as_bytes(batch.column("text"))]
            starts = bounds(texts)
            hashes = np.fromiter(map(table.__getitem__, flat(texts)), np.uint64, starts[-1])
            found = list(fingerprints(hashes, starts, lengths, bitmap, 0, False))
            doc = np.concatenate([x[1] for x in found] or [np.zeros(0, np.int64)])
            order = np.argsort(doc, kind="stable")
            one = lambda i, kind: np.concatenate([x[i] for x in found] or [np.zeros(0, kind)])[order]
            cls = np.concatenate([np.full(len(x[1]), x[0], np.int32) for x in found] or [np.zeros(0, np.int32)])[order]
            ctx = np.concatenate([x[4] for x in found])[order] if found else np.zeros((0, CONTEXT), np.uint64)
            hits = pa.StructArray.from_arrays(
                [pa.array(cls), pa.array(one(3, np.uint64).view(np.int64)), pa.array(one(2, np.int64).astype(np.int32)),
                 _lists(ctx)], names=["cls", "fp", "pos", "ctx"])
            ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(texts)))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_k1"), batch.column("_k2"), batch.column("doc_id"), pa.array(np.diff(starts)),
                 pa.ListArray.from_arrays(pa.array(ends), hits)], names=["_k1", "_k2", "doc_id", "n_words", "hits"])
            table.trim()

    return run


def item_lengths(items: DataFrame) -> list[int]:
    """Word counts from 1 to 9 that some item has: nine rows at most."""
    n = F.size(F.expr(r"regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+', 0)"))
    got = items.where("text is not null").select(n.alias("n")).where(F.col("n").between(1, WINDOW - 1)).distinct().collect()
    return sorted(x.n for x in got)


def item_contexts(items: DataFrame, lengths: list[int]) -> DataFrame:
    """(cls, fp, ctx, items): one row for equal surroundings, with the ids of the items that have them."""
    rows = items.select("item_id", F.col("text").cast("string").alias("text")).mapInArrow(
        item_rows(lengths), f"cls int, fp long, ctx array<long>, item_id {items.schema['item_id'].dataType.simpleString()}")
    return settle(rows.groupBy("cls", "fp", "ctx").agg(F.collect_set("item_id").alias("items")), "items")


def bitmap_of(contexts: DataFrame) -> bytes:
    """One bit per fingerprint hash; what comes to the driver is at most BITMAP_BITS bits, as 64-bit words."""
    at = F.expr(f"cast(pmod(pmod(fp, {BITMAP_BITS}), {BITMAP_BITS}) as int)")
    got = contexts.select(at.alias("at")).groupBy(F.expr("at div 64").alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, at % 64)")).alias("bits")).collect()
    out = np.zeros(BITMAP_BITS // 64, np.int64)
    for w, bits in got:
        out[w] = bits
    return out.tobytes()


def hit_documents(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per document: _k1, _k2, doc_id, n_words, hits), and (per document with hits: _k1, _k2, n_hit, item_ids sorted)."""
    docs, items = shelved(docs, ("doc_id", "text"))[0], shelved(items, ("item_id", "text"))[0]
    lengths = item_lengths(items)
    contexts = item_contexts(items, lengths)
    base = settle(
        docs.select("doc_id", "text", *row_keys()).mapInArrow(
            document_rows(lengths, bitmap_of(contexts)),
            f"_k1 long, _k2 long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, hits array<{HIT}>"),
        "fingerprints")
    hits = base.where("size(hits) > 0").select("_k1", "_k2", F.explode("hits").alias("h")).select("_k1", "_k2", "h.*")
    pairs = hits.join(contexts.withColumnRenamed("ctx", "other"), ["cls", "fp"])
    pairs = pairs.withColumn("same", F.array_join(F.zip_with("ctx", "other", lambda a, b: F.when(a == b, "1").otherwise("0")), ""))
    size = F.when(F.col("cls") == 0, F.lit(GRAM)).otherwise(F.col("cls"))
    before = F.length(F.regexp_extract(F.substring("same", 1, SIDE), "1*$", 0))
    after = F.length(F.regexp_extract(F.substring("same", SIDE + GRAM + 1, SIDE), "^1*", 0))
    run = pairs.withColumns({"size": size}).where(
        F.expr(f"substring(same, {SIDE + 1}, size)") == F.expr("repeat('1', size)"))
    run = run.withColumns({
        "start": F.when(F.col("cls") == 0, F.col("pos") - before).otherwise(F.col("pos")),
        "end": F.when(F.col("cls") == 0, F.col("pos") + GRAM + after).otherwise(F.col("pos") + F.col("size"))})
    run = run.where((F.col("cls") > 0) | (F.col("end") - F.col("start") >= WINDOW))
    # Equal runs of a document first become one row; then its runs are put in order and their union is measured.
    run = run.select("_k1", "_k2", "start", "end", F.explode_outer("items").alias("item"))
    spans = run.groupBy("_k1", "_k2", "start", "end").agg(F.collect_set("item").alias("item"))
    per_doc = spans.groupBy("_k1", "_k2").agg(
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("runs"),
        F.array_distinct(F.flatten(F.collect_list("item"))).alias("item"))
    union = F.aggregate(
        "runs", F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n")),
        lambda acc, x: F.struct(
            F.greatest(acc["upto"], x["end"]).alias("upto"),
            (acc["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(acc["upto"], x["start"]))).alias("n")),
        lambda acc: acc["n"])
    return base, per_doc.select(
        "_k1", "_k2", union.alias("n_hit"), F.array_sort(F.transform("item", lambda x: x.cast("string"))).alias("item_ids"))


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, item_ids (as strings, sorted)."""
    base, per_doc = hit_documents(docs, items)
    return base.select("_k1", "_k2", "doc_id", "n_words").join(per_doc, ["_k1", "_k2"], "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of `docs` with no word hit, all columns as they are."""
    _, per_doc = hit_documents(docs, items)
    docs, back = shelved(docs, ("doc_id", "text"))
    keyed = docs.select("*", *row_keys())
    return keyed.join(per_doc.select("_k1", "_k2"), ["_k1", "_k2"], "left_anti").select(*back)
