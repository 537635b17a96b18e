"""Near duplicates of texts: shingles, signatures, bands, an exact check, groups; texts and signatures in Arrow batches, the rest built-in functions.

Two texts are near duplicates if the Jaccard similarity of their sets of five-word shingles (of the normal form) is at
least 80 per cent; groups are what such links connect. The words of a text are hashed to 64 bits once, then the runs of
these hashes, which are kept as an array. Texts with equal normal forms are one class, so exact copies cost nothing further. A class gets `ROWS * BANDS`
minima of its shingles' hashes, and `ROWS` minima in a row are a band; two classes at the limit share no band in
(1 - 0.8^4)^24, about 3 in a million cases.

No bucket is turned into pairs as a whole. First every class meets the smallest class of each of its buckets; sets that
overlap enough are linked, and groups are formed. In a large group of near copies that settles nearly all. Then only
buckets that still hold classes of different groups are looked at, and only pairs across groups are checked, in pieces of
`PIECE` classes a side, so a crowded bucket (a shingle that very many texts share) is spread over tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayline.functions.text import _folds
from assayline.operators.duplicates import group_excess
from assayline.operators.graph import connected
from assayline.session import discard, settle
from assayline.vocabulary import NORMAL_CHARS

WIDTH, PERCENT = 5, 80
ROWS, BANDS = 4, 24
PIECE = 512
#: Shingles whose minima a task works out at once.
AT_ONCE = 1 << 18
#: Words that a task remembers before it starts afresh.
WORDS_KEPT = 400_000


class _WordHashes(dict):
    """The hash of the normal form of a word, 0 for a word of marks alone; forgets all words when there are too many."""

    def __init__(self) -> None:
        super().__init__()
        self.folds, self.kept = dict(_folds()) | {"İ": "i"}, set(re.findall("[" + NORMAL_CHARS + "]", "".join(map(chr, range(0x250)))))

    def __missing__(self, word: str) -> int:
        folded = "".join(self.folds.get(ch) or ch.lower() for ch in word)
        norm = "".join(ch for ch in folded if ch in self.kept)
        self[word] = h = max(xxhash.xxh3_64_intdigest(norm), 1) if norm else 0
        return h


def _text_sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(uid, id, key, grams) of rows (uid, id, text): words of the normal form are hashed once each, then their runs."""
    known = _WordHashes()
    rng = np.random.default_rng(width)
    times = rng.integers(0, 1 << 63, width + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def sets(text: str | None) -> tuple[str | None, np.ndarray | None]:
        words = np.fromiter((known[w] for w in text.split()), np.uint64) if text else np.empty(0, np.uint64)
        words = words[words != 0]
        if not len(words):
            return None, None
        places = max(len(words) - width + 1, 1)
        grams = np.full(places, int(times[width]) ^ min(len(words), width), np.uint64)
        for k in range(min(width, len(words))):
            grams = (grams ^ words[k:k + places]) * times[k]
            grams ^= grams >> np.uint64(32)
        return xxhash.xxh3_128_hexdigest(words.tobytes()), np.unique(grams).view(np.int64)

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            made = [sets(t) for t in part.column("text").to_pylist()]
            if len(known) > WORDS_KEPT:
                known.clear()
            yield pa.RecordBatch.from_arrays([part.column("uid"), part.column("id"), pa.array([k for k, _ in made], pa.string()),
                                              pa.array([g for _, g in made], pa.list_(pa.int64()))], ["uid", "id", "key", "grams"])


def _kept_sets(df: DataFrame, id_column: str, text_column: str, width: int) -> DataFrame:
    """(uid, id, key, grams): one pass over the texts. Equal normal forms have equal keys."""
    rows = df.select(F.monotonically_increasing_id().alias("uid"), F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    shape = T.StructType([rows.schema["uid"], rows.schema["id"], T.StructField("key", T.StringType()), T.StructField("grams", T.ArrayType(T.LongType()))])
    return settle(rows.mapInArrow(lambda batches: _text_sets(batches, width), shape), "shingles")


def _band_hashes(batches: Iterator[pa.RecordBatch], rows: int, count: int) -> Iterator[pa.RecordBatch]:
    """(node, bands): the hashes of all bands of a node. Minima are taken for all nodes of a piece at once."""
    rng = np.random.default_rng(rows * count)
    add, times = (rng.integers(0, 1 << 64, rows * count, dtype=np.uint64, endpoint=False) for _ in "ab")
    times |= np.uint64(1)
    for batch in batches:
        batch = batch.filter(pc.greater(pc.fill_null(pc.list_value_length(batch.column("grams")), 0), 0))
        lists = batch.column("grams")
        offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
        part = (offsets[1:] - offsets[0]) // AT_ONCE
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
        for low, high in zip(cuts, cuts[1:]):
            if low == high:
                continue
            some, starts = values[offsets[low]:offsets[high]], offsets[low:high] - offsets[low]
            out = np.empty((high - low, count), np.uint64)
            for band in range(count):
                named = np.full(high - low, add[band] ^ times[band], np.uint64)
                for i in range(band * rows, (band + 1) * rows):
                    named = (named ^ np.minimum.reduceat((some ^ add[i]) * times[i], starts)) * times[i]
                    named ^= named >> np.uint64(32)
                out[:, band] = named
            lists_out = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, count), pa.int32()), pa.array(out.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("node").slice(low, high - low), lists_out], ["node", "bands"])


def signatures(grams: DataFrame, rows: int = ROWS, count: int = BANDS) -> DataFrame:
    """grams (node, grams): (node, bands), the band a hash of its number and its minima; nodes without grams are left out."""
    kind = f"node {grams.schema['node'].dataType.simpleString()}, bands array<bigint>"
    return grams.select("node", "grams").mapInArrow(lambda batches: _band_hashes(batches, rows, count), kind)


def bands(grams: DataFrame, rows: int = ROWS, count: int = BANDS) -> DataFrame:
    """grams (node, grams): (node, band), a row for every band of a node."""
    return signatures(grams, rows, count).select("node", F.explode("bands").alias("band"))


def linked(pairs: DataFrame, grams: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The distinct pairs (a, b) whose sets overlap enough; grams (node, grams)."""
    sized = grams.select("node", "grams", F.size("grams").alias("n"))
    both = pairs.join(sized.toDF("a", "ga", "na"), "a").join(sized.toDF("b", "gb", "nb"), "b")
    both = both.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    shared = F.size(F.array_intersect("ga", "gb"))
    return both.where(100 * shared >= percent * (F.col("na") + F.col("nb") - shared)).select("a", "b")


def first_pairs(buckets: DataFrame) -> DataFrame:
    """Each class with the smallest class of each of its buckets."""
    least = buckets.groupBy("band").agg(F.min("node").alias("a"), F.count("*").alias("c")).where("c > 1").drop("c")
    return buckets.join(least, "band").where("node <> a").select("a", F.col("node").alias("b")).distinct()


def open_pairs(buckets: DataFrame, roots: DataFrame, piece: int = PIECE) -> DataFrame:
    """Pairs of classes of different groups that share a bucket and were not checked before."""
    named = buckets.join(roots, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root"))
    mixed = named.groupBy("band").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.min("node").alias("first"), F.count("*").alias("c"))
    mixed = mixed.where("low <> high AND c > 2").select("band", "first", F.ceil(F.col("c") / piece).cast("int").alias("parts"))
    rows = named.join(mixed, "band").where("node <> first").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("band", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "node", "root")
    left, right = rows.toDF("band", "p", "q", "a", "ra"), rows.toDF("band", "p", "q", "b", "rb")
    return left.join(right, ["band", "p", "q"]).where("a < b AND ra <> rb").select("a", "b").distinct()


def near_duplicates(df: DataFrame, id_column: str = "id", text_column: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(id, shingles, group, group_number): number of shingles of every row, and the smallest id of its group of near duplicates.

    Rows without a normal form (NULL or empty texts, marks alone) have no shingles and belong to no group. Rows that repeat an
    id stay rows. Groups have a number of this run, so those whose ids are all NULL are told apart. An empty table gives no rows.
    """
    sets = _kept_sets(df, id_column, text_column, width)
    keyed = sets.where("key IS NOT NULL")
    classes = settle(keyed.groupBy("key").agg(F.min("uid").alias("node")), "classes")
    signed = signatures(keyed.select(F.col("uid").alias("node"), "grams")).join(classes.select("node"), "node", "left_semi")
    buckets = settle(signed.select("node", F.explode("bands").alias("band")), "bands")
    first = settle(first_pairs(buckets), "pairs")
    # Whole sets travel only for classes that share a bucket; both rounds of checks read these.
    met = first.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    grams = settle(keyed.select(F.col("uid").alias("node"), "grams").join(met, "node", "left_semi"), "grams")
    found = settle(linked(first, grams, percent), "near")
    roots = connected(found)
    more = settle(linked(open_pairs(buckets, roots), grams, percent), "near")
    if not more.isEmpty():
        discard(roots)
        roots = connected(found.unionByName(more))
    named = classes.join(roots, "node", "left").select("key", F.coalesce("root", "node").alias("group_number"))
    rows = keyed.select("id", "key", F.size("grams").alias("shingles")).join(named, "key")
    least = rows.groupBy("group_number").agg(F.min("id").alias("group"))
    alone = sets.where("key IS NULL").select(
        "id", F.lit(0).alias("shingles"), F.lit(None).cast(sets.schema["id"].dataType).alias("group"), F.lit(None).cast("long").alias("group_number"))
    done = settle(rows.join(least, "group_number").select("id", "shingles", "group", "group_number").unionByName(alone), "groups")
    discard(sets, classes, buckets, first, grams, found, more, roots)
    return done


def near_duplicate_excess(df: DataFrame, id_column: str = "id", text_column: str = "text", percent: int = PERCENT) -> DataFrame:
    """rows, groups and excess (rows beyond the first of each group): the value of the near-duplicate gate."""
    return group_excess(near_duplicates(df, id_column, text_column, percent=percent), "group_number")
