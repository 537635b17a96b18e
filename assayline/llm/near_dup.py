"""Near-dedup by SetSketch: registers of exponentially spaced truncated minima, banded, estimated jointly, then verified.

A document's set holds its distinct w-word shingles. Register i of its sketch is floor(1 - log_b x), cut to 0..q+1, where x
is the least of the set's values under the i-th exponential hash of rate a; registers of a union are the larger of the two
(`merge`), and equal registers tell of a large overlap. Rows of equal sets are one node from then on.

Registers are grouped in bands; nodes that agree in a whole band are candidates. Inside a band's bucket no pairs are laid
out: all are held against one centre, the pair's overlap is estimated from both sketches by maximum likelihood (sizes are
known), clear misses go, and the rest is confirmed on the full sets. Confirmed links are joined to components. Buckets that
then hold more than one component are compared in full inside tasks, cut into parts of `PART` nodes or `PART_BYTES` of text,
each pair of parts a piece of work of its own: only nodes of different components meet, each pair in the first band it
shares, and what leaves a task is a link for each two components that it joins. No bucket is cut off.

Null or empty texts and texts without words have an empty set, which is linked with nothing. Texts of fewer than w words
are one shingle. Rows that repeat an id with other texts are judged each by its text; the component's name is the smallest
id in it. Rows that repeat both are linked. Other columns are carried along by `drop_near_duplicates`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.llm.common import (
    WordHashes, as_bytes, bounds, flat, in_parts, mix, odd_numbers, row_keys, runs_hash, shelved, signed, slices, sorted_groups)
from assayline.llm.components import components
from assayline.session import settle

#: Registers, registers of a band, base and rate of the sketch and its largest value.
REGISTERS = 96
BAND = 4
BASE, RATE, TOP = 1.001, 20.0, 65535
#: Natural log of the likelihood ratio beyond which a pair is taken for a clear miss.
MISS = 12.0
PART = 256
PART_BYTES = 16 << 20
#: A-Z become a-z, all else stays; words end at the ASCII blanks, which is where bytes.split() ends them.
ASCII_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
SKETCH = ("uid long, _k1 long, _k2 long, n long, f1 long, f2 long, bands array<long>, regs binary")


def words(text: bytes | None) -> list[bytes]:
    return text.translate(ASCII_LOWER).split() if text else []


def shingle_sets(texts: list[list[bytes]], table: WordHashes, width: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    starts = bounds(texts)
    hashes = np.fromiter(map(table.__getitem__, flat(texts)), np.uint64, starts[-1])
    table.trim()
    runs = runs_hash(hashes, width, 4)
    out = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(runs[a : b - width + 1]))
        else:  # fewer words: the whole sequence, hashed apart by its length
            out.append(runs_hash(hashes[a:b], b - a, 40 + b - a)[:1] if b > a else np.zeros(0, np.uint64))
    return out


def registers(least: np.ndarray) -> np.ndarray:
    """From the least of 32-bit hashes (uniform) to the register: exponential value, its logarithm, cut to 0..TOP."""
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP).astype(np.uint16)


def sketches(sets: list[np.ndarray], count: int) -> np.ndarray:
    """One row of registers per set; rows of empty sets are 0."""
    out = np.zeros((len(sets), count), np.uint16)
    full = [i for i, s in enumerate(sets) if len(s)]
    if not full:
        return out
    starts = bounds([sets[i] for i in full])[:-1]
    h = np.concatenate([sets[i] for i in full])
    low, high = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32), (h >> np.uint64(32)).astype(np.uint32)
    least = np.empty((count, len(full)), np.uint32)
    for i, odd in enumerate(odd_numbers(2 * count, 9).astype(np.uint32).reshape(count, 2)):
        v = low * odd[0]
        v ^= v >> np.uint32(15)
        v += high
        v *= odd[1]
        least[i] = np.minimum.reduceat(v, starts)
    out[full] = registers(least).T
    return out


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.maximum(a, b)


def _tail(x: np.ndarray) -> np.ndarray:
    return -np.log(np.maximum(1 - x * (BASE - 1) / BASE, 1e-12)) / np.log(BASE)


def log_likelihood(j, n1, n2, more, less, same):
    """Of similarity j, given in how many registers the first sketch is larger, smaller or equal."""
    u, v = n1 / (n1 + n2), n2 / (n1 + n2)
    p, m = np.clip(_tail(u - v * j), 1e-9, 1), np.clip(_tail(v - u * j), 1e-9, 1)
    return more * np.log(p) + less * np.log(m) + same * np.log(np.clip(1 - p - m, 1e-9, 1))


def likely(n1, n2, more, less, same, bound: float) -> np.ndarray:
    """Whether a similarity of `bound` or more is not clearly ruled out; the likelihood has one peak, found by thirds."""
    n1, n2 = n1.astype(np.float64), n2.astype(np.float64)
    low, high = np.zeros(len(n1)), np.minimum(n1, n2) / np.maximum(n1, n2)
    fits = high >= bound - 1e-12  # the sizes alone rule out the others
    for _ in range(40):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        up = log_likelihood(a, n1, n2, more, less, same) < log_likelihood(b, n1, n2, more, less, same)
        low, high = np.where(up, a, low), np.where(up, high, b)
    at = (low + high) / 2
    best = log_likelihood(at, n1, n2, more, less, same)
    return fits & ((at >= bound) | (best - log_likelihood(np.full(len(at), bound), n1, n2, more, less, same) <= MISS))


def sketch_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = WordHashes(), TaskContext.get().partitionId() << 36
        for batch in slices(batches):
            sets = shingle_sets([words(x) for x in as_bytes(batch.column("text"))], table, width)
            regs = sketches(sets, REGISTERS)
            size = np.fromiter(map(len, sets), np.int64, len(sets))
            f1 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64)
            f2 = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64)
            n_bands = REGISTERS // BAND
            bands = np.zeros((len(sets), n_bands), np.uint64)
            for j, odd in enumerate(odd_numbers(BAND, 5)):
                bands += mix(regs[:, j::BAND][:, :n_bands].astype(np.uint64) + np.uint64(1)) * odd
            bands = mix(bands + np.arange(n_bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            ends = np.arange(0, bands.size + 1, n_bands, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(seen, seen + len(sets))), batch.column("_k1"), batch.column("_k2"), pa.array(size),
                 pa.array(signed(f1)), pa.array(signed(f2)),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(signed(bands.ravel()))),
                 pa.array([r.tobytes() for r in regs], pa.binary())],
                names=["uid", "_k1", "_k2", "n", "f1", "f2", "bands", "regs"])
            seen += len(sets)

    return run


def estimate_rows(bound: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("ra", "rb"))
            n1, n2 = (batch.column(c).to_numpy() for c in ("na", "nb"))
            ok = likely(n1, n2, (a > b).sum(1), (a < b).sum(1), (a == b).sum(1), bound)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(ok)), batch.column("b").filter(pa.array(ok))], names=["a", "b"])

    return run


def confirm_rows(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordHashes()
        for batch in batches:
            ok, last, centre = [], None, None
            for ta, tb in zip(as_bytes(batch.column("ta")), as_bytes(batch.column("tb")), strict=True):
                if tb != last:
                    last, (centre,) = tb, shingle_sets([words(tb)], table, width)
                (own,) = shingle_sets([words(ta)], table, width)
                ok.append(linked(own, centre, percent))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return run


def apart_rows(width: int, percent: int):
    """Links between components that share a bucket; rows are those of `in_parts`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordHashes()
        for t in sorted_groups(batches, ["band", "p", "q"]):
            g = t.num_rows
            node, comp, n, part = (t.column(c).to_numpy() for c in ("node", "component", "n", "part"))
            band, one = t.column("j")[0].as_py(), t.column("p")[0] == t.column("q")[0]
            if g < 2 or (comp == comp[0]).all():
                continue
            regs = np.frombuffer(b"".join(t.column("regs").to_pylist()), np.uint16).reshape(g, REGISTERS)
            pairs = []
            for a in range(0, g, 32):
                same = regs[a : a + 32, None, :] == regs[None, :, :]
                first = ~same.reshape(*same.shape[:2], -1, BAND)[:, :, :band].all(3).any(2)
                meet = first & (comp[a : a + 32, None] != comp[None, :]) & (np.arange(a, a + len(same))[:, None] < np.arange(g))
                if not one:
                    meet &= part[a : a + 32, None] != part[None, :]
                i, k = np.nonzero(meet)
                pairs.append((i + a, k, same[i, k].sum(1)))
            i, k, same = (np.concatenate(x) for x in zip(*pairs, strict=True))
            more = np.concatenate([(regs[x] > regs[y]).sum(1) for x, y in zip(np.array_split(i, len(i) // 20_000 + 1), np.array_split(k, len(i) // 20_000 + 1), strict=True)])
            ok = likely(n[i], n[k], more, REGISTERS - more - same, same, percent / 100)
            i, k, same = i[ok], k[ok], same[ok]
            if not len(i):
                continue
            used = np.unique(np.concatenate([i, k])).tolist()
            texts = t.column("text").take(pa.array(used)).to_pylist()
            sets = dict(zip(used, shingle_sets([words(x.encode("utf-8", "surrogatepass")) for x in texts], table, width), strict=True))
            root, found = {c: c for c in comp.tolist()}, []

            def top(c: int) -> int:
                while root[c] != c:
                    root[c] = c = root[root[c]]
                return c

            for x in np.argsort(-same, kind="stable").tolist():
                a, b = int(i[x]), int(k[x])
                ca, cb = top(int(comp[a])), top(int(comp[b]))
                if ca != cb and linked(sets[a], sets[b], percent):
                    root[max(ca, cb)] = min(ca, cb)
                    found.append((node[a], node[b]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*found, strict=True)], names=["a", "b"])

    return run


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per row of `docs`: _k1, _k2 (its row keys), uid, doc_id, n_shingles, component_id."""
    docs, _ = shelved(docs, ("doc_id", "text"))
    keyed = docs.select("doc_id", "text", *row_keys())
    rows = settle(keyed.select("text", "_k1", "_k2").mapInArrow(sketch_rows(width), SKETCH), "sketches")
    classes = settle(rows.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("uid").alias("node")), "classes")
    nodes = rows.join(classes.select(F.col("node").alias("uid")), "uid", "left_semi")
    banded = nodes.select(F.posexplode("bands").alias("j", "band"), F.col("uid").alias("node"))
    centre = F.min(F.struct(F.xxhash64("node"), "node")).getField("node").alias("centre")
    centres = banded.groupBy("band").agg(F.count(F.lit(1)).alias("c"), centre).where("c > 1").select("band", "centre")
    banded = settle(banded.join(centres, "band"), "bands")
    some = settle(nodes.select(F.col("uid").alias("node"), "n", "regs", "_k1", "_k2").join(
        banded.select("node").distinct(), "node", "left_semi"), "nodes")
    facts = some.select("node", "n", "regs")
    texts = keyed.join(some.select("_k1", "_k2").distinct(), ["_k1", "_k2"], "left_semi").select("_k1", "_k2", "text").dropDuplicates(["_k1", "_k2"])
    texts = settle(texts.join(some.select("node", "_k1", "_k2"), ["_k1", "_k2"]).select("node", "text"), "texts")

    # Every node of a bucket against its centre.
    pairs = banded.where("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
    sized = pairs.join(facts.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("regs").alias("ra")), "a").join(
        facts.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb")), "b")
    chosen = sized.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(estimate_rows(percent / 100), "a long, b long")
    read = chosen.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(
        texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    links = settle(read.select("a", "b", "ta", "tb").mapInArrow(confirm_rows(width, percent), "a long, b long"), "links")
    joined = settle(components(links), "components")

    # What is then still apart in a bucket, in full.
    placed = banded.select("j", "band", "node").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    full = facts.join(texts, "node")
    ends = placed.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("band")
    placed = settle(placed.join(ends, "band"), "apart")
    parts = placed.join(texts.select("node", F.octet_length("text").alias("bytes")), "node").groupBy("band").agg(
        F.ceil(F.greatest(F.count(F.lit(1)) / PART, F.sum("bytes") / PART_BYTES)).cast("int").alias("s"))
    work = in_parts(placed.join(full, "node"), ["band"], parts, "node")
    more = work.mapInArrow(apart_rows(width, percent), "a long, b long")
    joined = settle(components(links.unionByName(settle(more, "links"))), "components")

    named = rows.join(classes, ["n", "f1", "f2"], "left").withColumn("node", F.coalesce("node", "uid")).select("uid", "_k1", "_k2", "n", "node")
    named = named.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = docs.select("doc_id", *row_keys()).distinct()
    named = settle(named.join(ids, ["_k1", "_k2"]).select("uid", "_k1", "_k2", "doc_id", F.col("n").alias("n_shingles"), "component"), "named")
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return named.join(least, "component")


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs`, all columns as they are, with one row of each component: one of its smallest id.

    Rows with an empty set all stay, but for rows that repeat both id and text, of which one stays."""
    found = near_duplicates(docs, width, percent)
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_k1", "_k2")).alias("x"))
    keys = first.select("x._k1", "x._k2").distinct()
    docs, back = shelved(docs, ("doc_id", "text"))
    keyed = docs.select("*", *row_keys())
    return keyed.join(keys, ["_k1", "_k2"], "left_semi").dropDuplicates(["_k1", "_k2"]).select(*back)
