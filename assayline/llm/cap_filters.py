"""Embedding near-dedup by spherical-cap filters.

Filter directions are a structured random product code: a rotated vector is cut into two blocks, each block has a random
code of `b` directions, and every pair (i, j) of them is one of b * b filters. A vector is list-decoded to all filters
whose summed inner product exceeds a threshold, about `list_length(b)` of them. `CODES` such codes, each turned another way,
make up for vectors that one code treats badly. Vectors of a label are joined on filters and verified by cosine in double
precision. `b` follows the square root of the largest label's number of vectors, so that a filter holds tens of them at any size, and the
lists grow with `b` so that the share of pairs without a common filter stays the same: in 64 dimensions, of pairs at cosine
0.98 exactly, one code misses about one in ten at any size, and all five together about 1 in 100,000; of nearer pairs fewer.

`complete=True` adds the links that no filter holds, exactly: vectors that exceed no filter by so much that all vectors within
the limit exceed it too are compared with each other, in blocks of `BLOCK`. That part grows with the square of a label's distinct
vectors and finds, for most tables, nothing.

Equal vectors of a label are one node with a weight. Pairs never leave a task: a bucket gives one count of links per node
(a link is counted in the smallest filter that both share, so once) and edges from each node to the least node it is
connected with there. A bucket of more than `PART` nodes is cut into parts, and each pair of parts is a piece of work of its
own, so a hot bucket is spread over tasks and is still compared as a whole.

Vectors that are null, zero, or hold null or non-finite components, and vectors without a label, are linked with nothing.
Vectors of different lengths are not compared. Rows that repeat an id are separate vectors; the component's name is the
smallest id in it. Pairs whose cosine rounds to the limit are linked if the double is not below it. An empty table gives no
rows. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.llm.common import in_parts, shelved, sorted_groups
from assayline.llm.components import components
from assayline.session import settle

#: Fixed value of the contract.
COSINE = 0.98
CODES = 5
#: Mean length of a vector's list of filters for 32 directions a block, and how it grows with more.
MEAN_LIST, GROWTH = 8, 0.25
PART = 512
#: Vectors of a block of the completion, and how many of them are compared with another block at once.
BLOCK = 2048
STRIPE = 256
NODE = "uid long, label long, dim int, w long, vec binary"
WORK = "label long, dim int, filter int, node long, w long, vec binary, filters binary, open boolean"


def list_length(side: int) -> float:
    return MEAN_LIST * max(1.0, side / 32) ** GROWTH


class ProductCode:
    """The filters for vectors of one length; the same on all workers."""

    def __init__(self, dim: int, side: int, seed: int = 0):
        rng = np.random.default_rng([dim, seed])
        self.side, self.cut = side, (dim + 1) // 2
        self.turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.codes = []
        for size in (self.cut, dim - self.cut):
            c = rng.standard_normal((side, max(size, 1)))
            self.codes.append(c / np.linalg.norm(c, axis=1, keepdims=True))
        probe = rng.standard_normal((100, dim))
        self.least = self.threshold(probe / np.linalg.norm(probe, axis=1, keepdims=True), list_length(side))

    def threshold(self, probe: np.ndarray, wanted: float) -> float:
        """What `wanted` filters exceed on average, found by halving; no table of all filters is made."""
        left, right = (np.sort(x, axis=1) for x in self.scores(probe))
        low, high = -2.0, 2.0
        for _ in range(30):
            middle = (low + high) / 2
            above = sum(len(b) * len(a) - np.searchsorted(b, middle - a).sum() for a, b in zip(left, right, strict=True))
            low, high = (middle, high) if above > wanted * len(probe) else (low, middle)
        return high

    def scores(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        turned = unit @ self.turn
        right = turned[:, self.cut :] if turned.shape[1] > self.cut else np.zeros((len(unit), 1))
        return turned[:, : self.cut] @ self.codes[0].T, right @ self.codes[1].T

    def decode(self, unit: np.ndarray) -> list[np.ndarray]:
        """All filters that each vector exceeds, in order; the best one if it exceeds none."""
        out = []
        for a, b in zip(*self.scores(unit), strict=True):
            i, j = np.flatnonzero(a >= self.least - b.max()), np.flatnonzero(b >= self.least - a.max())
            x, y = np.nonzero(a[i][:, None] + b[j][None, :] >= self.least)
            found = i[x] * self.side + j[y]
            out.append((found if len(found) else np.array([a.argmax() * self.side + b.argmax()])).astype(np.int32))
        return out

    def is_open(self, unit: np.ndarray, cosine: float) -> np.ndarray:
        """Whether no filter is sure to hold all vectors within `cosine` of a vector, so that links may be missed."""
        a, b = self.scores(unit)
        best = a.max(axis=1) + b.max(axis=1)  # a filter is no longer than the root of 2
        least = cosine * best - np.sqrt(max(0.0, 1 - cosine * cosine) * np.maximum(0.0, 2 - best * best))
        return (best <= 0) | (least < self.least + 1e-9)


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = TaskContext.get().partitionId() << 36
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(seen, seen + batch.num_rows)), *batch.columns], names=["uid", *batch.schema.names])
        seen += batch.num_rows


def decoded_rows(side: int, kind: str, cosine: float, complete: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, list[ProductCode]] = {}
        for big in batches:
            for off in range(0, big.num_rows, 1000):
                batch = big.slice(off, 1000)
                dims = batch.column("dim").to_numpy()
                vecs = batch.column("embedding").to_pylist()
                for dim in np.unique(dims).tolist():
                    at = np.flatnonzero(dims == dim)
                    if dim not in codes:
                        codes[dim] = [ProductCode(dim, side, k) for k in range(CODES)]
                    raw = np.array([vecs[i] for i in at], kind)
                    unit = unit_rows(raw.astype(np.float64))
                    lists = [np.concatenate([f + k * side * side for k, f in enumerate(x)]).astype(np.int32)
                             for x in zip(*(c.decode(unit) for c in codes[dim]), strict=True)]
                    sizes = np.array([len(x) for x in lists])
                    first = np.zeros(sizes.sum(), bool)
                    if complete:
                        first[np.cumsum(sizes) - sizes] = np.logical_and.reduce([c.is_open(unit, cosine) for c in codes[dim]])
                    pick = pa.array(np.repeat(at, sizes))
                    own_bytes = pa.array([u.tobytes() for u in raw], pa.binary())
                    # A row needs the filters below its own; the completion all of them.
                    below = [x.tobytes() if complete else x[:k].tobytes() for x in lists for k in range(len(x))]
                    own = pa.array(np.repeat(np.arange(len(at)), sizes))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("label").take(pick), batch.column("dim").take(pick), pa.array(np.concatenate(lists)),
                         batch.column("node").take(pick), batch.column("w").take(pick), own_bytes.take(own), pa.array(below, pa.binary()), pa.array(first)],
                        names=["label", "dim", "filter", "node", "w", "vec", "filters", "open"])

    return run


def local_components(linked: np.ndarray) -> np.ndarray:
    """The least index that each row of a symmetric link matrix reaches."""
    return least_reached(len(linked), *np.nonzero(linked))


def least_reached(size: int, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    out = np.arange(size)
    while len(rows):
        new = out.copy()
        np.minimum.at(new, rows, out[cols])
        new = new[new]
        if (new == out).all():
            break
        out = new
    return out


def bucket_links(filt: int, one_part: bool, side: np.ndarray, node: np.ndarray, w: np.ndarray, vecs: list, lists: list, kind: str, cosine: float):
    """(node, links counted here, least node connected here) of one bucket, or of one pair of its parts."""
    v = unit_rows(np.frombuffer(b"".join(vecs), kind).reshape(len(node), -1).astype(np.float64))
    linked = v @ v.T >= cosine
    np.fill_diagonal(linked, False)
    if not one_part:
        linked &= side[:, None] != side[None, :]
    if not linked.any():
        return None
    some = linked.any(1)
    node, w, linked = node[some], w[some], linked[np.ix_(some, some)]
    smaller = [(x := np.frombuffer(b, np.int32))[x < filt].tobytes() for b, s in zip(lists, some, strict=True) if s]
    x, y = np.nonzero(np.triu(linked))
    first = without_common(smaller, x, y)
    x, y = x[first], y[first]
    links = np.bincount(x, w[y], len(node)).astype(np.int64) + np.bincount(y, w[x], len(node)).astype(np.int64)
    order = np.argsort(node)
    least = np.empty(len(node), np.int64)
    least[order] = node[order][local_components(linked[np.ix_(order, order)])]
    return node, links, least


def linked_rows(kind: str, cosine: float):
    """Rows come sorted by bucket and parts; a piece of work has at most twice PART rows or so and may span batches."""
    key = ["label", "dim", "filter", "p", "q"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_groups(batches, key):
            if t.num_rows < 2:
                continue
            f, p, q = (t.column(c)[0].as_py() for c in ("filter", "p", "q"))
            got = bucket_links(f, p == q, *(t.column(c).to_numpy() for c in ("part", "node", "w")), t.column("vec").to_pylist(),
                               t.column("filters").to_pylist(), kind, cosine)
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in got], names=["node", "links", "least"])

    return run


def without_common(filters: list[bytes], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs (a, b) of rows have no filter in common."""
    lists = [np.frombuffer(x, np.int32) for x in filters]
    sizes = np.array([len(x) for x in lists])
    starts, every = np.cumsum(sizes) - sizes, np.concatenate(lists).astype(np.int64)
    if not len(every):
        return np.arange(len(a))
    known = np.sort(np.repeat(np.arange(len(lists)), sizes) << 32 | every)
    left, k = np.arange(len(a)), 0
    alone = []
    while len(left):
        over = sizes[a[left]] <= k
        alone.append(left[over])
        left = left[~over]
        key = b[left] << 32 | every[starts[a[left]] + k]
        left = left[known[np.minimum(np.searchsorted(known, key), len(known) - 1)] != key]
        k += 1
    return np.sort(np.concatenate(alone)) if alone else left


def missed_links(one_part: bool, p: int, part: np.ndarray, node: np.ndarray, w: np.ndarray, vecs: list, filters: list, kind: str, cosine: float):
    """As bucket_links, of the pairs of a block or of two blocks that no filter holds."""
    v = unit_rows(np.frombuffer(b"".join(vecs), kind).reshape(len(node), -1).astype(np.float64))
    here, there = np.flatnonzero(part == p), np.flatnonzero((part == p) == one_part)
    pairs = []
    for off in range(0, len(here), STRIPE):
        x, y = np.nonzero(v[here[off : off + STRIPE]] @ v[there].T >= cosine)
        a, b = here[x + off], there[y]
        if one_part:
            a, b = a[a < b], b[a < b]
        some = without_common(filters, a, b)
        pairs.append((a[some], b[some]))
    a, b = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (here, here)
    if not len(a):
        return None
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    order = np.argsort(node)
    rank = np.argsort(order)
    least = node[order][least_reached(len(node), rank[a], rank[b])][rank]
    links = np.zeros(len(node), np.int64)
    np.add.at(links, a, w[b])
    some = np.unique(a)
    return node[some], links[some], least[some]


def completed_rows(kind: str, cosine: float):
    """Rows come sorted by label and blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_groups(batches, ["label", "dim", "p", "q"]):
            if t.num_rows < 2:
                continue
            p, q = (t.column(c)[0].as_py() for c in ("p", "q"))
            got = missed_links(p == q, p, *(t.column(c).to_numpy() for c in ("part", "node", "w")), t.column("vec").to_pylist(),
                               t.column("filters").to_pylist(), kind, cosine)
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in got], names=["node", "links", "least"])

    return run


def embedding_links(vectors: DataFrame, cosine: float = COSINE, complete: bool = False) -> DataFrame:
    """Per row of `vectors` (vec_id, embedding, label): vec_id, n_links, component_id."""
    vectors = shelved(vectors, ("vec_id", "embedding", "label"))[0]
    raw = vectors.select("vec_id", F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = settle(raw.mapInArrow(numbered, f"uid long, vec_id {vectors.schema['vec_id'].dataType.simpleString()}, label long, embedding array<double>"), "vectors")
    broken = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~broken & F.exists("embedding", lambda x: x != 0.0)
    keys = [F.xxhash64("label", "embedding").alias("k1"), F.xxhash64(F.lit("v"), "embedding", "label").alias("k2")]
    keyed = rows.where(F.coalesce(good, F.lit(False))).select("uid", *keys)
    classes = settle(keyed.groupBy("k1", "k2").agg(F.min("uid").alias("node"), F.count(F.lit(1)).alias("w")), "classes")
    nodes = rows.join(classes, rows["uid"] == classes["node"]).select("node", "label", "w", "embedding", F.size("embedding").alias("dim"))
    largest = nodes.groupBy("label").agg(F.count(F.lit(1)).alias("c")).agg(F.max("c")).first()[0] or 0  # vectors meet within a label
    side = int(np.clip(np.ceil(np.sqrt(largest) / 4), 32, 4096))
    kind = "<f4" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"  # what the column holds, no less
    work = nodes.select("node", "label", "dim", "w", "embedding").mapInArrow(decoded_rows(side, kind, cosine, complete), WORK)
    work = settle(work, "filters")
    bucket = ["label", "dim", "filter"]
    loose = work.where("open").select("label", "dim", "node", "w", "vec", "filters") if complete else None
    work = work.drop("open")
    sizes = work.groupBy(*bucket).agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    parts = sizes.select(*bucket, F.ceil(F.col("c") / PART).cast("int").alias("s"))
    found = in_parts(work, bucket, parts, "node").mapInArrow(linked_rows(kind, cosine), "node long, links long, least long")
    if loose is not None:
        blocks = loose.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
        blocks = blocks.select("label", "dim", F.ceil(F.col("c") / BLOCK).cast("int").alias("s"))
        missed = in_parts(loose, ["label", "dim"], blocks, "node").mapInArrow(completed_rows(kind, cosine), "node long, links long, least long")
        found = found.unionByName(missed)
    found = settle(found, "links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = settle(components(found.select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()), "components")
    # Rows that link with nothing have no key and stay out of the joins.
    linkable = rows.select("uid", "vec_id").join(keyed, "uid").join(classes, ["k1", "k2"])
    linkable = linkable.join(counts, "node", "left").join(joined, "node", "left")
    alone = rows.where(~F.coalesce(good, F.lit(False))).select("vec_id", F.col("uid").alias("component"), F.lit(0).cast("long").alias("n_links"))
    named = settle(linkable.select(
        "vec_id", F.coalesce("component", "node").alias("component"),
        (F.col("w") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links")).unionByName(alone), "named")
    least = named.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    return named.join(least, "component").select("vec_id", "n_links", "component_id")
