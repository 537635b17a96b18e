"""Helpers that the operators of this folder share: keys of rows, batches of texts, word tables, ragged arrays."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes that a task works on at once, and words that a worker remembers before it starts afresh.
SLICE_BYTES = 3 << 20
WORDS_KEPT = 400_000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def row_keys(doc: str = "doc_id", text: str = "text") -> list[Column]:
    """Two 64-bit numbers, never null, that name a row by its id and text: equal rows share them, others do not."""
    return [F.xxhash64(doc, text).alias("_k1"), F.xxhash64(F.lit("row"), text, doc).alias("_k2")]


def shelved(df: DataFrame, needed: tuple[str, ...], added: tuple[str, ...] = ()) -> tuple[DataFrame, list[Column]]:
    """`df` with all columns but `needed` under numbers while an operator works, and the columns that name them again.

    So no name of the input meets one of the operator's own, in whatever case it is written. Of several columns with a
    needed name the first is meant. Columns named like one of `added` are left out: the operator's take their place."""
    inner, back, left = [], [], list(needed)
    for i, name in enumerate(df.columns):
        inner.append(name if name in left else f"_col{i}")
        if name in left:
            left.remove(name)
        if name.lower() not in added:
            back.append(F.col(inner[-1]).alias(name))
    if left:
        raise ValueError(f"no column {', '.join(left)}")
    return df.toDF(*inner), back


def with_fields(df: DataFrame, **more: str) -> T.StructType:
    """The schema of `df` with further columns, given by name and kind."""
    return T.StructType([*df.schema.fields, *(T.StructField(name, T.DataType.fromDDL(kind)) for name, kind in more.items())])


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, all other letters left. Pure ASCII takes the fast built-in, which does the same there."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` bytes of text; a longer text is a batch of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def worker_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker, so that tasks run one after the other share what they learned."""
    return sys.__dict__.setdefault("_assayline_kept", {}).setdefault(name, {})


def give_back() -> None:
    """Hands memory that is free again to the system: a worker lives on for other tasks, next to the executor's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


@contextmanager
def rows_per_batch(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is written meanwhile sends so many rows at a time to Python: for rows that are large themselves."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


class WordHashes(dict):
    """64-bit hash of a word, at least 2 (0 and 1 are padding); forgets all words when there are too many."""

    def __missing__(self, word: bytes) -> int:
        h = max(xxhash.xxh3_64_intdigest(word), 2)
        self[word] = h
        return h

    def trim(self) -> None:
        if len(self) > WORDS_KEPT:
            self.clear()


def flat(lists: list[list]) -> Iterator:
    for x in lists:
        yield from x


def bounds(lists: list[list]) -> np.ndarray:
    """Where each list starts when all are put one after the other, and where the last ends."""
    out = np.zeros(len(lists) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)), out=out[1:])
    return out


def take_ragged(values: np.ndarray, starts: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs values[starts[i]:starts[i + 1]] for each i of `index`, one after the other, and their lengths."""
    begin = starts[index]
    lengths = starts[index + 1] - begin
    shift = np.repeat(begin - (np.cumsum(lengths) - lengths), lengths)
    return values[np.arange(len(shift)) + shift], lengths


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers (in place where the array is a fresh one)."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def odd_numbers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def runs_hash(h: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Hash of each run of k neighbours; one for each place, the last k - 1 of no meaning."""
    out = np.zeros(len(h), np.uint64)
    for j, odd in enumerate(odd_numbers(k, seed)):
        out[: max(len(h) - j, 0)] += h[j:] * odd
    return mix(out)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key, of rows that come sorted by whole numbers; a key may span batches."""
    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        if not t.num_rows:
            continue
        same = np.ones(t.num_rows - 1, bool)
        for c in keys:
            x = t.column(c).to_numpy()
            same &= x[1:] == x[:-1]
        cuts = [0, *(np.flatnonzero(~same) + 1).tolist()]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield t.slice(a, b - a)
        rest = t.slice(cuts[-1])
    if rest is not None and rest.num_rows:
        yield rest


def in_parts(rows: DataFrame, bucket: list[str], parts: DataFrame, node: str) -> DataFrame:
    """Cuts crowded buckets for work on pairs of parts. parts: bucket columns and `s`, the number of parts.

    A row of part `part` is laid out once for every part it meets, under (p, q) with p <= q; each pair of parts is a
    piece of work of its own, and rows come sorted by it."""
    rows = rows.join(parts, bucket).withColumn("part", F.pmod(F.xxhash64(node), F.col("s")).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
    rows = rows.withColumns({"p": F.least("part", "o"), "q": F.greatest("part", "o")}).drop("o", "s")
    return rows.repartition(*bucket, "p", "q").sortWithinPartitions(*bucket, "p", "q")


def with_columns(batch: pa.RecordBatch, **more: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *more.values()], names=[*batch.schema.names, *more])


def shuffle_parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
