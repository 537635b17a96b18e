"""Sharding by a permutation-filled lookup table.

Every shard has a permutation of the slots of a table of prime size, given by an offset and a step taken from its name.
Shards take turns and each claims the next free slot of its own order, so all get the same number of slots within one, and
when a shard is added or goes, few other slots change hands. A document's slot is the hash of its id modulo the size; the
table (`SLOTS` rows, whatever the input) is broadcast, so placing needs no shuffle and constant time.

A null id is placed as the text "null". Rows that repeat an id are in one shard. Other columns are carried along, whatever
their names; those named `_slot` or `_shard` are replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayline.llm.common import shelved, shuffle_parts

SLOTS = 65537
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def fill(shards: tuple[str, ...], slots: int = SLOTS) -> list[int]:
    """For each slot the index of its shard."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must have names, each of its own")
    if slots < len(shards) or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime and not below that of shards")
    digest = [hashlib.md5(s.encode()).digest() for s in shards]
    place = [int.from_bytes(d[:8], "big") % slots for d in digest]
    step = [int.from_bytes(d[8:], "big") % (slots - 1) + 1 for d in digest]
    table, taken = [-1] * slots, 0
    while True:
        for i in range(len(shards)):
            while table[place[i]] >= 0:
                place[i] = (place[i] + step[i]) % slots
            table[place[i]] = i
            taken += 1
            if taken == slots:
                return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    text = F.coalesce(key.cast("string"), F.lit("null"))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def lookup(spark: SparkSession, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    return spark.createDataFrame([(i, shards[s]) for i, s in enumerate(fill(shards, slots))], "_slot int, _shard string")


def place(df: DataFrame, key: str = "doc_id", shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """All rows of `df` with `_slot` and `_shard`."""
    df, back = shelved(df, (key,), ("_slot", "_shard"))
    at = df.withColumn("_slot", slot_of(F.col(key), slots))
    return at.join(F.broadcast(lookup(df.sparkSession, shards, slots)), "_slot").select(*back, "_slot", "_shard")


def write_shards(df: DataFrame, path: str, key: str = "doc_id", shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> None:
    """One folder per shard. Rows go to tasks by shard and a further part of their slot, so a shard is not one task."""
    placed = place(df, key, shards, slots)
    split = max(1, -(-shuffle_parts(df) // len(shards)))
    placed.repartition(shuffle_parts(df), "_shard", F.pmod(F.xxhash64("_slot"), F.lit(split))).write.partitionBy("_shard").parquet(path)


def read_shards(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    kinds = T.StructType([*(f for f in like.schema.fields if f.name.lower() not in ("_slot", "_shard")), T.StructField("_slot", T.IntegerType()), T.StructField("_shard", T.StringType())])
    return spark.read.schema(kinds).parquet(path)
