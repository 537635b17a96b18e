"""Newly landed search items merged into a snapshot, in one batch or as a stream.

An item counts as known if the snapshot has its id, or else its whole key. NULL never equals NULL: an item without id is
only looked up by its key, one without id and without a whole key is kept as it is. Of items that repeat an id, the first
in page order stays. Rows with NULL ids or keys are taken out before the joins, so they do not meet in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayline.functions.dates import local_date
from assayline.operators.matching import absent
from assayline.sources.landed import page_items
from assayline.spec import SEARCH_PAGE, CorpusMap
from assayline.vocabulary import METADATA_KEY

#: Keys whose rows are handed back from a Python worker at once.
PART = 10_000


def landed_records(pages: DataFrame, source: str, zone: str = "Europe/Istanbul") -> DataFrame:
    """Items of landed pages in the columns of the corpus; text and what comes from it are NULL. `_order` is page order."""
    items = page_items(pages)
    day = local_date(F.col("kararTarihi"), zone)
    record = CorpusMap({
        "id": F.concat(F.lit(f"{source}:"), F.col("documentId")), "source": F.lit(source), "document_id": F.col("documentId"),
        "court": F.col("birimAdi"), "esas_no": F.col("esasNo"), "karar_no": F.col("kararNo"),
        "karar_tarihi": F.date_format(day, "yyyy-MM-dd"), "year": F.year(day), "month": F.month(day)})
    return items.select(*record.listed(), F.struct(F.col("start").isNull(), "start", "position").alias("_order"))


def first_per_id(records: DataFrame) -> DataFrame:
    """One row per document_id, the first by `_order`, then by its other values; rows without id all stay."""
    values = [c for c in records.columns if c != "_order"]
    has_id = F.col("document_id").isNotNull()
    first = records.where(has_id).groupBy("document_id").agg(F.min(F.struct("_order", *values)).alias("first"))
    return first.select(*[F.col(f"first.{c}").alias(c) for c in values]).unionByName(records.where(~has_id).select(*values))


def new_records(snapshot: DataFrame, records: DataFrame, keys: tuple[str, ...] = METADATA_KEY) -> DataFrame:
    """Landed records that the snapshot has neither by id nor by key."""
    return absent(absent(first_per_id(records), snapshot, ("document_id",)), snapshot, keys)


def merge_delta(snapshot: DataFrame, records: DataFrame, keys: tuple[str, ...] = METADATA_KEY) -> DataFrame:
    """The snapshot with the new records below it; rows of the snapshot stay as they are, repeats included."""
    return snapshot.unionByName(new_records(snapshot, records, keys))


def page_place() -> Column:
    """`_order` as text that sorts in page order: pages without a start last, then start, position, and the record itself."""
    start, position = (F.coalesce(F.col(f"_order.{c}"), F.lit(-1)).cast("bigint") + 1 for c in ("start", "position"))
    return F.concat(F.when(F.col("_order.start").isNull(), "1").otherwise("0"), F.lpad(start.cast("string"), 19, "0"),
                    F.lpad(position.cast("string"), 19, "0"), F.to_json(F.struct("document_id", "court", "esas_no", "karar_no", "karar_tarihi")))


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams that start meanwhile keep their state in RocksDB, on disk and not on the heap."""
    name, kind = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name)
    spark.conf.set(name, kind)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _by_key(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], first: bool) -> Iterator[pa.RecordBatch]:
    """One row for every key of a part: whether a row of `known` has it, and its rows in page order, or the first of them."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    rows = pa.Table.from_batches(parts).combine_chunks().sort_by([(k, "ascending") for k in (*keys, "page_place")])
    # Rows of a key follow each other; its first one has another key than the row before.
    differs = [pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)) for c in (rows.column(k).combine_chunks() for k in keys)]
    starts = np.concatenate([[0], np.flatnonzero(reduce(pc.or_, differs)) + 1]).astype(np.int64)
    if first:
        rows = rows.take(starts)
        starts = np.arange(len(starts), dtype=np.int64)
    held = rows.select([c for c in rows.column_names if c != "_known"]).to_struct_array().combine_chunks()
    known = rows.column("_known").take(starts).combine_chunks()
    for at in range(0, len(starts), PART):  # the rows of at most so many keys at once
        ends = np.append(starts[at:at + PART + 1], [rows.num_rows] if at + PART >= len(starts) else [])
        some = held.slice(ends[0], ends[-1] - ends[0])
        grouped = pa.ListArray.from_arrays(pa.array(ends - ends[0], pa.int32()), some)
        named = [rows.column(k).take(starts[at:at + PART]).combine_chunks() for k in keys]
        yield pa.RecordBatch.from_arrays([*named, known.slice(at, PART), grouped], [*keys, "_known", "_rows"])


def _once(records: DataFrame, keys: tuple[str, ...], known: DataFrame, first: bool) -> DataFrame:
    """The streamed records whose key is in no earlier batch and not among the rows of `known`; those without a whole key all.

    With `first`, only the first record of a key by page order. The rows of a key that land together are gathered before the
    state store is asked, so that Spark's own `dropDuplicates` decides on one row per key. `known` is a stream too, which has
    rows in the first batch only; its rows stand first in page order.
    """
    whole = " AND ".join(f"`{k}` IS NOT NULL" for k in keys)
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in records.schema.fields if f.name not in (*keys, "page_place")]
    seeds = known.where(whole).select(*keys, *blank, F.lit("").alias("page_place"), F.lit(True).alias("_known"))
    both = records.where(whole).withColumn("_known", F.lit(False)).unionByName(seeds)
    shape = T.StructType([*(both.schema[k] for k in keys), T.StructField("_known", T.BooleanType()), T.StructField("_rows", T.ArrayType(
        T.StructType([f for f in both.schema.fields if f.name != "_known"])))])
    gathered = both.repartition(*keys).mapInArrow(lambda batches: _by_key(batches, keys, first), shape)
    new = gathered.dropDuplicates(list(keys)).where("NOT _known").select(F.inline("_rows")).select(*records.columns)
    return new.unionByName(records.where(f"NOT ({whole})"))


def _seeds(known: DataFrame, folder: str) -> DataFrame:
    """The rows of `known` as a stream of the files in `folder`, which are written once, when the folder is new."""
    spark = known.sparkSession
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        known.write.mode("overwrite").parquet(folder)
    return spark.readStream.schema(known.schema).parquet(folder)


def delta_stream(spark: SparkSession, landed: str, snapshot: DataFrame, sink: str, checkpoint: str, source: str,
                 keys: tuple[str, ...] = METADATA_KEY, zone: str = "Europe/Istanbul") -> DataFrame:
    """Reads the pages landed since the last run, adds what is new to `sink` (Parquet) and returns the sink.

    Ids and keys that were there are remembered in the stream's own state (a RocksDB state store in `checkpoint`, cut by key
    over the shuffle partitions), so a batch costs what its own rows cost, however much has landed before: snapshot and sink
    are read once, when a checkpoint is new; their ids and keys are written to `known` in it and join the first batch. Each batch has a folder of its own in the sink, named by
    `checkpoint` and its number, which a batch that is run again after a failure replaces, so nothing is added twice.

    Of items that repeat an id the first one counts, in page order within a batch; if its key was there in an earlier batch
    or the snapshot, none of them is added. Pages that land together give the rows of `new_records`. With a new
    `checkpoint`, all pages come again, and rows without id and whole key are added once more. The schema of `sink` is that
    of the snapshot. `checkpoint` and `sink` must be in folders that all executors reach.
    """
    mark = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    spark.createDataFrame([], snapshot.schema).write.mode("overwrite").parquet(f"{sink}/batch=none")

    def held() -> DataFrame:
        return spark.read.schema(snapshot.schema).parquet(sink)

    columns = snapshot.columns
    records = landed_records(spark.readStream.schema(SEARCH_PAGE).json(landed), source, zone)
    # What this checkpoint itself has written is in its state; a first batch that is run again must not find its own rows.
    others = held().where(~F.startswith("batch", F.lit(f"{mark}-")))
    named = list(dict.fromkeys(["document_id", *keys]))
    known = _seeds(snapshot.select(*named).unionByName(others.select(*named)), f"{checkpoint}/known")
    fresh = _once(_once(records.withColumn("page_place", page_place()).drop("_order"), ("document_id",), known, True), keys, known, False)

    def add(batch: DataFrame, number: int) -> None:
        batch.select(*columns).write.mode("overwrite").parquet(f"{sink}/batch={mark}-{number}")

    with state_store(spark):
        query = (fresh.writeStream.outputMode("append").foreachBatch(add)
                 .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        query.awaitTermination()
    return held().select(*columns)
