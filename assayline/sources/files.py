"""Files as units: listing, footers, schemas, content hashes, manifest.

Spark lists the files and hands them out; each task opens only its own files.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.sources.identity import MISSING, match_paths
from assayline.spec import MANIFEST

_CHUNK = 8 << 20
_SAFE = "/:@=,;!$&'()*"


def list_files(spark: SparkSession, *globs: str) -> DataFrame:
    """path, file, size_bytes. The content column is never asked for, so no data is read.

    `file` is the path below the folder that all globs share, so files of equal names in two folders stay two files.
    """
    root = common_folder([_fixed_part(g) for g in globs])
    path = F.col("path")
    below = F.when(F.instr(path, root) > 0, F.substr(path, F.instr(path, root) + len(root)))
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(globs)).select(
        "path", F.coalesce(below, path).alias("file"), F.col("length").alias("size_bytes")
    )


def _fixed_part(glob: str) -> str:
    """A glob up to the folder before its first pattern, without scheme; a name without suffix is a folder."""
    path = re.sub("^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", "", glob)
    head = re.split(r"[*?{\[]", path, maxsplit=1)[0]
    if head == path and "." not in path.rpartition("/")[2]:
        return path.rstrip("/") + "/"
    return head.rpartition("/")[0] + "/"


def common_folder(paths: list[str]) -> str:
    """The longest folder, with its last slash, that all paths share."""
    return os.path.commonprefix(paths).rpartition("/")[0] + "/" if paths and "/" in os.path.commonprefix(paths) else ""


def spread(files: DataFrame) -> DataFrame:
    """One file per task as far as the cluster has tasks: opening a file costs more than moving its name."""
    return files.repartition(files.sparkSession.sparkContext.defaultParallelism, "path")


def _open(path: str):
    """Opens a file that Spark listed; its names are plain text there, blanks and percent signs included."""
    from pyarrow import fs

    scheme, _, rest = re.sub("^file:/(?!/)", "file:///", path).partition("://")
    system, place = fs.FileSystem.from_uri(f"{scheme}://{quote(rest, safe=_SAFE)}")
    return system.open_input_file(place)


def _footers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import pyarrow.parquet as pq

    for batch in batches:
        rows = []
        for uri, name, size in zip(batch["path"], batch["file"], batch["size_bytes"]):
            with _open(uri) as handle:
                meta = pq.ParquetFile(handle).metadata
                rows.append((name, meta.num_rows, meta.num_row_groups, size))
        yield pd.DataFrame(rows, columns=["file", "rows", "row_groups", "size_bytes"])


def _schemas(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import pyarrow.parquet as pq

    for batch in batches:
        rows = []
        for uri, name in zip(batch["path"], batch["file"]):
            with _open(uri) as handle:
                for k, f in enumerate(pq.ParquetFile(handle).schema_arrow):
                    rows.append((name, k, f.name, str(f.type), f.nullable))
        yield pd.DataFrame(rows, columns=["file", "position", "column", "type", "nullable"])


def _hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for uri, name, size in zip(batch["path"], batch["file"], batch["size_bytes"]):
            digest = hashlib.sha256()
            with _open(uri) as handle:
                while block := handle.read(_CHUNK):
                    digest.update(block)
            rows.append((uri, name, size, digest.hexdigest()))
        yield pd.DataFrame(rows, columns=["path", "file", "size_bytes", "sha256"])


def file_inventory(spark: SparkSession, *globs: str) -> DataFrame:
    """file, rows, row_groups, size_bytes from Parquet footers; no data page is read."""
    return spread(list_files(spark, *globs)).mapInPandas(
        _footers, "file string, rows bigint, row_groups bigint, size_bytes bigint"
    )


def file_schemas(spark: SparkSession, *globs: str) -> DataFrame:
    """One row per file and column."""
    return spread(list_files(spark, *globs)).mapInPandas(
        _schemas, "file string, position int, column string, type string, nullable boolean"
    )


def schema_strings(schemas: DataFrame) -> DataFrame:
    """file -> its whole schema as one text (a file has few columns, so a group is small)."""
    part = F.concat_ws(" ", "column", "type", F.col("nullable").cast("string"))
    return schemas.groupBy("file").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", part.alias("p")))),
                                 lambda s: s["p"]), ", ").alias("schema")
    )


def schemas_identical(schemas: DataFrame) -> DataFrame:
    return schema_strings(schemas).agg(
        F.count("*").alias("files"),
        F.count_distinct("schema").alias("distinct_schemas"),
        (F.count_distinct("schema") == 1).alias("schemas_identical"),
    )


def file_hash(spark: SparkSession, *globs: str) -> DataFrame:
    """path, file, size_bytes, sha256. Files are streamed in chunks, so size has no limit."""
    return spread(list_files(spark, *globs)).mapInPandas(
        _hashes, "path string, file string, size_bytes bigint, sha256 string"
    )


def file_totals(inventory: DataFrame) -> DataFrame:
    return inventory.agg(
        F.count("*").alias("files"), F.sum("rows").alias("rows"),
        F.sum("row_groups").alias("row_groups"), F.sum("size_bytes").alias("size_bytes"),
    )


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest as one nested row."""
    return spark.read.schema(MANIFEST).option("multiLine", True).json(path)


def manifest_shards(manifest: DataFrame) -> DataFrame:
    """One row per expected shard; `file` is its path below the folder that all shards of the manifest share."""
    paths = F.transform("shards", lambda s: s["path"])
    ends = F.array(F.array_min(paths), F.array_max(paths))
    parts = F.transform(ends, lambda p: F.slice(F.split(p, "/"), F.lit(1), F.size(F.split(p, "/")) - 1))
    same = F.zip_with(parts[0], parts[1], lambda a, b: F.coalesce(a == b, F.lit(False)))
    depth = F.when(F.array_position(same, False) > 0, F.array_position(same, False) - 1).otherwise(F.size(same))
    shard = manifest.select("revision", depth.cast("int").alias("depth"), F.explode("shards").alias("s"))
    names = F.split(F.col("s.path"), "/")
    return shard.select(
        "revision", F.col("s.path").alias("path"),
        F.array_join(F.slice(names, F.col("depth") + 1, F.size(names)), "/").alias("file"),
        F.col("s.size_bytes").alias("expected_size"), F.col("s.lfs_sha256").alias("expected_sha256"),
    )


def match_manifest(files: DataFrame, shards: DataFrame) -> DataFrame:
    """Expected shards with what was found: file, file_exists, size_matches, sha256_matches, state.

    A shard and a file are the same if the ends of their paths say so (`identity.match_paths`), below whatever folders they
    were listed. A missing file stays visible; so does one that several could be (`state` is `ambiguous`), as not found.
    """
    meant = match_paths(shards, files)
    seen = files.select(F.col("path").alias("found"), "size_bytes", "sha256").dropDuplicates(["found"])
    met = shards.join(meant, shards["path"] == meant["wanted"], "left").drop("path").join(seen, "found", "left")
    return met.select(
        "file",
        F.col("sha256").isNotNull().alias("file_exists"),
        F.coalesce(F.col("size_bytes") == F.col("expected_size"), F.lit(False)).alias("size_matches"),
        F.coalesce(F.col("sha256") == F.col("expected_sha256"), F.lit(False)).alias("sha256_matches"),
        F.coalesce("state", F.lit(MISSING)).alias("state"),
    )
