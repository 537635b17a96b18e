"""Where each row comes from: file, revision and hash of its shard, and the steps it went through."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayline.sources.identity import match_paths
from assayline.vocabulary import METADATA_KEY


def source_file(root: str) -> Column:
    """Path of a row's file below `root`, the whole path if it lies elsewhere. Only on a DataFrame that is a plain scan."""
    path, root = _decoded(F.col("_metadata.file_path")), root.rstrip("/") + "/"
    return F.when(F.instr(path, root) > 0, F.substr(path, F.instr(path, F.lit(root)) + len(root))).otherwise(path)


def scanned_paths(scan: DataFrame) -> DataFrame:
    """(path): the files behind a plain scan, which its plan lists already."""
    paths = [(p,) for p in scan.inputFiles()]
    return scan.sparkSession.createDataFrame(paths, "path string").select(_decoded(F.col("path")).alias("path"))


def _decoded(path: Column) -> Column:
    """A path as plain text; local ones are written with one slash or with three."""
    return F.regexp_replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "^file:/+", "file:///")


def with_lineage(scan: DataFrame, shards: DataFrame, root: str, steps: Iterable[str] = (), document: str = "document_id",
                 keys: tuple[str, ...] = METADATA_KEY) -> DataFrame:
    """`scan` with a column `lineage`: file, revision, shard_hash, document_id, key (an array), steps (an array).

    `shards` is `manifest_shards` (one row per file); a file of the scan and a shard are the same if the ends of their paths
    say so (`identity.match_paths`). Then `file` is the manifest's name, else the path below `root`. Rows of files that the
    manifest does not list, or not without doubt, stay, with NULL revision and hash. Columns of `scan` that are called
    `lineage` are replaced, all others are carried along.
    """
    shards = shards if "path" in shards.columns else shards.withColumn("path", F.col("file"))
    meant = match_paths(shards, scanned_paths(scan)).where(F.col("found").isNotNull())
    known = meant.join(shards, meant["wanted"] == shards["path"]).groupBy(F.col("found").alias("_path")).agg(
        F.min(F.struct("file", "revision", "expected_sha256")).alias("_shard"))
    carried = [c for c in scan.columns if c != "lineage"]
    done = F.array(*[F.lit(s) for s in steps]).cast("array<string>")
    traced = scan.select(*carried, source_file(root).alias("_file"), _decoded(F.col("_metadata.file_path")).alias("_path"))
    return traced.join(known, "_path", "left").select(*carried, F.struct(
        F.coalesce("_shard.file", "_file").alias("file"), F.col("_shard.revision").alias("revision"),
        F.col("_shard.expected_sha256").alias("shard_hash"), F.col(document).cast("string").alias("document_id"),
        F.array(*[F.col(k).cast("string") for k in keys]).alias("key"), done.alias("steps")).alias("lineage"))
