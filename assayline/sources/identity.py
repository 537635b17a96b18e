"""Which file is meant by a name: two lists of paths matched by what their ends have in common.

A listing and a manifest name the same file below different folders, so neither whole paths nor names below some common
folder can be compared. Two paths belong together if the longest end they share, in whole path parts, is shared by no
third path. Ends are compared from the longest to the file name; what is matched at one length is out of the way at the
next, so `x` and `a/x` find `x` and `a/x`, whatever folders stand above. Each length is an aggregation and a join of short
rows; equal names in very many folders make no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayline.session import discard, settle

MATCHED, AMBIGUOUS, MISSING = "matched", "ambiguous", "missing"


def path_parts(path: Column) -> Column:
    """The parts of a path or address, without scheme and host, without empty parts and single dots."""
    plain = F.regexp_replace(path, "^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", "")
    return F.filter(F.split(plain, "/"), lambda p: (p != "") & (p != "."))


def _ends(paths: DataFrame, length: int) -> DataFrame:
    """The paths that have as many parts, with their last `length` ones."""
    parts = path_parts(F.col("path"))
    return paths.where(F.size(parts) >= length).select("path", F.array_join(F.slice(parts, F.lit(-length), F.lit(length)), "/").alias("end"))


def _alone(paths: DataFrame, length: int, name: str) -> DataFrame:
    """(end, name): the ends that only one path has."""
    ends = _ends(paths, length).groupBy("end").agg(F.min("path").alias(name), F.count("*").alias("n"))
    return ends.where("n = 1").drop("n")


def match_paths(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """wanted (path), found (path): (wanted, found, state) for every distinct wanted path.

    `ambiguous` means that the file name is there but more than one wanted or found path could be meant; nothing is chosen
    then, and `found` is NULL as for a missing one. NULL paths are left out.
    """
    open_wanted = settle(wanted.select("path").where("path IS NOT NULL").distinct(), "wanted")
    open_found = settle(found.select("path").where("path IS NOT NULL").distinct(), "found")
    deepest = open_wanted.agg(F.max(F.size(path_parts(F.col("path"))))).first()[0] or 0
    pairs = None
    for length in range(deepest, 0, -1):
        pair = _alone(open_wanted, length, "wanted").join(_alone(open_found, length, "found"), "end").select("wanted", "found")
        pair = settle(pair, "pairs")
        if pair.isEmpty():
            discard(pair)
            continue
        left = (open_wanted, open_found)
        open_wanted = settle(open_wanted.join(pair, open_wanted["path"] == pair["wanted"], "left_anti"), "wanted")
        open_found = settle(open_found.join(pair, open_found["path"] == pair["found"], "left_anti"), "found")
        discard(*left)
        pairs = pair if pairs is None else pairs.unionByName(pair)
    names = _ends(open_found, 1).select("end").distinct().withColumn("there", F.lit(True))
    rest = _ends(open_wanted, 1).join(names, "end", "left").select(
        F.col("path").alias("wanted"), F.lit(None).cast("string").alias("found"),
        F.when(F.col("there"), AMBIGUOUS).otherwise(MISSING).alias("state"))
    return rest if pairs is None else pairs.withColumn("state", F.lit(MATCHED)).unionByName(rest)
