"""Line dedup: explode normalised lines, hash, count distinct documents per hash, drop frequent lines, reassemble.

Built-in functions only. A line's key is the line without white space at both ends and with A-Z lower-cased. Only 128-bit
hashes of keys are shuffled for counting: first one row per (key, document), then one partial count per task and key, so a
line that a third of all documents share is one row per task. The join that finds the documents that lose a line has one
row per key on its other side, and Spark splits hot keys there. Texts are shuffled once, by document. The keys that a
document loses are sorted and each of its lines is looked up by halving, so very long documents cost little more per line.

Null or empty text: one empty line. A null id counts as one document, smaller than all others. Rows that repeat an id are
one document: they lose the same keys. Lines below `min_chars` always stay. Other columns are carried along,
whatever their names; those named `_n_lines` or `_n_dropped` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayline.llm.common import ascii_lower, shelved

#: Fixed values of the contract: white space that is stripped; shortest key in code points; documents that make it frequent.
BLANK = " \t\n\x0b\x0c\r"
MIN_CHARS = 20
MIN_DOCS = 3


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANK)))


def key_hash(key: Column) -> Column:
    """128 bits: the second hash is seeded by another value, so the two are independent."""
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit("line"), key).alias("b"))


def document_keys(text: Column, min_chars: int) -> Column:
    keys = F.filter(F.transform(lines(text), line_key), lambda k: F.char_length(k) >= min_chars)
    return F.transform(keys, key_hash)


def frequent_keys(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """(key, document) pairs, and the keys found in at least `min_docs` documents with the largest document id."""
    pairs = docs.select(F.col("doc_id").alias("_doc"), F.explode(document_keys(F.col("text"), min_chars)).alias("_h"))
    pairs = pairs.select("_doc", "_h.a", "_h.b").distinct()
    frequent = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("_n"), F.max("_doc").alias("_keeper"))
    return pairs, frequent.where(F.col("_n") >= min_docs).select("a", "b", "_keeper")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """All columns of `docs` with the text after dropping; `_n_lines` before and `_n_dropped` are added."""
    docs, back = shelved(docs, ("doc_id", "text"), ("_n_lines", "_n_dropped"))
    pairs, frequent = frequent_keys(docs, min_chars, min_docs)
    loses = pairs.join(frequent, ["a", "b"]).where(~F.col("_doc").eqNullSafe(F.col("_keeper")))
    loses = loses.groupBy("_doc").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("_loses"))
    # Steps of a search by halving: powers of two, from the largest that fits down to 1.
    loses = loses.withColumn("_steps", F.transform(
        F.sequence(F.floor(F.log2(F.size("_loses"))).cast("int"), F.lit(0)), lambda k: F.call_function("shiftleft", F.lit(1), k)))
    joined = docs.join(loses, docs["doc_id"].eqNullSafe(loses["_doc"]), "left")

    def stays(x: Column) -> Column:
        h = x["h"]

        def halve(at: Column, step: Column) -> Column:
            return F.when(F.coalesce(F.get("_loses", at + step - 1) <= h, F.lit(False)), at + step).otherwise(at)

        at = F.aggregate("_steps", F.lit(0), halve)  # how many of the sorted keys are not above this one
        return h.isNull() | F.coalesce(F.get("_loses", at - 1) != h, F.lit(True))

    all_lines = lines(F.col("text"))
    keyed = F.transform(all_lines, lambda x: F.struct(x.alias("line"), line_key(x).alias("key")))
    hashed = F.transform(keyed, lambda x: F.struct(
        x["line"].alias("line"), F.when(F.char_length(x["key"]) >= min_chars, key_hash(x["key"])).alias("h")))
    kept = F.when(F.col("_loses").isNull(), all_lines).otherwise(F.transform(F.filter(hashed, stays), lambda x: x["line"]))
    done = joined.withColumns({"_n_lines": F.size(all_lines).cast("long"), "_kept": kept})
    done = done.withColumns({
        "_n_dropped": F.col("_n_lines") - F.size("_kept"),
        "text": F.when(F.col("_loses").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join("_kept", "\n"))})
    return done.select(*back, "_n_lines", "_n_dropped")
