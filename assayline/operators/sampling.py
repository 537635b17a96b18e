"""Deterministic samples and ranked lists.

A ranked list over a huge table meets two limits: every task hands its own best rows to the next step, and one group
may hold most rows. So the best rows are merged in two rounds (`top_k`, `top_n_per_group`), and where many rows are
wanted, counts per hash prefix first find the part of the table that can hold them (`hash_cut`).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayline.functions.predicates import in_years
from assayline.functions.text import court_group, let, lower_tr, stable_hash
from assayline.operators.late import ADDRESS, addressed, as_scan, fetch, narrow_first
from assayline.session import settle
from assayline.vocabulary import (
    MIDDLE, MIDDLE_PER_YEAR, MIDDLE_YEARS, MODERN, MODERN_PER_YEAR, MODERN_YEARS, OLD, OLD_TOTAL, PLACEHOLDERS,
    REVIEW_COLUMNS, SAMPLE_SEED, SHORT_LIMITS, SHORT_TEXT, VERIFY_ALLOCATION,
)

#: The wide column of a corpus: it is fetched for picked rows, never ranked.
TEXT = "text"
_LISTED = ("id", "document_id", "court", "esas_no", "karar_no", "karar_tarihi", "year")
FAN_IN = 256
PREFIX = 4

Limits = Mapping[int, int] | Mapping[str, int]


def _limit_of(group: str, limits: Limits) -> Column:
    """Limit of a row's group; 0 for a group that is not asked for."""
    pairs = ", ".join(f"{g!r}, {n}" for g, n in limits.items())
    return F.expr(f"coalesce(map({pairs})[{group}], 0)")


def top_k(df: DataFrame, k: int, *order: Column, fan_in: int = FAN_IN) -> DataFrame:
    """First `k` rows in total order. Tasks are merged in `fan_in` parts before the last step."""
    part = df.withColumn("_part", F.spark_partition_id() % fan_in)
    w = W.partitionBy("_part").orderBy(*order)
    best = part.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_part", "_rn")
    return best.orderBy(*order).limit(k)


def top_n_per_group(df: DataFrame, group: str, limits: Limits | int, *order: Column, fan_in: int = FAN_IN,
                    rank: str = "_rn") -> DataFrame:
    """First rows of each group, with their rank. A hot group is cut in `fan_in` parts first, then merged."""
    most = limits if isinstance(limits, int) else max(limits.values())
    limit = F.lit(limits) if isinstance(limits, int) else _limit_of(group, limits)

    def keep(rows: DataFrame, *keys: str) -> DataFrame:
        w = W.partitionBy(*keys).orderBy(*order)
        return rows.withColumn(rank, F.row_number().over(w)).where((F.col(rank) <= most) & (F.col(rank) <= limit))

    parts = keep(df.withColumn("_part", F.spark_partition_id() % fan_in), group, "_part")
    return keep(parts.drop("_part"), group)


def hash_cut(df: DataFrame, group: str, limits: Limits, hashed: str = "_h") -> DataFrame:
    """Drops rows whose hash prefix lies behind the lowest hashes wanted from their group.

    Counts per (group, prefix) need only the id: at most 65,536 rows per group. What is left is the sample and the
    rest of one prefix, whatever the size of the table. The cut has one row per group asked for, so it is broadcast.
    The hash must not be NULL (`hash_of`): rows without an id come last in it, so they never push others out.
    """
    prefix = F.substring(hashed, 1, PREFIX)
    wanted = df.where(F.col(group).isin(list(limits)))
    counts = wanted.groupBy(F.col(group).alias("_g"), prefix.alias("_p")).agg(F.count("*").alias("_n"))
    w = W.partitionBy("_g").orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    cut = before.where(F.col("_before") < _limit_of("_g", limits)).groupBy("_g").agg(F.max("_p").alias("_last"))
    return wanted.join(F.broadcast(cut), (F.col(group) == F.col("_g")) & (prefix <= F.col("_last")), "left_semi")


def hash_of(hashed: Column) -> Column:
    """A hash in hex; "g", which sorts behind all hex digits, where there is nothing to hash."""
    return F.coalesce(hashed, F.lit("g"))


def ranked_sample(df: DataFrame, group: str, limits: Limits, id_column: str = "id", rank: str = "_rn") -> DataFrame:
    """First rows of each group in hash order of the id, ties by id, NULL ids last, with their rank. Give it narrow rows."""
    hashed = df.withColumn("_h", hash_of(stable_hash(F.col(id_column))))
    cut = hash_cut(hashed, group, limits)
    return top_n_per_group(cut, group, limits, F.col("_h"), F.col(id_column).asc_nulls_last(), rank=rank).drop("_h")


def top_n_per_year(df: DataFrame, n: int, years: tuple[int, int], id_column: str = "id") -> DataFrame:
    def pick(rows: DataFrame) -> DataFrame:
        grouped = rows.where(in_years("year", years)).withColumn("_group", F.col("year").cast("int"))
        return ranked_sample(grouped, "_group", limits, id_column).drop("_group", "_rn")

    limits = {y: n for y in range(years[0], years[1] + 1)}
    return narrow_first(df, pick, TEXT)


def top_n_global(df: DataFrame, n: int, id_column: str = "id") -> DataFrame:
    def pick(rows: DataFrame) -> DataFrame:
        return ranked_sample(rows.withColumn("_group", F.lit(0)), "_group", {0: n}, id_column).drop("_group", "_rn")

    return narrow_first(df, pick, TEXT)


def top_n_per_stratum(df: DataFrame, limits: Limits, id_column: str = "id") -> DataFrame:
    """`modern` is 1 inside the modern years, else 0 (a missing year counts as historical)."""
    def pick(rows: DataFrame) -> DataFrame:
        return ranked_sample(rows.withColumn("modern", modern_flag()), "modern", limits, id_column).drop("_rn")

    return narrow_first(df, pick, TEXT)


def modern_flag() -> Column:
    return F.when(in_years("year", MODERN_YEARS), 1).otherwise(0)


def stratum_sizes(sample: DataFrame, stratum: str = "modern") -> DataFrame:
    return sample.groupBy(stratum).agg(F.count("*").alias("rows"))


def with_strata(rows: DataFrame) -> DataFrame:
    """The stratum of a sampled row's year, and the group of its court."""
    year = F.col("year").cast("int")
    return rows.withColumns({
        "stratum": F.when(in_years(year, MODERN_YEARS), MODERN).when(in_years(year, MIDDLE_YEARS), MIDDLE).otherwise(OLD),
        "court_group": court_group(F.col("court")),
    })


def stratified_sample(df: DataFrame, id_column: str = "id") -> DataFrame:
    """A fixed number per modern year and per middle year, and a fixed number of all older rows, tagged by stratum.

    One pass serves the three strata: older rows are one group next to the years.
    """
    year = F.col("year").cast("int")

    def pick(df: DataFrame) -> DataFrame:
        rows = df.where(F.col("year") <= MODERN_YEARS[1]).withColumn(
            "_group", F.when(year < MIDDLE_YEARS[0], 0).otherwise(year))
        return with_strata(ranked_sample(rows, "_group", limits, id_column).drop("_group", "_rn"))

    limits = {0: OLD_TOTAL}
    limits |= {y: MIDDLE_PER_YEAR for y in range(MIDDLE_YEARS[0], MIDDLE_YEARS[1] + 1)}
    limits |= {y: MODERN_PER_YEAR for y in range(MODERN_YEARS[0], MODERN_YEARS[1] + 1)}
    return narrow_first(df, pick, TEXT)


def sample_order(id_column: str = "id") -> tuple[Column, ...]:
    """Order of a written sample: year, hash, id inside a stratum."""
    return F.col("year").asc_nulls_last(), hash_of(stable_hash(F.col(id_column))), F.col(id_column).asc_nulls_last()


def reservoir_sample(df: DataFrame, n: int = 100, seed: int = SAMPLE_SEED, id_column: str = "id") -> DataFrame:
    """`n` rows, all equally likely over seeds, the same for one seed."""
    drawn = hash_of(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_column).cast("string"))))
    limits = {0: n}

    def pick(rows: DataFrame) -> DataFrame:
        cut = hash_cut(rows.withColumns({"_group": F.lit(0), "_h": drawn}), "_group", limits)
        return top_n_per_group(cut, "_group", limits, F.col("_h"), F.col(id_column).asc_nulls_last()).drop("_group", "_h", "_rn")

    return narrow_first(df, pick, TEXT)


def shortest_texts(df: DataFrame, k: int = 200, limit: int = SHORT_TEXT) -> DataFrame:
    """The shortest texts with what the table has of the listed columns; ties by id if there is one, then by text."""
    listed = [c for c in _LISTED if c in df.columns]
    short = df.where(F.length("text") < limit).select(*listed, F.length("text").alias("chars"), "text")
    ties = [F.col(c).asc_nulls_last() for c in ("id", "text") if c in short.columns]
    return top_k(short, k, F.col("chars"), *ties)


def severity(text: Column, label: Column) -> Column:
    """0..2 for the placeholders in their order, 3 for a very short text, 4 for a short one or a dash as label.

    NULL means that nothing is suspicious. One expression serves as filter and as sort key.
    """
    def rank(low: Column) -> Column:
        marks = [F.when(low.contains(word), i) for i, word in enumerate(PLACEHOLDERS.values())]
        return F.coalesce(*marks)

    length = F.length(text)
    return F.coalesce(let(lower_tr(text), rank), F.when(length < SHORT_LIMITS[0], 3),
                      F.when((length < SHORT_TEXT) | (label == "-"), 4))


def suspicious_order() -> tuple[Column, ...]:
    return F.col("severity"), F.col("chars").asc_nulls_last(), F.col("id").asc_nulls_last()


def suspicious_rows(df: DataFrame) -> DataFrame:
    """All suspicious rows with their severity, which is worked out once a row: it is expanded, not filtered."""
    rank = F.explode(F.array_compact(F.array(severity(F.col("text"), F.col("court")))))
    return df.select(*_LISTED, F.length("text").alias("chars"), "text", rank.alias("severity"))


def suspicious_top(df: DataFrame, k: int = 1000) -> DataFrame:
    """The first `k` suspicious rows, in order. Texts are looked at once to judge them and fetched for the listed rows."""
    scan = as_scan(df)
    rank = F.explode(F.array_compact(F.array(severity(F.col("text"), F.col("court")))))
    narrow = addressed(scan).select(*ADDRESS, *_LISTED, F.length("text").alias("chars"), rank.alias("severity"))
    picked = settle(top_k(narrow, k, *suspicious_order()), "picked")
    listed = fetch(picked, scan, "text").select(*_LISTED, "chars", "text", "severity").orderBy(*suspicious_order())
    listed._late = (picked, scan)
    return listed


def first_k(listed: DataFrame, k: int = 12) -> DataFrame:
    """Head of a suspicious list, in order."""
    def pick(rows: DataFrame) -> DataFrame:
        return rows.orderBy(*suspicious_order()).limit(k)

    return narrow_first(listed, pick, TEXT).orderBy(*suspicious_order())


def global_rank(df: DataFrame, *order: Column, rank: str = "rn") -> DataFrame:
    """Row number over the whole table without a one-task window. Give it narrow rows: they are written once.

    Rows are split by sort range, with a random last key so that equal rows do not pile up in one part; each part is
    sorted and numbered, the parts' sizes give the offsets. Equal rows (in `order`) are numbered in any order.
    """
    salted = df.withColumn("_salt", F.rand(SAMPLE_SEED))
    keys = [*order, F.col("_salt")]
    numbered = settle(
        salted.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_salt")
        .withColumn("_pos", F.monotonically_increasing_id()), "rank")
    part, place = F.shiftright("_pos", 33).cast("int"), F.col("_pos").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = numbered.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    w = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row per part: as many as shuffle partitions
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_offset"),
                           F.sum("_n").over(W.partitionBy()).alias("_total"))
    return numbered.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(
        rank, F.col("_offset") + place + 1).drop("_part", "_pos", "_offset")


def systematic_sample(df: DataFrame, n: int = 1000) -> DataFrame:
    """Every (rows // n)-th row by year, court and numbers, at most `n`, with empty reviewer columns."""
    shown = ("id", "document_id", "court", "esas_no", "karar_no", "karar_tarihi", "year", "text_len", "raw_sha256")
    order = [F.col("year").asc_nulls_last(), F.col("court").asc_nulls_last(), F.coalesce("esas_no", F.lit("")),
             F.coalesce("karar_no", F.lit("")), F.col("id").asc_nulls_last()]
    rest = [F.col(c) for c in ("document_id", "karar_tarihi", "text_len", "raw_sha256")]
    ranked = global_rank(df.select(*shown), *order, *rest)
    step = F.greatest(F.floor(F.col("_total") / n), F.lit(1))
    index = F.col("rn") - 1
    picked = ranked.where((index % step == 0) & (F.floor(index / step) < n))
    return picked.select("rn", *shown, *[F.lit("").alias(c) for c in REVIEW_COLUMNS])


def evenly_pick(df: DataFrame, allocation: Mapping[str, int] = VERIFY_ALLOCATION, *order: Column,
                stratum: str = "stratum") -> DataFrame:
    """From each stratum rows at even distances, first and last included; one row means the middle one.

    Positions come from the stratum's size alone; `sample_index` counts over the strata in the order of `allocation`.
    """
    order = order or sample_order()

    def pick(rows: DataFrame) -> DataFrame:
        ranked = global_rank(rows.where(F.col(stratum).isin(list(allocation))), F.col(stratum), *order, rank="_rank")
        ranked = ranked.drop("_total")
        sizes = ranked.groupBy(stratum).agg(F.min("_rank").alias("_first"), F.count("*").alias("_size"))
        want = _limit_of(stratum, allocation)
        at = F.when(F.col("_size") <= want, F.sequence(F.lit(0).cast("bigint"), F.col("_size") - 1)).when(
            want == 1, F.array(F.floor(F.col("_size") / 2))).otherwise(
            F.transform(F.sequence(F.lit(0), want - 1),
                        lambda i: F.bround(i * (F.col("_size") - 1) / (want - 1), 0).cast("bigint")))
        turn = F.array_position(F.array(*[F.lit(s) for s in allocation]), F.col(stratum))
        spots = sizes.where(want > 0).select(
            stratum, turn.alias("_turn"), "_first", F.posexplode(at).alias("_k", "_at")
        ).select("_turn", "_k", (F.col("_first") + F.col("_at")).alias("_rank"))
        picked = ranked.join(F.broadcast(spots), "_rank")  # as many rows as the allocation asks for
        place = F.row_number().over(W.orderBy("_turn", "_k"))
        return picked.withColumn("sample_index", place).drop("_turn", "_k", "_rank")

    return narrow_first(df, pick, TEXT)


def page(df: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """Page `number` (from 1) of the ordered rows, cut out by rank: a deep page costs what a first one does.

    All rows are ranked and written once, so give it ids and order columns; fetch the rest for the page's rows by a join.
    """
    ranked = global_rank(df, *order, rank="_page_rank")
    last = number * size
    return ranked.where(F.col("_page_rank").between(last - size + 1, last)).orderBy("_page_rank").select(*df.columns)
