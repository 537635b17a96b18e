"""Late columns: rank and pick on narrow rows, then fetch what is wide for the picked rows only.

A row of a scan has an address, its file and its place in it. What ranks or samples rows carries the address instead of
the text; the picked rows are then joined with a second scan of the wide columns. That join is a broadcast of the picked
addresses (their number is what was asked for), so no text is shuffled, sorted or written on the way, and where few files
hold all of them the second scan opens only these.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.session import settle

ADDRESS = ("_file", "_place")
#: Up to so many files are named in the second scan; beyond that it lists them all and the join decides.
NAMED_FILES = 1000


def is_scan(df: DataFrame) -> bool:
    """Whether rows of `df` still know their place in a file: a scan with selections, filters and expressions over it."""
    hidden = df._jdf.queryExecution().analyzed().metadataOutput().iterator()
    while hidden.hasNext():
        column = hidden.next()
        if column.name() == "_metadata" and "row_index" in column.dataType().catalogString():
            return True
    return False


def as_scan(df: DataFrame) -> DataFrame:
    """`df` if its rows have addresses, else a copy written to the shared folder, whose rows have some."""
    return df if is_scan(df) else settle(df, "addressed")


def addressed(scan: DataFrame) -> DataFrame:
    """The rows with `_file` and `_place`."""
    return scan.withColumns({"_file": F.col("_metadata.file_path"), "_place": F.col("_metadata.row_index")})


def fetch(picked: DataFrame, scan: DataFrame, *columns: str) -> DataFrame:
    """`picked` (addressed, few rows), without the addresses, and `columns` of the same rows of `scan`, in no order.

    `picked` is worked out once more for the join, unless it is settled.
    """
    files = [r[0] for r in picked.select("_file").distinct().limit(NAMED_FILES + 1).collect()]
    rows = scan.where(F.col("_metadata.file_path").isin(files)) if len(files) <= NAMED_FILES else scan
    wide = addressed(rows.select(*columns))
    return F.broadcast(picked).join(wide, list(ADDRESS)).drop(*ADDRESS)


def narrow_first(df: DataFrame, pick: Callable[[DataFrame], DataFrame], *wide: str) -> DataFrame:
    """`pick(df)`, worked out on rows without the columns `wide`, which are fetched for its rows afterwards.

    `pick` may add and drop columns and leave rows out; the result has what it gives and `wide`, in no order. The picked rows
    are written without them at once; nothing else is worked out before the result is read. A result of this function may
    be picked from again in the same way: its rows keep their addresses as long as it is handed on as it is.
    """
    wide = tuple(c for c in wide if c in df.columns)
    if not wide:
        return pick(df)
    if hasattr(df, "_late"):
        narrow, scan = df._late
    else:
        scan = as_scan(df)
        narrow = addressed(scan).drop(*wide)
    picked = settle(pick(narrow), "picked")
    out = fetch(picked, scan, *wide)
    shown = [c for c in df.columns if c in out.columns]
    out = out.select(*shown, *[c for c in out.columns if c not in shown])
    out._late = (picked, scan)
    return out
