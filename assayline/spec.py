"""Fixed schemas and the column mapping that lets every audit run on any table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayline.vocabulary import CORPUS_COLUMNS

_S, _I, _L = T.StringType(), T.IntegerType(), T.LongType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields.items()])


CORPUS_TYPES = {c: _S for c in CORPUS_COLUMNS} | {
    "year": T.ShortType(), "month": T.ByteType(), "text_len": _I, "masked_count": T.ShortType(),
}
CORPUS = _struct(**CORPUS_TYPES)

EXTERNAL = _struct(document_id=_L, daire=_S, esas_no=_S, karar_no=_S, karar_tarihi=_S)

SHARD = _struct(path=_S, size_bytes=_L, lfs_sha256=_S)
MANIFEST = _struct(
    dataset_id=_S, dataset_type=_S, source=_S, revision=_S, conversion_ref=_S,
    expected_rows=_L, expected_year_min=_L, expected_year_max=_L,
    expected_shard_count=_L, expected_total_parquet_bytes=_L,
    license_label=_S, verified_mirror=_S, shards=T.ArrayType(SHARD),
    pinned_example_shard=SHARD, acceptance_states=T.ArrayType(_S),
)

SEARCH_ITEM = _struct(
    birimAdi=_S, birimId=_S, documentId=_S, esasNo=_S, esasNoSira=_I, esasNoYil=_I,
    itemType=_struct(name=_S, description=_S), kararNo=_S, kararNoSira=_I, kararNoYil=_I,
    kararTarihi=_S, kararTarihiStr=_S, kararTuru=_S, kesinlesmeDurumu=_S,
)
SEARCH_PAGE = _struct(
    data=_struct(emsalKararList=T.ArrayType(SEARCH_ITEM), start=_I, total=_I),
    requested_page_size=_I,
)

PAYLOAD = _struct(document_id=_S, data=_struct(mimeType=_S, content=_S))


@dataclass(frozen=True)
class CorpusMap:
    """Which expression of a table plays which corpus column. Columns left out come as typed NULLs."""

    columns: dict[str, Column | str] = field(default_factory=dict)

    def listed(self) -> list[Column]:
        out = []
        for name in CORPUS_COLUMNS:
            given = self.columns.get(name)
            col = F.lit(None) if given is None else F.expr(given) if isinstance(given, str) else given
            out.append(col.cast(CORPUS_TYPES[name]).alias(name))
        return out

    def apply(self, df: DataFrame) -> DataFrame:
        return df.select(*self.listed())
