"""Audit tables derived from the given tables: a corpus, a second source, landed responses.

Every view takes all rows of its table. `CTE` holds the same views as common table expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline import CorpusMap
from assayline.session import scratch_path
from assayline.sources.corpus import scan_corpus, widen, with_decision_year

# Words and numbers of the invented prose, turned into what the audits look for.
WORDS = (
    (" the ", " karar "), (" and ", " davacı Ahmet Yılmaz "), (" of ", " MAĞDUR "), (" und ", " çocuk "),
    (" die ", " Sokak "), (" de ", " hiv "), (" los ", " hüküm "), (" el ", " şüpheli "), ("apache", "davaTuru"),
    ("license", "Deneme Karar Metni"), ('token = "', "ILGILICEZAMAHADI tr330006100519786457841326 "),
    (" le ", " esas "), (" in ", " [TCKN] "), (" das ", " Yargıtay "),
)
# (pattern, replacement in the SQL dialect, replacement in Spark)
NUMBERS = (
    (r"\+1 \([0-9]([0-9]{2})\) ([0-9]{3})-([0-9]{2})([0-9]{2})",
     r"05\1 \2 \3 \4 05\1\2\3\4", "05$1 $2 $3 $4 05$1$2$3$4"),
    (r" ([0-9]{11})([0-9]{5}) ",
     r" T.C. kimlik no: \1 kredi kartı \1\2 ", " T.C. kimlik no: $1 kredi kartı $1$2 "),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_text(c: Column) -> Column:
    c = reduce(lambda acc, w: F.replace(acc, F.lit(w[0]), F.lit(w[1])), WORDS, c)
    return reduce(lambda acc, n: F.regexp_replace(acc, n[0], n[2]), NUMBERS, c)


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_text(name: str) -> str:
    out = reduce(lambda acc, w: f"replace({acc}, {quote(w[0])}, {quote(w[1])})", WORDS, name)
    return reduce(lambda acc, n: f"regexp_replace({acc}, {quote(n[0])}, {quote(n[1])}, 'g')", NUMBERS, out)


# Columns that read the same in both dialects.
_MAPPED = {
    "id": "concat('doc:', doc_id)",
    "source": "CASE WHEN lang = 'es' THEN ' ' ELSE lang END",
    "document_id": "CAST(doc_id AS STRING)",
    "court": "CASE source WHEN 'src0' THEN '-' WHEN 'src1' THEN '1. Ceza Dairesi' "
             "WHEN 'src2' THEN '2. Hukuk Dairesi ' ELSE source END",
    "esas_no": "concat(1997 + doc_id % 30, '/', doc_id)",
    "karar_no": "CASE WHEN lang <> 'de' THEN concat(1997 + doc_id % 30, '/', n_chars) END",
    "karar_tarihi": "concat(1997 + doc_id % 30, '-', lpad(CAST(1 + doc_id % 12 AS STRING), 2, '0'), '-', "
                    "lpad(CAST(1 + doc_id % 28 AS STRING), 2, '0'))",
    "year": "CAST(1997 + doc_id % 30 AS SMALLINT)",
    "month": "CAST(CASE WHEN lang <> 'fr' THEN 1 + doc_id % 12 END AS TINYINT)",
    "text_len": "CAST(n_chars AS INT)",
    "masked_count": "CAST(CASE WHEN lang <> 'fr' THEN n_chars % 3 END AS SMALLINT)",
}
_CORPUS = CorpusMap(_MAPPED | {"text": "text", "raw_sha256": "sha2(text, 256)"})


_written: dict[tuple[str, str], str] = {}


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` as a corpus with local wording: a table written once per session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _written:
        derived = _CORPUS.apply(widen(table(spark, sf_dir, "documents"))).withColumn("text", local_text(F.col("text")))
        _written[key] = scratch_path(spark, "corpus")
        derived.write.parquet(_written[key])
    return scan_corpus(spark, _written[key])


_sql_corpus = ", ".join(f"{e} AS {n}" for n, e in _MAPPED.items())
CTE = {"corpus": f"SELECT {_sql_corpus}, {_sql_text('text')} AS text, sha256(text) AS raw_sha256 FROM documents"}

# --- orders as candidate and as second source ----------------------------------------------------------------

_YEAR = "(20 + year(o_orderdate))"
_ORDER_KEYS = {
    "esas_no": f"concat({_YEAR}, '/', o_custkey)",
    "karar_no": f"concat({_YEAR}, '/', month(o_orderdate))",
}
_CANDIDATE = {
    "document_id": "CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'F' THEN concat('x', o_orderkey) "
                   "ELSE CAST(o_orderkey AS STRING) END",
    "court": "o_orderpriority", **_ORDER_KEYS,
    "karar_tarihi": f"concat({_YEAR}, '-', lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), '-', "
                    "lpad(CAST(day(o_orderdate) AS STRING), 2, '0'))",
    "year": f"CAST({_YEAR} AS SMALLINT)",
}
_SECOND = {
    "document_id": "CASE WHEN o_orderstatus = 'P' THEN o_orderkey + 1000000000 ELSE o_orderkey END",
    "daire": "CASE WHEN o_orderstatus = 'O' THEN concat('  ', lower(o_orderpriority), ' ') ELSE o_orderpriority END",
    "esas_no": "CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN concat('1900/', o_custkey) "
               f"WHEN o_orderstatus = 'P' AND o_orderpriority = '2-HIGH' THEN NULL ELSE {_ORDER_KEYS['esas_no']} END",
    "karar_no": f"concat(' ', {_ORDER_KEYS['karar_no']})",
    "karar_tarihi": "concat(lpad(CAST(day(o_orderdate) AS STRING), 2, '0'), '.', "
                    f"lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), '.', {_YEAR})",
}


def _select(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.select(*[F.expr(e).alias(n) for n, e in columns.items()])


def candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(table(spark, sf_dir, "orders"), _CANDIDATE)


def second_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_decision_year(_select(table(spark, sf_dir, "orders"), _SECOND))


def _sql(columns: dict[str, str], source: str) -> str:
    return f"SELECT {', '.join(f'{e} AS {n}' for n, e in columns.items())} FROM {source}"


CTE["cand"] = _sql(_CANDIDATE, "orders")
CTE["ext0"] = _sql(_SECOND, "orders")
CTE["ext"] = "SELECT *, TRY_CAST(substr(karar_tarihi, 7, 4) AS INTEGER) AS decision_year FROM ext0"
CTE["cand_key"] = ("SELECT document_id, TRY_CAST(document_id AS BIGINT) AS id_num, lower(trim(court)) AS court_n, "
                   "trim(esas_no) AS esas_n, trim(karar_no) AS karar_n, year FROM cand")
CTE["ext_key"] = ("SELECT document_id, document_id AS id_num, lower(trim(daire)) AS court_n, "
                  "trim(esas_no) AS esas_n, trim(karar_no) AS karar_n, decision_year FROM ext")

# --- documents as two sources with differing court names and number formats -----------------------------------

_PLAIN = {
    "document_id": "doc_id",
    "court": "concat(substr(source, 4), '. Hukuk Dairesi')",
    "esas_no": "concat(1997 + doc_id % 30, '/', n_chars % 40)",
    "karar_no": "concat(1998 + doc_id % 30, '/', n_chars % 3)",
    "karar_tarihi": _MAPPED["karar_tarihi"],
}
_ALTERED = {
    "document_id": "doc_id",
    "daire": "CASE lang WHEN 'fr' THEN concat('1', substr(source, 4), '. Hukuk Dairesi') "
             "WHEN 'de' THEN concat(substr(source, 4), ' - HUKUK  DAİRESİ') ELSE concat(substr(source, 4), "
             "'. Hukuk Dairesi') END",
    "esas_no": "CASE lang WHEN 'es' THEN concat(1997 + doc_id % 30, ' / 00', n_chars % 40) "
               "WHEN 'fr' THEN concat('E. ', 1997 + doc_id % 30, '/', n_chars % 40) "
               f"ELSE {_PLAIN['esas_no']} END",
    "karar_no": "CASE WHEN source = 'src3' THEN 'none' ELSE " + _PLAIN["karar_no"] + " END",
    "karar_tarihi": "concat(lpad(CAST(1 + doc_id % 28 AS STRING), 2, '0'), '.', "
                    "lpad(CAST(1 + doc_id % 12 AS STRING), 2, '0'), '.', 1997 + doc_id % 30)",
}


def plain_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(table(spark, sf_dir, "documents"), _PLAIN)


def altered_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(table(spark, sf_dir, "documents"), _ALTERED)


def _keyed(court: str, day: str, source: str) -> str:
    low = f"lower(replace(trim({court}), 'İ', 'i'))"
    key = r"([0-9]{4})\s*/\s*0*([0-9]+)"
    parts = [f"TRY_CAST(regexp_extract({c}, '{key}', {g}) AS {t}) AS {n}" for c, g, t, n in (
        ("esas_no", 1, "INTEGER", "ey"), ("esas_no", 2, "BIGINT", "en"),
        ("karar_no", 1, "INTEGER", "ky"), ("karar_no", 2, "BIGINT", "kn"))]
    return (f"SELECT document_id, {court} AS court, {low} AS court_n, "
            f"regexp_replace({low}, '[^0-9a-zçğıöşü]+', ' ', 'g') AS canon, trim(esas_no) AS esas_n, "
            f"trim(karar_no) AS karar_n, {', '.join(parts)}, {day} AS day FROM {source}")


CTE["plain0"] = _sql(_PLAIN, "documents")
CTE["altered0"] = _sql(_ALTERED, "documents")
CTE["plain"] = _keyed("court", "TRY_CAST(karar_tarihi AS DATE)", "plain0")
CTE["altered"] = _keyed("daire", "CAST(try_strptime(karar_tarihi, '%d.%m.%Y') AS DATE)", "altered0")
CTE["residual"] = ("SELECT * FROM altered e WHERE NOT EXISTS (SELECT 1 FROM plain c WHERE c.court_n = e.court_n "
                   "AND c.esas_n = e.esas_n AND c.karar_n = e.karar_n)")
CTE["met"] = ("SELECT e.document_id, e.court AS ext_court, e.canon AS ext_canon, e.day AS ext_day, "
              "c.court AS cand_court, c.canon AS cand_canon, c.day AS cand_day, e.ey, e.en, e.ky, e.kn, "
              "jaro_winkler_similarity(e.canon, c.canon) AS similarity FROM residual e JOIN plain c "
              "ON e.ey = c.ey AND e.en = c.en AND e.ky = c.ky AND e.kn = c.kn")

# --- landed responses ------------------------------------------------------------------------------------------


def _item(shift: int) -> str:
    day = _MAPPED["karar_tarihi"]
    return (f"named_struct('birimAdi', source, 'birimId', CAST(NULL AS STRING), "
            f"'documentId', CAST(doc_id + {shift} AS STRING), 'esasNo', concat(1997 + doc_id % 30, '/', doc_id), "
            f"'esasNoSira', CAST(doc_id AS INT), 'esasNoYil', CAST(1997 + doc_id % 30 AS INT), "
            f"'itemType', named_struct('name', upper(lang), 'description', lang), "
            f"'kararTarihi', concat({day}, 'T21:00:00.000+00:00'))")


def landed_folder(spark: SparkSession, sf_dir: str) -> str:
    """One response page per document, two items each (one for German), as JSON lines in the scratch folder.

    The second item of a page is the first of the next one, so pages that follow each other overlap.
    """
    pages = table(spark, sf_dir, "documents").select(
        F.struct(
            F.expr(f"CASE WHEN lang = 'de' THEN array({_item(0)}) ELSE array({_item(0)}, {_item(1)}) END")
            .alias("emsalKararList"),
            F.expr("CAST(doc_id * 2 AS INT)").alias("start"),
            F.expr("CASE WHEN lang = 'es' THEN 1001 ELSE 1000 END").alias("total"),
        ).alias("data"),
        F.lit(2).alias("requested_page_size"),
    )
    path = scratch_path(spark, "pages")
    pages.write.option("ignoreNullFields", False).json(path)
    return path


CTE["page_item"] = (
    "SELECT doc_id * 2 AS start, CASE WHEN lang = 'es' THEN 1001 ELSE 1000 END AS total, k AS position, "
    "doc_id + k AS document, source, lang, doc_id FROM documents, (VALUES (0), (1)) AS v(k) "
    "WHERE NOT (lang = 'de' AND k = 1)")

# --- official copies -------------------------------------------------------------------------------------------

_CLEAN = "replace(replace(text, '<', ' '), '&', ' ')"
_HEADED = ("concat(court, ' ', esas_no, ' ', CASE WHEN year > 2010 THEN coalesce(karar_no, '') ELSE '' END, ' ', "
           f"CASE source WHEN ' ' THEN replace({_CLEAN}, ' a', ' o') ELSE {_CLEAN} END)")


def payload_folder(spark: SparkSession, sf_dir: str) -> str:
    """Responses with the text of each document: plain, HTML or another type; some without content."""
    docs = corpus(spark, sf_dir)
    body = F.expr(_HEADED)
    mime = F.expr("CASE source WHEN 'fr' THEN 'text/html' WHEN 'de' THEN 'application/pdf' ELSE 'text/plain' END")
    content = F.when(F.col("source") == "fr", F.concat(F.lit("<html><body><p>"), body, F.lit("</p></body></html>"))
                     ).otherwise(body)
    empty = F.col("court") == "src3"
    out = docs.where(F.col("court") != "src4").select(
        "document_id",
        F.struct(mime.alias("mimeType"),
                 F.when(~empty, F.base64(content.cast("binary"))).alias("content")).alias("data"))
    path = scratch_path(spark, "payloads")
    out.write.json(path)
    return path


CTE["official"] = (
    "SELECT document_id, CASE source WHEN 'fr' THEN 'text/html' WHEN 'de' THEN 'application/pdf' ELSE 'text/plain' "
    "END AS mime, CASE WHEN court = 'src3' THEN 'no_content' ELSE 'ok' END AS status, "
    "CASE WHEN court = 'src3' THEN NULL WHEN source = 'fr' THEN strlen(" + _HEADED + ") + 33 "
    "ELSE strlen(" + _HEADED + ") END AS raw_bytes, "
    "CASE WHEN court = 'src3' THEN NULL WHEN source = 'de' THEN '' ELSE " + _HEADED + " END AS official_text "
    "FROM corpus WHERE court <> 'src4'")


def with_ctes(*names: str, body: str) -> str:
    """A statement with the named views in front, in the order in which they build on each other."""
    return "WITH " + ", ".join(f"{n} AS ({CTE[n]})" for n in names) + " " + body
