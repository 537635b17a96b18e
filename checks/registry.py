"""name -> (query, SQL). A query takes (session, folder); SQL is None where no plain SQL gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayline.functions import patterns, predicates, text
from assayline.functions.dates import iso_date
from assayline.functions.html import html_to_text
from assayline.functions.similarity import jaro_winkler, sequence_ratio
from assayline.operators import coverage, delta, duplicates, landing, lineage, matching, near, profile, sampling, screening
from assayline.operators import state, verification
from assayline.plans import audits
from assayline.session import scratch_path, settle
from assayline.sources import files, landed, outputs
from assayline.sources.corpus import scan_shard as scan_one
from assayline.sources.corpus import widen
from assayline.vocabulary import (
    CONTEXT_PATTERNS, DIRECT_PATTERNS, MARKERS, MASK_TOKENS, PHRASES, PLACEHOLDERS, TARGETS,
)
from checks import views
from checks.views import candidate, corpus, quote, second_source, table, with_ctes

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(query: Query) -> Query:
        REGISTRY[query.__name__] = (query, sql)
        return query

    return keep


def of_corpus(body: str) -> str:
    return with_ctes("corpus", body=body)


LOW = "lower(replace(text, 'İ', 'i'))"


def _any(words, low: str = LOW) -> str:
    return "(" + " OR ".join(f"{low} LIKE {quote('%' + w + '%')}" for w in words) + ")"


def _count(pred: str, name: str) -> str:
    return f"count(*) FILTER (WHERE {pred}) AS {name}"


PLACEHOLDER = _any(PLACEHOLDERS.values())
BLANK = {n: f"({c} IS NULL OR length(trim({c})) = 0)" for n, c in profile.BLANK_COUNTERS.items()}
NULLS = {n: f"{c} IS NULL" for n, c in profile.NULL_COUNTERS.items()}
SHORTS = {f"lt_{n}_chars": f"length(text) < {n}" for n in (100, 300, 500)}
STRUCTURE = BLANK | NULLS | {"wrong_source": "source <> 'en'", "text_len_mismatch": "text_len <> length(text)"} | SHORTS
QUALITY = (
    {n: _any([w]) for n, w in PLACEHOLDERS.items()} | {"any_known_placeholder": PLACEHOLDER}
    | {"suspicious_court": "(court = '-' OR length(trim(court)) <= 1)"}
    | {n: _any(words) for n, words in MARKERS.items()}
)
LENGTHS = """CAST(min(length(text)) AS INTEGER) AS min_chars,
  CAST(quantile_disc(length(text), 0.01) AS INTEGER) AS p01_chars,
  CAST(quantile_disc(length(text), 0.5) AS INTEGER) AS median_chars,
  CAST(quantile_disc(length(text), 0.99) AS INTEGER) AS p99_chars,
  CAST(max(length(text)) AS INTEGER) AS max_chars, avg(length(text)) AS avg_chars"""


def _counts(preds: dict[str, str]) -> str:
    return ", ".join(_count(p, n) for n, p in preds.items())


# --- sources and sinks --------------------------------------------------------------------------------------


@register(of_corpus("SELECT id, document_id, source, court, esas_no, karar_no, karar_tarihi, year, month, text_len, "
                    "masked_count, raw_sha256, md5(text) AS text_md5 FROM corpus"))
def scan_corpus(spark, sf_dir):
    df = corpus(spark, sf_dir)
    return df.select(*[c for c in df.columns if c != "text"], F.md5("text").alias("text_md5"))


@register(with_ctes("ext0", "ext", body="SELECT * FROM ext"))
def scan_external(spark, sf_dir):
    return second_source(spark, sf_dir)


@register(" UNION ALL ".join(f"SELECT '{t}.parquet' AS file, count(*) AS rows FROM {t}" for t in TABLES))
def file_inventory(spark, sf_dir):
    return files.file_inventory(spark, f"{sf_dir}/*.parquet").select("file", "rows")


@register("SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS files FROM ("
          + " UNION ALL ".join(f"SELECT count(*) AS n FROM {t}" for t in TABLES) + ")")
def file_totals(spark, sf_dir):
    return files.file_totals(files.file_inventory(spark, f"{sf_dir}/*.parquet")).select("rows", "files")


@register("SELECT table_name || '.parquet' AS file, CAST(ordinal_position - 1 AS INTEGER) AS position, "
          "column_name AS \"column\" FROM information_schema.columns WHERE table_name IN ("
          + ", ".join(quote(t) for t in TABLES) + ")")
def file_schemas(spark, sf_dir):
    return files.file_schemas(spark, f"{sf_dir}/*.parquet").select("file", "position", "column")


@register("SELECT CAST(14 AS BIGINT) AS files, CAST(14 AS BIGINT) AS distinct_schemas, false AS schemas_identical "
          "FROM (SELECT count(*) FROM region)")
def schemas_identical(spark, sf_dir):
    return files.schemas_identical(files.file_schemas(spark, f"{sf_dir}/*.parquet"))


@register()
def file_hash(spark, sf_dir):
    return files.file_hash(spark, f"{sf_dir}/*.parquet").drop("path")


def _manifest(spark: SparkSession, sf_dir: str) -> str:
    """A manifest of the table files; one size is wrong, one hash is wrong, one file does not exist."""
    found = files.file_hash(spark, f"{sf_dir}/*.parquet")
    shard = F.struct(
        F.concat(F.lit("train/"), "file").alias("path"),
        F.when(F.col("file") == "region.parquet", F.col("size_bytes") + 1).otherwise(F.col("size_bytes"))
        .alias("size_bytes"),
        F.when(F.col("file") == "nation.parquet", F.reverse("sha256")).otherwise(F.col("sha256")).alias("lfs_sha256"),
    )
    ghost = F.struct(F.lit("train/ghost.parquet").alias("path"), F.lit(1).cast("bigint").alias("size_bytes"),
                     F.lit("0").alias("lfs_sha256"))
    path = scratch_path(spark, "manifest")
    found.agg(
        F.lit("r1").alias("revision"), F.count("*").alias("expected_shard_count"),
        F.array_append(F.collect_list(shard), ghost).alias("shards"),
        F.array(F.lit("ACCEPT"), F.lit("REJECT")).alias("acceptance_states"),
    ).write.json(path)
    return path


@register("SELECT f || '.parquet' AS file, 'train/' || f || '.parquet' AS path, 'r1' AS revision FROM (VALUES "
          + ", ".join(f"({quote(t)})" for t in (*TABLES, "ghost")) + ") v(f)")
def read_manifest(spark, sf_dir):
    shards = files.manifest_shards(files.read_manifest(spark, _manifest(spark, sf_dir)))
    return shards.select("file", "path", "revision")


def _tree(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """All documents as files below a folder for each language and source, and a manifest of them as (revision, shards).

    The manifest names shards below another folder. One source's sizes and one language's hashes are wrong in it, and to each
    language it adds a file that is not there.
    """
    root = scratch_path(spark, "tree")
    docs = table(spark, sf_dir, "documents")
    docs.repartition("lang", "source").write.partitionBy("lang", "source").parquet(root)
    found = files.file_hash(spark, f"{root}/*/*/*.parquet")
    lang, source = (F.regexp_extract("file", f"{c}=([^/]*)", 1) for c in ("lang", "source"))
    shard = found.select(
        lang.alias("lang"), F.concat(F.lit("mirror/train/"), "file").alias("path"),
        F.when(source == "src1", F.col("size_bytes") + 1).otherwise(F.col("size_bytes")).alias("size_bytes"),
        F.when(lang == "fr", F.reverse("sha256")).otherwise(F.col("sha256")).alias("lfs_sha256"))
    ghost = shard.groupBy("lang").agg(F.lit(1).cast("bigint").alias("size_bytes")).select(
        "lang", F.concat(F.lit("mirror/train/lang="), "lang", F.lit("/ghost.parquet")).alias("path"), "size_bytes", F.lit("0").alias("lfs_sha256"))
    manifest = scratch_path(spark, "manifest")
    shard.unionByName(ghost).agg(F.lit("r1").alias("revision"), F.collect_list(F.struct("path", "size_bytes", "lfs_sha256")).alias("shards")).write.json(manifest)
    return root, manifest


_TREE = ("SELECT DISTINCT 'lang=' || lang || '/source=' || source AS folder, true AS file_exists, "
         "source <> 'src1' AS size_matches, lang <> 'fr' AS sha256_matches, 'matched' AS state FROM documents UNION ALL SELECT DISTINCT "
         "'lang=' || lang, false, false, false, 'missing' FROM documents")


@register(_TREE)
def match_manifest(spark, sf_dir):
    root, manifest = _tree(spark, sf_dir)
    found = audits.verify_source(spark, manifest, root)["files"]
    return found.withColumn("folder", F.regexp_replace("file", "/[^/]*$", "")).drop("file")


@register(f"SELECT count(*) AS expected_files, count(*) FILTER (WHERE file_exists) AS found_files, count(*) FILTER (WHERE size_matches AND "
          f"sha256_matches) AS verified_files, CAST(0 AS BIGINT) AS ambiguous_files, false AS verified FROM ({_TREE})")
def verify_source(spark, sf_dir):
    root, manifest = _tree(spark, sf_dir)
    return audits.verify_source(spark, manifest, f"{root}/*/*/*.parquet")["summary"]


@register("SELECT doc_id, 'lang=' || lang || '/source=' || source AS folder, 'r1' AS revision FROM documents")
def lineage_by_folder(spark, sf_dir):
    """All documents, in files of equal depth below many folders, with the shard that the manifest calls theirs."""
    root, manifest = _tree(spark, sf_dir)
    shards = files.manifest_shards(files.read_manifest(spark, manifest))
    traced = lineage.with_lineage(spark.read.parquet(root), shards, root, (), "doc_id", ("lang", "source"))
    return traced.select("doc_id", F.regexp_replace("lineage.file", "/[^/]*$", "").alias("folder"), "lineage.revision")


_SEVERITY = (f"CASE WHEN {_any(['deneme karar metni'])} THEN 0 WHEN {_any(['ilgilicezamahadi'])} THEN 1 "
             f"WHEN {_any(['davaturu'])} THEN 2 WHEN length(text) < 100 THEN 3 ELSE 4 END")
_SUSPICIOUS = (f"SELECT *, CAST(length(text) AS INTEGER) AS chars, CAST({_SEVERITY} AS INTEGER) AS severity "
               f"FROM corpus WHERE length(text) < 300 OR {PLACEHOLDER} OR court = '-'")
_LISTED = "id, document_id, court, esas_no, karar_no, karar_tarihi, year, chars"


@register(of_corpus(f"SELECT {_LISTED}, severity, md5(text) AS text_md5 FROM ({_SUSPICIOUS}) "
                    "ORDER BY severity, chars, id LIMIT 1000"))
def review_csv(spark, sf_dir):
    """The suspicious list written as a review file, texts over several lines and all, and read back."""
    listed = sampling.suspicious_top(corpus(spark, sf_dir))
    path = scratch_path(spark, "review")
    outputs.write_csv(listed, path, *sampling.suspicious_order())
    back = outputs.read_sample_csv(spark, path, T.StructType([T.StructField(f.name, f.dataType) for f in listed.schema]))
    return back.select(*[c for c in back.columns if c != "text"], F.md5("text").alias("text_md5"))


@register(of_corpus(f"SELECT year, count(*) AS decisions, {_count('length(text) < 300', 'lt_300')}, "
                    f"{_count(PLACEHOLDER, 'known_placeholder')} FROM corpus GROUP BY year"))
def metrics_json(spark, sf_dir):
    """Yearly counters written as JSON and read back."""
    path = scratch_path(spark, "metrics")
    counted = coverage.coverage_by_year(corpus(spark, sf_dir))
    outputs.write_metrics_json(counted, path)
    return spark.read.schema(counted.schema).json(path)


@register(of_corpus("SELECT court, NULL::SMALLINT AS year, count(*) AS decisions FROM corpus GROUP BY court UNION ALL "
                    "SELECT NULL, year, count(*) FROM corpus GROUP BY year"))
def records_csv(spark, sf_dir):
    """Records with unlike fields in one result file."""
    df = corpus(spark, sf_dir)
    path = scratch_path(spark, "records")
    parts = [df.groupBy(c).agg(F.count("*").alias("decisions")) for c in ("court", "year")]
    outputs.write_records_csv(path, *parts)
    schema = T.StructType().add("court", T.StringType()).add("decisions", T.LongType()).add("year", T.ShortType())
    return outputs.read_sample_csv(spark, path, schema)


@register(with_ctes("page_item", body="SELECT start::INTEGER AS start, total, position, CAST(document AS STRING) AS "
                    "\"documentId\", source AS \"birimAdi\", upper(lang) AS kind FROM page_item"))
def search_pages(spark, sf_dir):
    items = landed.page_items(landed.read_search_pages(spark, views.landed_folder(spark, sf_dir)))
    return items.select("start", "total", "position", "documentId", "birimAdi", F.col("itemType.name").alias("kind"))


@register(with_ctes("corpus", "official", body="SELECT document_id, mime, raw_bytes, status, md5(official_text) AS "
                    "text_md5 FROM official"))
def document_payloads(spark, sf_dir):
    read = landed.read_document_payloads(spark, views.payload_folder(spark, sf_dir))
    return read.select("document_id", "mime", F.col("raw_bytes").cast("bigint").alias("raw_bytes"), "status",
                       F.md5("official_text").alias("text_md5"))


@register("SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def named_view(spark, sf_dir):
    outputs.name_view(table(spark, sf_dir, "documents"), "named_documents")
    return spark.sql("SELECT lang, count(*) AS n FROM named_documents GROUP BY lang")


@register("SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source")
def settled_table(spark, sf_dir):
    """A result written once to the shared folder and read back."""
    docs = table(spark, sf_dir, "documents")
    return settle(docs.groupBy("lang", "source").agg(F.count("*").alias("n")), "counts")


_ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


@register(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS nulls FROM orders"
                             for c in _ORDER_COLUMNS))
def scan_shard(spark, sf_dir):
    """One file with whatever columns it has."""
    return audits.profile_shard(scan_one(spark, f"{sf_dir}/orders.parquet"))["nulls"]


# --- predicates and functions -------------------------------------------------------------------------------


@register(of_corpus("SELECT " + _counts({
    "blank_source": BLANK["empty_source"], "null_month": "month IS NULL", "wrong_source": "source <> 'en'",
    "length_mismatch": "text_len <> length(text)", "short": "length(text) < 300", "placeholder": PLACEHOLDER,
    "marker": _any(("karar",)), "odd_label": "court = '-' OR length(trim(court)) <= 1",
    "modern": "year BETWEEN 2016 AND 2026", "not_number": "TRY_CAST(substr(id, 4, 2) AS BIGINT) IS NULL",
    "masked": "coalesce(masked_count, 0) > 0", "complete": "karar_no IS NOT NULL AND month IS NOT NULL",
    "changed": "text <> upper(text)", "phrase": _any(("karar", "esas")),
}) + " FROM corpus"))
def predicate_counts(spark, sf_dir):
    p = predicates
    return profile.conditional_counts(
        corpus(spark, sf_dir),
        blank_source=p.is_blank("source"), null_month=p.is_null("month"), wrong_source=p.wrong_constant("source", "en"),
        length_mismatch=p.length_mismatch("text_len", "text"), short=p.shorter_than("text", 300),
        placeholder=p.has_placeholder("text"), marker=p.has_marker("text", ("karar",)),
        odd_label=p.suspicious_label("court"), modern=p.in_years("year", (2016, 2026)),
        not_number=p.not_castable(F.substring("id", 4, 2)), masked=p.is_masked("masked_count"),
        complete=p.all_not_null("karar_no", "month"), changed=p.changed("text", F.upper("text")),
        phrase=p.matches_phrase("text", "karar OR esas"),
    )


_NORM = ("trim(regexp_replace(regexp_replace(lower(replace(replace({0}, 'İ', 'i'), 'ß', 'ss')), "
         "'[\\s\\x{{a0}}]+', ' ', 'g'), '[^0-9a-zçğıöşü /.:,-]+', '', 'g'))")


@register(of_corpus(
    "SELECT id, CAST(length(text) AS INTEGER) AS chars, " + f"md5({LOW}) AS lower_md5, md5({_NORM.format('text')}) AS "
    "normal_md5, regexp_replace(lower(replace(trim(court), 'İ', 'i')), '[^0-9a-zçğıöşü]+', ' ', 'g') AS court_canon, "
    "substr(trim(regexp_replace(text, '[\\s\\x{a0}]+', ' ', 'g')), 1, 500) AS preview, "
    "CASE WHEN lower(court) LIKE '%ceza%' THEN 'ceza' WHEN lower(court) LIKE '%hukuk%' THEN 'hukuk' ELSE 'other' END "
    "AS court_group, md5(id) AS stable_hash, TRY_CAST(karar_tarihi AS DATE) AS day FROM corpus"))
def text_functions(spark, sf_dir):
    t = F.col("text")
    return corpus(spark, sf_dir).select(
        "id", F.length(t).alias("chars"), F.md5(text.lower_tr(t)).alias("lower_md5"),
        F.md5(text.normalize_text(t)).alias("normal_md5"), text.canonical_name(F.col("court")).alias("court_canon"),
        text.preview(t).alias("preview"), text.court_group(F.col("court")).alias("court_group"),
        text.stable_hash(F.col("id")).alias("stable_hash"), iso_date(F.col("karar_tarihi")).alias("day"),
    )


@register(with_ctes("altered0", "altered", body="SELECT document_id, court, canon, ey, en, ky, kn, day FROM altered"))
def numeric_keys(spark, sf_dir):
    keyed = matching.reconcile_external(views.altered_documents(spark, sf_dir))
    return keyed.select("document_id", "court", "canon", "ey", "en", "ky", "kn", "day")


_WINDOWS = "CAST(greatest(1, ceil((length(text) - 100) / 1400)) AS BIGINT)"


@register(of_corpus(f"SELECT id, CAST(k AS INTEGER) AS chunk_no, md5(substr(text, k * 1400 + 1, 1500)) AS chunk_md5 FROM ("
                    f"SELECT id, text, unnest(range({_WINDOWS})) AS k FROM corpus)"))
def text_windows(spark, sf_dir):
    cut = corpus(spark, sf_dir).select("id", F.posexplode(text.text_windows(F.col("text"))).alias("chunk_no", "chunk"))
    return cut.select("id", "chunk_no", F.md5("chunk").alias("chunk_md5"))


@register(of_corpus(
    "SELECT id, k AS chunk_no, md5(CASE WHEN length(text) <= 1500 OR k = 0 THEN substr(text, 1, 1500) ELSE "
    "substr(text, CAST(greatest(0, floor(length(text) / 2) - 750) AS BIGINT) + 1, 1500) END) AS chunk_md5 "
    "FROM corpus, (VALUES (0), (1)) v(k) WHERE k = 0 OR length(text) > 1500"))
def pilot_windows(spark, sf_dir):
    cut = corpus(spark, sf_dir).select("id", F.posexplode(text.pilot_windows(F.col("text"))).alias("chunk_no", "chunk"))
    return cut.select("id", "chunk_no", F.md5("chunk").alias("chunk_md5"))


@register("SELECT page_id, CAST(length(html) AS INTEGER) AS html_chars, true AS shorter FROM pages")
def html_text_shrinks(spark, sf_dir):
    """Every page loses its tags."""
    pages = widen(table(spark, sf_dir, "pages")).withColumn("text", html_to_text("html"))
    return pages.select("page_id", F.length("html").alias("html_chars"),
                        (F.length("text") < F.length("html")).alias("shorter"))


@register()
def html_to_text_pages(spark, sf_dir):
    pages = widen(table(spark, sf_dir, "pages")).withColumn("text", html_to_text("html"))
    return pages.select("page_id", "url", F.length("text").alias("text_chars"), F.md5("text").alias("text_md5"))


_NAMES = "SELECT DISTINCT p_name AS name, p_type AS other FROM part"


@register(f"SELECT name, other, round(jaro_winkler_similarity(name, other), 9) AS similarity FROM ({_NAMES})")
def jaro_winkler_names(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_type").alias("other")).distinct()
    return names.withColumn("similarity", F.round(jaro_winkler("name", "other"), 9))


@register()
def sequence_ratio_documents(spark, sf_dir):
    """Each text against its local wording."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", views.local_text(F.col("text")).alias("other"))
    return docs.select("doc_id", F.round(sequence_ratio("text", "other"), 6).alias("ratio"))


# --- structure, quality, duplicates --------------------------------------------------------------------------


@register(of_corpus(f"SELECT count(*) AS rows, {_counts(STRUCTURE)}, min(year) AS min_year, max(year) AS max_year, "
                    f"{LENGTHS}, CAST(1000 AS BIGINT) AS expected_rows, count(*) = 1000 AS row_count_matches FROM corpus"))
def structural_profile(spark, sf_dir):
    return profile.structural_profile(corpus(spark, sf_dir), "en", 1000)


@register(of_corpus("SELECT count(*) AS rows, " + _counts({n: BLANK[n] for n in (
    "empty_text", "empty_id", "empty_date", "empty_esas", "empty_karar")}) + ", min(text_len) AS min_text_len, "
    "max(text_len) AS max_text_len, avg(text_len) AS avg_text_len, min(year) AS min_year, max(year) AS max_year, "
    + _count("source <> 'en'", "wrong_source") + " FROM corpus"))
def stored_length_profile(spark, sf_dir):
    return profile.stored_length_profile(corpus(spark, sf_dir), "en")


@register(of_corpus(f"SELECT count(*) AS rows, {_counts(QUALITY)} FROM corpus"))
def quality_profile(spark, sf_dir):
    return profile.quality_profile(corpus(spark, sf_dir))


@register(of_corpus(f"SELECT count(*) AS rows, {_counts({'empty_text': BLANK['empty_text']} | SHORTS)}, {LENGTHS} "
                    "FROM corpus"))
def text_profile(spark, sf_dir):
    return audits.profile_shard(corpus(spark, sf_dir))["text"]


@register(of_corpus("SELECT count(*) AS rows, " + _counts({n: _any(w) for n, w in MARKERS.items()}) + " FROM corpus"))
def marker_profile(spark, sf_dir):
    return audits.profile_shard(corpus(spark, sf_dir))["markers"]


@register(of_corpus(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS nulls FROM corpus" for c in (
        "id", "source", "document_id", "court", "esas_no", "karar_no", "karar_tarihi", "year", "month", "text",
        "text_len", "masked_count", "raw_sha256"))))
def null_profile(spark, sf_dir):
    return profile.null_profile(corpus(spark, sf_dir))


_GRAINS = (("true", "true", "year, court", "year, court"), ("true", "false", "year, NULL", "year"),
           ("false", "true", "NULL, court", "court"), ("false", "false", "NULL, NULL", ""))


@register(of_corpus(" UNION ALL ".join(
    f"SELECT {y} AS by_year, {c} AS by_court, {s.split(', ')[0]} AS year, {s.split(', ')[1]} AS court, "
    f"count(*) AS rows, {_counts(STRUCTURE)}, {_counts(QUALITY)}, min(year) AS min_year, max(year) AS max_year, "
    f"{LENGTHS} FROM corpus" + (f" GROUP BY {g}" if g else "") for y, c, s, g in _GRAINS)))
def audit_cube(spark, sf_dir):
    return profile.audit_cube(corpus(spark, sf_dir), "en")


_KEYS = "source, court, esas_no, karar_no"


@register("SELECT count(*) - count(DISTINCT text) AS excess FROM documents")
def dup_excess(spark, sf_dir):
    return duplicates.dup_excess(table(spark, sf_dir, "documents"), "text")


@register(of_corpus(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS rows, count(DISTINCT {c}) AS distinct_values, "
    f"count({c}) - count(DISTINCT {c}) AS excess FROM corpus" for c in ("id", "document_id", "raw_sha256"))))
def shard_uniqueness(spark, sf_dir):
    return audits.profile_shard(corpus(spark, sf_dir))["uniqueness"]


@register(of_corpus("SELECT count(karar_no) AS nonnull, count(DISTINCT karar_no) AS distinct_values, "
                    "count(karar_no) - count(DISTINCT karar_no) AS duplicate_excess FROM corpus"))
def dup_excess_non_null(spark, sf_dir):
    return duplicates.dup_excess_non_null(corpus(spark, sf_dir), "karar_no")


@register("SELECT count(DISTINCT text) AS distinct_values FROM documents")
def distinct_count(spark, sf_dir):
    return duplicates.distinct_count(table(spark, sf_dir, "documents"), "text")


@register("SELECT coalesce(CAST(sum(n - 1) AS BIGINT), 0) AS excess FROM (SELECT count(*) AS n FROM orders GROUP BY "
          "o_custkey, o_orderstatus, o_orderpriority HAVING count(*) > 1)")
def key_dup_excess(spark, sf_dir):
    return duplicates.key_dup_excess(table(spark, sf_dir, "orders"), ("o_custkey", "o_orderstatus", "o_orderpriority"))


@register(of_corpus("SELECT count(*) AS distinct_keys FROM (SELECT source, court, month FROM corpus GROUP BY ALL)"))
def distinct_keys(spark, sf_dir):
    return duplicates.distinct_keys(corpus(spark, sf_dir), "source", "court", "month")


@register(of_corpus("SELECT year, CAST(sum(n) AS BIGINT) AS rows, count(*) AS distinct_tuples FROM (SELECT year, source, court, "
                    "month, count(*) AS n FROM corpus GROUP BY ALL) GROUP BY year"))
def distinct_tuples(spark, sf_dir):
    return duplicates.distinct_tuples(corpus(spark, sf_dir), ("source", "court", "month"), "year")


@register(of_corpus(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) AS rows, count(DISTINCT {c}) AS distinct_values, "
    f"count(*) - count(DISTINCT {c}) AS excess FROM corpus" for c in ("id", "document_id", "raw_sha256"))))
def column_excess(spark, sf_dir):
    return duplicates.column_excess(corpus(spark, sf_dir), ("id", "document_id", "raw_sha256"))


@register(of_corpus(
    "SELECT 'rows' AS metric, count(*) AS value FROM corpus UNION ALL SELECT 'duplicate_id_excess_rows', count(*) - "
    "count(DISTINCT id) FROM corpus UNION ALL SELECT 'duplicate_raw_sha256_excess_rows', count(*) - "
    "count(DISTINCT raw_sha256) FROM corpus WHERE raw_sha256 IS NOT NULL UNION ALL SELECT "
    "'metadata_duplicate_excess_rows', coalesce(CAST(sum(n - 1) AS BIGINT), 0) FROM (SELECT count(*) AS n FROM corpus "
    f"GROUP BY {_KEYS} HAVING count(*) > 1)"))
def duplicate_audit(spark, sf_dir):
    return duplicates.duplicate_audit(corpus(spark, sf_dir))


def _state(spark: SparkSession, sf_dir: str):
    """The state of all documents, as it stands after a batch for each language was audited on its own."""
    df, path = corpus(spark, sf_dir), scratch_path(spark, "state")
    for (lang,) in sorted(table(spark, sf_dir, "documents").select("lang").distinct().collect()):
        named = df.where(F.col("source") == (" " if lang == "es" else lang))
        state.save_state(state.audit_state(named, "en"), path, lang)
    return audits.audit_from_state(state.load_state(spark, path))


@register(REGISTRY["audit_cube"][1])
def state_cube(spark, sf_dir):
    """The cube of all documents, merged from the states of the languages."""
    return _state(spark, sf_dir)["cube"]


@register(of_corpus(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) AS rows, count(DISTINCT {c}) AS distinct_values, "
    f"count(*) - count(DISTINCT {c}) AS excess, CAST(0 AS DOUBLE) AS distinct_error FROM corpus" for c in ("id", "document_id", "raw_sha256"))))
def state_duplicates(spark, sf_dir):
    return _state(spark, sf_dir)["duplicates"]


# --- coverage ------------------------------------------------------------------------------------------------


@register(REGISTRY["metrics_json"][1])
def coverage_by_year(spark, sf_dir):
    return coverage.coverage_by_year(corpus(spark, sf_dir))


@register(REGISTRY["metrics_json"][1])
def full_audit_by_year(spark, sf_dir):
    """The yearly table cut from the one-scan cube."""
    return audits.full_audit(corpus(spark, sf_dir), "en")["by_year"]


@register(of_corpus("SELECT court, count(*) AS decisions, " + _count("length(text) < 300", "lt_300")
                    + " FROM corpus GROUP BY court"))
def coverage_by_court(spark, sf_dir):
    return coverage.coverage_by_court(corpus(spark, sf_dir))


@register(of_corpus("SELECT year, court, count(*) AS decisions, CAST(quantile_disc(length(text), 0.5) AS INTEGER) AS "
                    "median_chars, " + _count("length(text) < 300", "lt_300") + " FROM corpus GROUP BY year, court"))
def coverage_year_court(spark, sf_dir):
    return coverage.coverage_year_court(corpus(spark, sf_dir))


@register(of_corpus("SELECT year, court, count(*) AS decisions, min(text_len) AS min_text_len, "
                    "CAST(quantile_disc(text_len, 0.5) AS INTEGER) AS median_text_len, max(text_len) AS max_text_len "
                    "FROM corpus GROUP BY year, court"))
def coverage_stored_length(spark, sf_dir):
    return audits.coverage_audit(corpus(spark, sf_dir))["by_year_court"]


@register(of_corpus("SELECT year, count(*) AS decisions, count(DISTINCT court) AS active_courts FROM corpus GROUP BY year"))
def active_labels_by_year(spark, sf_dir):
    return audits.gap_audit(corpus(spark, sf_dir))["active_labels"]


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items by day: a court is a part and discount, so that some courts miss a year."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("/", "l_returnflag", "l_linestatus", "l_linenumber", "l_discount", "l_tax").alias("court"),
        F.year("l_shipdate").alias("year"))


@register("WITH cells AS (SELECT concat_ws('/', l_returnflag, l_linestatus, l_linenumber, l_discount, l_tax) AS court, "
          "CAST(year(l_shipdate) AS INTEGER) AS year, count(*) AS n FROM lineitem GROUP BY ALL) "
          "SELECT a.court, CAST(a.year + 1 AS INTEGER) AS year, a.n AS before_rows, b.n AS after_rows FROM cells a "
          "JOIN cells b ON a.court = b.court AND b.year = a.year + 2 WHERE a.n >= 2 AND b.n >= 2 AND a.year + 1 BETWEEN "
          "1996 AND 2000 AND NOT EXISTS (SELECT 1 FROM cells m WHERE m.court = a.court AND m.year = a.year + 1)")
def internal_gaps(spark, sf_dir):
    return coverage.internal_gaps(_cells(spark, sf_dir), floor=2, years=(1996, 2000))


def _order_years(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ours = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(
        F.count("*").alias("corpus_rows"))
    shipped = table(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").alias("year"), "l_orderkey").agg(
        F.lit(1).alias("one"))
    return ours, shipped.groupBy("year").agg(F.count("*").alias("total"))


_YEARS = ("WITH ours AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS corpus_rows FROM orders GROUP BY "
          "1), theirs AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, count(DISTINCT l_orderkey) AS total FROM "
          "lineitem GROUP BY 1) ")


@register(_YEARS + "SELECT year, coalesce(corpus_rows, 0) AS corpus_rows, coalesce(total, 0) AS total, "
          "coalesce(corpus_rows, 0) - coalesce(total, 0) AS difference FROM ours FULL JOIN theirs USING (year)")
def compare_year_counts(spark, sf_dir):
    return coverage.compare_year_counts(*_order_years(spark, sf_dir), "corpus_rows", "total")


@register(_YEARS + "SELECT year, coalesce(corpus_rows, 0) AS corpus_rows, total, total - coalesce(corpus_rows, 0) AS "
          "difference, coalesce(corpus_rows, 0) / total AS ratio, 'ok' AS status FROM theirs LEFT JOIN ours USING (year)")
def coverage_vs_totals(spark, sf_dir):
    return audits.coverage_vs_reference_totals(*_order_years(spark, sf_dir))["by_year"]


@register(_YEARS + "SELECT count(*) AS years_retrieved, CAST(sum(coalesce(corpus_rows, 0)) AS BIGINT) AS corpus_rows, "
          "CAST(sum(total) AS BIGINT) AS total, CAST(sum(total) - sum(coalesce(corpus_rows, 0)) AS BIGINT) AS difference, "
          "sum(coalesce(corpus_rows, 0)) / sum(total) AS ratio FROM theirs LEFT JOIN ours USING (year) "
          "WHERE year BETWEEN 1996 AND 2000")
def complete_period_ratio(spark, sf_dir):
    compared = coverage.coverage_vs_totals(*_order_years(spark, sf_dir))
    return coverage.complete_period_ratio(compared, (1996, 2000))


_PHRASE_ROWS = " UNION ALL ".join(
    f"SELECT year, '{p}' AS phrase, count(*) FILTER (WHERE {_any(p.split(' OR '))}) AS total, count(*) AS corpus_rows "
    "FROM corpus GROUP BY year" for p in PHRASES)


@register(of_corpus("SELECT *, CASE WHEN total > 0 THEN corpus_rows / total END AS corpus_over_query_total FROM ("
                    + _PHRASE_ROWS + ")"))
def phrase_totals(spark, sf_dir):
    return coverage.phrase_totals(corpus(spark, sf_dir))


@register(of_corpus("SELECT year, count(*) AS phrases, count(DISTINCT total) AS distinct_totals, min(total) AS min_total, "
                    f"max(total) AS max_total FROM ({_PHRASE_ROWS}) GROUP BY year"))
def phrase_agreement(spark, sf_dir):
    return coverage.phrase_agreement(coverage.phrase_totals(corpus(spark, sf_dir)))


# --- samples and ranked lists --------------------------------------------------------------------------------


def _ranked(group: str, where: str = "true", source: str = "corpus", key: str = "id") -> str:
    return (f"SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY md5(CAST({key} AS VARCHAR)), {key}) AS rn "
            f"FROM {source} WHERE {where}")


@register("SELECT year, o_orderkey FROM (SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, row_number() OVER "
          "(PARTITION BY year(o_orderdate) ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey) AS rn FROM orders) "
          "WHERE rn <= 70 AND year BETWEEN 1996 AND 2000")
def top_n_per_year(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"))
    return sampling.top_n_per_year(orders, 70, (1996, 2000), "o_orderkey").select("year", "o_orderkey")


@register("SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 40")
def top_n_global(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return sampling.top_n_global(orders, 40, "o_orderkey")


@register(of_corpus("SELECT id, year, modern FROM (" + _ranked(
    "modern", source="(SELECT *, CASE WHEN year BETWEEN 2016 AND 2026 THEN 1 ELSE 0 END AS modern FROM corpus)")
    + ") WHERE rn <= CASE modern WHEN 1 THEN 200 ELSE 50 END"))
def top_n_per_stratum(spark, sf_dir):
    return screening.entity_sample(corpus(spark, sf_dir)).select("id", "year", "modern")


@register(of_corpus("SELECT modern, count(*) AS rows FROM (" + _ranked(
    "modern", source="(SELECT *, CASE WHEN year BETWEEN 2016 AND 2026 THEN 1 ELSE 0 END AS modern FROM corpus)")
    + ") WHERE rn <= CASE modern WHEN 1 THEN 200 ELSE 50 END GROUP BY modern"))
def stratum_sizes(spark, sf_dir):
    return sampling.stratum_sizes(screening.entity_sample(corpus(spark, sf_dir)))


@register("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_orderstatus, o_custkey, o_orderkey) AS rn "
          "FROM orders")
def global_rank(spark, sf_dir):
    keys = ("o_orderpriority", "o_orderstatus", "o_custkey", "o_orderkey")
    ranked = sampling.global_rank(table(spark, sf_dir, "orders").select(*keys), *[F.col(k) for k in keys])
    return ranked.select("o_orderkey", "rn")


_SYSTEMATIC = ("SELECT rn, id, document_id, court, esas_no, karar_no, karar_tarihi, year, text_len, raw_sha256, "
               "'' AS official_source_status, '' AS metadata_match, '' AS text_match, '' AS reviewer_note FROM (SELECT *, "
               "row_number() OVER (ORDER BY year, court, coalesce(esas_no, ''), coalesce(karar_no, ''), id) AS rn "
               "FROM corpus) WHERE (rn - 1) % greatest((SELECT count(*) FROM corpus) // 120, 1) = 0 ORDER BY rn LIMIT 120")


@register(of_corpus(_SYSTEMATIC))
def systematic_sample(spark, sf_dir):
    return sampling.systematic_sample(corpus(spark, sf_dir), 120)


_STRATA = (
    "SELECT *, 'modern_2016_2026' AS stratum FROM (" + _ranked("year") + ") WHERE year BETWEEN 2016 AND 2026 AND rn <= 70 "
    "UNION ALL SELECT *, 'mid_2006_2015' FROM (" + _ranked("year") + ") WHERE year BETWEEN 2006 AND 2015 AND rn <= 19 "
    "UNION ALL SELECT *, 'old_pre_2006' FROM (" + _ranked("1", "year < 2006") + ") WHERE rn <= 40")
_GROUP = ("CASE WHEN lower(court) LIKE '%ceza%' THEN 'ceza' WHEN lower(court) LIKE '%hukuk%' THEN 'hukuk' ELSE 'other' "
          "END AS court_group")


@register(of_corpus(f"SELECT id, year, court, stratum, {_GROUP}, md5(text) AS text_md5 FROM ({_STRATA})"))
def stratified_sample(spark, sf_dir):
    picked = sampling.stratified_sample(corpus(spark, sf_dir))
    return picked.select("id", "year", "court", "stratum", "court_group", F.md5("text").alias("text_md5"))


_PLACED = ("SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY year, md5(id), id) - 1 AS at, count(*) OVER "
           f"(PARTITION BY stratum) AS size FROM ({_STRATA})")
_EVEN = (
    f"SELECT p.*, w.turn * 1000 + s.i AS spot FROM ({_PLACED}) p JOIN (VALUES ('modern_2016_2026', 70, 0), "
    "('mid_2006_2015', 20, 1), ('old_pre_2006', 10, 2)) w(name, want, turn) ON w.name = p.stratum JOIN "
    "(SELECT unnest(range(0, 70)) AS i) s ON s.i < least(w.want, p.size) AND p.at = CASE WHEN p.size <= w.want THEN s.i "
    "ELSE CAST(round_even(s.i * (p.size - 1) / (w.want - 1), 0) AS BIGINT) END")


@register(of_corpus(f"SELECT id, stratum, CAST(row_number() OVER (ORDER BY spot) AS INTEGER) AS sample_index FROM ({_EVEN})"))
def evenly_pick(spark, sf_dir):
    picked = sampling.evenly_pick(sampling.stratified_sample(corpus(spark, sf_dir)).select("id", "year", "stratum"))
    return picked.select("id", "stratum", "sample_index")


@register("SELECT o_orderkey FROM orders ORDER BY md5('20260919:' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 100")
def reservoir_sample(spark, sf_dir):
    return sampling.reservoir_sample(table(spark, sf_dir, "orders").select("o_orderkey"), id_column="o_orderkey")


@register(of_corpus(f"SELECT {_LISTED.replace('chars', 'CAST(length(text) AS INTEGER) AS chars')}, md5(text) AS text_md5 "
                    "FROM corpus WHERE length(text) < 300 ORDER BY length(text), id LIMIT 200"))
def shortest_texts(spark, sf_dir):
    listed = sampling.shortest_texts(corpus(spark, sf_dir))
    return listed.select(*[c for c in listed.columns if c != "text"], F.md5("text").alias("text_md5"))


@register(of_corpus(f"SELECT {_LISTED}, severity FROM ({_SUSPICIOUS}) ORDER BY severity, chars, id LIMIT 1000"))
def state_suspicious(spark, sf_dir):
    return _state(spark, sf_dir)["suspicious"].drop("text")


@register(of_corpus(f"SELECT id, year, court, stratum, {_GROUP}, md5(text) AS text_md5 FROM ({_STRATA})"))
def state_sample(spark, sf_dir):
    picked = _state(spark, sf_dir)["verification_sample"]
    return picked.select("id", "year", "court", "stratum", "court_group", F.md5("text").alias("text_md5"))


@register(of_corpus(f"SELECT {_LISTED}, severity FROM ({_SUSPICIOUS}) ORDER BY severity, chars, id LIMIT 1000"))
def suspicious_top(spark, sf_dir):
    return sampling.suspicious_top(corpus(spark, sf_dir)).drop("text")


@register(of_corpus(f"SELECT {_LISTED}, severity FROM ({_SUSPICIOUS}) ORDER BY severity, chars, id LIMIT 12"))
def first_k(spark, sf_dir):
    return sampling.first_k(sampling.suspicious_top(corpus(spark, sf_dir))).drop("text")


@register("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 5 OFFSET 495")
def page_of_records(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return sampling.page(orders, 100, 5, F.col("o_orderdate"), F.col("o_orderkey"))


# --- personal data -------------------------------------------------------------------------------------------

_DIRECT = {n: f"regexp_matches(text, {quote(p)})" for _, n, p in DIRECT_PATTERNS}
_PII = (
    "count(*) AS rows, " + _count("coalesce(masked_count, 0) > 0", "rows_with_dataset_masking")
    + ", coalesce(CAST(sum(masked_count) AS BIGINT), 0) AS total_dataset_masked_count, "
    + _counts({f"{n}_rows": p for n, p in _DIRECT.items()}) + ", "
    + _counts({n: f"contains(text, {quote(t)})" for n, t in MASK_TOKENS.items()}))


@register(of_corpus(f"SELECT {_PII} FROM corpus"))
def pii_screen(spark, sf_dir):
    return screening.pii_screen(corpus(spark, sf_dir))


@register(of_corpus(f"SELECT year, {_PII} FROM corpus GROUP BY year"))
def pii_by_year(spark, sf_dir):
    return screening.pii_by_year(corpus(spark, sf_dir))


_SIGNALS = {n: f"regexp_matches(text, {quote(p)})" for n, p in CONTEXT_PATTERNS.items()}
_CONTEXT_SAMPLE = ("SELECT text, year, id, modern FROM (" + _ranked(
    "modern", source="(SELECT *, CASE WHEN year BETWEEN 2016 AND 2026 THEN 1 ELSE 0 END AS modern FROM corpus)")
    + ") WHERE rn <= CASE modern WHEN 1 THEN 40000 ELSE 10000 END")


@register(of_corpus(f"SELECT count(*) AS rows_sampled, {_count('modern = 1', 'modern_rows')}, {_counts(_SIGNALS)} "
                    f"FROM ({_CONTEXT_SAMPLE})"))
def signal_counts(spark, sf_dir):
    return screening.signal_counts(screening.contextual_sample(corpus(spark, sf_dir)))


@register(of_corpus(" UNION ALL ".join(
    f"SELECT '{n}' AS signal, count(*) FILTER (WHERE {p}) AS rows, count(*) FILTER (WHERE {p}) / count(*) AS rate "
    f"FROM ({_CONTEXT_SAMPLE})" for n, p in _SIGNALS.items())))
def contextual_screen(spark, sf_dir):
    return screening.contextual_screen(corpus(spark, sf_dir))


def _masked(column: str) -> str:
    for label, _, p in DIRECT_PATTERNS:
        column = f"regexp_replace({column}, {quote(p)}, '[{label}]', 'g')"
    return column


@register(of_corpus(f"SELECT id, md5({_masked('text')}) AS sanitized_md5 FROM corpus"))
def sanitize(spark, sf_dir):
    return screening.sanitize(corpus(spark, sf_dir)).select("id", F.md5("sanitized").alias("sanitized_md5"))


_RESIDUAL = {label.lower(): f"regexp_matches(sanitized, {quote(p)})" for label, _, p in DIRECT_PATTERNS}
_BEFORE = {label.lower(): f"regexp_matches(text, {quote(p)})" for label, _, p in DIRECT_PATTERNS}


@register(of_corpus(
    "SELECT *, " + " + ".join(f"residual_{k}" for k in _RESIDUAL) + " AS residual_sum, "
    + " + ".join(f"residual_{k}" for k in _RESIDUAL) + " = 0 AS passed FROM (SELECT count(*) AS rows, "
    + _count("text <> sanitized", "rows_changed") + ", "
    + _counts({f"before_{k}": p for k, p in _BEFORE.items()} | {f"residual_{k}": p for k, p in _RESIDUAL.items()})
    + f" FROM (SELECT text, {_masked('text')} AS sanitized FROM corpus))"))
def sanitize_check(spark, sf_dir):
    return screening.sanitize_check(corpus(spark, sf_dir))


@register()
def sanitize_guarded(spark, sf_dir):
    """Masking that leaves the neighbours of a number alone (the patterns use look-arounds, which the SQL engine lacks)."""
    return screening.sanitize_check(corpus(spark, sf_dir), guarded=True)


def _chunks(source: str) -> str:
    return ("SELECT id, k AS chunk_no, substr(text, k * 1400 + 1, 1500) AS chunk FROM ("
            f"SELECT id, text, unnest(range({_WINDOWS})) AS k FROM ({source}))")


def _found(source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT id, chunk_no, '{label}' AS label FROM ({_chunks(source)}) WHERE regexp_matches(chunk, {quote(p)})"
        for label, _, p in DIRECT_PATTERNS)


_DRAWN = ("SELECT * FROM (" + _ranked(
    "modern", source="(SELECT *, CASE WHEN year BETWEEN 2016 AND 2026 THEN 1 ELSE 0 END AS modern FROM corpus)")
    + ") WHERE rn <= CASE modern WHEN 1 THEN 200 ELSE 50 END")
_CHUNKS, _FOUND = _chunks(_DRAWN), _found(_DRAWN)


@register(of_corpus(f"SELECT t AS threshold, label, count(*) AS entities, count(DISTINCT id) AS documents FROM ({_found('SELECT * FROM corpus')}), "
                    "(VALUES (CAST(0.8 AS DOUBLE)), (CAST(0.9 AS DOUBLE))) v(t) GROUP BY t, label"))
def entity_counts_all(spark, sf_dir):
    """Every window of every document."""
    return audits.entity_audit(corpus(spark, sf_dir), limits=None)["entities"]


@register(of_corpus(f"SELECT t AS threshold, label, count(*) AS entities, count(DISTINCT id) AS documents FROM ({_FOUND}), "
                    "(VALUES (CAST(0.8 AS DOUBLE)), (CAST(0.9 AS DOUBLE))) v(t) GROUP BY t, label"))
def entity_counts(spark, sf_dir):
    return audits.entity_audit(corpus(spark, sf_dir))["entities"]


@register(of_corpus("SELECT t AS threshold, (SELECT count(DISTINCT id) FROM (" + _FOUND + ")) AS documents_with_any_entity "
                    "FROM (VALUES (CAST(0.8 AS DOUBLE)), (CAST(0.9 AS DOUBLE))) v(t)"))
def documents_with_entities(spark, sf_dir):
    return audits.entity_audit(corpus(spark, sf_dir))["documents"]


@register(of_corpus("SELECT count(*) AS chunks_scanned, " + _count("length(chunk) < 100", "inference_errors")
                    + f", count(*) FILTER (WHERE length(chunk) < 100) / count(*) AS error_rate, count(*) FILTER (WHERE "
                    f"length(chunk) < 100) / count(*) <= 0.05 AS valid FROM ({_CHUNKS})"))
def entity_run_quality(spark, sf_dir):
    """A detector that fails on short chunks: the failures are counted, not hidden."""

    def detector(chunk: str) -> list[tuple[str, float]]:
        if len(chunk) < 100:
            raise ValueError("too short")
        return [("LETTER", 0.85)] * chunk.count("Q")

    return audits.entity_audit(corpus(spark, sf_dir), detector)["quality"]


# --- second source -------------------------------------------------------------------------------------------

_X = ("ext0", "ext", "cand", "cand_key", "ext_key")


def of_sources(body: str) -> str:
    return with_ctes(*_X, body=body)


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return (matching.external_keys(second_source(spark, sf_dir)), matching.candidate_keys(candidate(spark, sf_dir)))


_HAS_ID = "EXISTS (SELECT 1 FROM cand_key c WHERE c.id_num = e.id_num)"
_HAS_KEY = ("EXISTS (SELECT 1 FROM cand_key c WHERE c.court_n = e.court_n AND c.esas_n = e.esas_n AND "
            "c.karar_n = e.karar_n)")
_IN_EXT = ("EXISTS (SELECT 1 FROM ext_key e WHERE e.court_n = c.court_n AND e.esas_n = c.esas_n AND "
           "e.karar_n = c.karar_n)")
_OVERLAP = "SELECT count(*) FROM ext_key e JOIN cand_key c ON e.id_num = c.id_num"


@register(of_sources(_OVERLAP.replace("count(*)", "count(*) AS exact_document_id_overlap")))
def overlap_by_id(spark, sf_dir):
    return matching.overlap_by_id(*_both(spark, sf_dir))


@register(of_sources(f"SELECT document_id, court_n, esas_n, karar_n, decision_year FROM ext_key e WHERE NOT {_HAS_ID}"))
def ids_not_in_candidate(spark, sf_dir):
    return matching.ids_not_in(*_both(spark, sf_dir)).drop("id_num")


@register(of_sources("SELECT document_id, court_n, esas_n, karar_n, year FROM cand_key c WHERE NOT EXISTS "
                     "(SELECT 1 FROM ext_key e WHERE e.id_num = c.id_num)"))
def candidate_ids_not_in_external(spark, sf_dir):
    ext, cand = _both(spark, sf_dir)
    return matching.ids_not_in(cand, ext).drop("id_num")


@register(of_sources(f"SELECT document_id FROM ext_key e WHERE NOT {_HAS_ID} AND {_HAS_KEY}"))
def key_present(spark, sf_dir):
    ext, cand = _both(spark, sf_dir)
    return matching.key_present(matching.ids_not_in(ext, cand), cand).select("document_id")


@register(of_sources(f"SELECT document_id FROM ext_key e WHERE NOT {_HAS_ID} AND NOT {_HAS_KEY}"))
def key_absent(spark, sf_dir):
    ext, cand = _both(spark, sf_dir)
    return matching.key_absent(matching.ids_not_in(ext, cand), cand).select("document_id")


@register(of_sources(f"SELECT document_id FROM cand_key c WHERE NOT {_IN_EXT}"))
def candidate_keys_not_in_external(spark, sf_dir):
    ext, cand = _both(spark, sf_dir)
    return matching.key_absent(cand, ext).select("document_id")


_METRICS = {
    "external_rows": "SELECT count(*) FROM ext_key",
    "candidate_rows": "SELECT count(*) FROM cand_key",
    "external_distinct_document_id": "SELECT count(DISTINCT document_id) FROM ext_key",
    "candidate_distinct_document_id": "SELECT count(DISTINCT document_id) FROM cand_key",
    "candidate_non_numeric_document_id": "SELECT count(*) FROM cand_key WHERE id_num IS NULL",
    "exact_document_id_overlap": _OVERLAP,
    "external_document_ids_not_in_candidate": f"SELECT count(*) FROM ext_key e WHERE NOT {_HAS_ID}",
    "candidate_document_ids_not_in_external":
        "SELECT count(*) FROM cand_key c WHERE NOT EXISTS (SELECT 1 FROM ext_key e WHERE e.id_num = c.id_num)",
    "candidate_distinct_metadata_key":
        "SELECT count(*) FROM (SELECT court_n, esas_n, karar_n FROM cand_key GROUP BY ALL)",
    "external_distinct_metadata_key": "SELECT count(*) FROM (SELECT court_n, esas_n, karar_n FROM ext_key GROUP BY ALL)",
    "external_metadata_duplicate_excess":
        "SELECT (SELECT count(*) FROM ext_key) - (SELECT count(*) FROM (SELECT court_n, esas_n, karar_n FROM ext_key "
        "GROUP BY ALL))",
    "external_missing_docid_but_metadata_key_present":
        f"SELECT count(*) FROM ext_key e WHERE NOT {_HAS_ID} AND {_HAS_KEY}",
    "external_metadata_keys_absent_from_candidate":
        f"SELECT count(*) FROM ext_key e WHERE NOT {_HAS_ID} AND NOT {_HAS_KEY}",
    "candidate_metadata_keys_absent_from_external": f"SELECT count(*) FROM cand_key c WHERE NOT {_IN_EXT}",
}


@register(of_sources(" UNION ALL ".join(f"SELECT '{n}' AS metric, ({q}) AS value" for n, q in _METRICS.items())))
def cross_source_audit(spark, sf_dir):
    return audits.cross_source_audit(candidate(spark, sf_dir), second_source(spark, sf_dir))["metrics"]


@register(of_sources(
    "SELECT year, coalesce(candidate_rows, 0) AS candidate_rows, coalesce(external_unique_keys, 0) AS external_unique_keys, "
    "coalesce(candidate_rows, 0) - coalesce(external_unique_keys, 0) AS candidate_minus_external_unique_keys, "
    "coalesce(external_rows, 0) AS external_rows FROM (SELECT CAST(year AS INTEGER) AS year, count(*) AS candidate_rows "
    "FROM cand_key WHERE year BETWEEN 2016 AND 2026 GROUP BY 1) FULL JOIN (SELECT decision_year AS year, count(*) AS "
    "external_rows, count(DISTINCT (court_n, esas_n, karar_n)) AS external_unique_keys FROM ext_key WHERE decision_year "
    "BETWEEN 2016 AND 2026 GROUP BY 1) USING (year)"))
def cross_source_by_year(spark, sf_dir):
    return audits.cross_source_audit(candidate(spark, sf_dir), second_source(spark, sf_dir))["by_year"]


_R = ("plain0", "altered0", "plain", "altered", "residual", "met")


def of_pairs(body: str) -> str:
    return with_ctes(*_R, body=body)


def _residual(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = matching.reconcile_candidate(views.plain_documents(spark, sf_dir))
    return matching.exact_residual(matching.reconcile_external(views.altered_documents(spark, sf_dir)), c), c


@register(of_pairs("SELECT document_id, court, canon, ey, en, ky, kn FROM residual"))
def exact_residual(spark, sf_dir):
    return _residual(spark, sf_dir)[0].select("document_id", "court", "canon", "ey", "en", "ky", "kn")


@register(of_pairs("SELECT ey, en, ky, kn, ext_court, cand_court, count(*) AS n_pairs, round(max(similarity), 9) AS "
                   "similarity FROM met GROUP BY ALL"))
def numeric_key_match(spark, sf_dir):
    pairs = matching.label_matches(*_residual(spark, sf_dir))
    return pairs.select("ey", "en", "ky", "kn", "ext_court", "cand_court", "n_pairs",
                        F.round("similarity", 9).alias("similarity"))


def _ids(pred: str) -> str:
    return f"(SELECT count(DISTINCT document_id) FROM met WHERE {pred})"


@register(of_pairs(
    f"SELECT (SELECT count(*) FROM residual) AS external_residual_exact_key, (SELECT count(*) FROM residual WHERE "
    "ey IS NOT NULL AND en IS NOT NULL AND ky IS NOT NULL AND kn IS NOT NULL) AS residual_numeric_key_parseable, "
    f"{_ids('true')} AS ids_with_same_numeric_key, "
    f"{_ids('ext_canon = cand_canon')} AS ids_with_court_canon_exact, {_ids('similarity >= 0.95')} AS "
    f"ids_with_similarity_ge_095, {_ids('similarity >= 0.90')} AS ids_with_similarity_ge_090, "
    f"{_ids('ext_day = cand_day')} AS ids_with_same_numeric_key_and_date, (SELECT count(*) FROM residual e WHERE NOT "
    "EXISTS (SELECT 1 FROM met m WHERE m.document_id = e.document_id AND m.similarity >= 0.90)) AS "
    "external_residual_after_fuzzy"))
def reconcile(spark, sf_dir):
    return audits.reconcile(views.plain_documents(spark, sf_dir), views.altered_documents(spark, sf_dir))["summary"]


@register(of_pairs("SELECT document_id FROM residual e WHERE NOT EXISTS (SELECT 1 FROM met m WHERE m.document_id = "
                   "e.document_id AND m.similarity >= 0.90)"))
def residual_after_fuzzy(spark, sf_dir):
    tables = audits.reconcile(views.plain_documents(spark, sf_dir), views.altered_documents(spark, sf_dir))
    return tables["left_over"].select("document_id")


@register(of_pairs("SELECT ext_court, cand_court, count(*) AS n, round(max(similarity), 4) AS similarity FROM met WHERE "
                   "ext_canon <> cand_canon AND similarity >= 0.90 GROUP BY ext_court, cand_court ORDER BY n DESC, "
                   "similarity DESC, ext_court, cand_court LIMIT 50"))
def alias_pairs(spark, sf_dir):
    return audits.reconcile(views.plain_documents(spark, sf_dir), views.altered_documents(spark, sf_dir))["aliases"]


# --- official texts ------------------------------------------------------------------------------------------


def _official(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landed.read_document_payloads(spark, views.payload_folder(spark, sf_dir))


@register(with_ctes("corpus", "official", body=(
    "SELECT c.id, coalesce(o.status, 'missing') AS status, o.mime FROM corpus c LEFT JOIN official o USING (document_id)")))
def attach_official_text(spark, sf_dir):
    joined = verification.attach_official_text(corpus(spark, sf_dir), _official(spark, sf_dir))
    return joined.select("id", "status", "mime")


_O, _C = "coalesce(o.official_text, '')", "c.text"


@register(with_ctes("corpus", "official", body=(
    "SELECT id, CAST(length(text) AS INTEGER) AS corpus_chars, contains(o, court_x) AS court_present, "
    "contains(o, esas_x) AS esas_present, contains(o, karar_x) AS karar_present, length(c) > 0 AND contains(o, c) AS "
    "corpus_in_official, length(o) > 0 AND contains(c, o) AS official_in_corpus, CASE WHEN greatest(length(c), length(o)) "
    "= 0 THEN 1.0 ELSE round_even(least(length(c), length(o)) / greatest(length(c), length(o)), 6) END AS "
    f"normalized_length_ratio FROM (SELECT id, text, {_NORM.format('text')} AS c, {_NORM.format('official_text')} AS o, "
    f"{_NORM.format('court')} AS court_x, {_NORM.format('esas_no')} AS esas_x, {_NORM.format('karar_no')} AS karar_x "
    "FROM corpus JOIN official USING (document_id) WHERE status = 'ok')")))
def text_flags(spark, sf_dir):
    """All flags that need no similarity, on every document with an official text."""
    joined = verification.attach_official_text(corpus(spark, sf_dir), _official(spark, sf_dir))
    out = verification.compare_texts(joined).where("status = 'ok'")
    return out.select("id", "corpus_chars", "court_present", "esas_present", "karar_present", "corpus_in_official",
                      "official_in_corpus", "normalized_length_ratio")


@register()
def verify_texts(spark, sf_dir):
    """The evenly picked verification sample against official texts (the similarity has no SQL form)."""
    sample = sampling.evenly_pick(sampling.stratified_sample(corpus(spark, sf_dir)))
    return audits.verify_texts(sample, _official(spark, sf_dir))["results"]


@register()
def match_quality(spark, sf_dir):
    sample = sampling.evenly_pick(sampling.stratified_sample(corpus(spark, sf_dir)))
    return audits.verify_texts(sample, _official(spark, sf_dir))["quality"]


@register()
def probe_suspicious(spark, sf_dir):
    listed = sampling.suspicious_top(corpus(spark, sf_dir))
    return audits.probe_suspicious(listed, _official(spark, sf_dir))["results"]


_PROBED = ("SELECT s.*, o.status, o.official_text FROM (SELECT * FROM (" + _SUSPICIOUS + ") ORDER BY severity, chars, id "
           "LIMIT 12) s LEFT JOIN official o USING (document_id)")
_OFFICIAL_LOW = "lower(replace(official_text, 'İ', 'i'))"


@register(with_ctes("corpus", "official", body=(
    "SELECT id, coalesce(status, 'missing') AS status, "
    + ", ".join(f"{_any([w])} AS {n.replace('placeholder', 'corpus_has')}, {_any([w], _OFFICIAL_LOW)} AS "
                f"{n.replace('placeholder', 'official_has')}" for n, w in PLACEHOLDERS.items()) + f" FROM ({_PROBED})")))
def placeholder_flags(spark, sf_dir):
    listed = sampling.suspicious_top(corpus(spark, sf_dir))
    out = audits.probe_suspicious(listed, _official(spark, sf_dir))["results"]
    names = [n.replace("placeholder", f"{side}_has") for n in PLACEHOLDERS for side in ("corpus", "official")]
    return out.select("id", "status", *names)


@register(with_ctes("corpus", "official", body=(
    "SELECT count(*) AS requested, " + _count("status = 'ok'", "official_retrieved") + ", "
    + _counts({n.replace("placeholder", "official_preserves"): f"status = 'ok' AND {_any([w], _OFFICIAL_LOW)}"
               for n, w in PLACEHOLDERS.items()}) + f" FROM ({_PROBED})")))
def placeholder_quality(spark, sf_dir):
    listed = sampling.suspicious_top(corpus(spark, sf_dir))
    return audits.probe_suspicious(listed, _official(spark, sf_dir))["quality"]


def _norm(column: str) -> str:
    return _NORM.format(column)


@register(with_ctes("corpus", "official", body=(
    "SELECT count(*) AS requested, " + _count("status = 'ok'", "official_retrieved") + ", " + _count(
        f"status = 'ok' AND contains({_norm('official_text')}, {_norm('court')}) AND contains({_norm('official_text')}, "
        f"{_norm('esas_no')}) AND contains({_norm('official_text')}, {_norm('karar_no')})", "metadata_all_three_present")
    + f" FROM ({_EVEN}) e LEFT JOIN official USING (document_id)")))
def verification_counts(spark, sf_dir):
    """The counts of the verification that need no similarity."""
    sample = sampling.evenly_pick(sampling.stratified_sample(corpus(spark, sf_dir)))
    quality = audits.verify_texts(sample, _official(spark, sf_dir))["quality"]
    return quality.select("requested", "official_retrieved", "metadata_all_three_present")


# --- landed pages --------------------------------------------------------------------------------------------


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landed.read_search_pages(spark, views.landed_folder(spark, sf_dir))


def of_items(body: str) -> str:
    return with_ctes("page_item", body=body)


@register(of_items("SELECT CAST(start AS INTEGER) AS start, total, 2 AS requested_page_size, CAST(count(*) AS INTEGER) AS "
                   "returned_count, CAST(min(document) AS STRING) AS first_document, CAST(max(document) AS STRING) AS "
                   "last_document FROM page_item GROUP BY start, total"))
def page_facts(spark, sf_dir):
    return audits.delta_page_audit(_pages(spark, sf_dir))["pages"]


@register(of_items("SELECT CAST(p.start AS INTEGER) AS start, count(b.document) AS shared_with_next, count(b.document) = 0 "
                   "AS disjoint FROM page_item p LEFT JOIN page_item b ON b.start = p.start + 2 AND b.document = "
                   "p.document GROUP BY p.start"))
def page_overlap(spark, sf_dir):
    return audits.delta_page_audit(_pages(spark, sf_dir))["overlap"]


@register(of_items("SELECT CAST(document AS STRING) AS \"documentId\", count(DISTINCT start) AS pages, count(*) AS items "
                   "FROM page_item GROUP BY document HAVING count(DISTINCT start) > 1"))
def repeated_documents(spark, sf_dir):
    return audits.delta_page_audit(_pages(spark, sf_dir))["repeated"]


@register(of_items("SELECT count(DISTINCT start) AS pages, count(*) AS items, (SELECT count(*) FROM documents WHERE lang = "
                   "'de') AS short_pages, min(total) AS min_total, max(total) AS max_total FROM page_item"))
def page_summary(spark, sf_dir):
    return audits.delta_page_audit(_pages(spark, sf_dir))["summary"]


@register(of_items("SELECT CAST(document AS STRING) AS \"documentId\", concat(1997 + doc_id % 30, '/', doc_id) AS \"esasNo\", "
                   "source AS \"birimAdi\" FROM page_item ORDER BY start, position LIMIT 10"))
def safe_projection(spark, sf_dir):
    first = landing.first_items(landed.page_items(_pages(spark, sf_dir)))
    return first.select("documentId", "esasNo", "birimAdi")


@register(of_items("SELECT CAST(document AS STRING) AS \"documentId\", CAST(start AS INTEGER) AS start, CAST(concat(1997 + "
                   "doc_id % 30, '-', lpad(CAST(1 + doc_id % 12 AS STRING), 2, '0'), '-', lpad(CAST(1 + doc_id % 28 AS "
                   "STRING), 2, '0')) AS DATE) + 1 AS decision_day FROM page_item WHERE lang IN ('en', 'fr') AND CAST("
                   "concat(1997 + doc_id % 30, '-', lpad(CAST(1 + doc_id % 12 AS STRING), 2, '0'), '-', lpad(CAST(1 + "
                   "doc_id % 28 AS STRING), 2, '0')) AS DATE) BETWEEN DATE '2003-05-07' AND DATE '2021-09-18'"))
def records_in_window(spark, sf_dir):
    items = landing.with_local_day(landed.page_items(_pages(spark, sf_dir)), "+03:00")
    used = landing.records_in_window(items, ["EN", "FR"], "2003-05-07T00:00:00.000Z", "2021-09-19T00:00:00.000Z")
    return used.select("documentId", "start", F.col("decision_day"))


_TYPES = {"birimAdi": "str", "birimId": "null", "documentId": "str", "esasNo": "str", "esasNoSira": "int",
          "esasNoYil": "int", "itemType": "dict", "kararTarihi": "str"}


@register(of_items(" UNION ALL ".join(f"SELECT '{f}' AS field, '{t}' AS type, count(*) AS items FROM page_item"
                                      for f, t in _TYPES.items())))
def field_types(spark, sf_dir):
    return landing.field_types(spark.read.text(views.landed_folder(spark, sf_dir)))


# --- merged pages, overlap of texts, lineage --------------------------------------------------------------------

_NEXT_DAY = ("(CAST(concat(1997 + doc_id % 30, '-', lpad(CAST(1 + doc_id % 12 AS STRING), 2, '0'), '-', "
             "lpad(CAST(1 + doc_id % 28 AS STRING), 2, '0')) AS DATE) + 1)")
_FRESH = (
    "SELECT concat('landed:', document) AS id, CAST(document AS STRING) AS document_id, concat(1997 + doc_id % 30, '/', "
    f"doc_id) AS esas_no, CAST({_NEXT_DAY} AS STRING) AS karar_tarihi, CAST(year({_NEXT_DAY}) AS SMALLINT) AS year FROM ("
    "SELECT *, row_number() OVER (PARTITION BY document ORDER BY start, position) AS r FROM page_item) p WHERE r = 1 "
    "AND NOT EXISTS (SELECT 1 FROM corpus c WHERE c.source <> 'fr' AND c.document_id = CAST(p.document AS STRING)) "
    "AND NOT EXISTS (SELECT 1 FROM corpus c WHERE c.source <> 'fr' AND c.esas_no = concat(1997 + p.doc_id % 30, '/', p.doc_id))")
_MERGED = ("id", "document_id", "esas_no", "karar_tarihi", "year")


@register(with_ctes("corpus", "page_item", body=(
    f"SELECT {', '.join(_MERGED)} FROM corpus WHERE source <> 'fr' UNION ALL {_FRESH}")))
def merge_delta(spark, sf_dir):
    """Landed pages merged into a snapshot that lacks one language."""
    snapshot = corpus(spark, sf_dir).where("source <> 'fr'")
    records = delta.landed_records(_pages(spark, sf_dir), "landed", "+03:00")
    return delta.merge_delta(snapshot, records, ("esas_no",)).select(*_MERGED)


@register(with_ctes("corpus", "page_item", body=_FRESH))
def delta_stream(spark, sf_dir):
    """The same pages as a stream of files; what its sink holds."""
    snapshot = corpus(spark, sf_dir).where("source <> 'fr'")
    sink, marks = scratch_path(spark, "sink"), scratch_path(spark, "marks")
    landed_pages = views.landed_folder(spark, sf_dir)
    return delta.delta_stream(spark, landed_pages, snapshot, sink, marks, "landed", ("esas_no",), "+03:00").select(*_MERGED)


@register(of_corpus(
    f"SELECT id, coalesce(n, 0) AS in_other FROM (SELECT id, {_norm('text')} AS x FROM corpus WHERE court = '-') a LEFT JOIN "
    f"(SELECT {_norm('text')} AS x, count(*) AS n FROM corpus WHERE court <> '-' GROUP BY 1) b ON a.x = b.x AND a.x <> ''"))
def text_overlap(spark, sf_dir):
    """Documents of one court with the number of equal texts of the others."""
    df = corpus(spark, sf_dir)
    return duplicates.text_overlap(df.where("court = '-'"), df.where("court <> '-'")).select("id", "in_other")


@register("SELECT count(*) AS rows, count(DISTINCT text) + count(*) FILTER (WHERE text IS NULL) AS groups, count(text) - "
          "count(DISTINCT text) AS excess FROM documents")
def group_excess(spark, sf_dir):
    """Excess over groups of equal texts, named by a hash."""
    return duplicates.group_excess(table(spark, sf_dir, "documents").select(F.md5("text").alias("component_id")))


_NEAR = (
    "w AS (SELECT row_number() OVER () AS uid, id, list_filter(string_split(coalesce({norm}, ''), ' '), lambda x: x <> '') AS w FROM corpus), "
    "s AS (SELECT uid, id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE "
    "list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS s FROM w), "
    "x AS (SELECT uid, len(s) AS n, unnest(s) AS g FROM s), "
    "p AS (SELECT a.uid AS x, b.uid AS y FROM x a JOIN x b ON a.g = b.g AND a.uid <> b.uid GROUP BY a.uid, b.uid, a.n, b.n "
    "HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))), "
    "r AS (SELECT uid AS x, uid AS y FROM s UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x), "
    "c AS (SELECT x, min(y) AS root FROM r GROUP BY x), "
    "near AS (SELECT s.id, len(s.s) AS shingles, c.root, min(s.id) OVER (PARTITION BY c.root) AS least FROM s JOIN c ON c.x = s.uid) ")


def _near(body: str) -> str:
    return "WITH RECURSIVE corpus AS (" + views.CTE["corpus"] + "), " + _NEAR.format(norm=_norm("text")) + body


@register(_near("SELECT id, CAST(shingles AS INTEGER) AS shingles, CASE WHEN shingles > 0 THEN least END AS \"group\" FROM near"))
def near_duplicates(spark, sf_dir):
    """Every document with its group of near duplicates."""
    return near.near_duplicates(corpus(spark, sf_dir)).select("id", "shingles", "group")


@register(_near("SELECT count(*) AS rows, count(DISTINCT root) AS groups, count(*) - count(DISTINCT root) AS excess FROM near"))
def near_duplicate_excess(spark, sf_dir):
    return near.near_duplicate_excess(corpus(spark, sf_dir))


@register(_near(
    "SELECT 'near_duplicate_rate' AS metric, CAST(e AS DOUBLE) AS observed, CASE WHEN e < t.threshold THEN 'PASS' ELSE 'FAIL' END AS "
    "state FROM (SELECT (count(*) - count(DISTINCT root)) / count(*) AS e FROM near) JOIN (VALUES "
    + ", ".join(f"('{m}', CAST({t} AS DOUBLE))" for m, _, t in TARGETS) + ") t(metric, threshold) ON t.metric = 'near_duplicate_rate'"))
def near_duplicate_gate(spark, sf_dir):
    """The gate of near duplicates, with the value found in the documents themselves."""
    df = corpus(spark, sf_dir)
    totals = profile.cube_slice(profile.audit_cube(df), False, False)
    excess = duplicates.column_excess(df, ("id", "document_id", "raw_sha256"))
    metrics = audits.acceptance_metrics(totals, excess, coverage.internal_gaps(df), near=near.near_duplicate_excess(df))
    return audits.acceptance(spark, metrics)["gates"].where("metric = 'near_duplicate_rate'").select("metric", "observed", "state")


@register("SELECT doc_id, 'documents.parquet' AS file, 'r1' AS revision, 64 AS hash_chars, CAST(doc_id AS STRING) AS document, "
          "concat(lang, '/', source) AS key, 'read,traced' AS steps FROM documents")
def with_lineage(spark, sf_dir):
    """All documents with the file they come from; the hash itself is compared in the tests."""
    shards = files.manifest_shards(files.read_manifest(spark, _manifest(spark, sf_dir)))
    traced = lineage.with_lineage(table(spark, sf_dir, "documents"), shards, sf_dir, ("read", "traced"), "doc_id", ("lang", "source"))
    return traced.select(
        "doc_id", "lineage.file", "lineage.revision", F.length("lineage.shard_hash").alias("hash_chars"),
        F.col("lineage.document_id").alias("document"),
        F.when(F.col("lang").isNotNull() & F.col("source").isNotNull(), F.array_join("lineage.key", "/")).alias("key"),
        F.array_join("lineage.steps", ",").alias("steps"))


# --- gates ---------------------------------------------------------------------------------------------------


def _gate_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = corpus(spark, sf_dir)
    totals = profile.cube_slice(profile.audit_cube(df), False, False)
    excess = duplicates.column_excess(df, ("id", "document_id", "raw_sha256"))
    return audits.acceptance_metrics(totals, excess, coverage.internal_gaps(df))


_GATE_VALUES = (
    "SELECT 'valid_document_rate' AS metric, (SELECT (count(*) - count(*) FILTER (WHERE "
    f"{BLANK['empty_text']}) - count(*) FILTER (WHERE {PLACEHOLDER})) / count(*) FROM corpus) AS value "
    "UNION ALL SELECT 'full_text_rate', (SELECT (count(*) - count(*) FILTER (WHERE length(text) < 100)) / count(*) FROM "
    "corpus) UNION ALL SELECT 'exact_duplicate_rate', (SELECT (count(*) - least(count(DISTINCT id), count(DISTINCT "
    "document_id), count(DISTINCT raw_sha256))) / count(*) FROM corpus) UNION ALL SELECT 'critical_coverage_gaps', 0.0")
_GATES = (
    f"SELECT t.metric, t.op, CAST(t.threshold AS DOUBLE) AS threshold, CAST(m.value AS DOUBLE) AS observed, true AS hard, "
    "CASE WHEN m.value IS NULL THEN 'PENDING' WHEN (t.op = '>=' AND m.value >= t.threshold) OR (t.op = '<' AND m.value < "
    "t.threshold) OR (t.op = '<=' AND m.value <= t.threshold) THEN 'PASS' ELSE 'FAIL' END AS state FROM (VALUES "
    + ", ".join(f"('{m}', '{op}', CAST({t} AS DOUBLE))" for m, op, t in TARGETS)
    + f") t(metric, op, threshold) LEFT JOIN ({_GATE_VALUES}) m USING (metric)")


@register(of_corpus(_GATES))
def evaluate_gates(spark, sf_dir):
    return audits.acceptance(spark, _gate_metrics(spark, sf_dir))["gates"]


@register(of_corpus(
    f"SELECT *, CASE WHEN failed > 0 THEN 'REJECT' WHEN passed < gates THEN 'ACCEPT_WITH_CONDITIONS' ELSE 'ACCEPT' END AS "
    "final_state FROM (SELECT count(*) AS gates, count(*) FILTER (WHERE state = 'PASS') AS passed, count(*) FILTER (WHERE "
    "state = 'CONDITIONAL_PASS') AS conditional, count(*) FILTER (WHERE state = 'PENDING') AS pending, count(*) FILTER "
    f"(WHERE state = 'FAIL') AS failed FROM ({_GATES}))"))
def final_state(spark, sf_dir):
    return audits.acceptance(spark, _gate_metrics(spark, sf_dir))["decision"]
