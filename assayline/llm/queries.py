"""Registered queries of the operators, with production parameters over whole tables, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.llm import (
    cap_filters, collocations, language, line_dedup, near_dup, pieces, quality, secrets, sharding, simplex, token_store, url_filter, winnowing)
from assayline.session import scratch_path

LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


OP1_SQL = f"""
with l as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) as pos
  from documents),
k as (select *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), {LETTERS}) as key from l),
f as (select key, max(doc_id) as keeper from k where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
m as (select k.doc_id, pos, line, f.key is not null and k.doc_id <> f.keeper as gone from k left join f on k.key = f.key)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from m group by doc_id"""


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_filters.embedding_links(table(spark, sf_dir, "embeddings")).withColumn("kept", F.col("vec_id") == F.col("component_id"))


OP2_SQL = """
with recursive v as (
  select vec_id, label, embedding::double[] as e from embeddings
  where embedding is not null and label is not null and list_dot_product(embedding::double[], embedding::double[]) > 0),
p as (
  select a.vec_id as x, b.vec_id as y from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.e, b.e) >= 0.98),
r as (select vec_id as x, vec_id as y from embeddings union select r.x, p.y from r join p on r.y = p.x),
n as (select x, count(*) as c from p group by x)
select e.vec_id, coalesce(n.c, 0) as n_links, c.component_id, e.vec_id = c.component_id as kept
from embeddings e join (select x, min(y) as component_id from r group by x) c on c.x = e.vec_id left join n on n.x = e.vec_id"""


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    files = token_store.write_tokens(docs, tokenizer_file("word_bpe_49k.json"), token_store.token_folder(docs))
    return token_store.read_tokens(files, with_ids=False)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: number of pieces, a hash of them, the hash of the decoded text, and whether it is the text."""
    path = tokenizer_file("piece_bpe_32k.model")
    done = pieces.decode(pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path), path)
    return done.select(
        "doc_id", F.size("_pieces").cast("long").alias("n_pieces"), F.xxhash64("_pieces").alias("pieces_hash"),
        F.sha2("_decoded", 256).alias("decoded_sha256"), (F.coalesce("text", F.lit("")) == F.col("_decoded")).alias("exact"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all documents into shards and reads them back: where each one is, and the hash of its text."""
    docs = table(spark, sf_dir, "documents")
    path = scratch_path(spark, "shards")
    sharding.write_shards(docs, path)
    return sharding.read_shards(spark, path, docs).select(
        "doc_id", F.col("_slot").alias("slot"), F.col("_shard").alias("shard"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list holds the canonical URLs that more than one page has."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, url_filter.recrawled(pages)).select(
        "page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), F.col("_verdict").alias("verdict"))


OP6_SQL = rf"""
with a as (select page_id, url, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
b as (
  select page_id, url, rest, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), {LETTERS}), '') as host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path
  from a),
c as (
  select *, case when instr(url, '://') > 0 then
      regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^www\.', '') || regexp_replace(path, '/+$', '')
      || case when len(q) > 0 then '?' || array_to_string(list_sort(q), '&') else '' end end as canonical
  from (select *, list_filter(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'),
          lambda x: x <> '' and not regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)=')) as q from b)),
d as (
  select *, case
      when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
      when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
      when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
      when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/') then 'net/' end as rule,
    count(*) over (partition by canonical) as n
  from c)
select page_id, host, path, rule, case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow'
    when canonical is not null and n > 1 then 'block' else 'allow' end as verdict
from d"""


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.learn(docs.where(~held_out()).select("text", "lang"))
    return language.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out().alias("held_out"), F.col("_lang_pred").alias("lang_pred"), F.col("_score").alias("score"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnowing.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


WORDS = rf"regexp_extract_all(translate(text, {LETTERS}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP8_SQL = f"""
with d as (select doc_id, coalesce({WORDS}, []) as w from documents),
i as (select item_id, coalesce({WORDS}, []) as w from benchmark),
j as (
  select distinct item_id, k, x from (
    select item_id, least(len(w), 10) as k, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2),
        lambda s: array_to_string(w[s : s + least(len(w), 10) - 1], ' '))) as x
    from i where len(w) > 0)),
g as (
  select doc_id, k, unnest(range(1, len(w) - k + 2)) as s,
         unnest(list_transform(range(1, len(w) - k + 2), lambda s: array_to_string(w[s : s + k - 1], ' '))) as x
  from d, (select distinct k from j) where len(w) >= k),
m as (select g.doc_id, g.s, g.k, j.item_id from g join j on g.k = j.k and g.x = j.x),
h as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + k)) as p from m) group by doc_id),
t as (select doc_id, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as items
      from (select distinct doc_id, item_id from m) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join h on d.doc_id = h.doc_id left join t on d.doc_id = t.doc_id"""


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


OP9_SQL = rf"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), {LETTERS}), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (
  select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
      else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) end) as s from w),
x as (select doc_id, len(s) as n, unnest(s) as g from s),
p as (
  select a.doc_id as x, b.doc_id as y from x a join x b on a.g = b.g and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r as (select doc_id as x, doc_id as y from documents union select r.x, p.y from r join p on r.y = p.x)
select s.doc_id, len(s.s)::bigint as n_shingles, c.component_id, s.doc_id = c.component_id as kept
from s join (select x, min(y) as component_id from r group by x) c on c.x = s.doc_id"""


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


OP11_SQL = rf"""
with p as (
  select coalesce(lang, 'und') as lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), {LETTERS}), '[.,;:!?\x0A-\x0D]')) as p from documents),
w as (select row_number() over () as id, lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') as w from p),
o as (select id, lang, unnest(w) as x, unnest(range(1, len(w) + 1)) as i from w),
t as (select lang, x, lead(x) over b as y, lead(x, 2) over b as z from o window b as (partition by id order by i)),
g as (
  select lang, 1 as k, x from t union all select lang, 2, x || ' ' || y from t where y is not null
  union all select lang, 3, x || ' ' || y || ' ' || z from t where z is not null),
f as materialized (select lang, k, x, count(*) as f from g group by lang, k, x),
n as (select lang, sum(f)::bigint as n from f where k = 1 group by lang),
c as materialized (select lang, k, x, f as a, string_split(x, ' ') as w from f where k > 1 and f >= 10),
parts as (
  select lang, k, x, a, i, array_to_string(w[: i], ' ') as head, array_to_string(w[i + 1 :], ' ') as tail
  from c, (select unnest([1, 2]) as i) where i < k),
cuts as (
  select p.lang, p.k, p.x, a, i, l.f as l, r.f as r, ((1000000::hugeint * a * a) // (l.f::hugeint * r.f))::bigint as score
  from parts p join f l on l.lang = p.lang and l.x = head join f r on r.lang = p.lang and r.x = tail),
best as (select * from cuts qualify row_number() over (partition by lang, x order by score, i) = 1),
inside as (
  select lang, x, max(a) as a from (
    select lang, a, array_to_string(w[: 2], ' ') as x from c where k = 3 union all select lang, a, array_to_string(w[2 :], ' ') from c where k = 3)
  group by lang, x),
kept as (
  select best.* from best left join inside on best.k = 2 and inside.lang = best.lang and inside.x = best.x
  where inside.a is null or 100 * inside.a < 50 * best.a)
select kept.lang, row_number() over (partition by kept.lang order by score desc, a desc, x) as rank, x as phrase, a, l, r, n, score
from kept join n on n.lang = kept.lang qualify rank <= 2000"""


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = quality.clean_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(
        "doc_id", *[F.col(f"_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


CLOSERS = quality.CLOSERS.replace("'", "''")


OP12_SQL = rf"""
with d as (select row_number() over () as id, doc_id, coalesce(text, '') as text from documents),
w as (select id, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from d),
o as (select id, unnest(w) as x, unnest(range(1, len(w) + 1)) as i from w),
t as (select id, i, x || ' ' || lead(x) over b || ' ' || lead(x, 2) over b as g from o window b as (partition by id order by i)),
m as (select id, i from t where g is not null qualify count(*) over (partition by id, g) >= 2),
r as (select id, count(distinct p) as n_repeat_words from (select id, unnest([i, i + 1, i + 2]) as p from m) group by id),
s as (select id, unnest(string_split(text, chr(10))) as line, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from d),
l as (
  select id, line, row_number() over (partition by id, line order by i) as copy,
         len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) as n,
         len(regexp_extract_all(line, '[#*$%&|<>]')) as symbols, len(regexp_extract_all(line, '[{quality.SEPARATORS}]')) as seps,
         len(string_split(line, '!!')) + len(string_split(line, '??')) - 2 as shouts,
         rtrim(rtrim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), '{CLOSERS}') as tail
  from s),
f as (
  select id, sum(n) as lost from l where n > 0 and (
    seps >= 2 and n <= 8 * seps or 2 * symbols > n or n >= 5 and regexp_matches(line, '\p{{Lu}}') and not regexp_matches(line, '\p{{Ll}}') or shouts >= 3
    or n <= 25 and regexp_matches(line, '(?i){"|".join(quality.BOILERPLATE)}') or tail = '' or not contains('{quality.MARKS}', right(tail, 1)))
  group by id),
c as (select id, count(*) as n_dup_lines from l where n > 0 and copy > 1 group by id),
v as (
  select doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols, coalesce(n_dup_lines, 0)::bigint as n_dup_lines,
         coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(lost, 0) as lost
  from d join w using (id) left join r using (id) left join f using (id) left join c using (id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
       not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and 100 * lost <= 50 * n_words as kept
from v"""


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simplex.clustered(table(spark, sf_dir, "embeddings"))


def _rounds(rounds: int) -> str:
    """Rounds of assignment and floored means; n(i) is the assignment before round i."""
    out = []
    for i in range(rounds + 1):
        out.append(f"""n{i} as materialized (
  select id, k, d from (select x.id, c.k, sum((x.x - c.x) * (x.x - c.x)) as d from x join c{i} c using (p) group by x.id, c.k)
  qualify row_number() over (partition by id order by d, k) = 1)""")
        if i < rounds:
            out.append(f"""c{i + 1} as materialized (
  select c.k, c.p, coalesce(m.x, c.x) as x from c{i} c left join (
    select k, p, (s - ((s % n + n) % n)) // n as x from (select k, p, sum(x.x) as s, count(*) as n from n{i} join x using (id) group by k, p)) m
  using (k, p))""")
    return ",\n".join(out)


OP13_SQL = f"""
with v as materialized (
  select row_number() over () as id, vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as e from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
x as materialized (select id, unnest(e) as x, unnest(range(1, 65)) as p from v),
c0 as materialized (
  select k, unnest(e) as x, unnest(range(1, 65)) as p from (
    select row_number() over (order by sha256('3:' || vec_id::varchar) nulls last, e) - 1 as k, e from v qualify k < 8)),
{_rounds(10)},
h as (select k, sha256(string_agg(x::varchar, ',' order by p)) as centroid_sha256 from c10 group by k)
select v.vec_id, k::int as cluster, d::bigint as distance, (sum(d) over (partition by k))::bigint as cluster_inertia,
       (sum(d) over ())::bigint as inertia, centroid_sha256
from n10 join v using (id) join h using (k)"""


QUERIES = {
    f.__name__: f
    for f in (op1_line_dedup, op2_embedding_dedup, op3_token_ids, op4_sentencepiece, op5_sharding, op6_url_filters,
              op7_language_id, op8_decontamination, op9_minhash_dedup, op10_secrets,
              op11_collocations, op12_quality_rules, op13_centroid_clustering)
}
ORACLES = {
    "op1_line_dedup": OP1_SQL, "op2_embedding_dedup": OP2_SQL, "op6_url_filters": OP6_SQL, "op8_decontamination": OP8_SQL,
    "op9_minhash_dedup": OP9_SQL, "op11_collocations": OP11_SQL, "op12_quality_rules": OP12_SQL, "op13_centroid_clustering": OP13_SQL,
}
