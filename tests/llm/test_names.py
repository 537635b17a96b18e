"""Extra columns whose names meet those that the operators use or add, and very long documents."""

import time

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from assayline.llm import cap_filters, common, language, line_dedup, near_dup, pieces, secrets, sharding, token_store, url_filter, winnowing

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
NAMES = ["_k1", "_K2", "_doc", "a", "uid", "node", "component", "component_id", "band", "_loses", "_kept", "_h", "n", "r", "hits", "fp", "start", "url", "_bad",
         "_canonical", "o d d `name", "_col0", "_pieces", "_decoded", "_lang_pred", "_SCORE", "_slot", "_shard", "_n_lines", "_n_dropped", "_host", "_path", "_rule", "_verdict"]
LONG = " ".join(f"word{i}" for i in range(60))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, LONG + "\na line that three documents share"), (2, LONG + "\na line that three documents share"), (3, "x\na line that three documents share"), (4, None), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("doc_id", *[F.lit(f"was {n}").alias(n) for n in NAMES if n != "url"], F.lit("http://x.net/").alias("url"), F.lit("en").alias("lang"), "text")


def carried(got, added, want):
    """All rows are there and the other columns hold what they held."""
    names = [n for n in NAMES if n != "url" and n.lower() not in added]
    assert sorted(got.columns) == sorted(["doc_id", "text", "lang", "url", *names, *added])
    rows = got.collect()
    assert len(rows) == want
    for row in rows:
        values = dict(zip(got.columns, row, strict=True))
        assert all(values[n] == f"was {n}" for n in names)
    return rows


def test_names_are_carried_or_replaced(docs):
    carried(line_dedup.dedup_lines(docs), ("_n_lines", "_n_dropped"), 5)
    carried(near_dup.drop_near_duplicates(docs), (), 3)
    items = docs.where("doc_id = 1").select(F.lit("i").alias("item_id"), "text", "_k1", "fp", F.lit(0).alias("ITEMS"))
    carried(winnowing.decontaminate(docs, items), (), 3)
    model = language.learn(docs.withColumn("count", F.lit(1)))
    assert {x["_lang_pred"] for x in carried(language.predict(docs, model), ("_lang_pred", "_score"), 5)} == {"en", "und"}
    encoded = pieces.encode(docs, PIECES)
    carried(encoded, ("_pieces",), 5)
    assert all((x["text"] or "") == x["_decoded"] for x in carried(pieces.decode(encoded.drop("_decoded"), PIECES).withColumn("_pieces", F.lit(0)), ("_pieces", "_decoded"), 5))
    carried(url_filter.judge(docs, docs), ("_host", "_path", "_rule", "_verdict"), 5)
    carried(sharding.place(docs), ("_slot", "_shard"), 5)
    assert near_dup.near_duplicates(docs).count() == 5 and winnowing.contamination(docs, items).count() == 5 and secrets.find_secrets(docs).count() == 5


def test_names_of_other_tables(spark, docs, tmp_path):
    whole = docs.drop("_K2", "_SCORE", "_n_lines")  # a partitioned table keeps all names but those it replaces
    sharding.write_shards(whole, f"{tmp_path}/shards")
    back = sharding.read_shards(spark, f"{tmp_path}/shards", whole)
    assert back.count() == 5 and {x["a"] for x in back.select("a").collect()} == {"was a"}
    assert token_store.read_tokens(token_store.write_tokens(docs, WORDS, token_store.token_folder(docs)), with_ids=False).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    vectors = spark.createDataFrame([(i, [1.0, 2.0], 0, "x", "y", "z") for i in range(3)], "vec_id long, embedding array<float>, label int, uid string, k1 string, Node string")
    assert {tuple(x) for x in cap_filters.embedding_links(vectors).collect()} == {(i, 2, 0) for i in range(3)}


def test_a_name_twice_and_a_missing_name(docs):
    twice = docs.select("doc_id", "text", F.lit(1).alias("TEXT"), F.lit(2).alias("n"), F.lit(3).alias("n"))
    got = line_dedup.dedup_lines(twice)
    assert got.columns == ["doc_id", "text", "TEXT", "n", "n", "_n_lines", "_n_dropped"] and {tuple(x)[2:5] for x in got.collect()} == {(1, 2, 3)}
    with pytest.raises(ValueError, match="no column text"):
        common.shelved(docs.drop("text"), ("doc_id", "text"))


def test_copies_of_a_very_long_document(spark):
    """All lines of two of three copies go; the work must not grow with the square of their number."""
    n, began = 60_000, time.time()
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("a line of its own, number "), i.cast("string"))), "\n")
    df = spark.range(3).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 0, F.concat(text, F.lit("\nshort"))).otherwise(text).alias("text"))
    got = {x.doc_id: (x._n_lines, x._n_dropped, x.chars) for x in line_dedup.dedup_lines(df).select("doc_id", "_n_lines", "_n_dropped", F.length("text").alias("chars")).collect()}
    assert got[0] == (n + 1, n, 5) and got[1] == (n, n, 0) and got[2][:2] == (n, 0)
    assert time.time() - began < 60
