"""Token files and pieces: against the libraries, round trips, random access."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from assayline.llm import pieces, queries, token_store

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "  two  blanks \n\n\tand\rtabs  ", "x", "ﬁ é ① 日本語 😀😀", "Ünïcode ŁÓDŹ İstanbul ΣΑΣ ²³½ 1234 it's DON'T we'll", "<|endoftext|>x <|",
       "a\x1cb　c\x00 \x01", "_foo_bar. ¡hola! ªº µm ×÷", "é word, (word) WORD! don.'", "   \n    lead", "z" * 5000, "ab " * 20_000, "日" * 3000,
       " " * 40 + "x", "a" + " " * 17 + "b" + " " * 33]


def test_word_ids_equal_the_library():
    library, words = Tokenizer.from_file(WORDS), token_store.WordIds(WORDS)
    rnd = random.Random(2)
    texts = ODD + ["".join(rnd.choice("abcXYZ éÜß .,;!'’-_19\n") for _ in range(80)) for _ in range(500)]
    values, starts = words.encode([None if t is None else t.encode() for t in texts])
    for i, t in enumerate(texts):
        assert values[starts[i] : starts[i + 1]].tolist() == (library.encode(t, add_special_tokens=False).ids if t else []), t


@pytest.mark.parametrize("high", [1, 256, 257, 49408, 2**31])
def test_files_give_back_any_token(high):
    rng = np.random.default_rng(high)
    ids = rng.integers(0, high, 5000).astype(np.uint32)
    ids[rng.integers(0, 5000, 2000)] = 0
    starts = np.sort(np.concatenate([[0, 5000], rng.integers(0, 5000, 30)]))
    file = token_store.TokenFile(token_store.pack(np.arange(31), np.zeros(31, bool), starts, ids))
    assert [file.token(int(i)) for i in range(0, 5000, 7)] == ids[::7].tolist()
    for a, b in [(0, 5000), (0, 0), (511, 513), (1023, 4097), (4999, 5000), (8, 16)]:
        assert (file.tokens(a, b) == ids[a:b]).all()
    assert file.starts.tolist() == starts.tolist()
    empty = token_store.TokenFile(token_store.pack(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(1, np.int64), np.zeros(0, np.uint32)))
    assert empty.size == 0 and len(empty.tokens(0, 0)) == 0


def plain_rows(rows):
    library, at, out = Tokenizer.from_file(WORDS), 0, []
    for i, t in rows:
        ids = [*(library.encode(t, add_special_tokens=False).ids if t else []), 2]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_token_query_equals_plain_version(spark, monkeypatch):
    folder = "/root/testdata/sf0.001"
    rows = sorted(map(tuple, queries.table(spark, folder, "documents").select("doc_id", "text").collect()))
    assert sorted(map(tuple, queries.op3_token_ids(spark, folder).collect())) == plain_rows(rows)
    monkeypatch.setattr(token_store, "FILE_TOKENS", 100)  # several files a task
    rows = [(i * 3, t) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows[::-1], "doc_id long, text string").withColumnRenamed("text", "text")
    files = token_store.write_tokens(docs, WORDS, token_store.token_folder(docs))
    assert sorted(x[:4] for x in token_store.read_tokens(files).collect()) == plain_rows(rows)
    extra = spark.createDataFrame([(None, "a", 1), (None, None, 2), (1, "a", 3), (1, "a", 4)], "doc_id long, text string, start int")
    got = token_store.read_tokens(token_store.write_tokens(extra, WORDS, token_store.token_folder(extra))).collect()
    assert [x.doc_id for x in sorted(got, key=lambda x: x.start)] == [None, None, 1, 1]
    none = docs.where("doc_id < 0")
    assert token_store.read_tokens(token_store.write_tokens(none, WORDS, token_store.token_folder(none))).count() == 0


def test_pieces_equal_the_library():
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rnd = random.Random(4)
    texts = ODD + ["".join(rnd.choice("abcdefghij klmnop  qrstu\n.,'éü日") for _ in range(60)) for _ in range(2000)] + [
        "".join(rnd.choice("aeinrst ") for _ in range(200)) for _ in range(300)]
    values, starts = pieces.encode_texts(texts, PIECES)
    for i, t in enumerate(texts):
        ids = values[starts[i] : starts[i + 1]].tolist()
        assert ids == (library.encode(t) if t else []), t
    assert pieces.decode_ids(values, starts, PIECES) == [t or "" for t in texts]
    broken = np.array([5, 3 + 0xC3, 400_000, -1, 1], np.int32)
    assert pieces.decode_ids(broken, np.array([0, 5]), PIECES) == ["\x02�"]


def test_blank_sign_in_texts():
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rnd = random.Random(6)
    texts = ["▁", "▁▁", " ▁", "▁ ", "a▁b", "a ▁ b", "▁a", "a▁", "\n▁", "▁\n ▁", "é▁日▁ ", "▁▁▁▁▁▁▁▁▁"] + [
        "".join(rnd.choice("aeinst ▁▁ .\né日") for _ in range(rnd.randint(1, 60))) for _ in range(6000)]
    units = pieces.Units(pieces.model_at(PIECES))
    for some in (texts[:3000], texts[3000:]):
        values, starts = pieces.encode_texts(some, PIECES, units)
        for i, t in enumerate(some):
            assert values[starts[i] : starts[i + 1]].tolist() == library.encode(t), t
        assert pieces.decode_ids(values, starts, PIECES) == [t.replace("▁", " ") for t in some]


def test_nothing_is_kept_beyond_a_task(spark):
    """What a worker holds between tasks does not grow with the texts it has met."""
    docs = spark.range(4000).selectExpr("id", "concat_ws(' ', sha2(cast(id as string), 256), sha2(cast(-id as string), 512)) as text")
    assert pieces.encode(docs, PIECES).count() == 4000

    def held(_):
        import sys

        kept = getattr(sys, "_assayline_kept", {}).get("pieces", {})
        yield max([0, *(len(x) if isinstance(x, dict) else 0 for x in kept.values())])

    assert max(spark.sparkContext.parallelize(range(8), 8).mapPartitions(held).collect()) == 0


def test_piece_frames(spark):
    df = spark.createDataFrame([(1, "a b", "k"), (2, None, None), (3, "", "k"), (3, "", "k")], "doc_id int, text string, `pieces x` string")
    done = pieces.decode(pieces.encode(df, PIECES), PIECES)
    assert [(x.doc_id, x._decoded, len(x._pieces)) for x in done.orderBy("doc_id").collect()] == [(1, "a b", 2), (2, "", 0), (3, "", 0), (3, "", 0)]
    assert pieces.encode(df.limit(0), PIECES).count() == 0
    lists = spark.createDataFrame([(1, None), (2, []), (3, [sentencepiece.SentencePieceProcessor(model_file=PIECES).piece_to_id("a")])], "i int, _pieces array<int>")
    assert [x._decoded for x in pieces.decode(lists, PIECES).orderBy("i").collect()] == ["", "", "a"]


def test_piece_query_equals_the_library(spark):
    folder = "/root/testdata/sf0.001"
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = dict(map(tuple, queries.table(spark, folder, "documents").select("doc_id", "text").collect()))
    got = queries.op4_sentencepiece(spark, folder).collect()
    assert {x.doc_id: x.n_pieces for x in got} == {i: len(library.encode(t)) if t else 0 for i, t in texts.items()}
    assert all(x.exact for x in got)
