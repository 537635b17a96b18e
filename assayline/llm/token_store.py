"""Token ids in files of directly addressable codes.

Ids are cut into chunks of 8 bits. Level 0 holds the lowest chunk of every id and one bit per id that tells whether the id
goes on; level 1 holds the next chunk of those that do, and so on. A rank directory counts the bits before every block of
512, so the place of an id's next chunk is one look-up and a count of bits in a block: any id, and any run of ids, is read
without decoding what stands before it.

File: magic, numbers of documents, ids and levels (64 bit, little endian); document ids, a byte each that tells null, starts
of documents in the file; then per level its length, chunks, bitmap and rank directory.

Documents are range-partitioned by id and sorted, each task encodes its range and writes files of about `FILE_TOKENS` ids
into the shared folder, under a name of its own first, then renamed, so a repeated task does no harm. What comes back is
a table of files, one row each, whose running sum gives the starts.

Texts are encoded by the tokenizers library. White space ends its words, so a text is encoded word by word, each distinct word
once per worker as far as memory is set aside for it. Words of printable ASCII and Latin-1 letters, which normalising only
lower-cases, are cut into the library's pre-tokens here and given to its merging model; all others go through the library whole.

Null and empty texts have the end id only. Documents of equal ids stand next to each other, by text hash; null ids come first.
"""

from __future__ import annotations

import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from assayline.llm.common import WORDS_KEPT, bounds, shelved, shuffle_parts, slices, take_ragged, worker_cache
from assayline.session import scratch_path, settle

#: Fixed value of the contract: the id that ends each document.
END_ID = 2
MAGIC = b"DACTOK01"
BLOCK = 512
FILE_TOKENS = 1 << 23
FILES = "path string, part int, seq int, docs long, n_tokens long"
#: Words that NFC and the blank rule leave as they are, and whose lower case is one letter for one.
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
SPECIAL = b"<|"
MARKS = (b".", b",", b";", b":", b"!", b"?", b")")
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself if printable, else from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class WordIds(dict):
    """Number of a word; its ids stand in a ragged array."""

    def __init__(self, path: str):
        super().__init__()
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.cut = self.model.tokenize
        self.split = regex.compile(PRETOKEN).findall
        self.letters = dict(enumerate(byte_letters()))
        self.values, self.ends = array("I"), array("q", [0])

    def __missing__(self, word: bytes) -> int:
        if word.isascii() and (low := word.lower()) != word and SPECIAL not in word:
            i = self[word] = self[low]  # upper case gives the same ids
            return i
        if word.isalpha():  # ASCII letters in lower case: one pre-token as it stands
            ids = [t.id for t in self.cut(word.decode("ascii"))]
        elif word[:-1].isalpha() and word[-1:] in MARKS:  # letters and a mark are two pre-tokens, each met more often alone
            ids = self.of(self[word[:-1]]) + self.of(self[word[-1:]])
        else:
            ids = self.ids(word.decode("utf-8", "replace"))
        self.values.extend(ids)
        i = self[word] = len(self.ends) - 1
        self.ends.append(len(self.values))
        return i

    def of(self, i: int) -> array:
        return self.values[self.ends[i] : self.ends[i + 1]]

    def ids(self, text: str) -> list[int]:
        if not PLAIN.fullmatch(text) or "<|" in text:
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        parts = [text.lower()] if text.isalpha() else self.split(text.lower())
        if not text.isascii():
            parts = [p.encode().decode("latin-1").translate(self.letters) for p in parts]
        return [t.id for part in parts for t in self.cut(part)]

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, without end ids, and where each text starts."""
        found = [t.split() if t else [] for t in texts]
        starts = bounds(found)
        index = np.fromiter(map(self.__getitem__, chain.from_iterable(found)), np.int64, starts[-1])
        values, lengths = take_ragged(np.array(self.values, np.uint32), np.array(self.ends, np.int64), index)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        if len(self) > WORDS_KEPT:
            self.clear()
            self.values, self.ends = array("I"), array("q", [0])
        return values, ends[starts]


def tokenizer_at(path: str) -> WordIds:
    kept = worker_cache("tokenizers")
    if path not in kept:
        kept[path] = WordIds(path)
    return kept[path]


def pack(doc_ids: np.ndarray, null: np.ndarray, starts: np.ndarray, ids: np.ndarray) -> bytes:
    """One file: starts has one entry per document and one for the end."""
    out, levels, rest = [], 0, ids.astype(np.uint32)
    while True:
        on = rest > 0xFF
        bits = np.packbits(on, bitorder="little")
        counts = np.add.reduceat(on.astype(np.int64), np.arange(0, len(on), BLOCK)) if len(on) else np.zeros(0, np.int64)
        ranks = np.concatenate([[0], np.cumsum(counts)]).astype("<i8")
        out += [np.array([len(rest)], "<i8").tobytes(), (rest & 0xFF).astype(np.uint8).tobytes(), bits.tobytes(), ranks.tobytes()]
        levels += 1
        rest = rest[on] >> 8
        if not len(rest):
            break
    head = np.array([len(doc_ids), len(ids), levels], "<i8").tobytes()
    return b"".join([MAGIC, head, doc_ids.astype("<i8").tobytes(), null.astype(np.uint8).tobytes(), starts.astype("<i8").tobytes(), *out])


class TokenFile:
    """Reads a packed file. `token` and `tokens` touch only the chunks and ranks of what is asked for."""

    def __init__(self, data: bytes | memoryview):
        if bytes(data[:8]) != MAGIC:
            raise ValueError("not a token file")
        self.docs, self.size, levels = np.frombuffer(data, "<i8", 3, 8).tolist()
        at = 32

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            x = np.frombuffer(data, kind, n, at)
            at += x.nbytes
            return x

        self.doc_ids, self.null, self.starts = take("<i8", self.docs), take("u1", self.docs), take("<i8", self.docs + 1)
        self.levels = []
        for _ in range(levels):
            n = int(take("<i8", 1)[0])
            self.levels.append((take("u1", n), take("u1", -(-n // 8)), take("<i8", -(-n // BLOCK) + 1)))

    @staticmethod
    def rank(bits: np.ndarray, ranks: np.ndarray, i: int) -> int:
        """Number of ids before place i that go on."""
        block = i // BLOCK
        inside = np.unpackbits(bits[block * (BLOCK // 8) : -(-i // 8)], bitorder="little")[: i - block * BLOCK]
        return int(ranks[block]) + int(inside.sum())

    def token(self, i: int) -> int:
        value = 0
        for level, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * level)
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            i = self.rank(bits, ranks, i)
        return value

    def tokens(self, a: int, b: int) -> np.ndarray:
        """Ids of places a to b - 1."""
        out = np.zeros(b - a, np.uint32)
        at = np.arange(b - a)
        for level, (chunks, bits, ranks) in enumerate(self.levels):
            out[at] |= chunks[a:b].astype(np.uint32) << np.uint32(8 * level)
            on = np.unpackbits(bits[a >> 3 : -(-b // 8)], bitorder="little")[(a & 7) : (a & 7) + b - a].astype(bool)
            at = at[on]
            if not len(at):
                break
            a = self.rank(bits, ranks, a)
            b = a + len(at)
        return out


def write_rows(tokenizer: str, folder: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        words, files, place = tokenizer_at(tokenizer), *fs.FileSystem.from_uri(folder)
        docs, null, sizes, ids, held, seq = [], [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal held, seq
            starts = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)
            data = pack(np.concatenate(docs), np.concatenate(null), starts, np.concatenate(ids))
            name = f"tokens-{part:06d}-{seq:04d}.dac"
            own = f"{place}/_{name}.{uuid.uuid4().hex}"
            with files.open_output_stream(own) as f:
                f.write(data)
            files.move(own, f"{place}/{name}")
            row = pa.RecordBatch.from_pydict({
                "path": [f"{folder}/{name}"], "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()),
                "docs": [len(starts) - 1], "n_tokens": [int(starts[-1])]})
            for x in (docs, null, sizes, ids):
                x.clear()
            held, seq = 0, seq + 1
            return row

        for batch in slices(batches):
            values, starts = words.encode([t for t in batch.column("text").cast(pa.binary()).to_pylist()])
            n = len(starts) - 1
            ended = np.full(len(values) + n, end_id, np.uint32)
            ended[np.arange(len(values)) + np.repeat(np.arange(n), np.diff(starts))] = values
            column = batch.column("doc_id").cast(pa.int64())
            docs.append(column.fill_null(0).to_numpy(zero_copy_only=False))
            null.append(column.is_null().to_numpy(zero_copy_only=False))
            sizes.append(np.diff(starts) + 1)
            ids.append(ended)
            held += len(ended)
            if held >= FILE_TOKENS:
                yield flush()
        if held:
            yield flush()

    return run


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID) -> DataFrame:
    """Writes the files below `folder` (a URI) and returns their table (path, part, seq, docs, n_tokens, start)."""
    docs = shelved(docs, ("doc_id", "text"))[0]
    filesystem, place = fs.FileSystem.from_uri(folder)
    filesystem.create_dir(place, recursive=True)
    sorted_docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(shuffle_parts(docs), "doc_id")
    sorted_docs = sorted_docs.sortWithinPartitions("doc_id", F.xxhash64("text")).select("doc_id", "text")
    files = settle(sorted_docs.mapInArrow(write_rows(tokenizer, folder, end_id), FILES), "files")
    before = W.orderBy("part", "seq").rowsBetween(W.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_rows(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                files, place = fs.FileSystem.from_uri(path)
                with files.open_input_file(place) as f:
                    file = TokenFile(f.read())
                for a in range(0, file.docs, 500):
                    b = min(a + 500, file.docs)
                    starts = file.starts[a : b + 1]
                    raw = memoryview(file.tokens(int(starts[0]), int(starts[-1])).astype("<u4").tobytes())
                    cuts = (4 * (starts - starts[0])).tolist()
                    ids = [raw[x:y] for x, y in zip(cuts, cuts[1:], strict=False)]
                    out = {
                        "doc_id": pa.array(file.doc_ids[a:b], mask=file.null[a:b].astype(bool)), "start": pa.array(starts[:-1] + first),
                        "n_tokens": pa.array(np.diff(starts)), "ids_crc32": pa.array([zlib.crc32(x) for x in ids], pa.int64())}
                    yield pa.RecordBatch.from_pydict(out | ({"ids": pa.array(map(bytes, ids), pa.binary())} if with_ids else {}))

    return run


def read_tokens(files: DataFrame, with_ids: bool = True) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and, if they are
    asked for, ids (binary)."""
    kinds = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return files.select("path", "start").repartition(shuffle_parts(files)).mapInArrow(read_rows(with_ids), kinds)


def token_folder(docs: DataFrame) -> str:
    path = scratch_path(docs.sparkSession, "tokens")
    return path if "://" in path or path.startswith("file:") else "file://" + path
