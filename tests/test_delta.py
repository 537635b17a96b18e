"""Merged pages, their stream, lineage and overlap of texts on small inputs with NULLs, repeats and awkward names."""

import json
import random

import pytest
from tests.conftest import rows

from assayline.operators import delta, duplicates, lineage
from assayline.sources import files
from assayline.sources.landed import read_search_pages
from assayline.spec import CORPUS

KEYS = ("court", "esas_no")


def page(start, *items):
    made = [{"documentId": i, "birimAdi": c, "esasNo": e, "kararTarihi": "2020-01-31T21:00:00.000+00:00"} for i, c, e in items]
    return json.dumps({"data": {"emsalKararList": made, "start": start, "total": 9}, "requested_page_size": 3})


PAGES = [
    page(0, ("1", "a", "1/1"), ("2", "b", "2/2"), (None, "c", "3/3")),
    page(3, ("2", "z", "9/9"), ("3", "k", "5/5"), (None, None, "4/4"), (None, None, "4/4")),
    page(6, (None, "k", "5/5"), ("4", None, "5/5")), page(9),
]
FRESH = [("2", "b", "2/2"), (None, "c", "3/3"), (None, None, "4/4"), (None, None, "4/4"), ("4", None, "5/5")]


@pytest.fixture
def snapshot(spark):
    known = [("1", "x", "0/0"), ("7", "k", "5/5"), (None, None, "4/4"), (None, None, None)]
    at = [CORPUS.names.index(c) for c in ("document_id", *KEYS)]
    return spark.createDataFrame([tuple(dict(zip(at, k)).get(i) for i in range(len(CORPUS))) for k in known], CORPUS)


def land(folder, pages, name="a.json"):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(pages))
    return str(folder)


def test_merge(spark, snapshot, tmp_path):
    records = delta.landed_records(read_search_pages(spark, land(tmp_path / "in", PAGES)), "s")
    new = delta.new_records(snapshot, records, KEYS)
    assert rows(new, "document_id", *KEYS) == sorted(FRESH, key=repr)
    assert {(r.karar_tarihi, r.year, r.month, r.source) for r in new.collect()} == {("2020-02-01", 2020, 2, "s")}
    merged = delta.merge_delta(snapshot, records, KEYS)
    assert merged.count() == snapshot.count() + len(FRESH) and merged.schema.names == CORPUS.names
    assert delta.new_records(snapshot, records.limit(0), KEYS).count() == 0
    assert delta.new_records(snapshot.limit(0), records, KEYS).count() == 8


def test_stream_equals_merge_and_repeats_nothing(spark, snapshot, tmp_path):
    folder, sink, marks = land(tmp_path / "in", PAGES), str(tmp_path / "sink"), str(tmp_path / "marks")
    run = lambda m: delta.delta_stream(spark, folder, snapshot, sink, m, "s", KEYS)
    assert rows(run(marks), "document_id", *KEYS) == sorted(FRESH, key=repr)
    land(tmp_path / "in", [page(12, ("2", "b", "2/2"), ("8", "n", "8/8"))], "b.json")
    later = rows(run(marks), "document_id", *KEYS)
    assert later == sorted([*FRESH, ("8", "n", "8/8")], key=repr)
    # Lost progress: all pages come again; only rows that nothing can identify are added once more.
    again = rows(run(str(tmp_path / "marks2")), "document_id", *KEYS)
    assert again == sorted([*later, (None, None, "4/4"), (None, None, "4/4")], key=repr)


def test_lineage_names_files_of_equal_and_awkward_names(spark, tmp_path):
    for name in ("k=1/part-0.parquet", "k=2/part-0.parquet", "k=2/a b+c%20d.parquet"):
        path = tmp_path / "data" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        import pandas as pd

        pd.DataFrame({"doc": [name, None], "lineage": [0, 0]}).to_parquet(path)
    root = str(tmp_path / "data")
    hashes = {r.file: r.sha256 for r in files.file_hash(spark, root).collect()}
    listed = [("r9", f, h) for f, h in hashes.items() if "k=1" not in f]
    shards = spark.createDataFrame(listed * 2, "revision string, file string, expected_sha256 string")
    out = lineage.with_lineage(spark.read.parquet(root), shards, root + "/", ["one"], "doc", ("doc", "k")).collect()
    assert len(out) == 6 and all(r.lineage.file in hashes for r in out)
    for r in out:
        if r.doc is not None:
            assert r.lineage.file == r.doc == r.lineage.document_id
        known = "k=1" not in r.lineage.file
        assert r.lineage.shard_hash == (hashes[r.lineage.file] if known else None)
        assert r.lineage.revision == ("r9" if known else None)
        assert r.lineage.key == [r.doc, str(r.k)] and r.lineage.steps == ["one"]


def test_text_overlap(spark):
    left = spark.createDataFrame([(1, "İki  Söz"), (2, None), (3, ""), (4, "***"), (5, "yok"), (1, "iki söz")], "id int, text string")
    right = spark.createDataFrame([("iki söz", 1), ("IKI SÖZ", 2), ("İKİ SÖZ", 3), (None, 4), ("", 5), ("---***", 6)], "text string, in_other int")
    got = rows(duplicates.text_overlap(left, right), "id", "in_other")
    n = dict.fromkeys((2, 3, 5), 0)
    assert [x for x in got if x[0] in n] == [(2, 0), (3, 0), (5, 0)]
    assert [x for x in got if x[0] == 1] == [(1, 3), (1, 3)]
    assert duplicates.text_overlap(left.limit(0), right).count() == 0


def test_a_batch_costs_what_its_own_rows_cost(spark, snapshot, tmp_path):
    """Many landings: what is scanned for a batch is the batch; neither snapshot nor sink is read again."""
    folder, sink, marks = tmp_path / "in", str(tmp_path / "sink"), str(tmp_path / "marks")
    folder.mkdir()
    base = str(tmp_path / "snapshot")
    snapshot.write.parquet(base)
    known = spark.read.parquet(base)
    reads = []
    for k in range(5):
        land(folder, [page(k, (f"n{k}", f"k{k}", f"9/{k}"), ("n0", "x", f"8/{k}"), (f"m{k}", "k0", "9/0"))], f"{k}.json")
        out = delta.delta_stream(spark, str(folder), known, sink, marks, "s", KEYS)
        state = sorted((tmp_path / "marks" / "state").glob("*"))
        assert len(state) >= 2
        reads.append(out.count())
    # Of each landing the first item is new; the id of the second, and the key of the third, were there from the first on.
    assert [b - a for a, b in zip(reads, reads[1:], strict=False)] == [1] * 4


def test_a_batch_run_again_adds_nothing_twice(spark, snapshot, tmp_path):
    folder, sink, marks = land(tmp_path / "in", PAGES), str(tmp_path / "sink"), str(tmp_path / "marks")
    first = rows(delta.delta_stream(spark, folder, snapshot, sink, marks, "s", KEYS), "document_id", *KEYS)
    (tmp_path / "marks" / "commits" / "0").unlink()  # lost between the write and its commit
    for crc in (tmp_path / "marks" / "commits").glob(".0.crc"):
        crc.unlink()
    assert rows(delta.delta_stream(spark, folder, snapshot, sink, marks, "s", KEYS), "document_id", *KEYS) == first


def test_stream_of_many_keys_equals_a_plain_version(spark, tmp_path):
    """Three landings with repeats of ids and keys, and a snapshot that has some: one call for the rows of a part, none a key."""
    rng = random.Random(4)
    folder, sink, marks = tmp_path / "in", str(tmp_path / "sink"), str(tmp_path / "marks")
    at = [CORPUS.names.index(c) for c in ("document_id", *KEYS)]
    old = [(str(n), f"c{n % 3}" if n % 2 else None, f"{n}/1") for n in range(0, 60, 2)] + [(None, "c1", "7/1"), (None, "c1", "7/1")]
    snapshot = spark.createDataFrame([tuple(dict(zip(at, k)).get(i) for i in range(len(CORPUS))) for k in old], CORPUS)
    ids, keys, want = {k[0] for k in old} - {None}, {k[1:] for k in old if None not in k[1:]}, []
    for landing in range(3):
        items = [(rng.choice([None, *map(str, range(90))]), rng.choice([None, "c0", "c1", "c2"]), rng.choice([None, *(f"{n}/1" for n in range(90))]))
                 for _ in range(150)]
        pages = [page(start, *items[start : start + 3]) for start in range(0, len(items), 3)]
        rng.shuffle(pages)
        land(folder, pages, f"{landing}.json")
        first = list({item[0]: item for item in reversed(items) if item[0] and item[0] not in ids}.values()) + [i for i in items if i[0] is None]
        ids |= {item[0] for item in items}
        added = [item for item in first if None in item[1:] or item[1:] not in keys]
        keys |= {item[1:] for item in added}
        want += added
        assert rows(delta.delta_stream(spark, str(folder), snapshot, sink, marks, "s", KEYS), "document_id", *KEYS) == sorted(want, key=repr)
    names = [json.loads(line)["operatorInfo"]["operatorName"] for f in (tmp_path / "marks" / "state").glob("*/_metadata/metadata")
             for line in f.read_text().splitlines() if line.startswith("{")]
    assert set(names) == {"dedupe"}
