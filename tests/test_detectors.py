"""Batch detectors: set up once a worker, called in batches, one bad window fails alone."""

import os

from assayline.operators import screening
from assayline.plans import audits


def test_setups_and_calls_are_few_and_a_bad_window_fails_alone(spark, tmp_path):
    log = str(tmp_path / "log")

    def setup():
        def note(what):
            with open(log, "a") as f:
                f.write(f"{what} {os.getpid()}\n")

        def detect(texts):
            note(f"call {len(texts)}")
            if any("bad" in t for t in texts):
                raise ValueError("cannot read this")
            return [[("PER", 0.9)] * t.count("Ayşe") for t in texts]

        note("setup")
        return detect

    texts = [f"Ayşe {i}" if i % 3 else f"kimse {i}" for i in range(256)]
    texts[100] = "bad Ayşe"
    chunks = spark.createDataFrame([(f"d{i}", 0, t) for i, t in enumerate(texts)], "id string, chunk_no int, chunk string").repartition(8)
    found = screening.detect_batches(chunks, setup, size=16)
    rows = {r.id: r for r in found.collect()}
    assert len(rows) == 256
    assert [r.id for r in rows.values() if r.failed] == ["d100"] and rows["d100"].error == "ValueError: cannot read this"
    assert all((r.label == "PER") == bool(i % 3) for i, r in ((int(k[1:]), r) for k, r in rows.items()) if i != 100)
    lines = open(log).read().split("\n")
    workers = {x.split()[-1] for x in lines if x}
    assert sum(x.startswith("setup") for x in lines) == len(workers) <= 4
    calls = [int(x.split()[1]) for x in lines if x.startswith("call")]
    assert sum(c > 1 for c in calls) <= 256 // 16 + 8 + 4 and calls.count(1) <= 2 + 8
    assert screening.detect_batches(chunks.limit(0), setup).count() == 0


def test_audit_with_a_batch_detector(spark):
    df = spark.createDataFrame([(str(i), 2000 + i % 20, f"metin {i} " + ("bad" if i == 3 else "Ali")) for i in range(12)], "id string, year int, text string")

    def setup():
        def detect(texts):
            if any("bad" in t for t in texts):
                raise RuntimeError("no")
            return [[("PER", 0.99)] if "Ali" in t else [] for t in texts]

        return detect

    with audits.entity_audit(df, limits=None, setup=setup) as out:
        assert out["quality"].first()["inference_errors"] == 1
        assert [tuple(r) for r in out["errors"].collect()] == [("RuntimeError: no", 1)]
        assert {(r.label, r.documents) for r in out["entities"].collect()} == {("PER", 11)}


def test_a_wrong_number_of_results_is_a_failure(spark):
    chunks = spark.createDataFrame([("a", 0, "x"), ("b", 0, "y")], "id string, chunk_no int, chunk string")
    rows = screening.detect_batches(chunks, lambda: lambda texts: []).collect()
    assert all(r.failed and "0 results for 1" in r.error for r in rows)
